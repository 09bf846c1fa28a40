"""Tiles, fits, catalogues and streams over the same tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..jobs import review, search
from ..operators import halo
from ..operators import patchfit as H
from ..operators import select as P
from ..operators import tracking as T
from ..operators import windows as W
from ..sources import store, tables, views
from ..sources.views import CELLS_SQL, SOURCES_SQL
from .cube import PEAK
from .registry import query, rounded, six
from .tracks import DYN, TRACK, _patch_sql, _sky

C = f"WITH {CELLS_SQL}, {SOURCES_SQL} "
PLANE = ("time_idx", "freq_idx", "pol_idx")


@query("t2_tile_regroup", C + "SELECT time_idx, freq_idx, pol_idx, l_idx // 3 AS tile_l, m_idx // 3 AS tile_m, min(l_idx) AS l0, min(m_idx) AS m0, count(DISTINCT l_idx) AS n_l, count(DISTINCT m_idx) AS n_m, count(flux) AS n, round(sum(flux * (l_idx * 8 + m_idx)), 4) + 0.0 AS mark FROM cells GROUP BY ALL")
def tile_regroup(spark, sf_dir):
    """Cells to tiles of 4, regrouped to tiles of 3, and back to pixels."""
    tiles = store.regroup(store.to_tiles(views.cells(spark, sf_dir), 4), 3)
    shape = tiles.select(*PLANE, "tile_l", "tile_m", "l0", "m0", F.col("n_l").cast("long").alias("n_l"), F.col("n_m").cast("long").alias("n_m"))
    pixels = store.to_cells(tiles).withColumns({"tile_l": F.expr("l_idx div 3"), "tile_m": F.expr("m_idx div 3")})
    sums = pixels.groupBy(*PLANE, "tile_l", "tile_m").agg(F.count("flux").alias("n"), F.sum(F.col("flux") * (F.col("l_idx") * 8 + F.col("m_idx"))).alias("mark"))
    return rounded(shape.join(sums, [*PLANE, "tile_l", "tile_m"]), "mark", digits=4)


@query("j1_tile_lookup", C + TRACK + " SELECT source_id, t.time_idx, freq_idx, pol_idx, round(flux, 6) + 0.0 AS flux FROM track t JOIN cells c ON c.time_idx = t.time_idx AND c.l_idx = t.l_idx AND c.m_idx = t.m_idx WHERE visible")
def tile_lookup(spark, sf_dir):
    return T.follow(*_sky(spark, sf_dir), T.pixels_of(views.tiles(spark, sf_dir), 4, six)).select("source_id", *PLANE, "flux")


@query("a25_axis_lengths", C + ", a AS (SELECT CASE WHEN freq_idx % 2 = 0 THEN 'even' ELSE 'odd' END AS variable, time_idx FROM cells WHERE freq_idx % 2 = 0 OR time_idx < (SELECT max(time_idx) - 1 FROM cells)), l AS (SELECT variable, max(time_idx) + 1 AS length FROM a GROUP BY ALL) SELECT variable, length, (SELECT min(length) FROM l) AS least FROM l")
def axis_lengths(spark, sf_dir):
    cells = views.cells(spark, sf_dir)
    last = cells.agg(F.max("time_idx").alias("last"))
    a = cells.join(F.broadcast(last), F.lit(True)).where("freq_idx % 2 = 0 OR time_idx < last - 1")
    return store.axis_lengths(a.select(F.when(F.col("freq_idx") % 2 == 0, "even").otherwise("odd").alias("variable"), "time_idx"))


@query("a26_best_stokes_plane", C + ", n AS (SELECT time_idx, freq_idx // 2 AS freq_idx, stokes, freq_idx % 2 AS plane_idx, count(flux) AS n FROM cells GROUP BY ALL) SELECT time_idx, freq_idx, stokes, arg_max(plane_idx, struct_pack(n := n, p := -plane_idx)) AS plane_idx FROM n GROUP BY ALL")
def best_stokes_plane(spark, sf_dir):
    cells = views.cells(spark, sf_dir)
    return store.best_planes(cells.select("time_idx", F.expr("freq_idx div 2").alias("freq_idx"), "stokes", (F.col("freq_idx") % 2).alias("plane_idx"), "flux"))


@query(
    "h3_regrid",
    C + """, ax AS (SELECT i, least(CAST(floor((0.1 + 0.3 * i) / 2 * 7) AS BIGINT), 6) AS k, (0.1 + 0.3 * i) / (2 / 7.0) AS pos, 0.3 * i <= 1.9 AS ok FROM (SELECT unnest([0, 1, 2, 3, 4, 5, 6, 7]) AS i)),
w AS (SELECT i, k AS idx, 1 - (pos - k) AS part, ok FROM ax UNION ALL SELECT i, k + 1, pos - k, ok FROM ax)
SELECT time_idx, freq_idx, pol_idx, CAST(x.i AS BIGINT) AS l_idx, CAST(y.i AS BIGINT) AS m_idx,
       round(CASE WHEN bool_and(x.ok AND y.ok) AND count(flux) = 4 THEN sum(flux * x.part * y.part) END, 5) + 0.0 AS flux
FROM cells JOIN w x ON x.idx = l_idx JOIN w y ON y.idx = m_idx GROUP BY ALL""",
)
def regrid(spark, sf_dir):
    """Every plane on a shifted, wider grid that goes beyond the old one, by tiles with borders."""
    old, new = (-1.0, 2 / 7, 8), (-0.9, 0.3, 8)
    return rounded(store.to_cells(halo.regrid_tiles(views.tiles(spark, sf_dir, 3), (old, old), (new, new), 5)), "flux", digits=5)


@query("w6_dedisperse_interpolated", C + DYN + """, s AS (SELECT *, 60000.0 + 0.01 * time_idx AS mjd, 4148.808 * 2.0 * (1 / (freq_hz * freq_hz / 1e12) - 1 / (84.0 * 84.0)) / 86400 AS delay FROM dyn), ok AS (SELECT * FROM s WHERE flux IS NOT NULL),
p AS (SELECT s.source_id, s.freq_idx, s.time_idx, s.mjd + s.delay AS pos, max(a.mjd) AS lo FROM s LEFT JOIN ok a ON a.source_id = s.source_id AND a.freq_idx = s.freq_idx AND a.mjd <= s.mjd + s.delay GROUP BY ALL),
q AS (SELECT p.*, min(b.mjd) AS hi FROM p LEFT JOIN ok b ON b.source_id = p.source_id AND b.freq_idx = p.freq_idx AND b.mjd >= p.pos GROUP BY ALL)
SELECT q.source_id, q.freq_idx, q.time_idx, round(CASE WHEN hi = lo THEN x.flux ELSE x.flux + (y.flux - x.flux) * (pos - lo) / (hi - lo) END, 4) + 0.0 AS flux
FROM q LEFT JOIN ok x ON x.source_id = q.source_id AND x.freq_idx = q.freq_idx AND x.mjd = lo LEFT JOIN ok y ON y.source_id = q.source_id AND y.freq_idx = q.freq_idx AND y.mjd = hi""")
def dedisperse_interpolated(spark, sf_dir):
    dyn = views.cells(spark, sf_dir).select(((F.col("l_idx") * 8 + F.col("m_idx")) * 2 + F.col("pol_idx")).alias("source_id"), "freq_idx", "time_idx", "mjd", "freq_hz", "flux")
    return rounded(H.dedisperse_interpolated(dyn, 2.0, 84.0), "flux", digits=4)


@query("e4_patch_fit")
def patch_fit(spark, sf_dir):
    """Gaussian fits of every tracked patch of every plane; tests hold the helper against planted sources."""
    tiles, places, _ = _places(spark, sf_dir)
    fits = H.fit_tiles(tiles, places, 4, 2, 1.0, 1.0).withColumn("source_id", F.col("l_c") * 8 + F.col("m_c"))
    return rounded(fits.select("source_id", *PLANE, "peak", "offset", "l_fit", "m_fit", "chi2", "centre", "patch_max", "good"), "peak", "offset", "l_fit", "m_fit", "chi2", "centre", "patch_max", digits=4)


WIDE = TRACK + """, places AS (SELECT DISTINCT time_idx, l_idx AS l_c, m_idx AS m_c FROM track WHERE visible),
px AS (SELECT p.*, freq_idx, pol_idx, flux, c.l_idx - l_c AS dx, c.m_idx - m_c AS dy FROM places p JOIN cells c ON c.time_idx = p.time_idx AND abs(c.l_idx - l_c) <= 2 AND abs(c.m_idx - m_c) <= 2 WHERE flux IS NOT NULL)"""
PLACE = ["time_idx", "l_c", "m_c", "freq_idx", "pol_idx"]


def _places(spark, sf_dir):
    """Tiles of vectors that are dealt to many tasks, the places that sources are seen at, and the times."""
    times = views.axis(spark, sf_dir, "time_idx")
    tiles = views.tiles(spark, sf_dir, vectors=views.vectors(spark, sf_dir))
    return tiles, T.places_of(views.sources(spark, sf_dir), times, 8, 8), times


@query(
    "e4_fixed_fit",
    C + WIDE + """, s AS (SELECT time_idx, l_c, m_c, freq_idx, pol_idx, regr_slope(flux, g) AS a, regr_intercept(flux, g) AS b, avg(flux) AS mean, regr_syy(flux, g) AS syy, regr_sxy(flux, g) AS sxy, count(*) AS n FROM (SELECT *, exp(-0.5 * (dx * dx + dy * dy)) AS g FROM px) GROUP BY ALL)
SELECT time_idx, l_c, m_c, freq_idx, pol_idx, round(greatest(a, 0), 5) + 0.0 AS peak, round(CASE WHEN a >= 0 THEN b ELSE mean END, 5) + 0.0 AS offset, round((syy - CASE WHEN a >= 0 THEN a * sxy ELSE 0 END) / (n - 2), 5) + 0.0 AS chi2 FROM s WHERE n > 2 AND a IS NOT NULL""",
)
def fixed_fit(spark, sf_dir):
    tiles, places, _ = _places(spark, sf_dir)
    return rounded(H.fit_fixed_tiles(tiles, places, 4, 2, 1.0, 1.0), "peak", "offset", "chi2", digits=5)


@query(
    "e5_peak_positions",
    C + WIDE + """, md AS (SELECT time_idx, l_c, m_c, freq_idx, pol_idx, median(flux) AS low FROM px GROUP BY ALL), w AS (SELECT *, greatest(flux - low, 0) AS w FROM px JOIN md USING (time_idx, l_c, m_c, freq_idx, pol_idx)),
o AS (SELECT time_idx, l_c, m_c, freq_idx, pol_idx, CASE WHEN sum(w) > 0 THEN sum(w * dx) / sum(w) ELSE 0 END AS dl, CASE WHEN sum(w) > 0 THEN sum(w * dy) / sum(w) ELSE 0 END AS dm FROM w GROUP BY ALL),
q AS (SELECT *, CAST(least(greatest(round_even(l_c + greatest(least(dl, 2), -2), 0), 0), 7) AS BIGINT) AS l_peak, CAST(least(greatest(round_even(m_c + greatest(least(dm, 2), -2), 0), 0), 7) AS BIGINT) AS m_peak FROM o),
t AS (SELECT DISTINCT time_idx, ((18.697374558 + 24.06570982441908 * (mjd - 51544.5) + -118.2817 / 15) % 24 + 24) % 24 * 15 AS ra0 FROM cells),
d AS (SELECT q.*, ra0, 2 * l_peak / 7 - 1 AS l, 2 * m_peak / 7 - 1 AS m FROM q JOIN t USING (time_idx)), e AS (SELECT *, CASE WHEN l * l + m * m <= 1 THEN sqrt(1 - l * l - m * m) END AS c FROM d)
SELECT time_idx, l_c, m_c, freq_idx, pol_idx, l_peak, m_peak, round(((ra0 + degrees(atan2(l, c * cos(radians(37.2339)) - m * sin(radians(37.2339))))) % 360 + 360) % 360, 4) AS ra_deg, round(degrees(asin(c * sin(radians(37.2339)) + m * cos(radians(37.2339)))), 4) AS dec_deg FROM e""",
)
def peak_positions(spark, sf_dir):
    tiles, places, times = _places(spark, sf_dir)
    found = H.peak_positions(H.moments_tiles(tiles, places, 4, 2), times, 8, 8)
    return rounded(found.select(*PLACE, "l_peak", "m_peak", "ra_deg", "dec_deg"), "ra_deg", "dec_deg", digits=4)


def _heat_sql(value: str, more: str = "") -> str:
    return _patch_sql(value, more) + " SELECT t.source_id, t.time_idx, f.freq_idx, f.pol_idx, round(value, 6) + 0.0 AS value FROM track t CROSS JOIN (SELECT DISTINCT freq_idx, pol_idx FROM cells) f LEFT JOIN v ON v.source_id = t.source_id AND v.time_idx = t.time_idx AND v.freq_idx = f.freq_idx AND v.pol_idx = f.pol_idx"


def _heat(spark, sf_dir, method):
    return review.heat_map(views.tiles(spark, sf_dir, vectors=views.vectors(spark, sf_dir)), *_sky(spark, sf_dir), method, 1, 4, six)


@query("e9_heat_map_mean", _heat_sql("avg(flux)"))
def heat_map_mean(spark, sf_dir):
    return _heat(spark, sf_dir, "mean")


@query("e9_heat_map_std", _heat_sql("stddev_pop(flux)"))
def heat_map_std(spark, sf_dir):
    return _heat(spark, sf_dir, "std")


@query("e9_heat_map_patch_max", _heat_sql("max(flux)"))
def heat_map_patch_max(spark, sf_dir):
    return _heat(spark, sf_dir, "patch_max")


@query("e9_heat_map_min", _heat_sql("min(flux)"))
def heat_map_min(spark, sf_dir):
    return _heat(spark, sf_dir, "min")


@query("e9_heat_map_dynamic_spectrum", C + TRACK + " SELECT source_id, track.time_idx, f.freq_idx, f.pol_idx, round(flux, 6) + 0.0 AS value FROM track CROSS JOIN (SELECT DISTINCT freq_idx, pol_idx FROM cells) f LEFT JOIN cells c ON c.time_idx = track.time_idx AND c.freq_idx = f.freq_idx AND c.pol_idx = f.pol_idx AND c.l_idx = track.l_idx AND c.m_idx = track.m_idx")
def heat_map_dynamic_spectrum(spark, sf_dir):
    return _heat(spark, sf_dir, "dynamic_spectrum")


@query(
    "e6_source_catalogue",
    C + PEAK + """, pk AS (SELECT time_idx, freq_idx, pol_idx, l_idx, m_idx, flux FROM box WHERE flux = top AND flux / sqrt(q / n - (s / n) * (s / n)) >= 2), i AS (SELECT time_idx, pol_idx, l_idx, m_idx, max(CASE WHEN freq_idx = 2 THEN flux END) AS s1, max(CASE WHEN freq_idx = 7 THEN flux END) AS s2 FROM cells GROUP BY ALL)
SELECT time_idx, freq_idx, pol_idx, l_idx, m_idx, round(flux, 6) AS flux, round(CASE WHEN s1 > 0 AND s2 > 0 THEN ln(s2 / s1) / ln(72e6 / 42e6) END, 5) + 0.0 AS alpha FROM pk LEFT JOIN i USING (time_idx, pol_idx, l_idx, m_idx)""",
)
def source_catalogue(spark, sf_dir):
    found = search.source_catalogue(views.cells(spark, sf_dir), 2, 7, 2.0, 6, 2)
    return rounded(rounded(found.select(*PLANE, "l_idx", "m_idx", "flux", "alpha"), "flux"), "alpha", digits=5)


@query(
    "e7_transient_search",
    C + ", r AS (SELECT freq_idx, pol_idx, l_idx, m_idx, avg(flux) AS mean FROM cells GROUP BY ALL), diff AS (SELECT time_idx, freq_idx, pol_idx, l_idx, m_idx, flux - mean AS flux FROM cells JOIN r USING (freq_idx, pol_idx, l_idx, m_idx))" + PEAK.replace("cells a", "diff a").replace("cells b", "diff b") + """,
pk AS (SELECT freq_idx, pol_idx, l_idx, m_idx, flux / sqrt(q / n - (s / n) * (s / n)) AS snr FROM box WHERE flux = top AND flux / sqrt(q / n - (s / n) * (s / n)) >= 2),
hits AS (SELECT pol_idx, l_idx, m_idx, count(DISTINCT freq_idx) AS channels, max(snr) AS snr FROM pk GROUP BY ALL),
v AS (SELECT pol_idx, l_idx, m_idx, CASE WHEN avg(flux) > 0 THEN stddev_pop(flux) / avg(flux) ELSE 0 END AS variability, count(flux) AS samples FROM cells GROUP BY ALL)
SELECT pol_idx, l_idx, m_idx, channels, round(snr, 4) AS snr, round(variability, 4) + 0.0 AS variability, samples, round(channels / (SELECT count(DISTINCT freq_idx) FROM cells), 4) + 0.0 AS share FROM hits JOIN v USING (pol_idx, l_idx, m_idx) WHERE channels / (SELECT count(DISTINCT freq_idx) FROM cells) >= 0.3""",
)
def transient_search(spark, sf_dir):
    """Differences, peaks, variability and channels in one job."""
    return rounded(search.transient_search(views.cells(spark, sf_dir), 2.0, 6, 2, 0.3), "snr", "variability", "share", digits=4)


@query("p15_inner_detections", C + PEAK + " SELECT time_idx, freq_idx, pol_idx, l_idx, m_idx FROM box WHERE flux = top AND flux / sqrt(q / n - (s / n) * (s / n)) > 2.1 AND l_idx BETWEEN 2 AND 5 AND m_idx BETWEEN 2 AND 5")
def inner_detections(spark, sf_dir):
    return P.detections_inside(W.find_peaks(views.cells(spark, sf_dir), 2.0, 6, 2), 8, 8, 2.1, 1).select(*PLANE, "l_idx", "m_idx")


# Candidate pages with the raw page of the table as the text around them; labels in two orders.
INDEX_PAGE = """'<p>' || p_name || '</p><table><tr data-sid="no"><td>outside</td></tr></table><table class="big idx"><tr>' || CASE WHEN p_partkey % 2 = 0 THEN '<th>#</th><th>SNR</th><th>source</th><th>odd</th><th>n_v_epoch</th>' ELSE '<th>source</th><th>n_i_epoch</th><th>#</th><th> snr</th><th>odd</th>' END || '</tr><tr data-sid="J' || p_partkey || '">'
 || CASE WHEN p_partkey % 2 = 0 THEN '<td>' || p_size || '</td><td>' || p_size || '.5</td><td>x</td><td>y</td><td>' || p_partkey % 9 || '</td>' ELSE '<td>x</td><td>' || p_partkey % 9 || '</td><td>' || p_size || '</td><td>none</td><td>y</td>' END || '</tr><tr><td>no id</td></tr></table>' """


@query("s10_candidates", "SELECT CAST(p_partkey AS VARCHAR) AS page, 'J' || p_partkey AS source_id, CAST(p_size AS VARCHAR) AS rank, CASE WHEN p_partkey % 2 = 0 THEN p_size + 0.5 END AS snr, CAST(p_partkey % 9 AS VARCHAR) AS n_epoch, '' AS note FROM part")
def candidate_rows(spark, sf_dir):
    """Index pages made from the part table, read back by their labels."""
    pages = views.dealt(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", "p_size")).select(F.col("p_partkey").alias("page_id"), F.expr(INDEX_PAGE).alias("html"))
    return tables.candidates(tables.read_pages(pages)).select("page", "source_id", "rank", "snr", "n_epoch", "note")


SOURCE_PAGE = """'<div class="locbar"><span>combined position</span><div><input class="lv" value="' || printf_ra || ' ' || printf_dec || '"></div><input class="lv" value="other"></div><table><tr><th>LST</th><th>Date</th><th>band</th><th>SNR</th><th>RA</th><th>Dec</th></tr>'
 || '<tr><td>' || c_custkey % 30 || 'h</td><td>2025-05-' || lpad(CAST(1 + c_custkey % 28 AS STRING), 2, '0') || '</td><td>' || CASE WHEN c_custkey % 3 = 0 THEN 'Full' ELSE '32MHz' END || '</td><td>1,2' || lpad(CAST(c_custkey % 100 AS STRING), 2, '0') || '.5</td><td>' || printf_ra || '</td><td>' || printf_dec || '</td></tr><tr><td>17h</td><td>short</td></tr></table>'
 || '<table><tr><td>17h</td><td>2025-05-05</td><td>Full</td><td>9</td><td>1</td><td>2</td></tr></table>' """


def _source_pages(spark, sf_dir):
    c = views.dealt(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey")).select("c_custkey", (F.col("c_custkey") * 37 % 360).cast("string").alias("printf_ra"), (F.col("c_nationkey") * 5 - 30).cast("string").alias("printf_dec"))
    return tables.read_pages(c.select(F.col("c_custkey").alias("page_id"), F.expr(SOURCE_PAGE).alias("html")))


@query("s11_detections", "SELECT CAST(c_custkey AS VARCHAR) AS page, CAST(c_custkey % 30 AS INT) AS lst_hour, '2025-05-' || lpad(CAST(1 + c_custkey % 28 AS VARCHAR), 2, '0') AS date, CASE WHEN c_custkey % 3 = 0 THEN 'Full' ELSE '32MHz' END AS band, 1200.5 + c_custkey % 100 AS snr, CAST(c_custkey * 37 % 360 AS DOUBLE) AS ra, CAST(c_nationkey * 5 - 30 AS DOUBLE) AS dec FROM customer WHERE c_custkey % 30 <= 23")
def detection_rows(spark, sf_dir):
    """Detections of source pages made from the customer table; SNRs have thousands commas."""
    return tables.detections(_source_pages(spark, sf_dir)).withColumn("date", F.col("date").cast("string"))


@query("s11_combined_position", "SELECT CAST(c_custkey AS VARCHAR) AS page, CAST(c_custkey * 37 % 360 AS DOUBLE) AS ra, CAST(c_nationkey * 5 - 30 AS DOUBLE) AS dec FROM customer")
def combined_position(spark, sf_dir):
    return tables.combined_positions(_source_pages(spark, sf_dir)).drop("position")


@query("a13_reference_grid", C + ", s AS (SELECT time_idx, pol_idx, count(DISTINCT l_idx) AS n_l, count(DISTINCT m_idx) AS n_m FROM cells WHERE flux IS NOT NULL AND time_idx < 5 GROUP BY ALL) SELECT max(struct_pack(a := n_l * n_m, l := n_l, m := n_m)).l AS n_l, max(struct_pack(a := n_l * n_m, l := n_l, m := n_m)).m AS n_m FROM s")
def reference_grid(spark, sf_dir):
    """The largest shape of the first five times: a limit that is the rule itself."""
    s = views.cells(spark, sf_dir).where("flux IS NOT NULL AND time_idx < 5").groupBy("time_idx", "pol_idx").agg(F.count_distinct("l_idx").alias("n_l"), F.count_distinct("m_idx").alias("n_m"))
    return s.agg(F.max(F.struct((F.col("n_l") * F.col("n_m")).alias("a"), "n_l", "n_m")).alias("g")).select("g.n_l", "g.n_m")


@query("a28_phase_centres", C + ", t AS (SELECT DISTINCT time_idx, mjd FROM cells), c AS (SELECT time_idx, ((18.697374558 + 24.06570982441908 * (mjd - 51544.5) + -118.2817 / 15) % 24 + 24) % 24 * 15 AS ra FROM t) SELECT round(min(ra), 6) AS least, round(max(ra), 6) AS most, round(arg_max(ra, time_idx) - arg_min(ra, time_idx), 6) AS moved, max(ra) - min(ra) > 0.01 AS drifts FROM c")
def phase_centres(spark, sf_dir):
    from ..functions.geometry import lst_hours

    t = views.axis(spark, sf_dir, "time_idx").withColumn("ra", lst_hours(F.col("mjd")) * 15)
    out = t.agg(F.min("ra").alias("least"), F.max("ra").alias("most"), (F.max_by("ra", "time_idx") - F.min_by("ra", "time_idx")).alias("moved"), (F.max("ra") - F.min("ra") > 0.01).alias("drifts"))
    return rounded(out, "least", "most", "moved")
