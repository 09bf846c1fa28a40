"""Cube reductions, windows and spectra."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import spectra as S
from ..operators import halo as H
from ..operators import reduce as R
from ..operators import select as P
from ..operators import sketches as K
from ..operators import windows as W
from ..sources import views
from ..sources.views import BEAMS_SQL, CELLS_SQL
from .registry import query, rounded

C = f"WITH {CELLS_SQL} "
N = 8


@query("a3_finite_fraction", C + "SELECT time_idx, freq_idx, pol_idx, round(count(flux) / 64.0, 6) AS fraction FROM cells GROUP BY ALL")
def finite_fraction(spark, sf_dir):
    return rounded(R.finite_fraction(views.cells(spark, sf_dir), N, N), "fraction")


@query("a1_time_average", C + "SELECT freq_idx, pol_idx, l_idx, m_idx, round(avg(flux), 6) + 0.0 AS flux FROM cells GROUP BY ALL")
def time_average(spark, sf_dir):
    return rounded(R.time_average(views.cells(spark, sf_dir)), "flux")


@query("a2_frequency_average", C + "SELECT time_idx, pol_idx, l_idx, m_idx, round(avg(flux), 6) + 0.0 AS flux FROM cells WHERE freq_hz BETWEEN 40e6 AND 70e6 GROUP BY ALL")
def frequency_average(spark, sf_dir):
    return rounded(R.frequency_average(views.cells(spark, sf_dir), 40, 70), "flux")


@query("a4_peak_flux_map", C + "SELECT freq_idx, pol_idx, l_idx, m_idx, round(max(flux), 6) + 0.0 AS peak FROM cells GROUP BY ALL")
def peak_flux_map(spark, sf_dir):
    return rounded(R.peak_flux_map(views.cells(spark, sf_dir)), "peak")


@query("a6_zenith_std", C + "SELECT time_idx, freq_idx, pol_idx, round(stddev_pop(flux), 6) AS std FROM cells WHERE abs(l) <= 0.5 AND abs(m) <= 0.5 GROUP BY ALL")
def zenith_std(spark, sf_dir):
    return rounded(R.box_std(views.cells(spark, sf_dir), 0.5), "std")


@query(
    "a7_integrated_flux",
    C + """, w AS (SELECT *, lag(flux) OVER s AS f0, lag(freq_hz) OVER s AS n0 FROM cells WHERE freq_hz BETWEEN 36e6 AND 66e6 WINDOW s AS (PARTITION BY time_idx, pol_idx, l_idx, m_idx ORDER BY freq_hz))
SELECT time_idx, pol_idx, l_idx, m_idx, round(CASE WHEN count(flux) < count(*) THEN NULL ELSE sum((flux + f0) / 2 * (freq_hz - n0)) END, 2) + 0.0 AS integrated FROM w GROUP BY ALL""",
)
def integrated_flux(spark, sf_dir):
    keys = ["time_idx", "pol_idx", "l_idx", "m_idx"]
    return rounded(R.integrated_flux(views.cells(spark, sf_dir), keys, 36e6, 66e6), "integrated", digits=2)


@query(
    "a8_populated_mask",
    C + f", {BEAMS_SQL} SELECT time_idx, freq_idx, pol_idx, coalesce(bool_or(bmaj > 0), false) OR bool_or(flux IS NOT NULL) AS populated FROM cells LEFT JOIN beams USING (time_idx, freq_idx, pol_idx) GROUP BY ALL",
)
def populated(spark, sf_dir):
    return R.populated(views.cells(spark, sf_dir), views.beams(spark, sf_dir))


@query(
    "a9_variability",
    C + "SELECT freq_idx, pol_idx, l_idx, m_idx, round(CASE WHEN avg(flux) > 0.001 THEN stddev_pop(flux) / avg(flux) ELSE 0 END, 4) AS variability, count(flux) AS n FROM cells GROUP BY ALL HAVING abs(avg(flux)) > 0.001",
)
def variability(spark, sf_dir):
    keys = ["freq_idx", "pol_idx", "l_idx", "m_idx"]
    cells = views.cells(spark, sf_dir)
    # Means near 0 make the ratio unstable in the last digits; both sides leave them out.
    stable = cells.groupBy(*keys).agg(F.avg("flux").alias("a")).where("abs(a) > 0.001").drop("a")
    return rounded(R.variability(cells.join(stable, keys), keys), "variability", digits=4)


@query("a22_robust_limits", C + "SELECT time_idx, freq_idx, pol_idx, round(quantile_cont(flux, 0.02), 6) + 0.0 AS vmin, round(quantile_cont(flux, 0.98), 6) + 0.0 AS vmax FROM cells WHERE flux IS NOT NULL GROUP BY ALL")
def robust_limits(spark, sf_dir):
    return rounded(R.robust_limits(views.cells(spark, sf_dir)), "vmin", "vmax")


@query(
    "a23_tile_cuts",
    C + "SELECT time_idx, freq_idx, pol_idx, l_idx // 4 AS tile_l, m_idx // 4 AS tile_m, round(quantile_cont(flux, 0.02), 6) + 0.0 AS lo, round(quantile_cont(flux, 0.98), 6) + 0.0 AS hi FROM cells WHERE flux IS NOT NULL GROUP BY ALL",
)
def tile_cuts(spark, sf_dir):
    return rounded(R.tile_cuts(views.cells(spark, sf_dir), 4, N), "lo", "hi")


@query("a22_plane_sketches", C + "SELECT time_idx, freq_idx, pol_idx, count(flux) AS n, round(quantile_disc(flux, 0.02), 6) + 0.0 AS vmin, round(quantile_disc(flux, 0.98), 6) + 0.0 AS vmax FROM cells WHERE flux IS NOT NULL GROUP BY ALL")
def plane_sketches(spark, sf_dir):
    """Limits of planes from sketches of their tiles; a plane's values all fit a sketch, so they are exact."""
    return rounded(K.limits(K.tile_sketches(views.tiles(spark, sf_dir)), ["time_idx", "freq_idx", "pol_idx"]), "vmin", "vmax")


@query("a22_channel_sketches", C + "SELECT freq_idx, pol_idx, count(flux) AS n, true AS low_in_bound, true AS high_in_bound FROM cells WHERE flux IS NOT NULL GROUP BY ALL")
def channel_sketches(spark, sf_dir):
    """The same sketches merged for channels; the exact rank of each limit is held against the sketch's bound."""
    found = K.limits(K.tile_sketches(views.tiles(spark, sf_dir)), ["freq_idx", "pol_idx"])
    cells = views.cells(spark, sf_dir).where("flux IS NOT NULL").join(found, ["freq_idx", "pol_idx"])
    share = lambda c: F.avg((F.col("flux") <= F.col(c)).cast("double"))
    ranks = cells.groupBy("freq_idx", "pol_idx", "n").agg(share("vmin").alias("a"), share("vmax").alias("b"))
    near = lambda c, q: F.abs(F.col(c) - q) <= K.rank_bound()
    return ranks.select("freq_idx", "pol_idx", "n", near("a", 0.02).alias("low_in_bound"), near("b", 0.98).alias("high_in_bound"))


@query(
    "a24_quality_summary",
    C + """SELECT freq_idx, pol_idx, round(min(flux), 6) + 0.0 AS low, round(max(flux), 6) + 0.0 AS high, round(avg(flux), 6) + 0.0 AS mean, round(stddev_pop(flux), 6) AS std,
  CAST(sum(CASE WHEN flux IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_null, CAST(sum(CASE WHEN isinf(flux) THEN 1 ELSE 0 END) AS BIGINT) AS n_inf FROM cells GROUP BY ALL""",
)
def quality_summary(spark, sf_dir):
    return rounded(R.plane_summary(views.cells(spark, sf_dir)), "low", "high", "mean", "std")


@query("w12_first_valid_frame", C + ", f AS (SELECT time_idx, freq_idx, pol_idx, count(flux) / 64.0 AS fraction FROM cells GROUP BY ALL) SELECT pol_idx, min(struct_pack(t := time_idx, f := freq_idx)).t AS time_idx, min(struct_pack(t := time_idx, f := freq_idx)).f AS freq_idx FROM f WHERE fraction >= 0.99 GROUP BY pol_idx")
def first_valid_frame(spark, sf_dir):
    return R.first_valid(R.finite_fraction(views.cells(spark, sf_dir), N, N), 0.99)


@query("p1_nearest_channel", C + ", a AS (SELECT DISTINCT freq_idx, freq_hz FROM cells), t AS (SELECT unnest([20, 33, 45.5, 57, 99]) * 1e6 AS target) SELECT CAST(target AS DOUBLE) AS target, arg_min(freq_idx, struct_pack(d := abs(freq_hz - target), i := freq_idx)) AS freq_idx FROM a, t GROUP BY target")
def nearest_channel(spark, sf_dir):
    cells = views.cells(spark, sf_dir)
    targets = spark.createDataFrame([(x * 1e6,) for x in (20.0, 33.0, 45.5, 57.0, 99.0)], "target double")
    return P.nearest(views.axis(spark, sf_dir, "freq_idx"), "freq_idx", "freq_hz", targets, "target")


@query("p2_nearest_time", C + ", a AS (SELECT DISTINCT time_idx, mjd FROM cells), t AS (SELECT unnest([59999, 60000.012, 60000.114, 60001]) AS target) SELECT CAST(target AS DOUBLE) AS target, arg_min(time_idx, struct_pack(d := abs(mjd - target), i := time_idx)) AS time_idx FROM a, t GROUP BY target")
def nearest_time(spark, sf_dir):
    cells = views.cells(spark, sf_dir)
    targets = spark.createDataFrame([(x,) for x in (59999.0, 60000.012, 60000.114, 60001.0)], "target double")
    return P.nearest(views.axis(spark, sf_dir, "time_idx"), "time_idx", "mjd", targets, "target")


@query("p3_nearest_pixel", C + ", a AS (SELECT DISTINCT l_idx, l FROM cells), t AS (SELECT unnest([-2, -0.3, 0.05, 0.6]) AS target) SELECT CAST(target AS DOUBLE) AS target, arg_min(l_idx, struct_pack(d := abs(l - target), i := l_idx)) AS l_idx FROM a, t GROUP BY target")
def nearest_pixel(spark, sf_dir):
    cells = views.cells(spark, sf_dir)
    targets = spark.createDataFrame([(x,) for x in (-2.0, -0.3, 0.05, 0.6)], "target double")
    return P.nearest(P.axis(cells, "l_idx", "l"), "l_idx", "l", targets, "target")


@query("p5_cutout", C + "SELECT time_idx, freq_idx, pol_idx, l_idx, m_idx, round(flux, 6) + 0.0 AS flux FROM cells WHERE l BETWEEN -0.45 AND 0.45 AND m BETWEEN -0.75 AND -0.05")
def cutout(spark, sf_dir):
    return rounded(P.box(views.cells(spark, sf_dir), 0.0, -0.4, 0.45, 0.35), "flux").select("time_idx", "freq_idx", "pol_idx", "l_idx", "m_idx", "flux")


@query("p7_circular_mask", C + "SELECT time_idx, freq_idx, pol_idx, l_idx, m_idx, CASE WHEN (l_idx - 4) ** 2 + (m_idx - 4) ** 2 <= 9 THEN round(flux, 6) + 0.0 END AS flux FROM cells")
def circular_mask(spark, sf_dir):
    return rounded(P.circle(views.cells(spark, sf_dir), N, N, 3.0), "flux").select("time_idx", "freq_idx", "pol_idx", "l_idx", "m_idx", "flux")


@query("p9_strided_preview", C + "SELECT time_idx, freq_idx, pol_idx, l_idx, m_idx, round(flux, 6) + 0.0 AS flux FROM cells WHERE l_idx % 3 = 0 AND m_idx % 3 = 0")
def strided_preview(spark, sf_dir):
    return rounded(P.strided(views.cells(spark, sf_dir), N, 3), "flux").select("time_idx", "freq_idx", "pol_idx", "l_idx", "m_idx", "flux")


@query("p10_stokes_select", C + "SELECT stokes, time_idx, count(flux) AS n FROM cells WHERE stokes = 4 GROUP BY ALL")
def stokes_select(spark, sf_dir):
    return views.cells(spark, sf_dir).where("stokes = 4").groupBy("stokes", "time_idx").agg(F.count("flux").alias("n"))


@query("w1_time_difference", C + "SELECT time_idx, freq_idx, pol_idx, l_idx, m_idx, round(flux - lag(flux) OVER (PARTITION BY freq_idx, pol_idx, l_idx, m_idx ORDER BY time_idx), 6) + 0.0 AS diff FROM cells")
def time_difference(spark, sf_dir):
    return rounded(W.difference(views.cells(spark, sf_dir), "time_idx"), "diff")


@query("j11_channel_difference", C + "SELECT time_idx, freq_idx, pol_idx, l_idx, m_idx, round(flux - lag(flux) OVER (PARTITION BY time_idx, pol_idx, l_idx, m_idx ORDER BY freq_idx), 6) + 0.0 AS diff FROM cells")
def channel_difference(spark, sf_dir):
    return rounded(W.difference(views.cells(spark, sf_dir), "freq_idx"), "diff")


@query("j13_reference_difference", C + ", r AS (SELECT freq_idx, pol_idx, l_idx, m_idx, avg(flux) AS mean FROM cells GROUP BY ALL) SELECT time_idx, freq_idx, pol_idx, l_idx, m_idx, round(flux - mean, 6) + 0.0 AS diff FROM cells JOIN r USING (freq_idx, pol_idx, l_idx, m_idx)")
def reference_difference(spark, sf_dir):
    return rounded(W.reference_difference(views.cells(spark, sf_dir)), "diff")


RMS = """, box AS (
  SELECT a.time_idx, a.freq_idx, a.pol_idx, a.l_idx, a.m_idx, a.flux, sum(b.flux) AS s, sum(b.flux * b.flux) AS q, count(b.flux) AS n, max(CASE WHEN abs(b.l_idx - a.l_idx) <= 1 AND abs(b.m_idx - a.m_idx) <= 1 THEN b.flux END) AS top
  FROM cells a JOIN cells b ON a.time_idx = b.time_idx AND a.freq_idx = b.freq_idx AND a.pol_idx = b.pol_idx AND b.l_idx BETWEEN a.l_idx - 2 AND a.l_idx + 1 AND b.m_idx BETWEEN a.m_idx - 2 AND a.m_idx + 1
  GROUP BY ALL)"""


def _noise(spark, sf_dir, box):
    """(plane, pixel, flux, rms, snr), by tiles with borders."""
    found = H.noise_tiles(views.tiles(spark, sf_dir, 3), 3, box)
    rows = found.select(*H.PLANE, "l0", "m0", "n_m", F.posexplode(F.arrays_zip("data", "rms", "snr")).alias("k", "x"))
    real = lambda c: F.when(~F.isnan(c), c)
    return rows.select(*H.PLANE, (F.col("l0") + F.expr("k div n_m")).alias("l_idx"), (F.col("m0") + F.col("k") % F.col("n_m")).alias("m_idx"), real(F.col("x.data").cast("double")).alias("flux"), real(F.col("x.rms")).alias("rms"), real(F.col("x.snr")).alias("snr"))


@query("w2_rms_map", C + RMS + " SELECT time_idx, freq_idx, pol_idx, l_idx, m_idx, round(CASE WHEN flux IS NOT NULL THEN sqrt(greatest(q / n - (s / n) * (s / n), 0)) END, 6) AS rms FROM box")
def rms_map(spark, sf_dir):
    return rounded(_noise(spark, sf_dir, 4), "rms").drop("flux", "snr")


@query("w3_snr_map", C + RMS + " SELECT time_idx, freq_idx, pol_idx, l_idx, m_idx, round(flux / sqrt(q / n - (s / n) * (s / n)), 4) + 0.0 AS snr FROM box")
def snr_map(spark, sf_dir):
    return rounded(_noise(spark, sf_dir, 4), "snr", digits=4).drop("flux", "rms")


PEAK = """, box AS (
  SELECT a.time_idx, a.freq_idx, a.pol_idx, a.l_idx, a.m_idx, a.flux,
         sum(CASE WHEN b.l_idx BETWEEN a.l_idx - 3 AND a.l_idx + 2 AND b.m_idx BETWEEN a.m_idx - 3 AND a.m_idx + 2 THEN b.flux END) AS s,
         sum(CASE WHEN b.l_idx BETWEEN a.l_idx - 3 AND a.l_idx + 2 AND b.m_idx BETWEEN a.m_idx - 3 AND a.m_idx + 2 THEN b.flux * b.flux END) AS q,
         count(CASE WHEN b.l_idx BETWEEN a.l_idx - 3 AND a.l_idx + 2 AND b.m_idx BETWEEN a.m_idx - 3 AND a.m_idx + 2 THEN b.flux END) AS n,
         max(CASE WHEN abs(b.l_idx - a.l_idx) <= 2 AND abs(b.m_idx - a.m_idx) <= 2 THEN b.flux END) AS top
  FROM cells a JOIN cells b ON a.time_idx = b.time_idx AND a.freq_idx = b.freq_idx AND a.pol_idx = b.pol_idx AND b.l_idx BETWEEN a.l_idx - 3 AND a.l_idx + 2 AND b.m_idx BETWEEN a.m_idx - 3 AND a.m_idx + 2
  GROUP BY ALL)"""


@query("w4_find_peaks", C + PEAK + " SELECT time_idx, freq_idx, pol_idx, l_idx, m_idx, round(flux, 6) AS flux, round(flux / sqrt(q / n - (s / n) * (s / n)), 4) AS snr FROM box WHERE flux = top AND flux / sqrt(q / n - (s / n) * (s / n)) >= 2")
def find_peaks(spark, sf_dir):
    return rounded(rounded(H.peak_rows(views.tiles(spark, sf_dir, 3), 3, 2.0, 6, 2).drop("rms"), "flux"), "snr", digits=4)


@query(
    "w4_located_peaks",
    C + PEAK + """, peak AS (SELECT *, flux / sqrt(q / n - (s / n) * (s / n)) AS snr FROM box WHERE flux = top AND flux / sqrt(q / n - (s / n) * (s / n)) >= 2),
t AS (SELECT DISTINCT time_idx, ((18.697374558 + 24.06570982441908 * (mjd - 51544.5) + -118.2817 / 15) % 24 + 24) % 24 * 15 AS ra0 FROM cells),
c AS (SELECT *, 2 * l_idx / 7 - 1 AS l, 2 * m_idx / 7 - 1 AS m FROM peak JOIN t USING (time_idx)), d AS (SELECT *, CASE WHEN l * l + m * m <= 1 THEN sqrt(1 - l * l - m * m) END AS z FROM c)
SELECT time_idx, freq_idx, pol_idx, l_idx, m_idx, round(snr, 4) AS snr, CAST(row_number() OVER (PARTITION BY time_idx, freq_idx, pol_idx ORDER BY snr DESC, l_idx, m_idx) AS INTEGER) AS place,
       round(((ra0 + degrees(atan2(l, z * cos(radians(37.2339)) - m * sin(radians(37.2339))))) % 360 + 360) % 360, 5) AS ra_deg, round(degrees(asin(z * sin(radians(37.2339)) + m * cos(radians(37.2339)))), 5) + 0.0 AS dec_deg FROM d""",
)
def located_peaks(spark, sf_dir):
    """Peaks with right ascension and declination, in order of SNR within their plane."""
    peaks = H.peak_rows(views.tiles(spark, sf_dir, 3), 3, 2.0, 6, 2)
    found = W.located(peaks, views.axis(spark, sf_dir, "time_idx"), 2 * F.col("l_idx") / 7 - 1, 2 * F.col("m_idx") / 7 - 1)
    return rounded(rounded(found.drop("flux", "rms"), "ra_deg", "dec_deg", digits=5), "snr", digits=4)


@query("w15_axis_spacing", C + ", a AS (SELECT DISTINCT freq_idx, freq_hz FROM cells), d AS (SELECT freq_hz - lag(freq_hz) OVER (ORDER BY freq_idx) AS step FROM a) SELECT min(step) AS least, max(step) AS most, count(step) AS n, max(step) - min(step) <= 1e-6 * max(step) AS regular FROM d")
def axis_spacing(spark, sf_dir):
    return W.axis_spacing(views.axis(spark, sf_dir, "freq_idx"), "freq_idx", "freq_hz")


INDEX = ", s AS (SELECT time_idx, pol_idx, l_idx, m_idx, max(CASE WHEN freq_idx = 2 THEN flux END) AS s1, max(CASE WHEN freq_idx = 7 THEN flux END) AS s2 FROM cells GROUP BY ALL), i AS (SELECT *, CASE WHEN s1 > 0 AND s2 > 0 THEN ln(s2 / s1) / ln(72e6 / 42e6) END AS alpha FROM s)"


def _index(spark, sf_dir):
    flux = lambda k: F.max(F.when(F.col("freq_idx") == k, F.col("flux")))
    both = views.cells(spark, sf_dir).groupBy("time_idx", "pol_idx", "l_idx", "m_idx").agg(flux(2).alias("s1"), flux(7).alias("s2"))
    return both.withColumn("alpha", S.spectral_index(F.col("s1"), F.col("s2"), F.lit(42e6), F.lit(72e6)))


@query("f11_spectral_index_map", C + INDEX + " SELECT time_idx, pol_idx, l_idx, m_idx, round(alpha, 6) + 0.0 AS alpha FROM i")
def spectral_index_map(spark, sf_dir):
    return rounded(_index(spark, sf_dir).drop("s1", "s2"), "alpha")


@query("f12_spectral_class", C + INDEX + " SELECT CASE WHEN alpha < -1 THEN 'steep' WHEN alpha < -0.3 THEN 'normal' WHEN alpha <= 0.3 THEN 'flat' WHEN alpha > 0.3 THEN 'inverted' END AS class, count(*) AS n FROM i GROUP BY ALL")
def spectral_class(spark, sf_dir):
    return _index(spark, sf_dir).groupBy(S.spectral_class(F.col("alpha")).alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query("h5_power_law", C + ", p AS (SELECT time_idx, pol_idx, l_idx, m_idx, ln(flux) AS y, ln(freq_hz / 60e6) AS x FROM cells WHERE flux > 0) SELECT time_idx, pol_idx, l_idx, m_idx, round(regr_slope(y, x), 4) + 0.0 AS alpha, round(exp(regr_intercept(y, x)), 4) + 0.0 AS amplitude FROM p GROUP BY ALL HAVING count(*) >= 3")
def power_law(spark, sf_dir):
    rows = views.cells(spark, sf_dir).where("flux > 0").withColumns({"y": F.ln("flux"), "x": F.ln(F.col("freq_hz") / 60e6)})
    fit = rows.groupBy("time_idx", "pol_idx", "l_idx", "m_idx").agg(F.regr_slope("y", "x").alias("alpha"), F.exp(F.regr_intercept("y", "x")).alias("amplitude"), F.count(F.lit(1)).alias("n")).where("n >= 3").drop("n")
    return rounded(fit, "alpha", "amplitude", digits=4)


@query("a10_confirmed_bands", C + RMS + ", s AS (SELECT time_idx, freq_idx, pol_idx, l_idx, m_idx, flux / sqrt(q / n - (s / n) * (s / n)) AS snr FROM box) SELECT time_idx, pol_idx, l_idx, m_idx, round(avg(CASE WHEN snr > 1 THEN 1 WHEN snr IS NOT NULL THEN 0 END), 6) AS share FROM s GROUP BY ALL HAVING avg(CASE WHEN snr > 1 THEN 1 WHEN snr IS NOT NULL THEN 0 END) >= 0.3")
def confirmed_bands(spark, sf_dir):
    return rounded(R.confirmed_bands(_noise(spark, sf_dir, 4), ["time_idx", "pol_idx", "l_idx", "m_idx"], 1.0, 0.3), "share")


KERNEL = "k AS (SELECT d, exp(-0.5 * (d / 1.0) ** 2) AS w FROM unnest(range(-4, 5)) AS t(d))"


@query("h4_matched_filter", C + f", {KERNEL} " + """SELECT a.time_idx, a.freq_idx, a.pol_idx, a.l_idx, a.m_idx, round(sum(b.flux * kl.w * km.w) / sum(CASE WHEN b.flux IS NOT NULL THEN kl.w * km.w END), 6) + 0.0 AS flux
FROM cells a JOIN cells b ON a.time_idx = b.time_idx AND a.freq_idx = b.freq_idx AND a.pol_idx = b.pol_idx AND abs(a.l_idx - b.l_idx) <= 4 AND abs(a.m_idx - b.m_idx) <= 4 JOIN k kl ON kl.d = a.l_idx - b.l_idx JOIN k km ON km.d = a.m_idx - b.m_idx GROUP BY ALL""")
def matched_filter(spark, sf_dir):
    return rounded(W.smooth(views.cells(spark, sf_dir), 1.0), "flux")


@query("t3_brightest", C + "SELECT freq_idx, pol_idx, l_idx, m_idx, round(max(flux), 6) AS peak FROM cells GROUP BY ALL ORDER BY peak DESC, freq_idx, pol_idx, l_idx, m_idx LIMIT 10")
def brightest(spark, sf_dir):
    """A top-k report: the limit is the feature."""
    return rounded(R.peak_flux_map(views.cells(spark, sf_dir)), "peak").orderBy(F.desc("peak"), "freq_idx", "pol_idx", "l_idx", "m_idx").limit(10)


@query("u1_channel_union", C + "SELECT DISTINCT freq_hz FROM cells")
def channel_union(spark, sf_dir):
    return views.cells(spark, sf_dir).select("freq_hz").distinct()
