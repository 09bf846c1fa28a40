"""Nightly quality and candidates over orders, lineitem and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names as NM
from ..operators import inventory as I
from ..operators import quality as Q
from ..operators import reduce as R
from ..sources import tables, views
from ..sources.scratch import new_path
from ..sources.views import CURVES_SQL, FILES_SQL, FLUX_SQL, RUNS_SQL
from .registry import query, rounded

NEWEST = f"WITH {RUNS_SQL}, cov AS (SELECT lst_hour, obs_date, max(run) AS latest_run, count(DISTINCT run) AS n_runs, max(struct_pack(r := run, n := n_subbands)).n AS n_subbands FROM runs WHERE qualified GROUP BY ALL) "


def _coverage(spark, sf_dir):
    return Q.newest_runs(views.runs(spark, sf_dir))


@query("w8_newest_runs", NEWEST + "SELECT * FROM cov")
def newest_runs(spark, sf_dir):
    return _coverage(spark, sf_dir)


TREE = "lpad(cast(lst_hour as string), 2, '0') || 'h/' || obs_date || '/' || run"


@query("e12_run_tree", f"WITH {RUNS_SQL} SELECT lpad(CAST(lst_hour AS VARCHAR), 2, '0') || 'h' AS lst_hour, obs_date, max(run) AS latest_run, count(DISTINCT run) AS n_runs FROM runs GROUP BY ALL")
def run_tree(spark, sf_dir):
    """The scan of a run tree from its paths alone."""
    paths = views.runs(spark, sf_dir).select(F.expr(f"'/pipe/' || {TREE} || '/55MHz/image.fits'").alias("path"))
    return Q.run_tree(paths).groupBy("lst_hour", "obs_date").agg(F.max("run").alias("latest_run"), F.count_distinct("run").alias("n_runs"))


@query(
    "a16_day_coverage",
    NEWEST + "SELECT obs_date, count(DISTINCT lst_hour) AS hours, array_to_string(list_sort(list(DISTINCT lst_hour)), ',') AS hour_list, min(n_subbands) AS least, max(n_subbands) AS most, median(n_subbands) AS median, CAST(sum(CASE WHEN n_runs > 1 THEN 1 ELSE 0 END) AS BIGINT) AS repeated FROM cov GROUP BY obs_date",
)
def day_coverage(spark, sf_dir):
    return Q.day_coverage(_coverage(spark, sf_dir))


@query("a17_hour_coverage", NEWEST + "SELECT lst_hour, count(DISTINCT obs_date) AS days, min(obs_date) AS first, max(obs_date) AS last, median(n_subbands) AS median FROM cov GROUP BY lst_hour")
def hour_coverage(spark, sf_dir):
    return Q.hour_coverage(_coverage(spark, sf_dir))


@query("a18_subband_coverage", NEWEST + ", e AS (SELECT *, (unnest(range(0, n_subbands)) * 5 + 18) || 'MHz' AS subband FROM cov) SELECT subband, count(*) AS pairs, count(DISTINCT obs_date) AS days, count(DISTINCT lst_hour) AS hours FROM e GROUP BY subband")
def subband_coverage(spark, sf_dir):
    listed = F.array_join(F.transform(F.sequence(F.lit(0), F.col("n_subbands").cast("int") - 1), lambda k: F.concat((k * 5 + 18).cast("string"), F.lit("MHz"))), ",")
    return Q.subband_coverage(_coverage(spark, sf_dir).withColumn("subbands", listed))


@query("a19_coverage_matrix", NEWEST + "SELECT obs_date, " + ", ".join(f"max(CASE WHEN lst_hour = {h} THEN n_subbands END) AS h{h:02d}" for h in range(24)) + " FROM cov GROUP BY obs_date")
def coverage_matrix(spark, sf_dir):
    return Q.coverage_matrix(_coverage(spark, sf_dir))


@query("u4_quality_days", f"WITH {RUNS_SQL} SELECT DISTINCT obs_date FROM runs WHERE qualified")
def quality_days(spark, sf_dir):
    return views.runs(spark, sf_dir).where("qualified").select("obs_date").distinct()


@query("a20_flux_ratio", f"WITH {FLUX_SQL} SELECT source, hour, freq, round(avg(CASE WHEN model_flux <> 0 THEN imfit_flux / model_flux END), 6) AS ratio FROM flux GROUP BY ALL")
def flux_ratio(spark, sf_dir):
    return rounded(Q.flux_ratio(views.flux_checks(spark, sf_dir)), "ratio")


@query("a21_shift_grid", f"WITH {FLUX_SQL} SELECT hour, freq, round(avg(shift), 6) AS shift FROM flux GROUP BY ALL")
def shift_grid(spark, sf_dir):
    return rounded(Q.shift_grid(views.flux_checks(spark, sf_dir)), "shift")


@query("s8_flux_csv", f"WITH {FLUX_SQL} SELECT source, hour, CAST(freq AS DOUBLE) AS freq, round(avg(CASE WHEN model_flux <> 0 THEN imfit_flux / model_flux END), 6) AS ratio FROM flux GROUP BY ALL")
def flux_csv(spark, sf_dir):
    """Flux checks written as CSV files of runs, read back beside their runs' coverage."""
    rows = views.flux_checks(spark, sf_dir).withColumn("run", F.concat(F.lit("Run_20240101_"), F.lpad(F.col("hour").cast("string"), 6, "0")))
    path = new_path(spark, "runs")
    rows.select("run", "imfit_flux", F.lit(0.1).alias("imfit_err"), F.lit(50.0).alias("elevation"), "model_flux", "source", F.col("freq").cast("double").alias("freq")).write.partitionBy("run").option("header", "true").csv(path)
    return rounded(Q.flux_ratio(tables.flux_checks(spark, path, rows.select("run", "hour").distinct())), "ratio")


@query("s9_shift_csv", f"WITH {FLUX_SQL} SELECT freq * 1.5 AS freq_mhz, round(avg(CASE WHEN hour <> 3 THEN shift END), 6) AS shift, count(*) AS n FROM flux GROUP BY ALL")
def shift_csv(spark, sf_dir):
    """Position shifts written as CSV, some of them text that is no number, read back."""
    path = new_path(spark, "shifts")
    rows = views.flux_checks(spark, sf_dir)
    rows.select((F.col("freq") * 1.5).alias("freq_mhz"), F.when(F.col("hour") == 3, "flagged").otherwise(F.col("shift").cast("string")).alias("median_shift_arcmin")).write.option("header", "true").csv(path)
    found = tables.dewarp_shifts(spark, path).groupBy("freq_mhz").agg(F.avg("median_shift_arcmin").alias("shift"), F.count(F.lit(1)).alias("n"))
    return rounded(found, "shift")


@query("f16_subband_labels", f"WITH {FLUX_SQL} SELECT DISTINCT freq, printf('%.0fMHz', freq * 5 + 18.0) AS label FROM flux")
def subband_labels(spark, sf_dir):
    return views.flux_checks(spark, sf_dir).select("freq", F.format_string("%.0fMHz", F.col("freq") * 5 + 18.0).alias("label")).distinct()


@query("a30_stokes_days", f"WITH {FILES_SQL} SELECT substr(time_key, 1, 8) AS day, bool_or(stokes = 1) AS has_i, bool_or(stokes = 4) AS has_v FROM files GROUP BY ALL")
def stokes_days(spark, sf_dir):
    return Q.stokes_days(I.described(views.files(spark, sf_dir)))


@query("t5_default_day", f"WITH {FILES_SQL}, d AS (SELECT substr(time_key, 1, 8) AS day, bool_or(mhz = 73 AND stokes = 4 AND size_bytes > 80000) AS has_store FROM files GROUP BY ALL) SELECT min(struct_pack(t := CASE WHEN has_store THEN 0 ELSE 1 END, d := day)).d AS day FROM d")
def default_day(spark, sf_dir):
    rows = I.described(views.files(spark, sf_dir))
    days = rows.groupBy(F.substring("time_key", 1, 8).alias("day")).agg(F.bool_or((F.col("mhz") == 73) & (F.col("stokes") == 4) & (F.col("size_bytes") > 80000)).alias("has_store"))
    return Q.default_day(days)


@query("p13_candidate_filter", "SELECT event_id, event_type AS source, value AS snr FROM events WHERE contains(lower(event_type), 'i') AND value BETWEEN 10 AND 50 AND strftime(ts, '%Y-%m-%d') BETWEEN '2024-01-05' AND '2024-01-20'")
def candidate_filter(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("event_type").alias("source"), F.col("value").alias("snr"), F.date_format("ts", "yyyy-MM-dd HH:mm").alias("date"))
    return Q.filter_candidates(e, {"source": "I"}, {"snr": (10, 50)}, ("2024-01-05", "2024-01-20")).drop("date")


DET = f"WITH {CURVES_SQL}, det AS (SELECT event_id AS detection_id, source_id, strftime(ts, '%Y-%m-%d') AS day, hour(ts) AS hour, CASE WHEN band <> 73 THEN band END AS band, flux AS snr FROM curves)"


def _detections(spark, sf_dir):
    c = views.light_curves(spark, sf_dir)
    return c.select(F.col("event_id").alias("detection_id"), "source_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.hour("ts").cast("long").alias("hour"), F.when(F.col("band") != 73, F.col("band")).alias("band"), F.col("flux").alias("snr"))


@query(
    "w14_peak_detection",
    DET + """, best AS (SELECT * FROM det QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY snr DESC, detection_id) = 1),
same AS (SELECT source_id, day, hour, arg_max(band, struct_pack(s := snr, d := -detection_id)) AS other FROM det WHERE band IS NOT NULL GROUP BY ALL)
SELECT source_id, day, hour, detection_id, band, snr, coalesce(band, other) AS overlay FROM best LEFT JOIN same USING (source_id, day, hour)""",
)
def peak_detection(spark, sf_dir):
    return Q.peak_detections(_detections(spark, sf_dir))


@query(
    "j10_detection_slices",
    """WITH t AS (SELECT time_idx, TIMESTAMP '2024-01-01 00:00:00' + time_idx * INTERVAL 7 HOUR AS ts, (time_idx * 7.02) % 24 AS t_lst FROM range(60) r(time_idx)), c AS (SELECT freq_idx, 18.0 + 9 * freq_idx AS c_mhz FROM range(7) r(freq_idx)),
d AS (SELECT event_id AS detection_id, CAST(ts AS DATE) AS day, CAST(hour(ts) AS DOUBLE) + 0.25 AS lst, CAST(CASE event_type WHEN 'view' THEN 41 WHEN 'signup' THEN 46 WHEN 'click' THEN 50 WHEN 'error' THEN 55 END AS DOUBLE) AS mhz FROM events),
x AS (SELECT *, abs(lst - t_lst) AS a0, CAST(t.ts AS DATE) = day AS same_day FROM d, t),
y AS (SELECT *, least(a0, 24 - a0) AS apart, CASE WHEN same_day AND round_even(lst, 0) % 24 = round_even(t_lst, 0) % 24 THEN 0 WHEN same_day THEN 1 ELSE 2 END AS tier FROM x),
z AS (SELECT detection_id, mhz, min(struct_pack(tier := tier, d := round(CASE WHEN tier < 2 THEN apart ELSE abs(epoch_us(ts) / 1e6 - epoch(CAST(day AS TIMESTAMP)) - 43200) END, 6), i := time_idx)) AS s FROM y GROUP BY ALL)
SELECT detection_id, s.i AS time_idx, s.tier AS tier, CASE WHEN mhz IS NULL THEN 3 ELSE (SELECT arg_min(freq_idx, struct_pack(d := abs(z.mhz - c_mhz), i := freq_idx)) FROM c) END AS freq_idx FROM z""",
)
def detection_slices(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    mhz = F.create_map(*[F.lit(x) for k, v in views.BANDS.items() if k != "purchase" for x in (k, float(v))])[F.col("event_type")]
    d = e.select(F.col("event_id").alias("detection_id"), F.to_date("ts").alias("day"), (F.hour("ts") + 0.25).alias("lst"), mhz.alias("mhz"))
    times = spark.range(60).select(F.col("id").alias("time_idx"), F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast(id * 7 as int))").alias("ts"), ((F.col("id") * 7.02) % 24).alias("lst"))
    channels = spark.range(7).select(F.col("id").alias("freq_idx"), (18.0 + 9 * F.col("id")).alias("mhz"))
    return Q.to_slices(d, times, channels)


@query("j8_beam_of_stokes_i", f"""WITH {FILES_SQL}, b AS (SELECT f.*, CASE WHEN beam = 'ok' THEN CAST(printf('%.5f', value / 1000) AS DOUBLE) END AS bmaj FROM files f JOIN events USING (event_id)),
i AS (SELECT mhz, time_key, min(struct_pack(p := path, b := bmaj)).b AS bmaj FROM b WHERE stokes = 1 GROUP BY ALL) SELECT v.event_id, i.bmaj FROM b v JOIN i USING (mhz, time_key) WHERE v.stokes = 4""")
def beam_of_stokes_i(spark, sf_dir):
    rows = I.described(views.files(spark, sf_dir)).withColumn("x", F.col("header")["BMAJ"].try_cast("double")).withColumn("bmaj", F.when(F.col("header")["BMAJ"] != "0", F.col("x")))
    i = I.first_of(rows.where("stokes = 1"), ["mhz", "time_key"], ["path"]).select("mhz", "time_key", "bmaj")
    v = rows.where("stokes = 4").drop("bmaj")
    return Q.matching_stokes_i(v.join(i.select("mhz", "time_key"), ["mhz", "time_key"], "left_semi"), i).select("event_id", "bmaj")


@query("a29_epoch_folding", f"""WITH {CURVES_SQL}, p AS (SELECT source_id, flux, CAST(least(floor(((epoch_us(ts) / 1e6) - floor((epoch_us(ts) / 1e6) / 7000) * 7000) / 7000 * 12), 11) AS BIGINT) AS bin FROM curves),
f AS (SELECT source_id, bin, avg(flux) AS flux FROM p GROUP BY ALL) SELECT s.source_id, b.bin, round(coalesce(flux, 0), 6) AS flux FROM (SELECT DISTINCT source_id FROM curves) s CROSS JOIN (SELECT unnest(range(0, 12)) AS bin) b LEFT JOIN f ON f.source_id = s.source_id AND f.bin = b.bin""")
def epoch_folding(spark, sf_dir):
    # Folded in seconds since 1970: exact in double where MJD days are not.
    c = views.light_curves(spark, sf_dir).select("source_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 / 86400).alias("mjd"), "flux", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("s"))
    return rounded(R.fold(c, ["source_id"], 7000.0, 12), "flux")


@query("a9_source_variability", f"WITH {CURVES_SQL} SELECT source_id, round(CASE WHEN avg(flux) > 0 THEN stddev_pop(flux) / avg(flux) ELSE 0 END, 6) AS variability, count(flux) AS n FROM curves GROUP BY ALL")
def source_variability(spark, sf_dir):
    return rounded(R.variability(views.light_curves(spark, sf_dir), ["source_id"]), "variability")


@query("f14_band_text", "SELECT event_type, CAST(CASE event_type WHEN 'view' THEN 41 WHEN 'error' THEN 55 END AS DOUBLE) AS mhz, CASE event_type WHEN 'click' THEN 17 END AS hour, count(*) AS n FROM events GROUP BY event_type")
def band_text(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    text = F.when(F.col("event_type") == "view", "41MHz").when(F.col("event_type") == "error", "55 MHz").when(F.col("event_type") == "click", "17h").when(F.col("event_type") == "signup", "77h").otherwise("Full")
    return e.groupBy("event_type", NM.band_mhz(text).alias("mhz"), NM.lst_hour(text).alias("hour")).agg(F.count(F.lit(1)).alias("n"))


@query("f15_candidate_urls", "SELECT page_id, 'https://catalog.example/c/' || replace(url_encode(url), '%2A', '*') AS link FROM pages")
def candidate_urls(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", NM.candidate_url("https://catalog.example/c/", F.col("url")).alias("link"))


@query("p14_source_search", "SELECT c_custkey FROM customer WHERE regexp_matches('cust', '^[A-Za-z]') AND contains(lower(c_name), 'r#00')")
def source_search(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/customer.parquet").where(F.contains(F.lower("c_name"), F.lit("r#00"))).select("c_custkey")
