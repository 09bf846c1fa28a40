"""File inventories over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names as NM
from ..operators import inventory as I
from ..sources import views
from ..sources.views import FILES_SQL
from .registry import query, rounded

W = f"WITH {FILES_SQL} "
BIN = "CAST(round_even(freq_hz / 23000.0, 0) AS BIGINT)"
KEPT = f", kept AS (SELECT * FROM files QUALIFY row_number() OVER (PARTITION BY time_key, {BIN}, stokes ORDER BY path) = 1)"


def _files(spark, sf_dir):
    return I.described(views.files(spark, sf_dir))


@query("f1_name_fields", W + f"SELECT event_id, time_key, CAST(mhz AS DOUBLE) AS mhz, CAST(stokes AS INT) AS stokes, {BIN} AS freq_bin FROM files")
def name_fields(spark, sf_dir):
    return _files(spark, sf_dir).select("event_id", "time_key", "mhz", "stokes", "freq_bin")


@query("f6_mjd", "SELECT event_id, round(epoch_us(ts) / 86400000000.0 + 40587, 8) AS mjd, strftime(ts, '%m-%d') AS label FROM events")
def mjd(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return rounded(e.select("event_id", NM.mjd(F.col("ts")).alias("mjd"), F.date_format("ts", "MM-dd").alias("label")), "mjd", digits=8)


@query("f7_invalid_beams", W + "SELECT CASE WHEN beam IS NULL THEN 'BMAJ missing' WHEN beam = '0' OR beam = 'ok' AND b <= 0 THEN 'BMAJ not positive' WHEN beam = 'bad' THEN 'BMAJ not a number' END AS reason, count(*) AS n FROM files JOIN (SELECT event_id, round(value / 1000, 5) AS b FROM events) USING (event_id) WHERE beam IS NULL OR beam <> 'ok' OR b <= 0 GROUP BY ALL")
def invalid_beams(spark, sf_dir):
    rows = _files(spark, sf_dir)
    return rows.where(F.col("beam_reason").isNotNull()).groupBy(F.col("beam_reason").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("f8_truncated_files", W + "SELECT CASE WHEN size_bytes = 0 THEN 'empty' ELSE 'truncated' END AS reason, count(*) AS n FROM files WHERE size_bytes < 65536 GROUP BY ALL")
def truncated_files(spark, sf_dir):
    reason = NM.truncated_reason(F.col("size_bytes"), F.lit(128), F.lit(128), F.lit(-32))
    return views.files(spark, sf_dir).select(reason.alias("reason")).where("reason IS NOT NULL").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("w10_deduplicated", W + KEPT + " SELECT event_id, path FROM kept")
def deduplicated(spark, sf_dir):
    return I.deduplicated(_files(spark, sf_dir)).select("event_id", "path")


MERGE = """, keys AS (SELECT DISTINCT time_key, epoch_us(strptime(time_key, '%Y%m%d_%H%M%S')) / 86400000000.0 + 40587 AS mjd FROM files),
flag AS (SELECT *, CASE WHEN (mjd - lag(mjd) OVER (ORDER BY mjd)) * 86400 <= 3600 + 1e-6 THEN 0 ELSE 1 END AS new FROM keys),
grp AS (SELECT *, sum(new) OVER (ORDER BY mjd) AS g FROM flag), groups AS (SELECT time_key, first_value(time_key) OVER (PARTITION BY g ORDER BY mjd) AS group_key FROM grp)"""


@query("w9_merged_keys", W + MERGE + " SELECT time_key, group_key FROM groups")
def merged_keys(spark, sf_dir):
    return I.merged_keys(_files(spark, sf_dir).select("time_key", "mjd"), 3600)


@query("w11_merged_files", W + KEPT + MERGE + " SELECT group_key, mhz + 0.0 AS mhz, stokes, min(struct_pack(k := time_key, p := path)).p AS path FROM kept JOIN groups USING (time_key) GROUP BY ALL")
def merged_files(spark, sf_dir):
    rows = I.deduplicated(_files(spark, sf_dir))
    rows = rows.join(I.merged_keys(rows.select("time_key", "mjd"), 3600), "time_key")
    return I.first_of(rows, ["group_key", "mhz", "stokes"], ["time_key", "path"]).select("group_key", "mhz", "stokes", "path")


STORED = ", stored AS (SELECT DISTINCT epoch_us(strptime(time_key, '%Y%m%d_%H%M%S')) / 86400000000.0 + 40587 AS mjd FROM files WHERE substr(time_key, 10, 2) IN ('04', '07', '11'))"


def _stored(rows):
    return rows.where(F.substring("time_key", 10, 2).isin("04", "07", "11")).select((F.col("mjd") + 5e-10).alias("mjd")).distinct()


@query("j6_resume_filter", W + " SELECT event_id, time_key FROM files WHERE substr(time_key, 10, 2) NOT IN ('04', '07', '11')")
def resume_filter(spark, sf_dir):
    rows = _files(spark, sf_dir)
    return I.not_stored(rows, _stored(rows)).select("event_id", "time_key")


@query("e10_ingest_plan", W + KEPT + MERGE + """, picked AS (SELECT k.*, group_key FROM kept k JOIN groups USING (time_key) QUALIFY row_number() OVER (PARTITION BY group_key, mhz, stokes ORDER BY time_key, path) = 1)
SELECT group_key, path FROM picked JOIN (SELECT event_id, round(value / 1000, 5) AS b FROM events) USING (event_id) WHERE beam = 'ok' AND b > 0 AND size_bytes > 0 AND substr(time_key, 10, 2) NOT IN ('04', '07', '11')""")
def ingest_plan(spark, sf_dir):
    files = views.files(spark, sf_dir)
    return I.ingest_plan(files, _stored(I.described(files)), 3600).select("group_key", "path")


@query(
    "j7_beam_donor",
    W + """, b AS (SELECT event_id, mhz, epoch_us(ts) / 86400000000.0 + 40587 AS mjd, CASE WHEN beam = 'ok' THEN CAST(printf('%.5f', value / 1000) AS DOUBLE) WHEN beam = '0' THEN 0.0 END AS bmaj FROM (SELECT f.*, e.value FROM files f JOIN events e USING (event_id))),
d AS (SELECT x.event_id, y.bmaj AS donor_bmaj FROM b x JOIN b y ON x.mhz = y.mhz AND y.bmaj > 0 AND coalesce(x.bmaj, 0) <= 0
  QUALIFY row_number() OVER (PARTITION BY x.event_id ORDER BY abs(x.mjd - y.mjd), y.mjd) = 1) SELECT event_id, donor_bmaj FROM d""",
)
def beam_donor(spark, sf_dir):
    rows = _files(spark, sf_dir).select("event_id", "mhz", NM.mjd(F.col("ts")).alias("mjd"), F.col("header")["BMAJ"].try_cast("double").alias("bmaj"))
    return I.beam_donors(rows).where("coalesce(bmaj, 0) <= 0").select("event_id", "donor_bmaj")


@query("a11_discovery_summary", W + f"SELECT count(*) AS files, count(DISTINCT time_key) AS times, count(DISTINCT {BIN}) AS bins, count(DISTINCT stokes) AS stokes FROM files")
def discovery_summary(spark, sf_dir):
    return I.summary(_files(spark, sf_dir))


@query("a12_store_size", "SELECT count(*) * (max(struct_pack(a := (event_id % 7 + 1) * 64 * 128, l := (event_id % 7 + 1) * 64, m := 128)).a) * 4 AS bytes FROM events")
def store_size(spark, sf_dir):
    return I.store_size(views.files(spark, sf_dir), (F.col("event_id") % 7 + 1) * 64, F.lit(128))


@query("a14_header_audit", W + """, v AS (SELECT DISTINCT time_key, 'RESTFREQ' AS keyword, printf('%.1f', freq_hz + 0.0) AS value FROM files UNION SELECT DISTINCT time_key, 'BMIN', '0.01' FROM files)
SELECT time_key, keyword, count(*) AS n, array_to_string(list_sort(list(value))[1:8], ',') AS values, count(*) <= 1 AS consistent FROM v GROUP BY ALL""")
def header_audit(spark, sf_dir):
    return I.header_audit(_files(spark, sf_dir), ["RESTFREQ", "BMIN"]).withColumn("values", F.array_join("values", ","))


@query("a15_time_audit", W + """, t AS (SELECT time_key, epoch_us(header_time) / 86400000000.0 AS t, epoch_us(strptime(time_key, '%Y%m%d_%H%M%S')) / 86400000000.0 AS k FROM files)
SELECT time_key, count(*) AS files, round((max(t) - min(t)) * 86400, 2) + 0.0 AS spread_s, round(max(abs(t - k)) * 86400, 2) + 0.0 AS name_gap_s FROM t GROUP BY ALL""")
def time_audit(spark, sf_dir):
    return rounded(I.time_audit(_files(spark, sf_dir)), "spread_s", "name_gap_s", digits=2)


@query("f9_single_time_groups", W + "SELECT event_id FROM files WHERE time_key IN (SELECT time_key FROM files GROUP BY time_key HAVING count(DISTINCT header_time) = 1)")
def single_time_groups(spark, sf_dir):
    return I.single_time_groups(_files(spark, sf_dir)).select("event_id")


@query("j12_reference_groups", W + "SELECT event_id FROM files WHERE time_key IN (SELECT time_key FROM files WHERE mhz = 73)")
def reference_groups(spark, sf_dir):
    return I.with_reference(_files(spark, sf_dir), 73.0).select("event_id")


@query("j3_global_grid", W + f", p AS (SELECT time_key, {BIN} AS freq_bin, count(*) AS n FROM files WHERE stokes = 1 GROUP BY ALL) SELECT t.time_key, c.freq_bin, n FROM (SELECT DISTINCT time_key FROM p) t CROSS JOIN (SELECT DISTINCT freq_bin FROM p) c LEFT JOIN p ON p.time_key = t.time_key AND p.freq_bin = c.freq_bin")
def global_grid(spark, sf_dir):
    planes = _files(spark, sf_dir).where("stokes = 1").groupBy("time_key", "freq_bin").agg(F.count(F.lit(1)).alias("n"))
    return I.on_global_grid(planes, planes.select("freq_bin").distinct())


@query("j4_snap_channels", W + ", c AS (SELECT i AS freq_idx, unnest([41, 46, 50, 55]) * 1e6 + 500 AS expected_hz, unnest([0, 1, 2, 3]) AS i) SELECT time_key, CAST(stokes AS INT) AS stokes, i AS freq_idx, arg_min(path, struct_pack(d := abs(freq_hz - expected_hz), p := path)) AS path FROM files JOIN (SELECT unnest([0, 1, 2, 3]) AS i, unnest([41, 46, 50, 55]) * 1e6 + 500 AS expected_hz) ON abs(freq_hz - expected_hz) <= 500 GROUP BY ALL")
def snap_channels(spark, sf_dir):
    channels = spark.createDataFrame([(i, m * 1e6 + 500) for i, m in enumerate((41, 46, 50, 55))], "freq_idx int, expected_hz double")
    return I.snapped(_files(spark, sf_dir), channels, 1000.0)


@query("u3_not_completed", W + "SELECT DISTINCT time_key FROM files EXCEPT SELECT time_key FROM files WHERE mhz = 41")
def not_completed(spark, sf_dir):
    rows = _files(spark, sf_dir)
    return rows.select("time_key").distinct().join(rows.where("mhz = 41").select("time_key").distinct(), "time_key", "left_anti")


@query("f17_elapsed_days", "SELECT event_id, round((epoch_us(ts) / 1e6 - min(epoch_us(ts) / 1e6) OVER (PARTITION BY user_id)) / 86400, 6) AS days FROM events")
def elapsed_days(spark, sf_dir):
    from pyspark.sql import Window

    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("s", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    w = Window.partitionBy("user_id")
    return rounded(e.select("event_id", NM.elapsed_days(F.col("s"), F.min("s").over(w), F.max("s").over(w)).alias("days")), "days")
