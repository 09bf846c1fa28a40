"""Cube, inventory and quality views over plain tables, for queries and tests.

``embeddings`` is read as a cube of 8 x 8 pixels, 10 channels and 2 polarisations: pixel i of a
vector is an element. ``events`` is read as a file inventory and as light curves, ``lineitem``
with ``part`` as flux checks, ``orders`` as nightly coverage. The SQL strings say the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.posexplode("embedding").alias("i", "x"))
    t, f, p = F.expr("vec_id div 20"), F.expr("(vec_id div 2) % 10"), F.expr("vec_id % 2")
    li, mi = F.expr("cast(i div 8 as long)"), F.expr("cast(i % 8 as long)")
    flux = F.when((F.col("vec_id") * 7 + F.col("i")) % 97 != 0, F.col("x").cast("double"))
    return schema.check_cells(
        v.select(
            t.alias("time_idx"), (F.lit(60000.0) + 0.01 * t).alias("mjd"), f.alias("freq_idx"), (F.lit(30e6) + 6e6 * f).alias("freq_hz"), p.alias("pol_idx"),
            F.when(p == 0, 1).otherwise(4).alias("stokes"), li.alias("l_idx"), mi.alias("m_idx"), (2 * li / 7 - 1).alias("l"), (2 * mi / 7 - 1).alias("m"), flux.alias("flux"),
        )
    )


def dealt(rows: DataFrame) -> DataFrame:
    """Rows dealt to as many tasks as a shuffle has. A small file is one task, however much is made of each of its rows."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cube's vectors, dealt to many tasks."""
    return dealt(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


def axis(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The distinct (index, value) pairs of the cube's time or frequency axis, from the vectors' keys: no pixel is read."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    t, f = F.expr("vec_id div 20"), F.expr("(vec_id div 2) % 10")
    made = {"time_idx": (t, (F.lit(60000.0) + 0.01 * t).alias("mjd")), "freq_idx": (f, (F.lit(30e6) + 6e6 * f).alias("freq_hz"))}[name]
    return v.select(made[0].alias(name), made[1]).distinct()


def arriving(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table as a stream of its files. A stream's path is a folder or, as here, a pattern."""
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/[{table[0]}]{table[1:]}.parquet")


def tiles(spark: SparkSession, sf_dir: str, tile: int = 4, vectors: DataFrame | None = None) -> DataFrame:
    """The same cube as stored tiles, cut from the vectors (a stream of them gives a stream); nothing is exploded to pixels."""
    v = vectors if vectors is not None else spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    flux = F.transform(F.col("embedding"), lambda x, i: F.when((F.col("vec_id") * 7 + i) % 97 != 0, x.cast("float")).otherwise(F.lit(float("nan")).cast("float")))
    n = range(-(-8 // tile))
    cut = [(a, b, min(tile, 8 - a * tile), min(tile, 8 - b * tile)) for a in n for b in n]
    row = lambda a, i, b, w: F.slice("data", (a * tile + i) * 8 + b * tile + 1, w)
    parts = [F.struct(*[F.lit(x).cast("long").alias(k) for k, x in zip(("tile_l", "tile_m", "l0", "m0"), (a, b, a * tile, b * tile))], F.lit(h).alias("n_l"), F.lit(w).alias("n_m"), F.concat(*[row(a, i, b, w) for i in range(h)]).alias("data")) for a, b, h, w in cut]
    rows = v.select(F.expr("vec_id div 20").alias("time_idx"), F.expr("(vec_id div 2) % 10").alias("freq_idx"), F.expr("vec_id % 2").alias("pol_idx"), flux.alias("data"))
    return rows.select("time_idx", "freq_idx", "pol_idx", F.explode(F.array(*parts)).alias("t")).select("time_idx", "freq_idx", "pol_idx", "t.*")


CELLS_SQL = """cells AS (
  SELECT vec_id // 20 AS time_idx, 60000.0 + 0.01 * (vec_id // 20) AS mjd, (vec_id // 2) % 10 AS freq_idx, CAST(30e6 + 6e6 * ((vec_id // 2) % 10) AS DOUBLE) AS freq_hz,
         vec_id % 2 AS pol_idx, CASE WHEN vec_id % 2 = 0 THEN 1 ELSE 4 END AS stokes, i // 8 AS l_idx, i % 8 AS m_idx,
         2 * (i // 8) / 7 - 1 AS l, 2 * (i % 8) / 7 - 1 AS m,
         CASE WHEN (vec_id * 7 + i) % 97 <> 0 THEN CAST(embedding[i + 1] AS DOUBLE) END AS flux
  FROM embeddings, unnest(range(0, 64)) AS u(i))"""


def beams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One beam a plane; every 37th is missing."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label")
    f = F.expr("(vec_id div 2) % 10")
    return v.select(
        F.expr("vec_id div 20").alias("time_idx"), f.alias("freq_idx"), F.expr("vec_id % 2").alias("pol_idx"),
        F.when(F.col("vec_id") % 37 != 0, 0.9 - 0.05 * f).alias("bmaj"), (0.4 + 0.02 * f).alias("bmin"), (F.col("label") * 30.0).alias("bpa"),
    )


BEAMS_SQL = """beams AS (
  SELECT vec_id // 20 AS time_idx, (vec_id // 2) % 10 AS freq_idx, vec_id % 2 AS pol_idx,
         CASE WHEN vec_id % 37 <> 0 THEN 0.9 - 0.05 * ((vec_id // 2) % 10) END AS bmaj, 0.4 + 0.02 * ((vec_id // 2) % 10) AS bmin, label * 30.0 AS bpa
  FROM embeddings)"""

BANDS = {"view": 41, "signup": 46, "click": 50, "error": 55, "purchase": 73}


def files(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """A file for each event (a stream of them gives a stream): stamp to the minute, subband from the type, Stokes from the user."""
    e = events if events is not None else spark.read.parquet(f"{sf_dir}/events.parquet")
    mhz = F.create_map(*[F.lit(x) for kv in BANDS.items() for x in kv])[F.col("event_type")]
    # Hours 0, 3, 6, ... count to the hour before, so observations come in pairs an hour apart.
    whole = F.date_trunc("hour", "ts")
    stamp = F.when(F.hour("ts") % 3 == 0, whole - F.expr("interval 1 hour")).otherwise(whole)
    name = F.concat(F.date_format(stamp, "yyyyMMdd_HHmmss"), F.lit("_"), mhz.cast("string"), F.lit("MHz-"), F.when(F.col("user_id") % 2 == 0, "I").otherwise("V"), F.lit("-image.fits"))
    i = F.col("event_id")
    bmaj = F.when(i % 11 == 0, F.lit(None)).when(i % 13 == 0, "0").when(i % 17 == 0, "bad").otherwise(F.format_string("%.5f", F.col("value") / 1000))
    header = F.map_from_arrays(F.array(*[F.lit(k) for k in ("BMAJ", "BMIN", "RESTFREQ", "DATE-OBS")]), F.array(bmaj, F.lit("0.01"), F.format_string("%.1f", mhz * 1e6 + i % 3 * 1000), F.date_format(F.when(F.hour(stamp) % 4 == 1, stamp).otherwise(F.col("ts")), "yyyy-MM-dd'T'HH:mm:ss")))
    return e.select(
        F.concat(F.lit("/data/"), F.lpad(i.cast("string"), 8, "0"), F.lit("/"), name).alias("path"), name.alias("name"),
        F.when(i % 19 == 0, 0).otherwise(40000 + i % 50000).cast("long").alias("size_bytes"), header.alias("header"), "event_id", "ts",
    )


FILES_SQL = """files AS (
  SELECT *, '/data/' || lpad(CAST(event_id AS VARCHAR), 8, '0') || '/' || name AS path FROM (
    SELECT event_id, ts, mhz, strftime(stamp, '%Y%m%d_%H%M%S') || '_' || mhz || 'MHz-' || CASE WHEN user_id % 2 = 0 THEN 'I' ELSE 'V' END || '-image.fits' AS name,
           strftime(stamp, '%Y%m%d_%H%M%S') AS time_key, CASE WHEN hour(stamp) % 4 = 1 THEN stamp ELSE date_trunc('second', ts) END AS header_time, CASE WHEN user_id % 2 = 0 THEN 1 ELSE 4 END AS stokes,
           CASE WHEN event_id % 19 = 0 THEN 0 ELSE 40000 + event_id % 50000 END AS size_bytes,
           CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 13 = 0 THEN '0' WHEN event_id % 17 = 0 THEN 'bad' ELSE 'ok' END AS beam,
           mhz * 1e6 + event_id % 3 * 1000 AS freq_hz
    FROM (SELECT *, CASE event_type WHEN 'view' THEN 41 WHEN 'signup' THEN 46 WHEN 'click' THEN 50 WHEN 'error' THEN 55 WHEN 'purchase' THEN 73 END AS mhz,
                 date_trunc('hour', ts) - CASE WHEN hour(ts) % 3 = 0 THEN INTERVAL 1 HOUR ELSE INTERVAL 0 HOUR END AS stamp FROM events)))"""


def light_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_id, ts, band, flux)."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    mhz = F.create_map(*[F.lit(x) for kv in BANDS.items() for x in kv])[F.col("event_type")]
    return e.select(F.col("user_id").alias("source_id"), "ts", mhz.cast("long").alias("band"), F.col("value").alias("flux"), "event_id")


CURVES_SQL = """curves AS (
  SELECT user_id AS source_id, ts, CAST(CASE event_type WHEN 'view' THEN 41 WHEN 'signup' THEN 46 WHEN 'click' THEN 50 WHEN 'error' THEN 55 WHEN 'purchase' THEN 73 END AS BIGINT) AS band,
         value AS flux, event_id FROM events)"""


def flux_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measured and model flux of calibrators; the model is 0 for one size of part."""
    line, part = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "part"))
    return line.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("p_brand").alias("source"), (F.col("l_orderkey") % 24).alias("hour"), F.col("l_linenumber").cast("long").alias("freq"),
        F.col("l_extendedprice").alias("imfit_flux"), F.when(F.col("p_size") == 1, 0.0).otherwise(F.col("p_retailprice") * F.col("l_quantity")).alias("model_flux"), F.col("l_discount").alias("shift"),
    )


FLUX_SQL = """flux AS (
  SELECT p_brand AS source, l_orderkey % 24 AS hour, CAST(l_linenumber AS BIGINT) AS freq, l_extendedprice AS imfit_flux,
         CASE WHEN p_size = 1 THEN 0.0 ELSE p_retailprice * l_quantity END AS model_flux, l_discount AS shift
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each pipeline run: (obs_date, lst_hour, run, qualified, n_subbands)."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select(
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("obs_date"), (F.col("o_orderkey") % 24).alias("lst_hour"),
        F.concat(F.lit("Run_"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("_"), F.lpad((F.col("o_custkey") % 240000).cast("string"), 6, "0")).alias("run"),
        (F.col("o_orderstatus") != "P").alias("qualified"), (F.col("o_custkey") % 15 + 1).alias("n_subbands"),
    )


RUNS_SQL = """runs AS (
  SELECT strftime(o_orderdate, '%Y-%m-%d') AS obs_date, o_orderkey % 24 AS lst_hour,
         'Run_' || strftime(o_orderdate, '%Y%m%d') || '_' || lpad(CAST(o_custkey % 240000 AS VARCHAR), 6, '0') AS run,
         o_orderstatus <> 'P' AS qualified, o_custkey % 15 + 1 AS n_subbands FROM orders)"""


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions to follow, from customers: (source_id, ra_deg, dec_deg)."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return c.select(F.col("c_custkey").alias("source_id"), (F.col("c_custkey") * 37 % 360).cast("double").alias("ra_deg"), (F.col("c_nationkey") * 5 - 30).cast("double").alias("dec_deg"))


SOURCES_SQL = "sources AS (SELECT c_custkey AS source_id, CAST(c_custkey * 37 % 360 AS DOUBLE) AS ra_deg, CAST(c_nationkey * 5 - 30 AS DOUBLE) AS dec_deg FROM customer)"
