"""Streams over the same tables, run to their end and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import inventory as I
from ..sources import store, views
from ..sources.scratch import new_path
from ..sources.views import CELLS_SQL, FILES_SQL
from ..streaming import arrivals
from .registry import query, rounded

W = f"WITH {FILES_SQL} "


def _files(spark, sf_dir) -> DataFrame:
    arriving = I.described(views.files(spark, sf_dir, views.arriving(spark, sf_dir, "events")))
    return arriving.withColumn("ts", F.col("ts").cast("timestamp"))


def _drained(spark, stream: DataFrame) -> DataFrame:
    path = new_path(spark, "stream")
    arrivals.drain(stream, path, new_path(spark, "progress"))
    return spark.read.schema(stream.schema).parquet(path)


@query("r1_append_stream", f"WITH {CELLS_SQL} SELECT time_idx, freq_idx, pol_idx, count(*) AS pixels, round(sum(flux * (l_idx * 8 + m_idx)), 4) + 0.0 AS mark FROM cells GROUP BY ALL")
def append_stream(spark, sf_dir):
    """Tiles that arrive as a stream, twice, in a store that has them once."""
    path = new_path(spark, "store")
    for _ in range(2):
        tiles = views.tiles(spark, sf_dir, vectors=views.arriving(spark, sf_dir, "embeddings"))
        arrivals.append_as_they_arrive(tiles, path, new_path(spark, "progress")).awaitTermination()
    cells = store.to_cells(store.open_tiles(spark, path))
    out = cells.groupBy("time_idx", "freq_idx", "pol_idx").agg(F.count(F.lit(1)).alias("pixels"), F.sum(F.col("flux") * (F.col("l_idx") * 8 + F.col("m_idx"))).alias("mark"))
    return rounded(out.withColumn("time_idx", F.col("time_idx").cast("long")), "mark", digits=4)


@query("r2_first_arrivals", W + "SELECT DISTINCT time_key, CAST(round_even(freq_hz / 23000.0, 0) AS BIGINT) AS freq_bin, CAST(stokes AS INT) AS stokes FROM files")
def first_arrivals(spark, sf_dir):
    """One file of each key; all arrive within the watermark, as the table is one batch."""
    return _drained(spark, arrivals.first_arrivals(_files(spark, sf_dir).select("ts", "time_key", "freq_bin", "stokes"))).select("time_key", "freq_bin", "stokes")


@query(
    "r3_merged_observations",
    W + """, f AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY stokes ORDER BY ts) <= INTERVAL 20 MINUTE THEN 0 ELSE 1 END AS new FROM files), g AS (SELECT *, sum(new) OVER (PARTITION BY stokes ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM f)
SELECT CAST(stokes AS INT) AS stokes, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS files, CAST(count(DISTINCT mhz) AS INT) AS subbands FROM g GROUP BY stokes, k HAVING max(ts) + INTERVAL 20 MINUTE <= (SELECT max(ts) FROM files) - INTERVAL 1 HOUR""",
)
def merged_observations(spark, sf_dir):
    """Observations that the watermark has passed."""
    found = _drained(spark, arrivals.merged_observations(_files(spark, sf_dir).select("ts", "stokes", "mhz"), 1200))
    return found.select("stokes", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "files", "subbands")


@query("r4_running_coverage", W + "SELECT strftime(ts, '%Y-%m-%d') AS day, mhz + 0.0 AS mhz, count(*) AS files FROM files GROUP BY ALL")
def running_coverage(spark, sf_dir):
    """The last state of a table that is updated as files come."""
    path = new_path(spark, "coverage")

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    stream = arrivals.running_coverage(_files(spark, sf_dir).select("ts", "mhz"))
    stream.writeStream.foreachBatch(keep).outputMode("complete").option("checkpointLocation", new_path(spark, "progress")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path).select(F.col("day").cast("string").alias("day"), "mhz", "files")
