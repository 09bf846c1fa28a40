"""Incremental ingest: files arrive, time steps are appended once, late subbands merge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import append_tiles


def append_as_they_arrive(tiles: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Tiles of a stream into a store. A time step may arrive over several batches; a batch that is run again adds nothing."""

    def add(batch: DataFrame, _: int) -> None:
        append_tiles(batch, path)

    return tiles.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_arrivals(files: DataFrame, delay: str = "1 hour") -> DataFrame:
    """One file of each (time_key, freq_bin, stokes) within the watermark; state is dropped behind it."""
    return files.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["time_key", "freq_bin", "stokes"])


def merged_observations(files: DataFrame, tolerance_s: float, key: str = "stokes", delay: str = "1 hour") -> DataFrame:
    """Files of one key no further apart than the tolerance are one observation, named by its start.

    A group is given out once the watermark has passed, so a late earlier file can't rename it.
    Its subbands are a set of some dozens.
    """
    window = F.session_window("ts", f"{int(tolerance_s * 1000)} milliseconds")
    return files.withWatermark("ts", delay).groupBy(key, window.alias("w")).agg(F.count(F.lit(1)).alias("files"), F.size(F.collect_set("mhz")).alias("subbands")).select(key, F.col("w.start").alias("start"), "files", "subbands")


def running_coverage(files: DataFrame) -> DataFrame:
    """Files for each day and subband, updated as they come."""
    return files.groupBy(F.to_date("ts").alias("day"), "mhz").agg(F.count(F.lit(1)).alias("files"))


def drain(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Run an append stream over all there is, into Parquet."""
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
