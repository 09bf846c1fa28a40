"""A cube store that grows: tiles, axes whose numbers never change, and a manifest that commits both together.

Below the store's path lie

* ``tiles/run=R/time_idx=T``: tiles that run R wrote;
* ``axes/run=R``: the values that run R added to the axes: axis, idx, value (MJD, Hz, Stokes), label;
* ``planes/run=R``: which file each new plane came from;
* ``files/run=R``: what became of every file that the run saw;
* ``manifest/V.json``: version V, of run R. Runs without one are not there for any reader.

A value keeps its number for ever. A run looks its values up, gives those that are new the numbers
after the largest, writes, and creates the next version's manifest, which fails if another run has
done so since it began to read. So a run that fails, or loses such a race, leaves nothing that
anyone reads, and may be run again.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .schema import TILES, CubeError

AXES = "axis string, idx long, value double, label string"
PLANES = "path string, plane int, time_idx long, freq_idx long, pol_idx long, n_l int, n_m int, header map<string,string>"
OUTCOMES = "path string, size_bytes long, outcome string, detail string"
#: Two values of an axis no further apart are one: days, Hz, Stokes codes.
TOLERANCES = {"time": 1e-9, "freq": 1.0, "pol": 0.0}


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def is_cube(spark: SparkSession, path: str) -> bool:
    at, fs = _fs(spark, f"{path}/manifest")
    return fs.exists(at)


def versions(spark: SparkSession, path: str) -> list[dict]:
    """The manifests in order, a small record for each run."""
    if not is_cube(spark, path):
        return []
    rows = spark.read.schema("version long, run string, planes long, files long").json(f"{path}/manifest").collect()
    return sorted((r.asDict() for r in rows), key=lambda r: r["version"])


def new_run() -> str:
    return uuid.uuid4().hex


def commit(spark: SparkSession, path: str, seen: int, run: str, **counts: int) -> int:
    """Makes run the version after ``seen``; CubeError if there is such a version already."""
    record = json.dumps({"version": seen + 1, "run": run, **counts})
    half, fs = _fs(spark, f"{path}/_{run}.json")
    out = fs.create(half, True)
    out.write(bytearray(record.encode()))
    out.close()
    to, _ = _fs(spark, f"{path}/manifest/{seen + 1:010d}.json")
    fs.mkdirs(to.getParent())
    if fs.exists(to) or not fs.rename(half, to):
        fs.delete(half, False)
        raise CubeError(f"version {seen + 1} of {path} was written meanwhile; run again")
    return seen + 1


def _committed(spark: SparkSession, path: str, part: str, schema: str, at: list[dict] | None = None) -> DataFrame:
    """Rows of the committed runs; the runs' names prune partitions."""
    runs = [r["run"] for r in (versions(spark, path) if at is None else at)]
    there = [r for r in runs if (lambda x: x[1].exists(x[0]))(_fs(spark, f"{path}/{part}/run={r}"))]
    if not there:
        return spark.createDataFrame([], schema).withColumn("run", F.lit(None).cast("string"))
    return spark.read.schema(f"{schema}, run string").option("basePath", f"{path}/{part}").parquet(*[f"{path}/{part}/run={r}" for r in there])


def axes(spark: SparkSession, path: str) -> DataFrame:
    """(axis, idx, value, label): some thousands of rows at most."""
    return _committed(spark, path, "axes", AXES).drop("run")


def planes(spark: SparkSession, path: str) -> DataFrame:
    return _committed(spark, path, "planes", PLANES)


def files(spark: SparkSession, path: str) -> DataFrame:
    """What became of each file, in each run."""
    return _committed(spark, path, "files", OUTCOMES)


def tiles(spark: SparkSession, path: str) -> DataFrame:
    """The tiles that were written; planes that no file had have none."""
    return _committed(spark, path, "tiles", TILES).select([x.split()[0] for x in TILES.split(", ")])


def filled_tiles(spark: SparkSession, path: str) -> DataFrame:
    """Tiles of every (time, channel, Stokes); those of missing planes are NaN and take their shape from the same place of other planes."""
    here, number = tiles(spark, path), axes(spark, path)
    values = lambda axis: number.where(F.col("axis") == axis).select(F.col("idx").alias(f"{axis}_idx"))
    place, key = ["tile_l", "tile_m", "l0", "m0", "n_l", "n_m"], ["time_idx", "freq_idx", "pol_idx"]
    every = values("time").join(values("freq"), F.lit(True)).join(values("pol"), F.lit(True))
    missing = every.join(planes(spark, path).select(*key), key, "left_anti").join(here.select(*place).distinct(), F.lit(True))
    nan = F.array_repeat(F.lit(float("nan")).cast("float"), F.col("n_l") * F.col("n_m"))
    return here.unionByName(missing.withColumn("data", nan).select(here.columns))


def in_order(spark: SparkSession, path: str) -> DataFrame:
    """(time_idx, mjd, label, place): where each time lies among all; numbers tell only when a time was first seen."""
    t = axes(spark, path).where("axis = 'time'")
    return t.select(F.col("idx").alias("time_idx"), F.col("value").alias("mjd"), "label", (F.row_number().over(Window.orderBy(F.col("value").asc_nulls_last(), "label")) - 1).alias("place"))


def looked_up(values: DataFrame, known: DataFrame, tolerance: float) -> DataFrame:
    """(value, label, idx): of each distinct (value, label) the number it has, NULL if it is new.

    The same label, where there is one, has the number; else the nearest value within the
    tolerance, of two the smaller number. Values stand in buckets of twice the tolerance, known ones
    in both neighbours too, so equality joins find every pair in reach.
    """
    rows = values.select("value", "label").distinct()
    by_label = known.where("label IS NOT NULL").groupBy("label").agg(F.min("idx").alias("by_label"))
    width = max(2 * tolerance, 1e-9)
    bucket = lambda c: F.floor(c / width).cast("long")
    near = known.select(F.col("idx").alias("i"), F.col("value").alias("v"), F.explode(F.array(*[bucket(F.col("value")) + k for k in (-1, 0, 1)])).alias("b"))
    gap = F.abs(F.col("value") - F.col("v"))
    slack = tolerance + 1e-12 * F.abs(F.col("value"))
    close = rows.join(near, bucket(F.col("value")) == F.col("b")).where(gap <= slack).groupBy("value").agg(F.min_by("i", F.struct(gap, "i")).alias("by_value"))
    out = rows.join(by_label, "label", "left").join(close, "value", "left")
    return out.select("value", "label", F.coalesce("by_label", "by_value").alias("idx"))


def numbered(values: DataFrame, known: DataFrame, tolerance: float) -> DataFrame:
    """(value, label, idx, is_new): numbers of all values. New ones no further apart than the tolerance, one after the other, are one.

    The windows run over an axis' new values alone.
    """
    found = looked_up(values, known, tolerance)
    w = Window.orderBy(F.col("value").asc_nulls_last(), "label")
    apart = F.coalesce(F.col("value") - F.lag("value").over(w) > tolerance + 1e-12 * F.abs(F.col("value")), F.lit(True))
    new = found.where("idx IS NULL").withColumn("rank", F.sum(apart.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    last = known.agg(F.coalesce(F.max("idx"), F.lit(-1)).alias("last"))
    new = new.join(last, F.lit(True)).select("value", "label", (F.col("last") + F.col("rank")).alias("idx"), F.lit(True).alias("is_new"))
    return found.where("idx IS NOT NULL").withColumn("is_new", F.lit(False)).unionByName(new)
