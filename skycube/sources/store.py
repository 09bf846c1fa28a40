"""The cube on disk: tiles partitioned by time, opened with a check, extended without doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cube
from .schema import TILES, CubeError


def open_tiles(spark: SparkSession, path: str) -> DataFrame:
    """The tiles of a plain store, or of a cube store with NaN where no file had a plane."""
    if cube.is_cube(spark, path):
        return cube.filled_tiles(spark, path)
    found = spark.read.parquet(path)
    need = {x.split()[0] for x in TILES.split(", ")}
    if missing := sorted(need - set(found.columns)):
        raise CubeError(f"missing columns: {', '.join(missing)}")
    return found


#: What tells one tile of a cube from another.
TILE_KEY = ("time_idx", "freq_idx", "pol_idx", "tile_l", "tile_m")
_NOTHING_THERE = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def stored_keys(tiles: DataFrame, path: str, keys: tuple[str, ...]) -> DataFrame:
    """The distinct keys of the store that ``tiles`` would go to; none where nothing has been written.

    A store that is there but can't be read is an error, so nothing is appended to it twice.
    """
    from pyspark.errors import AnalysisException

    spark = tiles.sparkSession
    try:
        return spark.read.parquet(path).select(*keys).distinct()
    except AnalysisException as e:
        if e.getCondition() not in _NOTHING_THERE:
            raise
        return spark.createDataFrame([], tiles.select(*keys).schema)


def by_time(tiles: DataFrame) -> DataFrame:
    """Tiles dealt by time step, eight channels together, for writers that put a folder to each step.

    So a step is a file or a few. Tasks that hold some tiles of every step would each write a file to each folder.
    """
    n = int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return tiles.repartition(n, "time_idx", F.expr("freq_idx div 8"))


def append_tiles(tiles: DataFrame, path: str) -> None:
    """Add the tiles that are not stored yet. Told by plane and tile, so parts of a time step may come one after the other."""
    new = tiles.join(stored_keys(tiles, path, TILE_KEY), list(TILE_KEY), "left_anti").select(tiles.columns)
    by_time(new).write.mode("append").partitionBy("time_idx").parquet(path)


def append_times(tiles: DataFrame, path: str, overwrite: bool = False) -> None:
    """Add whole time steps. A time that is stored is skipped whole, or replaced on request; others stay untouched."""
    if overwrite:
        by_time(tiles).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("time_idx").parquet(path)
        return
    new = tiles.join(stored_keys(tiles, path, ("time_idx",)), "time_idx", "left_anti").select(tiles.columns)
    by_time(new).write.mode("append").partitionBy("time_idx").parquet(path)


def rechunk(spark: SparkSession, path: str, to: str, tile: int) -> DataFrame:
    """Writes a store anew in tiles of another size and compares the two: (plane, equal) for each plane.

    Values are compared by place without bringing pixels together: each pixel gives a hash of
    its place and value, and a plane's hashes are summed on both sides.
    """
    by_time(regroup(open_tiles(spark, path), tile)).write.partitionBy("time_idx").parquet(to)
    plane = ["time_idx", "freq_idx", "pol_idx"]

    def marks(of: str, name: str) -> DataFrame:
        cells = to_cells(open_tiles(spark, of))
        return cells.groupBy(*plane).agg(F.count(F.lit(1)).alias(f"{name}_n"), F.sum(F.xxhash64("l_idx", "m_idx", "flux").cast("decimal(38,0)")).alias(f"{name}_sum"))

    both = marks(path, "a").join(marks(to, "b"), plane, "full")
    return both.select(*plane, (F.col("a_n").eqNullSafe(F.col("b_n")) & F.col("a_sum").eqNullSafe(F.col("b_sum"))).alias("equal"))


def to_cells(tiles: DataFrame) -> DataFrame:
    """Pixels of tiles: NaN becomes NULL. Explodes, so select tiles first."""
    rows = tiles.select("time_idx", "freq_idx", "pol_idx", "l0", "m0", "n_m", F.posexplode("data").alias("k", "x"))
    x = F.col("x").cast("double")
    return rows.select("time_idx", "freq_idx", "pol_idx", (F.col("l0") + F.expr("k div n_m")).alias("l_idx"), (F.col("m0") + F.col("k") % F.col("n_m")).alias("m_idx"), F.when(~F.isnan(x), x).alias("flux"))


def pixels_at(tiles: DataFrame, tracked: DataFrame, tile: int) -> DataFrame:
    """Tracked pixels, or those of places (time_idx, l_idx, m_idx), straight from tile arrays: an equality join on (time, tile), then one element."""
    keep = [c for c in ("source_id", "time_idx", "l_idx", "m_idx") if c in tracked.columns]
    wanted = (tracked.where("visible") if "visible" in tracked.columns else tracked).select(*keep).withColumns({"tile_l": F.expr(f"l_idx div {tile}"), "tile_m": F.expr(f"m_idx div {tile}")})
    rows = wanted.join(tiles, ["time_idx", "tile_l", "tile_m"])
    value = F.get("data", ((F.col("l_idx") - F.col("l0")) * F.col("n_m") + F.col("m_idx") - F.col("m0")).cast("int")).cast("double")
    return rows.select(*keep, "freq_idx", "pol_idx", F.when(~F.isnan(value), value).alias("flux"))


def regroup(cells_or_tiles: DataFrame, tile: int) -> DataFrame:
    """Tiles of another size. Source tiles are cut at the new borders, so whole runs of pixels move.

    Each column of a source tile (one l, a run of m) goes to the new tile it lies in; a new tile
    is put together from its columns, in order. One shuffle by the new key.
    """
    t = cells_or_tiles
    row = F.explode(F.sequence(F.lit(0), F.col("n_l") - 1)).alias("a")
    rows = t.select("time_idx", "freq_idx", "pol_idx", "l0", "m0", "n_m", "data", row)
    rows = rows.select("time_idx", "freq_idx", "pol_idx", (F.col("l0") + F.col("a")).alias("l"), "m0", "n_m", F.slice("data", F.col("a") * F.col("n_m") + 1, F.col("n_m")).alias("run"))
    cut = F.explode(F.sequence(F.expr(f"m0 div {tile}"), F.expr(f"(m0 + n_m - 1) div {tile}"))).alias("tile_m")
    rows = rows.select("*", cut)
    begin = F.greatest(F.col("m0"), F.col("tile_m") * tile)
    end = F.least(F.col("m0") + F.col("n_m"), (F.col("tile_m") + 1) * tile)
    rows = rows.select("time_idx", "freq_idx", "pol_idx", F.expr(f"l div {tile}").alias("tile_l"), "tile_m", "l", begin.alias("m"), F.slice("run", (begin - F.col("m0") + 1).cast("int"), (end - begin).cast("int")).alias("run"))
    out = rows.groupBy("time_idx", "freq_idx", "pol_idx", "tile_l", "tile_m").agg(F.array_sort(F.collect_list(F.struct("l", "m", "run"))).alias("x"))
    n_l = F.size(F.array_distinct(F.transform("x", lambda s: s["l"])))
    return out.select("time_idx", "freq_idx", "pol_idx", "tile_l", "tile_m", F.get("x", F.lit(0))["l"].alias("l0"), F.get("x", F.lit(0))["m"].alias("m0"), n_l.alias("n_l"), (F.size(F.flatten(F.transform("x", lambda s: s["run"]))) / n_l).cast("int").alias("n_m"), F.flatten(F.transform("x", lambda s: s["run"])).alias("data"))


def to_tiles(cells: DataFrame, tile: int) -> DataFrame:
    """Dense cells as tiles; NULL pixels become NaN."""
    rows = cells.withColumns({"tile_l": F.expr(f"l_idx div {tile}"), "tile_m": F.expr(f"m_idx div {tile}")})
    x = F.coalesce(F.col("flux").cast("float"), F.lit(float("nan")).cast("float"))
    out = rows.groupBy("time_idx", "freq_idx", "pol_idx", "tile_l", "tile_m").agg(F.array_sort(F.collect_list(F.struct("l_idx", "m_idx", x.alias("x")))).alias("s"), F.min("l_idx").alias("l0"), F.min("m_idx").alias("m0"), F.max("l_idx").alias("l1"), F.max("m_idx").alias("m1"))
    return out.select("time_idx", "freq_idx", "pol_idx", "tile_l", "tile_m", "l0", "m0", (F.col("l1") - F.col("l0") + 1).cast("int").alias("n_l"), (F.col("m1") - F.col("m0") + 1).cast("int").alias("n_m"), F.transform("s", lambda v: v["x"]).alias("data"))


def axis_lengths(arrays: DataFrame) -> DataFrame:
    """(variable, length, short): time lengths of variables (variable, time_idx) and which exceed the shortest."""
    lengths = arrays.groupBy("variable").agg((F.max("time_idx") + 1).alias("length"))
    return lengths.join(lengths.agg(F.min("length").alias("least")), F.lit(True))


def cut_to_shortest(arrays: DataFrame) -> DataFrame:
    least = axis_lengths(arrays).agg(F.max("least").alias("least"))
    return arrays.join(F.broadcast(least), F.col("time_idx") < F.col("least")).drop("least")


def best_planes(planes: DataFrame) -> DataFrame:
    """Of duplicate Stokes planes the one with most pixels, of equals the first (plane_idx)."""
    counted = planes.groupBy("time_idx", "freq_idx", "stokes", "plane_idx").agg(F.count("flux").alias("n"))
    return counted.groupBy("time_idx", "freq_idx", "stokes").agg(F.max_by("plane_idx", F.struct("n", -F.col("plane_idx"))).alias("plane_idx"))
