"""From files to a cube: planes of any run find their place on axes that never change."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import names as NM
from ..operators import halo
from ..operators import inventory as I
from ..sources import cube, fits, store
from ..sources.schema import CubeError
from ..sources.scratch import new_path

AXIS_OF = {"time": ("mjd", "group_key"), "freq": ("freq_hz", None), "pol": ("stokes", None)}
#: Files without a frequency are one channel, after all others.
NO_FREQUENCY = 1e15


def axes(files: DataFrame) -> DataFrame:
    """``files`` (group_key, freq_hz, stokes, path) with time_idx, freq_idx and pol_idx on the union of all axes.

    Files without a frequency come last, as one channel. Axes are distinct values, some thousands at most; their ranks are windows over
    those.
    """
    files = files.withColumn("freq_hz", F.coalesce("freq_hz", F.lit(NO_FREQUENCY)))
    for column, name in (("group_key", "time_idx"), ("freq_hz", "freq_idx"), ("stokes", "pol_idx")):
        axis = files.select(column).distinct().withColumn(name, (F.row_number().over(Window.orderBy(column)) - 1).cast("long"))
        files = files.join(axis, column)
    return files


def combined(files: DataFrame, tiles: DataFrame) -> DataFrame:
    """Cube tiles of all time steps: every (time, channel, Stokes) is there; planes that no file has are NaN.

    ``files``: group_key, freq_hz, stokes, path; ``tiles``: path and a plane's tiles. Only tile
    keys are crossed with the axes; missing tiles take their shape from those that the same
    place has in other planes.
    """
    planes = axes(files)
    here = tiles.join(planes.select("path", "time_idx", "freq_idx", "pol_idx"), "path").drop("path")
    place = ["tile_l", "tile_m", "l0", "m0", "n_l", "n_m"]
    shapes = tiles.select(*place).distinct()
    every = planes.select("time_idx").distinct().join(planes.select("freq_idx").distinct(), F.lit(True)).join(planes.select("pol_idx").distinct(), F.lit(True))
    missing = every.join(planes.select("time_idx", "freq_idx", "pol_idx"), ["time_idx", "freq_idx", "pol_idx"], "left_anti").join(shapes, F.lit(True))
    nan = F.array_repeat(F.lit(float("nan")).cast("float"), F.col("n_l") * F.col("n_m"))
    return here.unionByName(missing.withColumn("data", nan)).select("time_idx", "freq_idx", "pol_idx", *place, "data")


def _stored(df: DataFrame, tag: str) -> DataFrame:
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _number(header: Column, key: str, default: float) -> Column:
    return F.coalesce(header[key].try_cast("double"), F.lit(default))


def planes_of(files: DataFrame) -> DataFrame:
    """A row for each image plane of described files: plane, and freq_hz and stokes by the header's axes.

    A file of one plane keeps the frequency and Stokes that were found for it. In a spectral cube
    plane k is channel k mod NAXIS3, at CRVAL3 + (channel + 1 - CRPIX3) CDELT3, and Stokes by axis 4 alike.
    """
    h = F.col("header")
    n = lambda k: F.greatest(F.coalesce(h[k].try_cast("int"), F.lit(1)), F.lit(1))
    rows = files.withColumns({"_n3": n("NAXIS3"), "_n4": n("NAXIS4")}).withColumn("plane", F.explode(F.sequence(F.lit(0), F.col("_n3") * F.col("_n4") - 1)))
    at = lambda axis, k: _number(h, f"CRVAL{axis}", 0.0) + (k + 1 - _number(h, f"CRPIX{axis}", 1.0)) * _number(h, f"CDELT{axis}", 1.0)
    return rows.withColumns({
        "freq_hz": F.when(F.col("_n3") > 1, at(3, F.col("plane") % F.col("_n3"))).otherwise(F.coalesce("freq_hz", F.lit(NO_FREQUENCY))),
        "stokes": F.when(F.col("_n4") > 1, F.round(at(4, F.expr("plane div _n3"))).cast("int")).otherwise(F.col("stokes")),
    }).drop("_n3", "_n4")


def examined(files: DataFrame, tolerance_s: float) -> DataFrame:
    """Every file of ``read_headers`` with its time group and an outcome; NULL for those to convert.

    Files that can't be read or are cut short go first, so that a broken copy doesn't stand for a
    good one; then second copies of one plane, by path; then bad beams; then LST groups whose
    headers disagree in time.
    """
    rows = I.described(files)
    h = F.col("header")
    short = F.when(F.col("size_bytes") == 0, "empty").when(F.col("size_bytes") < F.col("needs"), "truncated")
    bad = F.coalesce(short, F.when(F.col("problem").startswith("unreadable"), "unreadable").when(F.col("problem").isNotNull(), "malformed"))
    # Spectral cubes are told from files of one plane by the number of theirs.
    shape = F.concat_ws("x", h["NAXIS3"], h["NAXIS4"])
    rows = _stored(rows.withColumns({"outcome": bad, "shape": shape}), "headers")
    good = rows.where("outcome IS NULL")
    groups = I.merged_keys(good.select("time_key", "mjd"), tolerance_s)
    good = good.join(groups, "time_key", "left").withColumn("group_key", F.coalesce("group_key", "time_key"))
    # The first copy of each plane of an observation, as first_of() has it, marked instead of kept.
    copy = F.struct(F.coalesce("group_key", F.concat(F.lit("path "), "path")).alias("g"), F.coalesce(F.col("freq_bin").cast("string"), F.col("path")).alias("b"), "stokes", "shape")
    order = Window.partitionBy(copy).orderBy("time_key", "path")
    good = good.withColumn("outcome", F.when(F.row_number().over(order) > 1, "copy of a plane").when(F.col("beam_reason").isNotNull(), "beam").otherwise(F.when(F.col("time_key").isNull(), "no time")))
    lst = F.col("group_key").rlike("LST")
    times = F.collect_set(F.when(lst & F.col("outcome").isNull(), F.col("header_time"))).over(Window.partitionBy("group_key"))
    good = good.withColumn("outcome", F.coalesce("outcome", F.when(lst & (F.size(times) > 1), "mixed header times")))
    return good.unionByName(rows.where("outcome IS NOT NULL").withColumn("group_key", F.col("time_key")))


def _grid(header: Column) -> Column:
    """The pixel axes of a header: where they begin, their step in degrees, their length."""
    axis = lambda k: F.struct(((1 - _number(header, f"CRPIX{k}", 1.0)) * _number(header, f"CDELT{k}", 1.0)).alias("begin"), _number(header, f"CDELT{k}", 1.0).alias("step"), header[f"NAXIS{k}"].cast("int").alias("size"))
    return F.struct(axis(1).alias("l"), axis(2).alias("m"))


def reference_grid(first_run: DataFrame) -> Row | None:
    """The grid that all planes of a store are on: that of the first plane of its first run, by number."""
    return first_run.agg(F.min_by(_grid(F.col("header")), F.struct("time_idx", "freq_idx", "pol_idx")).alias("g")).first().g


def _on_one_grid(tiles: DataFrame, fresh: DataFrame, to: Row | None, tile: int) -> DataFrame:
    """Tiles of planes on another grid than ``to`` are taken to it, bilinear, by tiles with borders; the others stay."""
    if to is None:
        return tiles
    own = _grid(F.col("header"))
    other = fresh.select("time_idx", "freq_idx", "pol_idx", own.alias("g")).where(~F.col("g").eqNullSafe(F.struct(*[F.struct(F.lit(a.begin).alias("begin"), F.lit(a.step).alias("step"), F.lit(a.size).alias("size")).alias(k) for k, a in (("l", to.l), ("m", to.m))])))
    if not other.take(1):
        return tiles
    key = ["time_idx", "freq_idx", "pol_idx"]
    moved = tiles.join(other, key).withColumns({f"{k}_{x}": F.col(f"g.{k}.{x}") for k in "lm" for x in ("begin", "step", "size")})
    old = tuple(tuple(F.col(f"{k}_{x}") for x in ("begin", "step", "size")) for k in "lm")
    on_it = halo.regrid_tiles(moved, old, ((to.l.begin, to.l.step, to.l.size), (to.m.begin, to.m.step, to.m.size)), tile)
    return tiles.join(other.select(*key), key, "left_anti").unionByName(on_it.withColumn("data", F.col("data").cast("array<float>")))


def convert(spark: SparkSession, source: str, path: str, tolerance_s: float = 60.0, tile: int = 512, strict: bool = True) -> DataFrame:
    """FITS files of a folder into a cube store; gives the planes of the folder that are in the store, and whether they are new.

    Planes whose pixel axes differ from those of the store's first plane are taken to that grid.
    Headers are read once and stored with what is to become of each file. Times, channels and Stokes
    keep the numbers that earlier runs gave them: a time is an earlier one if it has its key or is
    within the tolerance of it, whatever the order in which folders come. Planes that are
    stored stay as they are, so a second run adds nothing and a late subband joins its observation.
    Tiles and axes become visible together, by the version that this run commits; what became of
    each file is in ``cube.files``. With ``strict``, a file that could not be read (not one that is
    malformed or short) ends the run before anything is committed: its store, not its contents, is at fault.
    """
    seen = cube.versions(spark, path)
    run, version = cube.new_run(), seen[-1]["version"] if seen else 0
    rows = _stored(examined(fits.read_headers(spark, source), tolerance_s), "examined")
    if strict and (lost := rows.where("outcome = 'unreadable'").select("path", "problem").take(3)):
        raise CubeError("can't be read: " + "; ".join(f"{r.path} ({r.problem})" for r in lost))
    planes = planes_of(rows.where("outcome IS NULL"))
    # An observation's time is that of its earliest key.
    first = planes.groupBy("group_key").agg(F.min("mjd").alias("mjd"))
    planes = planes.drop("mjd").join(first, "group_key").withColumn("stokes", F.col("stokes").cast("double"))
    known, numbers = cube.axes(spark, path), []
    label_of = lambda label: F.col(label) if label else F.lit(None).cast("string")
    for axis, (value, label) in AXIS_OF.items():
        tolerance = max(tolerance_s / 86400, cube.TOLERANCES[axis]) if axis == "time" else cube.TOLERANCES[axis]
        values = planes.select(F.col(value).alias("value"), label_of(label).alias("label"))
        numbers.append(cube.numbered(values, known.where(F.col("axis") == axis), tolerance).select(F.lit(axis).alias("axis"), "value", "label", "idx", "is_new"))
    numbers = _stored(reduce(DataFrame.unionByName, numbers), "axes")
    for axis, (value, label) in AXIS_OF.items():
        own = numbers.where(F.col("axis") == axis).select(F.col("value").alias("_v"), F.col("label").alias("_l"), F.col("idx").alias(f"{axis}_idx"))
        planes = planes.join(own, F.col(value).eqNullSafe(F.col("_v")) & label_of(label).eqNullSafe(F.col("_l"))).drop("_v", "_l")
    key = ["time_idx", "freq_idx", "pol_idx"]
    # Two files of a run may find one place, by a time that an earlier run gave: the first has it.
    planes = planes.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy("time_key", "path", "plane")))
    there = cube.planes(spark, path).select(*key).withColumn("there", F.lit(True))
    marked = planes.where("place = 1").join(there, key, "left").withColumn("is_new", F.col("there").isNull())
    planned = _stored(marked.select("path", "size_bytes", "plane", *key, F.col("header")["NAXIS1"].cast("int").alias("n_l"), F.col("header")["NAXIS2"].cast("int").alias("n_m"), "header", "is_new", "group_key", "freq_hz", "stokes"), "planned")
    fresh = planned.where("is_new")
    filled = [r["run"] for r in seen if r["planes"]]
    to = reference_grid(cube.planes(spark, path).where(F.col("run") == filled[0]) if filled else fresh)
    tiles = _on_one_grid(fits.read_tiles(spark, fresh.select("path", "size_bytes", "plane", *key), source, tile), fresh, to, tile)
    store.by_time(tiles).write.partitionBy("time_idx").parquet(f"{path}/tiles/run={run}")
    new = numbers.where("is_new").groupBy("axis", "idx").agg(F.min("value").alias("value"), F.min("label").alias("label"))
    new.select("axis", "idx", "value", "label").coalesce(1).write.parquet(f"{path}/axes/run={run}")
    fresh.select([c.split()[0] for c in cube.PLANES.split(", ")]).write.parquet(f"{path}/planes/run={run}")
    fates = planned.groupBy("path").agg(F.when(F.bool_or("is_new"), "converted").otherwise("stored before").alias("fate"))
    outcome = F.coalesce("outcome", "fate", F.lit("copy of a plane"))
    rows.join(fates, "path", "left").select("path", "size_bytes", outcome.alias("outcome"), F.coalesce("problem", "beam_reason").alias("detail")).write.parquet(f"{path}/files/run={run}")
    cube.commit(spark, path, version, run, planes=fresh.count(), files=rows.count())
    return planned
