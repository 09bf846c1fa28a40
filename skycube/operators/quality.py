"""Nightly quality: runs, coverage, flux checks, position shifts, candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RUN_PATH = r"([0-9]{2}h)/([0-9]{4}-[0-9]{2}-[0-9]{2})/(Run_[0-9]{8}_[0-9]{6})(?:/([0-9]+MHz))?(?:/(.*))?$"


def run_tree(paths: DataFrame) -> DataFrame:
    """(lst_hour, obs_date, run, subband, rest) of each path of a run tree; other paths go."""
    part = lambda k: F.nullif(F.regexp_extract("path", RUN_PATH, k), F.lit(""))
    return paths.select(part(1).alias("lst_hour"), part(2).alias("obs_date"), part(3).alias("run"), part(4).alias("subband"), part(5).alias("rest")).where("run IS NOT NULL")


def newest_runs(runs: DataFrame, qualified_only: bool = True) -> DataFrame:
    """The run with the latest stamp of each (hour, day), and how many there are."""
    rows = runs.where("qualified") if qualified_only else runs
    return rows.groupBy("lst_hour", "obs_date").agg(F.max("run").alias("latest_run"), F.count_distinct("run").alias("n_runs"), F.max_by("n_subbands", F.struct("run", "n_subbands")).alias("n_subbands"))


def day_coverage(coverage: DataFrame) -> DataFrame:
    """Per day: hours, hour list, subbands, hours with several runs."""
    return coverage.groupBy("obs_date").agg(
        F.count_distinct("lst_hour").alias("hours"), F.array_join(F.transform(F.array_sort(F.collect_set("lst_hour")), lambda h: h.cast("string")), ",").alias("hour_list"),
        F.min("n_subbands").alias("least"), F.max("n_subbands").alias("most"), F.median("n_subbands").alias("median"), F.sum((F.col("n_runs") > 1).cast("long")).alias("repeated"),
    )


def hour_coverage(coverage: DataFrame) -> DataFrame:
    return coverage.groupBy("lst_hour").agg(F.count_distinct("obs_date").alias("days"), F.min("obs_date").alias("first"), F.max("obs_date").alias("last"), F.median("n_subbands").alias("median"))


def subband_coverage(coverage: DataFrame) -> DataFrame:
    """Per subband after exploding the comma list ``subbands``."""
    rows = coverage.select("obs_date", "lst_hour", F.explode(F.split("subbands", ",")).alias("subband")).where("subband <> ''")
    return rows.groupBy("subband").agg(F.count(F.lit(1)).alias("pairs"), F.count_distinct("obs_date").alias("days"), F.count_distinct("lst_hour").alias("hours"))


def coverage_matrix(coverage: DataFrame) -> DataFrame:
    """Day by 24 hours, the most subbands. The pivot's values are given, so no job looks for them."""
    return coverage.groupBy("obs_date").pivot("lst_hour", list(range(24))).agg(F.max("n_subbands")).select("obs_date", *[F.col(str(h)).alias(f"h{h:02d}") for h in range(24)])


def flux_ratio(checks: DataFrame) -> DataFrame:
    """Per source, hour and frequency the mean of measured over model flux; a zero model has none."""
    ratio = F.when(F.col("model_flux") != 0, F.col("imfit_flux") / F.col("model_flux"))
    return checks.groupBy("source", "hour", "freq").agg(F.avg(ratio).alias("ratio"))


def shift_grid(checks: DataFrame) -> DataFrame:
    return checks.groupBy("hour", "freq").agg(F.avg("shift").alias("shift"))


def stokes_days(files: DataFrame) -> DataFrame:
    """Per day whether I and V exist."""
    return files.groupBy(F.substring("time_key", 1, 8).alias("day")).agg(F.bool_or(F.col("stokes") == 1).alias("has_i"), F.bool_or(F.col("stokes") == 4).alias("has_v"))


def default_day(days: DataFrame, has_store: str = "has_store") -> DataFrame:
    """The earliest day with a store, else the earliest day."""
    return days.agg(F.min(F.struct((~F.col(has_store)).cast("int").alias("tier"), "day")).alias("s")).select("s.day")


def filter_candidates(candidates: DataFrame, text: dict[str, str] | None = None, ranges: dict[str, tuple[float | None, float | None]] | None = None, dates: tuple[str | None, str | None] = (None, None)) -> DataFrame:
    """Substrings in any case, numeric ranges (no number: out), dates by their first ten characters."""
    for column, part in (text or {}).items():
        candidates = candidates.where(F.contains(F.lower(column), F.lit(part.lower())))
    for column, (low, high) in (ranges or {}).items():
        x = F.col(column).try_cast("double")
        candidates = candidates.where(x.isNotNull() & (x >= low if low is not None else F.lit(True)) & (x <= high if high is not None else F.lit(True)))
    day = F.substring("date", 1, 10)
    for bound, test in zip(dates, (lambda b: day >= b, lambda b: day <= b)):
        if bound is not None:
            candidates = candidates.where(test(bound))
    return candidates


def peak_detections(detections: DataFrame) -> DataFrame:
    """Per source the detection with the highest SNR, and the band to overlay.

    The band is its own if it is a number; else that of the best numeric one of the same day and
    hour. ``detections``: source_id, day, hour, band (NULL for a full band), snr, detection_id.
    """
    rank = F.struct("snr", (-F.col("detection_id")).alias("m"))
    best = detections.groupBy("source_id").agg(F.max_by(F.struct("detection_id", "day", "hour", "band", "snr"), rank).alias("p"))
    same = detections.where("band IS NOT NULL").groupBy("source_id", "day", "hour").agg(F.max_by("band", rank).alias("other"))
    joined = best.select("source_id", "p.*").join(same, ["source_id", "day", "hour"], "left")
    return joined.withColumn("overlay", F.coalesce("band", "other")).drop("other")


def matching_stokes_i(v: DataFrame, i: DataFrame) -> DataFrame:
    """Beams of matching I images for V images, by subband and stamp; a V without one is an error."""
    from ..sources.schema import CubeError

    keys = ["mhz", "time_key"]
    if missing := v.join(i, keys, "left_anti").take(1):
        raise CubeError(f"no Stokes I image for {missing[0]['path']}")
    return v.join(i.select(*keys, "bmaj"), keys)


def to_slices(detections: DataFrame, times: DataFrame, channels: DataFrame) -> DataFrame:
    """Each detection's store slice: same day and hour and nearest LST, else same day, else nearest to noon.

    ``detections``: detection_id, day (date), lst, mhz; ``times``: time_idx, ts, lst; ``channels``:
    freq_idx, mhz. Without a band the middle channel is taken. Detections meet the times of their
    day alone; the time nearest to noon is found once for each day, the channel once for each band.
    """
    seconds = lambda c: F.unix_micros(c.cast("timestamp")) / 1e6
    t = times.select("time_idx", F.to_date("ts").alias("day"), seconds(F.col("ts")).alias("s"), F.col("lst").alias("t_lst"))
    apart = F.abs(F.col("lst") - F.col("t_lst"))
    apart = F.least(apart, 24 - apart)
    tier = F.when(F.pmod(F.rint("lst"), F.lit(24)) == F.pmod(F.rint("t_lst"), F.lit(24)), 0).otherwise(1)
    same = detections.join(t.drop("s"), "day").groupBy("detection_id").agg(F.min(F.struct(tier.alias("tier"), apart.alias("d"), "time_idx")).alias("same"))
    # Days and times in one order, of which there is a row each: the times before and after each noon.
    noon = detections.select("day").distinct().select((F.unix_seconds(F.col("day").cast("timestamp")).cast("double") + 43200).alias("s"), F.col("day").alias("noon_of"))
    at = t.groupBy("s").agg(F.min("time_idx").alias("time_idx"))
    rows = at.select("s", F.lit(None).cast("date").alias("noon_of"), F.struct("s", "time_idx").alias("x")).unionByName(noon.select("s", "noon_of", F.lit(None).cast("struct<s:double,time_idx:bigint>").alias("x")))
    w = Window.orderBy("s", F.col("x").isNull())
    rows = rows.withColumns({"back": F.last("x", True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "ahead": F.first("x", True).over(w.rowsBetween(0, Window.unboundedFollowing))}).where("noon_of IS NOT NULL")
    off = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(f"{c}.s") - F.col("s")).alias("d"), F.col(f"{c}.time_idx").alias("time_idx")))
    nearest = rows.select(F.col("noon_of").alias("day"), F.least(off("back"), off("ahead"))["time_idx"].alias("near_noon"))
    found = detections.join(same, "detection_id", "left").join(nearest, "day", "left")
    n = channels.count()
    bands = detections.where("mhz IS NOT NULL").select("mhz").distinct().join(channels.select("freq_idx", F.col("mhz").alias("c_mhz")), F.lit(True))
    bands = bands.groupBy("mhz").agg(F.min(F.struct(F.abs(F.col("mhz") - F.col("c_mhz")).alias("d"), "freq_idx"))["freq_idx"].alias("freq_idx"))
    return found.join(bands, "mhz", "left").select("detection_id", F.coalesce("same.time_idx", "near_noon").alias("time_idx"), F.coalesce("same.tier", F.lit(2)).alias("tier"), F.when(F.col("mhz").isNull(), n // 2).otherwise(F.col("freq_idx")).alias("freq_idx"))
