"""File inventories: keys, de-duplication, merging, quality, audits, resuming."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names as NM

BIN_HZ = 23_000.0
TOLERANCE_DAYS, TOLERANCE_SHARE = 1e-9, 1e-12


def described(files: DataFrame) -> DataFrame:
    """Adds time_key, mhz, stokes, freq_hz, freq_bin, mjd, beam_reason to an inventory (path, name, header)."""
    h = F.col("header")
    rows = files.withColumns({
        "time_key": NM.time_key(F.col("name"), F.col("path"), h["DATE-OBS"]),
        "mhz": NM.subband_mhz(F.col("name")),
        "stokes": NM.stokes(F.col("name")),
        "freq_hz": NM.frequency(h, F.col("name")),
        "beam_reason": NM.beam_reason(h["BMAJ"], h["BMIN"]),
        "header_time": F.try_to_timestamp(h["DATE-OBS"]),
    })
    return rows.withColumns({"freq_bin": F.bround(F.col("freq_hz") / BIN_HZ).cast("long"), "mjd": NM.mjd(NM.key_timestamp(F.col("time_key")))})


def first_of(files: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key; rows with a NULL key are all kept.

    One aggregate: the running minimum is the whole row, so it combines on the map side, a key
    with very many files is never sorted in one task, and the input is read once.
    """
    loose = F.when(reduce(Column.__or__, [F.col(k).isNull() for k in keys]), F.monotonically_increasing_id())
    first = F.min_by(F.struct(*files.columns), F.struct(*order)).alias("x")
    return files.groupBy(*[F.col(k).alias(f"_{k}") for k in keys], loose.alias("_loose")).agg(first).select("x.*")


def deduplicated(files: DataFrame) -> DataFrame:
    """First path of each (time_key, frequency bin, Stokes); files without a frequency are all kept."""
    return first_of(files, ["time_key", "freq_bin", "stokes"], ["path"])


def resolved(files: DataFrame, choose, schema: str) -> DataFrame:
    """Duplicates settled by ``choose(time_key, freq_hz, paths) -> path``; an unknown answer is an error.

    Only keys with several files go through Python.
    """
    import pandas as pd

    keys = ["time_key", "freq_bin", "stokes"]
    many = files.groupBy(*keys).count().where("count > 1").drop("count")

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("path")
        path = choose(pdf["time_key"].iloc[0], pdf["freq_hz"].iloc[0], pdf["path"].tolist())
        if path not in set(pdf["path"]):
            raise ValueError(f"the resolver chose an unknown path: {path}")
        return pdf[pdf["path"] == path].head(1)

    return files.join(many, keys, "left_anti").unionByName(files.join(many, keys, "left_semi").select(files.columns).groupBy(*keys).applyInPandas(pick, schema))


def merged_keys(keys: DataFrame, tolerance_s: float) -> DataFrame:
    """(time_key, group_key): keys whose sorted times leave gaps of at most the tolerance are one group, named by the earliest.

    Works on distinct keys, one for each observation. Keys are put in order within their day;
    a table of one row a day then tells how each day's first group hangs on to the days before.
    Keys without a time are groups of their own.
    """
    rows = keys.select("time_key", "mjd").distinct().withColumn("day", F.floor("mjd"))
    far = lambda gap: gap * 86400 > tolerance_s + 1e-6
    w, key = Window.partitionBy("day").orderBy("mjd", "time_key"), F.struct("mjd", "time_key")
    rows = rows.withColumn("starts", F.coalesce(far(F.col("mjd") - F.lag("mjd").over(w)), F.lit(False)))
    days = rows.groupBy("day").agg(F.min("mjd").alias("first"), F.max("mjd").alias("last"), F.min_by("time_key", key).alias("first_key"), F.max_by("time_key", F.when(F.col("starts"), key)).alias("inner"))
    d = Window.orderBy("day")
    days = days.withColumn("opens", F.coalesce(far(F.col("first") - F.lag("last").over(d)), F.lit(True)))
    days = days.withColumn("begins", F.when(F.col("opens"), F.col("first_key")))
    days = days.withColumn("carried", F.last(F.coalesce("inner", "begins"), True).over(d.rowsBetween(Window.unboundedPreceding, -1)))
    inside = F.last(F.when(F.col("starts"), F.col("time_key")), True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    named = rows.withColumn("inside", inside).join(days.select("day", F.coalesce("begins", "carried").alias("at_dawn")), "day", "left")
    return named.select("time_key", F.when(F.col("mjd").isNull(), F.col("time_key")).otherwise(F.coalesce("inside", "at_dawn")).alias("group_key"))


def consistent_beams(files: DataFrame) -> DataFrame:
    return files.where("beam_reason IS NULL")


def not_stored(files: DataFrame, stored: DataFrame) -> DataFrame:
    """Files whose time is not stored yet: not the same key, and no stored MJD within the tolerance.

    The tolerance is far below a bucket of a microday; a stored time is put in its own and both
    neighbouring buckets, so one equality join finds every pair that could be close.
    """
    left = files.join(stored.select("time_key").distinct(), "time_key", "left_anti") if "time_key" in stored.columns else files
    bucket = lambda c: F.floor(c / 1e-6).cast("long")
    near = stored.select(F.col("mjd").alias("_mjd"), F.explode(F.array(*[bucket(F.col("mjd")) + k for k in (-1, 0, 1)])).alias("_bucket"))
    close = F.abs(F.col("mjd") - F.col("_mjd")) <= TOLERANCE_DAYS + TOLERANCE_SHARE * F.abs(F.col("mjd"))
    return left.withColumn("_b", bucket(F.col("mjd"))).join(near, (F.col("_b") == F.col("_bucket")) & close, "left_anti").drop("_b")


def beam_donors(beams: DataFrame) -> DataFrame:
    """For each missing beam the valid one of the same subband nearest in time, of two the earlier.

    ``beams``: mhz, mjd, bmaj. As-of windows within (subband, day), one each way, so each grows with the rows;
    beams of one time all count, the widest of those before and the narrowest of those after. A table of one row
    for each subband and day carries the last valid beam before a day and the first one after it.
    """
    valid = F.when(F.col("bmaj") > 0, F.struct("mjd", "bmaj"))
    rows = beams.withColumn("_day", F.floor("mjd"))
    begin, here = Window.unboundedPreceding, Window.currentRow
    up, down = (Window.partitionBy("mhz", "_day").orderBy(o).rangeBetween(begin, here) for o in (F.col("mjd").asc(), F.col("mjd").desc()))
    before, after = (Window.partitionBy("mhz").orderBy(o).rowsBetween(begin, -1) for o in (F.col("_day").asc(), F.col("_day").desc()))
    days = rows.groupBy("mhz", "_day").agg(F.min(valid).alias("first"), F.max(valid).alias("last"))
    days = days.select(F.col("mhz").alias("_mhz"), F.col("_day").alias("_of"), F.last("last", True).over(before).alias("before"), F.last("first", True).over(after).alias("after"))
    rows = rows.withColumns({"back": F.max(valid).over(up), "ahead": F.min(valid).over(down)})
    rows = rows.join(days, F.col("mhz").eqNullSafe(F.col("_mhz")) & F.col("_day").eqNullSafe(F.col("_of")), "left")
    back, ahead = F.coalesce("back", "before"), F.coalesce("ahead", "after")
    nearer = F.when(back.isNull(), ahead).when(ahead.isNull(), back).when(F.col("mjd") - back["mjd"] <= ahead["mjd"] - F.col("mjd"), back).otherwise(ahead)
    return rows.withColumn("donor", nearer).select(*beams.columns, F.col("donor.mjd").alias("donor_mjd"), F.col("donor.bmaj").alias("donor_bmaj"))


def summary(files: DataFrame) -> DataFrame:
    """Numbers of an ingest plan."""
    return files.agg(F.count(F.lit(1)).alias("files"), F.count_distinct("time_key").alias("times"), F.count_distinct("freq_bin").alias("bins"), F.count_distinct("stokes").alias("stokes"))


def store_size(files: DataFrame, naxis1: Column, naxis2: Column) -> DataFrame:
    """Files times the largest shape times 4 bytes."""
    shape = F.struct((naxis1 * naxis2).alias("area"), naxis1.alias("n_l"), naxis2.alias("n_m"))
    return files.agg((F.count(F.lit(1)) * F.max(shape)["area"] * 4).alias("bytes"))


def header_audit(files: DataFrame, keywords: list[str]) -> DataFrame:
    """(time_key, keyword): distinct values of each keyword in a group, whether they agree, up to 8 of them."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("keyword"), F.col("header")[k].alias("value")) for k in keywords]))
    seen = files.select("time_key", pairs.alias("x")).select("time_key", "x.*").distinct()
    return seen.groupBy("time_key", "keyword").agg(F.count("value").alias("n"), F.slice(F.array_sort(F.collect_set("value")), 1, 8).alias("values")).withColumn("consistent", F.col("n") <= 1)


def time_audit(files: DataFrame) -> DataFrame:
    """(time_key): spread of header times in s, and the largest gap between name and header."""
    t = NM.mjd(F.col("header_time"))
    return files.groupBy("time_key").agg(
        F.count(F.lit(1)).alias("files"), ((F.max(t) - F.min(t)) * 86400).alias("spread_s"), (F.max(F.abs(t - F.col("mjd"))) * 86400).alias("name_gap_s")
    )


def single_time_groups(files: DataFrame) -> DataFrame:
    """Files of groups whose headers give one time; groups with several are dropped whole."""
    bad = files.groupBy("time_key").agg(F.count_distinct("header_time").alias("n")).where("n > 1")
    return files.join(bad, "time_key", "left_anti")


def with_reference(files: DataFrame, mhz: float) -> DataFrame:
    """Files of time groups that hold the reference subband."""
    return files.join(files.where(F.col("mhz") == mhz).select("time_key").distinct(), "time_key", "left_semi")


def on_global_grid(planes: DataFrame, channels: DataFrame) -> DataFrame:
    """Every (time, channel) of the union grid; missing planes are NULL. The grid is the result's own size."""
    return planes.select("time_key").distinct().join(channels, F.lit(True)).join(planes, ["time_key", "freq_bin"], "left")


def snapped(planes: DataFrame, channels: DataFrame, bin_hz: float = BIN_HZ) -> DataFrame:
    """Planes moved to the nearest expected channel within half a bin, the first of each channel.

    ``channels``: freq_idx, expected_hz. A channel stands in its bin and both neighbours, so an
    equality join meets every pair in reach.
    """
    own = F.floor(F.col("expected_hz") / bin_hz).cast("long")
    reach = channels.select("freq_idx", "expected_hz", F.explode(F.array(own - 1, own, own + 1)).alias("_bin"))
    near = planes.withColumn("_bin", F.floor(F.col("freq_hz") / bin_hz).cast("long")).join(reach, "_bin").where(F.abs(F.col("freq_hz") - F.col("expected_hz")) <= bin_hz / 2)
    return near.groupBy("time_key", "stokes", "freq_idx").agg(F.min_by("path", F.struct(F.abs(F.col("freq_hz") - F.col("expected_hz")), "path")).alias("path"))


def ingest_plan(files: DataFrame, stored: DataFrame, tolerance_s: float) -> DataFrame:
    """Discovered files that a run would convert: de-duplicated, merged in time, valid, not stored.

    The inventory is read twice: for its time keys, and for its files.
    """
    rows = described(files)
    groups = merged_keys(rows.select("time_key", "mjd"), tolerance_s)
    rows = deduplicated(rows).join(groups, "time_key", "left").withColumn("group_key", F.coalesce("group_key", "time_key"))
    rows = first_of(rows, ["group_key", "mhz", "stokes"], ["time_key", "path"])
    return not_stored(consistent_beams(rows).where("size_bytes > 0"), stored)


def shared_times(files: DataFrame, warn_s: float = 1.0) -> DataFrame:
    """One MJD for each time group: that of the lowest channel; the spread, and whether it is worth a warning."""
    t = NM.mjd(F.col("header_time"))
    out = files.groupBy("time_key").agg(F.min_by(t, F.struct("freq_hz", "path")).alias("mjd"), ((F.max(t) - F.min(t)) * 86400).alias("spread_s"))
    return out.withColumn("warn", F.col("spread_s") > warn_s)


def key_agreement(files: DataFrame) -> DataFrame:
    """Time keys that only names or only headers give."""
    header = F.date_format("header_time", "yyyyMMdd_HHmmss")
    rows = files.select(F.explode(F.array(F.struct(F.col("time_key").alias("key"), F.lit(1).alias("name"), F.lit(0).alias("header")), F.struct(header.alias("key"), F.lit(0).alias("name"), F.lit(1).alias("header")))).alias("x")).select("x.*")
    seen = rows.where("key IS NOT NULL").groupBy("key").agg(F.max("name").alias("name"), F.max("header").alias("header"))
    return seen.where("name + header = 1").select("key", F.when(F.col("name") == 1, "name").otherwise("header").alias("only_in"))


def mapped_times(stored: DataFrame, groups: DataFrame, tolerance_s: float = 6.0) -> DataFrame:
    """(time_idx, group_key): which file group each stored time is.

    ``stored``: time_idx, time_key, mjd; ``groups``: group_key, mjd. A stored time takes the
    group of its key. If none has one, both sides are equally many, and put in order all lie
    within the tolerance of each other, they are taken in order. Else it takes the nearest group
    within the tolerance, or none. Groups stand in their bucket of one tolerance and both
    neighbours, so an equality join meets every pair in reach. Both tables have a row for each
    time step; the ranks that the second rule compares need them in one order.
    """
    exact = stored.join(groups.select("group_key"), F.col("time_key") == F.col("group_key"), "left").select("time_idx", "mjd", "group_key")
    bucket = lambda c: F.floor(c * 86400 / tolerance_s).cast("long")
    near = groups.select(F.col("group_key").alias("g"), F.col("mjd").alias("m"), F.explode(F.array(*[bucket(F.col("mjd")) + k for k in (-1, 0, 1)])).alias("b"))
    gap = F.abs(F.col("mjd") - F.col("m")) * 86400
    within = gap <= tolerance_s + 1e-6
    close = exact.where("group_key IS NULL").join(near, bucket(F.col("mjd")) == F.col("b")).where(within).groupBy("time_idx").agg(F.min_by("g", F.struct(gap, "g")).alias("g"))
    rank = lambda *by: F.row_number().over(Window.orderBy(*by))
    pairs = exact.withColumn("k", rank("time_idx")).join(groups.select(F.col("group_key").alias("in_order"), F.col("mjd").alias("m"), rank("mjd", "group_key").alias("k")), "k", "full")
    aligned = pairs.agg(F.coalesce(F.bool_and(F.col("time_idx").isNotNull() & F.col("in_order").isNotNull() & F.col("group_key").isNull() & F.coalesce(within, F.lit(False))), F.lit(False)).alias("all_aligned"))
    out = exact.join(close, "time_idx", "left").join(pairs.select("time_idx", "in_order"), "time_idx").join(F.broadcast(aligned), F.lit(True))
    return out.select("time_idx", F.coalesce("group_key", F.when(F.col("all_aligned"), F.col("in_order")), "g").alias("group_key"))


def patched_grid(headers: DataFrame, mapped: DataFrame, sources: DataFrame) -> DataFrame:
    """Grid headers whose CRVAL1 and CRVAL2 come from the source file of their time; those without one stay.

    ``headers``: time_idx, header; ``mapped``: time_idx, group_key; ``sources``: group_key, path,
    header. Of a group's files the first path with both values is the source.
    """
    crval = F.struct(*[F.col("header")[k].try_cast("double").alias(k.lower()) for k in ("CRVAL1", "CRVAL2")])
    first = sources.select("group_key", "path", crval.alias("c")).where("c.crval1 IS NOT NULL AND c.crval2 IS NOT NULL").groupBy("group_key").agg(F.min_by("c", "path").alias("c"))
    rows = headers.join(mapped, "time_idx", "left").join(first, "group_key", "left")
    new = F.map_from_arrays(F.array(F.lit("CRVAL1"), F.lit("CRVAL2")), F.array(F.col("c.crval1").cast("string"), F.col("c.crval2").cast("string")))
    kept = F.map_filter("header", lambda k, v: ~k.isin("CRVAL1", "CRVAL2"))
    return rows.select("time_idx", F.when(F.col("c").isNotNull(), F.map_concat(kept, new)).otherwise(F.col("header")).alias("header"), F.col("c").isNotNull().alias("patched"))


def in_order(files: DataFrame) -> DataFrame:
    """Files of each time step in channel order: (frequency, or 1e15 Hz without one, then name)."""
    at = F.struct(F.coalesce("freq_hz", F.lit(1e15)).alias("freq_hz"), "name", "path")
    return files.withColumn("place", F.row_number().over(Window.partitionBy("time_key").orderBy(at)) - 1)


def aligned_stokes(planes: DataFrame, stokes: list[int]) -> DataFrame:
    """Every (time_idx, freq_idx) with each wanted Stokes plane; an absent one is NULL."""
    every = planes.select("time_idx", "freq_idx").distinct().withColumn("stokes", F.explode(F.array(*[F.lit(s) for s in stokes])))
    return every.join(planes, ["time_idx", "freq_idx", "stokes"], "left")
