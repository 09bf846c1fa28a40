"""Neighbourhoods in time, frequency and on the sky."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import SITE_LAT, lst_hours, unproject
from ..sources.schema import finite

PLANE = ("time_idx", "freq_idx", "pol_idx")


def difference(cells: DataFrame, axis: str) -> DataFrame:
    """Flux less that of the previous index of ``time_idx`` or ``freq_idx``, at the same pixel."""
    rest = [c for c in PLANE if c != axis] + ["l_idx", "m_idx"]
    w = Window.partitionBy(*rest).orderBy(axis)
    return cells.select(*PLANE, "l_idx", "m_idx", (F.col("flux") - F.lag("flux").over(w)).alias("diff"))


def reference_difference(cells: DataFrame, first: int | None = None) -> DataFrame:
    """Flux less the mean over all times (or the first ``first`` ones) at the same pixel and channel."""
    keys = ["freq_idx", "pol_idx", "l_idx", "m_idx"]
    used = cells if first is None else cells.where(F.col("time_idx") < first)
    mean = used.groupBy(*keys).agg(F.avg("flux").alias("mean"))
    return cells.join(mean, keys).select(*PLANE, "l_idx", "m_idx", (F.col("flux") - F.col("mean")).alias("diff"))


def rms_map(cells: DataFrame, box: int = 50, mode: str = "documented") -> DataFrame:
    """Local noise in a box of pixels about each pixel, over valid in-bounds pixels.

    Sums of values, squares and counts run along l, then along m. Spark sums each frame anew, so a
    pixel costs 2 box steps: for sparse cells or small boxes. ``halo.noise_tiles`` does whole tiles at a
    cost that does not depend on the box.
    ``documented`` is the population std. ``reference`` scales both means by box**2 before
    subtracting, as the reference does, which gives 0 wherever the mean is not small.
    """
    lo, hi = -(box // 2), box - box // 2 - 1
    along_l = Window.partitionBy(*PLANE, "m_idx").orderBy("l_idx").rangeBetween(lo, hi)
    along_m = Window.partitionBy(*PLANE, "l_idx").orderBy("m_idx").rangeBetween(lo, hi)
    x = F.when(finite(F.col("flux")), F.col("flux"))
    rows = cells.select(*PLANE, "l_idx", "m_idx", "flux", x.alias("x"))
    rows = rows.withColumns({"s": F.sum("x").over(along_l), "q": F.sum(F.col("x") * F.col("x")).over(along_l), "n": F.count("x").over(along_l)})
    rows = rows.withColumns({k: F.sum(k).over(along_m) for k in "sqn"})
    mean, square = F.col("s") / F.col("n"), F.col("q") / F.col("n")
    if mode == "documented":
        spread = square - mean * mean
    else:
        size = F.lit(float(box * box))
        spread = size * square - size * size * mean * mean
    return rows.select(*PLANE, "l_idx", "m_idx", "flux", F.when(F.col("flux").isNotNull(), F.sqrt(F.greatest(spread, F.lit(0.0)))).alias("rms"))


def snr_map(cells: DataFrame, box: int = 50, mode: str = "documented") -> DataFrame:
    """Signal over local noise; NULL where that is not finite."""
    ratio = F.when(F.col("rms") > 0, F.col("flux") / F.col("rms"))
    return rms_map(cells, box, mode).withColumn("snr", F.when(finite(ratio), ratio))


def find_peaks(cells: DataFrame, threshold: float = 5.0, box: int = 50, separation: int = 5, mode: str = "documented") -> DataFrame:
    """Pixels that are the maximum of their (2 sep + 1)**2 box and at least ``threshold`` in SNR."""
    along_l = Window.partitionBy(*PLANE, "m_idx").orderBy("l_idx").rangeBetween(-separation, separation)
    along_m = Window.partitionBy(*PLANE, "l_idx").orderBy("m_idx").rangeBetween(-separation, separation)
    rows = snr_map(cells, box, mode).withColumn("top", F.max("flux").over(along_l)).withColumn("top", F.max("top").over(along_m))
    return rows.where(finite(F.col("flux")) & (F.col("flux") == F.col("top")) & (F.col("snr") >= threshold)).select(*PLANE, "l_idx", "m_idx", "flux", "rms", "snr")


def located(peaks: DataFrame, times: DataFrame, l: Column, m: Column) -> DataFrame:  # noqa: E741
    """Peaks with their position on the sky and their place in their plane by SNR, from 1; of equal ones the earlier pixel.

    ``times``: time_idx, mjd; ``l`` and ``m``: direction cosines of a peak's pixel. A zenith image is centred
    on the local sidereal time and the site's latitude. Positions beyond the horizon are NULL.
    """
    rows = peaks.join(times, "time_idx")
    ra, dec = unproject(l, m, lst_hours(F.col("mjd")) * 15, F.lit(SITE_LAT))
    by = Window.partitionBy(*PLANE).orderBy(F.desc("snr"), "l_idx", "m_idx")
    return rows.select(*peaks.columns, ra.alias("ra_deg"), dec.alias("dec_deg"), F.row_number().over(by).alias("place"))


def smooth(cells: DataFrame, sigma: float = 2.0, truncate: float = 4.0) -> DataFrame:
    """Matched filter: separable Gaussian over valid pixels, weights renormalised at gaps and edges.

    Each pixel is dealt to the places within reach along one axis and summed there.
    """
    from math import exp

    reach = int(truncate * sigma + 0.5)
    weight = [exp(-0.5 * (k / sigma) ** 2) for k in range(-reach, reach + 1)]
    kernel = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(w).alias("w")) for k, w in zip(range(-reach, reach + 1), weight)]))
    rows = cells.where(F.col("flux").isNotNull()).select(*PLANE, "l_idx", "m_idx", F.col("flux").alias("v"), F.lit(1.0).alias("u"))
    for axis, other in (("l_idx", "m_idx"), ("m_idx", "l_idx")):
        moved = rows.select(*PLANE, other, axis, "v", "u", kernel.alias("x")).select(*PLANE, other, (F.col(axis) + F.col("x.k")).alias(axis), (F.col("v") * F.col("x.w")).alias("v"), (F.col("u") * F.col("x.w")).alias("u"))
        rows = moved.groupBy(*PLANE, "l_idx", "m_idx").agg(F.sum("v").alias("v"), F.sum("u").alias("u"))
    return cells.select(*PLANE, "l_idx", "m_idx").join(rows, [*PLANE, "l_idx", "m_idx"], "left").select(*PLANE, "l_idx", "m_idx", (F.col("v") / F.col("u")).alias("flux"))


def axis_spacing(axis: DataFrame, idx: str, value: str, tolerance: float = 1e-6) -> DataFrame:
    """Steps of an axis: smallest, largest, whether regular. An axis is a handful of rows."""
    w = Window.partitionBy(F.lit(0)).orderBy(idx)
    steps = axis.select((F.col(value) - F.lag(value).over(w)).alias("step")).where("step IS NOT NULL")
    return steps.agg(F.min("step").alias("least"), F.max("step").alias("most"), F.count("step").alias("n")).withColumn("regular", F.col("most") - F.col("least") <= tolerance * F.abs(F.col("most")))
