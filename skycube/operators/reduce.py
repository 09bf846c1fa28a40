"""Aggregations over cubes. Every one combines on the map side; only groups are shuffled."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.schema import CubeError, finite

PIXEL = ("l_idx", "m_idx")


def time_average(cells: DataFrame, times: list[int] | None = None) -> DataFrame:
    rows = cells.where(F.col("time_idx").isin(times)) if times else cells
    return rows.groupBy("freq_idx", "pol_idx", *PIXEL).agg(F.avg("flux").alias("flux"))


def frequency_average(cells: DataFrame, low_mhz: float, high_mhz: float, check: bool = False) -> DataFrame:
    """Mean over the channels of a closed range. With ``check`` a range without channels is an error."""
    rows = cells.where(F.col("freq_hz").between(low_mhz * 1e6, high_mhz * 1e6))
    if check and not rows.take(1):
        raise CubeError("no channel in the range")
    return rows.groupBy("time_idx", "pol_idx", *PIXEL).agg(F.avg("flux").alias("flux"))


def finite_fraction(cells: DataFrame, n_l: int, n_m: int) -> DataFrame:
    """Finite pixels of each plane by the size of the grid, so absent rows count as missing."""
    return cells.groupBy("time_idx", "freq_idx", "pol_idx").agg((F.sum(finite(F.col("flux")).cast("long")) / F.lit(n_l * n_m)).alias("fraction"))


def first_valid(fractions: DataFrame, least: float = 0.1) -> DataFrame:
    """The first (time, channel) of each polarisation with enough finite pixels."""
    return fractions.where(F.col("fraction") >= least).groupBy("pol_idx").agg(F.min(F.struct("time_idx", "freq_idx")).alias("s")).select("pol_idx", "s.*")


def peak_flux_map(cells: DataFrame) -> DataFrame:
    return cells.groupBy("freq_idx", "pol_idx", *PIXEL).agg(F.max("flux").alias("peak"))


def plane_summary(cells: DataFrame) -> DataFrame:
    """Quality numbers of each channel."""
    x = F.col("flux")
    return cells.groupBy("freq_idx", "pol_idx").agg(
        F.min("flux").alias("low"), F.max("flux").alias("high"), F.avg("flux").alias("mean"), F.stddev_pop("flux").alias("std"),
        F.sum(x.isNull().cast("long")).alias("n_null"), F.sum((F.abs(x) == float("inf")).cast("long")).alias("n_inf"),
    )


def robust_limits(cells: DataFrame, exact: bool = True, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """Percentiles of finite pixels of each plane: exact (linear), or approximate for planes too large to sort."""
    rows = cells.where(finite(F.col("flux")))
    f = (lambda q: F.percentile("flux", q)) if exact else (lambda q: F.percentile_approx("flux", q, 10000))
    return rows.groupBy("time_idx", "freq_idx", "pol_idx").agg(f(low).alias("vmin"), f(high).alias("vmax"))


def tile_cuts(cells: DataFrame, tile: int, n: int, most: int = 50_000) -> DataFrame:
    """Cuts for display tiles from strided pixels; a flat tile gets a cut of width 1."""
    stride = max(1, int((tile * tile / most) ** 0.5))
    rows = cells.where(finite(F.col("flux")) & (F.col("l_idx") % stride == 0) & (F.col("m_idx") % stride == 0))
    rows = rows.groupBy("time_idx", "freq_idx", "pol_idx", F.expr(f"l_idx div {tile}").alias("tile_l"), F.expr(f"m_idx div {tile}").alias("tile_m"))
    out = rows.agg(F.percentile("flux", 0.02).alias("lo"), F.percentile("flux", 0.98).alias("hi"))
    return out.withColumn("hi", F.when(F.col("hi") <= F.col("lo"), F.col("lo") + 1).otherwise(F.col("hi")))


def populated(cells: DataFrame, beams: DataFrame) -> DataFrame:
    """Whether each plane has a finite positive beam, else any pixel."""
    keys = ["time_idx", "freq_idx", "pol_idx"]
    pixels = cells.groupBy(*keys).agg(F.max(F.col("flux").isNotNull()).alias("any_pixel"))
    beam = beams.groupBy(*keys).agg(F.max(F.coalesce(finite(F.col("bmaj")) & (F.col("bmaj") > 0), F.lit(False))).alias("beam"))
    return pixels.join(beam, keys, "left").select(*keys, (F.coalesce("beam", F.lit(False)) | F.col("any_pixel")).alias("populated"))


def integrated_flux(spectra: DataFrame, keys: list[str], low_hz: float, high_hz: float) -> DataFrame:
    """Trapezoid of flux over frequency; NULL when any flux is, one channel gives its value, none 0.

    ``spectra``: keys, freq_hz, flux. One window by the keys, so a source's channels meet once.
    """
    w = Window.partitionBy(*keys).orderBy("freq_hz")
    inside = F.col("freq_hz").between(low_hz, high_hz)
    rows = spectra.where(inside).withColumns({"__f0": F.lag("flux").over(w), "__n0": F.lag("freq_hz").over(w)})
    area = F.sum((F.col("flux") + F.col("__f0")) / 2 * (F.col("freq_hz") - F.col("__n0")))
    n, known = F.count(F.lit(1)), F.count("flux")
    sums = rows.groupBy(*keys).agg(F.when(known < n, F.lit(None)).when(n == 1, F.max("flux")).otherwise(area).alias("__area"), F.lit(True).alias("__has"))
    every = spectra.select(*keys).distinct().join(sums, keys, "left")
    return every.select(*keys, F.when(F.col("__has"), F.col("__area")).otherwise(F.lit(0.0)).alias("integrated"))


def variability(curves: DataFrame, keys: list[str], value: str = "flux") -> DataFrame:
    """std / mean (population); 0 where the mean is not above 0."""
    mean = F.avg(value)
    return curves.groupBy(*keys).agg(F.when(mean > 0, F.stddev_pop(value) / mean).otherwise(F.lit(0.0)).alias("variability"), F.count(value).alias("n"))


def confirmed_bands(snr: DataFrame, keys: list[str], least_snr: float = 5.0, share: float = 0.5) -> DataFrame:
    """Sources seen above ``least_snr`` in at least ``share`` of their channels."""
    return snr.groupBy(*keys).agg(F.avg((F.col("snr") > least_snr).cast("int")).alias("share")).where(F.col("share") >= share)


def fold(curves: DataFrame, keys: list[str], period_s: float, bins: int) -> DataFrame:
    """Mean flux of each phase bin; an empty bin is 0. ``curves``: keys, mjd, flux."""
    seconds = F.col("mjd") * 86400
    phase = (seconds - F.floor(seconds / period_s) * period_s) / period_s
    found = curves.withColumn("bin", F.least(F.floor(phase * bins), F.lit(bins - 1)).cast("long")).groupBy(*keys, "bin").agg(F.avg("flux").alias("flux"))
    every = curves.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(0), F.lit(bins - 1)).cast("array<long>")).alias("bin"))
    return every.join(found, [*keys, "bin"], "left").select(*keys, "bin", F.coalesce("flux", F.lit(0.0)).alias("flux"))


def patch_statistic(patches: DataFrame, keys: list[str], statistic: str) -> DataFrame:
    """``std`` (population), ``max``, ``min``, ``mean`` or ``mad`` of the finite pixels of each patch."""
    rows = patches.where(finite(F.col("flux")))
    if statistic == "mad":
        # Exact medians of one patch each; a patch has some hundred pixels.
        rows = rows.join(rows.groupBy(*keys).agg(F.median("flux").alias("middle")), keys).withColumn("gap", F.abs(F.col("flux") - F.col("middle")))
        return rows.groupBy(*keys).agg(F.median("gap").alias("value"))
    f = {"std": F.stddev_pop, "max": F.max, "min": F.min, "mean": F.avg}[statistic]
    return rows.groupBy(*keys).agg(f("flux").alias("value"))


def box_std(cells: DataFrame, half: float) -> DataFrame:
    """Population std of each plane in the box |l|, |m| <= half about the zenith."""
    rows = cells.where((F.abs(F.col("l")) <= half) & (F.abs(F.col("m")) <= half))
    return rows.groupBy("time_idx", "freq_idx", "pol_idx").agg(F.stddev_pop("flux").alias("std"))
