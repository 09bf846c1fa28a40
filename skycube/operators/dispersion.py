"""Dispersion correction of dynamic spectra (source_id, time_idx, mjd, freq_idx, freq_hz, flux)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.spectra import dispersion_delay


def shifts(channels: DataFrame, dms: list[float], step_s: float, ref_mhz: float) -> DataFrame:
    """(dm, freq_idx, shift): whole time steps by which a channel lags. One row a trial and channel."""
    trial = channels.select("freq_idx", "freq_hz", F.explode(F.array(*[F.lit(float(d)) for d in dms])).alias("dm"))
    return trial.select("dm", "freq_idx", F.rint(dispersion_delay(F.col("dm"), F.col("freq_hz") / 1e6, F.lit(ref_mhz)) / step_s).cast("long").alias("shift"))


def dedisperse(spectra: DataFrame, dms: list[float], step_s: float, ref_mhz: float) -> DataFrame:
    """out[t] = in[t + shift] for every trial: each value is moved to its new time, none is joined."""
    by = shifts(spectra.select("freq_idx", "freq_hz").distinct(), dms, step_s, ref_mhz)
    moved = spectra.select("source_id", "time_idx", "freq_idx", "flux").join(by, "freq_idx").withColumn("time_idx", F.col("time_idx") - F.col("shift"))
    return moved.select("dm", "source_id", "time_idx", "freq_idx", "flux")


def trimmed(spectra: DataFrame, keys: list[str]) -> DataFrame:
    """From the first to the last time with any value."""
    span = spectra.where(F.col("flux").isNotNull()).groupBy(*keys).agg(F.min("time_idx").alias("a"), F.max("time_idx").alias("b"))
    return spectra.join(span, keys).where(F.col("time_idx").between(F.col("a"), F.col("b"))).drop("a", "b")


def search(spectra: DataFrame, dms: list[float], step_s: float, ref_mhz: float, n_times: int) -> DataFrame:
    """SNR of the channel sum for each source and trial: (max - mean) / std over its times."""
    moved = dedisperse(spectra, dms, step_s, ref_mhz).where(F.col("time_idx").between(0, n_times - 1))
    series = moved.groupBy("source_id", "dm", "time_idx").agg(F.sum("flux").alias("flux"))
    std = F.stddev_pop("flux")
    return series.groupBy("source_id", "dm").agg(F.when(std > 0, (F.max("flux") - F.avg("flux")) / std).alias("snr"))


def best_trial(searched: DataFrame) -> DataFrame:
    """The trial with the highest SNR of each source; of two the smaller."""
    return searched.where("snr IS NOT NULL").groupBy("source_id").agg(F.max_by("dm", F.struct("snr", -F.col("dm"))).alias("dm"), F.max("snr").alias("snr"))
