"""Transient search and source catalogue on a cube."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.spectra import spectral_index
from ..operators import reduce as R
from ..operators import windows as W


def source_catalogue(cells: DataFrame, low: int, high: int, threshold: float, box: int, separation: int) -> DataFrame:
    """Peaks of each plane with the spectral index of their pixel between two channels."""
    keys = ["time_idx", "pol_idx", "l_idx", "m_idx"]
    flux = lambda k, c: F.max(F.when(F.col("freq_idx") == k, F.col(c)))
    pair = cells.where(F.col("freq_idx").isin(low, high)).groupBy(*keys).agg(flux(low, "flux").alias("s1"), flux(high, "flux").alias("s2"), flux(low, "freq_hz").alias("n1"), flux(high, "freq_hz").alias("n2"))
    index = pair.select(*keys, spectral_index(F.col("s1"), F.col("s2"), F.col("n1"), F.col("n2")).alias("alpha"))
    return W.find_peaks(cells, threshold, box, separation).join(index, keys, "left")


def transient_search(cells: DataFrame, threshold: float, box: int, separation: int, share: float) -> DataFrame:
    """Positions that peak in difference images, with variability over time and share of channels seen."""
    diff = W.reference_difference(cells).withColumnRenamed("diff", "flux")
    peaks = W.find_peaks(diff, threshold, box, separation)
    place = ["pol_idx", "l_idx", "m_idx"]
    hits = peaks.groupBy(*place).agg(F.count_distinct("freq_idx").alias("channels"), F.max("snr").alias("snr"))
    curves = cells.join(hits.select(*place), place, "left_semi")
    total = cells.agg(F.count_distinct("freq_idx").alias("n"))
    var = R.variability(curves, place).withColumnRenamed("n", "samples")
    return hits.join(var, place).join(F.broadcast(total), F.lit(True)).withColumn("share", F.col("channels") / F.col("n")).where(F.col("share") >= share).drop("n")
