"""Quantiles that merge: KLL sketches of each tile, stored once, put together for any plane, channel or cube.

A sketch is some kilobytes whatever its number of pixels, and sketches merge by an aggregate that
combines on the map side; so limits of a new grouping cost a read of sketches, not of pixels. A
sketch of n values of size k errs in rank by about ``1.66 / k`` (99 % of the time); up to k values it holds them all
and is exact.

Defined cases: NULL, NaN and infinite pixels don't count. A tile without any has no sketch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TILE = ("time_idx", "freq_idx", "pol_idx", "tile_l", "tile_m")
K = 400


def tile_sketches(tiles: DataFrame, k: int = K) -> DataFrame:
    """(plane, tile_l, tile_m, sketch) of stored tiles. Pixels go from the array into the sketch where the tile is read."""
    x = tiles.select(*TILE, F.explode(F.col("data").cast("array<double>")).alias("x")).where(~F.isnan("x") & (F.abs("x") < float("inf")))
    return x.groupBy(*TILE).agg(F.kll_sketch_agg_double("x", k).alias("sketch"))


def merged(sketches: DataFrame, keys: list[str], k: int = K) -> DataFrame:
    """One sketch of each group."""
    return sketches.groupBy(*keys).agg(F.kll_merge_agg_double("sketch", k).alias("sketch"))


def quantile(q: float, sketch: Column | None = None) -> Column:
    """The value at least a share q of all lie at or below."""
    return F.kll_sketch_get_quantile_double(F.col("sketch") if sketch is None else sketch, F.lit(float(q)))


def count(sketch: Column | None = None) -> Column:
    return F.kll_sketch_get_n_double(F.col("sketch") if sketch is None else sketch)


def rank_bound(k: int = K) -> float:
    """How far off a quantile's rank may be, as a share of all: twice the usual bound of a sketch's own."""
    return 2 * 2.296 / k**0.9021


def limits(sketches: DataFrame, keys: list[str], low: float = 0.02, high: float = 0.98, k: int = K) -> DataFrame:
    """(keys, n, vmin, vmax): display limits of any grouping of stored sketches."""
    return merged(sketches, keys, k).select(*keys, count().alias("n"), quantile(low).alias("vmin"), quantile(high).alias("vmax"))
