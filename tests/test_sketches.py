"""Quantile sketches of tiles, merged, against exact ranks."""

import numpy as np

from skycube.operators import sketches
from skycube.sources.schema import TILES


def test_merged_sketches_keep_the_rank_bound(spark):
    """Many tiles of very different sizes and levels; NaN and infinite pixels don't count; a tile without pixels has no sketch."""
    r = np.random.default_rng(7)
    rows, every = [], []
    for k in range(40):
        x = r.normal(k % 5, 1 + k % 3, size=int(r.choice([1, 30, 2500]))).astype(np.float32)
        x[r.random(len(x)) < 0.1] = r.choice([np.nan, np.inf, -np.inf])
        rows.append((k % 4, 0, 0, k, 0, 0, 0, 1, len(x), x.tolist()))
        every += [(k % 4, v) for v in x[np.isfinite(x)].tolist()]
    rows.append((9, 0, 0, 0, 0, 0, 0, 1, 2, [float("nan")] * 2))
    stored = sketches.tile_sketches(spark.createDataFrame(rows, TILES), k=200).persist()
    assert stored.where("time_idx = 9").count() == 0
    for keys, of in ((["time_idx"], lambda t: t), (["freq_idx"], lambda t: 0)):
        for q in (0.02, 0.5, 0.98):
            got = sketches.merged(stored, keys, 200).select(*keys, sketches.count().alias("n"), sketches.quantile(q).alias("x")).collect()
            for row in got:
                own = np.array([v for t, v in every if of(t) == row[0]])
                assert row.n == len(own) and (own < row.x).mean() - sketches.rank_bound(200) <= q <= (own <= row.x).mean() + sketches.rank_bound(200)
    assert sketches.rank_bound(400) < 0.05 and max(len(bytes(r.sketch)) for r in stored.collect()) < 12_000


def test_few_values_are_exact(spark):
    rows = [(0, 0, 0, k, 0, 0, 0, 1, 10, [float(10 * j + k) for j in range(10)]) for k in range(10)]
    found = sketches.limits(sketches.tile_sketches(spark.createDataFrame(rows, TILES)), ["time_idx"], 0.02, 0.98).first()
    assert (found.n, found.vmin, found.vmax) == (100, 1.0, 97.0)
