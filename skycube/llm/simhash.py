"""SimHash near-duplicates by the generalised pigeonhole principle (operator 10).

Every text gets a 64-bit fingerprint of its word shingles. Bits that agree or disagree together
over all fingerprints are grouped into partitions. If two fingerprints differ in at most tau
bits and the thresholds t_i of the partitions satisfy sum(t_i + 1) = tau + 1, then some
partition differs in at most t_i bits (t_i = -1 leaves a partition out). Dynamic programming
allocates the thresholds with the least estimated work: probes of each partition's ball and
candidates that agree by chance, both from counts over all fingerprints. Each distinct
fingerprint is indexed once for each partition in use and probes its ball; the join checks the
whole distance. A bucket of more than ``max_bucket`` fingerprints is not joined with itself:
its members meet at hubs instead, which costs the same for each member whatever the bucket's
size and finds the same components.

The pipeline's stage takes these links (``drop_near_texts``). To them come those that fingerprints of 64 bits
cannot tell (``near_copies``): texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or
more. Candidates share one of 32 bands of five minima (at similarity 0.8 a pair is missed
with probability (1 - 0.8^5)^32 = 3e-6, less above); the exact similarity of the sets decides. Members of
a bucket meet its hub, then those that differ from it alike each other, which loses no pair. Components are
those of both kinds of links together.

Defined cases: a null text is an empty one; texts without words have fingerprint zero and link
like any other. Equal fingerprints are one node, so a group of copies costs one row. Null
doc_ids do not count for a component's smallest doc_id; a component of null doc_ids alone has a
null id. Repeated rows keep a row each. No rows give no rows. Other columns pass untouched or
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import components, fresh, map_texts, stored

BITS = 64
CHUNK = 1 << 15
BANDS, ROWS = 32, 5
SIM_WORDS, SIM_SEED, SIM_TAU = 3, 42, 3
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingle_hashes(text: bytes, words: int, seed: int) -> np.ndarray:
    """XXH64 of each shingle of the lower-cased text; of the whole sequence if it is shorter."""
    from xxhash import xxh64_intdigest

    found = text.translate(_LOWER).split()
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    if len(found) <= words:
        return np.array([xxh64_intdigest(joined, seed)], np.uint64)
    size = np.fromiter(map(len, found), np.int64, len(found))
    end = np.cumsum(size + 1) - 1
    cut = map(joined.__getitem__, map(slice, (end - size)[: 1 - words].tolist(), end[words - 1 :].tolist()))
    return np.fromiter(map(xxh64_intdigest, cut, repeat(seed)), np.uint64, len(found) - words + 1)


def majority(hashes: list[np.ndarray]) -> np.ndarray:
    """For each array, the word whose bits are set in over half of its hashes; zero for none."""
    n = np.array([len(h) for h in hashes], np.int64)
    counts = np.zeros((len(hashes), BITS), np.int64)
    full = np.flatnonzero(n)
    if len(full):
        flat = np.concatenate([hashes[i] for i in full])
        start = np.cumsum(n[full]) - n[full]
        for a in range(0, len(flat), CHUNK):
            part = np.unpackbits(flat[a : a + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            first = np.searchsorted(start, a, "right") - 1
            last = np.searchsorted(start, a + len(part))
            at = np.maximum(start[first:last] - a, 0)
            counts[full[first:last]] += np.add.reduceat(part, at, axis=0, dtype=np.int32)
    return np.packbits((2 * counts > n[:, None]).astype(np.uint8), axis=1, bitorder="little").view(np.uint64).reshape(-1)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SIM_WORDS, seed: int = SIM_SEED) -> DataFrame:
    """(doc_id, h, fp): h is a hash of the text that tells rows with one doc_id apart."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            fps, held, size = [], [], 0
            for text in texts:
                held.append(shingle_hashes(text.as_py() or b"", words, seed))
                size += len(held[-1])
                if size > 1 << 16:
                    fps.append(majority(held))
                    held, size = [], 0
            fps.append(majority(held))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate(fps).view(np.int64))], names=["doc_id", "h", "fp"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("t"))
    return map_texts(texts, rows, "doc_id long, h long, fp long")


def bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and how often each two bits are set together, over all of them."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            x = np.ascontiguousarray(np.asarray(batch.column(0))).view(np.uint8).reshape(-1, 8)
            for a in range(0, len(x), CHUNK):
                bits = np.unpackbits(x[a : a + CHUNK], axis=1, bitorder="little").astype(np.float32)
                total += bits.T @ bits
                n += len(bits)
        if n:
            i = np.append(np.arange(BITS * BITS), -1)
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(np.append(total.reshape(-1), n).astype(np.int64))], names=["i", "n"])

    found = {r.i: r.n for r in fps.select("fp").mapInArrow(rows, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect()}
    return found.pop(-1, 0), np.array([found.get(i, 0) for i in range(BITS * BITS)], float).reshape(BITS, BITS)


def group_bits(n: int, both: np.ndarray, groups: int) -> list[list[int]]:
    """Bits in ``groups`` partitions of near equal size; each takes in the bit most correlated with it."""
    p = np.diag(both) / max(n, 1)
    cov = both / max(n, 1) - np.outer(p, p)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(cov / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    left, out = set(range(BITS)), []
    for g in range(groups):
        size = (BITS + groups - 1 - g) // groups
        group = [max(left, key=lambda b: (corr[b, list(left)].sum(), -b))]
        left -= {*group}
        while len(group) < size:
            group.append(max(left, key=lambda b: (corr[b, group].sum(), -b)))
            left -= {group[-1]}
        out.append(sorted(group))
    return out


def chance(n: int, both: np.ndarray, group: list[int], upto: int) -> list[float]:
    """Estimated probability that two fingerprints differ in at most 0..upto bits of a partition.

    Disagreement rates of the bits; correlation within the partition lowers the number of
    bits that count.
    """
    p = np.diag(both)[group] / max(n, 1)
    q = np.clip(2 * p * (1 - p), 1e-6, 0.5)
    cov = both[np.ix_(group, group)] / max(n, 1) - np.outer(p, p)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    square = (cov / np.outer(sd, sd)).clip(-1, 1) ** 2
    np.fill_diagonal(square, 1)
    real = max(1, round(len(group) ** 2 / square.sum()))
    rate, dist = float(q.mean()), [1.0]
    for _ in range(min(real, len(group))):
        dist = [a * (1 - rate) + b * rate for a, b in zip([*dist, 0], [0, *dist])]
    return np.cumsum([*dist, *[0.0] * upto])[: upto + 1].tolist()


def allocate(n: int, both: np.ndarray, tau: int, pair_cost: float = 0.05) -> list[tuple[list[int], int]]:
    """Partitions and thresholds with the least estimated work, found by dynamic programming.

    The work of a partition with threshold t: n index rows, n times the size of the ball of
    radius t in probes, and ``pair_cost`` for each of the pairs that agree within t.
    """
    best = (float("inf"), [])
    for m in range(1, min(tau + 1, BITS) + 1):
        groups = group_bits(n, both, m)
        # state: sum of (t_i + 1) so far -> (cost, thresholds)
        states: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for g in groups:
            near = chance(n, both, g, tau)
            new: dict[int, tuple[float, list[int]]] = {}
            for used, (cost, chosen) in states.items():
                for t in range(-1, tau - used + 1):
                    ball = sum(comb(len(g), k) for k in range(t + 1))
                    c = cost + (n * (1 + ball) + pair_cost * near[t] * n * n / 2 if t >= 0 else 0)
                    if used + t + 1 not in new or c < new[used + t + 1][0]:
                        new[used + t + 1] = (c, [*chosen, t])
            states = new
        if tau + 1 in states and states[tau + 1][0] < best[0]:
            best = (states[tau + 1][0], [(g, t) for g, t in zip(groups, states[tau + 1][1]) if t >= 0])
    return best[1]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _ball(bits: list[int], radius: int) -> list[int]:
    return [_signed(sum(1 << b for b in c)) for k in range(radius + 1) for c in combinations(bits, k)]


def _longs(values: list[int]) -> Column:
    return F.expr("array(" + ",".join(f"{v}L" if v != -(1 << 63) else "(-9223372036854775807L - 1L)" for v in values) + ")")


def _around(i: int, key: Column, flips: list[int]) -> Column:
    return F.transform(_longs(flips), lambda f: F.struct(F.lit(i).alias("g"), key.bitwiseXOR(f).alias("key")))


def links(fps: DataFrame, tau: int = SIM_TAU, max_bucket: int = 4096, plan: list[tuple[list[int], int]] | None = None) -> DataFrame:
    """(u, v): pairs of different fingerprints that lie in one component, whose components are those of all links.

    Outside hot buckets these are the links themselves. ``fps`` should be a stored table of
    distinct fingerprints.
    """
    plan = plan or allocate(*bit_counts(fps), tau)
    masked = [F.col("fp").bitwiseAND(F.lit(_signed(sum(1 << b for b in g)))) for g, _ in plan]
    index = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("g"), k.alias("key")) for i, k in enumerate(masked)])).alias("x")).select("fp", "x.g", "x.key")
    probe = fps.select(
        F.col("fp"),
        F.explode(
            F.concat(*[_around(i, k, _ball(g, t)) for i, ((g, t), k) in enumerate(zip(plan, masked))])
        ).alias("x"),
    ).select("fp", "x.g", "x.key")
    hot = stored(index.groupBy("g", "key").count().where(F.col("count") > max_bucket).select("g", "key"), "hot")
    any_hot = bool(hot.take(1))
    cold_index, cold_probe = (x.join(hot, ["g", "key"], "left_anti") if any_hot else x for x in (index, probe))
    a, b = cold_index.select("g", "key", F.col("fp").alias("u")), cold_probe.select("g", "key", F.col("fp").alias("v"))
    found = (
        a.join(b, (a.g == b.g) & (a.key == b.key) & (F.col("u") < F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= tau)).select("u", "v")
    )
    if any_hot:
        found = found.unionByName(hub_links(index.join(hot, ["g", "key"], "left_semi").select("fp").union(probe.join(hot, ["g", "key"], "left_semi").select("fp")).distinct(), tau))
    return found


def hub_links(fps: DataFrame, tau: int) -> DataFrame:
    """(u, v) that connect just what links of at most ``tau`` bits connect, linear in the fingerprints.

    Every fingerprint stands at each 64-bit hub within ceil(tau/2) bits, and as a near one
    within floor(tau/2). At a hub with a near member all are linked to it; each two linked
    fingerprints meet at such a hub.
    """
    near = tau // 2
    flips = _longs(_ball(list(range(BITS)), tau - near))
    at = fps.select("fp", F.explode(F.transform(flips, lambda f: F.struct(F.col("fp").bitwiseXOR(f).alias("hub"), (F.bit_count(f) <= near).alias("near")))).alias("x")).select("fp", "x.hub", "x.near")
    hubs = at.groupBy("hub").agg(F.max("near").alias("near"), F.min("fp").alias("v"), F.count(F.lit(1)).alias("n")).where("near AND n > 1").select("hub", "v")
    return at.select("hub", F.col("fp").alias("u")).join(hubs, "hub").where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _named(marked: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, h, fp, component_id) of the rows of ``marked`` (doc_id, h, fp), by links (u, v) between their fps."""
    fps = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(found, "u", "v")
    in_group = roots.select("node", "root").union(roots.select("root", "root").distinct())
    named = in_group.join(fps, in_group.node == fps.fp).select("node", "root", "least")
    best = named.groupBy("root").agg(F.min("least").alias("component"))
    known = named.join(best, "root").select(F.col("node").alias("fp"), "component")
    # Stored, so that both sides of the last join are plain shuffles and a hot fingerprint can be split.
    ids = stored(fps.join(known, "fp", "left").select("fp", F.coalesce("component", "least").alias("component_id")), "ids")
    return marked.join(ids, "fp").select("doc_id", "h", "fp", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SIM_WORDS, tau: int = SIM_TAU, seed: int = SIM_SEED, max_bucket: int = 4096) -> DataFrame:
    """(doc_id, h, fp, component_id) of every row."""
    marked = stored(fingerprints(docs, id_col, text_col, words, seed), "fingerprints")
    fps = stored(marked.select("fp").distinct(), "distinct")
    return _named(marked, links(fps, tau, max_bucket))


def minima(sets: list[np.ndarray], flip: np.ndarray, odd: np.ndarray) -> np.ndarray:
    """For each set that is not empty, its least value under each of the orders."""
    flat = np.concatenate(sets)
    start = np.cumsum([0, *map(len, sets[:-1])])
    return np.stack([np.minimum.reduceat((flat ^ f) * o, start) for f, o in zip(flip, odd)], axis=1)


def shingle_sets(docs: DataFrame, id_col: str, text_col: str, words: int, seed: int) -> DataFrame:
    """(doc_id, h, fp, n, bands, sim): fp hashes the set of shingles, n is its size, bands has the keys of its bands, none for an empty set.

    sim is the fingerprint that ``fingerprints`` gives the text by itself.
    """
    random = np.random.default_rng(seed)
    flip, odd = (random.integers(0, 1 << 64, BANDS * ROWS, np.uint64) for _ in range(2))
    mix = random.integers(0, 1 << 64, ROWS, np.uint64) | np.uint64(1)
    odd |= np.uint64(1)

    def keys(sets: list[np.ndarray]) -> list[np.ndarray]:
        full = [x for x in sets if len(x)]
        found = iter((minima(full, flip, odd).reshape(-1, BANDS, ROWS) * mix).sum(axis=2, dtype=np.uint64).view(np.int64) if full else [])
        return [next(found) if len(x) else np.zeros(0, np.int64) for x in sets]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in batches:
            fps, sizes, bands, held, size, sims, short, n_short = [], [], [], [], 0, [], [], 0
            for text in batch.column(2).cast(pa.binary()):
                text = text.as_py() or b""
                short.append(shingle_hashes(text, SIM_WORDS, SIM_SEED))
                n_short += len(short[-1])
                if n_short > 1 << 16:
                    sims.append(majority(short))
                    short, n_short = [], 0
                held.append(np.unique(shingle_hashes(text, words, seed)))
                fps.append(xxh64_intdigest(held[-1].tobytes(), seed))
                sizes.append(len(held[-1]))
                size += sizes[-1]
                if size > CHUNK:
                    bands += keys(held)
                    held, size = [], 0
            bands += keys(held)
            sims = pa.array(np.concatenate([*sims, majority(short)]).view(np.int64))
            fps = pa.array(np.array(fps, np.uint64).view(np.int64))
            ends = pa.array(np.cumsum([0, *map(len, bands)]).astype(np.int32))
            flat = pa.array(np.concatenate([*bands, np.zeros(0, np.int64)]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), fps, pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(ends, flat), sims], names=["doc_id", "h", "fp", "n", "bands", "sim"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("t"))
    return map_texts(texts, rows, "doc_id long, h long, fp long, n long, bands array<long>, sim long")


def _members(fps: DataFrame, words: int, seed: int) -> DataFrame:
    """(fp, s): the shingle set of each row's text t."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for fp, text in zip(batch.column(0), batch.column(1).cast(pa.binary())):
                found = np.unique(shingle_hashes(text.as_py() or b"", words, seed)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([fp.as_py()], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(found)], pa.int32()), pa.array(found))], names=["fp", "s"])

    return map_texts(fps.select("fp", "t"), rows, "fp long, s array<long>")


def _similar(pairs: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """The pairs (u, v) whose sets have at least that Jaccard similarity."""
    both = pairs.join(sets.toDF("v", "b"), "v").join(sets.toDF("u", "a"), "u")
    both = both.withColumn("i", F.size(F.array_intersect("a", "b")))
    return stored(both.where(F.col("i") / (F.size("a") + F.size("b") - F.col("i")) >= similar).select("u", "v"), "similar")


def _starred(index: DataFrame, sets: DataFrame, similar: float) -> tuple[DataFrame, DataFrame]:
    """Similar pairs (u, v) of members with the hub of their bucket, and the members that this leaves apart.

    ``index``: key, fp, n; stored. The hub is the member that meets most others over all its buckets:
    of a text and its copies the text, to which copies are closer than to each other. The second
    table has key, fp, n, hub and the component c of members of buckets that lie in different ones,
    without the hub, which has been compared with all.
    """
    several = stored(index.groupBy("key").agg(F.count(F.lit(1)).alias("k")).where("k > 1"), "several")
    shared = stored(index.join(several, "key"), "shared")
    met = stored(shared.groupBy("fp").agg(F.sum("k").alias("met")), "met")
    hubs = shared.join(met, "fp").groupBy("key").agg(F.max(F.struct("met", "fp", "n")).alias("hub"))
    at = stored(shared.drop("k").join(stored(hubs, "buckets"), "key"), "members")
    stars = stored(at.where((F.col("fp") != F.col("hub.fp")) & _fits(F.col("n"), F.col("hub.n"), similar)).select(F.col("hub.fp").alias("u"), F.col("fp").alias("v")).distinct(), "pairs")
    found = _similar(stars, sets, similar)
    roots = components(found, "u", "v").toDF("fp", "root")
    named = stored(at.join(roots, "fp", "left").select("key", "fp", "n", "hub", (F.col("fp") == F.col("hub.fp")).alias("is_hub"), F.coalesce("root", "fp").alias("c")), "named")
    mixed = stored(named.groupBy("key").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x < y").select("key"), "mixed")
    return found, stored(named.where("NOT is_hub").join(mixed, "key", "left_semi").drop("is_hub"), "left")


def _fits(x: Column, y: Column, similar: float) -> Column:
    """Whether sets of these sizes can be as similar."""
    return F.least(x, y) / F.greatest(x, y) >= similar


def hub_pairs(crowd: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """(u, v): all similar pairs in different components c among the members of each hub, and few others.

    ``crowd``: h, nh (a hub and its size), fp, n, c. Two sets differ by as many elements as their
    differences from the hub differ. With g = (1 - similar) / (1 + similar), sets are similar when they differ in
    g (|u| + |v|) elements at most. Of a similar pair in different components one is far: not similar to
    the hub. A set that differs from the hub in a elements has more than (a + g (|hub| - |u|)) / 2 of them in
    common with one that is far, and a far one (a - g (|u| + |hub|)) / 2 at least with any. With so many in
    common, one is among each side's rarest. What all have from the hub, or one alone has, brings no two together.
    """
    g = (1 - similar) / (1 + similar)
    both = crowd.join(sets.toDF("fp", "s"), "fp").join(sets.toDF("h", "hs"), "h")
    off = F.concat(F.array_except("s", "hs"), F.array_except("hs", "s"))
    off = stored(both.select("h", "nh", "fp", "n", "c", off.alias("off")).withColumn("a", F.size("off")), "off")
    each = off.select("h", "fp", F.explode("off").alias("x"))
    often = stored(each.groupBy("h", "x").agg(F.count(F.lit(1)).alias("k")).where("k > 1"), "often")
    kept = stored(each.join(often, ["h", "x"]).groupBy("h", "fp").agg(F.array_sort(F.collect_list(F.struct("k", "x"))).alias("kept")), "kept")
    rows = off.drop("off").join(kept, ["h", "fp"]).withColumn("far", (F.col("n") + F.col("nh") - F.col("a")) / (F.col("n") + F.col("nh") + F.col("a")) < similar)
    # Elements that one alone has are the rarest of all and stand before those kept.
    first = lambda t: F.transform(F.slice("kept", F.lit(1), F.greatest(F.size("kept") - t + 1, F.lit(0)).cast("int")), lambda x: x["x"])
    with_far = F.floor((F.col("a") + g * (F.col("nh") - F.col("n"))) / 2) + 1
    with_any = F.greatest(F.ceil((F.col("a") - g * (F.col("n") + F.col("nh"))) / 2 - 1e-6), F.lit(1))
    rows = stored(rows.select("h", "fp", "n", "c", "far", first(with_far).alias("p2"), first(with_any).alias("p1")), "rare")

    def side(which: Column, p: str, k: str) -> DataFrame:
        return rows.where(which).select("h", F.col("fp").alias(k), F.col("n").alias(f"n{k}"), F.col("c").alias(f"c{k}"), F.col(p).alias(f"p{k}"), F.explode(p).alias("x"))

    def met(a: DataFrame, b: DataFrame, one_way: Column) -> DataFrame:
        # Of the elements that two share one stands for all, so a hub gives a pair once.
        once = F.array_min(F.array_intersect("pu", "pv")) == F.col("x")
        found = a.join(b, ["h", "x"]).where(one_way & (F.col("cu") != F.col("cv")) & _fits(F.col("nu"), F.col("nv"), similar) & once)
        return found.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))

    far = F.col("far")
    return met(side(far, "p2", "u"), side(far, "p2", "v"), F.col("u") < F.col("v")).unionByName(met(side(far, "p1", "u"), side(~far, "p2", "v"), F.lit(True)))


def set_links(marked: DataFrame, docs: DataFrame, id_col: str, text_col: str, words: int, similar: float, seed: int) -> DataFrame:
    """(u, v): pairs of similar sets that connect just what all similar pairs of one bucket connect.

    First each member of a bucket is compared with its hub; so a large group of near copies
    costs a comparison for each member. Of the members that this leaves in different components
    only those meet that differ from the hub alike (``hub_pairs``): that loses no similar pair, and
    neither pages that only have a frame in common nor copies that each have changes of their own meet.
    """
    index = stored(marked.select("fp", "n", F.posexplode("bands").alias("g", "b")).select(F.xxhash64("g", "b").alias("key"), "fp", "n").distinct(), "bands")
    several = stored(index.groupBy("key").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("key"), "several")
    # One row speaks for each set; rows repeated as a whole would give it twice.
    wanted = index.join(several, "key", "left_semi").select("fp").distinct()
    rows = marked.join(wanted, "fp", "left_semi").groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "h")).alias("r"))
    texts = docs.select(F.col(id_col).cast("long").alias("d"), F.xxhash64(text_col).alias("g"), F.col(text_col).alias("t"))
    rows = texts.join(rows, F.col("d").eqNullSafe(F.col("r.doc_id")) & (F.col("g") == F.col("r.h"))).select("fp", "t").dropDuplicates(["fp"])
    sets = stored(_members(rows, words, seed), "sets")
    found, left = _starred(index, sets, similar)
    crowd = left.select(F.col("hub.fp").alias("h"), F.col("hub.n").alias("nh"), "fp", "n", "c").distinct()
    pairs = hub_pairs(stored(crowd, "crowd"), sets, similar)
    return found.unionByName(_similar(stored(pairs.distinct(), "pairs"), sets, similar))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similar: float = 0.8, seed: int = 42) -> DataFrame:
    """(doc_id, h, fp, component_id) of every row; fp is a hash of the text's set of shingles."""
    marked = stored(shingle_sets(docs, id_col, text_col, words, seed), "signatures")
    return _named(marked.select("doc_id", "h", "fp"), set_links(marked, docs, id_col, text_col, words, similar, seed))


def fingerprint_links(marked: DataFrame) -> DataFrame:
    """(u, v): pairs of sets (fp) that connect just what the links of their texts' fingerprints (sim) connect.

    A fingerprint's least set speaks for all sets that have it. ``marked``: fp, sim; stored.
    """
    of = stored(marked.select("sim", "fp").distinct(), "sims")
    least = stored(of.groupBy("sim").agg(F.min("fp").alias("fp")), "distinct")
    same = of.join(least.toDF("sim", "u"), "sim").where("u <> fp").select("u", F.col("fp").alias("v"))
    near = links(least.select(F.col("sim").alias("fp")))
    near = near.join(least.toDF("u", "a"), "u").join(least.toDF("v", "b"), "v").where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v"))
    return same.unionByName(near)


def near_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similar: float = 0.8, seed: int = 42) -> DataFrame:
    """(doc_id, h, fp, component_id) of every row, by links of fingerprints (``near_duplicates``) and of similar sets (``near_copies``) together."""
    marked = stored(shingle_sets(docs, id_col, text_col, words, seed), "signatures")
    found = fingerprint_links(marked).unionByName(set_links(marked, docs, id_col, text_col, words, similar, seed))
    return _named(marked.select("doc_id", "h", "fp"), found)


def keep_first(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component of ``found``, a stored table (doc_id, h, fp, component_id): the smallest doc_id, of rows with one doc_id the smallest text hash.

    Columns and rows that stay are as they were.
    """
    rank = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "h", "fp")
    # A component of null doc_ids has no number; its fingerprints' rows then stand for themselves.
    group = [F.coalesce("component_id", "fp"), F.col("component_id").isNull()]
    winners = found.groupBy(*group).agg(F.min(rank).alias("w")).select("w.doc_id", "w.h")
    losers = found.select("doc_id", "h").distinct()
    gone = losers.join(winners, losers.doc_id.eqNullSafe(winners.doc_id) & (losers.h == winners.h), "left_anti")
    h, d, g = fresh(docs, "__h", "__d", "__g")
    keep = docs.withColumn(h, F.xxhash64(text_col))
    left = keep.join(gone.select(F.col("doc_id").alias(d), F.col("h").alias(g)), F.col(id_col).cast("long").eqNullSafe(F.col(d)) & (F.col(h) == F.col(g)), "left_anti")
    if found.groupBy("doc_id", "h").count().where("count > 1").take(1):
        left = left.dropDuplicates([id_col, h])
    return left.select(docs.columns)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of each component of near copies."""
    return keep_first(docs, stored(near_copies(docs, id_col, text_col, **options), "components"), id_col, text_col)


def drop_near_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of each component of near texts: by fingerprints and by similar sets together."""
    return keep_first(docs, stored(near_texts(docs, id_col, text_col, **options), "components"), id_col, text_col)


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
