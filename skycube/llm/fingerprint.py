"""Document fingerprints from prefix polynomial hashes (operator 4).

``Prefix`` holds modular prefix sums of a text; they answer whether any two spans are equal and
find longest common extensions by binary search. A fingerprint keeps a few of these sums, and
``likeness`` asks two fingerprints the same questions:

* at up to 64 places that the text itself chooses: after each four characters whose hash ends in
  enough zero bits. They move with the text, so spans between them are compared wherever they
  lie, after any insertions. From each chunk that both have, the longest common extension is
  found by binary search, and the extensions are chained.
* at up to 16 places from either end, on a grid whose step is a power of two, so the sums of two
  texts of any lengths meet on the coarser grid. They serve texts that repeat themselves, which
  choose few places or too many.

``next_documents`` puts each document beside the next one in descending doc_id order with one
shuffle of the texts: (doc_id, text hash) is cut into ranges, so that one doc_id with very many
texts, or very many null ones, lie in several; the first document of each range is dealt to the
range before it as well.

Defined cases: a null text is an empty one. Null doc_ids come last; rows with one doc_id are
ordered by a hash of the text. A lone document is its own next. Two empty texts are alike (1),
an empty and another are not (0). No rows give no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import map_texts

PRIME = (1 << 31) - 1
BASES = (1_000_003, 48_271_009)
CELLS, CUTS, WINDOW = 16, 64, 4


def _mod(x: np.ndarray) -> np.ndarray:
    """Below 2**62, modulo the Mersenne prime."""
    x = (x & np.uint64(PRIME)) + (x >> np.uint64(31))
    x = (x & np.uint64(PRIME)) + (x >> np.uint64(31))
    x[x == PRIME] = 0
    return x


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1); kept, and doubled when more are asked for."""
    have = _powers.get(base, np.ones(1, np.uint64))
    while len(have) < n:
        have = np.concatenate([have, _mod(have * np.uint64(pow(base, len(have), PRIME)))])
    _powers[base] = have
    return have[:n]


class Prefix:
    """Prefix sums of c_j * base**j modulo the prime, for two bases."""

    def __init__(self, text: str):
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
        self.n, self.codes = len(codes), codes
        self.sums = []
        for base in BASES:
            total = np.zeros(self.n + 1, np.uint64)
            np.cumsum(_mod(codes * powers(base, self.n)), out=total[1:])
            self.sums.append(total)

    def at(self, places: np.ndarray, k: int = 0) -> np.ndarray:
        return self.sums[k][places] % np.uint64(PRIME)

    def span(self, start: int, end: int) -> tuple[int, int]:
        """The hash of a span, the same wherever the span lies."""
        return tuple((int(s[end]) - int(s[start])) * pow(b, -start, PRIME) % PRIME for s, b in zip(self.sums, BASES))

    def extension(self, start: int, other: Prefix, start2: int) -> int:
        """Length of the longest common extension from two places."""
        low, high = 0, min(self.n - start, other.n - start2)
        while low < high:
            mid = (low + high + 1) // 2
            if self.span(start, start + mid) == other.span(start2, start2 + mid):
                low = mid
            else:
                high = mid - 1
        return low


class Fingerprint(NamedTuple):
    n: int
    whole: int
    step: int
    front: list[int]  # sums of the first 0, 1, 2, ... cells
    back: list[int]  # the same of the text read from its end
    places: list[int]  # that the text chose, in order
    levels: list[int]  # zero bits of the hash at each place
    sums: list[int]  # at each place

    def __str__(self) -> str:
        cells = [f"{self.n:x}", f"{self.whole:016x}", f"{self.step:x}"] + ["".join(f"{x:08x}" for x in c[1:]) for c in (self.front, self.back)]
        return ".".join([*cells, *(",".join(f"{x:x}" for x in c) for c in (self.places, self.levels)), "".join(f"{x:08x}" for x in self.sums)])

    @staticmethod
    def parse(text: str) -> Fingerprint:
        n, whole, step, front, back, places, levels, sums = text.split(".")
        eights = lambda x: [int(x[i : i + 8], 16) for i in range(0, len(x), 8)]
        numbers = lambda x: [int(v, 16) for v in x.split(",") if v]
        return Fingerprint(int(n, 16), int(whole, 16), int(step, 16), [0, *eights(front)], [0, *eights(back)], numbers(places), numbers(levels), eights(sums))


def chosen_places(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At most ``CUTS`` places inside a text, and the level of each: places of higher levels are fewer by halves."""
    x = np.zeros(max(0, len(codes) - 1), np.uint64)
    for k in range(WINDOW):
        x[k:] = x[k:] * np.uint64(0x9E3779B97F4A7C15) + codes[: len(x) - k] if k < len(x) else x[k:]
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    level = np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)).astype(np.int64)
    at_least = np.cumsum(np.bincount(level, minlength=1)[::-1])[::-1]
    least = int(np.searchsorted(-at_least, -CUTS)) if len(x) else 0
    at = np.flatnonzero(level >= least)
    return at + 1, level[at]


def fingerprint(text: str) -> Fingerprint:
    p = Prefix(text)
    step = 1
    while p.n > CELLS * step:
        step *= 2
    grid = np.arange(p.n // step + 1) * step
    front = p.at(grid)
    # From the end: span sums shifted so that the text's end is the origin.
    turn = np.uint64(pow(BASES[0], -p.n, PRIME))
    back = _mod((np.uint64(PRIME) + p.at(np.array([p.n])) - p.at(p.n - grid)) % np.uint64(PRIME) * turn)
    whole = int(p.at(np.array([p.n]))[0]) << 31 | int(p.at(np.array([p.n]), 1)[0])
    places, levels = chosen_places(p.codes)
    return Fingerprint(p.n, whole, step, front.tolist(), back.tolist(), places.tolist(), levels.tolist(), p.at(places).tolist())


def _runs(a: list[int], b: list[int]) -> tuple[int, int]:
    """Equal cells at equal places; how many of them lead."""
    i, equal, lead, m = 0, 0, 0, min(len(a), len(b)) - 1
    while i < m:
        shift = a[i] - b[i]
        j = bisect_right(range(i + 1, m + 1), 0, key=lambda k: (a[k] - b[k] - shift) % PRIME != 0) + i
        equal += j - i
        if not i:
            lead = j
        i = j + 1
    return equal, lead


_INVERSE = pow(BASES[0], -1, PRIME)


def _chunks(f: Fingerprint, level: int) -> tuple[list[int], list[int]]:
    """The places of that level or above with both ends, and the sums there."""
    kept = [i for i, x in enumerate(f.levels) if x >= level]
    return [0, *(f.places[i] for i in kept), f.n], [0, *(f.sums[i] for i in kept), f.whole >> 31]


def common(a: Fingerprint, b: Fingerprint) -> int:
    """Characters of both texts in chained common extensions of chunks."""
    level = max(min(a.levels, default=0), min(b.levels, default=0))
    (at_a, sum_a), (at_b, sum_b) = _chunks(a, level), _chunks(b, level)
    # Factors that make the sums of spans from these places comparable.
    turn_a, turn_b = ([pow(_INVERSE, p, PRIME) for p in x] for x in (at_a, at_b))
    first: dict[tuple[int, int], list[int]] = {}
    for j in range(len(at_b) - 1):
        first.setdefault((at_b[j + 1] - at_b[j], (sum_b[j + 1] - sum_b[j]) * turn_b[j] % PRIME), []).append(j)
    used, total, i = [False] * len(at_b), 0, 0
    while i < len(at_a) - 1:
        best, at = 0, 0
        for j in first.get((at_a[i + 1] - at_a[i], (sum_a[i + 1] - sum_a[i]) * turn_a[i] % PRIME), ()):
            if used[j]:
                continue
            # Spans of both texts from these places are equal up to some number of chunks, and unequal beyond.
            most = min(len(at_a) - i, len(at_b) - j)
            differs = lambda m: at_a[i + m] - at_a[i] != at_b[j + m] - at_b[j] or ((sum_a[i + m] - sum_a[i]) * turn_a[i] - (sum_b[j + m] - sum_b[j]) * turn_b[j]) % PRIME != 0 or used[j + m - 1]  # noqa: B023, E731
            m = 1 + bisect_right(range(2, most), False, key=differs)
            if m > best:
                best, at = m, j
        if best:
            used[at : at + best] = [True] * best
            total += at_a[i + best] - at_a[i]
        i += max(best, 1)
    return total


def likeness(a: Fingerprint, b: Fingerprint) -> float:
    """Share of the longer text that lies in common runs, as far as the sums show; 1 for equal texts."""
    if (a.n, a.whole) == (b.n, b.whole):
        return 1.0
    if not a.n or not b.n:
        return 0.0
    step = max(a.step, b.step)
    (front, lead), (back, trail) = (_runs(x[:: step // a.step], y[:: step // b.step]) for x, y in ((a.front, b.front), (a.back, b.back)))
    grid = max(front, back, min(lead + trail, min(a.n, b.n) // step)) * step
    return min(1.0, max(grid, common(a, b)) / max(a.n, b.n))


def edited_text(text: str, following: str) -> str:
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def next_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """Rows (part, spare, doc_id, text), partitioned by part and in order: each row's next document follows it.

    A part's last row is spare: it is the first row of the next part (of the first after the last).
    """
    parts = parts or 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("d"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    shares = [i / parts for i in range(1, parts)] or [0.5]
    found = rows.select(F.percentile_approx("d", shares, 20 * parts).alias("q"), F.count_if(F.col("d").isNull()).alias("nulls"), F.count(F.lit(1)).alias("n")).first()
    # A doc_id that several quantiles fall on, and null, are cut further by the hash of the text.
    ids = Counter(found.q or [])
    width = lambda k: [((i << 64) // k) - (1 << 63) for i in range(k)]
    cuts = [(d, h) for d in sorted(ids, reverse=True) for h in width(ids[d])]
    cuts += [(None, h) for h in width(max(1, -(-found.nulls * parts // found.n)))] if found.nulls else []
    rows = rows.withColumn("h", F.xxhash64("t"))
    if cuts:
        marks = lambda some: F.array(*[F.struct(F.lit(d).cast("long").alias("d"), F.lit(h).cast("long").alias("h")) for d, h in some])
        before = lambda x: F.when(x["d"].isNull(), F.col("d").isNull() & (x["h"] <= F.col("h"))).otherwise(F.col("d").isNull() | (x["d"] > F.col("d")) | ((x["d"] == F.col("d")) & (x["h"] <= F.col("h"))))
        # Cuts are in order: a row meets every k-th of them, then those between two of these.
        k = math.isqrt(len(cuts)) + 1
        between = F.array(*[marks(cuts[i : i + k - 1]) if cuts[i : i + k - 1] else marks([]).cast("array<struct<d:bigint,h:bigint>>") for i in range(0, len(cuts) + 1, k)])
        coarse = F.size(F.filter(marks(cuts[k - 1 :: k]), before)) if cuts[k - 1 :: k] else F.lit(0)
        rows = rows.withColumn("coarse", coarse)
        part = F.col("coarse") * k + F.size(F.filter(F.get(between, F.col("coarse")), before))
    else:
        part = F.lit(0)
    rows = rows.withColumn("p", part).select("d", "t", "h", "p")
    # One row for each part: the first document of its order.
    order = F.struct(F.col("d").isNull().alias("no"), F.bitwise_not("d").alias("m"), "h")
    heads = sorted(rows.groupBy("p").agg(F.min(order).alias("f")).select("p", "f.m", "f.h").collect())
    # Arrays by part, so a row looks up its own part's head: nothing nests with the number of parts.
    found: list = [(None, None, None)] * (len(cuts) + 1)
    for i, head in enumerate(heads):
        found[head.p] = (None if head.m is None else ~head.m, head.h, heads[i - 1].p)
    first, mark, before = (F.array(*[F.lit(x).cast(kind) for x in column])[F.col("p")] for column, kind in zip(zip(*found), ("long", "long", "int")))
    spare = F.when(F.col("d").eqNullSafe(first) & (F.col("h") == mark), before)
    targets = F.array_compact(F.array(F.struct(F.col("p").alias("part"), F.lit(False).alias("spare")), F.when(F.col("x").isNotNull(), F.struct(F.col("x").alias("part"), F.lit(True).alias("spare")))))
    dealt = rows.withColumn("x", spare).select("d", "h", "t", F.explode(targets).alias("to")).select("to.part", "to.spare", "d", "h", "t")
    return dealt.repartition("part").sortWithinPartitions("part", "spare", F.col("d").desc_nulls_last(), "h").select("part", "spare", F.col("d").alias("doc_id"), F.col("t").alias("text"))


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row whose next document has not come yet
        names = [x.split()[0] for x in RESULT.split(", ")]
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            columns = [pa.array(list(c), pa.int64() if i < 2 else pa.float64() if i > 4 else pa.string()) for i, c in enumerate(zip(*out))]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            for part, spare, doc_id, text in zip(*(batch.column(i) for i in range(4))):
                part, spare, text = part.as_py(), spare.as_py(), text.as_py()
                if held and held[0] == part:
                    mark = fingerprint(text)
                    edited = edited_text(held[2], text)
                    theirs = fingerprint(edited)
                    mine = held[3]
                    out.append((held[1], mine.n, hashlib.sha256(edited.encode()).hexdigest(), str(mine), str(theirs), likeness(mine, theirs), likeness(mine, mark)))
                    held = None if spare else (part, doc_id.as_py(), text, mark)
                elif not spare:
                    held = (part, doc_id.as_py(), text, fingerprint(text))
                if len(out) >= 1000:
                    yield flush()
        if out:
            yield flush()

    return map_texts(next_documents(docs, id_col, text_col, parts), rows, RESULT)


def op4_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
