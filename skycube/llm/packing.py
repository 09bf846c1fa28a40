"""Best-two-fit packing of token pieces into sequences (operator 5).

Texts are encoded where they are read; only (doc_id, piece, start, length, crc) rows move.
They are dealt in turn into shares of about ``share`` pieces, and each share is packed on its
own, so no task holds more and each share wastes less than one sequence more than a single
packing would. Within a share a bin is filled greedily with the longest piece that fits its
gap; then its smallest piece gives way to the two unpacked pieces that fill the widened gap
best, if they leave less of it empty.

Defined cases: a null text is empty; an empty text is one piece, the end id alone. Rows with
the same doc_id are packed each for itself. Null doc_ids stay null. No rows give no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import map_texts, stored
from .token_output import with_end
from .tokens import tokens

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"
SHARE = 1 << 16


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, size: int = 2048) -> DataFrame:
    """One row for each piece. Longer documents are cut; their first piece is the shorter one."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens(tokenizer).encode
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                ids, lengths = with_end(*encode(batch.column(1).to_pylist()), end_id)
                count = -(-lengths // size)
                first = lengths - (count - 1) * size
                row = np.repeat(np.arange(len(lengths)), count)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                length = np.where(piece == 0, first[row], size)
                start = np.where(piece == 0, 0, first[row] + (piece - 1) * size)
                raw, ends = memoryview(ids.astype("<u4").tobytes()), (4 * np.append(0, np.cumsum(length))).tolist()
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(ends, ends[1:])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return map_texts(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), rows, PIECES)


def best_two_fit(lengths: list[int], size: int) -> list[list[int]]:
    """Bins of indices into ``lengths``, all of which are at most ``size``."""
    by_length: dict[int, list[int]] = {}
    for i, n in enumerate(lengths):
        by_length.setdefault(n, []).append(i)
    have = sorted(by_length)  # the lengths that are left

    def take(n: int) -> int:
        i = by_length[n].pop()
        if not by_length[n]:
            have.pop(bisect_left(have, n))
        return i

    def give(n: int, i: int) -> None:
        if not by_length[n]:
            insort(have, n)
        by_length[n].append(i)

    def two(gap: int) -> tuple[int, int, int]:
        """The pair of lengths with the largest sum within gap: (sum, longer, shorter)."""
        best = (0, 0, 0)
        hi = bisect_left(have, gap) - 1
        while hi >= 0 and 2 * have[hi] > best[0]:
            a = have[hi]
            k = bisect_right(have, min(a, gap - a)) - 1
            if k >= 0 and have[k] == a and len(by_length[a]) < 2:
                k -= 1
            if k >= 0 and a + have[k] > best[0]:
                best = (a + have[k], a, have[k])
                if best[0] == gap:
                    break
            hi -= 1
        return best

    bins = []
    while have:
        picked, gap = [], size
        while have and have[0] <= gap:
            n = have[bisect_right(have, gap) - 1]
            picked.append((n, take(n)))
            gap -= n
        if gap and len(picked) > 1:
            n, i = picked[-1]  # greedy picks never grow, so the last is the smallest
            total, a, b = two(gap + n)
            if total > n:
                picked[-1:] = [(a, take(a)), (b, take(b))]
                give(n, i)
        bins.append([i for _, i in picked])
    return bins


def pack(found: DataFrame, size: int = 2048, share: int = SHARE) -> DataFrame:
    """Adds sequence_id and offset to the columns of ``pieces``. ``found`` should be a stored table."""
    total = found.count()
    shares = max(1, total // share)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        table = pa.Table.from_batches(list(batches), schema)
        if not table.num_rows:
            return
        bins = best_two_fit(table.column("length").to_pylist(), size)
        order = np.fromiter((i for b in bins for i in b), np.int64, table.num_rows)
        which = np.repeat(np.arange(len(bins)), [len(b) for b in bins])
        out = table.take(pa.array(order))
        n = np.asarray(out.column("length"))
        ends = np.cumsum(n) - n
        first = np.searchsorted(which, which)
        out = out.append_column("sequence_id", pa.array(which + (part << 32))).append_column("offset", pa.array(ends - ends[first]))
        yield from out.combine_chunks().to_batches()

    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
    return found.select("doc_id", "piece", "start", "length", "ids_crc32").repartition(shares).mapInArrow(rows, PACKED)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(stored(pieces(docs, public_tokenizers.path("byte_bpe_50k.json")), "pieces"))
