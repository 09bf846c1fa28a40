"""Token ids as binary files: range-coded frames in ascending document order (operator 1).

``write_tokens`` shuffles the texts once into ranges of doc_id, encodes them, and writes one
Parquet table of frames with Spark's own committer, so a retried or speculative task leaves no
half file and any store will do. A frame holds whole documents, up to ``frame_ids`` ids or one
longer document; its blocks are coded by ``range_coder``. ``read_tokens`` decodes frames and
checks every block.

Defined cases: a null text is an empty one; an empty text has the end id alone. A null doc_id
comes first. Rows with the same doc_id keep their own entries, ordered by a hash of the text, then by
the text. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .range_coder import BLOCK, pack_frame, unpack_frame
from .shared import map_texts, new_path
from .tokens import tokens

FRAME_IDS = 4 << 20
FRAMES = "part int, frame int, n_ids long, data binary"


def with_end(ids: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's ids followed by ``end_id``; the new lengths."""
    lengths = np.diff(offsets) + 1
    out = np.full(len(ids) + len(lengths), end_id, np.uint32)
    keep = np.ones(len(out), bool)
    keep[np.cumsum(lengths) - 1] = False
    out[keep] = ids
    return out, lengths


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, frame_ids: int = FRAME_IDS, block: int = BLOCK
) -> None:
    rows = docs.select(F.col(id_col).cast("long").alias("d"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).withColumn("h", F.xxhash64("t"))
    ordered = rows.repartitionByRange("d", "h").sortWithinPartitions(F.col("d").asc_nulls_first(), "h", "t").select("d", "t")

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encode, frame = TaskContext.get().partitionId(), tokens(tokenizer).encode, 0
        held: list[tuple] = []
        n_held = 0

        def made() -> pa.RecordBatch:
            nonlocal frame, n_held
            d, known, n, ids = (np.concatenate(x) for x in zip(*held))
            held.clear()
            n_held = 0
            frame += 1
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([frame - 1], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([pack_frame(d, known, n, ids, block)], pa.binary())],
                names=["part", "frame", "n_ids", "data"],
            )

        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                known = ~np.asarray(batch.column(0).is_null())
                d = np.asarray(batch.column(0).fill_null(0))
                ids, lengths = with_end(*encode(batch.column(1).to_pylist()), end_id)
                # Cut where a frame would pass its limit; a document is never cut.
                ends = np.cumsum(lengths)
                first = 0
                for k in range(len(lengths)):
                    before = ends[first - 1] if first else 0
                    if (n_held or k > first) and n_held + ends[k] - before > frame_ids:
                        if k > first:
                            held.append((d[first:k], known[first:k], lengths[first:k], ids[before : ends[k - 1]]))
                        yield made()
                        first = k
                before = ends[first - 1] if first else 0
                if first < len(lengths):
                    held.append((d[first:], known[first:], lengths[first:], ids[before:]))
                    n_held += len(ids) - int(before)
        if held:
            yield made()

    map_texts(ordered, frames, FRAMES).write.parquet(path)


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FRAMES).parquet(path)


def frame_starts(frames: DataFrame) -> DataFrame:
    """(part, frame, start): ids of all frames before. Part totals are one row for each writing task."""
    sizes = frames.select("part", "frame", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    within = F.sum("n_ids").over(Window.partitionBy("part").orderBy("frame")) - F.col("n_ids")
    return sizes.join(before, "part").select("part", "frame", (F.col("base") + within).alias("start"))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids array<long>): the whole contents, for training readers."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for frame, base in zip(batch.column(0), batch.column(1).to_pylist()):
                d, known, n, ids = unpack_frame(frame.as_py())
                ends = np.append(0, np.cumsum(n))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(d, mask=~known), pa.array(base + ends[:-1]), pa.LargeListArray.from_arrays(ends, pa.array(ids.astype(np.int64))).cast(pa.list_(pa.int64()))], names=["doc_id", "start", "ids"]
                )

    frames = read_frames(spark, path)
    placed = frames.join(frame_starts(frames), ["part", "frame"]).select("data", "start")
    return placed.mapInArrow(rows, "doc_id long, start long, ids array<long>")


def token_digest(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the files."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, frame, data in zip(*(batch.column(i) for i in range(3))):
                d, known, n, ids = unpack_frame(data.as_py())
                raw, ends = memoryview(ids.astype("<u4").tobytes()), np.append(0, np.cumsum(n))
                at = (4 * ends).tolist()
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(at, at[1:])]
                one = np.ones(len(d), np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(one * part.as_py()), pa.array(one * frame.as_py()), pa.array(d, mask=~known), pa.array(ends[:-1]), pa.array(n), pa.array(crc, pa.int64())],
                    names=["part", "frame", "doc_id", "within", "n_tokens", "ids_crc32"],
                )

    frames = read_frames(spark, path)
    out = frames.select("part", "frame", "data").mapInArrow(rows, "part int, frame int, doc_id long, within long, n_tokens long, ids_crc32 long")
    return out.join(frame_starts(frames), ["part", "frame"]).select("doc_id", (F.col("start") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = new_path(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_digest(spark, path)
