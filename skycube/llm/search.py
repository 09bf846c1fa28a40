"""Ranked lexical search with dense blocked products (operator 12).

Items are queries, all documents are ranked for each. One pass over the texts leaves, for each
document, its number of terms and the counts of those terms that some item has; document
frequencies, N and L are aggregates of that table. Then a task takes its documents in tiles: for
each tile of items the compact vocabulary of these items, in tiles of its own, times the dense
impacts of the documents, as float64 matrix products. Weights and impacts are whole numbers, and a
vocabulary tile is as wide as keeps every sum below 2**53, so the products are exact in any order
of summation; sums of tiles are added as 64-bit integers.

A task keeps the best of each item over its tiles: all scores that reach the k-th largest stay
until ties are settled by doc_id. What tasks leave is ranked by bucket, then by item, so
no ranking holds more than a bucket's or the buckets' best.

Items are dealt by a hash into shards of about ``max_words`` words. One shard at a time is held
by the driver and broadcast, whatever the number of items; most benchmarks are one shard.

Defined cases: a null text has no terms. Rows of items with one id are one item with the terms of
all; null is an id too. Rows of documents with one doc_id rank each for itself, null doc_ids after
others of the score. An item none of whose terms occurs has no rows. No rows give no rows.
Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .decontaminate import words_of
from .shared import map_texts, stored

MAX_WORDS = 400_000
ITEM_TILE, DOC_TILE, TERM_TILE = 64, 2048, 4096
#: An impact is at most this: (10**9 tf) div (1000 tf + ...).
MOST_IMPACT = 10**6
COUNTS = "doc_id long, n long, terms array<int>, tfs array<int>"


def term_counts(docs: DataFrame, vocabulary: list[bytes], id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, terms, tfs): all terms of each document, and how often it has each term of the vocabulary."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(held.value, pa.binary())
        for batch in batches:
            words = [words_of(x.as_py() or b"") for x in batch.column(1).cast(pa.binary())]
            n = np.array([len(w) for w in words], np.int64)
            term = np.asarray(pc.index_in(pa.array([t for w in words for t in w], pa.binary()), known).fill_null(-1)).astype(np.int64)
            there = term >= 0
            keys, tfs = np.unique(np.repeat(np.arange(len(n)), n)[there] * len(known) + term[there], return_counts=True)
            ends = pa.array(np.searchsorted(keys, np.arange(len(n) + 1) * len(known)), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (keys % max(len(known), 1), tfs)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), *lists], names=["doc_id", "n", "terms", "tfs"])

    return map_texts(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t")), rows, COUNTS)


def _merge(item: np.ndarray, known: np.ndarray, doc: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Of (item, document, score) the k best of each item: by score, known documents first, by document."""
    order = np.lexsort((doc, ~known, -score, item))
    item, known, doc, score = item[order], known[order], doc[order], score[order]
    begins = np.flatnonzero(np.append(True, item[1:] != item[:-1])[: len(item)])
    rank = np.arange(len(item)) - np.repeat(begins, np.diff(np.append(begins, len(item))))
    best = rank < k
    return item[best], known[best], doc[best], score[best]


class Tiles:
    """Items in tiles, each with the weights of its compact vocabulary. ``items``: the term numbers of each item; ``weights``: of each term."""

    def __init__(self, items: list[np.ndarray], weights: np.ndarray, k: int, item_tile: int = ITEM_TILE, term_tile: int = TERM_TILE):
        self.k, self.n_terms = k, len(weights)
        width = max(1, min(term_tile, (2**53 - 1) // (MOST_IMPACT * max(1, int(weights.max(initial=1))))))
        self.tiles = []
        for first in range(0, len(items), item_tile):
            own = items[first : first + item_tile]
            compact = np.unique(np.concatenate([*own, np.zeros(0, np.int64)]))
            for_terms = []
            for at in range(0, len(compact), width):
                part = compact[at : at + width]
                w = np.zeros((len(own), len(part)))
                for i, terms in enumerate(own):
                    w[i, np.searchsorted(part, terms[np.isin(terms, part)])] = weights[terms[np.isin(terms, part)]]
                for_terms.append((part, w))
            self.tiles.append((first, len(own), for_terms))

    def scores(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, n_docs: int) -> Iterator[tuple[int, np.ndarray]]:
        """(first item, scores as items x documents) of each tile of items; (doc, term, impact) are the filled places of a tile of documents."""
        place = np.full(self.n_terms, -1, np.int64)
        for first, n_items, for_terms in self.tiles:
            total = np.zeros((n_items, n_docs), np.int64)
            for part, w in for_terms:
                place[part] = np.arange(len(part))
                row = place[term]
                place[part] = -1
                dense = np.zeros((len(part), n_docs))
                dense[row[row >= 0], doc[row >= 0]] = impact[row >= 0]
                total += (w @ dense).astype(np.int64)
            yield first, total

    def best(self, tiles: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, ...]:
        """(item, known, doc, score): the k best of each item over tiles of documents given as (known, id, doc, term, impact)."""
        none = np.zeros(0, np.int64)
        kept = none, none.astype(bool), none, none
        for known, ids, doc, term, impact in tiles:
            least = np.zeros(sum(n for _, n, _ in self.tiles), np.int64)
            full = np.bincount(kept[0], minlength=len(least)) == self.k
            ends = np.searchsorted(kept[0], np.arange(len(least)), "right")
            least[full] = kept[3][ends[full] - 1]
            found = [kept]
            for first, s in self.scores(doc, term, impact, len(ids)):
                floor = np.maximum(1, least[first : first + len(s)])
                if len(ids) > self.k:
                    floor = np.maximum(floor, np.partition(s, len(ids) - self.k, axis=1)[:, len(ids) - self.k])
                item, at = np.nonzero(s >= floor[:, None])
                found.append((item + first, known[at], ids[at], s[item, at]))
            kept = _merge(*(np.concatenate(x) for x in zip(*found)), self.k)
        return kept


def _shards(items: DataFrame, item_col: str, text_col: str, max_words: int) -> tuple[DataFrame, int]:
    """The items' rows (item, t, shard), stored, and the number of shards."""
    rows = items.select(F.col(item_col).alias("item"), F.col(text_col).alias("t")).where("t IS NOT NULL")
    n = rows.agg(F.sum(F.floor((F.octet_length("t") + 1) / 2))).first()[0] or 0
    shards = -(-int(n) // max_words)
    return stored(rows.withColumn("shard", F.pmod(F.xxhash64("item"), F.lit(max(1, shards))).cast("int")), "items"), shards


def rank(
    docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", max_words: int = MAX_WORDS, item_tile: int = ITEM_TILE, doc_tile: int = DOC_TILE, term_tile: int = TERM_TILE
) -> DataFrame:
    """(item, rank, doc_id, score): the k documents of highest score above 0 of each item."""
    spark = docs.sparkSession
    kind = items.schema[item_col].dataType
    rows, shards = _shards(items, item_col, item_text_col, max_words)
    out = None
    for shard in range(shards):
        texts: dict = {}
        for r in rows.where(F.col("shard") == shard).select("item", "t").collect():  # about max_words words
            texts.setdefault(r["item"], set()).update(words_of(r["t"].encode()))
        if not any(texts.values()):
            continue
        found = _rank_shard(spark, docs, texts, kind, k, id_col, text_col, item_tile, doc_tile, term_tile)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], "item string, rank int, doc_id long, score long").withColumn("item", F.col("item").cast(kind))


def _rank_shard(spark: SparkSession, docs: DataFrame, texts: dict, kind, k: int, id_col: str, text_col: str, item_tile: int, doc_tile: int, term_tile: int) -> DataFrame:
    vocabulary = sorted(set().union(*texts.values()))
    number = {t: i for i, t in enumerate(vocabulary)}
    counts = stored(term_counts(docs, vocabulary, id_col, text_col), "counts")
    n_docs, n_all = counts.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(vocabulary), np.int64)
    for r in counts.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # a row for each term of the shard at most
        df[r["term"]] = r["count"]
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) if x else 0 for x in df], np.int64)
    names = list(texts)
    tiles = Tiles([np.array(sorted(number[t] for t in texts[x] if df[number[t]]), np.int64) for x in names], weights, k, item_tile, term_tile)
    held, arrow = spark.sparkContext.broadcast((tiles, names)), to_arrow_type(kind)

    def tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        for whole in batches:
            for at in range(0, whole.num_rows, doc_tile):
                ids, m, terms, tfs = whole.slice(at, doc_tile).columns
                ends = np.asarray(terms.offsets).astype(np.int64)
                flat, tf = np.asarray(terms.flatten()).astype(np.int64), np.asarray(tfs.flatten()).astype(np.int64)
                doc = np.repeat(np.arange(len(ids)), np.diff(ends))
                yield ~np.asarray(ids.is_null()), np.asarray(ids.fill_null(0)), doc, flat, 10**9 * tf // (1000 * tf + 20 * np.asarray(m)[doc])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles, names = held.value
        item, known, doc, score = tiles.best(tiled(batches))
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(names, arrow).take(pa.array(item)), pa.array(doc, mask=~known), pa.array(score)], names=["at", "item", "doc_id", "score"])

    # Products of 64 bits could overflow here for very long texts in very large corpora.
    m = F.expr(f"CAST(50 + (CAST(50 * n AS DECIMAL(20, 0)) * {n_docs} div {max(n_all, 1)}) AS BIGINT)").alias("m")
    schema = "at int, item string, doc_id long, score long".replace("string", kind.simpleString())
    found = counts.where(F.size("terms") > 0).select("doc_id", m, "terms", "tfs").mapInArrow(best, schema)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    bucket = found.withColumn("bucket", F.spark_partition_id() % 64)
    first = bucket.withColumn("rank", F.row_number().over(Window.partitionBy("at", "bucket").orderBy(*order))).where(F.col("rank") <= k)
    last = first.withColumn("rank", F.row_number().over(Window.partitionBy("at").orderBy(*order))).where(F.col("rank") <= k)
    return last.select("item", "rank", "doc_id", "score")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rank(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.withColumnRenamed("item", "item_id")


#: The same score as joins of term counts.
OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
i AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
  FROM benchmark),
size AS (SELECT count(*) FILTER (WHERE len(w) > 0) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_all FROM d),
tf AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) GROUP BY r, t),
weight AS (
  SELECT t, CAST(floor(1000 * ln(CAST(2 * any_value(n_docs) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM tf, size WHERE t IN (SELECT t FROM i) GROUP BY t),
m AS (SELECT r, doc_id, 50 + ((50 * CAST(len(w) AS BIGINT) * n_docs) // n_all) AS m FROM d, size WHERE len(w) > 0),
score AS (
  SELECT item_id, m.r, m.doc_id, CAST(sum(weight.w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
  FROM i JOIN tf USING (t) JOIN weight USING (t) JOIN m USING (r) GROUP BY ALL),
ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score FROM score WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 50
"""
