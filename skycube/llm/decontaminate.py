"""Benchmark decontamination with a generalised suffix automaton (operator 8).

The automaton holds every run of words of every test item. A document's words are streamed
through it; the length of the longest match that ends at each word tells which words lie in a
copied window. A word outside the items' vocabulary resets the automaton, so only runs of known
words that could hold a window are stepped through.

The items are dealt by a hash into shards of about ``max_words`` words. Each shard's automaton is
built in a task and stored in the shared folder; one at a time is broadcast, and the documents
pass through it. Between two passes their hits are stored and the automaton is let go, so the
driver and every worker hold one automaton whatever the benchmark's size. Most benchmarks are
one shard, and then nothing is stored.

Only texts go to Python; hits and, where there are some, the places to cut come back.

Defined cases: a null or empty document has no words and no hits. Null or wordless items match
nothing; a null item_id stands as ``null``. Item rows with one id count as one item. Repeated
documents keep a row each. Without items or documents nothing is hit.
"""

from __future__ import annotations

import pickle
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import fresh, judge_texts, stored

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
RUNS = "array<struct<start:long,end:long>>"
MATCHED = f"n_words long, hits {RUNS}, cuts {RUNS}, items array<string>"

_fold = bytearray(range(256))
for _c in range(128):
    _fold[_c] = _c + 32 if 65 <= _c <= 90 else _c if 48 <= _c <= 57 or 97 <= _c <= 122 else 32
FOLD = bytes(_fold)


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words of a UTF-8 text."""
    return text.translate(FOLD).split()


class _Vocabulary(dict):
    def __missing__(self, key):
        return -1


class Automaton:
    """Generalised suffix automaton of word sequences."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = 10):
        self.window = window
        self.vocabulary = _Vocabulary()
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = []
        for name, words in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
            if ids:
                coded.append((name, ids))
                self._add(ids)
        self.items: dict[int, set[str]] = {}  # state of a window: the items with it
        self.short: dict[int, list[tuple[int, str]]] = {}  # state of a whole short item
        self.least = min([window, *(len(ids) for _, ids in coded)])
        for name, ids in coded:
            for _, length, state in self._walk(ids):
                if length >= window:
                    self.items.setdefault(self._at(state, window), set()).add(name)
            if len(ids) < window:
                self.short.setdefault(self._at(state, len(ids)), []).append((len(ids), name))
        # The nearest state with a short item on the way to the root, itself included.
        self.near = [-1] * len(self.link)
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            self.near[s] = s if s in self.short else self.near[self.link[s]]

    def _add(self, ids: list[int]) -> None:
        nxt, link, length = self.next, self.link, self.length
        last = 0

        def clone(p: int, c: int, q: int) -> int:
            k = len(nxt)
            nxt.append(dict(nxt[q]))
            link.append(link[q])
            length.append(length[p] + 1)
            link[q] = k
            while p >= 0 and nxt[p].get(c) == q:
                nxt[p][c] = k
                p = link[p]
            return k

        for c in ids:
            q = nxt[last].get(c)
            if q is not None:
                last = q if length[q] == length[last] + 1 else clone(last, c, q)
                continue
            cur = len(nxt)
            nxt.append({})
            link.append(0)
            length.append(length[last] + 1)
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                link[cur] = q if length[q] == length[p] + 1 else clone(p, c, q)
            last = cur

    def _at(self, state: int, length: int) -> int:
        """The state of the suffix of that length."""
        while self.length[self.link[state]] >= length:
            state = self.link[state]
        return state

    def _walk(self, ids: list[int]) -> Iterator[tuple[int, int, int]]:
        """Position, length and state of the longest match that ends at each word."""
        nxt, link, length = self.next, self.link, self.length
        state = n = 0
        for i, c in enumerate(ids):
            while state and c not in nxt[state]:
                state = link[state]
                n = length[state]
            if c in nxt[state]:
                state = nxt[state][c]
                n += 1
            yield i, n, state

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Disjoint [first, end) runs of hit words, in order; the items with occurring windows."""
        if not self.vocabulary or len(words) < self.least:
            return [], set()
        ids = np.fromiter(map(self.vocabulary.__getitem__, words), np.int32, len(words))
        gap = np.flatnonzero(ids < 0)
        begin, end = np.append(0, gap + 1), np.append(gap, len(ids))
        long = end - begin >= self.least
        marks: list[tuple[int, int]] = []
        states, names = set(), set()
        for b, e in zip(begin[long].tolist(), end[long].tolist()):
            for i, n, state in self._walk(ids[b:e].tolist()):
                if n >= self.window:
                    marks.append((b + i + 1 - self.window, b + i + 1))
                    states.add(self._at(state, self.window))
                s = self.near[state]
                while s > 0:
                    for m, name in self.short[s]:
                        if m <= n:
                            marks.append((b + i + 1 - m, b + i + 1))
                            names.add(name)
                    s = self.near[self.link[s]]
        return join_runs(marks), names.union(*(self.items[s] for s in states))


def join_runs(marks: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of intervals; touching ones become one."""
    out: list[list[int]] = []
    for a, b in sorted(marks):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def automata(items: DataFrame, window: int = 10, id_col: str = "item_id", text_col: str = "text", max_words: int = 400_000) -> DataFrame:
    """(shard, automaton): a stored, pickled automaton for each shard of items."""
    rows = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("i"), F.col(text_col).alias("t")).where("t is not null")
    # Every word but the last is followed by another character.
    most = rows.agg(F.sum(F.length("t") / 2 + 1)).first()[0] or 0
    if most > max_words:
        most = rows.agg(F.sum(F.regexp_count("t", F.lit(WORD.pattern)))).first()[0]
    shards = max(1, -(-int(most) // max_words))
    rows = rows.select(F.pmod(F.xxhash64("i", "t"), F.lit(shards)).cast("int").alias("shard"), "i", "t").repartition(shards, "shard")

    def built(_: tuple, texts: pa.Table) -> pa.Table:
        named = zip(texts["i"].to_pylist(), texts["t"].to_pylist())
        automaton = Automaton([(i, words_of(t.encode())) for i, t in named], window)
        return pa.table({"shard": texts["shard"].slice(0, 1), "automaton": pa.array([pickle.dumps(automaton, 5)], pa.binary())})

    return stored(rows.groupBy("shard").applyInArrow(built, "shard int, automaton binary"), "automata")


def _word_spans(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in WORD.finditer(text.encode().translate(_LOWER).decode())]


_loaded: dict[str, Automaton] = {}


def _load(name: str, held: Broadcast) -> Automaton:
    """The worker's only automaton, kept from task to task."""
    if name not in _loaded:
        _loaded.clear()
        _loaded[name] = pickle.loads(held.value)
    return _loaded[name]


def _through(text: Column, held: Broadcast, spark: SparkSession) -> Column:
    """The struct ``MATCHED`` of a text: runs of hit words by word and by character, items with windows in it."""
    mark = uuid.uuid4().hex

    def judged(texts: list[str]) -> list[dict]:
        match, out = _load(mark, held).match, []
        for text in texts:
            words = words_of(text.encode())
            runs, found = match(words)
            spans = _word_spans(text) if runs else []
            out.append({"n_words": len(words), "hits": [{"start": a, "end": b} for a, b in runs], "cuts": [{"start": spans[a][0], "end": spans[b - 1][1]} for a, b in runs], "items": sorted(found)})
        return out

    return judge_texts(text, judged, MATCHED, spark)


def union_of_runs(runs: Column) -> Column:
    """Runs, sorted, of which overlapping and touching ones are one. Few runs: those of one text."""

    def add(done: Column, x: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        joins = (F.size(done) > 0) & (x["start"] <= last["end"])
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        return F.when(joins, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(F.array_sort(runs), F.expr(f"cast(array() as {RUNS})"), add)


def matched(docs: DataFrame, items: DataFrame, window: int = 10, text_col: str = "text", **limits) -> DataFrame:
    """All columns of ``docs`` and a struct ``MATCHED`` named __match (with more underscores if ``docs`` has such a name).

    After several shards, runs of different shards that touch are one run of hits.
    """
    spark = docs.sparkSession
    shards = automata(items, window, **limits)
    keys = sorted(r.shard for r in shards.select("shard").collect())
    name, old = fresh(docs, "__match", "__old")
    out = docs
    for k, key in enumerate(keys or [None]):
        # One automaton at a time, of a size that max_words bounds.
        held = spark.sparkContext.broadcast(bytes(shards.where(F.col("shard") == key).first().automaton) if keys else pickle.dumps(Automaton([], window)))
        if not k:
            out = docs.withColumn(name, _through(F.col(text_col), held, spark))
        else:
            new = out.withColumnRenamed(name, old).withColumn(name, _through(F.col(text_col), held, spark))
            both = {f: F.concat(F.col(old)[f], F.col(name)[f]) for f in ("hits", "cuts", "items")}
            merged = F.struct(F.col(name)["n_words"].alias("n_words"), union_of_runs(both["hits"]).alias("hits"), union_of_runs(both["cuts"]).alias("cuts"), F.array_sort(F.array_distinct(both["items"])).alias("items"))
            touched = (F.size(F.col(old)["hits"]) > 0) & (F.size(F.col(name)["hits"]) > 0)
            kept = F.when(touched, merged).when(F.size(F.col(name)["hits"]) > 0, F.col(name)).otherwise(F.col(old))
            out = new.withColumn(name, kept).drop(old)
        if len(keys) > 1:
            out = stored(out, "hits")
            held.destroy()
    return out


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, max_coverage: float = 0.5, text_col: str = "text", **limits) -> DataFrame:
    """The documents without copied test passages, with the columns of ``docs``.

    Every run of hit words is cut out of the text; it covers a window or a whole shorter item,
    however short the item is. A document of which more
    than ``max_coverage`` of the words are hit, or of which no word is left, goes. Others stay
    as they are. A column n_chars follows the text.
    """
    (name,) = fresh(docs, "__match")
    found, x = matched(docs, items, window, text_col, **limits), F.col(name)
    n_hit = F.aggregate(x["hits"], F.lit(0).cast("long"), lambda a, r: a + r["end"] - r["start"])
    found = found.where((n_hit == 0) | ((n_hit <= max_coverage * x["n_words"]) & (n_hit < x["n_words"])))
    # What lies before, between and after the cuts.
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform(x["cuts"], lambda r: r["end"]))
    ends = F.concat(F.transform(x["cuts"], lambda r: r["start"]), F.array(F.length(text_col).cast("long")))
    left = F.zip_with(starts, ends, lambda a, b: F.substr(F.col(text_col), (a + 1).cast("int"), (b - a).cast("int")))
    text = F.when(n_hit > 0, F.array_join(left, "")).otherwise(F.col(text_col))
    n_chars = {c: F.when(n_hit > 0, F.length(text).cast(docs.schema[c].dataType)).otherwise(F.col(c)).alias(c) for c in docs.columns if c == "n_chars"}
    return found.select(*[text.alias(c) if c == text_col else n_chars.get(c, F.col(c)) for c in docs.columns])


_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """One row for each document: its words, hit words, and the items with windows in it."""
    found = matched(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), items, window, **limits)
    x = F.col("__match")
    return found.select(
        "doc_id",
        x["n_words"].alias("n_words"),
        F.aggregate(x["hits"], F.lit(0).cast("long"), lambda a, r: a + r["end"] - r["start"]).alias("n_hit"),
        F.size(x["items"]).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", x["items"]), 256).alias("items_sha256"),
        (F.size(x["hits"]) > 0).alias("contaminated"),
    )


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: Words of both tables, windows of the items, and document positions that equal a window.
OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
i AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
win AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[k : k + least(len(w), 10) - 1], ' ') AS g
  FROM i, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS t(k) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM win),
hit AS (
  SELECT p.doc_id, p.k, p.n, win.item
  FROM (SELECT doc_id, k, n, array_to_string(w[k : k + n - 1], ' ') AS g
        FROM d, sizes, unnest(generate_series(1, len(w) - n + 1)) AS t(k) WHERE len(w) >= n) p
  JOIN win ON p.n = win.n AND p.g = win.g),
word AS (
  SELECT doc_id, count(DISTINCT k + j) AS n_hit FROM hit, unnest(generate_series(0, n - 1)) AS t(j) GROUP BY doc_id),
item AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN word USING (doc_id) LEFT JOIN item USING (doc_id)
"""
