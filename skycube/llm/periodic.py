"""Periodic runs of words by recompression (operator 11).

A run is a stretch of words in which words ``period`` apart are identical, that no neighbouring
word extends, of at least ``least`` words and ``times`` periods. Runs are found exactly:

* The words of a batch of texts become one string of numbers, with a symbol of its own between
  texts, so nothing reaches across.
* The string is recompressed: level by level, blocks of one symbol or pairs of a left and a
  right symbol are replaced by one symbol each, so that equal stretches get equal symbols but for
  their ends. The levels are a run-length grammar of the string.
* How far two places agree, to the right or to the left, is read from the grammar: the places
  climb while their symbols agree, pass at most the rest of one block a level, and come down
  where the symbols differ. All queries of a batch climb together, and levels are built when the
  first of them gets there.
* A run of period q has two neighbours, q apart, on a grid of step max(least - q, (times - 1) q);
  the grids of all periods are a harmonic sum. Only places of the grid that agree are extended.
  Those inside a known run whose period divides q would give that run again and are left out.

A text is held in memory by one task, with about 60 bytes a word; texts share nothing, so there
is no shuffle and a lost executor costs its own tasks. Long texts lie in small batches.

Defined cases: a null text has no words and no runs, and its collapsed text is empty. Every row
gives a row, repeated rows too. Other columns are not read. No rows give no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import map_texts

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
FOUND = f"doc_id long, n_words long, runs {RUNS}, collapsed string"
#: Grid places that are extended at a time.
CHUNK = 1 << 18


def _named(keys: np.ndarray) -> np.ndarray:
    """Small numbers for equal keys."""
    return np.asarray(pc.dictionary_encode(pa.array(keys)).indices)


class Grammar:
    """A string and the levels above it. The symbols of its first and last place may not occur elsewhere.

    Symbols that occur once agree with nothing, so at the next level neighbours of that kind are one
    block, which occurs once too and needs no look-up.
    """

    def __init__(self, symbols: np.ndarray):
        self.symbols: list[np.ndarray] = []
        #: For each level: symbols from this number on occur once.
        self.once: list[int] = []
        self.pairs: list[bool] = []
        #: For each level but the last: the block above each place, and the first and last place of each block.
        self.above: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self._add(symbols, np.zeros(len(symbols), bool))

    def _add(self, names: np.ndarray, once: np.ndarray) -> None:
        """A level from small numbers; what occurs once, or is known to, gets the numbers after all others."""
        counts = np.bincount(names[~once])
        once = once | (counts[np.where(once, 0, names)] == 1) if len(counts) else once
        t = names.astype(np.int32)
        t[once] = len(counts) + np.arange(np.count_nonzero(once))
        self.symbols.append(t)
        self.once.append(len(counts))

    def climb(self) -> None:
        """Builds the next level: blocks of one symbol if there are any and the last level made pairs, else pairs."""
        t, n_names = self.symbols[-1], self.once[-1]
        once = t >= n_names
        pairs = bool(self.pairs) and not self.pairs[-1]
        apart = ~(once[1:] & once[:-1])
        if not pairs:
            equal = t[1:] == t[:-1]
            pairs = not equal.any()
        if pairs:
            side = np.random.default_rng(len(self.above)).integers(0, 2, n_names + 1).astype(np.int8)[np.minimum(t, n_names)]
            side[once] = 2
            # What occurs once is a right symbol, whichever side is the left one.
            either = (side[:-1] == 0) & (side[1:] != 0), (side[:-1] == 1) & (side[1:] != 1)
            apart &= ~max(either, key=np.count_nonzero)
        else:
            apart &= ~equal
        begins = np.append(True, apart)
        first = np.flatnonzero(begins).astype(np.int32)
        last = np.append(first[1:], len(t)).astype(np.int32) - np.int32(1)
        known = ~once[first] & ~once[last]
        low, size, end = t[first[known]].astype(np.int64), (last - first)[known], t[last[known]]
        keys = low * (n_names + 1) + np.where(size > 0, end + 1, 0) if pairs else low * (int(size.max(initial=0)) + 1) + size
        names = np.zeros(len(first), np.int32)
        names[known] = _named(keys)
        self.pairs.append(pairs)
        self.above.append(((np.cumsum(begins) - 1).astype(np.int32), first, last))
        self._add(names, ~known)

    def agree(self, a: np.ndarray, b: np.ndarray, step: int) -> np.ndarray:
        """How many symbols from each place in ``a`` on equal those from ``b`` on; step 1 goes right, -1 left. a and b differ."""
        at_a, at_b, level_of = a.copy(), b.copy(), np.zeros(len(a), np.int32)
        live, x, y, level = np.arange(len(a)), a, b, 0

        def halt(which: np.ndarray) -> None:
            nonlocal live, x, y
            gone = live[which]
            at_a[gone], at_b[gone], level_of[gone] = x[which], y[which], level
            live, x, y = live[~which], x[~which], y[~which]

        while True:
            t = self.symbols[level]
            halt(t[x] != t[y])
            if not len(live):
                break
            if level == len(self.above):
                self.climb()
            up, first, last = self.above[level]
            p, q = up[x], up[y]
            if step > 0:
                rest_x, rest_y, whole = last[p] - x + 1, last[q] - y + 1, (first[p] == x) & (first[q] == y)
            else:
                rest_x, rest_y, whole = x - first[p] + 1, y - first[q] + 1, (last[p] == x) & (last[q] == y)
            # Where one of the places is within its block, the rests of both blocks are the same symbol.
            move = np.where(whole, 0, step * np.minimum(rest_x, rest_y))
            x, y = x + move, y + move
            halt(~whole & (rest_x != rest_y))
            x, y, level = up[x], up[y], level + 1
        for level in range(int(level_of.max(initial=0)) - 1, -1, -1):
            down = np.flatnonzero(level_of > level)
            (_, first, last), t = self.above[level], self.symbols[level]
            p, q = at_a[down], at_b[down]
            x, y = (first[p], first[q]) if step > 0 else (last[p], last[q])
            # Different symbols above: at most the first symbol of a pair, or the shorter block, is common.
            common = 1 if self.pairs[level] else np.minimum(last[p] - first[p], last[q] - first[q]) + 1
            move = np.where(t[x] == t[y], step * common, 0)
            at_a[down], at_b[down] = x + move, y + move
        return np.abs(at_a - a)


def _grid(t: np.ndarray, ends: np.ndarray, lengths: np.ndarray, least: int, times: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, periods) of the grids where the words one period apart agree; a new batch for each doubling of the period, or sooner.

    ``ends`` and ``lengths`` are of texts in falling order of length.
    """
    held, n, high = [], 0, 2
    for q in range(1, int(lengths[0]) // times + 1 if len(lengths) else 0):
        if held and (q >= high or n >= CHUNK):
            yield np.concatenate([p for p, _ in held]), np.repeat([q for _, q in held], [len(p) for p, _ in held])
            held, n = [], 0
        high = high * 2 if q >= high else high
        texts = int(np.searchsorted(-lengths, -max(least, times * q), "right"))
        if not texts:
            break
        step = max(least - q, (times - 1) * q)
        there = t[1 + q : ends[texts - 1] + q : step]
        places = np.flatnonzero(t[1 : ends[texts - 1] : step][: len(there)] == there)
        if len(places):
            held.append((1 + step * places, q))
            n += len(places)
    if held:
        yield np.concatenate([p for p, _ in held]), np.repeat([q for _, q in held], [len(p) for p, _ in held])


def runs_of(texts: list[np.ndarray], least: int = 24, times: int = 3) -> list[np.ndarray]:
    """For each text, given as numbers of its words, its runs as rows (start, length, period), by start, then period."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    lengths = np.array([len(texts[i]) for i in order], np.int64)
    begins = np.cumsum(lengths + 1) - lengths
    t = np.empty(int(lengths.sum()) + len(texts) + 1, np.int32)
    base = max((int(x.max()) for x in texts if len(x)), default=0) + 1
    t[0] = base
    for k, (i, at) in enumerate(zip(order, begins)):
        t[at : at + len(texts[i])] = texts[i]
        t[at + len(texts[i])] = base + 1 + k
    grammar, found = Grammar(t), np.zeros((0, 3), np.int64)
    until, every = np.zeros(len(t), np.int32), np.ones(len(t), np.int32)  # of a known run at each place: its end and period
    for place, q in _grid(t, begins + lengths, lengths, least, times):
        new = (until[place] <= place + q) | (q % every[place] != 0)
        place, q = place[new].astype(np.int32), q[new].astype(np.int32)
        left = grammar.agree(place - 1, place + q - 1, -1)
        start, length = place - left, left + q + grammar.agree(place, place + q, 1)
        keep = length >= np.maximum(least, times * q)
        rows = np.unique(np.stack([start[keep], length[keep], q[keep]], axis=1).astype(np.int64), axis=0)
        # Of one stretch the smallest period is the run's; the others are multiples of it.
        found = np.concatenate([found, rows[np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1))[: len(rows)]]])
        for s, n, p in found[len(found) - len(rows) :]:
            until[s : s + n], every[s : s + n] = s + n, p
    found = found[np.lexsort(found.T[::-1])]
    found = found[np.append(True, (found[1:, :2] != found[:-1, :2]).any(axis=1))[: len(found)]]
    found = found[np.lexsort((found[:, 2], found[:, 0]))]
    own = np.searchsorted(begins, found[:, 0], "right") - 1
    out = [np.zeros((0, 3), np.int64)] * len(texts)
    for k in np.unique(own):
        rows = found[own == k]
        rows[:, 0] -= begins[k]
        out[order[k]] = rows
    return out


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 24, times: int = 3, edit: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row; collapsed keeps of each run its first period, words joined by one space.

    ``edit`` may change the words of a text before runs are sought.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            words = [(x.as_py() or b"").split() for x in batch.column(1).cast(pa.binary())]
            if edit:
                words = [edit(i, w) for i, w in zip(ids, words)]
            ends = np.cumsum([0, *map(len, words)])
            numbers = _named(pa.array([w for x in words for w in x], pa.binary()))
            found = runs_of([numbers[a:b] for a, b in zip(ends, ends[1:])], least, times)
            left = []
            for own, runs in zip(words, found):
                if len(runs):
                    gone = np.zeros(len(own) + 1, np.int64)
                    np.add.at(gone, runs[:, 0] + runs[:, 2], 1)
                    np.add.at(gone, runs[:, 0] + runs[:, 1], -1)
                    own = compress(own, np.cumsum(gone) == 0)
                left.append(b" ".join(own))
            flat = np.concatenate([*found, np.zeros((0, 3), np.int64)])
            structs = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], names=["start", "length", "period"])
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), structs)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(ends)), lists, pa.array(left, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    return map_texts(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t")), rows, FOUND)


def repeat_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words, of which one document in ten gets a periodic end: the query's rule, from crc32 of doc_id. No doc_id: as they are."""
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * -(-(n - a) // p))[: n - a]


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"), edit=repeat_tail)
    runs = F.col("runs")
    # Runs come by start and period, so only a greater length / period replaces what stands.
    best = F.aggregate(F.slice(runs, F.lit(2), F.greatest(F.size(runs) - 1, F.lit(0))), F.get(runs, F.lit(0)), lambda a, x: F.when(x["length"] * a["period"] > a["length"] * x["period"], x).otherwise(a))
    lines = F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    rows = found.select("doc_id", F.size(runs).cast("long").alias("n_runs"), best.alias("b"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return rows.select("doc_id", "n_runs", "b.start", "b.length", "b.period", F.expr("1000 * b.length div b.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
