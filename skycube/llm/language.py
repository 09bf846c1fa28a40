"""Hierarchical language identification (operator 2).

Linear support vector machines on hashed character n-grams: one for each language family
against the rest, then one for each two languages of a family. A text goes to the family with
the largest margin, then to the language that wins most of its pairs. A margin is the mean of
the n-grams' weights over the whole text, so scoring is one pass of table look-ups.

The model is fitted on a bounded sample of labelled rows outside the held-out fold: the same
number for every language, ``max_sample`` (default 1200) in all but at least ``least_each``
(default 8) of each, chosen by a hash of doc_id and text; rows repeated as a whole count once.
No language is left out. Their n-gram counts are made where the texts lie; the driver sees
counts only, of at most max(max_sample, least_each * languages) texts.

Defined cases: a null text, or one without letters, is ``und`` with score 0. A null doc_id is
neither learned from nor held out. Rows without lang are not learned from. Without any
labelled row every text is ``und``; with one language every text with letters is that
language. Ties go to the name that sorts first. Repeated rows keep a row each.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import fresh, judge_texts, map_texts

DIMS_BITS = 14
DIMS = 1 << DIMS_BITS
GRAMS = 4
UND = "und"
# Families of common languages by ISO 639-1 code. Any other is its own family.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr tt uz",
    "indic": "bn gu hi mr ne pa sa si ur",
    "iranian": "fa ku ps tg",
    "semitic": "am ar he mt",
    "austronesian": "id jv ms su tl",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """Lower-case code point of every letter, 32 for all else."""
    global _letters
    if _letters is None:
        _letters = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            if unicodedata.category(x := chr(c))[0] == "L":
                low = x.lower()
                _letters[c] = ord(low) if len(low) == 1 else c
    return _letters


def grams(texts: list[str]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Ends of the texts; for each n the bucket of the n-gram at each place (DIMS for none); letters of each text."""
    codes = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le"), np.uint32)
    edges = np.cumsum(np.fromiter((len(x) + 1 for x in texts), np.int64, len(texts))) - 1
    c = letters().take(codes)
    c[edges] = 0
    solid = c != 32
    keep = solid.copy()
    keep[1:] |= solid[:-1] & (c[:-1] != 0)  # one blank after a word, none at a text's start
    c = c[keep]
    ends = np.flatnonzero(c == 0)
    n_letters = np.diff(np.cumsum((c != 0) & (c != 32))[ends], prepend=0)
    h, out = np.zeros(len(c), np.uint32), []
    for n in range(1, GRAMS + 1):
        # The n-gram that ends here: fold the code n-1 places back into the hash.
        h[n - 1 :] = (h[n - 1 :] ^ c[: len(c) - n + 1]) * np.uint32(0x9E3779B1) + np.uint32(n)
        bucket = ((h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA77) >> np.uint32(32 - DIMS_BITS)).astype(np.int32)
        bucket[ends] = DIMS
        for k in range(min(n - 1, len(c))):
            at = np.append(-1, ends[:-1]) + 1 + k
            bucket[np.minimum(at, ends)] = DIMS
        out.append(bucket)
    return ends, out, n_letters


class Model(NamedTuple):
    families: list[list[str]]  # languages of each family, sorted
    pairs: list[tuple[int, int, int]]  # family, two of its languages
    weights: np.ndarray  # DIMS + 1 rows; the last is zero
    bias: np.ndarray
    slope: np.ndarray  # margins to log-odds


def fit_svm(gram: np.ndarray, y: np.ndarray, rounds: int = 150, c: float = 10.0) -> tuple[np.ndarray, float]:
    """Squared-hinge linear SVM by accelerated gradient steps, on the rows' inner products.

    Gives each row's coefficient in the weight vector, and the bias. y is +1 or -1; classes weigh the same.
    """
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    a, b = np.zeros(len(y)), 0.0
    norm = float((weight * (np.diag(gram) + 1)).sum()) * 2 * c + 1
    va, vb, last = a, b, (a, b)
    for k in range(rounds):
        gap = weight * np.maximum(0, 1 - y * (gram @ va + vb)) * y
        a, b = va - (va - 2 * c * gap) / norm, vb + 2 * c * gap.sum() / norm
        m = k / (k + 3)
        va, vb, last = a + m * (a - last[0]), b + m * (b - last[1]), (a, b)
    return a, float(b)


def fit(x: np.ndarray, langs: list[str]) -> Model | None:
    """x: n-gram shares of the sample's texts; it is scaled in place."""
    names = sorted(set(langs))
    if not names:
        return None
    groups: dict[str, list[str]] = {}
    for name in names:
        groups.setdefault(_FAMILY.get(name, name), []).append(name)
    families = sorted(groups.values())
    label = np.array(langs)
    mean = x.mean(0)
    std = np.sqrt(np.maximum(np.einsum("ij,ij->j", x, x) / len(x) - mean * mean, 0))
    scale = (1 / np.maximum(std, 1e-4)).astype(np.float32)
    x *= scale
    size = np.float32(max(1e-9, float(np.sqrt(np.einsum("ij,ij->", x, x, dtype=float) / len(x)))))
    x /= size
    scale /= size
    gram = (x @ x.T).astype(float)
    pairs = [(f, i, j) for f, group in enumerate(families) for i, j in combinations(range(len(group)), 2)]
    tasks = [(np.ones(len(label), bool), np.where(np.isin(label, group), 1.0, -1.0)) for group in families]
    for f, i, j in pairs:
        here = np.isin(label, [families[f][i], families[f][j]])
        tasks.append((here, np.where(label == families[f][i], 1.0, -1.0)))
    weights, bias, slope = np.zeros((DIMS + 1, len(tasks)), np.float32), [], []
    for k, (rows, y) in enumerate(tasks):
        if len(families) == 1 and k == 0:
            bias.append(1.0)
            slope.append(1.0)
            continue
        inner = gram[np.ix_(rows, rows)]
        coefficient, b = fit_svm(inner, y[rows])
        margin = float(np.median(np.abs(inner @ coefficient + b)))
        every = np.zeros(len(x), np.float32)
        every[rows] = coefficient
        weights[:DIMS, k] = (every @ x) * scale
        bias.append(b)
        slope.append(4 / max(margin, 1e-6))  # the median of the sample is at odds of e**4
    return Model(families, pairs, weights, np.array(bias), np.array(slope))


def margins(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    ends, buckets, n_letters = grams(texts)
    begin = np.append(0, ends[:-1] + 1)
    total = np.zeros((len(texts), model.weights.shape[1]))
    n = np.zeros(len(texts), np.int64)
    for b in buckets:
        total += np.add.reduceat(model.weights.take(b, axis=0), begin, axis=0)
        n += np.add.reduceat((b != DIMS).astype(np.int64), begin)
    return total / np.maximum(n, 1)[:, None] + model.bias, n_letters


def decide(model: Model, m: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The language and a score from 0 to 1 of each row of margins."""
    odds = np.clip(m * model.slope, -30, 30)
    fam = odds[:, : len(model.families)]
    best = fam.argmax(1)
    share = np.exp(fam - fam.max(1, keepdims=True))
    score = (1 / share.sum(1)) if len(model.families) > 1 else np.ones(len(m))
    chance = 1 / (1 + np.exp(-odds[:, len(model.families) :]))
    names = np.empty(len(m), object)
    for f, group in enumerate(model.families):
        rows = np.flatnonzero(best == f)
        wins, least = np.zeros((len(rows), len(group))), np.ones((len(rows), len(group)))
        for k, (g, i, j) in enumerate(model.pairs):
            if g == f:
                p = chance[rows, k]
                wins[:, i] += p >= 0.5
                wins[:, j] += p < 0.5
                least[:, i] = np.minimum(least[:, i], p)
                least[:, j] = np.minimum(least[:, j], 1 - p)
        pick = (wins + least * 0.5).argmax(1)
        names[rows] = np.array(group, object)[pick]
        score[rows] *= least[np.arange(len(rows)), pick]
    return names.tolist(), score


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_sample: int = 1200, least_each: int = 8) -> Model | None:
    rows = docs.select(F.col(id_col).alias("d"), F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("l")).where(F.col("t").isNotNull() & F.col("l").isNotNull() & ~held_out(F.col("d")))
    rows = rows.withColumn("p", F.xxhash64(F.col("d").cast("string"), F.lit("sample"), F.col("t")))
    # Different rows of each language, about: the share taken below holds more than needed, and the rest is cut.
    counts = {r.l: r.n for r in rows.groupBy("l").agg(F.approx_count_distinct("p").alias("n")).collect()}
    if not counts:
        return None
    each = max(least_each, max_sample // len(counts))
    shares = {lang: min(1.0, 1.2 * (each + 3 * each**0.5 + 5) / n) for lang, n in counts.items()}
    limit = F.create_map(*[F.lit(x) for lang, share in sorted(shares.items()) for x in (lang, int((1 << 30) * share))])[F.col("l")]

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, place, text in zip(*(batch.column(i) for i in range(3))):
                _, buckets, n_letters = grams([text.as_py()])
                if n_letters[0]:
                    found = np.bincount(np.concatenate(buckets), minlength=DIMS + 1)[:DIMS]
                    at = np.flatnonzero(found)
                    share = (found[at] / found.sum()).astype(np.float32)
                    yield pa.RecordBatch.from_arrays([pa.array([lang.as_py()]), pa.array([place.as_py()]), pa.array([at.astype(np.int32)], pa.list_(pa.int32())), pa.array([share], pa.list_(pa.float32()))], names=["l", "place", "at", "share"])

    # The hash tells different rows apart, so repeated ones meet before anything goes to the driver.
    chosen = rows.where(F.pmod("p", F.lit(1 << 30)) < limit).groupBy("l", "p").agg(F.first("t").alias("t"))
    sample = map_texts(chosen, features, "l string, place long, at array<int>, share array<float>").toArrow()
    if not sample.num_rows:
        return None
    names = np.array(sample["l"].to_pylist(), object).astype(str)
    chosen, seen = [], {}
    for i in np.lexsort([np.asarray(sample["place"]), names]).tolist():
        seen[names[i]] = seen.get(names[i], 0) + 1
        if seen[names[i]] <= each:
            chosen.append(i)
    # The only large array on the driver: max_sample rows of DIMS floats.
    x = np.zeros((len(chosen), DIMS), np.float32)
    at, share = sample["at"], sample["share"]
    for k, i in enumerate(chosen):
        x[k, np.asarray(at[i].values)] = np.asarray(share[i].values)
    del sample, at, share
    pa.default_memory_pool().release_unused()
    return fit(x, [str(names[i]) for i in chosen])


def identify(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and __lang, __score (with more underscores if ``docs`` has such names)."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def judged(texts: list[str]) -> list[dict]:
        model, out = held.value, []
        first, size = 0, 0
        for i, text in enumerate(texts):
            size += len(text)
            if size > 1 << 18 or i == len(texts) - 1:
                if model:
                    m, n_letters = margins(model, texts[first : i + 1])
                    out += [{"lang": x, "score": s} if ok else {"lang": UND, "score": 0.0} for x, s, ok in zip(*decide(model, m), n_letters > 0)]
                else:
                    out += [{"lang": UND, "score": 0.0}] * (i + 1 - first)
                first, size = i + 1, 0
        return out

    lang, score, both = fresh(docs, "__lang", "__score", "__both")
    found = docs.withColumn(both, judge_texts(F.col(text_col), judged, "lang string, score double", docs.sparkSession))
    return found.select(*docs.columns, F.col(both)["lang"].alias(lang), F.col(both)["score"].alias(score))


def keep_identified(docs: DataFrame, model: Model | None, min_score: float = 0.3, text_col: str = "text") -> DataFrame:
    """The documents whose language is told with ``min_score`` or more, columns as they were."""
    lang, score = fresh(docs, "__lang", "__score")
    return identify(docs, model, text_col).where((F.col(lang) != UND) & (F.col(score) >= min_score)).select(docs.columns)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs.select("doc_id", "text"), train(docs))
    return found.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"))
