"""Runs, ranked search and mixing against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest
from compare import SMALL
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skycube.llm import mixing, periodic, search
from skycube.llm.queries import QUERIES


def plain_runs(w, least=24, times=3):
    """Every period of every stretch, by comparing all words with those so far behind."""
    n, found = len(w), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, times * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda x: (x[0], x[2]))


stretch = st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=9), st.integers(1, 60)).map(lambda x: (x[0] * 60)[: x[1]])
words = st.lists(st.one_of(stretch, st.lists(st.integers(0, 99), max_size=5)), max_size=6).map(lambda x: [w for s in x for w in s])


@given(st.lists(words, max_size=5), st.sampled_from([(24, 3), (6, 3), (4, 2)]))
@settings(max_examples=200, deadline=None)
def test_runs_equal_brute_force(texts, rule):
    got = periodic.runs_of([np.array(t, np.int32) for t in texts], *rule)
    assert [[tuple(r) for r in x.tolist()] for x in got] == [plain_runs(t, *rule) for t in texts]


@given(words.filter(len), st.data())
@settings(max_examples=100, deadline=None)
def test_places_agree_as_far_as_their_words(text, data):
    t = np.array([100, *text, 101], np.int32)
    a = np.array(data.draw(st.lists(st.integers(1, len(t) - 2), min_size=1, max_size=20)), np.int32)
    b = np.array([data.draw(st.integers(1, len(t) - 2)) for _ in a], np.int32)
    a, b = a[a != b], b[a != b]
    far = lambda x, y, d: next(k for k in range(len(t)) if t[x + d * k] != t[y + d * k])
    grammar = periodic.Grammar(t)
    for d in (1, -1):
        assert grammar.agree(a, b, d).tolist() == [far(x, y, d) for x, y in zip(a.tolist(), b.tolist())]


def test_a_long_text_of_one_word_and_one_of_few():
    for text in (np.zeros(100_000, np.int32), np.resize(np.arange(997, dtype=np.int32), 100_000)):
        assert periodic.runs_of([text])[0].tolist() == [[0, 100_000, int(text.max()) + 1]]


def test_periodic_runs_query(spark):
    docs = pd.read_parquet(f"{SMALL}/documents.parquet")
    got, planted = {r.doc_id: r for r in QUERIES["op11_periodic_runs"](spark, SMALL).collect()}, 0
    assert len(got) == len(docs)
    for d, text in zip(docs.doc_id, docs.text):
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h = zlib.crc32(str(d).encode())
        if h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w, planted = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)], planted + 1
        runs, r = plain_runs(w), got[d]
        assert r.n_runs == len(runs) and r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=(None,) * 3)
        assert (r.start, r.length, r.period) == best and r.exponent_milli == (best[0] if best[0] is None else 1000 * best[1] // best[2])
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()
    assert planted > 5 and sum(r.n_runs for r in got.values()) >= planted / 2


def plain_rank(docs, items, k):
    words = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    own = [(d, Counter(words(t))) for d, t in docs]
    n_docs, n_all = sum(bool(c) for _, c in own), sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    terms = defaultdict(set)
    for i, t in items:
        terms[i] |= set(words(t))
    out = []
    for i, ts in terms.items():
        scored = []
        for d, c in own:
            m = 50 + (50 * sum(c.values()) * n_docs) // max(n_all, 1)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in ts if c[t])
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(i, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("max_words", [400_000, 40])
def test_search_equals_brute_force_with_many_ties(spark, max_words):
    r = random.Random(3)
    some = [f"w{i}" for i in range(30)] + ["Über", "漢字", "x1"]
    docs = [(d, " ".join(r.choice(some) for _ in range(r.choice([0, 1, 2, 2, 40]))).replace("w1", "W1,")) for d in [*range(400), None, None, 7]]
    items = [(i, " ".join(r.choice(some) for _ in range(r.randint(0, 12)))) for i in [*range(40), 3]]
    got = search.rank(
        spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), k=5, max_words=max_words, item_tile=7, doc_tile=16, term_tile=5
    )
    assert sorted(map(tuple, got.collect()), key=str) == plain_rank(docs, items, 5)


def test_products_stay_exact_at_the_largest_weights():
    weights = np.array([2**33, 3, 2**33 - 1, 1], np.int64)
    tiles = search.Tiles([np.arange(4), np.array([0, 2])], weights, 3)
    assert all(sum(w[i].sum() for i in range(len(w))) and w.max(initial=0) * search.MOST_IMPACT * w.shape[1] < 2**53 for _, _, parts in tiles.tiles for _, w in parts)
    doc, term = np.repeat(np.arange(5), 4), np.tile(np.arange(4), 5)
    impact = np.arange(20) * 49_999 + 1
    (_, s), = tiles.scores(doc, term, impact, 5)
    assert s.tolist() == [[sum(int(weights[t]) * int(impact[4 * d + t]) for t in ts) for d in range(5)] for ts in (range(4), (0, 2))]


def plain_targets(sizes, share, ratios, most):
    """Shares by weight, what is over shared anew until nothing is."""
    weight = {s: ratios[i % len(ratios)] for i, s in enumerate(sorted(sizes))}
    budget, full = share * sum(sizes.values()), set()
    while True:
        rest, w = budget - sum(most * sizes[s] for s in full), sum(weight[s] for s in sizes if s not in full)
        target = {s: most * sizes[s] if s in full else weight[s] * rest / w for s in sizes}
        over = {s for s in sizes if target[s] > most * sizes[s]}
        if not over:
            return target
        full |= over


@given(st.dictionaries(st.sampled_from([*"abcdefghij"]), st.integers(0, 1000), min_size=1), st.sampled_from([1.5, 0.3, 1.9]))
@settings(max_examples=25, deadline=None)
def test_targets_equal_sharing_anew(spark, sizes, share):
    got = {r.s: r.target for r in mixing.targets(spark.createDataFrame([*sizes.items()], "s string, source_size long"), share).collect()}
    want = plain_targets(sizes, share, (3, 1, 2), 2) if sum(sizes.values()) else dict.fromkeys(sizes, 0)
    assert got == pytest.approx(want)


def test_mix_meets_targets_and_prefers_weight(spark):
    r = random.Random(5)
    docs = [(i, "w " * r.choice([0, 1, 5, 90]), None if i % 7 == 0 else f"s{i % 3}") for i in range(3000)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    weights = df.select("doc_id", F.when(F.col("doc_id") % 2 == 0, 4.0).otherwise(F.lit(float("nan"))).alias("weight")).where("doc_id < 1500")
    # Far more of the last sources than others, so that the first are taken in part.
    got = mixing.mix(df, share=0.5, weights=weights).collect()
    by = defaultdict(list)
    for x in got:
        by[docs[x.doc_id][2]].append(x)
    for rows in by.values():
        assert sum(x["size"] for x in rows) == rows[0].source_size and sum(x.taken for x in rows) == math.floor(rows[0].target)
        assert sum(0 < x.taken % x["size"] for x in rows if x["size"]) <= 1
    share = lambda keep: (lambda rows: sum(x.taken for x in rows) / sum(x["size"] for x in rows))([x for x in got if keep(x.doc_id)])
    assert share(lambda d: d < 1500 and d % 2 == 0) > 1.2 * share(lambda d: d >= 1500) > 2 * share(lambda d: d < 1500 and d % 2)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(df.repartition(5), share=0.5, weights=weights).collect()), key=str)
