"""Operators against brute force, round trips and held-out accuracy."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from compare import SMALL, sql_rows, table
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
import public_tokenizers
from skycube.llm import chat, decontaminate, fingerprint, language, line_dedup, packing, pii, range_coder, secrets, simhash
from skycube.llm.queries import ORACLES, QUERIES
from skycube.llm.tokens import Tokens

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{SMALL}/documents.parquet").sort_values("doc_id").reset_index(drop=True)


@pytest.fixture(scope="module")
def encoded(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch(docs.text.fillna("").tolist(), add_special_tokens=False)]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert table(QUERIES[name](spark, SMALL).toPandas()) == table(sql_rows(ORACLES[name]))


@pytest.fixture(scope="module")
def both_encoders():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    t.encode_special_tokens = True
    return t, Tokens(TOKENIZER, 1 << 10)


@given(st.lists(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from("ab 's't're've'm'll'd\n\t <|endoftext|>1")), max_size=40), max_size=8))
@settings(max_examples=60, deadline=None)
def test_tokens_equal_the_library(both_encoders, texts):
    library, own = both_encoders
    ids, ends = own.encode(texts, chars=16)
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_pieces_with_one_hash_are_told_apart(both_encoders):
    """Words whose polynomial hashes are the same whatever the base; pieces beyond the length that is remembered."""
    library, own = both_encoders
    for k in (9, 10, 11):
        a, b = "a", "b"
        for _ in range(k):
            a, b = a + b, b + a
        for x, y in ((a, b), (" " + a, " " + b)):
            h = [own.hashes(c, np.array([0]), np.array([len(c)]))[0] for c in (np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in (x, y))]
            assert k < 10 or h[0] == h[1]
            ids, ends = own.encode([x, y, x])
            assert [ids[s:e].tolist() for s, e in zip(ends, ends[1:])] == [library.encode(t, add_special_tokens=False).ids for t in (x, y, x)]
    assert own.n_chars <= 64 * own.n


@pytest.mark.parametrize("n", [0, 1, 7, 8, 9, 500])
def test_coder_round_trip_and_damage(n):
    ids = np.random.default_rng(n).zipf(1.3, n).clip(0, 60000).astype(np.uint32)
    frame = range_coder.pack_frame(np.arange(2), np.array([True, False]), np.array([n, 0]), ids, block=8)
    docs, known, lengths, back = range_coder.unpack_frame(frame)
    assert (back == ids).all() and lengths.tolist() == [n, 0] and known.tolist() == [True, False]
    for k in range(-(-n // 8)):
        assert (range_coder.unpack_block(frame, k) == ids[8 * k : 8 * k + 8]).all()
    if n > 8:
        for at in (10, len(frame) - 20):
            bad = bytearray(frame)
            bad[at] ^= 0x55
            with pytest.raises((range_coder.BadBlock, zlib.error)):
                range_coder.unpack_frame(bytes(bad))


def test_token_output(spark, docs, encoded):
    got = QUERIES["op1_token_output"](spark, SMALL).toPandas().sort_values("doc_id")
    want = [np.array([*x, 2], "<u4") for x in encoded]
    n = np.array([len(x) for x in want])
    assert got.n_tokens.tolist() == n.tolist() and got.start.tolist() == (np.cumsum(n) - n).tolist() and got.ids_crc32.tolist() == [zlib.crc32(x.tobytes()) for x in want]


def test_packing(spark, docs, encoded):
    got = QUERIES["op5_best_fit_packing"](spark, SMALL).toPandas()
    want = {d: np.array([*x, 0], "<u4") for d, x in zip(docs.doc_id, encoded)}
    seen = defaultdict(int)
    for r in got.itertuples():
        part = want[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length <= 2048 and zlib.crc32(part.tobytes()) == r.ids_crc32
        seen[r.doc_id] += r.length
    assert seen == {d: len(x) for d, x in want.items()}
    for _, bin_ in got.sort_values("offset").groupby("sequence_id"):
        assert bin_.offset.tolist() == (bin_.length.cumsum() - bin_.length).tolist() and bin_.length.sum() <= 2048
    assert got.sequence_id.nunique() <= 1.03 * sum(map(len, want.values())) / 2048 + 1


def test_best_two_fit_replaces_the_smallest():
    # Greedy takes 60 then 30; the gap of 40 is filled better by 21 + 19.
    assert sorted(sorted([60, 30, 21, 19][i] for i in b) for b in packing.best_two_fit([60, 30, 21, 19], 100)) == [[19, 21, 60], [30]]


def test_language_held_out(spark):
    got = QUERIES["op2_language_id"](spark, "/root/testdata/sf0.01").toPandas()
    lang = pd.read_parquet("/root/testdata/sf0.01/documents.parquet").set_index("doc_id").lang
    assert (got.held_out == [zlib.crc32(str(d).encode()) % 4 == 2 for d in got.doc_id]).all()
    held = got[got.held_out]
    assert (held.lang_pred.values == lang[held.doc_id].values).mean() > 0.98


def test_language_families():
    texts = {"en": "the and of with", "de": "der und die mit", "fr": "le et la avec", "xx": "qqq zzz kkk jjj"}
    x, y = [], []
    for k, t in texts.items():
        for i in range(8):
            buckets = np.concatenate(language.grams([" ".join(random.Random(i).sample(t.split(), 4))])[1])
            f = np.bincount(buckets, minlength=language.DIMS + 1)[: language.DIMS]
            x.append((f / f.sum()).astype(np.float32))
            y.append(k)
    m = language.fit(np.array(x), y)
    assert m.families == [["de", "en"], ["fr"], ["xx"]] and m.pairs == [(0, 0, 1)]
    assert language.decide(m, language.margins(m, list(texts.values()))[0])[0] == list(texts)


def test_trigram_queries():
    q = {r.kind: secrets.trigram_query(r.pattern) for r in secrets.RULES}
    assert q["access"] == [frozenset({"aki", "kia"})] and q["hex"] == [] and frozenset({"tok", "oke", "ken"}) in q["assign"]
    assert secrets.trigram_query("ab?cdef") == [frozenset({"abc", "bcd", "cde", "def"}), frozenset({"acd", "cde", "def"})]


def test_secret_rules(spark):
    texts = ["TOKEN = 'abcdef' token=abc secret=token: abcdefg", "AKIA" + "A" * 16 + " AKIAABC", "😀" + "a1" * 12 + "Z", "ghp_" + "z" * 36, None, "password : \"hunter22\"" * 600]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in sorted(r.spans)] for r in secrets.scan(df).collect()}
    assert got[0] == [("assign", 0, 15)] and got[1] == [("access", 0, 20)] and got[2] == [("hex", 1, 25)] and got[3] == [("github", 0, 40)] and got[4] == []
    want = [("assign", m.start(), m.end()) for m in re.finditer(r"password : \"[A-Za-z0-9]+", texts[5])]
    assert got[5] == want


BASE = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def luhn(d):
    return sum(v if i % 2 == 0 else v * 2 - 9 * (v > 4) for i, v in enumerate(map(int, reversed(d)))) % 10 == 0


def base_spans(text):
    out = []
    for k, (kind, p) in enumerate(BASE):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]:
                out.append((m.start(), k, m.end(), kind))
    return sorted(out)


def test_personal_base_spans(spark):
    r = random.Random(5)
    pieces = ["a.b@c.de", "x@y", "@", "1.2.3.4", "1.2.3.4.5", "256.1.1.1", "001.2.3.4", "4111 1111 1111 1111", "4111111111111112", "+1 (243) 555-5526", "+12", "a@b.co%m@d.ee", "9" * 40, " ", "-", "é", "😀", ".", "+49 30 1234567", "\n"]
    texts = ["".join(r.choice(pieces) for _ in range(12)) for _ in range(300)] + ["a" * 50_000, "1." * 20_000, "+1" + " " * 20_000, None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in pii.personal_spans(df).collect():
        assert [(s.start, s["rank"], s.end, s.kind) for s in sorted(row.spans) if s.base] == base_spans(texts[row.doc_id]), texts[row.doc_id]


def test_expectation_maximisation(spark):
    rng = np.random.default_rng(0)
    truth = rng.random(20_000) < 0.3
    said = {v: np.where(truth, rng.random(20_000) < t, rng.random(20_000) < f).astype(int) for v, t, f in (("form", 0.95, 0.1), ("gazetteer", 0.8, 0.2), ("context", 0.7, 0.05))}
    votes = pd.DataFrame(said).assign(kind="card").value_counts().reset_index(name="n")
    got = pii.expectation_maximisation(spark.createDataFrame(votes), rounds=40)["card"]
    assert abs(got["prior"] - 0.3) < 0.03 and abs(got["t_form"] - 0.95) < 0.03 and abs(got["f_context"] - 0.05) < 0.03


def iban(country, number):
    turned = "".join(str(int(c, 36)) for c in number + country + "00")
    return f"{country}{98 - int(turned) % 97:02d}{number}"


def test_added_spans_against_brute_force(spark):
    """All kinds, good and bad: labelers' votes, EM, the classifier and the added spans, worked out span by span in Python."""
    r = random.Random(9)
    good, bad = [], []
    for _ in range(120):
        d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
        good += [
            f"call me by phone ({r.randint(201, 289)}) {r.randint(234, 289)}-{d(4)} today", f"social security {r.randint(100, 599)}-{r.randint(10, 99)}-{r.randint(1000, 9999)} noted",
            f"my bank account {iban('DE', d(18))} there", f"dear Mr. {r.choice(['Thomas', 'Peter'])} Anders, hello",
        ]
        bad += [f"order 111.911-{d(4)} there", f"version 666-00-0000 out", f"serial ZZ{d(2)}{'Q' * 12} item", "the build Dr. Xu Y was"]
    texts = good + bad[:200]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {row.doc_id: row.spans for row in pii.personal_spans(df).collect()}
    found = [(row.doc_id, s) for row in pii.candidates(df).collect() for s in row.found]
    kinds = {}
    for doc, s in found:
        kinds.setdefault(s.kind, []).append((doc, s))
    assert {"local_phone", "ssn", "iban", "person"} <= kinds.keys()
    for doc, s in kinds["iban"]:
        span = texts[doc][s.start : s.end].replace(" ", "")
        assert s.form == (int("".join(str(int(c, 36)) for c in span[4:] + span[:4])) % 97 == 1) and s.gazetteer == (span[:2] == "DE" and len(span) == 22)
    want = {}
    for kind, seen in kinds.items():
        p = [0.5] * len(seen)
        x = {"prior": 0.5} | {f"t_{v}": 0.8 for v in pii.LABELERS} | {f"f_{v}": 0.3 for v in pii.LABELERS}
        odds = lambda s, x: np.log(x["prior"] / (1 - x["prior"])) + sum(0 if s[v] < 0 else np.log(x[f"t_{v}"] / x[f"f_{v}"]) if s[v] else np.log((1 - x[f"t_{v}"]) / (1 - x[f"f_{v}"])) for v in pii.LABELERS)
        for _ in range(15):
            p = [1 / (1 + np.exp(-odds(s, x))) for _, s in seen]
            new = {"prior": (sum(p) + 1) / (len(p) + 2)}
            for v in pii.LABELERS:
                said = [(q, s[v]) for q, (_, s) in zip(p, seen) if s[v] >= 0]
                new[f"t_{v}"] = (sum(q for q, y in said if y) + 1.6) / (sum(q for q, _ in said) + 2)
                new[f"f_{v}"] = (sum(1 - q for q, y in said if y) + 0.6) / (sum(1 - q for q, _ in said) + 2)
            x = new
        p = [1 / (1 + np.exp(-odds(s, x))) for _, s in seen]
        for k, (doc, s) in enumerate(seen):
            total = odds(s, x)
            for f in pii.FEATURES:
                values = {y[f] for _, y in seen}
                t, o = (sum(w for w, (_, y) in zip(ws, seen) if y[f] == s[f]) + 1 for ws in (p, [1 - q for q in p]))
                total += np.log(t / (sum(p) + len(values))) - np.log(o / (sum(1 - q for q in p) + len(values)))
            want.setdefault(doc, {})[s.kind, s.start, s.end] = 1 / (1 + np.exp(-total))
    for doc, spans in got.items():
        have = {(s.kind, s.start, s.end): s.probability for s in spans}
        wanted = {k: v for k, v in want.get(doc, {}).items() if v >= 0.5 or k in have and [s.base for s in spans if (s.kind, s.start, s.end) == k][0]}
        assert have.keys() == wanted.keys() and all(abs(have[k] - wanted[k]) < 1e-6 for k in have)
    caught = sum(any(s.kind in ("local_phone", "ssn", "iban", "person") for s in got[k]) for k in range(len(good)))
    wrong = sum(any(not s.base for s in got[k]) for k in range(len(good), len(texts)))
    assert caught > 0.9 * len(good) and wrong < 0.1 * 200


def plain_common(a, b):
    """The chain of common extensions by comparing the texts themselves at the places that the fingerprints chose."""
    fa, fb = fingerprint.fingerprint(a), fingerprint.fingerprint(b)
    level = max(min(fa.levels, default=0), min(fb.levels, default=0))
    at = [[0, *(p for p, x in zip(f.places, f.levels) if x >= level), f.n] for f in (fa, fb)]
    used, total, i = set(), 0, 0
    while i < len(at[0]) - 1:
        best, place = 0, 0
        for j in range(len(at[1]) - 1):
            m = 0
            while i + m + 1 < len(at[0]) and j + m + 1 < len(at[1]) and j + m not in used and a[at[0][i] : at[0][i + m + 1]] == b[at[1][j] : at[1][j + m + 1]]:
                m += 1
            if m > best:
                best, place = m, j
        used |= {*range(place, place + best)}
        total += at[0][i + best] - at[0][i]
        i += max(best, 1)
    return total


def test_fingerprints(spark, docs):
    got = QUERIES["op4_document_fingerprints"](spark, SMALL).toPandas().sort_values("doc_id", ascending=False)
    x = docs.text.tolist()[::-1]
    edited = [fingerprint.edited_text(a, b) for a, b in zip(x, x[1:] + x[:1])]
    assert got.edited_sha256.tolist() == [hashlib.sha256(e.encode()).hexdigest() for e in edited] and got.n_chars.tolist() == list(map(len, x))
    assert got.fingerprint.tolist() == [str(fingerprint.fingerprint(a)) for a in x] and len(set(x)) == got.fingerprint.nunique()
    assert (got.near_edited > 0.55).all() and got.near_next.mean() < 0.1
    for a, e, b, near, following in list(zip(x, edited, x[1:], got.near_edited, got.near_next))[:200]:
        for other, value in ((e, near), (b, following)):
            chain = plain_common(a, other) / max(1, len(a), len(other))
            assert value >= min(1, chain) - 1e-9 and fingerprint.common(*map(fingerprint.fingerprint, (a, other))) == (plain_common(a, other))


def test_hot_and_null_doc_ids_are_cut_into_ranges(spark):
    """One doc_id, and null, with very many texts: no part holds them all, and each row's next is the one in order."""
    rows = [(7, f"text {i}") for i in range(400)] + [(None, f"none {i}") for i in range(400)] + [(k, f"own {k}") for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    parts = fingerprint.next_documents(df, parts=10)
    dealt = parts.where("NOT spare").groupBy("part").count().collect()
    assert max(r["count"] for r in dealt) < 250 and sum(r["count"] for r in dealt) == len(rows)
    order = [r.text for r in df.select("text", F.col("doc_id").alias("d"), F.xxhash64("text").alias("h")).orderBy(F.col("d").desc_nulls_last(), "h").collect()]
    want = {a: hashlib.sha256(fingerprint.edited_text(a, b).encode()).hexdigest() for a, b in zip(order, order[1:] + order[:1])}
    got = fingerprint.edited_fingerprints(df, parts=10).collect()
    assert sorted(r.edited_sha256 for r in got) == sorted(want.values())


@given(st.text("ab", max_size=30), st.text("ab", max_size=30), st.data())
@settings(max_examples=150, deadline=None)
def test_common_extensions(a, b, data):
    i, j = data.draw(st.integers(0, len(a))), data.draw(st.integers(0, len(b)))
    n = 0
    while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
        n += 1
    assert fingerprint.Prefix(a).extension(i, fingerprint.Prefix(b), j) == n
    f = fingerprint.fingerprint(a)
    assert fingerprint.Fingerprint.parse(str(f)) == f and 0 <= fingerprint.likeness(f, fingerprint.fingerprint(b)) <= 1


def test_likeness_of_insertions():
    r = random.Random(1)
    a = "".join(r.choice("abcdefgh ") for _ in range(4000))
    f = fingerprint.fingerprint
    assert fingerprint.likeness(f(a), f(a[:1000] + "xyz" + a[1000:])) > 0.9
    # Insertions, a cut and a move: nothing stays at its distance from either end.
    b = "new " + a[:700] + "xyz" + a[700:1900] + a[2000:2900] + "and more words" + a[2900:] + " end"
    assert fingerprint.likeness(f(a), f(b)) > 0.7 and fingerprint.likeness(f(a), f(a[2000:] + a[:2000])) > 0.8
    assert fingerprint.likeness(f("a" * 3000), f("a" * 2000 + b[:1000])) > 0.55
    assert fingerprint.likeness(f(a), f(a[::-1])) < 0.1 and fingerprint.likeness(f(""), f("")) == 1 and fingerprint.likeness(f(""), f("a")) == 0


@given(st.lists(st.lists(st.sampled_from("abc"), min_size=0, max_size=12), max_size=5), st.lists(st.sampled_from("abcd"), max_size=40), st.integers(1, 4))
@settings(max_examples=200, deadline=None)
def test_automaton_against_brute_force(items, words, window):
    code = lambda x: [w.encode() for w in x]
    automaton = decontaminate.Automaton([(str(k), code(i)) for k, i in enumerate(items)], window)
    hit, names = set(), set()
    for k, item in enumerate(items):
        n = min(window, len(item))
        for s in range(len(item) - n + 1) if n else ():
            for p in range(len(words) - n + 1):
                if words[p : p + n] == item[s : s + n]:
                    hit |= {*range(p, p + n)}
                    names.add(str(k))
    runs, found = automaton.match(code(words))
    assert {i for a, b in runs for i in range(a, b)} == hit and found == names


def test_several_automata_find_the_same(spark):
    docs, items = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    one, many = (decontaminate.matched(docs.select("doc_id", "text"), items, max_words=m).select("doc_id", "__match").orderBy("doc_id").collect() for m in (10**6, 3000))
    assert one == many


def components_of(fps, tau):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= tau):
            root[find(i)] = find(i + 1 + int(j))
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("bucket", [4096, 2])
def test_links_and_hubs_give_the_components(spark, bucket):
    rng = np.random.default_rng(2)
    centres = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    fps = np.unique([c ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, rng.integers(1, 4)).astype(np.uint64)) for c in centres for _ in range(15)])
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    got = {r.node: r.root for r in simhash.components(simhash.links(df, 3, bucket), "u", "v").collect()}
    want = defaultdict(set)
    for x, r in zip(fps.view(np.int64).tolist(), components_of(fps, 3)):
        want[r].add(x)
    groups = defaultdict(set)
    for x in fps.view(np.int64).tolist():
        groups[got.get(x, x)].add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values())) and len(want) < len(fps)


def test_thresholds_follow_the_pigeonhole():
    both = np.full((64, 64), 0.25) + np.eye(64) * 0.25
    for n in (10**3, 10**7, 10**10):
        plan = simhash.allocate(n, both * n, 3)
        assert sum(t + 1 for _, t in plan) == 4 and len({b for g, _ in plan for b in g}) == sum(len(g) for g, _ in plan)


def test_simhash_fingerprints(spark, docs):
    import xxhash

    got = QUERIES["op10_simhash_near_dedup"](spark, SMALL).toPandas().set_index("doc_id").fingerprint
    for d, text in zip(docs.doc_id[:60], docs.text[:60]):
        w = re.findall(r"[^\x20\x09-\x0D]+", text.translate({c: c + 32 for c in range(65, 91)}))
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
        assert got[d] == f"{sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if w else 0:016x}"


@given(st.text(st.sampled_from("<>[]|/\\sINSTim_end "), max_size=30))
def test_chat_escape(text):
    escaped = chat.escape(text)
    assert chat.unescape(escaped) == text and not re.search(r"<\||</?s>|\[/?INST\]", escaped)


def test_line_templates(spark):
    base = "the server answered request {} from the north office in good time"
    rows = [(k, f"own line number {'abcdefgh'[k]} of this text\n" + base.format(k)) for k in range(4)] + [(9, "Short.\nAnother quite different line that stands in one text alone today")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(df).collect()}
    assert got[0] == rows[0][1] and got[9] == rows[4][1]
    assert all("server" not in got[k] for k in (1, 2, 3))


def test_pipeline_catches_planted_cases(spark, tmp_path):
    r = random.Random(7)
    word = lambda: "".join(r.choice(["the", "an", "er", "on", "in", "re", "st"]) for _ in range(r.randint(1, 4)))
    line = lambda n: " ".join(word() for _ in range(n))
    clean = ["\n".join(line(30) for _ in range(5)) for _ in range(40)]
    passage, leak = line(60), line(40)
    rows = list(enumerate(clean)) + [(100, clean[0]), (101, clean[1].replace(" ", " x ", 1)), (102, clean[2] + "\n" + passage), (103, "\n".join(line(30) for _ in range(5)) + "\n" + passage), (104, "\n".join(line(30) for _ in range(4)) + "\n" + leak), (105, "!!! 123"), (106, None)]
    spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path)).persist()
    texts = {x.doc_id: x.text for x in docs.collect()}
    assert {*range(3, 40)} <= texts.keys() and not {100, 101, 105, 106} & texts.keys()
    assert sum(passage in t for t in texts.values()) <= 1 and leak not in texts[104] and all(texts[k] == clean[k] for k in range(3, 40))
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {x.doc_id for x in packed.select("doc_id").collect()} == texts.keys()


@pytest.mark.parametrize("parts", [1, 2, 3, 7, 40])
def test_next_documents_at_the_ends_of_long(spark, parts):
    """Every row's next document follows it, whatever the number of parts, with the smallest and largest ids of all."""
    ids = [-(2**63), -(2**63) + 1, -5, 0, 3, 2**63 - 1, *range(100, 140)]
    df = spark.createDataFrame([(d, f"text {d}") for d in ids], "doc_id long, text string")
    rows = fingerprint.next_documents(df, parts=parts).withColumn("at", F.spark_partition_id()).collect()
    follows = {}
    for a, b in zip(rows, rows[1:]):
        if (a.at, a.part) == (b.at, b.part) and not a.spare:
            follows[a.doc_id] = b.doc_id
    down = sorted(ids, reverse=True)
    assert follows == dict(zip(down, [*down[1:], down[0]]))


def test_simhash_query_against_brute_force(spark, docs):
    """Fingerprints of whole documents bit by bit, and components of all pairs at three bits."""
    from xxhash import xxh64_intdigest

    def plain(text):
        w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))))
        h = [xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
        return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))

    fps = [plain(t) for t in docs.text]
    root = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3 and root[i] != root[j]:
                root = [root[j] if r == root[i] else r for r in root]
    least = {}
    for i, r in enumerate(root):
        least[r] = min(least.get(r, 1 << 62), docs.doc_id[i])
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op10_simhash_near_dedup"](spark, SMALL).collect()}
    assert got == {d: (f"{fps[i]:016x}", least[root[i]]) for i, d in enumerate(docs.doc_id)}
