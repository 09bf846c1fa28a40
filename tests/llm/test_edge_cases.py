"""Every operator and stage on nulls, empty and very long texts, ties, repeats, empty tables, clashing columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from skycube.llm import chat, decontaminate, fingerprint, language, line_dedup, mixing, packing, periodic, pii, search, secrets, simhash, token_output
from skycube.llm.shared import new_path

import public_tokenizers

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the quick brown fox jumps over a lazy dog while seven small birds sing in old trees"
LONG = " ".join(f"{w}{i % 97}" for i in range(20_000) for w in ("alpha", "beta"))
CLASHING = ["h", "d", "g", "t", "i", "n", "fp", "leaf", "kinds", "spans", "found", "part", "piece", "start", "length", "component_id", "score", "p", "__lang", "__score", "__both", "__match", "__old", "__hits", "__d", "__h", "__g", "__gone", "__lines", "__dropped", "__lost", "__tokens", "__own", "_tmp"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [
        (1, WORDS, "en", "a", 5), (1, WORDS, "en", "a", 5), (2, WORDS, None, None, None), (3, None, "en", "a", None), (4, "", "fr", None, 0), (None, "Der Hund und die Katze gehen in das Haus", "de", "b", 3),
        (None, None, None, None, None), (5, LONG, "en", "a", len(LONG)), (6, "123 !!! \n\n \t", "en", "a", 9), (7, "漢字 😀 é x </s>[INST] <|endoftext|>", "en", "a", 9), (8, " \n ", "es", "a", 3),
    ]
    return spark.createDataFrame(rows, SCHEMA).persist()


@pytest.fixture(scope="module")
def clashing(odd):
    return odd.withColumns({c: F.lit("x") for c in CLASHING}).persist()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def bench_dir(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(1, WORDS), (2, None), (3, ""), (None, "two words"), (3, "Über straße öl")], "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    return str(path)


OPERATORS = {
    "tokens": lambda d: (lambda p: (token_output.write_tokens(d, p, TOKENIZER), token_output.token_digest(d.sparkSession, p))[1])(new_path(d.sparkSession, "t")),
    "language": lambda d: language.identify(d, language.train(d)),
    "secrets": secrets.scan,
    "fingerprints": fingerprint.edited_fingerprints,
    "pieces": lambda d: packing.pack(packing.pieces(d, TOKENIZER)),
    "personal": pii.personal_spans,
    "lines": line_dedup.dedup_lines,
    "contamination": lambda d: decontaminate.contamination(d, d.sparkSession.createDataFrame([("i", WORDS)], "item_id string, text string")),
    "near": simhash.near_duplicates,
    "runs": periodic.find_runs,
    "mix": mixing.mix,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operator_keeps_a_row_for_each_document(odd, clashing, none, name):
    f = OPERATORS[name]
    rows = f(odd).collect()
    if name == "pieces":
        assert len({(r.doc_id, r.piece, r.ids_crc32) for r in rows}) <= len(rows) and sum(r.piece == 0 for r in rows) == odd.count()
    else:
        assert len(rows) == odd.count()
    assert len(f(clashing).collect()) == len(rows)
    assert f(none).collect() == []


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stage_takes_anything(spark, odd, clashing, none, bench_dir, k):
    name, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, clashing, bench_dir)
    if k < len(corpus_pipeline.STAGES) - 1:
        assert out.columns == clashing.columns and out.dtypes == clashing.dtypes
    n = out.count()
    assert 0 < n and stage(spark, none, bench_dir).count() == 0
    assert stage(spark, odd, bench_dir).count() == n


def test_search_takes_anything(odd, clashing, none):
    items = odd.sparkSession.createDataFrame([(1, WORDS), (1, "Hund ++ FOX"), (2, None), (3, ""), (None, "Katze"), (4, "unheard of")], "item_id long, text string").withColumn("rank", F.lit("x"))
    rows = search.rank(odd, items).collect()
    assert sorted(map(tuple, search.rank(clashing, items).collect()), key=str) == sorted(map(tuple, rows), key=str)
    by = {i: [(r["rank"], r.doc_id) for r in sorted(rows, key=lambda r: r["rank"]) if r["item"] == i] for i in (1, 2, 3, None, 4)}
    assert [d for _, d in by[1]] == [1, 1, 2, None] and by[None] == [(1, None)] and not by[2] + by[3] + by[4]
    assert search.rank(none, items).collect() == [] and search.rank(odd, items.limit(0)).collect() == []


def test_mix_rules(odd):
    rows = mixing.mix(odd).collect()
    assert all(0 <= r.taken <= 2 * r["size"] for r in rows) and all(r["size"] == 0 for r in rows if r.doc_id in (3, 4, 8))
    texts = mixing.mixed_texts(odd.withColumn("epoch", F.lit(1)))
    assert texts.columns == [*odd.columns, "epoch", "_epoch"]
    assert sum(len((r.text or "").encode().split()) for r in texts.collect()) == sum(r.taken for r in rows)


def test_language_rules(odd):
    found = language.identify(odd, language.train(odd)).select("doc_id", "text", "__lang", "__score").collect()
    for r in found:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r["__lang"] == "und") == (not letters) and 0 <= r["__score"] <= 1 and (letters or r["__score"] == 0)
    assert {r["__lang"] for r in language.identify(odd, None).collect()} == {"und"}


def test_near_dedup_keeps_one_of_each_group(odd):
    left = [(r.doc_id, r.text) for r in simhash.drop_near_duplicates(odd).collect()]
    assert left.count((1, WORDS)) == 1 and (2, WORDS) not in left
    assert sum(not (t or "").split() for _, t in left) == 1


def test_chat_rules(spark):
    rows = [(1, 0, "user", None), (1, 0, None, "x"), (1, None, "assistant", "</s>[INST] <|im_end|> <\\|im_end|>"), (None, 1, "assistant", ""), (2, 1, "assistant", "a" * 3000), (2, 0, "user", "é")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segment", F.lit("x"))
    got = {r.conv_id: r for r in chat.digest(chat.format_conversations(df, TOKENIZER, segment_chars=1000), TOKENIZER).collect()}
    assert {k: r.n_turns for k, r in got.items()} == {1: 3, None: 1, 2: 2}
    assert got[1].loss_chars == len(rows[2][3]) and got[None].loss_chars == 0 and got[2].loss_chars == 3000
    assert chat.digest(chat.format_conversations(df.limit(0), TOKENIZER), TOKENIZER).collect() == []
    with pytest.raises(Exception, match="no whole number"):
        chat.format_conversations(df.withColumn("conv_id", F.lit("x1")), TOKENIZER).collect()


def test_a_hot_conversation_is_spread(spark, tmp_path):
    """One conversation with nearly all turns, among repeated rows and ties: several tasks format it, and its digests are those of the whole."""
    import hashlib

    rows = [(1, k // 2, "user" if k % 3 else "assistant", f"turn {k // 2} [INST] " + "word " * (k % 50)) for k in range(3000)] + [(c, t, "assistant", "x" * t) for c in (0, 2, 3) for t in (1, 2)] + [(3, 2, "assistant", "xx")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # Spark would put so few rows together again
    chat.format_conversations(df, TOKENIZER, segment_chars=5000).write.parquet(str(tmp_path / "f"))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    formatted = spark.read.parquet(str(tmp_path / "f"))
    assert len({r.part for r in formatted.where("conv_id = 1").select("part").collect()}) > 2
    got = {r.conv_id: r for r in chat.digest(formatted, TOKENIZER).collect()}
    assert sorted(got) == [0, 1, 2, 3]
    for c, r in got.items():
        mine = sorted((t, role, text) for conv, t, role, text in rows if conv == c)
        assert r.n_turns == len(mine) and r.turns_sha256 == hashlib.sha256("".join(f"{x[1]}\n{x[2]}\n" for x in mine).encode()).hexdigest()
        loss = "".join(x[2] for x in mine if x[1] == "assistant")
        assert r.loss_chars == len(loss) and r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
