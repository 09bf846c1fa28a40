"""Training-data stages against brute force where a shortcut would leave a part of the job."""

import math
import random
import re
from collections import Counter, defaultdict

from skycube.llm import decontaminate, language, line_dedup, simhash


def shingles(text, words=5):
    found = text.lower().split()
    return {" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))}


def test_near_copies_by_exact_similarity(spark):
    """Pairs at 5-word Jaccard 0.8 to 0.95 go, pairs just below stay; components as by brute force."""
    r = random.Random(5)
    word = lambda: "".join(r.choices("abcdefghij", k=6))
    rows = []
    for k in range(60):
        text = [word() for _ in range(r.choice([40, 150, 400]))]
        rows.append(" ".join(text))
        for _ in range(k % 4):
            new = list(text)
            for _ in range(r.randrange(1, max(2, len(text) // 35))):
                new[r.randrange(len(new))] = word()
            rows.append(" ".join(new))
    sets = [shingles(t) for t in rows]
    group = list(range(len(rows)))
    near = 0
    for i in range(len(rows)):
        for j in range(i):
            same = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
            near += 0.8 <= same < 0.95
            if same >= 0.8:
                group = [group[j] if g == group[i] else g for g in group]
    least = [min(i for i in range(len(rows)) if group[i] == g) for g in group]
    assert near > 20
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert {x.doc_id: x.component_id for x in simhash.near_copies(df).collect()} == dict(enumerate(least))
    assert sorted(x.doc_id for x in simhash.drop_near_duplicates(df).collect()) == sorted(set(least))


def test_the_pipeline_links_fingerprints_and_sets(spark):
    """The pipeline's stage leaves one text of each component of both kinds of links, also where the sets are less alike than 0.8."""
    import corpus_pipeline

    r = random.Random(11)
    word = lambda: "".join(r.choices("abcdefghij", k=6))
    rows = []
    for _ in range(200):
        text = [word() for _ in range(60)]
        rows.append(" ".join(text))
        for changes in (1, 2):
            at = r.sample(range(60), changes)
            rows.append(" ".join(word() if i in at else w for i, w in enumerate(text)))
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    sims = {x.doc_id: x.fp & (1 << 64) - 1 for x in simhash.fingerprints(df).collect()}
    sets = [shingles(t) for t in rows]
    group, kinds = list(range(len(rows))), Counter()
    for i in range(len(rows)):
        for j in range(i):
            near, alike = (sims[i] ^ sims[j]).bit_count() <= 3, len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8
            kinds[near, alike] += 1
            if near or alike:
                group = [group[j] if g == group[i] else g for g in group]
    assert kinds[True, False] > 2 and kinds[False, True] > 2, kinds
    left = corpus_pipeline.drop_near_copies(spark, df, "").collect()
    assert sorted(x.doc_id for x in left) == sorted({min(i for i in range(len(rows)) if group[i] == g) for g in group})


def test_pages_of_one_frame_meet_no_more_than_their_number(spark, monkeypatch):
    """Pages that share most words but not 0.8 of their shingles, and near copies among them: rows that are stored grow as the pages, and no pair is lost."""
    sizes, whole = {}, simhash.stored

    def counting(df, tag):
        out = whole(df, tag)
        if tag in ("pairs", "left", "members", "rare"):
            sizes[n, tag] = sizes.get((n, tag), 0) + out.count()
        return out

    monkeypatch.setattr(simhash, "stored", counting)
    r = random.Random(9)
    word = lambda: "".join(r.choices("abcdefghij", k=6))
    frame = [word() for _ in range(300)]
    for n in (80, 240):
        rows = [(k, " ".join(frame + [word() for _ in range(120)])) for k in range(n)]
        rows += [(n + k, " ".join([*rows[k][1].split()[:-3], "some", "other", "end"])) for k in range(0, n, 8)]
        got = {x.doc_id: x.component_id for x in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got == {k: k if k < n else k - n for k, _ in rows}
    assert all(sizes[240, tag] < 4.5 * max(sizes[80, tag], 60) for _, tag in sizes), sizes


def tree(rows, similar=0.75, evidence=16, depth=3):
    """Lines dropped from each document by the plain tree, node after node; what is dropped shares its group's constants."""
    placed = []
    for d, text in rows:
        for i, line in enumerate((text or "").split("\n")):
            words = re.sub(r"[ \t\x0b\f\r]+", " ", line).strip(" ")
            if words:
                masked = ["<*>" if re.search("[0-9]", w) else w for w in words.split(" ")]
                placed.append((d, i, tuple(words.split(" ")) if masked.count("<*>") * 2 > len(masked) else tuple(masked)))
    lines, first, group = Counter(t for _, _, t in placed), {}, {}
    for d, i, t in sorted(placed):
        first.setdefault(t, (d, i))
    nodes = defaultdict(list)
    for t in lines:
        nodes[len(t), t[:3]].append(t)
    for level in range(1, depth + 1):
        below = defaultdict(list)
        for name, ts in nodes.items():
            n = len(ts[0])
            most = n - math.ceil(similar * n)
            head = min(ts, key=lambda t: (-lines[t], first[t]))
            differs = {t: [p for p in range(n) if t[p] != head[p]] for t in ts}
            often = Counter()
            for t in ts:
                if len(differs[t]) <= most:
                    often.update(dict.fromkeys(differs[t], lines[t]))
            fields = sorted(often, key=lambda p: (-often[p], p))[:most]
            group |= {t: (level, name) for t in ts if set(differs[t]) <= set(fields)}
            rest = [t for t in ts if t not in group]
            seen = sorted(range(n), key=lambda p: (len({t[p] for t in rest}), p))[: math.ceil(similar * level / depth * n)]
            for t in rest:
                below[name, tuple((p, t[p]) for p in seen)].append(t)
        nodes = below
    group |= {t: name for name, ts in nodes.items() for t in ts}
    members = defaultdict(list)
    for t, g in group.items():
        members[g].append(t)
    assert all(sum(len(set(x)) == 1 for x in zip(*ts)) >= similar * len(ts[0]) for ts in members.values())
    docs = defaultdict(set)
    for d, _, t in placed:
        docs[group[t]].add(d)
    gone = dict.fromkeys([d for d, _ in rows], 0)
    for d, _, t in placed:
        seen = docs[group[t]]
        gone[d] += len(seen) > 1 and len(seen) * len(t) >= evidence and d != min(seen)
    return gone


def dropped(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id: r["__dropped"] for r in line_dedup.dedup_lines(df).collect()}


def test_long_lines_agree_token_by_token(spark):
    """A recurring line of 147 tokens with six changed ones is found; one with a third of them changed is not."""
    base = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(147)]
    few, many = list(base), list(base)
    for i in range(5, 147, 24):
        few[i] = "other"
    for i in range(4, 147, 3):
        many[i] = "another"
    rows = [(k, f"own start {'x' * k}\n" + " ".join(w)) for k, w in enumerate((base, base, few, many))]
    assert dropped(spark, rows) == {0: 0, 1: 1, 2: 1, 3: 0} == tree(rows)


def test_every_family_of_a_leaf_is_found(spark):
    """Families under one opening, each varying in one word, and a line that one document repeats."""
    line = lambda family, field: "the same opening " + " ".join(f"{family}{c}" for c in "abcdefg") + f" {field}"
    rows = [(k, f"own {'x' * k}\n" + line("pqr"[k % 3], "abcdefghi"[k])) for k in range(9)]
    rows.append((9, "\n".join([line("z", "z")] * 30)))
    assert dropped(spark, rows) == {k: int(3 <= k < 9) for k in range(10)} == tree(rows)
    rows = [(k, line("p" if k < 4 else "q", "abcdefg"[k])) for k in range(7)]
    assert sum(dropped(spark, rows).values()) == 5


def test_a_chain_of_lines_is_no_group(spark):
    """Thirteen lines, each unlike the one before in one token: a line goes only with those that share three quarters of all their tokens."""
    words = [f"w{chr(97 + i)}" for i in range(15)]
    rows = [(k, " ".join([*words[:3], *["new"] * k, *words[3 + k :]])) for k in range(13)]
    got = dropped(spark, rows)
    assert got == tree(rows) and 0 < sum(got.values()) < 12


def test_form_lines_cost_a_row_each(spark, monkeypatch):
    """Lines of 24 shared and 16 own tokens: none is dropped, and what is stored grows as their number."""
    sizes, whole = {}, line_dedup.stored

    def counting(df, tag):
        out = whole(df, tag)
        sizes[n] = sizes.get(n, 0) + out.count()
        return out

    monkeypatch.setattr(line_dedup, "stored", counting)
    r = random.Random(2)
    for n in (100, 400):
        rows = [(k, " ".join(["the", "same", "start", *(f"w{chr(97 + i % 26)}{i}".rstrip("0123456789") for i in range(21)), *("".join(r.choices("abcdefgh", k=5)) for _ in range(16))])) for k in range(n)]
        assert not any(dropped(spark, rows).values())
    assert sizes[400] < 4.5 * sizes[100]


def test_lines_against_the_plain_tree(spark):
    """Lines of 1 to 30 tokens from few words, so that leaves hold many templates that agree more or less."""
    r = random.Random(11)
    rows = []
    for d in range(60):
        lines = []
        for _ in range(12):
            n = r.choice([1, 2, 4, 5, 6, 8, 9, 12, 30])
            base = [f"w{chr(97 + (7 * i + n) % 26)}" for i in range(n)]
            for _ in range(r.choice([0, 0, 1, 2, 4, 9])):
                base[r.randrange(n)] = r.choice(["alpha", "beta", "gamma", "x1", "22", "c"])
            lines.append(r.choice(["", " ", "\t"]) + r.choice([" ", "  "]).join(base))
        rows.append((d, "\n".join(lines)))
    got = dropped(spark, rows)
    assert got == tree(rows) and 0 < sum(got.values()) < 720


def test_short_items_are_cut(spark):
    """An item of fewer words than a window is cut out of a long document, as op8 counts it."""
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    df = spark.createDataFrame([(1, " ".join([*words[:30], "what is the capital", *words[30:]])), (2, " ".join(words))], "doc_id long, text string")
    items = spark.createDataFrame([("i", "What is the capital")], "item_id string, text string")
    got = {r.doc_id: r.text.split() for r in decontaminate.decontaminate(df, items).collect()}
    assert got == {1: words, 2: words}


def test_cuts_over_several_shards(spark):
    """Runs of hits from different shards that touch are one; what is cut does not depend on the shards."""
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(80)]
    rows = [(1, "Ä! " + " ".join(words)), (2, " ".join(words[:50]) + " own words that follow here"), (3, None), (4, "nothing of it")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(k, " ".join(words[k : k + 12])) for k in range(0, 40, 4)] + [(99, "own words")], "item_id long, text string")
    one, many = (sorted((r.doc_id, r.text) for r in decontaminate.decontaminate(df, items, max_coverage=0.8, max_words=m).collect() if r.text) for m in (10**6, 20))
    assert one == many and len(one) == 2 and one[1] == (4, "nothing of it")
    assert one[0][1].split()[0] == "Ä!" and one[0][1].split()[1:] == words[48:]


def test_sample_is_bounded_whatever_repeats(spark):
    """A row repeated many times counts once in the sample, and no language is left out, however many there are."""
    same = spark.range(20_000).selectExpr("1L AS doc_id", "'the same words again and again' AS text", "'en' AS lang")
    many = spark.range(900).selectExpr("id AS doc_id", "concat('wort ', repeat(chr(97 + cast(id % 26 AS int)), 3), ' ', id) AS text", "concat('l', id % 300) AS lang")
    model = language.train(same.unionByName(many))
    assert sum(map(len, model.families)) == 301
