"""Secret scans with a trigram inverted index (operator 3), in DataFrame functions only.

Each rule's regular expression gives a Boolean query over trigrams of the lower-cased text:
alternatives, each a set of trigrams that a match must contain. The index has a posting
(trigram, document) for the trigrams that occur in any query. Intersecting the postings of an
alternative gives its candidates; only they are matched. A rule without mandatory trigrams is
matched against every text.

Defined cases: a null text is an empty one and has no spans. Documents are told apart by doc_id
and a hash of the text; repeated rows share postings and keep a row each. Null doc_ids are
scanned like others. No rows give no rows. Other columns are not read.
"""

from __future__ import annotations

import re
from itertools import product
from re import _constants as sre
from re import _parser
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import sized, stored
from .spans import find_spans, joined, labelled, no_spans

#: Strings that an expression's part can be, at most; more are cut into trigrams and forgotten.
MOST_STRINGS = 64


class Rule(NamedTuple):
    kind: str
    pattern: str
    group: int = 0  # the group that has to be long enough
    least: int = 1  # code points of it
    base: bool = False


RULES = (
    Rule("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24, True),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"sk_live_[0-9A-Za-z]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("hex_upper", r"[0-9A-F]{24,}", 0, 24),
)


def _cut(strings: set[str]) -> list[frozenset[str]] | None:
    """The query that one of the strings occurs; None if it demands nothing."""
    sets = [frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings]
    return None if not all(sets) else sets


def _both(a: list[frozenset[str]] | None, b: list[frozenset[str]] | None) -> list[frozenset[str]] | None:
    if a is None or b is None:
        return b if a is None else a
    return [x | y for x, y in product(a, b)] if len(a) * len(b) <= MOST_STRINGS else a


def _query(parsed) -> tuple[set[str] | None, list[frozenset[str]] | None]:
    """All strings that a parsed expression can be (None: too many), and its trigram query."""
    strings: set[str] | None = {""}
    whole, need = True, None
    for op, arg in parsed:
        here: set[str] | None = None
        inner = None
        if op is sre.LITERAL:
            here = {chr(arg).lower()}
        elif op is sre.IN and all(o is sre.LITERAL for o, _ in arg):
            here = {chr(c).lower() for _, c in arg}
        elif op is sre.SUBPATTERN:
            here, inner = _query(arg[-1])
        elif op is sre.BRANCH:
            parts = [_query(x) for x in arg[1]]
            here = set().union(*(s for s, _ in parts)) if all(s is not None for s, _ in parts) else None
            queries = [q if s is None else _cut(s) for s, q in parts]
            inner = sum(queries, []) if all(q is not None for q in queries) else None
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, sub = arg
            got, inner = _query(sub)
            if high <= 1 and got is not None:
                here = got | ({""} if not low else set())
            elif low and got is not None:
                inner = _both(inner, _cut(got))
            if not low:
                inner = None
        elif op is sre.AT:
            here = {""}
        longer = None if here is None else {a + b for a, b in product(strings, here)}
        if longer is not None and len(longer) <= MOST_STRINGS:
            strings = longer
            continue
        # Whatever follows, one of these strings has been read: demand it, and start anew.
        need = _both(need, _cut(strings))
        need = _both(need, _cut(here) if here is not None else inner)
        strings, whole = {""}, False
    if whole:
        return strings, None
    return None, _both(need, _cut(strings))


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Alternatives of mandatory trigrams of the lower-cased text; none if every text must be scanned."""
    strings, need = _query(_parser.parse(pattern))
    if strings is not None:
        need = _cut(strings)
    least = {a for a in need or [] if not any(b < a for b in need)}
    return sorted(least, key=sorted)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("h"), text.alias("text"))


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """(trigram, doc_id, h) for every document and every one of the trigrams in its lower-cased text."""
    low = docs.select("doc_id", "h", F.lower("text").alias("low"))
    has = F.filter(F.array(*[F.lit(g) for g in trigrams]), lambda g: F.contains(F.col("low"), g))
    return low.select(F.explode(has).alias("trigram"), "doc_id", "h")


def candidates(index: DataFrame, queries: dict[str, list[frozenset[str]]]) -> DataFrame:
    """(d, g, kinds): the documents at which an alternative's postings meet, with the rules they are for."""
    spark = index.sparkSession
    terms = [(kind, k, g, len(alternative)) for kind, q in queries.items() for k, alternative in enumerate(q) for g in sorted(alternative)]
    # Fixed by the rules, some dozens of rows.
    wanted = F.broadcast(spark.createDataFrame(terms, "kind string, alternative int, trigram string, size int"))
    met = index.join(wanted, "trigram").groupBy("kind", "alternative", "doc_id", "h").agg((F.count_distinct("trigram") == F.first("size")).alias("all"))
    return met.where("all").groupBy(F.col("doc_id").alias("d"), F.col("h").alias("g")).agg(F.collect_set("kind").alias("kinds"))


def _spans(rule: Rule, wanted: Column) -> Column:
    text = F.col("text")
    spans = find_spans(text, rule.pattern)
    if rule.group:
        spans = F.filter(spans, lambda s: F.length(F.regexp_extract(s["match"], rule.pattern, rule.group)) >= rule.least)
    else:
        spans = F.filter(spans, lambda s: F.length(s["match"]) >= rule.least)
    return F.when(wanted & F.rlike(text, F.lit(rule.pattern)), spans).otherwise(no_spans())


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans): spans of all rules as structs of start, rank (the rule's place), end, kind."""
    rows = keyed(docs, id_col, text_col)
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern))}
    found = candidates(postings(rows, sorted({g for q in queries.values() for a in q for g in a})), queries) if queries else None
    if found is not None:
        rows = rows.join(sized(stored(found, "candidates")), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g")), "left")
    else:
        rows = rows.withColumn("kinds", F.expr("cast(array() as array<string>)"))
    kinds = F.coalesce("kinds", F.expr("cast(array() as array<string>)"))
    rows = rows.select("doc_id", "text", kinds.alias("kinds"))
    each = [_spans(r, F.array_contains("kinds", r.kind) if r.kind in queries else F.lit(True)) for r in rules]
    rows = rows.select("doc_id", *[s.alias(f"s{i}") for i, s in enumerate(each)])
    return rows.select("doc_id", F.concat(*[labelled(F.col(f"s{i}"), r.kind, i) for i, r in enumerate(rules)]).alias("spans"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = [r.kind for r in RULES if r.base]
    own = F.filter("spans", lambda s: s["kind"].isin(base))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in base], F.sha2(joined(own), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def _sql() -> str:
    """The same spans in SQL, every rule matched against every text."""
    parts = []
    for i, r in enumerate(RULES):
        pattern = r.pattern.replace("'", "''").replace(r"\"", '"')
        keep = f"length(regexp_extract(m, '{pattern}', {r.group})) >= {r.least}"
        parts.append(f"""
  SELECT doc_id, s AS start, {i} AS rank, s + length(m) AS stop, '{r.kind}' AS kind FROM (
    SELECT doc_id, m[k] AS m, CAST(list_sum(list_transform(g[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1 : k - 1], lambda x: length(x))), 0) AS BIGINT) AS s
    FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS m, regexp_split_to_array(text, '{pattern}') AS g FROM documents WHERE regexp_matches(text, '{pattern}')),
         unnest(generate_series(1, len(m))) AS t(k)) WHERE {keep}""")
    return f"""
WITH s AS ({" UNION ALL ".join(parts)}),
a AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank, stop) FILTER (rank < 3) AS base,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank, stop) AS spans
  FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN a USING (doc_id)
"""


OP3_SQL = _sql()
