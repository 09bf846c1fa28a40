"""Line dedup with a log-template tree (operator 7), in DataFrame functions only.

The tree has a fixed depth: a line goes by its number of tokens, then by its first three tokens,
then through ``DEPTH`` levels. Tokens with digits are variable fields and become ``<*>`` (unless
that would leave less than half of the line). At most n - ceil(similar n) of a group's n positions
are variable fields. A node of level j

* makes a group of its commonest template (of two the one that is first met): its fields are the
  positions where most lines that differ in few enough positions differ from it, and the templates
  that differ in fields only join it;
* deals the others to nodes below it: the ceil(similar n j / DEPTH) positions where they have the
  fewest different tokens (of two the earlier) are constant there.

At the tree's end what is in one node agrees in ``similar`` of all positions and is a group. So all
lines of a group, not just each and the next, have the same tokens at ``similar`` of their positions.
Templates are compared with their node's commonest one only, and no two lines of a leaf ever make a pair.

A group that recurs across documents is dropped from all of them but the first. It recurs if it is
in two documents or more and documents times tokens are ``evidence`` or more: the fewer tokens a
line has, the more documents it takes to tell a copy from chance. Blank lines stay.

One pass over the texts makes a row of hashes for each line. Leaves of one line end there; the rest
works on rows of templates whose leaves have more, fewer at each level. The texts are read once
more with the decisions.

Tokens and nodes are compared by 64-bit hashes, templates by 96 bits: unequal ones pass for equal
once in 2**64.

Defined cases: a null text stays null and has no lines. Documents are told apart by doc_id and a
hash of the text, so rows repeated as a whole are one document and lose the same lines. The
first document is the one with the smallest doc_id; null doc_ids come last. Groups do not depend
on any order. No rows give no rows. Other columns pass untouched.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import fresh, stored

LEAD, DEPTH = 3, 3


def _document(doc_id: Column, h: Column) -> list[Column]:
    """Orders documents: known ids first."""
    return [doc_id.isNull().alias("no"), doc_id.alias("d"), h.alias("h")]


def _templates(rows: DataFrame) -> DataFrame:
    """A column template for the column raw; rows of blank lines go."""
    odd = F.contains("raw", F.lit("  "))
    for c in "\t\x0b\f\r":
        odd = odd | F.contains("raw", F.lit(c))
    rows = rows.withColumn("line", F.trim(F.when(odd, F.regexp_replace("raw", r"[ \t\x0B\f\r]+", " ")).otherwise(F.col("raw")))).where("line <> ''").drop("raw")
    rows = rows.withColumn("masked", F.when(F.rlike("line", F.lit("[0-9]")), F.regexp_replace("line", "[^ ]*[0-9][^ ]*", "<*>")))
    fields = (F.length("masked") - F.length(F.replace("masked", F.lit("<*>")))) / 3
    n_line = F.length("line") - F.length(F.replace("line", F.lit(" "))) + 1
    return rows.withColumn("template", F.when(F.col("masked").isNull() | (fields * 2 > n_line), F.col("line")).otherwise(F.col("masked"))).drop("line", "masked")


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(d, h, i, n, leaf, t, t2) of every line with a token; t and t2 hash the template."""
    rows = docs.select(F.col(id_col).cast("long").alias("d"), F.xxhash64(text_col).alias("h"), F.posexplode(F.split(text_col, "\n")).alias("i", "raw"))
    rows = _templates(rows).withColumn("n", F.length("template") - F.length(F.replace("template", F.lit(" "))) + 1)
    return rows.select("d", "h", "i", "n", F.xxhash64("n", F.substring_index("template", " ", LEAD)).alias("leaf"), F.xxhash64("template").alias("t"), F.hash("template").alias("t2"))


def _tokens(docs: DataFrame, pool: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The templates of ``pool`` with hashes of their tokens, from the texts that have them first."""
    wanted = pool.groupBy(F.col("first.d").alias("d"), F.col("first.h").alias("h")).agg(F.collect_list("first.i").alias("i"))
    texts = docs.select(F.col(id_col).cast("long").alias("d"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text")).withColumnRenamed("d", "e")
    rows = texts.join(wanted, F.col("e").eqNullSafe(F.col("d")) & (texts.h == wanted.h)).select("d", wanted.h, "i", "text").dropDuplicates(["d", "h"])
    rows = _templates(rows.select(F.explode("i").alias("i"), F.split("text", "\n").alias("l")).select(F.get("l", F.col("i")).alias("raw")))
    rows = rows.select(F.xxhash64("template").alias("t"), F.hash("template").alias("t2"), F.transform(F.split("template", " "), lambda x: F.xxhash64(x)).alias("tokens"))
    return stored(pool.join(rows, ["t", "t2"]).withColumn("node", F.xxhash64("t", "t2")), "tokens")


def _groups(pool: DataFrame, similar: float) -> DataFrame:
    """(node, root) of the templates of ``pool``: leaf, node, n, lines, first, tokens; a stored table of a row a template."""
    need = lambda share: F.ceil(F.lit(share) * F.col("n")).cast("int")
    rows, done = pool.select("node", "n", "lines", "first", "tokens", F.col("leaf").alias("g")), []
    for level in range(1, DEPTH + 1):
        heads = rows.groupBy("g").agg(F.count(F.lit(1)).alias("k"), F.min_by("tokens", F.struct((-F.col("lines")).alias("l"), "first")).alias("head"))
        differs = F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda p: F.get("tokens", p) != F.get("head", p)).alias("differs")
        marked = stored(rows.join(stored(heads, "heads"), "g").select("node", "n", "lines", "first", "tokens", "g", "k", differs), "marked")
        few = (F.col("k") > 1) & (F.size("differs") > 0) & (F.size("differs") <= F.col("n") - need(similar))
        counts = marked.where(few).select("g", "n", "lines", F.explode("differs").alias("p")).groupBy("g", "n", "p").agg(F.sum("lines").alias("c"))
        fields = counts.groupBy("g", "n").agg(F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("c"), "p"))).alias("ps"))
        fields = stored(fields.select("g", F.transform(F.slice("ps", F.lit(1), F.col("n") - need(similar)), lambda x: x["p"]).alias("fields")), "fields")
        joins = (F.size("differs") == 0) | F.coalesce(few & (F.size(F.array_except("differs", "fields")) == 0), F.lit(False))
        marked = stored(marked.join(fields, "g", "left").withColumn("joins", joins), "joined")
        done.append(marked.where("joins").select("node", F.xxhash64("g", F.lit(level)).alias("root")))
        rest = marked.where("NOT joins")
        seen = rest.select("g", "n", F.posexplode("tokens").alias("p", "x")).distinct().groupBy("g", "n", "p").agg(F.count(F.lit(1)).alias("c"))
        ranked = seen.groupBy("g", "n").agg(F.array_sort(F.collect_list(F.struct("c", "p"))).alias("ps"))
        picked = stored(ranked.select("g", F.transform(F.slice("ps", F.lit(1), need(similar * level / DEPTH)), lambda x: x["p"]).alias("ps")), "picked")
        below = F.xxhash64("g", F.transform("ps", lambda p: F.get("tokens", p)))
        rows = stored(rest.join(picked, "g").select("node", "n", "lines", "first", "tokens", below.alias("g")), "level")
    return reduce(DataFrame.unionByName, [*done, rows.select("node", F.col("g").alias("root"))])


def recurring(docs: DataFrame, id_col: str, text_col: str, similar: float, evidence: int) -> tuple[DataFrame, DataFrame]:
    """The stored lines of leaves with several, and (t, t2, first) of templates whose group recurs, with its first document."""
    places = stored(lines(docs, id_col, text_col), "lines")
    # Stored, so that both sides of the join are plain shuffles and a hot leaf can be split.
    leaves = stored(places.groupBy("leaf").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("leaf"), "leaves")
    busy = stored(places.join(leaves, "leaf"), "busy")
    doc = _document(F.col("d"), F.col("h"))
    templates = stored(busy.groupBy("leaf", "t", "t2", "n").agg(F.count(F.lit(1)).alias("lines"), F.min(F.struct(*doc, "i")).alias("first"), F.max(F.struct(*doc)).alias("last")), "templates")
    several = templates.where(F.col("n") > LEAD).groupBy("leaf").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("leaf")
    pool = stored(templates.where(F.col("n") > LEAD).join(stored(several, "several"), "leaf").select("leaf", "t", "t2", "n", "lines", "first"), "pool")
    node = F.xxhash64("t", "t2")
    roots = _groups(_tokens(docs, pool, id_col, text_col), similar)
    grouped = stored(templates.withColumn("node", node).join(roots, "node", "left").withColumn("g", F.coalesce("root", "node")).drop("node", "root"), "grouped")
    first = F.min(F.struct("first.no", "first.d", "first.h"))
    groups = grouped.groupBy("g").agg(F.max("n").alias("n"), F.sum("lines").alias("lines"), first.alias("first"), F.max("last").alias("last")).where(F.col("first") != F.col("last"))
    # Two documents are enough, or those with enough lines are counted.
    groups = stored(groups.where(F.col("lines") * F.col("n") >= evidence), "groups")
    unsure = F.col("n") * 2 < evidence
    counted = stored(groups.where(unsure).select("g").join(grouped, "g").select("t", "t2", "g"), "unsure")
    in_docs = busy.where(unsure).join(counted, ["t", "t2"]).groupBy("g", "n", "d", "h").agg(F.count(F.lit(1)).alias("k")).groupBy("g").agg((F.count(F.lit(1)) * F.max("n")).alias("weight"))
    often = groups.where(unsure).join(in_docs.where(F.col("weight") >= evidence), "g").select("g", "first")
    many = stored(groups.where(~unsure).select("g", "first").unionByName(often), "recurring")
    return busy, stored(grouped.select("t", "t2", "g").join(many, "g").select("t", "t2", "first"), "dropped")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = 0.75, evidence: int = 16) -> DataFrame:
    """All columns of ``docs`` with recurring lines taken out of the text, and __lines, __dropped, __tokens, __lost.

    The last four count the document's lines and those dropped, its tokens (where lines were
    dropped) and those dropped. They get more underscores if ``docs`` has such names.
    """
    busy, found = recurring(docs, id_col, text_col, similar, evidence)
    d, g, h, own, gone, total, rows_in, *names = fresh(docs, "__d", "__g", "__h", "__own", "__gone", "__sum", "__rows", "__lines", "__dropped", "__tokens", "__lost")
    lost = busy.join(found, ["t", "t2"]).where(F.struct(*_document(F.col("d"), F.col("h"))) != F.col("first"))
    lost = lost.groupBy(F.col("d").alias(d), F.col("h").alias(h)).agg(F.collect_set("i").alias(gone), F.sum("n").alias(total), F.count(F.lit(1)).alias(rows_in))
    rows = docs.withColumn(g, F.xxhash64(text_col)).withColumn(own, F.col(id_col).cast("long")).join(lost, F.col(own).eqNullSafe(F.col(d)) & (F.col(g) == F.col(h)), "left")
    split = F.split(text_col, "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col(gone))
    text = F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(kept, lambda i: F.get(split, i)), "\n"))
    n_lines = F.when(F.col(text_col).isNotNull(), F.length(text_col) - F.length(F.replace(F.col(text_col), F.lit("\n"))) + 1)
    tokens = F.size(F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), r"\s+"), lambda x: x != ""))
    counts = (
        F.coalesce(n_lines, F.lit(0)),
        F.coalesce(F.size(gone), F.lit(0)),
        F.when(F.col(gone).isNotNull(), tokens).otherwise(F.lit(0)),
        # Rows repeated as a whole gave each line several times.
        F.coalesce(F.col(total) * F.size(gone) / F.col(rows_in), F.lit(0)),
    )
    return rows.select(*[text.alias(c) if c == text_col else F.col(c) for c in docs.columns], *[c.cast("long").alias(name) for c, name in zip(counts, names)])


def drop_recurring_lines(docs: DataFrame, most_lost: float = 0.5, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents without recurring lines, with the columns of ``docs``.

    A document that loses more than ``most_lost`` of its tokens is a copy in the main and goes.
    A column n_chars follows the text.
    """
    _, dropped, tokens, lost = fresh(docs, "__lines", "__dropped", "__tokens", "__lost")
    found = dedup_lines(docs, id_col, text_col, **options)
    found = found.where((F.col(dropped) == 0) | (F.col(lost) <= most_lost * F.col(tokens)))
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.when(F.col(dropped) > 0, F.length(text_col).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return found.select(docs.columns)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", "text", F.col("__lines").alias("n_lines"), F.col("__dropped").alias("n_dropped"))


#: The same tree over the table's lines, its nodes named by the tokens on the way.
OP7_SQL = r"""
WITH raw AS (
  SELECT doc_id AS d, str_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL),
line AS (
  SELECT d, k - 1 AS i, trim(regexp_replace(parts[k], '[ \t\x0B\f\r]+', ' ', 'g'), ' ') AS line
  FROM raw, unnest(generate_series(1, len(parts))) AS u(k)),
masked AS (
  SELECT *, length(line) - length(replace(line, ' ', '')) + 1 AS n, regexp_replace(line, '[^ ]*[0-9][^ ]*', '<*>', 'g') AS m FROM line WHERE line <> ''),
placed AS (
  SELECT d, i, n, template, array_to_string(str_split(template, ' ')[1:3], ' ') AS lead
  FROM (SELECT *, CASE WHEN (length(m) - length(replace(m, '<*>', ''))) / 3 * 2 > n THEN line ELSE m END AS template FROM masked)),
n0 AS (SELECT template, n, str_split(template, ' ') AS w, count(*) AS lines, min(struct_pack(d := d, i := i)) AS first, n || ' ' || lead AS node FROM placed GROUP BY template, n, lead),
h1 AS (SELECT node, count(*) AS k, arg_min(w, struct_pack(l := -lines, f := first)) AS head FROM n0 GROUP BY node),
m1 AS (SELECT t.*, n - CAST(ceil(n * 3 / 4.0) AS BIGINT) AS most, list_filter(generate_series(1, n), lambda p: w[p] <> head[p]) AS differs FROM n0 t JOIN h1 USING (node)),
f1 AS (
  SELECT node, list(p ORDER BY c DESC, p)[1 : any_value(most)] AS fields
  FROM (SELECT node, p, any_value(most) AS most, sum(lines) AS c FROM m1, unnest(differs) AS u(p) WHERE len(differs) <= most GROUP BY node, p) GROUP BY node),
j1 AS (SELECT m.*, len(differs) = 0 OR coalesce(len(differs) <= most AND len(list_filter(differs, lambda p: NOT list_contains(fields, p))) = 0, false) AS joins FROM m1 m LEFT JOIN f1 USING (node)),
p1 AS (SELECT node, n, p, count(DISTINCT w[p]) AS c FROM j1, unnest(generate_series(1, n)) AS u(p) WHERE NOT joins GROUP BY ALL),
k1 AS (SELECT node, list(p ORDER BY c, p)[1 : CAST(ceil(n * 1 / 4.0) AS INTEGER)] AS ps FROM p1 GROUP BY node, n),
n1 AS (SELECT template, n, w, lines, first, node || chr(10) || array_to_string(list_transform(ps, lambda p: p || ' ' || w[p]), chr(9)) AS node FROM j1 JOIN k1 USING (node) WHERE NOT joins),
h2 AS (SELECT node, count(*) AS k, arg_min(w, struct_pack(l := -lines, f := first)) AS head FROM n1 GROUP BY node),
m2 AS (SELECT t.*, n - CAST(ceil(n * 3 / 4.0) AS BIGINT) AS most, list_filter(generate_series(1, n), lambda p: w[p] <> head[p]) AS differs FROM n1 t JOIN h2 USING (node)),
f2 AS (
  SELECT node, list(p ORDER BY c DESC, p)[1 : any_value(most)] AS fields
  FROM (SELECT node, p, any_value(most) AS most, sum(lines) AS c FROM m2, unnest(differs) AS u(p) WHERE len(differs) <= most GROUP BY node, p) GROUP BY node),
j2 AS (SELECT m.*, len(differs) = 0 OR coalesce(len(differs) <= most AND len(list_filter(differs, lambda p: NOT list_contains(fields, p))) = 0, false) AS joins FROM m2 m LEFT JOIN f2 USING (node)),
p2 AS (SELECT node, n, p, count(DISTINCT w[p]) AS c FROM j2, unnest(generate_series(1, n)) AS u(p) WHERE NOT joins GROUP BY ALL),
k2 AS (SELECT node, list(p ORDER BY c, p)[1 : CAST(ceil(n * 2 / 4.0) AS INTEGER)] AS ps FROM p2 GROUP BY node, n),
n2 AS (SELECT template, n, w, lines, first, node || chr(10) || array_to_string(list_transform(ps, lambda p: p || ' ' || w[p]), chr(9)) AS node FROM j2 JOIN k2 USING (node) WHERE NOT joins),
h3 AS (SELECT node, count(*) AS k, arg_min(w, struct_pack(l := -lines, f := first)) AS head FROM n2 GROUP BY node),
m3 AS (SELECT t.*, n - CAST(ceil(n * 3 / 4.0) AS BIGINT) AS most, list_filter(generate_series(1, n), lambda p: w[p] <> head[p]) AS differs FROM n2 t JOIN h3 USING (node)),
f3 AS (
  SELECT node, list(p ORDER BY c DESC, p)[1 : any_value(most)] AS fields
  FROM (SELECT node, p, any_value(most) AS most, sum(lines) AS c FROM m3, unnest(differs) AS u(p) WHERE len(differs) <= most GROUP BY node, p) GROUP BY node),
j3 AS (SELECT m.*, len(differs) = 0 OR coalesce(len(differs) <= most AND len(list_filter(differs, lambda p: NOT list_contains(fields, p))) = 0, false) AS joins FROM m3 m LEFT JOIN f3 USING (node)),
p3 AS (SELECT node, n, p, count(DISTINCT w[p]) AS c FROM j3, unnest(generate_series(1, n)) AS u(p) WHERE NOT joins GROUP BY ALL),
k3 AS (SELECT node, list(p ORDER BY c, p)[1 : CAST(ceil(n * 3 / 4.0) AS INTEGER)] AS ps FROM p3 GROUP BY node, n),
n3 AS (SELECT template, n, w, lines, first, node || chr(10) || array_to_string(list_transform(ps, lambda p: p || ' ' || w[p]), chr(9)) AS node FROM j3 JOIN k3 USING (node) WHERE NOT joins),
grouped AS (
  SELECT template, '1 ' || node AS g FROM j1 WHERE joins UNION ALL SELECT template, '2 ' || node FROM j2 WHERE joins UNION ALL SELECT template, '3 ' || node FROM j3 WHERE joins
  UNION ALL SELECT template, node FROM n3),
groups AS (
  SELECT g, min(d) AS first FROM placed JOIN grouped USING (template) GROUP BY g
  HAVING count(DISTINCT d) >= 2 AND count(DISTINCT d) * max(n) >= 16),
gone AS (
  SELECT p.d, list(DISTINCT p.i) AS gone FROM placed p JOIN grouped USING (template) JOIN groups USING (g)
  WHERE p.d <> groups.first GROUP BY p.d)
SELECT doc_id,
       CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_filter(str_split(text, chr(10)), lambda x, k: NOT list_contains(gone, k - 1)), chr(10)) END AS text,
       CAST(coalesce(len(str_split(text, chr(10))), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_dropped
FROM documents LEFT JOIN gone ON doc_id = d
"""
