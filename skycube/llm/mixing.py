"""Mixing sources to target weights by Efraimidis-Spirakis sampling (operator 13), in DataFrame functions only.

Sources weigh ``ratios`` in turn, by code point, null last, and share ``share`` times all words.
No source takes more than ``most`` times its own; what is over goes to the others by weight, until
none is above: of sources in order of size / weight a first part is full, and one level holds for
the rest, which running sums over the table of sources give at once.

A source whose target is above its size is taken whole so many times; the rest of its target is a
weighted sample without replacement. Each document gets the key -ln(u) / weight, u from a hash
of its id and the seed; documents in order of their keys are such a sample, and prefix sums of
their sizes say where the target is met. The document there gives its first words only, so a source
takes its target to less than a word.

Only rows of some dozens of bytes are sorted: in ranges of (source, key), so a source that holds
most rows is many ranges. Sums of the ranges, a row for each range and source, say what lies before
each; within a range the running sum is a window.

Defined cases: a null text has no words and takes none. Rows with one doc_id have one key and are
told by a hash of the text; rows repeated as a whole are alike and each stands for itself. A null
weight counts 1; one that is 0, negative or NaN comes after all others. Sources without words take
none. No rows give no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import fresh, stored

#: ASCII white space, as one text for translate().
SPACE = " \t\n\x0b\f\r"


def word_count(text: Column) -> Column:
    """Number of runs of characters that are not white space; each run becomes one character, so no list of words is made."""
    marks = F.translate(F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "x"), SPACE, "")
    return F.coalesce(F.length(marks).cast("long"), F.lit(0).cast("long"))


def uniform(key: Column, seed: int) -> Column:
    """Above 0, at most 1, from 52 bits of a hash of the seed and the key."""
    return (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, 13), 16, 10).cast("long") + 1) / F.lit(float(1 << 52))


def targets(sizes: DataFrame, share: float = 1.5, ratios: Sequence[int] = (3, 1, 2), most: int = 2) -> DataFrame:
    """(s, source_size, target) from (s, source_size), a row for each source; s orders them. Windows run over the sources alone."""
    place = F.row_number().over(Window.orderBy("s")) - 1
    rows = sizes.withColumn("w", F.element_at(F.array(*[F.lit(int(x)) for x in ratios]), (place % len(ratios) + 1).cast("int")).cast("long"))
    rows = rows.withColumns({"cap": F.col("source_size") * most, "all": F.sum("source_size").over(Window.partitionBy())})
    order = Window.orderBy(F.col("source_size") / F.col("w"), "s")
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumns({"before": before, "open": F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))})
    # Full if a level that held from this source on would be above what it has.
    rows = rows.withColumn("full", F.col("cap") * F.col("open") <= F.col("w") * (F.col("all") * F.lit(float(share)) - F.col("before")))
    every = Window.partitionBy()
    taken, left = F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(every), F.sum(F.when(F.col("full"), 0).otherwise(F.col("w"))).over(every)
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("w") * (F.col("all") * F.lit(float(share)) - taken) / left)
    return rows.select("s", "source_size", target.alias("target"))


def mix(
    docs: DataFrame, share: float = 1.5, ratios: Sequence[int] = (3, 1, 2), most: int = 2, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: DataFrame | None = None
) -> DataFrame:
    """(doc_id, h, size, source_size, target, epochs, taken) of every row of ``docs``; h is a hash of the text.

    ``weights`` has doc_id and weight, of documents whose weight isn't 1; of several the greatest
    counts. A document's words are taken ``epochs`` times whole, then the first
    taken - epochs * size of them.
    """
    # Null comes last.
    s = F.coalesce(F.concat(F.lit("0"), F.col(source_col).cast("string")), F.lit("1")).alias("s")
    rows = stored(docs.select(F.col(id_col).cast("long").alias("doc_id"), s, word_count(F.col(text_col)).alias("size"), F.xxhash64(text_col).alias("h")), "sizes")
    named = stored(targets(rows.groupBy("s").agg(F.sum("size").alias("source_size")), share, ratios, most), "targets")
    if weights is not None:
        w = F.when(F.isnan("weight"), F.lit(0.0)).otherwise(F.col("weight").cast("double"))
        known = weights.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(w).alias("weight")).where("doc_id IS NOT NULL")
        rows = rows.join(known, "doc_id", "left")
    else:
        rows = rows.withColumn("weight", F.lit(1.0))
    w = F.coalesce("weight", F.lit(1.0))
    key = F.when(w > 0, -F.log(uniform(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), seed)) / w).otherwise(F.lit(float("inf")))
    order = ["key", F.col("doc_id").asc_nulls_last(), "h"]
    ranged = rows.select("doc_id", "s", "size", "h", key.alias("key")).repartitionByRange("s", *order)
    # Stored, so that a range keeps its number whatever is computed again.
    ranged = stored(ranged.withColumn("range", F.spark_partition_id()), "ranges")
    sums = ranged.groupBy("range", "s").agg(F.sum("size").alias("n"))
    base = F.sum("n").over(Window.partitionBy("s").orderBy("range")) - F.col("n")
    based = sums.withColumn("base", base).join(named, "s").select("range", "s", "base", "source_size", "target")
    within = F.sum("size").over(Window.partitionBy("range", "s").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    placed = ranged.join(based, ["range", "s"]).withColumn("before", F.col("base") + within)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.floor("target").cast("long") - F.col("epochs") * F.col("source_size") - F.col("before")
    placed = placed.withColumn("epochs", epochs)
    return placed.select("doc_id", "h", "size", "source_size", "target", "epochs", (F.col("epochs") * F.col("size") + F.greatest(F.lit(0), F.least("size", rest))).cast("long").alias("taken"))


def mixed_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The mix itself: a row of ``docs`` for each time it is taken, with a column epoch from 0.

    A row that is taken in part gives its first words, joined by one space. Rows repeated as a
    whole share what they take, so any of them may be the one that is cut.
    """
    d, g, h, own, nth, at, taken, size, epoch = fresh(docs, "__d", "__g", "__h", "__own", "__nth", "__at", "__taken", "__size", "epoch")
    found = mix(docs, id_col=id_col, text_col=text_col, **options)
    alike = Window.partitionBy("doc_id", "h").orderBy(F.col("taken").desc())
    found = found.where("taken > 0").select(F.col("doc_id").alias(d), F.col("h").alias(h), F.col("size").alias(size), F.col("taken").alias(taken), F.row_number().over(alike).alias(at))
    rows = docs.withColumns({g: F.xxhash64(text_col), own: F.col(id_col).cast("long")})
    rows = rows.withColumn(nth, F.row_number().over(Window.partitionBy(own, g).orderBy(own)))
    both = rows.join(found, F.col(own).eqNullSafe(F.col(d)) & (F.col(g) == F.col(h)) & (F.col(nth) == F.col(at)))
    both = both.withColumn(epoch, F.explode(F.sequence(F.lit(0), F.floor((F.col(taken) - 1) / F.col(size)).cast("int"))))
    words = F.least(F.col(size), F.col(taken) - F.col(epoch) * F.col(size))
    first = F.array_join(F.slice(F.filter(F.split(text_col, r"[\x20\x09-\x0D]+"), lambda x: x != ""), F.lit(1), words.cast("int")), " ")
    text = F.when(words < F.col(size), first).otherwise(F.col(text_col))
    return both.select(*[text.alias(c) if c == text_col else F.col(c) for c in docs.columns], F.col(epoch))


def op13_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents labelled as good weigh 2, those labelled as poor 0.5, all others 1."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality IS NOT NULL")
    weights = labels.select("doc_id", F.when(F.col("quality") > 0, F.lit(2.0)).otherwise(F.lit(0.5)).alias("weight"))
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"), weights=weights).select("doc_id", "size", "source_size", "target", "taken")


#: The same keys from MD5; prefix sums of each source by one window.
OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce('0' || source, '1') AS s, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
q AS (SELECT doc_id, max(CASE WHEN quality > 0 THEN 2.0 ELSE 0.5 END)::DOUBLE AS weight FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
sources AS (SELECT s, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY s),
weighed AS (
  SELECT *, CAST([3, 1, 2][CAST((row_number() OVER (ORDER BY s) - 1) % 3 + 1 AS INTEGER)] AS BIGINT) AS w, source_size * 2 AS cap, CAST(sum(source_size) OVER () AS BIGINT) AS total FROM sources),
level AS (
  SELECT *, cap * sum(w) OVER (ORDER BY source_size / w, s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
            <= w * (total * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY source_size / w, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS fills
  FROM weighed),
target AS (
  SELECT s, source_size,
         CASE WHEN fills THEN CAST(cap AS DOUBLE)
              ELSE w * (total * 1.5::DOUBLE - sum(CASE WHEN fills THEN cap ELSE 0 END) OVER ()) / sum(CASE WHEN fills THEN 0 ELSE w END) OVER () END AS target
  FROM level),
keyed AS (
  SELECT d.*, -ln((('0x' || md5('42:' || d.doc_id)[1:13])::BIGINT + 1) / 4503599627370496.0::DOUBLE) / coalesce(weight, 1.0) AS key FROM d LEFT JOIN q USING (doc_id)),
placed AS (
  SELECT k.*, source_size, target, sum(size) OVER (PARTITION BY s ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) - size AS before,
         CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs
  FROM keyed k JOIN target USING (s))
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, CAST(floor(target) AS BIGINT) - epochs * source_size - before)) AS BIGINT) AS taken
FROM placed
"""
