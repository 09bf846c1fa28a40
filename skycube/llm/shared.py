"""What the training-data operators share: intermediate tables, ranged order, components."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from ..sources.scratch import new_path, remove

MOST_BROADCAST = 1 << 18
BATCH_BYTES, SPARK_BATCH_BYTES = 4 << 20, "67108864b"


def bound_batches(spark: SparkSession) -> None:
    """Bounds an Arrow batch by bytes, so that long texts do not add up in a worker.

    Spark's default is 64 MB, which a worker holds several times over. A session that chose a
    bound of its own keeps it; one with the default gets ``BATCH_BYTES`` when it first hands
    texts to Python. A batch has one row at least, so a text of any length passes.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == SPARK_BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def map_texts(df: DataFrame, rows, schema) -> DataFrame:
    """``df.mapInArrow(rows, schema)`` in batches that suit long texts. What Arrow holds goes back after each task."""
    bound_batches(df.sparkSession)

    def run(batches):
        import pyarrow as pa

        try:
            yield from rows(batches)
        finally:
            pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def judge_texts(text: Column, values, schema: str, spark: SparkSession) -> Column:
    """A struct of ``schema`` for each text; ``values`` maps lists of texts (null: empty) to lists of dicts.

    Only the texts go to Python, once, and only the judgement comes back; all other columns
    stay where they are. The column is marked as not deterministic so that a filter on it is
    not evaluated a second time below a projection.
    """
    bound_batches(spark)
    kind = to_arrow_type(StructType.fromDDL(schema))

    @F.arrow_udf(schema)
    def judged(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import pyarrow as pa

        for batch in batches:
            yield pa.array(values([x or "" for x in batch.to_pylist()]), kind)
        pa.default_memory_pool().release_unused()

    return judged.asNondeterministic()(text)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of ``df`` has, made from ``names`` with underscores in front."""
    have, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in have:
            name = "_" + name
        have.add(name.lower())
        out.append(name)
    return out


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors.

    The table stays until ``scratch.clear`` removes what the application wrote.
    """
    return _stored(df, new_path(df.sparkSession, tag))


def _stored(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sized(small: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """The stored table ``small``, to be broadcast if it has at most ``most`` rows.

    For decisions on some documents that meet all texts: the texts then stay where they are.
    With more rows nothing is asked for, and Spark joins by shuffles. Rows are to be of some
    dozens of bytes.
    """
    return F.broadcast(small) if small.count() <= most else small


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z, all other characters as they are."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def components(edges: DataFrame, a: str, b: str, rounds: int = 60) -> DataFrame:
    """Connected components of an edge list as (node, root); root is the smallest node of the component.

    Alternating large-star and small-star steps (Kiveris et al. 2014). A node with many
    neighbours costs a partial-aggregated minimum and one row for each of its edges; no
    neighbour list is gathered anywhere. Every round is a stored table, and the round before it is
    removed.
    """
    spark = edges.sparkSession
    path = new_path(spark, "edges")
    e = _stored(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), path)
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        )
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")))).alias("x"))
            .select("x.u", "x.v").where("u <> v").distinct()
        )
        path, old = new_path(spark, "edges"), path
        new = _stored(small, path)
        # Both are sets; a star forest is reached when a round changes nothing.
        sums = [
            x.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first() for x in (e, new)
        ]
        e = new
        remove(spark, old)
        if sums[0] == sums[1]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    raise RuntimeError(f"components did not settle in {rounds} rounds")
