"""Spans of regular-expression matches as DataFrame expressions: no Python touches a text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:bigint,end:bigint,match:string,before:string>>"
_CHUNK = 256


def _walk(pairs: Column, context: int) -> Column:
    """(length, spans) of (gap, match) pairs that lie one after the other."""
    begin = F.expr(f"named_struct('at', 0L, 'spans', cast(array() as {SPAN}))")

    def step(a: Column, x: Column) -> Column:
        start = a["at"] + F.length(x["gap"])
        end = start + F.length(x["match"])
        span = F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"), x["match"].alias("match"), F.right(x["gap"], F.lit(context)).alias("before"))
        return F.struct(end.cast("long").alias("at"), F.concat(a["spans"], F.array(span)).alias("spans"))

    return F.aggregate(pairs, begin, step)


def find_spans(text: Column, pattern: str, context: int = 0) -> Column:
    """Leftmost non-overlapping matches with code-point offsets, end exclusive.

    What lies between matches comes from ``split``, the matches from ``regexp_extract_all``; both
    walk the text alike. Offsets are running sums, taken by chunks so that a text with very
    many matches does not cost the square of their number. No match may be empty. ``before`` has
    up to ``context`` characters before a match, back to the one before it.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    pairs = F.arrays_zip(F.slice(gaps, 1, F.size(gaps) - 1).alias("gap"), found.alias("match"))
    pairs = F.transform(pairs, lambda x: F.struct(x["gap"].alias("gap"), x["match"].alias("match")))
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / _CHUNK).cast("int")), lambda k: _walk(F.slice(pairs, k * _CHUNK + 1, F.lit(_CHUNK)), context))
    begin = F.expr(f"named_struct('at', 0L, 'spans', cast(array() as {SPAN}))")

    def join(a: Column, x: Column) -> Column:
        moved = F.transform(x["spans"], lambda s: F.struct((s["start"] + a["at"]).alias("start"), (s["end"] + a["at"]).alias("end"), s["match"].alias("match"), s["before"].alias("before")))
        return F.struct((a["at"] + x["at"]).alias("at"), F.concat(a["spans"], moved).alias("spans"))

    return F.aggregate(chunks, begin, join)["spans"]


def no_spans() -> Column:
    return F.expr(f"cast(array() as {SPAN})")


def labelled(spans: Column, kind: str, rank: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def joined(spans: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined. Structs start with (start, rank)."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
