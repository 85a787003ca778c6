"""Regular-expression matches with their positions, as Spark column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_OUT = "array<struct<start:int,end:int,value:string>>"


def located(text: Column, pattern: str, block: int = 128) -> Column:
    """Leftmost non-overlapping matches as structs of start, end (code points, end exclusive) and value.

    The pieces between the matches come from ``split`` with the same pattern, so
    running lengths give the positions.  They are added up block by block, since
    an array that grows match by match is copied each time: a text with many
    thousand matches would take quadratic time.  No match, or null text: an empty
    array.
    """
    empty = F.array().cast(_OUT)
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    sizes = F.zip_with(F.slice(gaps, F.lit(1), F.size(matches)), matches, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("len"), m.alias("value")))

    def in_blocks(sizes: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / block).cast("int")), lambda i: F.slice(sizes, i * block + 1, F.lit(block)))

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0), lambda n, x: n + x["gap"] + x["len"])

    def starts(blocks: Column) -> Column:
        """Where each block begins, and the end."""
        return F.aggregate(blocks, F.array(F.lit(0)), lambda at, part: F.concat(at, F.array(F.element_at(at, -1) + total(part))))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        one = F.struct(start.alias("start"), (start + x["len"]).alias("end"), x["value"].alias("value"))
        return F.struct((start + x["len"]).alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    def placed(part: Column, at: Column) -> Column:
        return F.aggregate(part, F.struct(at.alias("at"), empty.alias("out")), step, lambda acc: acc["out"])

    # One-element arrays give names to what is used twice, so it is found once.
    whole = F.transform(F.array(in_blocks(sizes)), lambda blocks: F.flatten(F.zip_with(blocks, F.slice(starts(blocks), F.lit(1), F.size(blocks)), placed)))[0]
    return F.when(text.rlike(pattern), whole).otherwise(empty)


def with_kind(spans: Column, kind: str, order: int) -> Column:
    """Spans as structs that sort by start, then by the order of the kinds."""
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def span_text(spans: Column) -> Column:
    """kind:start:end of sorted spans, comma-joined."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
