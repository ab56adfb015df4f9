"""Column helpers that keep higher-order expressions linear."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Array elements that one fold appends to; a fold copies its array at each step.
CHUNK = 128


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body over a value that is computed once, however often a lambda inside body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def scan(values: Column, zero: Column, step: Callable[[Column, Column], Column]) -> Column:
    """[zero, zero + v0, zero + v0 + v1, ...], one longer than values (ints), where + is ``step``, associative with ``zero``
    neutral. Folds within chunks, then over the chunks' totals."""

    def fold(vs: Column) -> Column:
        return F.aggregate(vs, F.array(zero), lambda acc, x: F.concat(acc, F.array(step(F.element_at(acc, -1), x))))

    def chunked(v: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), ((F.size(v) - 1) / CHUNK).cast("int")), lambda j: fold(F.slice(v, j * CHUNK + 1, CHUNK)))
        return let(chunks, lambda cs: let(fold(F.transform(cs, lambda c: F.element_at(c, -1))), lambda starts: F.concat(F.array(zero), F.flatten(F.zip_with(cs, F.slice(starts, 1, F.size(cs)), lambda c, at: F.transform(F.slice(c, 2, F.size(c)), lambda x: step(at, x)))))))

    return let(values.cast("array<int>"), lambda v: F.when(F.size(v) == 0, F.array(zero)).otherwise(chunked(v)))


def prefix_sums(sizes: Column) -> Column:
    """[0, s0, s0 + s1, ...], one longer than sizes."""
    return scan(sizes, F.lit(0), lambda a, x: a + x)


def prefix_maxima(values: Column) -> Column:
    """[0, the greatest of 0 and v0, of these and v1, ...], one longer than values."""
    return scan(values, F.lit(0), lambda a, x: F.greatest(a, x))


def matches(text: Column, pattern: str) -> Column:
    """All matches of a pattern, leftmost and not overlapping, as structs of start, end (code points) and value."""
    kind = "array<struct<start:int,end:int,value:string>>"

    def placed(values: Column) -> Column:
        sizes = F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(values)), values, lambda gap, x: F.char_length(gap) + F.char_length(x))
        ends = F.slice(prefix_sums(sizes), 2, F.size(values))
        return F.zip_with(ends, values, lambda end, x: F.struct((end - F.char_length(x)).alias("start"), end.alias("end"), x.alias("value")))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda v: F.when(F.size(v) == 0, F.array().cast(kind)).otherwise(placed(v).cast(kind)))


#: Groups whose sketches are merged side by side before the last merge.
MERGERS = 64


def top_items(df: DataFrame, column: str, k: int, tracked: int) -> DataFrame:
    """(item, count) of about the k most frequent values, by a sketch of ``tracked`` entries for each task. Sketches are
    merged in two levels, so that no task merges those of all others; no rows give no items."""
    grouped = df.select(column, (F.spark_partition_id() % MERGERS).alias("__merger")).groupBy("__merger")
    parts = grouped.agg(F.expr(f"approx_top_k_accumulate({column}, {tracked})").alias("sketch"))
    whole = parts.groupBy(F.lit(0).alias("all")).agg(F.expr(f"approx_top_k_combine(sketch, {tracked})").alias("sketch"))
    return whole.select(F.explode(F.expr(f"approx_top_k_estimate(sketch, {k})")).alias("top")).select("top.item", "top.count")
