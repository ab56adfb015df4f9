"""Keeping whole texts out of shuffles when a narrow table of keys meets them.

A bitmap of the keys' hashes has SLOTS bits whatever their number, so it can be broadcast. Rows whose bit is unset have no
match for certain and stay where they are; only the others, the matches and a share of the rest that falls as SLOTS / keys
rises, need a join. Results do not depend on the bitmap; with very many keys it lets all rows through to the join.
That join is always one by merging, alike at every size: tables of keys grow with the corpus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.storage import staged

#: 8 MB in all, as rows of one bitmap each.
SLOTS = 1 << 26
ROW_BITS = 1 << 15


def sifted(rows: DataFrame, wanted: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows that may have a match in wanted by the columns of key, and rows that have none. Null keys match nothing."""
    place = F.pmod(F.xxhash64(*key), F.lit(SLOTS))
    bits = wanted.groupBy(F.floor(place / ROW_BITS).alias("__row")).agg(F.bitmap_construct_agg(place % ROW_BITS).alias("__bits"))
    marked = rows.withColumn("__slot", place).withColumn("__row", F.floor(F.col("__slot") / ROW_BITS)).join(F.broadcast(staged(bits, "sieve")), "__row", "left")
    at = F.col("__slot") % ROW_BITS
    byte = F.conv(F.hex(F.substring("__bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))
    return marked.where(is_set).select(*rows.columns), marked.where(~is_set).select(*rows.columns)


def without(rows: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    """Rows that have no match in gone."""
    perhaps, never = sifted(rows, gone, key)
    return perhaps.join(gone.hint("merge"), key, "left_anti").unionByName(never)
