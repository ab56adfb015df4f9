"""What has changed between two versions of a keyed table, found by hashes of key ranges.

A row's leaf is a range of its key's hash. A leaf's digest is its number of rows and two combinations of their hashes that do
not depend on order; digests are summed upwards, FANOUT children to a node, so two equal tables are told by their roots,
and two that differ by the nodes on the way to the leaves that do. A digest has 2^LEAF_BITS leaves at most, whatever the
table's size. ``write`` lays a version out in order of leaves beside its digest, so that a comparison reads the digests and,
of both versions, the row groups of the leaves that differ.

A changed row whose hash did not change (one in 2^64) would go unseen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LEAF_BITS, FANOUT_BITS = 12, 4
LEAF = "__leaf"
ADDED, CHANGED, GONE = "ADDED", "CHANGED", "GONE"
_SUMS = ["n", "x", "s"]


def leaf(keys: list[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(1 << LEAF_BITS)).cast("int")


def digest(table: DataFrame, keys: list[str]) -> DataFrame:
    """(level, node, n, x, s): leaves at the deepest level, and each level above summed from the one below."""
    columns = sorted(c for c in table.columns if c != LEAF)
    row = F.xxhash64(*(F.struct(F.col(c).isNull(), F.col(c)) for c in columns))
    rows = table.select(leaf(keys).alias("node"), row.alias("h"))
    below = rows.groupBy("node").agg(F.count("*").alias("n"), F.bit_xor("h").alias("x"), F.sum(F.pmod(F.xxhash64("h"), F.lit(1 << 31))).alias("s"))
    levels = [below.select(F.lit(LEAF_BITS).alias("level"), "node", *_SUMS)]
    for level in range(LEAF_BITS - FANOUT_BITS, -1, -FANOUT_BITS):
        up = F.shiftright("node", LEAF_BITS - level).alias("node")
        levels.append(below.groupBy(up).agg(F.sum("n").alias("n"), F.bit_xor("x").alias("x"), F.sum("s").alias("s")).select(F.lit(level).alias("level"), "node", *_SUMS))
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more)
    return out


def differing(old: DataFrame, new: DataFrame) -> list[int]:
    """The leaves that differ, from the roots down: of each level only the children of nodes that do are looked at, 2^LEAF_BITS
    at most. old, new: written digests."""
    nodes = [0]
    for level in range(0, LEAF_BITS + 1, FANOUT_BITS):
        wanted = nodes if level == 0 else [n << FANOUT_BITS | k for n in nodes for k in range(1 << FANOUT_BITS)]
        of = lambda d: d.where((F.col("level") == level) & F.col("node").isin(wanted)).select("node", F.struct(*_SUMS).alias("d"))  # noqa: E731, B023
        both = of(old).join(of(new).withColumnRenamed("d", "e"), "node", "full_outer")
        nodes = sorted(r.node for r in both.where(~F.col("d").eqNullSafe(F.col("e"))).select("node").collect())
        if not nodes:
            return []
    return nodes


def compared(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, kind, columns): rows that only new has, only old has, or both with other values in some columns."""
    values = [c for c in old.columns if c not in keys and c != LEAF]
    a, b = (d.select(*keys, F.struct(*values).alias(name)) for d, name in ((old, "__a"), (new, "__b")))
    joined = a.join(b, keys, "full_outer")
    changed = F.filter(F.array(*(F.when(~F.col(f"__a.{c}").eqNullSafe(F.col(f"__b.{c}")), F.lit(c)) for c in values)), lambda c: c.isNotNull())
    kind = F.when(F.col("__a").isNull(), ADDED).when(F.col("__b").isNull(), GONE).when(F.size("columns") > 0, CHANGED)
    shown = joined.withColumn("columns", F.when(F.col("__a").isNotNull() & F.col("__b").isNotNull(), F.array_sort(changed)).otherwise(F.array().cast("array<string>")))
    return shown.withColumn("kind", kind).where("kind IS NOT NULL").select(*keys, "kind", "columns")


def write(table: DataFrame, keys: list[str], path: str) -> None:
    """A version of a table, in order of leaves, and its digest from what was written."""
    spark = table.sparkSession
    table.withColumn(LEAF, leaf(keys)).repartitionByRange(LEAF).sortWithinPartitions(LEAF).write.parquet(f"{path}/rows")
    digest(spark.read.parquet(f"{path}/rows").drop(LEAF), keys).coalesce(1).write.parquet(f"{path}/digest")


def between(spark: SparkSession, old: str, new: str, keys: list[str]) -> DataFrame:
    """compared for two written versions. Row groups of equal leaves are not read."""
    leaves = differing(*(spark.read.parquet(f"{p}/digest") for p in (old, new)))
    at = F.col(LEAF).between(leaves[0], leaves[-1]) & F.col(LEAF).isin(leaves) if leaves else F.lit(False)
    return compared(*(spark.read.parquet(f"{p}/rows").where(at) for p in (old, new)), keys)


def of_tables(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """compared for two plans: rows of leaves whose digests differ, found in one pass over each, meet; the others stay where
    they are."""
    leaves = [digest(d, keys).where(F.col("level") == LEAF_BITS).select("node", F.struct(*_SUMS).alias(name)) for d, name in ((old, "d"), (new, "e"))]
    apart = leaves[0].join(leaves[1], "node", "full_outer").where(~F.col("d").eqNullSafe(F.col("e"))).select(F.col("node").alias(LEAF))
    some = [d.withColumn(LEAF, leaf(keys)).join(F.broadcast(apart), LEAF, "left_semi") for d in (old, new)]  # 2^LEAF_BITS rows at most
    return compared(*some, keys)
