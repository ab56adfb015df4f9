"""Snapshots of what is to be scanned, and their division into batches."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def snapshot(entity_keys: DataFrame, versions: DataFrame, run_id: str) -> DataFrame:
    """Entity, key and the version of the entity's key set at this moment."""
    return entity_keys.join(versions, "entity_id").select(F.lit(run_id).alias("run_id"), "entity_id", "scan_key", "version")


def scan_keys(snapshot: DataFrame) -> DataFrame:
    return snapshot.select("scan_key").distinct()


def batch_numbers(keys: DataFrame, size: int) -> DataFrame:
    """Every key with its batch: distinct keys in order, a null first, cut every ``size``. Keys are ranged once to find each
    range's first key and its count, a row for each partition; ranks are then counted within the ranges that these first
    keys bound, however Spark deals the keys the second time. A key finds its range by halving the sorted first keys."""
    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = keys.schema["scan_key"].dataType.simpleString()
    ranged = keys.select("scan_key", F.lit(0).alias("__zero")).repartitionByRange(parts, "scan_key").withColumn("__part", F.spark_partition_id())
    found = ranged.groupBy("__part").agg(F.min("scan_key").alias("first"), F.count("*").alias("n")).collect()
    ranges = sorted(found, key=lambda r: (r.first is not None, r.first))
    before = F.array(*map(F.lit, accumulate((r.n for r in ranges), initial=0)))
    firsts = F.array(*(F.lit(r.first) for r in ranges)).cast(f"array<{kind}>")

    def halved(b: Column) -> Column:
        middle = ((b["low"] + b["high"] + 1) / 2).cast("int")
        upper = F.get(firsts, middle) <= F.col("scan_key")
        return F.when(upper, F.struct(middle.alias("low"), b["high"].alias("high"))).otherwise(F.struct(b["low"].alias("low"), F.greatest(middle - 1, b["low"]).alias("high")))

    whole = F.struct(F.lit(0).alias("low"), F.lit(max(len(ranges) - 1, 0)).alias("high"))
    steps = F.sequence(F.lit(0), F.lit(len(ranges).bit_length()))
    own = keys.select("scan_key", F.aggregate(steps, whole, lambda b, _: halved(b))["low"].alias("__range"))
    rank = F.row_number().over(Window.partitionBy("__range").orderBy(F.col("scan_key").asc_nulls_first())) + F.get(before, F.col("__range")) - 1
    return own.select("scan_key", (F.floor(rank / size) + 1).cast("int").alias("batch_number"))


def batch_definitions(numbered: DataFrame) -> DataFrame:
    """A row for each batch; its keys are as many as a batch may hold."""
    return numbered.groupBy("batch_number").agg(F.array_sort(F.collect_list("scan_key")).alias("scan_keys"), F.count("*").cast("int").alias("n_keys"))


def expected_counts(snapshot: DataFrame, definitions: DataFrame) -> DataFrame:
    pairs = snapshot.agg(F.count("*").alias("n_pairs"), F.count_distinct("scan_key").alias("n_keys"))
    return pairs.join(definitions.agg(F.count("*").alias("n_batches")))  # one row each


def exact_cover(definitions: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Whether the batches hold each of the snapshot's keys exactly once and nothing else."""
    dealt = definitions.select(F.explode("scan_keys").alias("scan_key")).groupBy("scan_key").agg(F.count("*").alias("n"))
    both = dealt.join(scan_keys(snapshot).withColumn("due", F.lit(1)), "scan_key", "full_outer")
    checked = both.agg(F.coalesce(F.sum(F.when(F.col("n") > 1, 1).otherwise(0)), F.lit(0)).cast("bigint").alias("repeated"), F.coalesce(F.sum(F.when(F.col("due").isNull(), 1).otherwise(0)), F.lit(0)).cast("bigint").alias("unexpected"), F.coalesce(F.sum(F.when(F.col("n").isNull(), 1).otherwise(0)), F.lit(0)).cast("bigint").alias("missing"))
    return checked.withColumn("exact", (F.col("repeated") + F.col("unexpected") + F.col("missing")) == 0)
