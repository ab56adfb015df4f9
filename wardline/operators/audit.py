"""Contracts of a source, and audits of what runs have stored."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def contract_stats(source: DataFrame, key: str) -> DataFrame:
    """Exact counts: they are compared for equality."""
    return source.agg(F.count("*").alias("total_rows"), F.count_distinct(key).alias("distinct_keys"), F.count_if(F.col(key).isNull()).alias("null_keys"))


def duplicate_groups(source: DataFrame, key: str) -> DataFrame:
    return source.groupBy(key).agg(F.count("*").alias("n")).where((F.col("n") > 1) & F.col(key).isNotNull())


def contract_verdict(source: DataFrame, key: str) -> DataFrame:
    """All counts from one grouping by key."""
    each = source.groupBy(key).agg(F.count("*").alias("n"))
    real = F.col(key).isNotNull()
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    stats = each.agg(total("n").alias("total_rows"), F.count_if(real).alias("distinct_keys"), total(F.when(~real, F.col("n"))).alias("null_keys"), F.count_if(real & (F.col("n") > 1)).alias("duplicate_groups"))
    holds = (F.col("null_keys") == 0) & (F.col("duplicate_groups") == 0) & (F.col("total_rows") == F.col("distinct_keys"))
    return stats.withColumn("holds", holds)


def run_metrics(batches: DataFrame) -> DataFrame:
    status = lambda s: F.count_if(F.col("status") == s).alias(f"n_{s.lower()}")
    return batches.groupBy("run_id").agg(F.count("*").alias("n_batches"), *map(status, ("PENDING", "COMPLETED", "FAILED")), F.coalesce(F.sum("rows_fetched"), F.lit(0)).cast("bigint").alias("rows_fetched"), F.bool_or(F.col("status") != "COMPLETED").alias("any_open"))


def request_delta(after: DataFrame, before: DataFrame, key: str) -> DataFrame:
    """What counters that only rise have risen by, for each key; one that restarted counts as not risen."""
    counters = [c for c in after.columns if c != key]
    old = before.select(key, *(F.col(c).alias(f"__{c}") for c in counters))
    risen = [F.greatest(F.lit(0), F.col(c) - F.coalesce(f"__{c}", F.lit(0))).cast("bigint").alias(c) for c in counters]
    return after.join(old, key, "left").select(key, *risen)


def operational_summary(runs: DataFrame, snapshot: DataFrame, batches: DataFrame, written: DataFrame) -> DataFrame:
    """For each run: keys scanned, first calls, retries and all calls, rows fetched and written, and failures: none of a run that
    is complete, else its failed batches, at least one."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    calls = batches.groupBy("run_id").agg(total(F.col("requests") - F.col("retries")).alias("data_calls"), total("retries").alias("retry_calls"), total("requests").alias("total_calls"), total("rows_fetched").alias("rows_fetched"), F.count_if(F.col("status") == "FAILED").alias("failed"))
    scanned = snapshot.groupBy("run_id").agg(F.count_distinct("scan_key").alias("keys_scanned"))
    rows = written.groupBy("run_id").agg(F.count("*").alias("rows_written"))
    joined = reduce(lambda a, b: a.join(b, "run_id", "left"), (scanned, calls, rows), runs.select("run_id", "status")).na.fill(0)
    return joined.withColumn("failures", F.when(F.col("status") == "COMPLETED", F.lit(0)).otherwise(F.greatest(F.lit(1), F.col("failed"))).cast("bigint")).drop("failed")


def duplicate_audit(tables: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """For each table: rows, distinct keys, and the difference."""
    each = []
    for name, (table, keys) in tables.items():
        whole = table.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("total"), F.count("*").alias("distinct_keys"))
        each.append(whole.select(F.lit(name).alias("table_name"), "total", "distinct_keys", (F.col("total") - F.col("distinct_keys")).alias("excess")))
    return reduce(DataFrame.unionByName, each)


def run_audit(runs: DataFrame, snapshot: DataFrame, batches: DataFrame, staged: DataFrame) -> DataFrame:
    """A row for each run, from one grouped count of each table."""
    parts = [
        snapshot.groupBy("run_id").agg(F.count("*").alias("n_pairs"), F.count_distinct("entity_id").alias("n_entities"), F.count_distinct("scan_key").alias("n_keys")),
        batches.groupBy("run_id").agg(F.count("*").alias("n_batches"), F.coalesce(F.sum("rows_fetched"), F.lit(0)).cast("bigint").alias("rows_fetched")),
        staged.groupBy("run_id").agg(F.count("*").alias("n_staged"), F.count_distinct("source_id").alias("n_sources")),
    ]
    out = reduce(lambda a, b: a.join(b, "run_id", "left"), parts, runs.select("run_id", "status"))
    return out.na.fill(0)


def violations(table: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, n) of each rule that some rows break. A rule is what must hold; null breaks it."""
    broken = table.agg(*(F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in rules.items()))
    pairs = F.array(*(F.struct(F.lit(name).alias("rule"), F.col(name).alias("n")) for name in rules))
    return broken.select(F.explode(pairs).alias("r")).select("r.rule", "r.n").where("n > 0")


def enforced(table: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """table, whose plan fails at the first row that breaks a rule: what writes it stops before anything is in force."""
    broken = F.coalesce(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()), F.lit(None).cast("string"))
    stop = F.raise_error(F.concat(F.lit("RULE_BROKEN "), broken)).cast("boolean")
    return table.where(F.when(broken.isNotNull(), stop).otherwise(F.lit(True)))


def key_bitmaps(rows: DataFrame, key: Column) -> DataFrame:
    """(bucket, bits): which whole-number keys rows have, a bit each. Bitmaps of folders that landed apart are merged by
    ``merged_bitmaps``, so a count of distinct keys reads new rows alone."""
    number = key.cast("long")
    return rows.where(number.isNotNull()).groupBy(F.bitmap_bucket_number(number).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("bits"))


def merged_bitmaps(bitmaps: DataFrame) -> DataFrame:
    return bitmaps.groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def distinct_in(bitmaps: DataFrame) -> DataFrame:
    """The exact number of distinct keys. bitmaps: one row a bucket."""
    return bitmaps.agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("distinct_keys"))


def run_rules() -> dict[str, Column]:
    started = F.col("status").isin("RUNNING", "COMPLETED", "SOURCE_CHANGED")
    has = F.col("start_version").isNotNull()
    return {
        "started_runs_are_initialised": ~started | (F.col("initialised") & has),
        "queued_runs_have_no_version": (F.col("status") != "QUEUED") | ~has,
        "a_version_needs_initialisation": ~has | F.col("initialised"),
        "counts_are_not_negative": F.coalesce(F.col("expected_pairs"), F.lit(0)) >= 0,
    }


def same_mapping(left: DataFrame, right: DataFrame) -> DataFrame:
    """(missing, unexpected): rows, counted with their repetition, that only the left or only the right has."""
    def counted(d: DataFrame, sign: int) -> DataFrame:
        return d.groupBy(*left.columns).agg((F.count("*") * sign).alias("n"))

    delta = counted(left, 1).unionByName(counted(right.select(*left.columns), -1)).groupBy(*left.columns).agg(F.sum("n").alias("n"))
    more = lambda sign: F.coalesce(F.sum(F.when(F.col("n") * sign > 0, F.abs("n"))), F.lit(0)).cast("bigint")
    return delta.agg(more(1).alias("missing"), more(-1).alias("unexpected"))


def seed_checks(seed: DataFrame, key: str) -> DataFrame:
    """Whether the keys are unique, and in order by position: each is compared with the one before it in its range of positions,
    and each range that has rows with the last before it, however far. Rows of one position are ordered by key; those without a
    position or a key are counted but are no part of the order."""
    size = 10_000
    placed = seed.where(F.col("pos").isNotNull() & F.col(key).isNotNull())
    ranges = placed.groupBy(F.floor(F.col("pos") / size).alias("range")).agg(F.collect_list(F.struct("pos", F.col(key).alias("k"))).alias("rows"))
    keys = ranges.select("range", F.transform(F.array_sort("rows"), lambda r: r["k"]).alias("ks"))
    checked = keys.select("range", (F.array_sort("ks") == F.col("ks")).alias("sorted"), F.get("ks", F.lit(0)).alias("first"), F.element_at("ks", -1).alias("last"))
    before = F.lag("last").over(Window.orderBy("range"))  # a row for each range
    order = checked.withColumn("before", before).agg(F.coalesce(F.bool_and(F.col("sorted") & F.coalesce(F.col("before") <= F.col("first"), F.lit(True))), F.lit(True)).alias("in_order"))
    return seed.agg(F.count("*").alias("total"), F.count_distinct(key).alias("distinct_keys")).join(order)  # one row each
