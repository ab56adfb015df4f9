import datetime as dt
import re
from pathlib import Path

from pyspark.sql import functions as F

from wardline.operators import feeds
from wardline.plans import bucketed, publish, reading
from wardline.queries import Tables

AT = dt.datetime(2026, 1, 2)


def test_live_rows_are_never_exchanged(spark, tmp_path):
    """Equals promotion and reconciliation by shuffles, run after run, and each version is dealt as the one before."""
    t = Tables(spark, "/root/testdata/sf0.001")
    live, staged, scope = (d.withColumn("scan_key", F.col("scan_key").cast("string")) for d in (t.live, t.staged, t.snapshot))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in live.schema)
    staged_schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in staged.schema)
    path = lambda name: str(tmp_path / name)
    bucketed.write(live, path("live-0"), 4)
    bucketed.write(staged, path("staged"), 4)
    bucketed.bitmaps(scope).write.parquet(path("scanned"))
    want = live
    for k, run in enumerate(("r1", "r2")):
        now = bucketed.published(bucketed.read(spark, path(f"live-{k}"), schema, 4), bucketed.read(spark, path("staged"), staged_schema, 4), spark.read.parquet(path("scanned")), run, AT)
        plan = now._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and not re.search("Exchange (hash|range|single|round)", plan) and plan.count("Bucketed: true") == 2
        bucketed.write(now, path(f"live-{k + 1}"), 4, dealt=True)
        want = publish.reconcile(publish.promote(want, staged, run, AT), scope, run)
        got = bucketed.read(spark, path(f"live-{k + 1}"), schema, 4)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect()))
        assert len(list(Path(path(f"live-{k + 1}")).glob("*.parquet"))) == 4  # a file for each bucket
    assert got.where("NOT is_current").count() > live.where("NOT is_current").count()


def test_scanned_keys_are_bounded(spark):
    keys = spark.createDataFrame([(k,) for k in ("1000001", "9999999", "0000000", "10000000", "-1", "x", None)], "scan_key string")
    maps = bucketed.bitmaps(keys)
    assert maps.agg(F.sum(F.bitmap_count("bits"))).collect()[0][0] == 3 and all(len(r.bits) <= 4096 for r in maps.collect())


def scanned_rows(df):
    """Rows that the leaves of a plan have read, once it has run."""
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan
    leaves = plan.collectLeaves()
    return sum(leaves.apply(k).metrics().apply("numOutputRows").value() for k in range(leaves.size()))


def test_a_page_of_few_keys_skips_files(spark, tmp_path):
    """Over the live facts of sf0.1: rows as by the semi join, of which the scan reads a small share."""
    live = Tables(spark, "/root/testdata/sf0.1").live
    keys = spark.createDataFrame([(1, k) for k in (17, 4711, 9000, 14999)] + [(2, 10**8)], "entity_id int, scan_key long")
    reading.write_by_key(live, str(tmp_path / "by-key"), 16)
    laid = spark.read.parquet(str(tmp_path / "by-key"))
    page = feeds.page(reading.of_keys(laid, keys, 1).where(feeds.current()), 50)
    want = feeds.page(feeds.of_entity(live.where(feeds.current()), keys, 1), 50)
    assert sorted(map(str, page.collect())) == sorted(map(str, want.collect())) and page.count() > 20
    rows = reading.of_keys(laid, keys, 1)
    assert len(rows.collect()) > 20 and scanned_rows(rows) < 0.3 * live.count()
    assert reading.of_keys(laid, keys, 2).count() == 0 and reading.of_keys(laid, keys, 3).count() == 0
