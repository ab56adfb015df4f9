import random

import pytest
from pyspark.sql import functions as F

from wardline.operators import audit, deltas, feeds
from wardline.plans import control, reading
from wardline.plans.publish import COVERAGE, rules
from wardline.sources import paged

SCHEMA = "k long, part string, a string, b double"


def versions(seed=1, n=3000):
    rng = random.Random(seed)
    old = {(k, "p" if k % 2 else None): (rng.choice(["x", None, "y"]), rng.choice([0.5, None])) for k in range(n)}
    new = dict(old)
    want = {}
    for k in rng.sample(sorted(old, key=str), 9):
        kind = rng.choice(["gone", "changed", "both"])
        if kind == "gone":
            del new[k]
            want[k] = ("GONE", [])
        else:
            a, b = old[k]
            new[k] = ("changed", b if kind == "changed" else 9.0)
            want[k] = ("CHANGED", ["a"] if kind == "changed" else ["a", "b"])
    new[(10**6, "new")] = (None, None)
    return old, new, want | {(10**6, "new"): ("ADDED", [])}


def table(spark, rows):
    return spark.createDataFrame([(*k, *v) for k, v in rows.items()], SCHEMA).withColumn("part", F.coalesce("part", F.lit(""))).repartition(4)


def test_only_differing_leaves_are_read(spark, tmp_path):
    old, new, want = versions()
    keys = ["k", "part"]
    for name, rows in (("old", old), ("new", new)):
        deltas.write(table(spark, rows), keys, str(tmp_path / name))
    got = deltas.between(spark, str(tmp_path / "old"), str(tmp_path / "new"), keys)
    shown = {(r.k, r.part): (r.kind, list(r.columns)) for r in got.collect()}
    assert shown == {(k, p or ""): v for (k, p), v in want.items()}
    leaves = deltas.differing(*(spark.read.parquet(str(tmp_path / v / "digest")) for v in ("old", "new")))
    assert 0 < len(leaves) <= len(want)
    rows = spark.read.parquet(str(tmp_path / "old" / "rows")).where(F.col(deltas.LEAF).isin(leaves)).count()
    assert rows < len(old) / 20
    assert "PushedFilters: [IsNotNull(__leaf)" in got._jdf.queryExecution().toString() or "In(__leaf" in got._jdf.queryExecution().toString()
    same = {(r.k, r.part): (r.kind, list(r.columns)) for r in deltas.of_tables(table(spark, old), table(spark, new), keys).collect()}
    assert same == shown
    top = {(r.level, r.n) for r in spark.read.parquet(str(tmp_path / "old" / "digest")).where("level = 0").collect()}
    assert top == {(0, len(old))}


def test_equal_tables_are_told_by_their_roots(spark, tmp_path):
    old, *_ = versions()
    for name in ("one", "two"):
        deltas.write(table(spark, old), ["k", "part"], str(tmp_path / name))
    assert deltas.differing(*(spark.read.parquet(str(tmp_path / v / "digest")) for v in ("one", "two"))) == []
    assert deltas.between(spark, str(tmp_path / "one"), str(tmp_path / "two"), ["k", "part"]).count() == 0
    empty = table(spark, old).limit(0)
    assert deltas.of_tables(empty, empty, ["k", "part"]).count() == 0 and deltas.of_tables(empty, table(spark, old), ["k", "part"]).count() == len(old)
    twice = table(spark, old).unionByName(table(spark, old))
    assert deltas.digest(twice, ["k", "part"]).where("level = 0").collect()[0].n == 2 * len(old)


def test_bitmaps_count_exactly_and_merge(spark):
    rng = random.Random(2)
    landings = [[rng.randrange(1_000_000, 1_090_000) for _ in range(4000)] + [None] for _ in range(3)]
    maps = [audit.key_bitmaps(spark.createDataFrame([(str(k) if k else None,) for k in ks], "key string"), F.col("key")) for ks in landings]
    merged = maps[0]
    for more in maps[1:]:  # each landing is merged into what there was
        merged = audit.merged_bitmaps(merged.unionByName(more))
    assert audit.distinct_in(merged).collect()[0].distinct_keys == len({k for ks in landings for k in ks if k})
    assert audit.distinct_in(maps[0].limit(0)).collect()[0].distinct_keys == 0


@pytest.fixture
def store(spark, tmp_path):
    store = control.Store(spark, str(tmp_path / "store"))
    store.publish({
        "live": spark.createDataFrame([(f"id{k}", f"s{k}", "r", "1000001", None, None, "ACTIVE", None, None, "r0", True, None, None) for k in range(3)], "id string, source_id string, row_id string, scan_key string, number string, issue_date date, status string, balance_due decimal(15,2), updated_at timestamp, last_run_id string, is_current boolean, created_at timestamp, modified_at timestamp"),
        "entity_keys": spark.createDataFrame([(1, "1000001"), (2, "1000009")], "entity_id int, scan_key string"),
        "coverage": spark.createDataFrame([(1, "NOT_CHECKED", "NEVER_INGESTED", None, None, None, None, None, None)], COVERAGE),
    })
    return store


def test_a_broken_rule_leaves_the_old_state_in_force(store):
    before = store.versions()
    live, coverage = store.table("live"), store.table("coverage")
    bad = [
        {"live": live.withColumn("scan_key", F.when(F.col("source_id") != "s1", F.col("scan_key")))},
        {"live": live, "coverage": coverage.withColumn("status", F.lit("FAILED"))},
        {"coverage": coverage.withColumn("status", F.lit("CHECKED"))},
        {"coverage": coverage.withColumn("status", F.lit(None).cast("string"))},
    ]
    for tables in bad:
        with pytest.raises(Exception, match="RULE_BROKEN"):
            store.publish(tables, rules=rules())
        assert store.versions() == before
    now = store.publish({"live": live, "coverage": coverage}, rules=rules())
    assert now["live"] != before["live"] and store.table("live").count() == 3


def test_a_page_and_its_coverage_come_from_one_state(store, monkeypatch):
    query = feeds.FeedQuery(limit=2)
    rows, cursor, covered = reading.entity_page(store, 1, query)
    assert [r.source_id for r in rows] == ["s2", "s1"] and cursor and covered.status == "NOT_CHECKED"
    assert reading.entity_page(store, 2, query) == ([], None, None)
    read = feeds.read_page

    def meanwhile(*args):
        """A run is published between the two reads."""
        store.publish({"live": store.table("live").limit(0), "coverage": store.table("coverage").withColumns({"status": F.lit("FAILED"), "last_error": F.lit("x")})})
        return read(*args)

    monkeypatch.setattr(feeds, "read_page", meanwhile)
    rows, _, covered = reading.entity_page(store, 1, query)
    assert len(rows) == 2 and covered.status == "NOT_CHECKED"
    monkeypatch.undo()
    assert reading.entity_page(store, 1, query)[2].status == "FAILED"


def test_a_slow_request_times_out():
    import time

    calls = paged.Calls()
    with pytest.raises(TimeoutError):
        paged.retrying(lambda: time.sleep(5), 2, 0, calls, timeout=0.05)()
    assert (calls.requests, calls.retries) == (2, 1)
    assert paged.retrying(lambda x: x + 1, timeout=5)(1) == 2
    with pytest.raises(paged.RemoteError):
        paged.retrying(lambda: (_ for _ in ()).throw(paged.RemoteError(404)), timeout=5)()
