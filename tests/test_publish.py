import datetime as dt

from pyspark.sql import functions as F

from wardline.operators import audit, merge, snapshots
from wardline.plans import publish

LIVE = "id string, source_id string, scan_key string, status string, is_current boolean, last_run_id string"
T = [dt.datetime(2026, 1, d) for d in range(1, 10)]
RUN = publish.Run("a-run", T[4], T[5], T[3])


def coverage(spark, rows):
    return spark.createDataFrame(rows, publish.COVERAGE)


def runs(spark):
    return spark.createDataFrame([("z-old", T[1]), ("a-run", T[4]), ("0-new", T[6])], "run_id string, started_at timestamp")


def test_promotion_and_replay(spark):
    live = spark.createDataFrame([("i1", "s1", "k1", "OLD", False, "r0"), ("i2", "s2", "k1", "OLD", True, "r0"), ("i3", "s3", "k9", "OLD", True, "r0")], LIVE)
    staged = spark.createDataFrame([("s1", "k1", "NEW"), ("s4", "k1", "NEW")], "source_id string, scan_key string, status string")
    scope = spark.createDataFrame([("k1",), ("k1",)], "scan_key string")
    for _ in range(2):
        live = publish.reconcile(publish.promote(live, staged, "r1"), scope, "r1")
        got = {r.source_id: (r.id, r.status, r.is_current, r.last_run_id) for r in live.collect()}
        assert got == {"s1": ("i1", "NEW", True, "r1"), "s2": ("i2", "OLD", False, "r0"), "s3": ("i3", "OLD", True, "r0"), "s4": (None, "NEW", True, "r1")}


def test_merge_keeps_what_changes_lack(spark):
    table = spark.createDataFrame([(1, "a", 10), (2, "b", 20)], "k int, x string, y int")
    out = merge.merged(table, spark.createDataFrame([(2, None), (3, "c")], "k int, x string"), ["k"], insert={"y": F.lit(-1)})
    assert sorted(map(tuple, out.collect())) == [(1, "a", 10), (2, None, 20), (3, "c", -1)]
    longer = merge.merged(table, spark.createDataFrame([(1, 5)], "k int, y int"), ["k"], update={"y": lambda old, new: F.greatest(old, new)})
    assert sorted(map(tuple, longer.collect())) == [(1, "a", 10), (2, "b", 20)]


def test_first_and_last(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 3, "c")], "k int, at int, v string")
    assert {r.v for r in merge.first_wins(rows, ["k"], ["at"]).collect()} == {"a", "c"}
    assert {r.v for r in merge.last_wins(rows, ["k"], ["at"]).collect()} == {"b", "c"}
    new = merge.insert_if_absent(rows.where("k = 1"), rows, ["k"], ["at"])
    assert [r.v for r in new.collect()] == ["c"]
    assert merge.insert_if_absent(rows, rows, ["k"], ["at"]).count() == 0


def test_coverage_of_an_accepted_run(spark):
    snap = spark.createDataFrame([(e, f"k{e}", 1) for e in (1, 2, 3, 4, 4)], "entity_id int, scan_key string, version int")
    versions = spark.createDataFrame([(1, 1), (2, 2), (3, 1), (4, 1)], "entity_id int, version int")
    old = coverage(spark, [(2, "CHECKED", None, "z-old", "z-old", T[1], T[1], T[0], None), (3, "CHECKED", None, "z-old", "0-new", T[7], T[7], T[6], None), (9, "FAILED", None, "z-old", None, T[1], None, None, "e")])
    now = publish.merge_coverage(old, publish.success_changes(snap, versions, old, runs(spark), RUN))
    now = publish.merge_coverage(now, publish.stale_changes(snap, versions, old, runs(spark), RUN))
    got = {r.entity_id: r for r in now.collect()}
    assert tuple(got[1]) == (1, "CHECKED", None, "a-run", "a-run", T[5], T[5], T[3], None) and got[4].status == "CHECKED"
    # changed since the snapshot: what was learned stays
    assert (got[2].status, got[2].status_reason, got[2].last_success_run_id, got[2].last_success_at) == ("NOT_CHECKED", "IDENTIFIERS_CHANGED_AFTER_SNAPSHOT", "z-old", T[1])
    assert tuple(got[3]) == tuple(old.where("entity_id = 3").first())  # a newer run wrote it
    assert tuple(got[9]) == tuple(old.where("entity_id = 9").first())


def test_coverage_of_a_failed_run(spark):
    snap = spark.createDataFrame([(1, "k1", 1), (1, "k2", 1), (2, "k3", 1), (3, "k4", 1)], "entity_id int, scan_key string, version int")
    versions = spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "entity_id int, version int")
    batches = spark.createDataFrame([(1, "FAILED", " ", '{"keys":["k3"]}'), (2, "FAILED", "TIMEOUT", '{"keys":["k2"]}'), (3, "FAILED", "LATER", '{"keys":["k1"]}'), (4, "FAILED", "ODD", '{"keys":"k3"}'), (5, "COMPLETED", "x", '{"keys":["k3"]}')], "batch_number int, status string, last_error string, definition string")
    old = coverage(spark, [(1, "CHECKED", None, "z-old", "z-old", T[1], T[1], T[0], None)])
    got = {r.entity_id: r for r in publish.merge_coverage(old, publish.failure_changes(snap, versions, batches, RUN)).collect()}
    assert (got[1].status, got[1].last_error, got[1].last_attempt_run_id, got[1].last_success_run_id, got[1].last_success_at) == ("FAILED", "TIMEOUT", "a-run", "z-old", T[1])
    assert got[2].last_error == "RUN_NOT_PROMOTED" and set(got) == {1, 2}
    changed = {r.entity_id: r.last_error for r in publish.failure_changes(snap, versions, batches, RUN, source_changed=True).collect()}
    assert changed == {1: "SOURCE_CHANGED", 2: "SOURCE_CHANGED"}


def test_batches_cover_the_snapshot(spark):
    keys = spark.createDataFrame([(f"{k:05d}",) for k in range(2501)], "scan_key string")
    snap = keys.crossJoin(spark.createDataFrame([(1,), (2,)], "entity_id int"))
    numbered = snapshots.batch_numbers(snapshots.scan_keys(snap), 1000)
    assert all(r.batch_number == int(r.scan_key) // 1000 + 1 for r in numbered.collect())
    d = snapshots.batch_definitions(numbered)
    assert snapshots.exact_cover(d, snap).first().exact and tuple(snapshots.expected_counts(snap, d).first()) == (5002, 2501, 3)
    assert not snapshots.exact_cover(d.unionByName(d.where("batch_number = 1")), snap).first().exact
    assert not snapshots.exact_cover(d.where("batch_number > 1"), snap).first().exact


def test_contract_and_rules(spark):
    good = spark.createDataFrame([("a",), ("b",)], "k string")
    bad = spark.createDataFrame([("a",), ("a",), (None,)], "k string")
    assert audit.contract_verdict(good, "k").first().holds and not audit.contract_verdict(bad, "k").first().holds
    assert [tuple(r) for r in audit.duplicate_groups(bad, "k").collect()] == [("a", 2)]
    table = spark.createDataFrame([("QUEUED", False, 5, 1), ("RUNNING", True, None, 1), ("QUEUED", True, None, -1)], "status string, initialised boolean, start_version int, expected_pairs int")
    assert {r.rule: r.n for r in audit.violations(table, audit.run_rules()).collect()} == {"started_runs_are_initialised": 1, "queued_runs_have_no_version": 1, "a_version_needs_initialisation": 1, "counts_are_not_negative": 1}
    assert tuple(audit.same_mapping(good, bad).first()) == (1, 2)
    seed = spark.createDataFrame([(k, f"{k:06d}") for k in range(25_000)], "pos int, bbl string")
    assert tuple(audit.seed_checks(seed, "bbl").first()) == (25_000, 25_000, True)
    assert not audit.seed_checks(seed.withColumn("bbl", F.when(F.col("pos") == 9_999, "999999").otherwise(F.col("bbl"))), "bbl").first().in_order
