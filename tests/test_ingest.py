import datetime as dt
import itertools
import json
import threading
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from wardline.plans import control
from wardline.plans.ingest import Ingestion, Source
from wardline.plans.publish import COVERAGE
from wardline.sources import paged

START = dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc)


def row(source_id, key, **more):
    return json.dumps({"isn_dob_bis_extract": source_id, ":id": f"row-{source_id}", ":updated_at": "2026-01-02T03:04:05.000Z", "bin": key, "issue_date": "20260203", "balance_due": "1,250.00", "ecb_violation_status": " ACTIVE "} | more)


class Remote:
    """A table of JSON texts by key; version counts up when told to."""

    def __init__(self, spark, rows):
        self.spark, self.rows, self.now = spark, rows, 100

    def fetch(self, batches):
        out = []
        for b in batches.collect():
            out += [(b.batch_number, t, None, None, None, None) for k in b.scan_keys for t in self.rows.get(k, [])]
            out.append((b.batch_number, None, 1, 1, 0, None))
        return self.spark.createDataFrame(out, paged.FETCHED)

    def version(self):
        return self.now


@pytest.fixture(autouse=True)
def small_plans(spark):
    """The tables have a few rows: one partition and no re-planning."""
    values = {"spark.sql.shuffle.partitions": "1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.fixture
def engine(spark, tmp_path):
    store = control.Store(spark, str(tmp_path / "store"))
    store.publish({
        "entities": spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "entity_id int, version int"),
        "entity_keys": spark.createDataFrame([(1, "1000001"), (1, "1000002"), (2, "1000002"), (3, "1000003")], "entity_id int, scan_key string"),
        "live": spark.createDataFrame([("gone", "1000001", None, None, None, None, True, "r0"), ("else", "1999999", None, None, None, None, True, "r0")], "source_id string, scan_key string, issue_date date, status string, balance_due decimal(15,2), updated_at timestamp, is_current boolean, last_run_id string"),
        "raw": spark.createDataFrame([], "source_id string, updated_text string, payload string, first_run_id string"),
        "coverage": spark.createDataFrame([], COVERAGE),
    })
    clock = (START + dt.timedelta(minutes=k) for k in itertools.count())
    remote = Remote(spark, {"1000001": [row("s1", "1000001")], "1000002": [row("s2", " 1000002 ", issue_date="0")], "1000003": [row("s3", 1000003)]})
    return Ingestion(store, Source(remote.fetch, remote.version), lambda: next(clock), batch_size=2), remote


def states(engine):
    v = engine.store.versions()
    live = {r.source_id: (r.status, r.is_current) for r in engine.store.table("live", v).collect()}
    return live, {r.entity_id: (r.status, r.last_error) for r in engine.store.table("coverage", v).collect()}, engine.store.table("raw", v).count()


def test_accepted_run_and_replay(engine):
    ingestion, _ = engine
    for _ in range(2):
        run = ingestion.execute(ingestion.store.create(ingestion.clock()))
        assert (run.status, run.failure, run.expected) == ("COMPLETED", None, {"pairs": 4, "keys": 3, "batches": 2})
        live, coverage, raw = states(ingestion)
        assert live == {"s1": ("ACTIVE", True), "s2": ("ACTIVE", True), "s3": ("ACTIVE", True), "gone": (None, False), "else": (None, True)}
        assert coverage == {e: ("CHECKED", None) for e in (1, 2, 3)} and raw == 3


def test_bad_row_keeps_raw_evidence_only(engine):
    ingestion, remote = engine
    remote.rows["1000003"].append(row("bad", "1000003", balance_due="x"))
    run = ingestion.execute(ingestion.store.create(ingestion.clock()))
    assert run.status == "FAILED" and "BATCHES_OPEN" in run.failure and {b.batch_number: (b.attempts, b.rows_fetched) for b in ingestion.states(run).collect()} == {1: (1, 2), 2: (3, 2)}
    live, coverage, raw = states(ingestion)
    assert set(live) == {"gone", "else"} and live["gone"] == (None, True)
    assert coverage[3] == ("FAILED", "balance:INVALID_NUMBER".replace("balance", "BALANCE")) and coverage[1] == coverage[2] == ("FAILED", "RUN_NOT_PROMOTED") and raw == 4


def test_source_changed_during_the_run(engine):
    ingestion, remote = engine
    versions = iter([100, 101])
    ingestion.source.version = lambda: next(versions)
    run = ingestion.execute(ingestion.store.create(ingestion.clock()))
    assert run.status == "SOURCE_CHANGED"
    live, coverage, _ = states(ingestion)
    assert set(live) == {"gone", "else"} and {c for c in coverage.values()} == {("FAILED", "SOURCE_CHANGED")}


def test_resume_skips_completed_batches(engine):
    ingestion, remote = engine
    remote.rows["1000003"].append(row("bad", "1000003", balance_due="x"))
    run = ingestion.attempt(ingestion.initialise(ingestion.store.create(ingestion.clock())))
    with pytest.raises(control.StateConflict):
        ingestion.store.create(ingestion.clock())
    remote.rows["1000003"].pop()
    asked = []
    fetch = remote.fetch
    ingestion.source.fetch = lambda batches: asked.append([b.batch_number for b in batches.collect()]) or fetch(batches)
    run = ingestion.execute(ingestion.store.load(run.run_id))
    assert run.status == "COMPLETED" and asked == [[2]] and run.attempts == 2


def test_ended_runs_stay_as_they_ended(engine):
    ingestion, remote = engine
    old = ingestion.store.create(ingestion.clock())
    run = ingestion.execute(old)
    before = states(ingestion)
    remote.now += 1
    assert ingestion.execute(run) == run and ingestion.execute(old) == run and states(ingestion) == before
    with pytest.raises(control.StateConflict):
        ingestion.finish(run)
    assert ingestion.store.load(run.run_id) == run and states(ingestion) == before


#: The small files of one execution, in their order.
WRITES = ("lease", "fence", "token", "initialised", "running", "attempt", "end version", "publication", "ended", "release")
LIVE = {"s1": ("ACTIVE", True), "s2": ("ACTIVE", True), "s3": ("ACTIVE", True), "gone": (None, False), "else": (None, True)}


@pytest.mark.parametrize(("at", "change"), [(k, c) for k in range(len(WRITES)) for c in ("keys", "source")] + [(WRITES.index(w), "nothing") for w in ("initialised", "attempt", "publication")])
def test_crash_between_any_two_writes(engine, spark, monkeypatch, at, change):
    """A crash before any small file is written: the old state is in force and the run goes on, or all of the new is. Between crash
    and resumption nothing changes, or a key is added, or the source moves."""
    ingestion, remote = engine
    run = ingestion.store.create(ingestion.clock())
    before, write, count = states(ingestion), ingestion.store._write, itertools.count()

    def failing(*args):
        if next(count) == at:
            raise OSError("crash")
        write(*args)

    monkeypatch.setattr(ingestion.store, "_write", failing)
    with pytest.raises(OSError):
        ingestion.execute(run)
    monkeypatch.setattr(ingestion.store, "_write", write)
    now = ingestion.store.load(run.run_id)
    published = at > WRITES.index("publication")
    assert (now.status == "COMPLETED") == (states(ingestion) != before) == published and now.initialised == (at > WRITES.index("initialised"))
    if change == "keys":
        keys = ingestion.store.table("entity_keys").unionByName(spark.createDataFrame([(3, "1000004")], "entity_id int, scan_key string"))
        ingestion.store.publish({"entity_keys": keys, "entities": spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "entity_id int, version int")})
    if change == "source":
        remote.now += 1
    sealed = None if not now.initialised else (sorted(map(tuple, ingestion.snapshot(now).collect())), ingestion.definitions(now).count())
    other = Ingestion(ingestion.store, ingestion.source, lambda: START + dt.timedelta(days=1), batch_size=2)  # the lease has run out
    done = other.execute(now)
    assert ingestion.store.load(run.run_id) == done and ingestion.store.active() is None
    moved = change == "source" and WRITES.index("running") < at <= WRITES.index("end version")
    assert done.status == ("SOURCE_CHANGED" if moved else "COMPLETED")
    assert done.expected["pairs"] == (5 if change == "keys" and sealed is None else 4)
    assert sealed in (None, (sorted(map(tuple, other.snapshot(done).collect())), other.definitions(done).count()))
    live, coverage, _ = states(ingestion)
    assert live == (before[0] if moved else LIVE)
    stale = change == "keys" and sealed is not None and not published
    assert coverage[3] == (("FAILED", "SOURCE_CHANGED") if moved else ("NOT_CHECKED" if stale else "CHECKED", None))


def files(ingestion, run):
    root = ingestion.store.folder
    return {str(p.relative_to(root)): (p.stat().st_mtime_ns, p.stat().st_size) for what in ("fetched", "landed", "states", "snapshots", "batches") for p in Path(root, what, run.run_id).rglob("*") if p.is_file()}


@pytest.mark.parametrize("ends", [True, False], ids=["published", "still running"])
def test_two_executors(engine, ends):
    """Another executor takes over during an attempt, whose lease has run out: the files of the attempt that counts stay as they
    are, and the first executor writes nothing that counts."""
    first, remote = engine
    run = first.store.create(START)
    first.clock = lambda: START
    late = START + 2 * control.LEASE
    second = Ingestion(first.store, Source(remote.fetch, remote.version), lambda: late, batch_size=2)
    kept = {}

    def fetch(batches):
        if not kept:
            if ends:
                assert second.execute(run).status == "COMPLETED"
            else:
                second.lease = second.store.acquire(second.owner, late)
                second.store.fence(second.lease)
            kept.update(files=files(first, run), states=states(first), versions=first.store.versions())
        return remote.fetch(batches)

    first.source = Source(fetch, remote.version)
    with pytest.raises(control.AuthorityLost):
        first.execute(run)
    now = files(first, run)
    assert {k: now[k] for k in kept["files"]} == kept["files"] and states(first) == kept["states"] and first.store.versions() == kept["versions"]
    done = second.execute(run)
    assert done.status == "COMPLETED" and done.folders == ["attempt-1-2"] and states(first)[0] == LIVE


def test_an_old_holder_can_not_publish(engine, spark):
    store = engine[0].store
    old = store.acquire("a", START)
    store.fence(old)
    new = store.acquire("b", START + control.LEASE)
    assert new.token == old.token + 1
    for lease in (old,):
        with pytest.raises(control.AuthorityLost):
            store.publish({"live": spark.range(1)}, lease=lease)
        with pytest.raises(control.AuthorityLost):
            store.renew(lease, START)
    # one that looked before the take-over and writes after it finds the number taken
    number, state = store._state()
    store.fence(new)
    with pytest.raises(control.StateConflict):
        store._write("state", number + 1, state)
    for _ in range(2 * control.KEPT):
        store.publish({}, lease=new)
    with pytest.raises(control.StateConflict):
        store._write("state", number + 1, state)
    assert store.table("live").count() == 2


def test_heartbeat_renews_and_interrupts(engine, spark):
    store, times = engine[0].store, itertools.count()
    lease = store.acquire("a", START)
    with control.Heartbeat(store, lease, lambda: START + next(times) * control.LEASE / 2, 0.05):
        time.sleep(2)
    with pytest.raises(control.StateConflict):
        store.acquire("b", START + control.LEASE)
    far = START + dt.timedelta(days=100)
    begun = time.time()

    def slow(frames):
        time.sleep(60)
        yield from frames

    def take_over():
        time.sleep(1)
        while True:
            try:
                return store.acquire("b", far)
            except control.StateConflict:  # a renewal took the number
                time.sleep(0.01)

    with pytest.raises(control.AuthorityLost), control.Heartbeat(store, lease, lambda: START, 0.2):
        threading.Thread(target=take_over).start()
        spark.range(8).mapInArrow(slow, "id long").count()
    assert time.time() - begun < 30


def test_numbers_are_taken_once(engine):
    store, won = engine[0].store, []

    def take(k):
        try:
            store._write("x", 1, {"by": k})
            won.append(k)
        except control.StateConflict:
            pass

    threads = [threading.Thread(target=take, args=(k,)) for k in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and store._read("x-000000000001.json") == {"by": won[0]}


def test_no_version_at_the_start_ends_the_run(engine):
    ingestion, remote = engine

    def refused():
        raise paged.RemoteError(503)

    ingestion.source.version = refused
    run = ingestion.execute(ingestion.store.create(ingestion.clock()))
    assert (run.status, run.failure, run.start_version) == ("FAILED", "remote status 503", None)
    assert states(ingestion)[1] == {e: ("FAILED", "RUN_NOT_PROMOTED") for e in (1, 2, 3)} and ingestion.store.active() is None


def test_a_run_with_other_rows_than_sealed_does_not_start(engine, spark):
    ingestion, _ = engine
    run = ingestion._sealed(ingestion.store.create(ingestion.clock()))
    ingestion.snapshot(run).limit(3).write.parquet(ingestion._at("snapshots", run, "other"))
    with pytest.raises(control.StateConflict, match="final"):
        ingestion.store.transition(run, ("QUEUED",), sealed="other")
    Path(ingestion._at("snapshots", run, run.sealed)).rename(ingestion._at("snapshots", run, "aside"))
    Path(ingestion._at("snapshots", run, "other")).rename(ingestion._at("snapshots", run, run.sealed))
    with pytest.raises(control.StateConflict, match="sealed"):
        ingestion.initialise(run)
    assert ingestion.store.load(run.run_id).status == "QUEUED"


def test_used_up_batches_fail_the_run_before_the_source_is_asked(engine):
    ingestion, remote = engine
    remote.rows["1000003"].append(row("bad", "1000003", balance_due="x"))
    run = ingestion.initialise(ingestion.store.create(ingestion.clock()))
    for _ in range(control.MAX_ATTEMPTS):
        run = ingestion.attempt(run)
    remote.now += 1
    done = ingestion.execute(run)
    assert done.status == "FAILED" and states(ingestion)[1][3] == ("FAILED", "BALANCE:INVALID_NUMBER")


def test_lease_keeps_others_out_until_it_runs_out(engine):
    ingestion, _ = engine
    run = ingestion.store.create(START)
    ingestion.store.acquire("other", START)
    with pytest.raises(control.StateConflict, match="ACTIVE_EXECUTOR"):
        ingestion.execute(run)
    assert ingestion.store.load(run.run_id).status == "QUEUED"
    ingestion.clock = lambda: START + 2 * control.LEASE
    assert ingestion.execute(run).status == "COMPLETED"


def client():
    """Two rows for each key; key 7 refuses, key 9's first request times out."""
    tried = []

    def ask(keys, offset, limit):
        if "7" in keys:
            raise paged.RemoteError(400)
        if "9" in keys and not tried:
            tried.append(1)
            raise TimeoutError
        return [json.dumps({"bin": k, "n": n}) for k in keys for n in range(2)][offset : offset + limit]

    return ask


def test_batches_are_fetched_in_one_job(spark):
    batches = spark.createDataFrame([(1, ["1", "2"]), (2, ["7"]), (3, ["8", "9"]), (4, ["3"] * 2)], "batch_number int, scan_keys array<string>")
    bad = paged.fetched(batches, "tests.test_ingest:client", wait=0).where("payload IS NULL AND error IS NOT NULL").collect()
    assert {(r.batch_number, r.requests, r.error) for r in bad} == {(2, 1, "remote status 400"), (4, 0, paged.BAD_DEFINITION)}
    rows = paged.fetched(batches.where("batch_number < 4"), "tests.test_ingest:client", page_size=3, wait=0).collect()
    assert {(r.batch_number, r.pages, r.requests, r.retries, r.error) for r in rows if r.payload is None} == {(1, 2, 2, 0, None), (2, 0, 1, 0, "remote status 400"), (3, 2, 3, 1, None)}
    assert sorted((r.batch_number, json.loads(r.payload)["bin"]) for r in rows if r.payload) == [(1, "1")] * 2 + [(1, "2")] * 2 + [(3, "8")] * 2 + [(3, "9")] * 2
    (r,) = paged.fetched(batches.where("batch_number = 1"), "tests.test_ingest:client", page_size=1, max_pages=2, wait=0).where("payload IS NULL").collect()
    assert r.error == "FAILED_PAGE_LIMIT"


def served():
    """One row for each key that is asked for."""
    return lambda keys, offset, limit: [row(f"c{k}", k) for k in keys][offset : offset + limit]


def version():
    return 100


def test_ingest_command(engine, capsys):
    from wardline.__main__ import main

    ingestion, _ = engine
    folder = ingestion.store.folder
    args = ["ingest", folder, "tests.test_ingest:served", "tests.test_ingest:version"]
    assert main(args) == 0 and json.loads(capsys.readouterr().out.splitlines()[-1])["status"] == "COMPLETED"
    assert {r.source_id for r in ingestion.store.table("live").where("last_run_id <> 'r0'").collect()} == {"c1000001", "c1000002", "c1000003"}
    run = ingestion.store.create(START)
    ingestion.store.acquire("other", dt.datetime.now(dt.timezone.utc))
    assert main(args) == 3 and ingestion.store.load(run.run_id).status == "QUEUED"
    ingestion.store.release("other")
    assert main([*args[:3], "tests.test_ingest:nowhere"]) == 2
    assert main([*args[:2], "tests.test_ingest:client", args[3]]) == 1  # replies that are no rows of the source
    assert main(args[:3]) == 2


def slowly():
    """One row for each key; the second batch's reply takes a while."""

    def ask(keys, offset, limit):
        time.sleep(6 if "1000003" in keys else 0)
        return [row(f"c{k}", k) for k in keys][offset : offset + limit]

    return ask


def test_progress_is_seen_while_a_job_runs(engine):
    from wardline.plans.ingest import paged_source

    ingestion, _ = engine
    now = lambda: dt.datetime.now(dt.timezone.utc)
    own = Ingestion(ingestion.store, paged_source("tests.test_ingest:slowly", version, concurrency=2), now, batch_size=2, heartbeat=0.2)
    run, seen, over = own.store.create(now()), [], threading.Event()

    def watch():
        while not over.is_set():
            noted = own.store.working(now())
            if noted and noted["rows"] and not seen:
                seen.append((noted, {r.batch_number: r.status for r in own.visible(own.store.load(run.run_id)).collect()}))
            time.sleep(0.1)

    watcher = threading.Thread(target=watch)
    watcher.start()
    done = own.execute(run)
    over.set()
    watcher.join()
    assert done.status == "COMPLETED" and seen[0] == ({"batches": 1, "pages": 1, "rows": 2, "requests": 1}, {1: "RUNNING", 2: "RUNNING"})
    assert {r.batch_number: r.status for r in own.visible(done).collect()} == {1: "COMPLETED", 2: "COMPLETED"} and own.store.working(now()) is None
    assert own.source.progress() == {"batches": 2, "pages": 2, "rows": 3, "requests": 2}


def test_publication_is_all_or_nothing(engine, spark):
    store = engine[0].store
    before = store.versions()
    with pytest.raises(Exception):
        store.publish({"live": spark.range(1), "coverage": spark.range(1).select(F.raise_error(F.lit("crash")).alias("x"))})
    assert store.versions() == before and store.table("live").count() == 2


def test_control_rules(engine):
    store = engine[0].store
    store.acquire("a", START)
    store.acquire("a", START)
    with pytest.raises(control.StateConflict):
        store.acquire("b", START)
    store.release("b")
    store.release("a")
    store.acquire("b", START)
    with pytest.raises(control.StateConflict):
        store.acquire("a", START + control.LEASE / 2)
    store.acquire("a", START + control.LEASE)
    run = store.create(START)
    run = store.transition(run, ("QUEUED",), initialised=True, start_version=5, expected={"batches": 1})
    for change in ({"initialised": False}, {"start_version": 6}, {"expected": {}}):
        with pytest.raises(control.StateConflict):
            store.transition(run, ("QUEUED",), **change)
    with pytest.raises(control.StateConflict):
        store.transition(run, ("RUNNING",), status="COMPLETED")
