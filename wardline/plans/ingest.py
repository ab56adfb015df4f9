"""A run from snapshot to publication: the driver keeps control, Spark moves the rows.

An attempt fetches all batches that are still open in one job and writes their rows and states; batches are dealt to as many
tasks as requests may run at once. The state of a batch is that of its last attempt. Folders of an attempt bear the token of
the lease it ran under, and a run names the folders that count, so an executor that has lost the lease writes beside the
run, never into it.

A run that goes on after a crash never does again what is sealed: an initialised one keeps its snapshot and batches, whatever
the keys are by now; one whose batches are used up fails; one that is complete is published; only then does a source
that has moved since end it.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.operators import snapshots
from wardline.operators.merge import insert_if_absent, last_wins
from wardline.plans import control, publish
from wardline.sources import landing, paged

STATES = "batch_number int, attempt int, status string, pages long, requests long, retries long, rows_fetched long, last_error string"


@dataclass
class Source:
    """What a run reads. fetch gives what ``paged.fetched`` does for a table of batches (batch_number, scan_keys); version the
    dataset's own version; progress what fetches have done so far."""

    fetch: Callable[[DataFrame], DataFrame]
    version: Callable[[], int]
    progress: Callable[[], dict] = dict


@dataclass
class Ingestion:
    store: control.Store
    source: Source
    clock: Callable[[], dt.datetime]
    batch_size: int = 1000
    owner: str = field(default_factory=lambda: uuid.uuid4().hex)
    #: Seconds between renewals of the lease.
    heartbeat: float = control.LEASE.total_seconds() / 5
    lease: control.Lease | None = None

    def _step(self, run: control.RunState, allowed: tuple[str, ...], **change) -> control.RunState:
        return self.store.transition(run, allowed, self.lease, **change)

    def initialise(self, run: control.RunState) -> control.RunState:
        """Seals the run's snapshot and batches, unless they are, checks them against the counts they were sealed with, and
        notes the source's version. A version that can't be had ends the run."""
        if not run.initialised:
            run = self._sealed(run)
        counts = snapshots.expected_counts(self.snapshot(run), self.definitions(run)).collect()[0]
        if {"pairs": counts.n_pairs, "keys": counts.n_keys, "batches": counts.n_batches} != run.expected:
            raise control.StateConflict(f"run {run.run_id} has not the rows it was sealed with")
        try:
            version = self.source.version()
        except (paged.RemoteError, ConnectionError, TimeoutError) as e:
            return self.finish(self._step(run, (control.QUEUED,), failure=str(e) or type(e).__name__))
        return self._step(run, (control.QUEUED,), status=control.RUNNING, started_at=self.clock().isoformat(), start_version=version)

    def _sealed(self, run: control.RunState) -> control.RunState:
        v = self.store.versions()
        snap = snapshots.snapshot(self.store.table("entity_keys", v), self.store.table("entities", v).select("entity_id", "version"), run.run_id)
        sealed = uuid.uuid4().hex  # leftovers of a crash or of another executor stay where they are
        spark, folder = self.store.spark, {what: self._at(what, run, sealed) for what in ("snapshots", "batches")}
        snap.write.parquet(folder["snapshots"])
        snap = spark.read.parquet(folder["snapshots"])
        numbered = snapshots.batch_numbers(snapshots.scan_keys(snap), self.batch_size)
        snapshots.batch_definitions(numbered).write.parquet(folder["batches"])
        counts = snapshots.expected_counts(snap, spark.read.parquet(folder["batches"])).collect()[0]
        return self._step(run, (control.QUEUED,), initialised=True, sealed=sealed, expected={"pairs": counts.n_pairs, "keys": counts.n_keys, "batches": counts.n_batches})

    def _at(self, what: str, run: control.RunState, folder: str) -> str:
        return f"{self.store.folder}/{what}/{run.run_id}/{folder}"

    def snapshot(self, run: control.RunState) -> DataFrame:
        return self.store.spark.read.parquet(self._at("snapshots", run, run.sealed))

    def definitions(self, run: control.RunState) -> DataFrame:
        return self.store.spark.read.parquet(self._at("batches", run, run.sealed))

    def _attempts(self, what: str, run: control.RunState, schema: str) -> DataFrame:
        """What the attempts that are done have written; a leftover of one that is not is not read."""
        spark = self.store.spark
        paths = [self._at(what, run, folder) for folder in run.folders]
        return spark.read.parquet(*paths) if paths else spark.createDataFrame([], schema)

    def states(self, run: control.RunState) -> DataFrame:
        """The last attempt of each batch, and how many it has had."""
        done = self._attempts("states", run, STATES)
        last = done.groupBy("batch_number").agg(F.max_by(F.struct(*(c for c in done.columns if c != "batch_number")), "attempt").alias("s"), F.count("*").cast("int").alias("attempts"))
        return last.select("batch_number", "s.*", "attempts")

    def landed(self, run: control.RunState) -> DataFrame:
        """Rows of all attempts: raw evidence of bad ones stays."""
        return self._attempts("landed", run, f"batch_number int, {landing.PARSED}, attempt int")

    def open_batches(self, run: control.RunState) -> DataFrame:
        done = self.states(run).where("status = 'COMPLETED'").select("batch_number")
        return self.definitions(run).join(done, "batch_number", "left_anti")

    def attempt(self, run: control.RunState) -> control.RunState:
        """One job over all open batches. It counts when the run says so; what a lost one has written is overwritten if the
        same executor repeats it, and left alone by others."""
        number, spark = run.attempts + 1, self.store.spark
        asked = self.open_batches(run)
        folder = f"attempt-{number}-{self.lease.token if self.lease else 0}"
        raw = self._at("fetched", run, folder)
        self.source.fetch(asked.select("batch_number", "scan_keys")).write.mode("overwrite").parquet(raw)
        fetched = spark.read.parquet(raw)
        landing.parsed(fetched.where("payload IS NOT NULL"), "batch_number").withColumn("attempt", F.lit(number)).write.mode("overwrite").parquet(self._at("landed", run, folder))
        bad = spark.read.parquet(self._at("landed", run, folder)).groupBy("batch_number").agg(F.count("*").alias("rows_fetched"), F.min("error").alias("bad"))
        calls = fetched.where("payload IS NULL").groupBy("batch_number").agg(*(F.sum(c).alias(c) for c in ("pages", "requests", "retries")), F.min("error").alias("refused"))
        error = F.coalesce("refused", "bad")
        rows = asked.select("batch_number").join(calls, "batch_number", "left").join(bad, "batch_number", "left")
        counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("pages", "requests", "retries", "rows_fetched")]
        status = F.when(error.isNull(), control.COMPLETED).otherwise(control.FAILED).alias("status")
        rows.select("batch_number", F.lit(number).alias("attempt"), status, *counts, error.alias("last_error")).write.mode("overwrite").parquet(self._at("states", run, folder))
        return self._step(run, (control.RUNNING,), attempts=number, folders=[*run.folders, folder])

    def execute(self, run: control.RunState) -> control.RunState:
        """Runs or resumes, under the lease, which is renewed all the while. A run that has ended is returned as it ended. Raises
        ``control.AuthorityLost`` once another executor has taken over; its jobs are interrupted and nothing it wrote counts."""
        run = self.store.load(run.run_id)
        if run.status not in control.ACTIVE:
            return run
        self.lease = self.store.acquire(self.owner, self.clock())
        try:
            with control.Heartbeat(self.store, self.lease, self.clock, self.heartbeat, note=self.source.progress):
                self.store.fence(self.lease)
                run = self.store.load(run.run_id)  # as the last holder left it
                return self._execute(run) if run.status in control.ACTIVE else run
        finally:
            self.lease = None
            self.store.release(self.owner)

    def _execute(self, run: control.RunState) -> control.RunState:
        run = self._step(run, control.ACTIVE, token=self.lease.token)
        if run.failure is not None:
            return self.finish(run)
        if run.status == control.QUEUED:
            run = self.initialise(run)
            if run.status not in control.ACTIVE:
                return run
        else:
            complete = self.open_batches(run).isEmpty()
            if not complete and run.attempts >= control.MAX_ATTEMPTS:
                return self.finish(run)
            if complete and run.start_version == run.end_version:
                return self.finish(run)
            if run.start_version != self.source.version():
                return self.finish(run, source_changed=True)
        while run.attempts < control.MAX_ATTEMPTS and not self.open_batches(run).isEmpty():
            run = self.attempt(run)
        if not self.open_batches(run).isEmpty():
            return self.finish(run)
        run = self._step(run, (control.RUNNING,), end_version=self.source.version())
        return self.finish(run, source_changed=run.end_version != run.start_version)

    def batch_table(self, run: control.RunState) -> DataFrame:
        """Definition, status and error of each batch; those that were never tried are pending."""
        definition = F.to_json(F.struct(F.col("scan_keys").alias("keys"))).alias("definition")
        states = self.states(run).select("batch_number", "status", "last_error")
        joined = self.definitions(run).select("batch_number", definition).join(states, "batch_number", "left")
        return joined.withColumn("status", F.coalesce("status", F.lit("PENDING")))

    def visible(self, run: control.RunState) -> DataFrame:
        """Batches as anyone may see them while a run goes on: those that are open are running while an executor holds the lease.
        What it has done so far is in ``Store.working``, as of its last renewal."""
        table = self.batch_table(run).drop("definition")
        if run.status != control.RUNNING or self.store.working(self.clock()) is None:
            return table
        return table.withColumn("status", F.when(F.col("status") == control.COMPLETED, F.col("status")).otherwise(control.RUNNING))

    def finish(self, run: control.RunState, *, source_changed: bool = False) -> control.RunState:
        """Publishes an accepted run, or the failure of one that isn't. Raw versions stay either way."""
        v, now = self.store.versions(), self.clock()
        snap, landed = self.snapshot(run), self.landed(run)
        versions, coverage = self.store.table("entities", v).select("entity_id", "version"), self.store.table("coverage", v)
        spark = self.store.spark
        runs = spark.createDataFrame([(r.run_id, dt.datetime.fromisoformat(r.started_at)) for r in self.store.runs() if r.started_at], "run_id string, started_at timestamp")
        fresh = landed.where(F.col("source_id").isNotNull() & F.col("updated_text").isNotNull())
        raw = self.store.table("raw", v)
        first = insert_if_absent(raw, fresh.select("source_id", "updated_text", "payload", F.lit(run.run_id).alias("first_run_id")), ["source_id", "updated_text"], ["payload"])
        tables = {"raw": raw.unionByName(first)}
        done = publish.Run(run.run_id, dt.datetime.fromisoformat(run.started_at) if run.started_at else now, now, dt.datetime.fromtimestamp(run.start_version or 0, dt.timezone.utc))
        batches = self.batch_table(run)
        counts = run.expected
        control_row = {"status": run.status, "initialised": run.initialised, "started_at": run.started_at, "start_version": run.start_version, "end_version": run.end_version} | {f"expected_{k}": n for k, n in counts.items()}
        reasons = publish.gate(control_row, counts, batches, snapshots.exact_cover(self.definitions(run), snap))
        if source_changed or reasons:
            changes = publish.failure_changes(snap, versions, batches, done, source_changed=source_changed)
            tables["coverage"] = publish.merge_coverage(coverage, changes)
            end = control.SOURCE_CHANGED if source_changed else control.FAILED
            return self._close(run, end, tables, run.failure or ",".join(reasons) or None)
        # rows of a batch's last attempt: an earlier one may have seen a bad row, and what it saw may be older
        last = landed.join(self.states(run).select("batch_number", "attempt"), ["batch_number", "attempt"])
        staged = last_wins(last.select(*landing.CANDIDATE), ["source_id"], ["updated_at", "row_id"])
        live = publish.reconcile(publish.promote(self.store.table("live", v), staged, run.run_id, now), snap, run.run_id)
        checked = publish.merge_coverage(coverage, publish.success_changes(snap, versions, coverage, runs, done))
        tables |= {"live": live, "coverage": publish.merge_coverage(checked, publish.stale_changes(snap, versions, coverage, runs, done))}
        return self._close(run, control.COMPLETED, tables, None)

    def _close(self, run: control.RunState, status: str, tables: dict[str, DataFrame], failure: str | None) -> control.RunState:
        allowed = (control.RUNNING,) if status == control.COMPLETED else control.ACTIVE
        ended = self.store.changed(run, allowed, status=status, finished_at=self.clock().isoformat(), failure=failure)
        self.store.publish(tables, ended, self.lease, publish.rules())
        return ended


def paged_source(client: str, version: Callable[[], int], **limits) -> Source:
    """A source behind a paged client; see ``paged.fetched``."""
    seen: list[paged.Progress] = []

    def fetch(batches: DataFrame) -> DataFrame:
        if not seen:
            seen.append(paged.Progress(batches.sparkSession))
        return paged.fetched(batches, client, progress=seen[0], **limits)

    return Source(fetch, version, lambda: seen[0].seen() if seen else {})
