"""Runs, the lease and the table versions: small state on the driver, kept as numbered files beside the tables.

Nothing is ever replaced. A run, the lease and the tables in force each have files numbered upwards, of which the newest
counts; a number is taken by one writer alone (see ``Store._put``), who must have read the one before. A publication writes the
next version of every table it changes and then one state file, which names the versions in force and holds the run as it
ended. A crash before that file leaves the old tables and a running run, one after it the new tables and an ended run.
What grows with the keys, such as the states of batches, is in Spark's tables. Of each kind the last KEPT files stay.

The lease is fenced. Each take-over counts a token up; the new holder writes the token into the state file and into its run
before anything else, so whatever an old holder still tries to write finds its number taken or a higher token. ``Heartbeat``
renews the lease beside a running job and interrupts the job when the lease is lost.
"""

from __future__ import annotations

import datetime as dt
import json
import re
import threading
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession

from wardline.operators import audit

QUEUED, RUNNING, COMPLETED, FAILED, SOURCE_CHANGED = "QUEUED", "RUNNING", "COMPLETED", "FAILED", "SOURCE_CHANGED"
ACTIVE = (QUEUED, RUNNING)
MAX_ATTEMPTS = 3
LEASE = dt.timedelta(minutes=15)
#: Files of each kind that stay behind the newest.
KEPT = 8
#: Stores that write a file whole when it is closed, and refuse it if it is there, but have no rename.
PUT_WHOLE = ("s3a", "gs", "abfs", "abfss")


class StateConflict(RuntimeError):
    pass


class AuthorityLost(StateConflict):
    """The lease has been taken over."""


@dataclass(frozen=True)
class Lease:
    owner: str
    token: int


@dataclass(frozen=True)
class RunState:
    run_id: str
    status: str = QUEUED
    initialised: bool = False
    sealed: str | None = None
    created_at: str = ""
    started_at: str | None = None
    finished_at: str | None = None
    start_version: int | None = None
    end_version: int | None = None
    expected: dict[str, int] = field(default_factory=dict)
    attempts: int = 0
    folders: list[str] = field(default_factory=list)
    failure: str | None = None
    token: int = 0


class Store:
    """The folder of one dataset. One writer at a time, by lease."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.folder))

    # numbered files

    def _newest(self, kind: str) -> dict[str, tuple[int, str]]:
        """By name: the highest number and its file. One listing of the folder."""
        found: dict[str, tuple[int, str]] = {}
        for s in self._fs.listStatus(self._path(self.folder)):
            m = re.fullmatch(rf"{kind}-(?:(.+)-)?([0-9]{{12}})\.json", s.getPath().getName())
            if m:
                found[m[1] or ""] = max(found.get(m[1] or "", (0, "")), (int(m[2]), m[0]))
        return found

    def _read(self, name: str) -> dict:
        stream = self._fs.open(self._path(f"{self.folder}/{name}"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _write(self, stem: str, number: int, value: dict) -> None:
        """The next file of its kind, whole or not at all; raises if its number is taken, or was and is gone since."""
        self._put(f"{stem}-{number:012d}.json", json.dumps(value).encode())
        if number > 1 and not self._fs.exists(self._path(f"{self.folder}/{stem}-{number - 1:012d}.json")):
            raise StateConflict(f"{stem}-{number:012d}.json is long past")
        self._fs.delete(self._path(f"{self.folder}/{stem}-{number - KEPT:012d}.json"), False)

    def _put(self, name: str, value: bytes) -> None:
        """Takes a name for good. A local file system takes it by a hard link, which fails if it is there; HDFS by a rename, which
        does so too; object stores by a put that does not overwrite."""
        target, aside = self._path(f"{self.folder}/{name}"), self._path(f"{self.folder}/.{name}.{uuid.uuid4().hex}")
        scheme = self._fs.getScheme()
        try:
            out = self._fs.create(target if scheme in PUT_WHOLE else aside, False)
            out.write(bytearray(value))
            out.close()
            if scheme in PUT_WHOLE:
                return
            if scheme == "file":
                at = lambda p: self._jvm.java.nio.file.Paths.get(self._fs.makeQualified(p).toUri())
                self._jvm.java.nio.file.Files.createLink(at(target), at(aside))
            elif not self._fs.rename(aside, target):
                raise StateConflict(f"{name} is there already")
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in e.java_exception.getClass().getName():
                raise
            raise StateConflict(f"{name} is there already") from None
        finally:
            self._fs.delete(aside, False)

    # lease

    def _held(self) -> tuple[int, dict]:
        number, name = self._newest("lease").get("", (0, ""))
        return number, self._read(name) if name else {"owner": None, "token": 0}

    def acquire(self, owner: str, now: dt.datetime, term: dt.timedelta = LEASE) -> Lease:
        """Takes the lease, or renews the owner's own; raises if another owner has it and it has not run out; doesn't wait.
        A lease taken from another, or after a release, has the next token."""
        number, held = self._held()
        if held["owner"] not in (None, owner) and dt.datetime.fromisoformat(held["until"]) > now:
            raise StateConflict("ACTIVE_EXECUTOR")
        token = held["token"] + (held["owner"] != owner)
        self._write("lease", number + 1, {"owner": owner, "token": token, "until": (now + term).isoformat()})
        return Lease(owner, token)

    def renew(self, lease: Lease, now: dt.datetime, term: dt.timedelta = LEASE, note: dict | None = None) -> None:
        """Also one that has run out, if nobody has taken it. note: for others to see, until the next renewal."""
        number, held = self._held()
        if (held["owner"], held["token"]) != (lease.owner, lease.token):
            raise AuthorityLost(f"lease {lease.token} was taken over")
        self._write("lease", number + 1, {"owner": lease.owner, "token": lease.token, "until": (now + term).isoformat(), "note": note})

    def working(self, now: dt.datetime) -> dict | None:
        """What the holder of the lease last noted, an empty note at least; None if nobody holds it."""
        held = self._held()[1]
        live = held["owner"] is not None and dt.datetime.fromisoformat(held["until"]) > now
        return (held.get("note") or {}) if live else None

    def check(self, lease: Lease | None) -> None:
        held = self._held()[1]
        if lease and (held["owner"], held["token"]) != (lease.owner, lease.token):
            raise AuthorityLost(f"lease {lease.token} was taken over")

    def release(self, owner: str) -> None:
        number, held = self._held()
        if held["owner"] == owner:
            self._write("lease", number + 1, {"owner": None, "token": held["token"]})

    def fence(self, lease: Lease) -> None:
        """Takes the next state file without changing a table: an older holder's publication can't come any more."""
        while True:
            self.check(lease)
            number, state = self._state()
            if state["token"] >= lease.token:
                return
            try:
                self._write("state", number + 1, state | {"token": lease.token})
            except StateConflict:
                continue

    # tables

    def _state(self) -> tuple[int, dict]:
        number, name = self._newest("state").get("", (0, ""))
        return number, {"tables": {}, "ended": {}, "token": 0} | (self._read(name) if name else {})

    def versions(self) -> dict[str, str]:
        """Each table's version in force."""
        return self._state()[1]["tables"]

    def table(self, name: str, versions: dict[str, str] | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}/{(versions or self.versions())[name]}")

    def publish(self, tables: dict[str, DataFrame], ended: RunState | None = None, lease: Lease | None = None, rules: dict[str, dict[str, Column]] | None = None) -> dict[str, str]:
        """Writes the next version of each table, then the file that puts all of them and the run's end in force at once.
        Raises if another publication or a take-over came between. rules: of a table's rows, part of the plan that writes it: a
        row that breaks one stops the publication, and the old state stays in force."""
        number, state = self._state()
        new = {}
        for name, df in tables.items():
            new[name] = uuid.uuid4().hex
            df = audit.enforced(df, rules[name]) if rules and name in rules else df
            df.write.mode("errorifexists").parquet(f"{self.folder}/{name}/{new[name]}")
        self.check(lease)
        if lease and state["token"] > lease.token:
            raise AuthorityLost(f"lease {lease.token} was taken over")
        self._write("state", number + 1, state | {"tables": state["tables"] | new, "ended": asdict(ended) if ended else state["ended"]})
        if ended:
            self._write(f"run-{ended.run_id}", self._newest("run").get(ended.run_id, (0, ""))[0] + 1, asdict(ended))
        return state["tables"] | new

    # runs

    def _runs(self) -> dict[str, tuple[int, RunState]]:
        """All runs with the numbers of their files, from one listing of each kind. The newest state file has the run that
        ended with it, whose own file may be behind after a crash; the file that took a run's creation stands for its own first."""
        ended = self._state()[1]["ended"]
        found = {run_id: (number, RunState(**(ended if ended.get("run_id") == run_id else self._read(name)))) for run_id, (number, name) in self._newest("run").items()}
        _, name = self._newest("created").get("", (0, ""))
        created = RunState(**self._read(name)) if name else None
        return found if created is None or created.run_id in found else found | {created.run_id: (0, created)}

    def _stored(self, run_id: str) -> tuple[int, RunState]:
        number, name = self._newest("run").get(run_id, (0, ""))
        ended = self._state()[1]["ended"]
        if ended.get("run_id") == run_id:
            return number, RunState(**ended)
        return (number, RunState(**self._read(name))) if name else self._runs()[run_id]

    def load(self, run_id: str) -> RunState:
        return self._stored(run_id)[1]

    def runs(self) -> list[RunState]:
        return [run for _, (_, run) in sorted(self._runs().items())]

    def active(self) -> RunState | None:
        return next((r for r in self.runs() if r.status in ACTIVE), None)

    def create(self, now: dt.datetime) -> RunState:
        """At most one run is queued or running: of two that create at once, one finds the number taken."""
        number, _ = self._newest("created").get("", (0, ""))
        if self.active() is not None:
            raise StateConflict("a run is active")
        run = RunState(uuid.uuid4().hex, created_at=now.isoformat())
        self._write("created", number + 1, asdict(run))
        self._write(f"run-{run.run_id}", 1, asdict(run))
        return run

    def _changed(self, stored: RunState, run: RunState, allowed: tuple[str, ...], change: dict) -> RunState:
        if stored != run or stored.status not in allowed:
            raise StateConflict(f"run {run.run_id} is {stored.status}")
        new = replace(stored, **change)
        if stored.initialised and not new.initialised:
            raise StateConflict("initialisation is final")
        if stored.start_version is not None and new.start_version != stored.start_version:
            raise StateConflict("the start version is final")
        if stored.initialised and (new.expected, new.sealed) != (stored.expected, stored.sealed):
            raise StateConflict("batches are final")
        if new.attempts < stored.attempts:
            raise StateConflict("attempts are counted up")
        return new

    def changed(self, run: RunState, allowed: tuple[str, ...], **change) -> RunState:
        """The run with a change, unwritten: the stored run must be as given and in an allowed status. What is written once
        stays: initialisation and the start version."""
        return self._changed(self.load(run.run_id), run, allowed, change)

    def transition(self, run: RunState, allowed: tuple[str, ...], lease: Lease | None = None, **change) -> RunState:
        """Compare and set: the file after the one compared with is written, which one writer can do."""
        number, stored = self._stored(run.run_id)
        new = self._changed(stored, run, allowed, change)
        self.check(lease)
        self._write(f"run-{run.run_id}", number + 1, asdict(new))
        return new


class Heartbeat:
    """While it is entered: renews a lease every ``every`` seconds from a thread beside the caller's. When the lease is lost it
    interrupts the caller's Spark jobs, which bear its tag; whatever the caller's work then raises becomes ``AuthorityLost``."""

    def __init__(self, store: Store, lease: Lease, clock: Callable[[], dt.datetime], every: float, term: dt.timedelta = LEASE, note: Callable[[], dict] = dict):
        self.note = note
        self.store, self.lease, self.clock, self.every, self.term = store, lease, clock, every, term
        self.tag, self._over = f"lease-{uuid.uuid4().hex}", threading.Event()

    def _beat(self) -> None:
        while not self._over.wait(self.every):
            try:
                self.store.renew(self.lease, self.clock(), self.term, self.note())
            except AuthorityLost:
                self.store.spark.sparkContext.cancelJobsWithTag(self.tag)  # a session's interruptTag sees its own thread's tags only
                return
            except Exception:  # noqa: S112 - a failed renewal is tried again; the lease may outlast it
                continue

    def __enter__(self):
        self.store.spark.sparkContext.addJobTag(self.tag)
        self._thread = threading.Thread(target=self._beat, daemon=True)
        self._thread.start()
        return self

    def __exit__(self, kind, error, trace):
        self._over.set()
        self._thread.join()
        self.store.spark.sparkContext.removeJobTag(self.tag)
        if error is not None and not isinstance(error, AuthorityLost):  # an interrupted job, or a number that was taken
            self.store.check(self.lease)
