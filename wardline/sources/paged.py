"""A Spark data source for a paged remote table: one partition for each batch of keys, pages read until a short one.

``spark.dataSource.register(PagedSource)``, then ``spark.read.format("paged")`` with options ``client`` (``module:function``
that makes a client), ``keys`` (comma-joined) or ``batches`` (JSON list of lists), ``page_size`` and ``max_pages``. A
client is a callable ``(keys, offset, limit) -> list of JSON texts``; it is made anew in each task. Requests are retried
a few times within the task, and Spark retries the task. ``fetched`` reads a table of batches the same way, so that neither
keys nor rows pass through the driver.
"""

from __future__ import annotations

import importlib
import json
import queue
import threading
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import AccumulatorParam
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MAX_KEYS, MAX_KEY_CHARS, MAX_PAGE = 1000, 64, 50_000
#: Replies worth another try.
RETRIED = (408, 425, 429, 500, 502, 503, 504)


class RemoteError(RuntimeError):
    """A reply with a status, or none: then the network failed."""

    def __init__(self, status: int | None = None):
        super().__init__(f"remote status {status}" if status else "network failure")
        self.status = status


def checked_keys(keys: list[str]) -> list[str]:
    if not keys or len(keys) > MAX_KEYS:
        raise ValueError(f"between 1 and {MAX_KEYS} keys, not {len(keys)}")
    if sorted(set(keys)) != keys:
        raise ValueError("keys must be unique and in order")
    if any(not k or len(k) > MAX_KEY_CHARS for k in keys):
        raise ValueError("a key is empty or too long")
    return keys


@dataclass
class Calls:
    requests: int = 0
    retries: int = 0
    pages: int = 0


def limited(call: Callable, seconds: float | None) -> Callable:
    """A call that raises ``TimeoutError`` after so many seconds, whatever the client does. The call goes on in a thread that is
    given up, and its reply is thrown away."""
    if seconds is None:
        return call

    def run(*args):
        got: queue.SimpleQueue = queue.SimpleQueue()

        def ask() -> None:
            try:
                got.put((call(*args), None))
            except Exception as e:
                got.put((None, e))

        threading.Thread(target=ask, daemon=True).start()
        try:
            reply, error = got.get(timeout=seconds)
        except queue.Empty:
            raise TimeoutError(f"no reply within {seconds} s") from None
        if error is not None:
            raise error
        return reply

    return run


def retrying(call: Callable, tries: int = 3, wait: float = 0.0, calls: Calls | None = None, timeout: float | None = None) -> Callable:
    """A call that is tried again after the statuses that are worth it and after failures of the network, time-outs among
    them; waits double from try to try. timeout: seconds for each try; None leaves it to the client."""
    calls = Calls() if calls is None else calls
    call = limited(call, timeout)

    def run(*args):
        for attempt in range(tries):
            calls.requests += 1
            calls.retries += attempt > 0
            try:
                return call(*args)
            except (RemoteError, ConnectionError, TimeoutError) as e:
                status = getattr(e, "status", None)
                if (status is not None and status not in RETRIED) or attempt == tries - 1:
                    raise
                time.sleep(wait * 2**attempt)

    return run


class PageLimit(RuntimeError):
    pass


def paged(client: Callable, keys: list[str], page_size: int, max_pages: int) -> Iterator[list[str]]:
    """All pages. A full page at the limit is an error: rows might be missing."""
    for page in range(max_pages):
        rows = client(keys, page * page_size, page_size)
        yield rows
        if len(rows) < page_size:
            return
    raise PageLimit("FAILED_PAGE_LIMIT")


def pages(client: Callable, keys: list[str], page_size: int, max_pages: int) -> Iterator[str]:
    """Rows of all pages."""
    for rows in paged(client, keys, page_size, max_pages):
        yield from rows


def _client(name: str) -> Callable:
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)()


class _Sums(AccumulatorParam):
    def zero(self, value: tuple) -> tuple:
        return (0,) * len(value)

    def addInPlace(self, value1: tuple, value2: tuple) -> tuple:
        return tuple(a + b for a, b in zip(value1, value2, strict=True))


class Progress:
    """What tasks have done so far, seen from the driver while their job runs: counted when a task ends. A task that runs again counts
    again, so these are for looking at; what counts are the states that an attempt writes."""

    NAMES = ("batches", "pages", "rows", "requests")

    def __init__(self, spark: SparkSession):
        self.sums = spark.sparkContext.accumulator((0,) * len(self.NAMES), _Sums())

    def seen(self) -> dict[str, int]:
        return dict(zip(self.NAMES, self.sums.value, strict=True))


BAD_DEFINITION = "INVALID_BATCH_DEFINITION"
FETCHED = "batch_number int, payload string, pages long, requests long, retries long, error string"


def fetched(batches: DataFrame, client: str, *, page_size: int = 1000, max_pages: int = 100, tries: int = 3, wait: float = 0.5, concurrency: int = 8, timeout: float | None = None, progress: Progress | None = None) -> DataFrame:
    """batches: (batch_number, scan_keys). A row for each payload, and one without payload for each batch: its pages, requests
    and retries, and the error if it failed, a bad definition included, which fails no other batch. Batches are dealt to
    ``concurrency`` tasks, so no more requests run at a time; a task streams one page after the other, and a lost one asks for
    all its batches again. timeout: seconds for each try of a request."""

    sums = progress and progress.sums

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        names = [x.split()[0] for x in FETCHED.split(", ")]

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

        ask = _client(client)
        for frame in frames:
            for number, keys in zip(frame.column("batch_number").to_pylist(), frame.column("scan_keys").to_pylist(), strict=True):
                calls, error, n_rows = Calls(), None, 0
                counted = retrying(ask, tries, wait, calls, timeout)
                try:
                    wanted = checked_keys([str(k) for k in keys or []])
                except ValueError:
                    yield out([(number, None, 0, 0, 0, BAD_DEFINITION)])
                    continue
                try:
                    for page in paged(counted, wanted, page_size, max_pages):
                        calls.pages += 1
                        n_rows += len(page)
                        yield out([(number, row, None, None, None, None) for row in page])
                except (RemoteError, ConnectionError, TimeoutError, PageLimit) as e:
                    error = str(e) or type(e).__name__
                if sums is not None:
                    sums.add((1, calls.pages, n_rows, calls.requests))
                yield out([(number, None, calls.pages, calls.requests, calls.retries, error)])

    return batches.select(F.col("batch_number").cast("int").alias("batch_number"), "scan_keys").repartition(concurrency, "batch_number").mapInArrow(run, FETCHED)


class BatchPartition(InputPartition):
    def __init__(self, keys: list[str]):
        self.keys = keys


class PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        batches = json.loads(options["batches"]) if "batches" in options else [options["keys"].split(",")]
        self.batches = [checked_keys(b) for b in batches]
        self.client = options["client"]
        self.page_size, self.max_pages = int(options.get("page_size", 1000)), int(options.get("max_pages", 100))
        if not 1 <= self.page_size <= MAX_PAGE:
            raise ValueError(f"page_size must be between 1 and {MAX_PAGE}")

    def partitions(self) -> list[InputPartition]:
        return [BatchPartition(b) for b in self.batches]

    def read(self, partition: BatchPartition) -> Iterator[tuple[str]]:
        client = retrying(_client(self.client))
        return ((row,) for row in pages(client, partition.keys, self.page_size, self.max_pages))


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "payload string"

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(dict(self.options))
