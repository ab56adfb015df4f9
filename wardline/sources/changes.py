"""A remote table read by what changed: filters go into the requests, and a stream asks only for what is newer.

Rows have a place: the time of their last change as an ISO text in UTC, whose order is that of time, and their own id. A client is a callable that
takes an ``Ask`` and gives the rows between two places, of some keys or of all, in the order of their places, ``limit``
of them at most; its ``newest()`` gives the last place there is, or None. Options: ``client`` (``module:function`` that makes
one, anew in each task), ``page_size``, ``keys_per_request``, ``tries``, ``timeout`` (seconds for each try), and for streams
``since`` (a time; rows changed before it are not asked for), ``slices`` and ``overlap``.

``table(spark, client)`` with filters on ``scan_key`` (equality, IN) and ``updated`` (comparisons): both become parameters of the
requests, and keys are dealt to one task for each ``keys_per_request`` of them. All other filters stay with Spark. Use
it once for each query: Spark keeps what one query has pushed with the table it was loaded as, and a later query over
the same DataFrame that pushes nothing would be asked the narrower question.

``spark.readStream.format("changes")`` has the place as its offset. A micro-batch covers what lies behind the last one's end
and not behind the newest place when it began, cut into ``slices`` of equal time, one a task; a replay asks for the same
ranges. Rows that turn up with a time before the end of a batch that is done are asked for only with ``overlap`` (seconds
before the last end, asked for again); what then comes twice is told by ``streaming.versions``.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds

from wardline.sources import paged

#: Before and behind every id.
FIRST, LAST = "", "\U0010ffff"
Place = tuple[str, str]
SCHEMA = "scan_key string, updated string, row_id string, payload string"


@dataclass(frozen=True)
class Ask:
    """Rows behind ``after`` and not behind ``until``; None is no bound."""

    keys: tuple[str, ...] | None = None
    after: Place | None = None
    until: Place | None = None
    limit: int = 1000


def _pages(client: Callable, ask: Ask) -> Iterator[pa.RecordBatch]:
    """Each page begins behind the last row of the one before, so rows that change meanwhile shift no other."""
    while True:
        rows = client(ask)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(4)], names=["scan_key", "updated", "row_id", "payload"])
        if len(rows) < ask.limit:
            return
        ask = replace(ask, after=(rows[-1][1], rows[-1][2]))


class _Asks:
    """What both readers share."""

    def __init__(self, options: dict):
        self.client, self.limit = options["client"], int(options.get("page_size", 1000))
        if not 1 <= self.limit <= paged.MAX_PAGE:
            raise ValueError(f"page_size must be between 1 and {paged.MAX_PAGE}")
        self.keys_per_request = int(options.get("keys_per_request", paged.MAX_KEYS))
        self.tries, self.timeout = int(options.get("tries", 3)), float(options["timeout"]) if "timeout" in options else None

    def made(self, wait: float = 0.5) -> tuple[Callable, Callable]:
        client = paged._client(self.client)
        return tuple(paged.retrying(call, self.tries, wait, timeout=self.timeout) for call in (client, client.newest))

    def rows(self, ask: Ask) -> Iterator[pa.RecordBatch]:
        return _pages(self.made()[0], ask)


def table(spark: SparkSession, client: str, **options) -> DataFrame:
    """The source as a table of its own, for one query."""
    spark.dataSource.register(ChangesSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("changes").options(client=client, **{k: str(v) for k, v in options.items()}).load()


class AskPartition(ds.InputPartition):
    def __init__(self, ask: Ask):
        self.ask = ask


class ChangesReader(ds.DataSourceReader):
    def __init__(self, options: dict):
        self.asks = _Asks(options)
        self.keys: set[str] | None = None
        self.after: Place | None = None
        self.until: Place | None = None

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        for f in filters:
            if not self._taken(f):
                yield f

    def _taken(self, f: ds.Filter) -> bool:
        """Whether a filter has become part of the requests."""
        column = getattr(f, "attribute", None)
        if isinstance(f, ds.IsNotNull):
            return column in (("scan_key",), ("updated",))  # the source has no others
        if column == ("scan_key",) and isinstance(f, (ds.EqualTo, ds.In)):
            wanted = {f.value} if isinstance(f, ds.EqualTo) else set(f.value)
            wanted.discard(None)
            self.keys = wanted if self.keys is None else self.keys & wanted
            return True
        if column != ("updated",):
            return False
        lower = {ds.GreaterThan: LAST, ds.GreaterThanOrEqual: FIRST, ds.EqualTo: FIRST}.get(type(f))
        upper = {ds.LessThan: FIRST, ds.LessThanOrEqual: LAST, ds.EqualTo: LAST}.get(type(f))
        if lower is not None:
            self.after = max(self.after or ("", ""), (f.value, lower))
        if upper is not None:
            self.until = min(self.until or (LAST, LAST), (f.value, upper))
        return lower is not None or upper is not None

    def partitions(self) -> list[ds.InputPartition]:
        whole = Ask(None, self.after, self.until, self.asks.limit)
        if self.keys is None:
            return [AskPartition(whole)]
        keys, n = sorted(self.keys), self.asks.keys_per_request
        dealt = [AskPartition(replace(whole, keys=tuple(keys[k : k + n]))) for k in range(0, len(keys), n)]
        return dealt or [AskPartition(replace(whole, keys=()))]

    def read(self, partition: AskPartition) -> Iterator[pa.RecordBatch]:
        if partition.ask.keys != ():
            yield from self.asks.rows(partition.ask)


def _time(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text.replace("Z", "+00:00"))


def iso(at: dt.datetime) -> str:
    return at.astimezone(dt.timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.") + f"{at.microsecond // 1000:03d}Z"


class ChangesStreamReader(ds.DataSourceStreamReader):
    def __init__(self, options: dict):
        self.asks = _Asks(options)
        self.since, self.slices, self.overlap = options.get("since", ""), int(options.get("slices", 1)), float(options.get("overlap", 0))

    def initialOffset(self) -> dict:
        return {"updated": self.since, "row_id": FIRST}

    def latestOffset(self) -> dict:
        newest = self.asks.made()[1]()
        return self.initialOffset() if newest is None else {"updated": newest[0], "row_id": newest[1]}

    def partitions(self, start: dict, end: dict) -> list[ds.InputPartition]:
        after, until = (start["updated"], start["row_id"]), (end["updated"], end["row_id"])
        if after >= until:
            return [AskPartition(Ask(()))]
        if self.overlap and after[0] and after[0] != self.since:
            after = (max(self.since, iso(_time(after[0]) - dt.timedelta(seconds=self.overlap))), FIRST)
        cuts = []
        if self.slices > 1 and after[0] < until[0] and after[0]:
            low, high = _time(after[0]), _time(until[0])
            cuts = sorted({(iso(low + (high - low) * k / self.slices), LAST) for k in range(1, self.slices)})
            cuts = [c for c in cuts if after < c < until]
        bounds = [after, *cuts, until]
        return [AskPartition(Ask(None, a, b, self.asks.limit)) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def read(self, partition: AskPartition) -> Iterator[pa.RecordBatch]:
        if partition.ask.keys != ():
            yield from self.asks.rows(partition.ask)

    def commit(self, end: dict) -> None:
        """Nothing is held at the source."""


class ChangesSource(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "changes"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ds.DataSourceReader:
        return ChangesReader(dict(self.options))

    def streamReader(self, schema) -> ds.DataSourceStreamReader:
        return ChangesStreamReader(dict(self.options))
