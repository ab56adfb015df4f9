"""Versions of source rows told by keyed state: what a stream has seen of each source row lives in the state store.

``told`` takes parsed rows (``landing.parsed``) and gives only what is new: for each (source_id, updated_text) the first row that came, and for
each source_id the last good one whenever another takes its place. A key's state holds the versions it has shown and a
hash of its last good row, so neither has to be ranked out of all landed rows when it is read. Within a micro-batch the
least payload of a version is its first and the greatest (updated_at, payload) is the last good one, as in
``landing_stream``, so a batch that is replayed gives the same.

State is bounded: a version that has not come again for EXPIRY leaves the store; if it comes after that, it counts as new
once more (``raw_versions`` still shows it once). Rows without source_id or time have no version; their errors are in the landed rows.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Iterator
from hashlib import sha256

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from wardline.operators.merge import first_wins, last_wins
from wardline.sources import changes, landing

EXPIRY = dt.timedelta(days=90)
NEWS = f"kind string, {landing.PARSED}"
VERSION, CANDIDATE = "version", "candidate"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Versions(StatefulProcessor):
    """By source_id."""

    def __init__(self, expiry: dt.timedelta = EXPIRY):
        self.expiry = int(expiry.total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.shown = handle.getMapState("shown", "updated_text string", "payload_hash string", ttlDurationMs=self.expiry)
        self.last = handle.getValueState("last", "payload_hash string")

    def handleInputRows(self, key, rows: Iterable[Row], timerValues) -> Iterator[Row]:
        firsts: dict[str, Row] = {}
        last: Row | None = None
        for r in rows:
            if r.updated_text is None:
                continue
            if r.updated_text not in firsts or r.payload < firsts[r.updated_text].payload:
                firsts[r.updated_text] = r
            if r.error is None and (last is None or (r.updated_at, r.payload) > (last.updated_at, last.payload)):
                last = r
        for at, r in firsts.items():
            if not self.shown.containsKey((at,)):
                yield _news(VERSION, r)
            self.shown.updateValue((at,), (_hash(r),))  # also renews its time
        if last is not None and not (self.last.exists() and self.last.get()[0] == _hash(last)):
            self.last.update((_hash(last),))
            yield _news(CANDIDATE, last)

    def close(self) -> None:
        pass


def _hash(row: Row) -> str:
    return sha256(row.payload.encode()).hexdigest()


_COLUMNS = [c.split()[0] for c in landing.PARSED.split(", ")]


def _news(kind: str, row: Row) -> Row:
    return Row(kind=kind, **{c: row[c] for c in _COLUMNS})


def told(rows: DataFrame, expiry: dt.timedelta = EXPIRY) -> DataFrame:
    """rows: a stream of parsed rows. (kind, parsed columns): a version's first row, or a source row's last good one."""
    rows = rows.where(F.col("source_id").isNotNull() & F.col("updated_text").isNotNull())
    return rows.groupBy("source_id").transformWithState(Versions(expiry), NEWS, "Append", "ProcessingTime")


def land_changes(spark: SparkSession, client: str, out: str, *, expiry: dt.timedelta = EXPIRY, **options) -> int:
    """Lands what has changed at a source since the last call and tells its versions; returns the number of micro-batches that
    had rows. options: of ``changes.ChangesSource``. A batch writes folders named by its id and overwrites them if it is replayed."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    spark.dataSource.register(changes.ChangesSource)
    rows = spark.readStream.format("changes").options(client=client, **{k: str(v) for k, v in options.items()}).load()
    numbers = []

    def write(batch: DataFrame, number: int) -> None:
        numbers.append(number)
        batch.withColumn("batch_id", F.lit(number).cast("long")).write.mode("overwrite").partitionBy("kind").parquet(f"{out}/news/batch_id={number}")

    news = told(landing.parsed(rows.select("payload")), expiry)
    query = news.writeStream.foreachBatch(write).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return len(numbers)


def news(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(f"{landing.PARSED}, batch_id long, kind string").parquet(f"{out}/news")


def raw_versions(spark: SparkSession, out: str) -> DataFrame:
    """The first row that came for each version; only rows that were new when they came are read."""
    return first_wins(news(spark, out).where(F.col("kind") == VERSION), ["source_id", "updated_text"], ["batch_id"]).select("source_id", "updated_text", "payload")


def candidates(spark: SparkSession, out: str) -> DataFrame:
    """The last good row that came for each source row."""
    return last_wins(news(spark, out).where(F.col("kind") == CANDIDATE), ["source_id"], ["batch_id"]).select(*landing.CANDIDATE)
