"""Feeds of live facts: filters, keyset pages and their shapes.

A page is one plan, semi join, filters and ``orderBy().limit()``, which Spark runs as a top-k of k + 1 rows; only the page
reaches the driver. Ids are text and order as text.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions import cursors
from wardline.functions.parsing import iso_millis, shortest_decimal

FEED = ["id", "source_id", "row_id", "scan_key", "number", "issue_date", "status", "balance_due", "updated_at", "last_run_id", "is_current", "created_at", "modified_at"]
OPEN = "ACTIVE"
MAX_PAGE = 100


def current() -> Column:
    return F.col("is_current")


def is_open() -> Column:
    return F.col("status") == OPEN


def unpaid() -> Column:
    return F.col("balance_due") > 0


def updated_since(time) -> Column:
    return F.col("updated_at") > F.lit(time).cast("timestamp")


def after_dated(day, source_id: str) -> Column:
    """Rows after a cursor in order of falling date, no date last, then falling id."""
    if day is None:
        return F.col("issue_date").isNull() & (F.col("source_id") < source_id)
    at = F.lit(day).cast("date")
    return (F.col("issue_date") < at) | ((F.col("issue_date") == at) & (F.col("source_id") < source_id)) | F.col("issue_date").isNull()


def after_updated(time, source_id: str) -> Column:
    at = F.lit(time).cast("timestamp")
    return (F.col("updated_at") < at) | ((F.col("updated_at") == at) & (F.col("source_id") < source_id))


def of_entity(live: DataFrame, entity_keys: DataFrame, entity_id) -> DataFrame:
    """Facts filed under any of an entity's keys."""
    own = entity_keys.where(F.col("entity_id") == entity_id).select("scan_key")
    return live.join(own, "scan_key", "left_semi")


def of_portfolio(live: DataFrame, entity_keys: DataFrame) -> DataFrame:
    """Facts filed under any entity's keys, once each however many entities share a key."""
    return live.join(entity_keys.select("scan_key"), "scan_key", "left_semi")


def page(facts: DataFrame, limit: int, *, by_update: bool = False) -> DataFrame:
    """limit + 1 rows: one more than a page tells whether there is a next."""
    order = [F.col("updated_at").desc()] if by_update else [F.col("issue_date").desc_nulls_last()]
    return facts.select(*FEED).orderBy(*order, F.col("source_id").desc()).limit(limit + 1)


@dataclass(frozen=True)
class FeedQuery:
    """What a caller may ask for. ``parse`` rejects everything else."""

    open_only: bool = False
    unpaid_only: bool = False
    since: dt.datetime | None = None
    cursor: str | None = None
    limit: int = 50

    @classmethod
    def parse(cls, raw: dict[str, str], *, portfolio: bool) -> FeedQuery:
        known = {"openOnly", "unpaidOnly", "cursor", "limit"} - ({"openOnly"} if portfolio else set()) | ({"updatedSince"} if portfolio else set())
        if unknown := set(raw) - known:
            raise ValueError(f"unknown parameters: {sorted(unknown)}")
        flag = {"true": True, "false": False}
        for name in ("openOnly", "unpaidOnly"):
            if raw.get(name, "false") not in flag:
                raise ValueError(f"{name} must be true or false")
        limit = raw.get("limit", "50")
        if not limit.isdigit() or not 1 <= int(limit) <= MAX_PAGE:
            raise ValueError(f"limit must be between 1 and {MAX_PAGE}")
        since = cursors.time(raw["updatedSince"]) if "updatedSince" in raw else None
        query = cls(flag[raw.get("openOnly", "false")], flag[raw.get("unpaidOnly", "false")], since, raw.get("cursor"), int(limit))
        if query.cursor is not None:
            (cursors.updated if since else cursors.dated)(query.cursor)
        return query

    def filters(self) -> Column:
        out = current()
        for wanted, part in ((self.open_only, is_open), (self.unpaid_only, unpaid)):
            out = out & part() if wanted else out
        if self.since is not None:
            out = out & updated_since(self.since)
        if self.cursor is not None:
            out = out & (after_updated(*cursors.updated(self.cursor)) if self.since else after_dated(*cursors.dated(self.cursor)))
        return out


def read_page(facts: DataFrame, query: FeedQuery) -> tuple[list, str | None]:
    """The page's rows, and the cursor of the next one if there is one. At most MAX_PAGE + 1 rows are collected."""
    rows = page(facts.where(query.filters()), query.limit, by_update=query.since is not None).collect()
    shown = rows[: query.limit]
    if len(rows) <= query.limit:
        return shown, None
    last = shown[-1]
    if query.since is not None:
        # collected times have no zone: they are in the session's
        zone = ZoneInfo(facts.sparkSession.conf.get("spark.sql.session.timeZone"))
        return shown, cursors.encode(updated_at=last.updated_at.replace(tzinfo=zone).isoformat(), source_id=last.source_id)
    return shown, cursors.encode(issue_date=last.issue_date and last.issue_date.isoformat(), source_id=last.source_id)


def entity_shape(facts: DataFrame) -> DataFrame:
    """Texts as the entity feed writes them: the amount as short as it goes."""
    return facts.select("source_id", "scan_key", "number", F.date_format("issue_date", "yyyy-MM-dd").alias("issue_date"), "status", shortest_decimal(F.col("balance_due")).alias("balance_due"), iso_millis(F.col("updated_at")).alias("updated_at"))


def portfolio_shape(facts: DataFrame) -> DataFrame:
    """As the portfolio feed writes them: the amount always with two places."""
    amount = F.col("balance_due").cast("decimal(15,2)").cast("string").alias("balance_due")
    return facts.select("id", "source_id", "row_id", "scan_key", "number", F.date_format("issue_date", "yyyy-MM-dd").alias("issue_date"), "status", amount, iso_millis(F.col("updated_at")).alias("updated_at"), "last_run_id", "is_current")


def coverage_shape(coverage: DataFrame) -> DataFrame:
    times = [iso_millis(F.col(c)).alias(c) for c in ("last_attempt_at", "last_success_at", "source_version_at")]
    return coverage.select("entity_id", "status", "status_reason", *times, "last_error")


def entity_with_keys(entities: DataFrame, entity_keys: DataFrame) -> DataFrame:
    """Each entity with its keys in order, an empty list if it has none."""
    keys = entity_keys.groupBy("entity_id").agg(F.array_sort(F.collect_set("scan_key")).alias("scan_keys"))
    empty = F.array().cast(keys.schema["scan_keys"].dataType)
    return entities.join(keys, "entity_id", "left").withColumn("scan_keys", F.coalesce("scan_keys", empty))


def entity_payload(entities: DataFrame, entity_keys: DataFrame, coverage: DataFrame) -> DataFrame:
    """Each entity with its keys and, as structs, its coverage of each dataset."""
    told = F.struct("dataset", "status", "status_reason")
    covered = coverage.groupBy("entity_id").agg(F.array_sort(F.collect_list(told)).alias("coverage"))
    empty = F.array().cast(covered.schema["coverage"].dataType)
    return entity_with_keys(entities, entity_keys).join(covered, "entity_id", "left").withColumn("coverage", F.coalesce("coverage", empty))
