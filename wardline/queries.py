"""The registered queries: each applies operators of the engine to the relations, beside the same question in DuckDB SQL."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.functions import identifiers as ids
from wardline.functions import json_fields as jf
from wardline.functions import parsing, requests, text
from wardline.operators import audit, deltas, feeds, merge, registration, resolve, snapshots
from wardline.plans import publish
from wardline.plans.lineage import cut
from wardline.sources import geocoder, landing
from wardline.sources.relations import BATCH, relation, with_clause

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

ENTITY, LIMIT, SINCE = 7, 50, "1995-06-17 00:00:00"
RUN = publish.Run("r1", dt.datetime(2024, 1, 8), dt.datetime(2024, 1, 9, 1, 2, 3), dt.datetime(2024, 1, 7))


class Tables:
    """The relations, by attribute, made as they are asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return relation(self._spark, self._dir, name)


def query(name: str, sql: str):
    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        SQL[name] = f"{with_clause()}\n{sql}"
        return f

    return add


def day(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


# feeds ------------------------------------------------------------------------------------------------------------------

_ISO = "strftime({0}, '%Y-%m-%dT%H:%M:%S.%gZ') AS {0}"
_FEED = f"id, source_id, row_id, scan_key, number, CAST(issue_date AS STRING) AS issue_date, status, CAST(balance_due AS STRING) AS balance_due, {_ISO.format('updated_at')}, last_run_id, is_current, {_ISO.format('created_at')}, {_ISO.format('modified_at')}"
_OWN = f"scan_key IN (SELECT scan_key FROM entity_keys WHERE entity_id = {ENTITY})"
_ALL = "scan_key IN (SELECT scan_key FROM entity_keys)"
_DATED, _UPDATED = "live.issue_date DESC NULLS LAST, source_id DESC", "live.updated_at DESC, source_id DESC"


def _shown(page: DataFrame) -> DataFrame:
    return page.withColumns({"issue_date": day("issue_date"), "balance_due": F.col("balance_due").cast("string"), **{c: parsing.iso_millis(F.col(c)) for c in ("updated_at", "created_at", "modified_at")}})


def _page_sql(scope: str, where: str = "TRUE", order: str = _DATED) -> str:
    return f"SELECT {_FEED} FROM live WHERE is_current AND {scope} AND ({where}) ORDER BY {order} LIMIT {LIMIT + 1}"


def _of_entity(t: Tables) -> DataFrame:
    return feeds.of_entity(t.live.where(feeds.current()), t.entity_keys, ENTITY)


def _of_portfolio(t: Tables) -> DataFrame:
    return feeds.of_portfolio(t.live.where(feeds.current()), t.entity_keys)


_CURSOR_SQL = "issue_date < DATE '1996-01-02' OR (issue_date = DATE '1996-01-02' AND source_id < '5') OR issue_date IS NULL"
for _name, _filter, _where in (
    ("first_page", None, "TRUE"),
    ("dated_cursor", lambda: feeds.after_dated("1996-01-02", "5"), _CURSOR_SQL),
    ("null_cursor", lambda: feeds.after_dated(None, "5"), "issue_date IS NULL AND source_id < '5'"),
    ("open_only", feeds.is_open, "status = 'ACTIVE'"),
    ("unpaid_only", feeds.unpaid, "balance_due > 0"),
    ("open_unpaid", lambda: feeds.is_open() & feeds.unpaid(), "status = 'ACTIVE' AND balance_due > 0"),
):
    for _kind, _facts, _scope in (("property_feed", _of_entity, _OWN), ("portfolio_feed", _of_portfolio, _ALL)):

        @query(f"{_kind}_{_name}", _page_sql(_scope, _where))
        def _(t: Tables, facts=_facts, where=_filter) -> DataFrame:
            rows = facts(t)
            return _shown(feeds.page(rows.where(where()) if where else rows, LIMIT))


@query("portfolio_updated_since", _page_sql(_ALL, f"updated_at > CAST('{SINCE}' AS TIMESTAMP)", _UPDATED))
def _(t: Tables) -> DataFrame:
    return _shown(feeds.page(_of_portfolio(t).where(feeds.updated_since(SINCE)), LIMIT, by_update=True))


@query("portfolio_updated_since_cursor", _page_sql(_ALL, f"updated_at > CAST('{SINCE}' AS TIMESTAMP) AND (updated_at < TIMESTAMP '1997-03-04 00:00:00' OR (updated_at = TIMESTAMP '1997-03-04 00:00:00' AND source_id < '5'))", _UPDATED))
def _(t: Tables) -> DataFrame:
    rows = _of_portfolio(t).where(feeds.updated_since(SINCE) & feeds.after_updated("1997-03-04 00:00:00", "5"))
    return _shown(feeds.page(rows, LIMIT, by_update=True))


@query("feed_shape_property", rf"SELECT source_id, scan_key, number, strftime(issue_date, '%Y-%m-%d') AS issue_date, status, regexp_replace(regexp_replace(CAST(balance_due AS STRING), '(\.[0-9]*?)0+$', '\1'), '\.$', '') AS balance_due, strftime(updated_at, '%Y-%m-%dT%H:%M:%S.%gZ') AS updated_at FROM live WHERE {_OWN}")
def _(t: Tables) -> DataFrame:
    return feeds.entity_shape(feeds.of_entity(t.live, t.entity_keys, ENTITY))


@query("feed_shape_portfolio", f"SELECT id, source_id, row_id, scan_key, number, strftime(issue_date, '%Y-%m-%d') AS issue_date, status, CAST(balance_due AS STRING) AS balance_due, strftime(updated_at, '%Y-%m-%dT%H:%M:%S.%gZ') AS updated_at, last_run_id, is_current FROM live WHERE {_ALL}")
def _(t: Tables) -> DataFrame:
    return feeds.portfolio_shape(feeds.of_portfolio(t.live, t.entity_keys))


_COVERAGE = "entity_id, status, status_reason, last_attempt_run_id, last_success_run_id, " + ", ".join(_ISO.format(c) for c in ("last_attempt_at", "last_success_at", "source_version_at")) + ", last_error"


@query("coverage_shape", "SELECT entity_id, status, status_reason, " + ", ".join(_ISO.format(c) for c in ("last_attempt_at", "last_success_at", "source_version_at")) + ", last_error FROM coverage")
def _(t: Tables) -> DataFrame:
    return feeds.coverage_shape(t.coverage)


@query("entity_with_keys", "SELECT entity_id, version, coalesce(keys, '') AS scan_keys FROM versions LEFT JOIN (SELECT entity_id, string_agg(CAST(scan_key AS STRING), ',' ORDER BY scan_key) AS keys FROM (SELECT DISTINCT entity_id, scan_key FROM entity_keys) AS d GROUP BY entity_id) AS k USING (entity_id)")
def _(t: Tables) -> DataFrame:
    return feeds.entity_with_keys(t.versions, t.entity_keys).withColumn("scan_keys", F.array_join(F.col("scan_keys").cast("array<string>"), ","))


@query("entity_payload", """SELECT entity_id, version, coalesce(keys, '') AS scan_keys, coalesce(told, '') AS coverage FROM versions LEFT JOIN (SELECT entity_id, string_agg(CAST(scan_key AS STRING), ',' ORDER BY scan_key) AS keys FROM (SELECT DISTINCT entity_id, scan_key FROM entity_keys) AS d GROUP BY entity_id) AS k USING (entity_id)
  LEFT JOIN (SELECT entity_id, string_agg(dataset || ':' || status || ':' || coalesce(status_reason, ''), ';' ORDER BY dataset) AS told FROM (SELECT entity_id, d.dataset, status, status_reason FROM coverage CROSS JOIN (VALUES ('ecb'), ('permits')) AS d(dataset) WHERE d.dataset = 'ecb' OR entity_id % 2 = 0) AS c GROUP BY entity_id) AS t USING (entity_id)""")
def _(t: Tables) -> DataFrame:
    datasets = F.explode(F.when(F.col("entity_id") % 2 == 0, F.array(F.lit("ecb"), F.lit("permits"))).otherwise(F.array(F.lit("ecb")))).alias("dataset")
    found = feeds.entity_payload(t.versions, t.entity_keys, t.coverage.select("entity_id", "status", "status_reason", datasets))
    told = F.transform("coverage", lambda c: F.concat(c["dataset"], F.lit(":"), c["status"], F.lit(":"), F.coalesce(c["status_reason"], F.lit(""))))
    return found.select("entity_id", "version", F.array_join(F.col("scan_keys").cast("array<string>"), ",").alias("scan_keys"), F.array_join(told, ";").alias("coverage"))


# snapshots and batches --------------------------------------------------------------------------------------------------


@query("snapshot_property_bins", "SELECT 'r9' AS run_id, entity_id, scan_key, version FROM entity_keys JOIN versions USING (entity_id)")
def _(t: Tables) -> DataFrame:
    return snapshots.snapshot(t.entity_keys, t.versions, "r9")


@query("distinct_scan_keys", "SELECT DISTINCT scan_key FROM snapshot")
def _(t: Tables) -> DataFrame:
    return snapshots.scan_keys(t.snapshot)


@query("batch_assignment", "SELECT scan_key, batch_number FROM batch_keys")
def _(t: Tables) -> DataFrame:
    return snapshots.batch_numbers(snapshots.scan_keys(t.snapshot), BATCH)


@query("batch_definition_lists", "SELECT batch_number, string_agg(CAST(scan_key AS STRING), ',' ORDER BY scan_key) AS scan_keys, CAST(count(*) AS INT) AS n_keys FROM batch_keys GROUP BY batch_number")
def _(t: Tables) -> DataFrame:
    lists = snapshots.batch_definitions(snapshots.batch_numbers(snapshots.scan_keys(t.snapshot), BATCH))
    return lists.withColumn("scan_keys", F.array_join(F.col("scan_keys").cast("array<string>"), ","))


@query("batch_expected_counts", f"SELECT count(*) AS n_pairs, count(DISTINCT scan_key) AS n_keys, CAST(ceil(count(DISTINCT scan_key) / {BATCH}.0) AS BIGINT) AS n_batches FROM snapshot")
def _(t: Tables) -> DataFrame:
    return snapshots.expected_counts(t.snapshot, snapshots.batch_definitions(snapshots.batch_numbers(snapshots.scan_keys(t.snapshot), BATCH)))


@query("batch_exact_cover", """, dealt AS (SELECT CASE WHEN scan_key % 50 = 0 THEN scan_key + 2 WHEN scan_key % 70 = 0 THEN -scan_key ELSE scan_key END AS scan_key FROM batch_keys), n AS (SELECT scan_key, count(*) AS n FROM dealt GROUP BY scan_key), due AS (SELECT DISTINCT scan_key FROM snapshot),
  c AS (SELECT count(*) FILTER (WHERE n > 1) AS repeated, count(*) FILTER (WHERE due.scan_key IS NULL) AS unexpected, count(*) FILTER (WHERE n IS NULL) AS missing FROM n FULL JOIN due ON n.scan_key = due.scan_key) SELECT *, repeated + unexpected + missing = 0 AS exact FROM c""")
def _(t: Tables) -> DataFrame:
    key = F.col("scan_key")
    wrong = F.when(key % 50 == 0, key + 2).when(key % 70 == 0, -key).otherwise(key)  # some twice, some missing, some of no entity
    return snapshots.exact_cover(snapshots.batch_definitions(t.batch_keys.withColumn("scan_key", wrong)), t.snapshot)


# landing and live state -------------------------------------------------------------------------------------------------


@query("raw_first_wins", "SELECT source_id, updated_text, min(event_id) AS event_id FROM raw_rows GROUP BY source_id, updated_text")
def _(t: Tables) -> DataFrame:
    return merge.first_wins(t.raw_rows, ["source_id", "updated_text"], ["event_id"]).select("source_id", "updated_text", "event_id")


@query("staging_last_wins", "SELECT source_id, max_by(payload, event_id) AS payload, max(event_id) AS event_id FROM raw_rows GROUP BY source_id")
def _(t: Tables) -> DataFrame:
    return merge.last_wins(t.raw_rows, ["source_id"], ["event_id"]).select("source_id", "payload", "event_id")


@query("raw_new_versions_only", "SELECT r.source_id, r.updated_text, min(r.event_id) AS event_id FROM raw_rows r LEFT JOIN raw_table o ON r.source_id = o.source_id AND r.updated_text = o.updated_text WHERE o.source_id IS NULL GROUP BY r.source_id, r.updated_text")
def _(t: Tables) -> DataFrame:
    return merge.insert_if_absent(t.raw_table, t.raw_rows, ["source_id", "updated_text"], ["event_id"]).select("source_id", "updated_text", "event_id")


_STAGED_COLUMNS = ("row_id", "scan_key", "number", "issue_date", "status", "balance_due", "updated_at")
_NOW = "TIMESTAMP '2024-01-09 01:02:03'"
_PROMOTED = f"""promoted AS (SELECT coalesce(s.source_id, l.source_id) AS source_id, coalesce(l.id, md5(s.source_id)) AS id, {", ".join(f"CASE WHEN s.source_id IS NULL THEN l.{c} ELSE s.{c} END AS {c}" for c in _STAGED_COLUMNS)},
  CASE WHEN s.source_id IS NULL THEN l.is_current ELSE TRUE END AS is_current, CASE WHEN s.source_id IS NULL THEN l.last_run_id ELSE 'r1' END AS last_run_id, coalesce(l.created_at, {_NOW}) AS created_at, CASE WHEN s.source_id IS NULL THEN l.modified_at ELSE {_NOW} END AS modified_at FROM live l FULL JOIN staged s ON l.source_id = s.source_id)"""
_RETIRED = "is_current AND NOT (is_current AND last_run_id IS DISTINCT FROM 'r1' AND scan_key IN (SELECT scan_key FROM snapshot))"


_FINISHED = "2024-01-09 01:02:03"


def _live(df: DataFrame) -> DataFrame:
    return _shown(df)


@query("live_promote", f", {_PROMOTED} SELECT {_FEED} FROM promoted")
def _(t: Tables) -> DataFrame:
    return _live(publish.promote(t.live, t.staged, "r1", _FINISHED))


@query("live_reconcile", f"SELECT {_FEED.replace('is_current', f'{_RETIRED} AS is_current')} FROM live")
def _(t: Tables) -> DataFrame:
    return _live(publish.reconcile(t.live, t.snapshot, "r1"))


@query("live_promote_and_reconcile", f", {_PROMOTED} SELECT {_FEED.replace('is_current', f'{_RETIRED} AS is_current')} FROM promoted")
def _(t: Tables) -> DataFrame:
    return _live(publish.reconcile(publish.promote(t.live, t.staged, "r1", _FINISHED), t.snapshot, "r1"))


_OLD_NEW = "live o FULL OUTER JOIN (SELECT * REPLACE ({} AS is_current) FROM promoted) n ON o.source_id = n.source_id"
_DELTA_COLUMNS = ("balance_due", "id", "is_current", "issue_date", "last_run_id", "created_at", "modified_at", "number", "row_id", "scan_key", "status", "updated_at")


@query("run_deltas", f", {_PROMOTED}, d AS (SELECT coalesce(o.source_id, n.source_id) AS source_id, CASE WHEN o.source_id IS NULL THEN 'ADDED' WHEN n.source_id IS NULL THEN 'GONE' ELSE 'CHANGED' END AS kind, CASE WHEN o.source_id IS NULL OR n.source_id IS NULL THEN '' ELSE concat_ws(',', {', '.join(f"CASE WHEN o.{c} IS DISTINCT FROM n.{c} THEN '{c}' END" for c in sorted(_DELTA_COLUMNS))}) END AS columns FROM {_OLD_NEW.format(_RETIRED)}) SELECT * FROM d WHERE kind <> 'CHANGED' OR columns <> ''")
def _(t: Tables) -> DataFrame:
    after = publish.reconcile(publish.promote(t.live, t.staged, "r1", _FINISHED), t.snapshot, "r1")
    return deltas.of_tables(t.live, after, ["source_id"]).withColumn("columns", F.array_join("columns", ","))


@query("distinct_keys_by_bitmap", "SELECT count(DISTINCT scan_key) AS distinct_keys FROM live WHERE scan_key >= 0")
def _(t: Tables) -> DataFrame:
    # three landings of rows, each with bitmaps of its own
    landed = [audit.key_bitmaps(t.live.where(F.pmod(F.xxhash64("source_id"), F.lit(3)) == k), F.when(F.col("scan_key") >= 0, F.col("scan_key"))) for k in range(3)]
    return audit.distinct_in(audit.merged_bitmaps(reduce(DataFrame.unionByName, landed)))


# coverage ---------------------------------------------------------------------------------------------------------------

_NEWER = """newer AS (SELECT c.entity_id FROM coverage c LEFT JOIN runs a ON a.run_id = c.last_attempt_run_id LEFT JOIN runs s ON s.run_id = c.last_success_run_id
  WHERE a.started_at > TIMESTAMP '2024-01-08 00:00:00' OR s.started_at > TIMESTAMP '2024-01-08 00:00:00')"""
_CURRENT = "SELECT DISTINCT entity_id FROM snapshot JOIN versions USING (entity_id, version)"
_STALE = "SELECT DISTINCT s.entity_id FROM snapshot s JOIN versions v ON s.entity_id = v.entity_id AND s.version <> v.version"
_FAILURES = """failures AS (SELECT s.entity_id, min_by(b.last_error, b.batch_number) AS last_error FROM snapshot s JOIN batch_keys k USING (scan_key) JOIN batches b USING (batch_number)
  WHERE b.status = 'FAILED' AND length(trim(b.last_error)) > 0 AND b.batch_number <> 8 GROUP BY s.entity_id)"""


def _times(df: DataFrame) -> DataFrame:
    return df.withColumns({c: parsing.iso_millis(F.col(c)) for c in ("last_attempt_at", "last_success_at", "source_version_at") if c in df.columns})


@query("coverage_newer_run_guard", f", {_NEWER} SELECT entity_id FROM newer")
def _(t: Tables) -> DataFrame:
    return publish.published_by_newer(t.coverage, t.runs, F.lit("2024-01-08 00:00:00").cast("timestamp"))


_GUARDED = publish.Run("r1", "2024-01-08 00:00:00", "2024-01-09 01:02:03", "2024-01-07 00:00:00")
_GUARD_SQL = "entity_id NOT IN (SELECT entity_id FROM newer)"


def _merged_sql(changes: str, columns: dict[str, str]) -> str:
    """Coverage after an upsert of the changes that sets only the given columns."""
    out = ", ".join(f"CASE WHEN n.entity_id IS NULL THEN c.{c} ELSE {columns[c]} END AS {c}" if c in columns else f"c.{c}" for c in ("status", "status_reason", "last_attempt_run_id", "last_success_run_id", "last_attempt_at", "last_success_at", "source_version_at", "last_error"))
    return f"changes AS ({changes}), merged AS (SELECT coalesce(n.entity_id, c.entity_id) AS entity_id, {out} FROM coverage c FULL JOIN changes n ON c.entity_id = n.entity_id) SELECT {_COVERAGE} FROM merged"


@query("coverage_checked", f", {_NEWER}, " + _merged_sql(f"SELECT entity_id FROM ({_CURRENT}) AS x WHERE {_GUARD_SQL}", {"status": "'CHECKED'", "status_reason": "NULL", "last_attempt_run_id": "'r1'", "last_success_run_id": "'r1'", "last_attempt_at": "TIMESTAMP '2024-01-09 01:02:03'", "last_success_at": "TIMESTAMP '2024-01-09 01:02:03'", "source_version_at": "TIMESTAMP '2024-01-07 00:00:00'", "last_error": "NULL"}))
def _(t: Tables) -> DataFrame:
    return _times(publish.merge_coverage(t.coverage, publish.success_changes(t.snapshot, t.versions, t.coverage, _runs(t), _GUARDED)))


@query("coverage_stale", f", {_NEWER}, " + _merged_sql(f"SELECT entity_id FROM ({_STALE}) AS x WHERE {_GUARD_SQL}", {"status": "'NOT_CHECKED'", "status_reason": "'IDENTIFIERS_CHANGED_AFTER_SNAPSHOT'"}))
def _(t: Tables) -> DataFrame:
    return _times(publish.merge_coverage(t.coverage, publish.stale_changes(t.snapshot, t.versions, t.coverage, _runs(t), _GUARDED)))


def _runs(t: Tables) -> DataFrame:
    return t.runs.select("run_id", "started_at")


def _batches(t: Tables) -> DataFrame:
    return t.batches


_FAILED = {"status": "'FAILED'", "status_reason": "NULL", "last_attempt_run_id": "'r1'", "last_attempt_at": "TIMESTAMP '2024-01-09 01:02:03'"}


@query("coverage_failed_attributed", f", {_FAILURES}, " + _merged_sql(f"SELECT x.entity_id, coalesce(f.last_error, 'RUN_NOT_PROMOTED') AS error FROM ({_CURRENT}) AS x LEFT JOIN failures f ON f.entity_id = x.entity_id", _FAILED | {"last_error": "n.error"}))
def _(t: Tables) -> DataFrame:
    return _times(publish.merge_coverage(t.coverage, publish.failure_changes(t.snapshot, t.versions, _batches(t), _GUARDED)))


@query("coverage_source_changed", ", " + _merged_sql(_CURRENT, _FAILED | {"last_error": "'SOURCE_CHANGED'"}))
def _(t: Tables) -> DataFrame:
    return _times(publish.merge_coverage(t.coverage, publish.failure_changes(t.snapshot, t.versions, _batches(t), _GUARDED, source_changed=True)))


@query("failed_keys_unnested", "SELECT k.scan_key, k.batch_number, b.last_error FROM batch_keys k JOIN batches b USING (batch_number) WHERE b.status = 'FAILED' AND length(trim(b.last_error)) > 0 AND k.batch_number <> 8")
def _(t: Tables) -> DataFrame:
    return publish.failed_keys(_batches(t)).withColumn("scan_key", F.col("scan_key").cast("bigint"))


@query("first_failing_batch", f", {_FAILURES} SELECT entity_id, last_error FROM failures")
def _(t: Tables) -> DataFrame:
    return publish.first_failures(t.snapshot, _batches(t))


@query("snapshot_version_stats", "SELECT s.entity_id, min(s.version) AS least_version, count(*) AS n_rows, count(DISTINCT s.version) AS n_versions, v.version AS current_version FROM mixed_snapshot s JOIN versions v ON s.entity_id = v.entity_id GROUP BY s.entity_id, v.version")
def _(t: Tables) -> DataFrame:
    return publish.version_stats(t.mixed_snapshot, t.versions)


@query("snapshot_version_conflicts", "SELECT entity_id, count(DISTINCT version) AS n_versions FROM mixed_snapshot GROUP BY entity_id HAVING count(DISTINCT version) > 1")
def _(t: Tables) -> DataFrame:
    return publish.version_conflicts(t.mixed_snapshot)


# contracts and audits ---------------------------------------------------------------------------------------------------

_EVENTS = "(SELECT CASE WHEN event_id % 97 = 0 THEN NULL ELSE user_id END AS k FROM events) AS e"


def _events(t: Tables) -> DataFrame:
    return t.events.select(F.when(F.col("event_id") % 97 != 0, F.col("user_id")).alias("k"))


@query("source_contract_stats", f"SELECT count(*) AS total_rows, count(DISTINCT k) AS distinct_keys, count(*) FILTER (WHERE k IS NULL) AS null_keys FROM {_EVENTS}")
def _(t: Tables) -> DataFrame:
    return audit.contract_stats(_events(t), "k")


@query("source_contract_duplicates", f"SELECT k, count(*) AS n FROM {_EVENTS} WHERE k IS NOT NULL GROUP BY k HAVING count(*) > 1")
def _(t: Tables) -> DataFrame:
    return audit.duplicate_groups(_events(t), "k")


@query("source_contract_verdict", f"SELECT *, null_keys = 0 AND duplicate_groups = 0 AND total_rows = distinct_keys AS holds FROM (SELECT count(*) AS total_rows, count(DISTINCT k) AS distinct_keys, count(*) FILTER (WHERE k IS NULL) AS null_keys, (SELECT count(*) FROM (SELECT k FROM {_EVENTS} WHERE k IS NOT NULL GROUP BY k HAVING count(*) > 1)) AS duplicate_groups FROM {_EVENTS}) AS c")
def _(t: Tables) -> DataFrame:
    return audit.contract_verdict(_events(t), "k")


@query("source_contract_kept", "SELECT *, null_keys = 0 AND duplicate_groups = 0 AND total_rows = distinct_keys AS holds FROM (SELECT count(*) AS total_rows, count(DISTINCT o_orderkey) AS distinct_keys, count(*) FILTER (WHERE o_orderkey IS NULL) AS null_keys, count(o_orderkey) - count(DISTINCT o_orderkey) AS duplicate_groups FROM orders) AS c")
def _(t: Tables) -> DataFrame:
    return audit.contract_verdict(t.orders, "o_orderkey")


@query("run_metrics", "SELECT run_id, count(*) AS n_batches, count(*) FILTER (WHERE status = 'PENDING') AS n_pending, count(*) FILTER (WHERE status = 'COMPLETED') AS n_completed, count(*) FILTER (WHERE status = 'FAILED') AS n_failed, CAST(coalesce(sum(rows_fetched), 0) AS BIGINT) AS rows_fetched, bool_or(status <> 'COMPLETED') AS any_open FROM batches GROUP BY run_id")
def _(t: Tables) -> DataFrame:
    return audit.run_metrics(_batches(t))


@query("run_operations", """SELECT r.run_id, r.status, coalesce(s.n, 0) AS keys_scanned, CAST(coalesce(b.data_calls, 0) AS BIGINT) AS data_calls, CAST(coalesce(b.retry_calls, 0) AS BIGINT) AS retry_calls, CAST(coalesce(b.total_calls, 0) AS BIGINT) AS total_calls, CAST(coalesce(b.rows_fetched, 0) AS BIGINT) AS rows_fetched, coalesce(w.n, 0) AS rows_written,
  CASE WHEN r.status = 'COMPLETED' THEN 0 ELSE greatest(1, coalesce(b.failed, 0)) END AS failures FROM runs r LEFT JOIN (SELECT run_id, count(DISTINCT scan_key) AS n FROM snapshot GROUP BY run_id) s USING (run_id) LEFT JOIN (SELECT run_id, count(*) AS n FROM staged GROUP BY run_id) w USING (run_id)
  LEFT JOIN (SELECT run_id, sum(requests - retries) AS data_calls, sum(retries) AS retry_calls, sum(requests) AS total_calls, sum(rows_fetched) AS rows_fetched, count(*) FILTER (WHERE status = 'FAILED') AS failed FROM batches GROUP BY run_id) b USING (run_id)""")
def _(t: Tables) -> DataFrame:
    return audit.operational_summary(t.runs, t.snapshot, _batches(t), t.staged)


@query("request_metrics_delta", "SELECT batch_number, CAST(greatest(0, requests - CASE WHEN batch_number % 5 = 0 THEN 0 ELSE rows_fetched - 2 END) AS BIGINT) AS requests, CAST(greatest(0, retries - CASE WHEN batch_number % 5 = 0 THEN 0 ELSE 1 END) AS BIGINT) AS retries FROM batches")
def _(t: Tables) -> DataFrame:
    before = _batches(t).where("batch_number % 5 <> 0").select("batch_number", (F.col("rows_fetched") - 2).alias("requests"), F.lit(1).alias("retries"))  # others are new
    return audit.request_delta(_batches(t).select("batch_number", "requests", "retries"), before, "batch_number")


@query("duplicate_audit", """SELECT 'raw' AS table_name, count(*) AS total, count(DISTINCT source_id || '|' || updated_text) AS distinct_keys, count(*) - count(DISTINCT source_id || '|' || updated_text) AS excess FROM raw_rows
  UNION ALL SELECT 'live', count(*), count(DISTINCT source_id), count(*) - count(DISTINCT source_id) FROM live""")
def _(t: Tables) -> DataFrame:
    return audit.duplicate_audit({"raw": (t.raw_rows, ["source_id", "updated_text"]), "live": (t.live, ["source_id"])})


@query("run_audit_record", """SELECT r.run_id, r.status, coalesce(s.n_pairs, 0) AS n_pairs, coalesce(s.n_entities, 0) AS n_entities, coalesce(s.n_keys, 0) AS n_keys, coalesce(b.n_batches, 0) AS n_batches, CAST(coalesce(b.rows_fetched, 0) AS BIGINT) AS rows_fetched, coalesce(g.n_staged, 0) AS n_staged, coalesce(g.n_sources, 0) AS n_sources
  FROM runs r LEFT JOIN (SELECT run_id, count(*) AS n_pairs, count(DISTINCT entity_id) AS n_entities, count(DISTINCT scan_key) AS n_keys FROM snapshot GROUP BY run_id) s USING (run_id)
  LEFT JOIN (SELECT run_id, count(*) AS n_batches, sum(rows_fetched) AS rows_fetched FROM batches GROUP BY run_id) b USING (run_id) LEFT JOIN (SELECT run_id, count(*) AS n_staged, count(DISTINCT source_id) AS n_sources FROM staged GROUP BY run_id) g USING (run_id)""")
def _(t: Tables) -> DataFrame:
    return audit.run_audit(t.runs, t.snapshot, _batches(t), t.staged)


@query("mapping_equality", "SELECT (SELECT count(*) FROM (SELECT entity_id, scan_key FROM entity_keys EXCEPT ALL SELECT entity_id, scan_key FROM snapshot)) AS missing, (SELECT count(*) FROM (SELECT entity_id, scan_key FROM snapshot EXCEPT ALL SELECT entity_id, scan_key FROM entity_keys)) AS unexpected")
def _(t: Tables) -> DataFrame:
    return audit.same_mapping(t.entity_keys, t.snapshot.select("entity_id", "scan_key"))


_SEED_KEYS = ("in_order", "broken_at_gap", "broken_inside", "input")


@query("seed_checks", " UNION ALL ".join(f"SELECT '{k}' AS seed_key, count(*) AS total, count(DISTINCT {k}) AS distinct_keys, (SELECT bool_and(coalesce(b <= {k}, TRUE)) FROM (SELECT {k}, lag({k}) OVER (ORDER BY pos, {k}) AS b FROM seeds WHERE pos IS NOT NULL AND {k} IS NOT NULL) AS x) AS in_order FROM seeds" for k in _SEED_KEYS))
def _(t: Tables) -> DataFrame:
    seeds = t.seeds
    return reduce(DataFrame.unionByName, (audit.seed_checks(seeds, k).select(F.lit(k).alias("seed_key"), "total", "distinct_keys", "in_order") for k in _SEED_KEYS))


@query("integrity_violations", "SELECT * FROM (SELECT unnest([{'rule': 'positive_balance', 'n': count(*) FILTER (WHERE NOT coalesce(balance_due >= 0, FALSE))}, {'rule': 'numbered', 'n': count(*) FILTER (WHERE number IS NULL)}, {'rule': 'current_rows_are_dated', 'n': count(*) FILTER (WHERE is_current AND issue_date IS NULL)}, {'rule': 'has_id', 'n': count(*) FILTER (WHERE source_id IS NULL)}], recursive := true) FROM live) WHERE n > 0")
def _(t: Tables) -> DataFrame:
    return audit.violations(t.live, {"positive_balance": F.col("balance_due") >= 0, "numbered": F.col("number").isNotNull(), "current_rows_are_dated": ~F.col("is_current") | F.col("issue_date").isNotNull(), "has_id": F.col("source_id").isNotNull()})


# resolution -------------------------------------------------------------------------------------------------------------

_PARSED = r"parsed AS (SELECT pos, input, CASE WHEN regexp_full_match(regexp_replace(input, '\s+', '', 'g'), '[0-9]{10}') THEN regexp_replace(input, '\s+', '', 'g') END AS parcel FROM inputs)"
_ASSESSED = r"""assessed AS (SELECT parcel, borough, block, lot, address, list_filter([CASE WHEN parcel IS NULL THEN 'missing_bbl' END, CASE WHEN borough IS NULL THEN 'missing_borocode' END, CASE WHEN block IS NULL THEN 'missing_block' END, CASE WHEN lot IS NULL THEN 'missing_lot' END, CASE WHEN address IS NULL THEN 'missing_address' END,
  CASE WHEN CAST(substr(parcel, 1, 1) AS INT) <> borough OR CAST(substr(parcel, 2, 5) AS INT) <> block OR CAST(substr(parcel, 7, 4) AS INT) <> lot THEN 'identifier_mismatch' END], lambda x: x IS NOT NULL) AS reasons
  FROM (SELECT CASE WHEN regexp_full_match(split_part(trim(bbl), '.', 1), '[0-9]{1,10}') THEN lpad(split_part(trim(bbl), '.', 1), 10, '0') END AS parcel, TRY_CAST(split_part(borocode, '.', 1) AS INT) AS borough, TRY_CAST(split_part(block, '.', 1) AS INT) AS block, TRY_CAST(split_part(lot, '.', 1) AS INT) AS lot, nullif(trim(address), '') AS address FROM parcel_records) AS r)"""
_STATUS = """statuses AS (SELECT p.parcel, CASE WHEN a.parcel IS NULL THEN 'NOT_FOUND' WHEN a.complete = 1 THEN 'FOUND' WHEN a.complete > 1 THEN 'MULTIPLE' ELSE 'INCOMPLETE' END AS parcel_status, CASE WHEN a.complete = 1 THEN a.address END AS address, CASE WHEN a.complete = 0 THEN a.reasons END AS reasons
  FROM parcels p LEFT JOIN (SELECT parcel, count(*) FILTER (WHERE len(reasons) = 0) AS complete, min(CASE WHEN len(reasons) = 0 THEN address END) AS address,
    array_to_string(list_filter(['missing_bbl', 'missing_borocode', 'missing_block', 'missing_lot', 'missing_address', 'identifier_mismatch'], lambda r: list_contains(flatten(list(reasons)), r)), ',') AS reasons FROM assessed WHERE parcel IS NOT NULL GROUP BY parcel) a USING (parcel))"""
_FOUND = "found AS (SELECT k.parcel, f.* FROM lots k JOIN footprints f ON f.base_parcel = k.parcel UNION SELECT k.parcel, f.* FROM lots k JOIN footprints f ON f.map_parcel = k.parcel)"


def _verdict_sql(mode: str, parcel: str = "parcel") -> str:
    base = f"CASE WHEN base_parcel IS DISTINCT FROM {parcel} THEN 'BASE_MISMATCH' END"
    return f"CASE WHEN NOT has_map THEN {base} WHEN map_parcel IS NULL THEN {base if mode == 'parcel' else chr(39) + 'MAP_MISMATCH' + chr(39)} WHEN map_parcel <> {parcel} THEN 'MAP_MISMATCH' END"


_BUILDINGS = "list_sort(list_distinct(list(building) FILTER (WHERE reason IS NULL AND regexp_full_match(building, '[0-9]{7}') AND building NOT LIKE '%000000')))"
_VALID = f"valid AS (SELECT parcel, CASE WHEN count(*) FILTER (WHERE reason IS NULL) > 0 THEN coalesce(array_to_string({_BUILDINGS}, ','), '') END AS buildings, CASE WHEN count(*) FILTER (WHERE reason IS NULL) = 0 THEN CASE WHEN count(*) FILTER (WHERE reason = 'MAP_MISMATCH') > 0 THEN 'MAP_MISMATCH' ELSE 'BASE_MISMATCH' END END AS footprint_error FROM (SELECT *, {_verdict_sql('parcel')} AS reason FROM found) AS j GROUP BY parcel)"
_CHAIN = """units AS (SELECT l.parcel, count(u.base_parcel) AS n, min(u.base_parcel) AS b FROM lots l LEFT JOIN unit_map u ON u.unit_parcel = l.parcel WHERE CAST(substr(l.parcel, 7, 4) AS INT) BETWEEN 1001 AND 7500 GROUP BY l.parcel),
  bills AS (SELECT base_parcel, count(*) AS n, min(billing_parcel) AS billing FROM billing_map GROUP BY base_parcel),
  chain AS (SELECT u.parcel, CASE WHEN u.n = 1 THEN u.b END AS base_parcel, CASE WHEN u.n = 1 AND i.n = 1 THEN i.billing END AS billing_parcel,
    CASE WHEN u.n = 0 THEN 'CONDO_UNIT_NOT_FOUND' WHEN u.n > 1 THEN 'CONDO_UNIT_AMBIGUOUS' WHEN i.n IS NULL THEN 'CONDO_BILLING_NOT_FOUND' WHEN i.n > 1 THEN 'CONDO_BILLING_AMBIGUOUS' END AS condo_error FROM units u LEFT JOIN bills i ON i.base_parcel = u.b AND u.n = 1)"""
_CONDO_VALID = f"condo_valid AS (SELECT billing_parcel, CASE WHEN count(*) FILTER (WHERE reason IS NULL) > 0 THEN coalesce(array_to_string({_BUILDINGS}, ','), '') END AS buildings, CASE WHEN count(*) FILTER (WHERE reason IS NULL) = 0 THEN CASE WHEN count(*) FILTER (WHERE reason = 'MAP_MISMATCH') > 0 THEN 'MAP_MISMATCH' ELSE 'BASE_MISMATCH' END END AS footprint_error FROM (SELECT c.billing_parcel, f.building, {_verdict_sql('condo', 'c.billing_parcel')} AS reason FROM (SELECT DISTINCT base_parcel AS of_base, billing_parcel FROM chain WHERE billing_parcel IS NOT NULL) c JOIN footprints f ON f.base_parcel = c.of_base) AS j GROUP BY billing_parcel)"
_CODES = "CASE s.parcel_status WHEN 'NOT_FOUND' THEN 'PARCEL_NOT_FOUND' WHEN 'INCOMPLETE' THEN 'PARCEL_INCOMPLETE' WHEN 'MULTIPLE' THEN 'PARCEL_MULTIPLE' END"
_RESOLVED = f"""resolved AS (SELECT parcel, error, CASE WHEN error IS NULL THEN address END AS address, base_parcel, billing_parcel, CASE WHEN error IS NULL THEN coalesce(buildings, '') END AS buildings FROM (
  SELECT l.parcel, coalesce({_CODES}, v.footprint_error) AS error, s.address, NULL AS base_parcel, NULL AS billing_parcel, v.buildings FROM lots l JOIN statuses s USING (parcel) LEFT JOIN valid v USING (parcel) WHERE CAST(substr(l.parcel, 7, 4) AS INT) NOT BETWEEN 1001 AND 7500
  UNION ALL SELECT c.parcel, coalesce(c.condo_error, {_CODES}, v.footprint_error), s.address, c.base_parcel, c.billing_parcel, v.buildings FROM chain c LEFT JOIN statuses s ON s.parcel = c.billing_parcel LEFT JOIN condo_valid v ON v.billing_parcel = c.billing_parcel) AS x)"""
_RESOLUTION = ", ".join((_PARSED, _ASSESSED, _STATUS, _FOUND, _VALID, _CHAIN, _CONDO_VALID, _RESOLVED))
_OUTCOMES = """outcomes AS (SELECT p.pos, p.input, p.parcel, CASE WHEN p.parcel IS NULL THEN 'failed' WHEN g.parcel IS NOT NULL THEN 'cached' WHEN r.error IS NOT NULL THEN 'failed' ELSE 'succeeded' END AS status,
  CASE WHEN p.parcel IS NULL THEN 'INVALID_IDENTIFIER' WHEN g.parcel IS NOT NULL THEN NULL ELSE r.error END AS error FROM parsed p LEFT JOIN registered g ON g.parcel = p.parcel LEFT JOIN resolved r ON r.parcel = p.parcel)"""


def _joined(c: str) -> Column:
    return F.array_join(c, ",")


def _resolved(t: Tables, parcels: DataFrame | None = None) -> DataFrame:
    return resolve.resolve(t.lots if parcels is None else parcels, t.parcel_records, t.footprints, t.unit_map, t.billing_map)


def _outcomes(t: Tables) -> DataFrame:
    parsed = resolve.parse_inputs(t.inputs)
    cached, others = resolve.split_cached(resolve.distinct_parcels(parsed), t.registered)
    return resolve.outcomes(parsed, cached, _resolved(t, others))


@query("bulk_parse_and_dedupe", f", {_PARSED} SELECT DISTINCT parcel FROM parsed WHERE parcel IS NOT NULL")
def _(t: Tables) -> DataFrame:
    return resolve.distinct_parcels(resolve.parse_inputs(t.inputs))


@query("bulk_cached_split", f", {_PARSED} SELECT DISTINCT p.parcel, g.entity_id, g.parcel IS NOT NULL AS cached FROM parsed p LEFT JOIN registered g USING (parcel) WHERE p.parcel IS NOT NULL")
def _(t: Tables) -> DataFrame:
    cached, others = resolve.split_cached(resolve.distinct_parcels(resolve.parse_inputs(t.inputs)), t.registered)
    return cached.withColumn("cached", F.lit(True)).unionByName(others.withColumns({"entity_id": F.lit(None).cast("bigint"), "cached": F.lit(False)}))


@query("lookup_cardinality", "SELECT l.parcel, CASE count(u.base_parcel) WHEN 0 THEN 'zero' WHEN 1 THEN 'one' ELSE 'multiple' END AS match_count, CASE WHEN count(u.base_parcel) = 1 THEN min(u.base_parcel) END AS base_parcel FROM lots l LEFT JOIN unit_map u ON u.unit_parcel = l.parcel GROUP BY l.parcel")
def _(t: Tables) -> DataFrame:
    return resolve.cardinality(t.lots, t.unit_map.withColumnRenamed("unit_parcel", "parcel"), "parcel", "base_parcel")


@query("parcel_assessment", f", {_ASSESSED} SELECT parcel, borough, block, lot, address, array_to_string(reasons, ',') AS reasons FROM assessed")
def _(t: Tables) -> DataFrame:
    return resolve.assess_parcels(t.parcel_records).withColumn("reasons", _joined("reasons"))


@query("parcel_status", f", {_ASSESSED}, {_STATUS} SELECT parcel, parcel_status, address, reasons FROM statuses")
def _(t: Tables) -> DataFrame:
    return resolve.parcel_status(t.parcels, resolve.assess_parcels(t.parcel_records))


@query("footprint_candidates_both_keys", f", {_FOUND} SELECT * FROM found")
def _(t: Tables) -> DataFrame:
    return resolve.footprint_candidates(t.lots, t.footprints)


@query("footprint_validation", f", {_FOUND} SELECT parcel, building, base_parcel, map_parcel, has_map, {_verdict_sql('parcel')} AS verdict, {_verdict_sql('condo')} AS condo_verdict FROM found")
def _(t: Tables) -> DataFrame:
    return resolve.footprint_candidates(t.lots, t.footprints).withColumns({"verdict": resolve.footprint_verdict("parcel"), "condo_verdict": resolve.footprint_verdict("condo")})


@query("entity_effective_keys", f", {_FOUND}, {_VALID} SELECT parcel, buildings, footprint_error FROM valid")
def _(t: Tables) -> DataFrame:
    return resolve.validated_buildings(resolve.footprint_candidates(t.lots, t.footprints)).withColumn("buildings", _joined("buildings"))


@query("condo_chain", f", {_CHAIN} SELECT parcel, base_parcel, billing_parcel, condo_error FROM chain")
def _(t: Tables) -> DataFrame:
    return resolve.condo_chain(t.lots.where(ids.is_unit_lot(F.col("parcel"))), t.unit_map, t.billing_map)


@query("resolved_parcels", f", {_RESOLUTION} SELECT parcel, error, address, base_parcel, billing_parcel, buildings FROM resolved")
def _(t: Tables) -> DataFrame:
    return _resolved(t).withColumn("buildings", _joined("buildings"))


@query("bulk_outcomes", f", {_RESOLUTION}, {_OUTCOMES} SELECT pos, input, parcel, status, error FROM outcomes")
def _(t: Tables) -> DataFrame:
    return _outcomes(t)


@query("bulk_summary", f", {_RESOLUTION}, {_OUTCOMES} SELECT count(*) AS submitted, count(DISTINCT parcel) AS unique, count(*) FILTER (WHERE status = 'succeeded') AS succeeded, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'cached') AS cached FROM outcomes")
def _(t: Tables) -> DataFrame:
    return resolve.summary(_outcomes(t))


@query("bulk_failures_by_code", f", {_RESOLUTION}, {_OUTCOMES} SELECT error, count(*) AS n FROM outcomes WHERE status = 'failed' GROUP BY error")
def _(t: Tables) -> DataFrame:
    return resolve.failures_by_code(_outcomes(t))


_NARROW = """fit AS (SELECT * FROM candidates WHERE parcel IS NOT NULL AND coalesce(upper(trim(borough)) = nullif(upper(trim(split_part(address, ',', 2))), ''), split_part(address, ',', 2) = '')),
  marked AS (SELECT *, replace(upper(coalesce(name, split_part(label, ',', 1))) || '|', ' ST|', ' STREET|') = replace(upper(split_part(address, ',', 1)) || '|', ' ST|', ' STREET|') AS street FROM fit),
  by_street AS (SELECT * FROM (SELECT *, bool_or(street) OVER (PARTITION BY input_id) AS any_street FROM marked) AS m WHERE street OR NOT any_street),
  narrow AS (SELECT * FROM (SELECT *, bool_or(layer = 'address') OVER (PARTITION BY input_id) AS any_layer FROM by_street) AS m WHERE layer = 'address' OR NOT any_layer)"""
_RANK = "row_number() OVER (PARTITION BY input_id ORDER BY confidence DESC NULLS LAST, CASE WHEN confidence IS NOT NULL THEN label END, CASE WHEN confidence IS NOT NULL THEN source_id END, pos)"


@query("candidate_narrowing", f", {_NARROW} SELECT input_id, pos, layer, borough, parcel, source_id FROM narrow")
def _(t: Tables) -> DataFrame:
    return resolve.narrow_candidates(t.candidates).select("input_id", "pos", "layer", "borough", "parcel", "source_id")


@query("candidate_ranking", f", {_NARROW} SELECT i.input_id, CASE WHEN i.usable > 0 AND c.n = 1 THEN c.parcel END AS parcel, CASE WHEN i.usable = 0 THEN 'NO_IDENTIFIERS' WHEN coalesce(c.n, 2) > 1 THEN 'AMBIGUOUS' END AS error FROM (SELECT input_id, count(parcel) AS usable FROM candidates GROUP BY input_id) i LEFT JOIN (SELECT input_id, count(DISTINCT parcel) AS n, max(CASE WHEN rk = 1 THEN parcel END) AS parcel FROM (SELECT *, {_RANK} AS rk FROM narrow) AS r GROUP BY input_id) c USING (input_id)")
def _(t: Tables) -> DataFrame:
    return resolve.select_candidate(t.candidates).drop("building")


@query("candidate_ambiguity", "SELECT input_id, count(DISTINCT parcel) AS n_parcels FROM geo_candidates GROUP BY input_id HAVING count(DISTINCT parcel) > 1")
def _(t: Tables) -> DataFrame:
    ambiguous = resolve.select_candidate(t.geo_candidates).where("error = 'AMBIGUOUS'").select("input_id")
    return resolve.narrow_candidates(t.geo_candidates).join(ambiguous, "input_id").groupBy("input_id").agg(F.count_distinct("parcel").alias("n_parcels"))


_TOKEN = r"""CASE WHEN regexp_full_match(x, '[0-9]+(-[0-9]+)?') THEN x WHEN regexp_full_match(x, '[0-9]+([sS][tT]|[nN][dD]|[rR][dD]|[tT][hH])') THEN lower(x) WHEN regexp_full_match(x, '[0-9]+[A-Za-z]+') THEN upper(x) ELSE upper(substr(x, 1, 1)) || lower(substr(x, 2)) END"""
_FLAT = r"regexp_replace(trim(regexp_replace({}, '\s+', ' ', 'g')), '[–—]', '-', 'g')"
_BY_UNIT = """named AS (SELECT base_parcel, unit, count(*) AS n, min(unit_parcel) AS unit_parcel FROM unit_names WHERE trim(unit) <> '' GROUP BY base_parcel, unit)"""
_TO_BASE = """bills_to AS (SELECT billing_parcel, count(*) AS n, min(base_parcel) AS base_parcel FROM billing_map GROUP BY billing_parcel)"""
_LOT = "CAST(substr(parcel, 7, 4) AS INT)"


@query("condo_by_unit", f", {_BY_UNIT}, w AS (SELECT DISTINCT b.base_parcel, u.unit FROM unit_map b CROSS JOIN (VALUES ('12C'), ('3-A'), (' '), ('9')) AS u(unit)) SELECT w.base_parcel, w.unit, CASE WHEN n = 1 THEN unit_parcel END AS unit_parcel, CASE WHEN n IS NULL THEN 'CONDO_UNIT_NOT_FOUND' WHEN n > 1 THEN 'CONDO_UNIT_AMBIGUOUS' END AS unit_error FROM w LEFT JOIN named USING (base_parcel, unit)")
def _(t: Tables) -> DataFrame:
    names = F.explode(F.array(*map(F.lit, ("12C", "3-A", " ", "9")))).alias("unit")
    return resolve.unit_by_designation(t.unit_map.select("base_parcel").distinct().select("base_parcel", names), t.unit_names)


@query("billing_to_base", f", {_TO_BASE} SELECT parcel, CASE WHEN {_LOT} >= 7501 THEN CASE WHEN n = 1 THEN base_parcel END ELSE parcel END AS base_parcel, CASE WHEN {_LOT} < 7501 THEN NULL WHEN n IS NULL THEN 'CONDO_BASE_NOT_FOUND' WHEN n > 1 THEN 'CONDO_BASE_AMBIGUOUS' END AS base_error FROM (SELECT DISTINCT parcel FROM geo_candidates WHERE parcel IS NOT NULL) p LEFT JOIN bills_to ON billing_parcel = parcel")
def _(t: Tables) -> DataFrame:
    return resolve.condo_base(t.geo_candidates.where("parcel IS NOT NULL").select("parcel").distinct(), t.billing_map)


@query("corroboration", f", {_FOUND}, {_VALID} SELECT DISTINCT parcel, building, building IS NULL OR building LIKE '%000000' OR coalesce(buildings, '') = '' OR list_contains(string_split(buildings, ','), building) AS agrees FROM geo_candidates JOIN valid USING (parcel)")
def _(t: Tables) -> DataFrame:
    found = resolve.validated_buildings(resolve.footprint_candidates(t.lots, t.footprints)).withColumn("buildings", F.coalesce("buildings", F.array().cast("array<string>")))
    return t.geo_candidates.join(found, "parcel").select("parcel", "building", resolve.corroborated(F.col("building"), F.col("buildings")).alias("agrees")).distinct()


_IS_VALUE = "(length({0}) > 0 AND {0}[1] <> '-' AND translate(upper({0}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789-', '') = '')"
_HAS_CONTENT = "translate(upper({0}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789', '') <> upper({0})"
_ADDRESSES = f"""unit_words AS (SELECT * FROM (VALUES {", ".join(str(p) for p in text.UNIT_WORDS.items())}) AS u(word, written)),
  worded AS (SELECT id, flat, w, len(w) AS n, w[len(w)] AS last, w[len(w) - 1] AS before FROM (SELECT id, {_FLAT.format('address')} AS flat, string_split({_FLAT.format('address')}, ' ') AS w FROM addresses) AS f),
  ended AS (SELECT worded.*, written, CASE WHEN written IS NOT NULL AND {_IS_VALUE.format('last')} THEN 2 WHEN before = '#' AND n > 2 AND {_IS_VALUE.format('last')} THEN 2 WHEN n > 1 AND last[1] = '#' AND {_IS_VALUE.format('last[2:]')} THEN 1 ELSE 0 END AS taken
    FROM worded LEFT JOIN unit_words ON word = lower(CASE WHEN before[-1] = '.' THEN before[:-2] ELSE before END)),
  parted AS (SELECT id, flat, array_to_string(list_transform(w[1 : n - taken], lambda x: {_TOKEN}), ' ') AS base, CASE WHEN taken = 0 THEN NULL WHEN last[1] = '#' THEN upper(last[2:]) ELSE upper(last) END AS unit, CASE WHEN taken = 0 THEN NULL WHEN taken = 2 AND before <> '#' THEN written ELSE '#' END AS label FROM ended),
  addressed AS (SELECT id, unit, base, concat_ws(' ', base, label, unit) AS key, CASE WHEN flat = '' THEN 'ADDRESS_EMPTY' WHEN NOT ({_HAS_CONTENT.format('flat')}) THEN 'ADDRESS_NO_CONTENT' WHEN NOT ({_HAS_CONTENT.format('base')}) THEN 'ADDRESS_UNIT_ONLY' END AS input_error FROM parted)"""
_CHOSEN = """chosen AS (SELECT a.id, a.unit, a.input_error, CASE WHEN a.input_error IS NULL THEN a.key END AS key, k.entity_id, CASE WHEN g.n = 1 THEN g.parcel END AS parcel, CASE WHEN g.n = 1 THEN g.building END AS building, CASE WHEN g.id IS NULL THEN 'NO_CANDIDATES' WHEN g.n = 0 THEN 'NO_IDENTIFIERS' WHEN g.n > 1 THEN 'AMBIGUOUS' END AS geo_error
    FROM addressed a LEFT JOIN known_addresses k ON k.key = a.key AND a.input_error IS NULL LEFT JOIN (SELECT input_id AS id, count(DISTINCT parcel) AS n, max_by(parcel, pos) AS parcel, max_by(building, pos) AS building FROM geo_candidates GROUP BY input_id) g ON g.id = a.id)"""
_TARGETS = f"""based AS (SELECT c.*, CASE WHEN c.unit IS NOT NULL AND {_LOT.replace('parcel', 'c.parcel')} >= 7501 THEN CASE WHEN b.n IS NULL THEN 'CONDO_BASE_NOT_FOUND' WHEN b.n > 1 THEN 'CONDO_BASE_AMBIGUOUS' END END AS base_error, CASE WHEN {_LOT.replace('parcel', 'c.parcel')} >= 7501 THEN CASE WHEN b.n = 1 THEN b.base_parcel END ELSE c.parcel END AS base FROM chosen c LEFT JOIN bills_to b ON b.billing_parcel = c.parcel),
  targets AS (SELECT t.*, CASE WHEN t.unit IS NULL THEN t.parcel WHEN n.n = 1 THEN n.unit_parcel END AS target, coalesce(t.geo_error, t.base_error, CASE WHEN t.unit IS NULL THEN NULL WHEN n.n IS NULL THEN 'CONDO_UNIT_NOT_FOUND' WHEN n.n > 1 THEN 'CONDO_UNIT_AMBIGUOUS' END) AS early FROM based t LEFT JOIN named n ON n.base_parcel = t.base AND n.unit = t.unit)"""
_FINAL = """final AS (SELECT t.id AS input_id, t.key, t.entity_id, CASE WHEN t.entity_id IS NULL AND t.input_error IS NULL THEN t.target END AS parcel, r.base_parcel, r.billing_parcel, r.buildings,
    CASE WHEN t.input_error IS NOT NULL THEN t.input_error WHEN t.entity_id IS NOT NULL THEN NULL ELSE coalesce(t.early, CASE WHEN r.parcel IS NULL THEN 'PARCEL_NOT_FOUND' END, r.error, CASE WHEN NOT (t.building IS NULL OR t.building LIKE '%000000' OR r.buildings = '' OR list_contains(string_split(r.buildings, ','), t.building)) THEN 'BUILDING_CONFLICT' END) END AS error
    FROM targets t LEFT JOIN resolved r ON r.parcel = t.target AND t.early IS NULL AND t.entity_id IS NULL AND t.input_error IS NULL)"""


@query("address_resolution", f", {_RESOLUTION}, {_BY_UNIT}, {_TO_BASE}, {_ADDRESSES}, {_CHOSEN}, {_TARGETS}, {_FINAL} SELECT input_id, key, CASE WHEN error IS NOT NULL THEN 'failed' WHEN entity_id IS NOT NULL THEN 'cached' ELSE 'succeeded' END AS status, error, entity_id, parcel, base_parcel, billing_parcel, CASE WHEN error IS NULL THEN buildings END AS buildings FROM final")
def _(t: Tables) -> DataFrame:
    return _resolved_addresses(t).drop("address").withColumn("buildings", _joined("buildings"))


def _resolved_addresses(t: Tables) -> DataFrame:
    inputs = t.addresses.select(F.col("id").alias("input_id"), "address")
    return resolve.resolve_addresses(inputs, t.geo_candidates, t.known_addresses, t.parcel_records, t.footprints, t.unit_names, t.billing_map)


_REGISTERED = """good AS (SELECT key, parcel, buildings FROM final WHERE error IS NULL AND parcel IS NOT NULL),
  each AS (SELECT parcel, arg_min(buildings, key) AS buildings FROM good GROUP BY parcel),
  ents AS (SELECT CAST(entity_id AS STRING) AS entity_id, parcel, coalesce(e.buildings NOT IN ('', '1000001'), FALSE) AS changed, e.buildings, FALSE AS fresh FROM registered LEFT JOIN each e USING (parcel)
    UNION ALL SELECT substr(sha256(parcel), 1, 32), parcel, FALSE, buildings, TRUE FROM each WHERE parcel NOT IN (SELECT parcel FROM registered)),
  ins AS (SELECT key AS input, CAST(entity_id AS STRING) AS entity_id FROM known_addresses UNION ALL SELECT key, min(entity_id) FROM good JOIN ents USING (parcel) WHERE key NOT IN (SELECT key FROM known_addresses) GROUP BY key)"""


@query("address_registration", f", {_RESOLUTION}, {_BY_UNIT}, {_TO_BASE}, {_ADDRESSES}, {_CHOSEN}, {_TARGETS}, {_FINAL}, {_REGISTERED} SELECT e.entity_id, parcel, CAST(CASE WHEN changed THEN 2 ELSE 1 END AS INT) AS version, CASE WHEN fresh OR changed THEN e.buildings ELSE '1000001' END AS keys, CASE WHEN fresh OR changed THEN 'NOT_CHECKED' ELSE 'CHECKED' END AS status, CASE WHEN fresh AND e.buildings = '' THEN 'NO_VALID_BUILDING' WHEN fresh THEN 'NEVER_INGESTED' WHEN changed THEN 'IDENTIFIERS_CHANGED' END AS status_reason, i.inputs FROM ents e LEFT JOIN (SELECT entity_id, string_agg(input, '|' ORDER BY input) AS inputs FROM ins GROUP BY entity_id) i USING (entity_id)")
def _(t: Tables) -> DataFrame:
    known = t.registered.select(F.col("entity_id").cast("string").alias("entity_id"), "parcel")
    inputs = t.known_addresses.select(F.lit("ADDRESS").alias("input_type"), F.col("key").alias("input"), F.col("entity_id").cast("string").alias("entity_id"))
    coverage = known.select("entity_id", F.lit("CHECKED").alias("status"), *(F.lit(None).cast(k).alias(c) for c, k in (("status_reason", "string"), ("last_attempt_run_id", "string"), ("last_attempt_at", "timestamp"), ("last_error", "string"))))
    before = registration.Registry(known.withColumn("version", F.lit(1)), inputs, known.select("entity_id", F.lit("1000001").alias("scan_key")), coverage)
    now = registration.register(before, cut(_resolved_addresses(t)), "ADDRESS")
    sets = now.entity_keys.groupBy("entity_id").agg(F.array_join(F.array_sort(F.collect_list("scan_key")), ",").alias("keys"))
    named = now.inputs.groupBy("entity_id").agg(F.array_join(F.array_sort(F.collect_list("input")), "|").alias("inputs"))
    out = now.entities.select("entity_id", "parcel", "version").join(sets, "entity_id", "left").join(named, "entity_id", "left").join(now.coverage.select("entity_id", "status", "status_reason"), "entity_id")
    return out.withColumn("keys", F.coalesce("keys", F.lit("")))


_KEYS = "SELECT entity_id, string_agg(CAST(scan_key AS STRING), ',' ORDER BY CAST(scan_key AS STRING)) AS keys FROM (SELECT DISTINCT entity_id, scan_key FROM {}) AS d GROUP BY entity_id"


@query("key_set_changes", f"SELECT v.entity_id, CAST(v.version + CASE WHEN n.keys <> o.keys THEN 1 ELSE 0 END AS INT) AS version, CASE WHEN n.keys <> o.keys THEN n.keys ELSE o.keys END AS keys, coalesce(n.keys <> o.keys, FALSE) AS changed FROM versions v JOIN ({_KEYS.format('entity_keys')}) o USING (entity_id) LEFT JOIN ({_KEYS.format('snapshot')}) n USING (entity_id)")
def _(t: Tables) -> DataFrame:
    def sets(d: DataFrame) -> DataFrame:
        return d.groupBy("entity_id").agg(F.collect_set(F.col("scan_key").cast("string")).alias("keys"))

    changes = resolve.key_set_changes(t.versions.join(sets(t.entity_keys), "entity_id"), sets(t.snapshot))
    return changes.withColumn("keys", _joined("keys"))


@query("coverage_reset", f"""SELECT c.entity_id, CASE WHEN k.changed THEN 'NOT_CHECKED' ELSE c.status END AS status, CASE WHEN k.changed AND k.n > 0 THEN 'IDENTIFIERS_CHANGED' WHEN k.changed THEN 'NO_VALID_BUILDING' ELSE c.status_reason END AS status_reason, CASE WHEN NOT coalesce(k.changed, FALSE) THEN c.last_attempt_run_id END AS last_attempt_run_id, c.last_success_run_id,
  {", ".join(_ISO.format(c) for c in ("last_attempt_at", "last_success_at", "source_version_at"))}, CASE WHEN NOT coalesce(k.changed, FALSE) THEN c.last_error END AS last_error FROM (SELECT c.* REPLACE (CASE WHEN NOT coalesce(entity_id % 4 < 2, FALSE) THEN last_attempt_at END AS last_attempt_at) FROM coverage c) c LEFT JOIN (SELECT entity_id, entity_id % 4 < 2 AS changed, entity_id % 4 AS n FROM versions) k USING (entity_id)""")
def _(t: Tables) -> DataFrame:
    n = F.col("entity_id") % 4
    changes = t.versions.select("entity_id", (n < 2).alias("changed"), F.when(n == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("k"))).alias("keys"))
    known = changes.join(t.coverage.select("entity_id"), "entity_id", "left_semi")
    return _times(registration.reset_coverage(t.coverage, known))


@query("initial_coverage", f", {_FOUND}, {_VALID} SELECT parcel AS entity_id, 'NOT_CHECKED' AS status, CASE WHEN buildings <> '' THEN 'NEVER_INGESTED' ELSE 'NO_VALID_BUILDING' END AS status_reason FROM valid WHERE footprint_error IS NULL")
def _(t: Tables) -> DataFrame:
    found = resolve.validated_buildings(resolve.footprint_candidates(t.lots, t.footprints)).where("footprint_error IS NULL")
    return resolve.initial_coverage(found.withColumnRenamed("parcel", "entity_id"))


# functions --------------------------------------------------------------------------------------------------------------


@query("canonical_parcel_key", f", {_PARSED} SELECT pos, parcel FROM parsed")
def _(t: Tables) -> DataFrame:
    return t.inputs.select("pos", ids.canonical_parcel(F.col("input")).alias("parcel"))


@query("parcel_components", "SELECT parcel, CAST(substr(parcel, 1, 1) AS INT) AS borough, CAST(substr(parcel, 2, 5) AS INT) AS block, CAST(substr(parcel, 7, 4) AS INT) AS lot, CAST(substr(parcel, 7, 4) AS INT) BETWEEN 1001 AND 7500 AS is_unit, CAST(substr(parcel, 7, 4) AS INT) >= 7501 AS is_billing FROM parcels")
def _(t: Tables) -> DataFrame:
    p = F.col("parcel")
    return t.parcels.select("parcel", ids.borough(p).alias("borough"), ids.block(p).alias("block"), ids.lot(p).alias("lot"), ids.is_unit_lot(p).alias("is_unit"), ids.is_billing_lot(p).alias("is_billing"))


@query("placeholder_keys", "SELECT DISTINCT building, building LIKE '%000000' AS placeholder FROM footprints")
def _(t: Tables) -> DataFrame:
    return t.footprints.select("building", ids.is_placeholder(F.col("building")).alias("placeholder")).distinct()


@query("address_tokens", f"SELECT id, array_to_string(list_transform(string_split({_FLAT.format('address')}, ' '), lambda x: {_TOKEN}), ' ') AS address FROM addresses")
def _(t: Tables) -> DataFrame:
    return t.addresses.select("id", text.recased_address(F.col("address")).alias("address"))


@query("address_units", f", {_ADDRESSES} SELECT id, CASE WHEN input_error IS NULL THEN base END AS base, CASE WHEN input_error IS NULL THEN unit END AS unit, CASE WHEN input_error IS NULL THEN key END AS key, input_error AS error FROM addressed")
def _(t: Tables) -> DataFrame:
    return resolve.parse_addresses(t.addresses.withColumnRenamed("id", "input_id")).withColumnsRenamed({"input_id": "id", "input_error": "error"})


_ALIAS = "CASE x " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in text.STREET_WORDS.items()) + " ELSE x END"


_PLAIN = "array_to_string(list_transform(string_split(upper({0}), ''), lambda c: CASE WHEN contains('{1}', c) THEN c ELSE ' ' END), '')"
_STREET = _PLAIN.format("address", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789-")
_CARDINAL = f"CASE WHEN right(p, 2) IN {text.ORDINALS} AND TRY_CAST(left(p, -2) AS HUGEINT) IS NOT NULL THEN left(p, -2) ELSE p END"


@query("street_evidence", f"""SELECT id, array_to_string(list_transform(list_transform(list_filter(string_split({_STREET}, ' '), lambda x: x <> ''), lambda x: array_to_string(list_transform(string_split(x, '-'), lambda p: {_CARDINAL}), '-')), lambda x: {_ALIAS}), ' ') AS street,
  list_filter(list_transform(string_split(address, ',')[2:], lambda x: trim({_PLAIN.format("x", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")})), lambda x: x IN {text.BOROUGHS})[1] AS borough FROM addresses""")
def _(t: Tables) -> DataFrame:
    return t.addresses.select("id", text.street_evidence(F.col("address")).alias("street"), text.requested_borough(F.col("address")).alias("borough"))


#: A moment worked out from a text: its day's three numbers, then its clock and zone.
_MOMENTS = r"""split AS (SELECT id, text, trim(text) AS x FROM dated_texts),
  days AS (SELECT *, CASE WHEN contains(x, 'T') AND length(x) >= 20 THEN string_split(x[1:10], '-') WHEN contains(x, '-') THEN string_split(x, '-') WHEN contains(x, '/') THEN [x[7:10], x[1:2], x[4:5]] WHEN length(x) = 8 THEN [x[1:4], x[5:6], x[7:8]] END AS n, CASE WHEN contains(x, 'T') THEN string_split(x, 'T')[2] END AS clock FROM split),
  moments AS (SELECT id, text, x, CASE WHEN len(n) = 3 AND TRY_CAST(n[1] AS INT) >= 100 THEN CAST(TRY_CAST(n[1] || '-' || n[2] || '-' || n[3] AS DATE) AS TIMESTAMP) END
    + to_seconds(coalesce(CAST(clock[1:2] AS INT) * 3600 + CAST(clock[4:5] AS INT) * 60 + CAST(clock[7:8] AS INT), 0) - CASE WHEN clock IS NULL OR clock[-1] = 'Z' THEN 0 ELSE CASE clock[-6] WHEN '-' THEN -60 ELSE 60 END * (CAST(clock[-5:-4] AS INT) * 60 + CAST(clock[-2:] AS INT)) END)
    + to_milliseconds(CASE WHEN clock[9] = '.' THEN CAST(clock[10:12] AS INT) ELSE 0 END) AS moment FROM days)"""


@query("issue_date_parse", f", {_MOMENTS} SELECT id, CASE WHEN text <> '0' THEN CAST(CAST(moment AS DATE) AS STRING) END AS issue_date, CASE WHEN moment IS NULL AND x <> '' AND text <> '0' THEN 'INVALID_DATE' END AS error FROM moments")
def _(t: Tables) -> DataFrame:
    return t.dated_texts.select("id", parsing.parse_issue_date(F.col("text")).alias("p")).select("id", day("p.value").alias("issue_date"), "p.error")


@query("source_timestamp_parse", f", {_MOMENTS} SELECT id, strftime(moment, '%Y-%m-%dT%H:%M:%S.%gZ') AS updated_at, CASE WHEN moment IS NULL AND x <> '' THEN 'INVALID_DATE' WHEN moment IS NULL THEN 'MISSING_TIMESTAMP' END AS error FROM moments")
def _(t: Tables) -> DataFrame:
    parsed = t.dated_texts.select("id", parsing.parse_source_time(F.col("text")).alias("p"))
    utc = F.date_format(F.to_utc_timestamp("p.value", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return parsed.select("id", F.when(F.current_timezone() == "UTC", parsing.iso_millis(F.col("p.value"))).otherwise(utc).alias("updated_at"), "p.error")


_SECONDS = "CASE o_orderkey % 5 WHEN 0 THEN CAST(1700000000 + o_orderkey * 37 AS STRING) WHEN 1 THEN ' ' || CAST(o_orderkey AS STRING) || ' ' WHEN 2 THEN '-1' WHEN 3 THEN CAST(o_orderkey AS STRING) || '.5' END"


@query("source_versions", f"SELECT id, strftime(epoch_ms(1000 * n), '%Y-%m-%dT%H:%M:%S.%gZ') AS version_at, CASE WHEN n IS NULL THEN 'INVALID_VERSION' END AS error FROM (SELECT id, CASE WHEN trim(x) ~ '^[0-9]+$' THEN CAST(trim(x) AS BIGINT) END AS n FROM (SELECT o_orderkey AS id, {_SECONDS} AS x FROM orders) AS v) AS w")
def _(t: Tables) -> DataFrame:
    found = t.orders.select(F.col("o_orderkey").alias("id"), parsing.timestamp_seconds(F.expr(_SECONDS)).alias("p"))
    return found.select("id", parsing.iso_millis(F.col("p.value")).alias("version_at"), "p.error")


@query("submitted_requests", """SELECT id, CASE WHEN trim(a) <> '' AND trim(p) <> '' THEN 'ADDRESS_AND_PARCEL' WHEN coalesce(trim(a), '') = '' AND coalesce(trim(p), '') = '' THEN 'NOTHING_SUBMITTED' END AS error,
  CASE WHEN id % 7 = 0 THEN 'NO_INPUTS' WHEN id % 7 = 1 THEN 'INVALID_INPUT' WHEN id % 50 = 2 THEN 'TOO_MANY_INPUTS' END AS bulk_error,
  CASE WHEN id % 4 IN (0, 1) THEN 'INVALID_ENTITY_ID' END AS ids_error FROM (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN p_name WHEN p_partkey % 3 = 1 THEN '  ' END AS a, CASE WHEN p_partkey % 5 < 3 THEN p_brand END AS p FROM part) AS r""")
def _(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    address, parcel = F.when(k % 3 == 0, F.col("p_name")).when(k % 3 == 1, "  "), F.when(k % 5 < 3, F.col("p_brand"))
    one = F.lit("x")
    inputs = F.when(k % 7 == 1, F.array(one, F.lit(None))).when(k % 7 != 0, F.array_repeat(one, F.when(k % 50 == 2, 10_001).otherwise(k % 30 + 1).cast("int")))
    digits = F.substr(F.md5(k.cast("string")), F.lit(1), F.lit(32))
    part = lambda a, n: F.substr(digits, F.lit(a), F.lit(n))
    uuid = F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("4"), part(14, 3)), F.concat(F.lit("a"), part(18, 3)), part(21, 12))
    ids_ = F.array(uuid, F.when(k % 4 == 0, F.replace(uuid, F.lit("-"))).when(k % 4 == 1, F.lit(None)).otherwise(F.upper(uuid)))
    return t.part.select(k.alias("id"), requests.submission_error(address, parcel).alias("error"), requests.bulk_error(inputs).alias("bulk_error"), requests.entity_ids_error(ids_).alias("ids_error"))


@query("balance_parse", r"SELECT id, CAST(CASE WHEN regexp_full_match(x, '[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)') THEN TRY_CAST(x AS DECIMAL(15,2)) END AS STRING) AS balance, CASE WHEN x = '' THEN NULL WHEN NOT regexp_full_match(x, '[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)') THEN 'INVALID_NUMBER' WHEN TRY_CAST(x AS DECIMAL(15,2)) IS NULL THEN 'NUMBER_OVERFLOW' END AS error FROM (SELECT id, replace(trim(text), ',', '') AS x FROM amount_texts) AS a")
def _(t: Tables) -> DataFrame:
    return t.amount_texts.select("id", parsing.parse_amount(F.col("text")).alias("p")).select("id", F.col("p.value").cast("string").alias("balance"), "p.error")


_BIN_KEY = "(SELECT id, payload, CASE WHEN list_contains(json_keys(payload), 'bin') THEN 'bin' ELSE list_filter(json_keys(payload), lambda k: lower(k) = 'bin')[1] END AS k FROM json_rows) AS j"


@query("json_fields_case_insensitive", f"SELECT id, json_extract_string(payload, '$.' || k) AS bin, nullif(trim(json_extract_string(payload, '$.' || k)), '') AS bin_text FROM {_BIN_KEY}")
def _(t: Tables) -> DataFrame:
    m = jf.fields(F.col("payload"))
    return t.json_rows.select("id", jf.field(m, "bin").alias("bin"), jf.required_text(m, "bin").alias("bin_text"))


@query("json_key_presence", f"SELECT id, CASE WHEN k IS NULL THEN 'absent' WHEN json_type(payload, '$.' || k) = 'NULL' THEN 'null' ELSE 'value' END AS bin_state, k IS NOT NULL AS has_bin FROM {_BIN_KEY}")
def _(t: Tables) -> DataFrame:
    m = jf.fields(F.col("payload"))
    return t.json_rows.select("id", jf.state(m, "bin").alias("bin_state"), jf.has_field(m, "bin").alias("has_bin"))


@query("json_text_or_number", f"SELECT id, coalesce(json_type(payload, '$.' || k) = 'VARCHAR', FALSE) AS is_text FROM {_BIN_KEY}")
def _(t: Tables) -> DataFrame:
    return t.json_rows.select("id", jf.is_text(F.col("payload"), "bin").alias("is_text"))


_STRICT = "regexp_full_match({0}, '[0-9]{{{1}}}')"


@query("canonical_building_key", rf"SELECT building, CASE WHEN regexp_full_match(regexp_replace(building, '\s+', '', 'g'), '[0-9]{{7}}') THEN regexp_replace(building, '\s+', '', 'g') END AS canonical FROM (SELECT DISTINCT CASE WHEN building LIKE '%3' THEN substr(building, 1, 3) || ' ' || substr(building, 4) WHEN building LIKE '%5' THEN building || '0' ELSE building END AS building FROM footprints) AS b")
def _(t: Tables) -> DataFrame:
    b = F.col("building")
    odd = F.when(b.endswith("3"), F.concat(F.substr(b, F.lit(1), F.lit(3)), F.lit(" "), F.substr(b, F.lit(4)))).when(b.endswith("5"), F.concat(b, F.lit("0"))).otherwise(b)
    return t.footprints.select(odd.alias("building")).distinct().select("building", ids.canonical_building(b).alias("canonical"))


@query("strict_source_identifier", f"SELECT DISTINCT bbl, CASE WHEN {_STRICT.format("split_part(trim(bbl), '.', 1)", 10)} THEN split_part(trim(bbl), '.', 1) END AS parcel, CASE WHEN {_STRICT.format("split_part(trim(block), '.', 1)", 7)} THEN split_part(trim(block), '.', 1) END AS building FROM parcel_records")
def _(t: Tables) -> DataFrame:
    strict = ids.strict_identifier
    return t.parcel_records.select("bbl", strict(F.col("bbl"), ids.PARCEL_DIGITS).alias("parcel"), strict(F.col("block"), ids.BUILDING_DIGITS).alias("building")).distinct()


@query("typed_source_parcel", r"""SELECT id, CASE WHEN v ~ '^[0-9]{10}$' THEN v END AS parcel, CASE WHEN coalesce(v ~ '^[0-9]{10}$', FALSE) THEN NULL ELSE 'MALFORMED_PARCEL' END AS error
FROM (SELECT id, CASE WHEN kind = 'VARCHAR' THEN regexp_replace(x, '\s+', '', 'g') WHEN kind IN ('DOUBLE', 'BIGINT', 'UBIGINT') AND n >= 0 AND n < 10000000000 THEN lpad(CAST(n AS STRING), 10, '0') END AS v
  FROM (SELECT id, x, kind, CASE WHEN kind IN ('DOUBLE', 'BIGINT', 'UBIGINT') THEN CAST(trunc(CAST(x AS DECIMAL(30,6))) AS BIGINT) END AS n FROM (SELECT id, json_type(payload, '$.bbl') AS kind, json_extract_string(payload, '$.bbl') AS x FROM typed_rows) AS j) AS i) AS p""")
def _(t: Tables) -> DataFrame:
    typed = ids.typed_parcel(jf.field(jf.fields(F.col("payload")), "bbl"), jf.is_number(F.col("payload"), "bbl"))
    return t.typed_rows.select("id", typed.alias("p")).select("id", F.col("p.value").alias("parcel"), "p.error")


@query("count_parse", "SELECT id, CASE WHEN regexp_full_match(x, '[0-9]+') THEN CAST(x AS BIGINT) END AS n, CASE WHEN NOT regexp_full_match(x, '[0-9]+') THEN 'INVALID_COUNT' END AS error FROM (SELECT id, json_extract_string(payload, '$.count') AS x FROM typed_rows) AS c")
def _(t: Tables) -> DataFrame:
    return t.typed_rows.select("id", parsing.parse_count(jf.field(jf.fields(F.col("payload")), "count")).alias("p")).select("id", F.col("p.value").alias("n"), "p.error")


_EACH_FEATURE = "(SELECT input_id, address, unnest(json_extract(reply, '$.features[*]')) AS f, generate_subscripts(json_extract(reply, '$.features[*]'), 1) - 1 AS pos FROM replies) AS e"
_PROP = "nullif(trim(json_extract_string(f, '$.properties.{}')), '')"


@query("geocoder_candidates", f"""SELECT input_id, address, CAST(pos AS INT) AS pos, {_PROP.format('label')} AS label, {_PROP.format('name')} AS name, {_PROP.format('layer')} AS layer, {_PROP.format('borough')} AS borough, TRY_CAST({_PROP.format('confidence')} AS DOUBLE) AS confidence, coalesce({_PROP.format('pad_bbl')}, {_PROP.format('addendum.pad.bbl')}) AS parcel,
  CASE WHEN length({_PROP.format('addendum.pad.bin')}) = 7 THEN {_PROP.format('addendum.pad.bin')} END AS building, CAST(json_extract(f, '$.geometry.coordinates[0]') AS DOUBLE) AS x, {_PROP.format('id')} AS source_id FROM {_EACH_FEATURE} WHERE {_PROP.format('label')} IS NOT NULL""")
def _(t: Tables) -> DataFrame:
    return geocoder.candidates(t.replies).withColumn("x", F.get("coordinates", F.lit(0))).drop("coordinates")


@query("geocoder_status", "SELECT input_id, CASE WHEN json_array_length(reply, '$.features') > 0 THEN 'FOUND' ELSE 'NO_CANDIDATES' END AS status FROM replies")
def _(t: Tables) -> DataFrame:
    return geocoder.reply_status(t.replies)


@query("landing_parsed", """SELECT id, source_id, row_id, scan_key, status, issue_date, balance_due, updated_at, CASE WHEN payload = 'no object' THEN 'NOT_AN_OBJECT' WHEN source_id IS NULL THEN 'MISSING_SOURCE_ID' WHEN row_id IS NULL THEN 'MISSING_ROW_ID' WHEN scan_key IS NULL THEN 'INVALID_KEY' WHEN bad_date THEN 'ISSUED:INVALID_DATE' WHEN balance_due IS NULL THEN 'BALANCE:INVALID_NUMBER' END AS error
  FROM (SELECT id, payload, nullif(trim(payload ->> 'isn_dob_bis_extract'), '') AS source_id, payload ->> ':id' AS row_id, CASE WHEN regexp_full_match(trim(payload ->> 'BIN'), '[0-9]{7}') THEN trim(payload ->> 'BIN') END AS scan_key, trim(payload ->> 'ecb_violation_status') AS status, json_type(payload, '$.issue_date') = 'UBIGINT' OR payload ->> 'issue_date' = '20261350' AS bad_date,
    CAST(TRY_CAST(TRY_STRPTIME(payload ->> 'issue_date', '%Y%m%d') AS DATE) AS STRING) AS issue_date, CAST(TRY_CAST(payload ->> 'balance_due' AS DECIMAL(15,2)) AS STRING) AS balance_due, payload ->> ':updated_at' AS updated_at FROM (SELECT id, CASE WHEN payload = 'no object' THEN '{}' ELSE payload END AS payload, payload = 'no object' AS none FROM landed_rows) AS r) AS p""".replace("CASE WHEN payload = 'no object' THEN 'NOT_AN_OBJECT'", "CASE WHEN payload = '{}' THEN 'NOT_AN_OBJECT'"))
def _(t: Tables) -> DataFrame:
    rows = landing.parsed(t.landed_rows, "id")
    return rows.select("id", "source_id", "row_id", "scan_key", "status", day("issue_date").alias("issue_date"), F.col("balance_due").cast("string").alias("balance_due"), parsing.iso_millis(F.col("updated_at")).alias("updated_at"), "error")


# registration and seeds -------------------------------------------------------------------------------------------------


@query("new_entities", f", {_RESOLUTION} SELECT parcel, CAST(1 AS INT) AS version, address, base_parcel, billing_parcel, CAST(substr(parcel, 1, 1) AS INT) AS borough, CAST(substr(parcel, 2, 5) AS INT) AS block, CAST(substr(parcel, 7, 4) AS INT) AS lot, substr(sha256(parcel), 1, 32) AS entity_id FROM resolved WHERE error IS NULL AND parcel NOT IN (SELECT parcel FROM registered)")
def _(t: Tables) -> DataFrame:
    return registration.new_entities(t.registered, _resolved(t))


@query("new_resolution_inputs", "SELECT DISTINCT 'PARCEL' AS input_type, parcel AS input, sha256(parcel) AS entity_id FROM lots WHERE parcel NOT IN (SELECT parcel FROM registered)")
def _(t: Tables) -> DataFrame:
    as_inputs = lambda d: d.select(F.lit("PARCEL").alias("input_type"), F.col("parcel").alias("input"), F.sha2("parcel", 256).alias("entity_id"))
    return registration.new_inputs(as_inputs(t.registered), as_inputs(t.lots.unionByName(t.lots)))


@query("seed_selection", "SELECT DISTINCT lpad(split_part(trim(bbl), '.', 1), 10, '0') AS parcel FROM parcel_records WHERE bbl IS NOT NULL AND borocode IS NOT NULL AND address IS NOT NULL AND CAST(block AS INT) % 5 IN (0, 1) ORDER BY parcel LIMIT 10000")
def _(t: Tables) -> DataFrame:
    return registration.select_seed(t.parcel_records.withColumn("district", F.col("block").cast("int") % 5), [0, 1], 10_000)


@query("log_json_lines", "SELECT payload AS value, count(*) AS n FROM json_rows WHERE id % 3 <> 0 GROUP BY payload")
def _(t: Tables) -> DataFrame:
    noisy = F.when(F.col("id") % 3 == 0, F.concat(F.lit("worker: "), F.col("payload"))).otherwise(F.concat(F.lit("  "), F.col("payload")))
    return geocoder.json_lines(t.json_rows.select(noisy.alias("value"))).groupBy("value").agg(F.count("*").alias("n"))
