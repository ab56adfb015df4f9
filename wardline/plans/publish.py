"""Publication of a run: live state, retirement of what disappeared, and coverage."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.operators.merge import first_wins, merged

COVERAGE = "entity_id int, status string, status_reason string, last_attempt_run_id string, last_success_run_id string, last_attempt_at timestamp, last_success_at timestamp, source_version_at timestamp, last_error string"
NOT_PROMOTED, SOURCE_CHANGED = "RUN_NOT_PROMOTED", "SOURCE_CHANGED"


def rules() -> dict[str, dict[str, Column]]:
    """What must hold for the rows of what a run publishes."""
    has = lambda c: F.col(c).isNotNull()
    failed, checked = F.col("status") == "FAILED", F.col("status") == "CHECKED"
    return {
        "live": {"has_source_id": has("source_id"), "has_key": has("scan_key"), "is_current_or_not": has("is_current")},
        "raw": {"has_source_id": has("source_id"), "has_version": has("updated_text"), "has_payload": has("payload")},
        "coverage": {"known_status": F.col("status").isin("CHECKED", "NOT_CHECKED", "FAILED"), "failures_have_a_cause": ~failed | has("last_error"), "checked_means_a_success": ~checked | (has("last_success_run_id") & has("last_success_at"))},
    }


@dataclass(frozen=True)
class Run:
    run_id: str
    started_at: dt.datetime
    finished_at: dt.datetime
    version_at: dt.datetime | None = None


def promote(live: DataFrame, staged: DataFrame, run_id: str, at: dt.datetime | Column | None = None, *, null_keys: bool = True) -> DataFrame:
    """live with the run's rows in it, current and stamped with the run; other rows as they were. With a time, rows are stamped
    with it too, and new ones get an id and the time of their making, which stay. null_keys: as of ``merge.merged``."""
    rows = staged.select(*(c for c in live.columns if c in staged.columns and c not in ("is_current", "last_run_id"))).withColumns({"is_current": F.lit(True), "last_run_id": F.lit(run_id)})
    if at is None:
        return merged(live, rows, ["source_id"], null_keys=null_keys)
    now = F.lit(at).cast("timestamp")
    return merged(live, rows.withColumn("modified_at", now), ["source_id"], insert={"id": F.md5(F.col("new.source_id")), "created_at": now}, null_keys=null_keys)


def reconcile(live: DataFrame, scope: DataFrame, run_id: str) -> DataFrame:
    """Retires current rows under scanned keys that the run did not stamp. The stamp spares an anti join."""
    scanned = scope.select("scan_key").distinct().withColumn("__scanned", F.lit(True))
    gone = F.col("__scanned") & F.col("is_current") & ~F.col("last_run_id").eqNullSafe(F.lit(run_id))
    joined = live.join(scanned, "scan_key", "left")
    return joined.withColumn("is_current", F.when(gone, F.lit(False)).otherwise(F.col("is_current"))).select(*live.columns)


def version_stats(snapshot: DataFrame, versions: DataFrame) -> DataFrame:
    """For each entity: its snapshot rows, their least version and number of versions, and the version it has now."""
    own = snapshot.groupBy("entity_id").agg(F.min("version").alias("least_version"), F.count("*").alias("n_rows"), F.count_distinct("version").alias("n_versions"))
    return own.join(versions.select("entity_id", F.col("version").alias("current_version")), "entity_id")


def version_conflicts(snapshot: DataFrame) -> DataFrame:
    return snapshot.groupBy("entity_id").agg(F.count_distinct("version").alias("n_versions")).where("n_versions > 1")


def still_current(snapshot: DataFrame, versions: DataFrame) -> DataFrame:
    """Entities whose keys are still those of the snapshot."""
    return snapshot.join(versions, ["entity_id", "version"]).select("entity_id").distinct()


def changed_since(snapshot: DataFrame, versions: DataFrame) -> DataFrame:
    now = versions.select("entity_id", F.col("version").alias("now"))
    return snapshot.join(now, "entity_id").where(F.col("version") != F.col("now")).select("entity_id").distinct()


def published_by_newer(coverage: DataFrame, runs: DataFrame, started_at: dt.datetime | Column) -> DataFrame:
    """Entities whose coverage a later run has written, be it an attempt or a success. Runs are ordered by their start,
    never by id. Two joins on equality, not one on OR."""
    start = lambda c: runs.select(F.col("run_id").alias(f"last_{c}_run_id"), F.col("started_at").alias(f"__{c}"))
    both = coverage.join(start("attempt"), "last_attempt_run_id", "left").join(start("success"), "last_success_run_id", "left")
    return both.where(F.greatest("__attempt", "__success") > F.lit(started_at)).select("entity_id")


def success_changes(snapshot: DataFrame, versions: DataFrame, coverage: DataFrame, runs: DataFrame, run: Run) -> DataFrame:
    eligible = still_current(snapshot, versions).join(published_by_newer(coverage, runs, run.started_at), "entity_id", "left_anti")
    at, null = F.lit(run.finished_at).cast("timestamp"), F.lit(None).cast("string")
    return eligible.select("entity_id", F.lit("CHECKED").alias("status"), null.alias("status_reason"), F.lit(run.run_id).alias("last_attempt_run_id"), F.lit(run.run_id).alias("last_success_run_id"), at.alias("last_attempt_at"), at.alias("last_success_at"), F.lit(run.version_at).cast("timestamp").alias("source_version_at"), null.alias("last_error"))


def stale_changes(snapshot: DataFrame, versions: DataFrame, coverage: DataFrame, runs: DataFrame, run: Run) -> DataFrame:
    """Touches status and reason alone: what was learned before stays."""
    stale = changed_since(snapshot, versions).join(published_by_newer(coverage, runs, run.started_at), "entity_id", "left_anti")
    return stale.select("entity_id", F.lit("NOT_CHECKED").alias("status"), F.lit("IDENTIFIERS_CHANGED_AFTER_SNAPSHOT").alias("status_reason"))


def failed_keys(batches: DataFrame) -> DataFrame:
    """(scan_key, batch_number, last_error) of failed batches with an error; what is no list of keys has none."""
    bad = batches.where((F.col("status") == "FAILED") & (F.length(F.trim("last_error")) > 0))
    keys = F.from_json(F.get_json_object("definition", "$.keys"), "array<string>")
    return bad.select(F.explode(keys).alias("scan_key"), "batch_number", "last_error")


def first_failures(snapshot: DataFrame, batches: DataFrame) -> DataFrame:
    """Each entity's error in its earliest failed batch."""
    hit = snapshot.join(failed_keys(batches), "scan_key")
    return first_wins(hit, ["entity_id"], ["batch_number", "last_error"]).select("entity_id", "last_error")


def failure_changes(snapshot: DataFrame, versions: DataFrame, batches: DataFrame, run: Run, *, source_changed: bool = False) -> DataFrame:
    """Attempt-side columns alone; an entity none of whose keys failed was not promoted."""
    eligible = first_wins(snapshot, ["entity_id"], ["scan_key"]).join(versions, ["entity_id", "version"]).select("entity_id")
    if source_changed:
        error = F.lit(SOURCE_CHANGED)
    else:
        eligible, error = eligible.join(first_failures(snapshot, batches), "entity_id", "left"), F.coalesce("last_error", F.lit(NOT_PROMOTED))
    return eligible.select("entity_id", F.lit("FAILED").alias("status"), F.lit(None).cast("string").alias("status_reason"), F.lit(run.run_id).alias("last_attempt_run_id"), F.lit(run.finished_at).cast("timestamp").alias("last_attempt_at"), error.alias("last_error"))


def merge_coverage(coverage: DataFrame, changes: DataFrame) -> DataFrame:
    return merged(coverage, changes, ["entity_id"])


def gate(run: dict, counts: dict, batches: DataFrame, cover: DataFrame) -> list[str]:
    """Why a run may not be accepted; empty if it may. run and counts are its control rows; two one-row plans are read."""
    states = batches.agg(F.count("*").alias("n"), F.count_if((F.col("status") != "COMPLETED") | F.col("last_error").isNotNull()).alias("open")).collect()[0]
    checks = {
        "NOT_RUNNING": run["status"] == "RUNNING",
        "NOT_INITIALISED": bool(run["initialised"]),
        "NOT_STARTED": run["started_at"] is not None,
        "SOURCE_CHANGED": run["start_version"] is not None and run["start_version"] == run["end_version"],
        "COUNTS_DIFFER": all(run[f"expected_{k}"] == counts[k] for k in ("pairs", "keys", "batches")) and states.n == counts["batches"],
        "BATCHES_OPEN": states.open == 0,
        "NO_EXACT_COVER": bool(cover.collect()[0].exact),
    }
    return [why for why, ok in checks.items() if not ok]
