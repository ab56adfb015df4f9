"""Registration of resolved parcels as entities: each write is the next version of its table, as a plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions import identifiers as ids
from wardline.operators.merge import first_wins, insert_if_absent, merged
from wardline.operators.resolve import initial_coverage, key_set_changes


def entity_id(parcel: Column) -> Column:
    """The same for a parcel in every run, so that replays find it."""
    return F.sha2(parcel, 256).substr(1, 32)


def new_entities(entities: DataFrame, resolved: DataFrame) -> DataFrame:
    """Rows to append for resolved parcels that have no entity; existing entities are never touched."""
    rows = resolved.where(F.col("error").isNull()).select(
        entity_id(F.col("parcel")).alias("entity_id"), F.lit(1).alias("version"), "parcel", "base_parcel", "billing_parcel", "address",
        ids.borough(F.col("parcel")).alias("borough"), ids.block(F.col("parcel")).alias("block"), ids.lot(F.col("parcel")).alias("lot"),
    )
    return insert_if_absent(entities, rows, ["parcel"], ["entity_id"])


def new_inputs(inputs: DataFrame, submitted: DataFrame) -> DataFrame:
    """(input_type, input, entity_id) rows to append: the first registration of an input stays."""
    return insert_if_absent(inputs, submitted, ["input_type", "input"], ["entity_id"])


def next_key_sets(entities: DataFrame, entity_keys: DataFrame, resolved: DataFrame) -> DataFrame:
    """(entity_id, version, keys, changed) after a resolution. An empty resolution never clears a set."""
    old = entity_keys.groupBy("entity_id").agg(F.collect_set("scan_key").alias("keys"))
    now = entities.select("entity_id", "version").join(old, "entity_id", "left").withColumn("keys", F.coalesce("keys", F.array().cast("array<string>")))
    new = resolved.where(F.col("error").isNull()).select(entity_id(F.col("parcel")).alias("entity_id"), F.col("buildings").alias("keys"))
    return key_set_changes(now, new)


def apply_key_sets(entities: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The next entities and entity_keys."""
    versions = changes.select("entity_id", "version")
    return merged(entities, versions, ["entity_id"]), changes.select("entity_id", F.explode("keys").alias("scan_key"))


def reset_coverage(coverage: DataFrame, changes: DataFrame) -> DataFrame:
    """Entities whose set changed are to be checked anew: attempt columns are emptied, success columns stay."""
    changed = changes.where("changed")
    reason = F.when(F.size("keys") > 0, F.lit("IDENTIFIERS_CHANGED")).otherwise(F.lit("NO_VALID_BUILDING"))
    empty = F.lit(None)
    rows = changed.select("entity_id", F.lit("NOT_CHECKED").alias("status"), reason.alias("status_reason"), empty.cast("string").alias("last_attempt_run_id"), empty.cast("timestamp").alias("last_attempt_at"), empty.cast("string").alias("last_error"))
    return merged(coverage, rows, ["entity_id"])


@dataclass(frozen=True)
class Registry:
    """What is known of entities: (entity_id, version, parcel, ...), (input_type, input, entity_id), (entity_id, scan_key) and coverage."""

    entities: DataFrame
    inputs: DataFrame
    entity_keys: DataFrame
    coverage: DataFrame


def register(registry: Registry, resolved: DataFrame, input_type: str) -> Registry:
    """The next version of all four tables after a resolution of inputs (``resolve_addresses`` and its like, with ``key`` as the
    input). What resolved without error becomes an entity unless its parcel has one, and its input that entity's, so that
    the next resolution finds it cached. A new entity gets its keys and initial coverage; one that was there gets its keys
    and coverage changed if its key set has. Inputs that failed leave nothing behind. resolved is read several times: let it be
    a written table or a checkpoint."""
    good = resolved.where(F.col("error").isNull() & F.col("parcel").isNotNull())
    each = first_wins(good, ["parcel"], ["key"])  # one row for each parcel: those of its other inputs agree but for the input
    fresh = new_entities(registry.entities, each)
    own = lambda d: d.join(registry.entities.select("parcel", F.col("entity_id").alias("known_id")), "parcel", "left").withColumn("entity_id", F.coalesce("known_id", entity_id(F.col("parcel")).cast(registry.entities.schema["entity_id"].dataType)))
    submitted = own(good.select("parcel", F.col("key").alias("input"))).select(F.lit(input_type).alias("input_type"), "input", "entity_id")
    found = own(each.select("parcel", F.col("buildings").alias("keys")))
    old = registry.entity_keys.groupBy("entity_id").agg(F.collect_set("scan_key").alias("keys"))
    now = registry.entities.select("entity_id", "version").join(old, "entity_id", "left").withColumn("keys", F.coalesce("keys", F.array().cast(found.schema["keys"].dataType)))
    changes = key_set_changes(now, found.where("known_id IS NOT NULL").select("entity_id", "keys"))
    entities = merged(registry.entities, changes.select("entity_id", "version"), ["entity_id"]).unionByName(fresh, allowMissingColumns=True)
    added = found.where("known_id IS NULL").select("entity_id", F.col("keys").alias("buildings"))
    keys = changes.select("entity_id", F.explode("keys").alias("scan_key")).unionByName(added.select("entity_id", F.explode("buildings").alias("scan_key")))
    coverage = reset_coverage(registry.coverage, changes).unionByName(initial_coverage(added), allowMissingColumns=True)
    inputs = registry.inputs.unionByName(new_inputs(registry.inputs, submitted))
    return Registry(entities, inputs, keys, coverage)


def select_seed(records: DataFrame, districts: list[int], n: int) -> DataFrame:
    """The first n valid parcels of the districts, each once, in order."""
    whole = F.col("address").isNotNull() & F.col("borocode").isNotNull() & F.col("block").isNotNull() & F.col("lot").isNotNull()
    parcel = ids.lenient_parcel(F.col("bbl"))
    valid = records.where(F.col("district").isin(districts) & whole & parcel.isNotNull()).select(parcel.alias("parcel")).distinct()
    return valid.orderBy("parcel").limit(n)
