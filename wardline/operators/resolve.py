"""Resolution of parcels to building keys: set-based lookups that report ambiguity instead of guessing.

All inputs go through one plan of left joins. Lookups are grouped before they are joined, so an input keeps one row
whatever its lookups hold, and every outcome is a status and an error code in columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.functions import identifiers as ids
from wardline.functions.text import address_parts, candidate_street, optional, requested_borough, street_evidence
from wardline.plans.lineage import cut

#: What a parcel record may lack, in the order in which it is reported.
MISSING = ("missing_bbl", "missing_borocode", "missing_block", "missing_lot", "missing_address")
MISMATCH = "identifier_mismatch"


def parse_inputs(inputs: DataFrame) -> DataFrame:
    """(pos, input) with the canonical parcel, or an error."""
    parcel = ids.canonical_parcel(F.col("input"))
    return inputs.select("pos", "input", parcel.alias("parcel"), F.when(parcel.isNull(), F.lit("INVALID_IDENTIFIER")).alias("input_error"))


def distinct_parcels(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("parcel").isNotNull()).select("parcel").distinct()


def split_cached(parcels: DataFrame, registered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Those with an entity already, with its id; and the others."""
    known = registered.select("parcel", "entity_id")
    return parcels.join(known, "parcel"), parcels.join(known, "parcel", "left_anti")


def cardinality(keys: DataFrame, lookup: DataFrame, key: str, value: str) -> DataFrame:
    """For each key: zero, one or multiple matches, and the value of a single one."""
    found = lookup.groupBy(key).agg(F.count("*").alias("n"), F.min(value).alias(value))
    n = F.coalesce("n", F.lit(0))
    count = F.when(n == 0, "zero").when(n == 1, "one").otherwise("multiple")
    return keys.join(found, key, "left").select(*keys.columns, count.alias("match_count"), F.when(n == 1, F.col(value)).alias(value))


def assess_parcels(records: DataFrame) -> DataFrame:
    """Each source record with its parcel, parts and the reasons for which it is incomplete."""
    parcel = ids.lenient_parcel(F.col("bbl"))
    parts = [ids.source_integer(F.col(c)) for c in ("borocode", "block", "lot")]
    address = optional(F.col("address"))
    lacking = [F.when(x.isNull(), F.lit(why)) for x, why in zip((parcel, *parts, address), MISSING, strict=True)]
    same = (ids.borough(parcel) == parts[0]) & (ids.block(parcel) == parts[1]) & (ids.lot(parcel) == parts[2])
    reasons = F.array_compact(F.array(*lacking, F.when(~same, F.lit(MISMATCH))))
    return records.select(parcel.alias("parcel"), *(p.alias(n) for p, n in zip(parts, ("borough", "block", "lot"), strict=True)), address.alias("address"), reasons.alias("reasons"))


def parcel_status(keys: DataFrame, assessed: DataFrame) -> DataFrame:
    """For each key: FOUND with its address, NOT_FOUND, INCOMPLETE with the reasons of all its records, or MULTIPLE."""
    order = F.array(*map(F.lit, (*MISSING, MISMATCH)))
    found = assessed.where(F.col("parcel").isNotNull()).groupBy("parcel").agg(
        F.count_if(F.size("reasons") == 0).alias("complete"),
        F.count("*").alias("records"),
        F.min(F.when(F.size("reasons") == 0, F.col("address"))).alias("address"),
        F.array_distinct(F.flatten(F.collect_set("reasons"))).alias("all_reasons"),
    )
    status = F.when(F.col("records").isNull(), "NOT_FOUND").when(F.col("complete") == 1, "FOUND").when(F.col("complete") > 1, "MULTIPLE").otherwise("INCOMPLETE")
    reasons = F.when(status == "INCOMPLETE", F.array_join(F.filter(order, lambda r: F.array_contains("all_reasons", r)), ","))
    return keys.join(found, "parcel", "left").select(*keys.columns, status.alias("parcel_status"), F.when(status == "FOUND", F.col("address")).alias("address"), reasons.alias("reasons"))


def parcel_error(status: Column) -> Column:
    return F.when(status == "NOT_FOUND", "PARCEL_NOT_FOUND").when(status == "INCOMPLETE", "PARCEL_INCOMPLETE").when(status == "MULTIPLE", "PARCEL_MULTIPLE")


def footprint_candidates(keys: DataFrame, footprints: DataFrame) -> DataFrame:
    """Footprints filed under a key by either of their parcels, once each: two joins on equality, not one on OR."""
    either = [keys.join(footprints, F.col("parcel") == F.col(side)) for side in ("base_parcel", "map_parcel")]
    return either[0].unionByName(either[1]).distinct()


def footprint_verdict(mode: str | Column) -> Column:
    """mode: parcel, condo, or whether it is condo. Null for a footprint that may stand for its key, else why not. A parcel that the source left out and one that it
    states as null are not the same: of a condo's billing parcel the latter says that it is another's."""
    base = F.when(~F.col("base_parcel").eqNullSafe(F.col("parcel")), F.lit("BASE_MISMATCH"))
    stated_null = F.when(F.lit(mode == "condo") if isinstance(mode, str) else mode, F.lit("MAP_MISMATCH")).otherwise(base)
    stated = F.when(F.col("map_parcel").isNull(), stated_null).when(F.col("map_parcel") != F.col("parcel"), F.lit("MAP_MISMATCH"))
    return F.when(F.col("has_map"), stated).otherwise(base)


def validated_buildings(candidates: DataFrame, mode: str | Column = "parcel", by: tuple[str, ...] = ("parcel",)) -> DataFrame:
    """For each key with candidates: its valid buildings, or the error if all of them were rejected."""
    judged = candidates.withColumn("reason", footprint_verdict(mode))
    found = judged.groupBy(*by).agg(
        F.bool_or(F.col("reason").isNull()).alias("any_accepted"),
        F.bool_or(F.coalesce(F.col("reason") == "MAP_MISMATCH", F.lit(False))).alias("any_map"),
        F.collect_set(F.when(F.col("reason").isNull(), F.col("building"))).alias("buildings"),
    )
    error = F.when(~F.col("any_accepted"), F.when(F.col("any_map"), F.lit("MAP_MISMATCH")).otherwise(F.lit("BASE_MISMATCH")))
    return found.select(*by, F.when(F.col("any_accepted"), ids.valid_buildings(F.col("buildings"))).alias("buildings"), error.alias("footprint_error"))


def condo_chain(units: DataFrame, unit_map: DataFrame, billing_map: DataFrame) -> DataFrame:
    """Unit to base to billing parcel; each hop must have exactly one answer."""
    base = cardinality(units.select("parcel"), unit_map.withColumnRenamed("unit_parcel", "parcel"), "parcel", "base_parcel").withColumnRenamed("match_count", "unit_matches")
    bases = base.where(F.col("base_parcel").isNotNull()).select("base_parcel").distinct()
    billing = cardinality(bases, billing_map, "base_parcel", "billing_parcel").withColumnRenamed("match_count", "billing_matches")
    error = (
        F.when(F.col("unit_matches") == "zero", "CONDO_UNIT_NOT_FOUND")
        .when(F.col("unit_matches") == "multiple", "CONDO_UNIT_AMBIGUOUS")
        .when(F.col("billing_matches") == "zero", "CONDO_BILLING_NOT_FOUND")
        .when(F.col("billing_matches") == "multiple", "CONDO_BILLING_AMBIGUOUS")
    )
    return base.join(billing, "base_parcel", "left").select("parcel", "base_parcel", "billing_parcel", error.alias("condo_error"))


def unit_by_designation(wanted: DataFrame, unit_map: DataFrame) -> DataFrame:
    """wanted: (base_parcel, unit). Each with its unit parcel, if both together name exactly one; a blank unit names none."""
    named = unit_map.where(optional(F.col("unit")).isNotNull()).groupBy("base_parcel", "unit").agg(F.count("*").alias("n"), F.min("unit_parcel").alias("unit_parcel"))
    n = F.coalesce("n", F.lit(0))
    error = F.when(n == 0, "CONDO_UNIT_NOT_FOUND").when(n > 1, "CONDO_UNIT_AMBIGUOUS")
    return wanted.join(named, ["base_parcel", "unit"], "left").select(*wanted.columns, F.when(error.isNull(), F.col("unit_parcel")).alias("unit_parcel"), error.alias("unit_error"))


def condo_base(parcels: DataFrame, billing_map: DataFrame) -> DataFrame:
    """Each parcel with the base parcel that it stands in: its own, or for a billing parcel the only one that it bills."""
    is_billing = ids.is_billing_lot(F.col("parcel"))
    found = cardinality(parcels.where(is_billing).select("parcel").distinct(), billing_map.withColumnRenamed("billing_parcel", "parcel"), "parcel", "base_parcel")
    error = F.when(F.col("match_count") == "zero", "CONDO_BASE_NOT_FOUND").when(F.col("match_count") == "multiple", "CONDO_BASE_AMBIGUOUS")
    joined = parcels.join(found, "parcel", "left")
    return joined.select(*parcels.columns, F.when(is_billing, F.col("base_parcel")).otherwise(F.col("parcel")).alias("base_parcel"), error.alias("base_error"))


def probed(owners: DataFrame, footprints: DataFrame) -> DataFrame:
    """owners: (base, parcel), base empty for a plain parcel. Footprints filed under a plain parcel by either of their own, or
    under a condo by its base alone: one join on the side and its parcel, not one on OR."""
    side = lambda name, value: F.struct(F.lit(name).alias("side"), F.col(value).alias("probe"))
    asked = F.when(F.col("base") == "", F.array(side("base", "parcel"), side("map", "parcel"))).otherwise(F.array(side("base", "base")))
    filed = footprints.select("*", F.explode(F.array(side("base", "base_parcel"), side("map", "map_parcel"))).alias("f")).select(*footprints.columns, "f.*")
    return owners.select("base", "parcel", F.explode(asked).alias("a")).select("base", "parcel", "a.*").join(filed, ["side", "probe"]).drop("side", "probe").distinct()


def resolve(parcels: DataFrame, records: DataFrame, footprints: DataFrame, unit_map: DataFrame, billing_map: DataFrame) -> DataFrame:
    """For each parcel: error, address, base and billing parcels, and its buildings. Condo units are validated against
    their billing parcel and found by their base; all others stand for themselves."""
    keys = parcels.select("parcel", ids.is_unit_lot(F.col("parcel")).alias("as_unit"))
    return resolve_keys(keys, records, footprints, unit_map, billing_map).drop("as_unit")


def resolve_keys(keys: DataFrame, records: DataFrame, footprints: DataFrame, unit_map: DataFrame, billing_map: DataFrame) -> DataFrame:
    """keys: (parcel, as_unit): whether it is taken as a condo unit. Plain and billing parcels are looked up together."""
    null = F.lit(None).cast("string")
    chain = condo_chain(keys.where("as_unit").select("parcel"), unit_map, billing_map)
    plain = keys.where("NOT as_unit").select("as_unit", "parcel", null.alias("base_parcel"), F.col("parcel").alias("looked_up"), null.alias("condo_error"))
    wanted = plain.unionByName(chain.select(F.lit(True).alias("as_unit"), "parcel", "base_parcel", F.col("billing_parcel").alias("looked_up"), "condo_error"))
    wanted = wanted.withColumn("base", F.coalesce("base_parcel", F.lit("")))
    owners = wanted.where(F.col("looked_up").isNotNull()).select("base", F.col("looked_up").alias("parcel")).distinct()
    status = parcel_status(owners, assess_parcels(records))
    buildings = validated_buildings(probed(owners, footprints), F.col("base") != "", ("base", "parcel"))
    known = status.join(buildings, ["base", "parcel"], "left").withColumnRenamed("parcel", "looked_up")
    joined = wanted.join(known, ["base", "looked_up"], "left")
    error = F.coalesce("condo_error", parcel_error(F.col("parcel_status")), "footprint_error")
    keep = F.when(error.isNull(), F.coalesce("buildings", F.array().cast("array<string>")))
    billing = F.when(F.col("as_unit"), F.col("looked_up"))
    return joined.select("parcel", "as_unit", error.alias("error"), F.when(error.isNull(), F.col("address")).alias("address"), "base_parcel", billing.alias("billing_parcel"), keep.alias("buildings"))


def parse_addresses(inputs: DataFrame) -> DataFrame:
    """(input_id, base, unit, key, input_error) of (input_id, address). Addresses take long for their few bytes, of which a scan
    makes one task, so they are dealt to tasks by their number."""
    spark = inputs.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    parsed = inputs.select("input_id", "address").repartition(tasks, "input_id").select("input_id", address_parts(F.col("address")).alias("p"))
    return parsed.select("input_id", "p.base", "p.unit", "p.key", F.col("p.error").alias("input_error"))


def resolve_addresses(inputs: DataFrame, candidates: DataFrame, known: DataFrame, records: DataFrame, footprints: DataFrame, unit_map: DataFrame, billing_map: DataFrame) -> DataFrame:
    """inputs: (input_id, address). Each to its entity if its key is known, else by the geocoder's candidate to a parcel, or with
    a unit to the one that bears it, and to buildings that must not contradict the candidate's. One row for each input.
    candidates: as ``geocoder.candidates`` gives them for the addresses without their units; known: (key, entity_id);
    unit_map: with the unit's designation. What is read several times is written once: addresses as parsed, and as located."""
    cached = cut(parse_addresses(inputs).join(known.select("key", "entity_id"), "key", "left"))
    fresh = cached.where(F.col("input_error").isNull() & F.col("entity_id").isNull()).select("input_id", "unit")
    chosen = fresh.join(select_candidate(candidates).select("input_id", "parcel", "building", F.col("error").alias("geo_error")), "input_id", "left")
    chosen = chosen.withColumn("geo_error", F.when(F.col("parcel").isNull(), F.coalesce("geo_error", F.lit("NO_CANDIDATES"))))
    located = cut(condo_base(chosen.withColumn("parcel", F.when(F.col("geo_error").isNull(), F.col("parcel"))), billing_map))
    by_unit = unit_by_designation(located.where(F.col("unit").isNotNull() & F.col("base_parcel").isNotNull()).select("base_parcel", "unit").distinct(), unit_map)
    found = located.join(by_unit, ["base_parcel", "unit"], "left")
    with_unit = F.col("unit").isNotNull()
    target = found.select("input_id", "building", with_unit.alias("as_unit"), F.when(with_unit, F.col("unit_parcel")).otherwise(F.col("parcel")).alias("parcel"), F.coalesce("geo_error", F.when(with_unit, F.coalesce("base_error", "unit_error"))).alias("early_error"))
    keys = target.where(F.col("parcel").isNotNull() & F.col("early_error").isNull()).select("parcel", "as_unit").distinct()
    resolved = resolve_keys(keys, records, footprints, unit_map.select("unit_parcel", "base_parcel"), billing_map).withColumnRenamed("error", "late_error")
    joined = target.join(resolved, ["parcel", "as_unit"], "left")
    conflict = F.when(~corroborated(F.col("building"), F.col("buildings")), F.lit("BUILDING_CONFLICT"))
    error = F.coalesce("early_error", "late_error", conflict)
    outcome = joined.select("input_id", "parcel", "address", error.alias("error"), "base_parcel", "billing_parcel", F.when(error.isNull(), F.col("buildings")).alias("buildings"))
    whole = cached.select("input_id", "key", "entity_id", "input_error").join(outcome, "input_id", "left")
    final = F.coalesce("input_error", "error")
    status = F.when(final.isNotNull(), "failed").when(F.col("entity_id").isNotNull(), "cached").otherwise("succeeded")
    return whole.select("input_id", "key", status.alias("status"), final.alias("error"), "entity_id", "parcel", "address", "base_parcel", "billing_parcel", "buildings")


def outcomes(parsed: DataFrame, cached: DataFrame, resolved: DataFrame) -> DataFrame:
    """One row for each input as submitted, repeated ones too, in the order of ``pos``."""
    known = cached.select("parcel", F.lit(True).alias("was_cached"))
    found = resolved.select("parcel", "error", F.lit(True).alias("was_resolved"))
    error = F.coalesce("input_error", F.when(F.col("was_cached"), None).otherwise(F.coalesce("error", F.when(F.col("was_resolved").isNull(), F.lit("UNRESOLVED")))))
    status = F.when(error.isNotNull(), "failed").when(F.col("was_cached"), "cached").otherwise("succeeded")
    joined = parsed.join(known, "parcel", "left").join(found, "parcel", "left")
    return joined.select("pos", "input", "parcel", status.alias("status"), error.alias("error"))


def summary(outcomes: DataFrame) -> DataFrame:
    of = lambda s: F.count_if(F.col("status") == s).alias(s)
    return outcomes.agg(F.count("*").alias("submitted"), F.count_distinct("parcel").alias("unique"), of("succeeded"), of("failed"), of("cached"))


def failures_by_code(outcomes: DataFrame) -> DataFrame:
    return outcomes.where(F.col("status") == "failed").groupBy("error").agg(F.count("*").alias("n"))


def narrowed(candidates: DataFrame, flag: Column) -> DataFrame:
    """An input's flagged candidates, or all of them if it has none."""
    marked = candidates.withColumn("__flag", F.coalesce(flag, F.lit(False)))
    return marked.withColumn("__any", F.bool_or("__flag").over(Window.partitionBy("input_id"))).where(F.col("__flag") | ~F.col("__any")).drop("__flag", "__any")


def narrow_candidates(candidates: DataFrame) -> DataFrame:
    """Candidates (input_id, address, pos, label, name, layer, borough, confidence, parcel, source_id) that the address
    supports: of the borough it asks for, then of its street if any, then of the address layer if any."""
    borough = requested_borough(F.col("address"))
    fit = candidates.where(F.col("parcel").isNotNull() & (borough.isNull() | (F.upper(F.trim("borough")) == borough)))
    street = street_evidence(candidate_street(F.col("name"), F.col("label"))) == street_evidence(F.split_part("address", F.lit(","), F.lit(1)))
    return narrowed(narrowed(fit, street), F.col("layer") == "address")


def select_candidate(candidates: DataFrame) -> DataFrame:
    """For each input: the best candidate's parcel and building, or why none can be taken. Label and id break ties between known
    confidences; candidates without any keep the order in which they came."""
    inputs = candidates.groupBy("input_id").agg(F.count_if(F.col("parcel").isNotNull()).alias("usable"))
    left = narrow_candidates(candidates)
    known = F.col("confidence").isNotNull()
    order = [F.col("confidence").desc_nulls_last(), F.when(known, F.coalesce("label", F.lit(""))), F.when(known, F.coalesce("source_id", F.lit(""))), F.col("pos")]
    best = left.withColumn("rank", F.row_number().over(Window.partitionBy("input_id").orderBy(*order)))
    first = F.max(F.when(F.col("rank") == 1, F.struct("parcel", F.col("building") if "building" in best.columns else F.lit(None).cast("string").alias("building")))).alias("first")
    chosen = best.groupBy("input_id").agg(F.count_distinct("parcel").alias("n_parcels"), first).select("input_id", "n_parcels", "first.*")
    error = F.when(F.col("usable") == 0, "NO_IDENTIFIERS").when(F.col("n_parcels").isNull() | (F.col("n_parcels") > 1), "AMBIGUOUS")
    taken = lambda c: F.when(error.isNull(), F.col(c)).alias(c)
    return inputs.join(chosen, "input_id", "left").select("input_id", taken("parcel"), taken("building"), error.alias("error"))


def corroborated(building: Column, buildings: Column) -> Column:
    """Whether a geocoder's building agrees: it must be among the validated ones if both sides have any."""
    own = ids.canonical_building(building)
    return own.isNull() | ids.is_placeholder(own) | (F.size(buildings) == 0) | F.array_contains(buildings, own)


def initial_coverage(entities: DataFrame) -> DataFrame:
    """NOT_CHECKED, for want of a run, or of anything to check."""
    reason = F.when(F.size("buildings") > 0, "NEVER_INGESTED").otherwise("NO_VALID_BUILDING")
    return entities.select("entity_id", F.lit("NOT_CHECKED").alias("status"), reason.alias("status_reason"))


def key_set_changes(now: DataFrame, new: DataFrame) -> DataFrame:
    """(entity_id, version, keys) against new (entity_id, keys): the next version of each set. An empty new set changes
    nothing; equal sets keep their version."""
    keys = lambda c: F.array_sort(F.array_distinct(c))
    joined = now.select("entity_id", "version", keys(F.col("keys")).alias("keys")).join(new.select("entity_id", keys(F.col("keys")).alias("new_keys")), "entity_id", "left")
    changed = F.coalesce((F.size("new_keys") > 0) & (F.col("new_keys") != F.col("keys")), F.lit(False))
    return joined.select("entity_id", (F.col("version") + F.when(changed, 1).otherwise(0)).cast("int").alias("version"), F.when(changed, F.col("new_keys")).otherwise(F.col("keys")).alias("keys"), changed.alias("changed"))

