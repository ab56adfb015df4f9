"""Fields of JSON rows: looked up by name whatever its case, with absent, null and value told apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardline.functions.text import optional


def fields(json: Column) -> Column:
    """The top level as a map of texts; null for what is no object."""
    return F.from_json(json, "map<string,string>", {"mode": "PERMISSIVE"})


def field(values: Column, name: str) -> Column:
    """The value under that very name, or else under the first name that differs in case only."""
    other = F.get(F.map_values(F.map_filter(values, lambda k, _: F.lower(k) == name.lower())), F.lit(0))
    return F.when(F.map_contains_key(values, name), F.try_element_at(values, F.lit(name))).otherwise(other)


def has_field(values: Column, name: str) -> Column:
    return F.coalesce(F.size(F.map_filter(values, lambda k, _: F.lower(k) == name.lower())) > 0, F.lit(False))


def state(values: Column, name: str) -> Column:
    return F.when(~has_field(values, name), F.lit("absent")).when(field(values, name).isNull(), F.lit("null")).otherwise(F.lit("value"))


def required_text(values: Column, name: str) -> Column:
    return optional(field(values, name))


def _type(json: Column, name: str) -> Column:
    return F.coalesce(F.schema_of_variant(field(F.from_json(json, "map<string,variant>"), name)), F.lit("VOID"))


def is_text(json: Column, name: str) -> Column:
    """Whether the field, found as ``field`` finds it, is a JSON text, not a number or anything else."""
    return _type(json, name) == "STRING"


def is_number(json: Column, name: str) -> Column:
    return _type(json, name).rlike("^(?:BIGINT|DOUBLE|DECIMAL)")
