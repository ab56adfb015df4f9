"""Parcel and building identifiers: digit strings of fixed length, never numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardline.functions.text import stripped, without_space

PARCEL_DIGITS, BUILDING_DIGITS = 10, 7
UNIT_LOTS, BILLING_LOTS_FROM = (1001, 7500), 7501


def canonical(text: Column, digits: int) -> Column:
    """The identifier without white space; null if it is not of that many digits."""
    plain = without_space(text)
    return F.when(plain.rlike(f"^[0-9]{{{digits}}}$"), plain)


def canonical_parcel(text: Column) -> Column:
    return canonical(text, PARCEL_DIGITS)


def canonical_building(text: Column) -> Column:
    return canonical(text, BUILDING_DIGITS)


def borough(parcel: Column) -> Column:
    return F.substring(parcel, 1, 1).cast("int")


def block(parcel: Column) -> Column:
    return F.substring(parcel, 2, 5).cast("int")


def lot(parcel: Column) -> Column:
    return F.substring(parcel, 7, 4).cast("int")


def is_placeholder(building: Column) -> Column:
    return building.endswith("000000")


def is_unit_lot(parcel: Column) -> Column:
    return lot(parcel).between(*UNIT_LOTS)


def is_billing_lot(parcel: Column) -> Column:
    return lot(parcel) >= BILLING_LOTS_FROM


def valid_buildings(buildings: Column) -> Column:
    """The array's valid identifiers, distinct and in order; others are left out."""
    found = F.transform(buildings, canonical_building)
    return F.array_sort(F.array_distinct(F.filter(found, lambda b: b.isNotNull() & ~is_placeholder(b))))


def lenient_parcel(text: Column) -> Column:
    """As one source writes it: what stands before a point, padded on the left."""
    whole = F.split_part(stripped(text), F.lit("."), F.lit(1))
    return F.when(whole.rlike(f"^[0-9]{{1,{PARCEL_DIGITS}}}$"), F.lpad(whole, PARCEL_DIGITS, "0"))


def strict_identifier(text: Column, digits: int) -> Column:
    """As the other sources write it: what stands before a point, of exactly that many digits."""
    whole = F.split_part(stripped(text), F.lit("."), F.lit(1))
    return F.when(whole.rlike(f"^[0-9]{{{digits}}}$"), whole)


def typed_parcel(value: Column, is_number: Column) -> Column:
    """As a third writes it, struct of value and error: a number loses its fraction and is padded if it is short, a text is
    canonical or it is an error, as is everything else; nothing is ever cut."""
    number = value.try_cast("decimal(38,6)")  # large numbers come with exponents
    whole = F.when(number < 0, F.ceil(number)).otherwise(F.floor(number)).cast("string")
    padded = F.when(whole.rlike(f"^[0-9]{{1,{PARCEL_DIGITS}}}$"), F.lpad(whole, PARCEL_DIGITS, "0"))
    found = F.when(is_number, padded).otherwise(canonical_parcel(value))
    return F.struct(found.alias("value"), F.when(found.isNull(), F.lit("MALFORMED_PARCEL")).alias("error"))


def source_integer(text: Column) -> Column:
    whole = F.split_part(stripped(text), F.lit("."), F.lit(1))
    return F.when(whole.rlike("^[0-9]+$"), whole.try_cast("int"))
