"""Checks of what callers submit: columns that give an error, or null if there is none."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardline.functions.text import optional

BULK_INPUTS, ENTITIES = (1, 10_000), (1, 10_000)
_UUID = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[1-8][0-9a-fA-F]{3}-[89abAB][0-9a-fA-F]{3}-[0-9a-fA-F]{12}$"


def submission_error(address: Column, parcel: Column) -> Column:
    """Of a single registration: an address or a parcel, not both and not neither; blank is none."""
    given = lambda c: optional(c).isNotNull()
    return F.when(given(address) & given(parcel), F.lit("ADDRESS_AND_PARCEL")).when(~given(address) & ~given(parcel), F.lit("NOTHING_SUBMITTED"))


def bulk_error(inputs: Column) -> Column:
    """Of a list of inputs: between 1 and 10,000, none of them null."""
    n = F.size(inputs)
    return F.when(inputs.isNull() | (n < BULK_INPUTS[0]), F.lit("NO_INPUTS")).when(n > BULK_INPUTS[1], F.lit("TOO_MANY_INPUTS")).when(F.exists(inputs, lambda x: x.isNull()), F.lit("INVALID_INPUT"))


def is_uuid(text: Column) -> Column:
    return F.coalesce(text.rlike(_UUID), F.lit(False))


def entity_ids_error(ids: Column) -> Column:
    """Of a portfolio's list of entity ids."""
    n = F.size(ids)
    return F.when(ids.isNull() | (n < ENTITIES[0]), F.lit("NO_ENTITIES")).when(n > ENTITIES[1], F.lit("TOO_MANY_ENTITIES")).when(F.exists(ids, lambda x: ~is_uuid(x)), F.lit("INVALID_ENTITY_ID"))
