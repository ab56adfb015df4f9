"""Keyed writes without MERGE: each gives the table's next version as a plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_wins(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    return _numbered(rows, keys, [F.col(c) if isinstance(c, str) else c for c in order])


def last_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return _numbered(rows, keys, [F.col(c).desc() for c in order])


def _numbered(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """row_number() = 1 is planned with a group limit, so a task keeps one row of each key before the shuffle."""
    return rows.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__rn = 1").drop("__rn")


def insert_if_absent(table: DataFrame, rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The rows to append: those whose key the table doesn't have, the first of each key."""
    return first_wins(rows, keys, order).join(table.select(*keys), keys, "left_anti").select(*rows.columns)


def merged(table: DataFrame, changes: DataFrame, keys: list[str], update: dict[str, Callable[[Column, Column], Column]] | None = None, insert: dict[str, Column] | None = None, *, null_keys: bool = True) -> DataFrame:
    """The table after an upsert of changes, one row for each key in either. Columns that changes have replace the
    table's; those they lack stay. update: for a column, (old, new) -> value on rows that both have. insert: values of
    columns that changes lack, on new rows. null_keys: null keys are equal; without, no key is null, and tables that are dealt
    by their keys are joined as they lie."""
    update, insert = update or {}, insert or {}
    old, new = table.alias("old").withColumn("__old", F.lit(True)), changes.alias("new").withColumn("__new", F.lit(True))
    same = (lambda k: F.col(f"old.{k}").eqNullSafe(F.col(f"new.{k}"))) if null_keys else (lambda k: F.col(f"old.{k}") == F.col(f"new.{k}"))
    joined = old.join(new, [same(k) for k in keys], "full_outer")
    out = []
    for c in table.columns:
        kind = table.schema[c].dataType
        if c in keys:
            value = F.when(F.col("__old"), F.col(f"old.{c}")).otherwise(F.col(f"new.{c}"))
        elif c in changes.columns:
            both = update[c](F.col(f"old.{c}"), F.col(f"new.{c}")) if c in update else F.col(f"new.{c}")
            value = F.when(F.col("__new").isNull(), F.col(f"old.{c}")).when(F.col("__old").isNull(), F.col(f"new.{c}")).otherwise(both)
        else:
            value = F.when(F.col("__old").isNull(), insert.get(c, F.lit(None))).otherwise(F.col(f"old.{c}"))
        out.append(value.cast(kind).alias(c))
    return joined.select(*out)
