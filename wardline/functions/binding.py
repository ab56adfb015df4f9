"""A value computed once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body over a value that is computed once. Without it, a value named in several branches of a CASE is computed anew
    in each, and nested parsers multiply."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
