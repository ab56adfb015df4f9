"""Replies of a geocoder, and JSON lines in mixed logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions import identifiers as ids
from wardline.functions.text import optional

_EACH = "array<struct<geometry:struct<coordinates:array<double>>,properties:string>>"


def _text(props: Column, *paths: str) -> Column:
    """The first of the paths that holds a text or a number, stripped."""
    return F.coalesce(*(optional(F.get_json_object(props, p)) for p in paths))


def candidates(replies: DataFrame) -> DataFrame:
    """replies: (input_id, address, reply), a GeoJSON text each. A row for each feature, in order; features without a label
    are left out."""
    features = F.from_json(F.get_json_object("reply", "$.features"), _EACH)
    each = replies.select("input_id", "address", F.posexplode(features).alias("pos", "f")).select("input_id", "address", "pos", "f.geometry.coordinates", F.col("f.properties").alias("p"))
    p = F.col("p")
    out = each.select(
        "input_id", "address", "pos", _text(p, "$.label").alias("label"), _text(p, "$.name").alias("name"), _text(p, "$.layer").alias("layer"), _text(p, "$.borough").alias("borough"),
        _text(p, "$.confidence").try_cast("double").alias("confidence"),
        ids.canonical_parcel(_text(p, "$.pad_bbl", "$.addendum.pad.bbl")).alias("parcel"), ids.canonical_building(_text(p, "$.pad_bin", "$.addendum.pad.bin")).alias("building"),
        "coordinates", _text(p, "$.source_id", "$.id").alias("source_id"),
    )
    return out.where(F.col("label").isNotNull())


def reply_status(replies: DataFrame) -> DataFrame:
    n = F.size(F.from_json(F.get_json_object("reply", "$.features"), "array<string>"))
    return replies.select("input_id", F.when(n > 0, "FOUND").when(n == 0, "NO_CANDIDATES").otherwise("MALFORMED").alias("status"))


def json_lines(lines: DataFrame) -> DataFrame:
    """(value) of those lines of a mixed log that are JSON objects."""
    value = F.trim("value")
    return lines.select(value.alias("value")).where(value.startswith("{") & F.try_parse_json(value).isNotNull())
