"""Strict parsers. Each gives a struct of value and error; Spark's own parsers accept more than the sources may send, so
a pattern guards each of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardline.functions.binding import let
from wardline.functions.text import stripped

_ZONED = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T(?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](?:\.[0-9]{1,9})?(?:Z|[+-](?:[01][0-9]|2[0-3]):[0-5][0-9])$"


def result(value: Column, error: Column) -> Column:
    return F.struct(F.when(error.isNull(), value).alias("value"), error.alias("error"))


def _day(year: Column, month: Column, day: Column) -> Column:
    """A calendar day as a timestamp in UTC; null if there is none such. Years below 100 are not accepted."""
    text = F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    return F.when(year.try_cast("int") >= 100, F.try_to_date(text, "yyyy-MM-dd")).cast("timestamp")


def _zoned(text: Column) -> Column:
    """Fractions are cut to milliseconds; the calendar day is checked apart from the zone."""
    seconds = sum((F.substring(text, at, 2).try_cast("int") * unit for at, unit in ((12, 3600), (15, 60), (18, 1))), F.lit(0))
    millis = F.rpad(F.substring(F.regexp_extract(text, r"\.([0-9]+)", 1), 1, 3), 3, "0").try_cast("int")
    minutes = lambda z: F.when(z == "", F.lit(0)).otherwise(F.when(F.substring(z, 1, 1) == "+", 1).otherwise(-1) * (F.substring(z, 2, 2).try_cast("int") * 60 + F.substring(z, 5, 2).try_cast("int")))
    offset = let(F.regexp_extract(text, r"([+-][0-9]{2}:[0-9]{2})$", 1), minutes)
    moved = lambda day: F.timestamp_millis(F.unix_millis(day) + (seconds - offset * 60).cast("long") * 1000 + F.coalesce(millis, F.lit(0)))
    return let(_day(F.substring(text, 1, 4), F.substring(text, 6, 2), F.substring(text, 9, 2)), moved)


def parse_time(text: Column) -> Column:
    """Compact, dashed and slashed dates and zoned timestamps; null or blank is null; anything else is an error."""
    dashed, slashed = r"^([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})$", r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})$"

    def value(plain: Column) -> Column:
        part = lambda pattern, n: F.regexp_extract(plain, pattern, n)
        return (
            F.when(plain.rlike("^[0-9]{8}$"), _day(F.substring(plain, 1, 4), F.substring(plain, 5, 2), F.substring(plain, 7, 2)))
            .when(plain.rlike(dashed), _day(part(dashed, 1), part(dashed, 2), part(dashed, 3)))
            .when(plain.rlike(slashed), _day(part(slashed, 3), part(slashed, 1), part(slashed, 2)))
            .when(plain.rlike(_ZONED), _zoned(plain))
        )

    def judged(plain: Column) -> Column:
        bad = lambda v: F.when((plain != "") & v.isNull(), F.lit("INVALID_DATE"))
        return let(value(plain), lambda v: F.struct(v.alias("value"), bad(v).alias("error")))

    return let(stripped(text), judged)


def parse_issue_date(text: Column, is_text: Column | None = None) -> Column:
    """A date; the text ``0`` itself, and not a number or a padded one, means that there is none."""
    is_text = F.lit(True) if is_text is None else is_text
    none = is_text & F.coalesce(text == "0", F.lit(False))
    return let(parse_time(text), lambda p: F.struct(F.when(~none, p["value"].cast("date")).alias("value"), F.when(~none, p["error"]).alias("error")))


def parse_source_time(text: Column) -> Column:
    missing = lambda p: F.when(p["error"].isNull() & p["value"].isNull(), F.lit("MISSING_TIMESTAMP"))
    return let(parse_time(text), lambda p: F.struct(p["value"].alias("value"), F.coalesce(p["error"], missing(p)).alias("error")))


def parse_amount(text: Column) -> Column:
    """A decimal of two places, rounded half up; no exponent; what overflows is an error."""

    def judged(given: Column) -> Column:
        plain = F.replace(given, F.lit(","), F.lit(""))
        shaped = plain.rlike(r"^[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)$")
        error = lambda v: F.when((given != "") & v.isNull(), F.when(shaped, F.lit("NUMBER_OVERFLOW")).otherwise(F.lit("INVALID_NUMBER")))
        return let(F.when(shaped, plain.try_cast("decimal(15,2)")), lambda v: F.struct(v.alias("value"), error(v).alias("error")))

    return let(stripped(text), judged)


def parse_count(text: Column) -> Column:
    plain = stripped(text)
    value = F.when(plain.rlike("^[0-9]+$"), plain.try_cast("bigint"))
    return result(value, F.when(value.isNull(), F.lit("INVALID_COUNT")))


def iso_millis(time: Column) -> Column:
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def shortest_decimal(amount: Column) -> Column:
    """Without trailing zeros, nor a trailing point."""
    return F.regexp_replace(F.regexp_replace(amount.cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")


def timestamp_seconds(value: Column) -> Column:
    """A source's version, whole seconds since 1970 as a number or a text of digits, as the moment it stands for."""
    plain = stripped(value.cast("string"))
    seconds = F.when(plain.rlike("^[0-9]{1,11}$"), plain.try_cast("long"))
    return result(F.timestamp_seconds(seconds), F.when(seconds.isNull(), F.lit("INVALID_VERSION")))
