import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from wardline.functions import cursors, identifiers as ids, json_fields as jf, parsing, text


def over(spark, values, column):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.out for r in df.select("i", column(F.col("v")).alias("out")).orderBy("i").collect()]


def parsed(spark, values, parser):
    return [(r.value, r.error) for r in over(spark, values, parser)]


def test_space_is_the_wide_set(spark):
    assert over(spark, ["  ﻿a   b　\n", "", " ", None, "a b" + " " * 9], text.stripped) == ["a   b", "", "", None, "a b"]
    assert over(spark, ["  a   b　", " "], text.collapsed) == ["a b", ""]
    assert over(spark, [" x ", " \t", None], text.optional) == ["x", None, None]


@pytest.mark.parametrize("given, base, unit, key", [
    ("350   5th   Avenue", "350 5th Avenue", None, "350 5th Avenue"),
    ("37-15  82nd   street", "37-15 82nd Street", None, "37-15 82nd Street"),
    ("37–15 82ND st 12b MAIN", "37-15 82nd St 12B Main", None, "37-15 82nd St 12B Main"),
    ("419 e 84 st apt 12c", "419 E 84 St", "12C", "419 E 84 St Apt 12C"),
    ("419 E 84 St #12C", "419 E 84 St", "12C", "419 E 84 St # 12C"),
    ("1 main st Suite. 5-a ", "1 Main St", "5-A", "1 Main St Ste 5-A"),
    ("1 Apt 5 main st", "1 Apt 5 Main St", None, "1 Apt 5 Main St"),
])
def test_addresses(spark, given, base, unit, key):
    (r,) = over(spark, [given], text.address_parts)
    assert (r.base, r.unit, r.key, r.error) == (base, unit, key, None)


def test_address_errors(spark):
    assert [r.error for r in over(spark, ["", "   ", " , , ", "Apt 12C", None, "floor 3"], text.address_parts)] == ["ADDRESS_EMPTY", "ADDRESS_EMPTY", "ADDRESS_NO_CONTENT", "ADDRESS_UNIT_ONLY", "ADDRESS_EMPTY", "ADDRESS_UNIT_ONLY"]


def test_street_evidence(spark):
    assert over(spark, ["37-15 82nd St.", "5 e. 4TH ave", "1  Main"], text.street_evidence) == ["37-15 82 STREET", "5 EAST 4 AVENUE", "1 MAIN"]
    assert over(spark, ["1 X St, queens, NY", "1 X St", "Queens, 5 St", "a, NY, Staten  Island 1"], text.requested_borough) == ["QUEENS", None, None, "STATEN ISLAND"]


def test_identifiers(spark):
    assert over(spark, [" 10083 50041 ", "0000000001", "123", None, "100835004x"], ids.canonical_parcel) == ["1008350041", "0000000001", None, None, None]
    assert over(spark, ["1012345", " 101 2345"], ids.canonical_building) == ["1012345", "1012345"]
    assert over(spark, ["1008350041.00000", "8350041", "12345678901", "", "1.5.x"], ids.lenient_parcel) == ["1008350041", "0008350041", None, None, "0000000001"]
    assert over(spark, ["1008350041.0", "8350041"], lambda c: ids.strict_identifier(c, 10)) == ["1008350041", None]
    assert over(spark, ["12.0", "x", "99999999999", " 7 "], ids.source_integer) == [12, None, None, 7]
    (r,) = over(spark, ["1012345, 3000000,bad,1012345 ,1000001"], lambda c: ids.valid_buildings(F.split(c, ",")))
    assert r == ["1000001", "1012345"]
    (r,) = over(spark, ["1008350041"], lambda c: F.struct(ids.borough(c), ids.block(c), ids.lot(c)))
    assert tuple(r) == (1, 835, 41)
    assert over(spark, ["1000001001", "1000007500", "1000007501", "1000001000"], ids.is_unit_lot) == [True, True, False, False]


def test_issue_dates(spark):
    d = dt.date
    good = {"20260203": d(2026, 2, 3), " 2026-2-3 ": d(2026, 2, 3), "2/29/2024": d(2024, 2, 29), "2026-02-03T23:30:00-05:00": d(2026, 2, 4), "2026-02-03T00:00:00.123456789Z": d(2026, 2, 3), "": None, " ": None, None: None, "0": None, "0100-01-01": d(100, 1, 1)}
    assert parsed(spark, list(good), parsing.parse_issue_date) == [(v, None) for v in good.values()]
    bad = ["not-a-date", " 0 ", "2026-02-30", "02/30/2026", "2026/02/30", "20260230", "0099-01-01", "2026", "2026-02-03T10:00:00", "2026-02-03T24:00:00Z", "2026-02-03T10:00:60Z", "2026-02-03T10:00:00+24:00", "2026-02-30T03:04:05.000Z", "2023-02-29"]
    assert parsed(spark, bad, parsing.parse_issue_date) == [(None, "INVALID_DATE")] * len(bad)
    assert parsed(spark, ["0"], lambda c: parsing.parse_issue_date(c, F.lit(False))) == [(None, "INVALID_DATE")]


def test_source_times(spark):
    iso = lambda c: F.struct(parsing.iso_millis(parsing.parse_source_time(c)["value"]).alias("value"), parsing.parse_source_time(c)["error"].alias("error"))
    assert parsed(spark, ["2026-01-02T03:04:05.9999Z", "2026-01-02T03:04:05+01:30", "2026-01-02", None, "x"], iso) == [("2026-01-02T03:04:05.999Z", None), ("2026-01-02T01:34:05.000Z", None), ("2026-01-02T00:00:00.000Z", None), (None, "MISSING_TIMESTAMP"), (None, "INVALID_DATE")]


def test_amounts(spark):
    values = ["-125.50", "1,250.00", " .5 ", "7.", "+1", "1.005", "", None]
    assert parsed(spark, values, parsing.parse_amount) == [(Decimal(x), None) if x else (None, None) for x in ("-125.50", "1250.00", "0.50", "7.00", "1.00", "1.01", None, None)]
    assert [e for _, e in parsed(spark, ["1e3", "abc", "--1", ".", ",", "9" * 14], parsing.parse_amount)] == ["INVALID_NUMBER"] * 5 + ["NUMBER_OVERFLOW"]
    assert parsed(spark, ["12", "-1", "x"], parsing.parse_count) == [(12, None), (None, "INVALID_COUNT"), (None, "INVALID_COUNT")]
    assert over(spark, ["0.00", "12.50", "-3.10", "100.00", "7"], lambda c: parsing.shortest_decimal(c)) == ["0", "12.5", "-3.1", "100", "7"]


def test_json_fields(spark):
    rows = ['{"BIN":1,"bin":"2"}', '{"BIN":1}', '{"bin":null}', "{}", "[1]", "oops", '{"bin":{"a":1}}', None]
    assert over(spark, rows, lambda c: jf.field(jf.fields(c), "bin")) == ["2", "1", None, None, None, None, '{"a":1}', None]
    assert over(spark, rows[:4], lambda c: jf.state(jf.fields(c), "bin")) == ["value", "value", "null", "absent"]


def test_cursors():
    c = cursors.encode(issue_date="2026-02-03", source_id="9")
    assert "=" not in c and cursors.dated(c) == (dt.date(2026, 2, 3), "9")
    assert cursors.dated(cursors.encode(issue_date=None, source_id="9")) == (None, "9")
    assert cursors.updated(cursors.encode(updated_at="2026-01-02T03:04:05+00:00", source_id="1"))[1] == "1"
    other = cursors.encode(source_id="9", issue_date=None)
    for bad in ("not*a*cursor", "", c[:-1], "YWJj", other[:-2] + "==", cursors.encode(issue_date="2026-02-30", source_id="9"), cursors.encode(issue_date=None, source_id=""), cursors.encode(a="1")):
        with pytest.raises(cursors.InvalidCursor):
            cursors.dated(bad)


def test_lock_key():
    assert cursors.lock_key("") == 0x811C9DC5 and cursors.lock_key("a") == 0xE40C292C
