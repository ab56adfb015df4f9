from pyspark.sql import functions as F

from wardline.operators import resolve

FOOTPRINT = "building string, base_parcel string, map_parcel string, has_map boolean"


def test_bulk(spark):
    unit, plain = "1012341001", "1008350041"
    inputs = [plain, f" {plain} ", "bad", unit, "1000010001", "1000020002", "1012351001", "1012361001", "1012371001", "1012381001", "1000030003"]
    given = spark.createDataFrame(list(enumerate(inputs)), "pos int, input string")
    record = lambda p, address="1 Main": (p, p[0], p[1:6], p[6:], address)
    records = spark.createDataFrame([record(plain), record("1012347501"), record("1000010001", " "), record("1000020002"), record("1000020002"), record("1000030003")], "bbl string, borocode string, block string, lot string, address string")
    footprints = spark.createDataFrame([("1012345", plain, plain, True), ("1000000", plain, plain, True), ("1055555", "1012340001", "1012347501", True), ("1066666", "1012340001", None, True), ("1077777", "1999999999", "1000030003", False)], FOOTPRINT)
    units = spark.createDataFrame([(unit, "1012340001"), ("1012361001", "a"), ("1012361001", "b"), ("1012371001", "1012370001"), ("1012381001", "1012380001")], "unit_parcel string, base_parcel string")
    billing = spark.createDataFrame([("1012340001", "1012347501"), ("1012380001", "x"), ("1012380001", "y")], "base_parcel string, billing_parcel string")
    parsed = resolve.parse_inputs(given)
    cached, others = resolve.split_cached(resolve.distinct_parcels(parsed), spark.createDataFrame([("1000020002", 77)], "parcel string, entity_id int"))
    resolved = resolve.resolve(others, records, footprints, units, billing)
    out = resolve.outcomes(parsed, cached, resolved)
    assert [(r.status, r.error) for r in out.orderBy("pos").collect()] == [
        ("succeeded", None), ("succeeded", None), ("failed", "INVALID_IDENTIFIER"), ("succeeded", None), ("failed", "PARCEL_INCOMPLETE"), ("cached", None),
        ("failed", "CONDO_UNIT_NOT_FOUND"), ("failed", "CONDO_UNIT_AMBIGUOUS"), ("failed", "CONDO_BILLING_NOT_FOUND"), ("failed", "CONDO_BILLING_AMBIGUOUS"), ("failed", "BASE_MISMATCH"),
    ]
    got = {r.parcel: r for r in resolved.collect()}
    assert got[plain].buildings == ["1012345"] and got[unit].buildings == ["1055555"] and got[unit].billing_parcel == "1012347501"
    assert tuple(resolve.summary(out).first()) == (11, 9, 3, 7, 1)


def test_parcel_states(spark):
    rows = [("1000010001", "1", "1", "1", "a"), ("1000010002", "1", "9", "2", "a"), ("1000010003", None, "1", None, None), ("1000010004", "1", "1", "4", "a"), ("1000010004.0", "1", "1", "4.00", "b")]
    assessed = resolve.assess_parcels(spark.createDataFrame(rows, "bbl string, borocode string, block string, lot string, address string"))
    keys = spark.createDataFrame([(f"100001000{k}",) for k in range(1, 6)], "parcel string")
    got = {r.parcel[-1]: (r.parcel_status, r.address, r.reasons) for r in resolve.parcel_status(keys, assessed).collect()}
    assert got == {"1": ("FOUND", "a", None), "2": ("INCOMPLETE", None, "identifier_mismatch"), "3": ("INCOMPLETE", None, "missing_borocode,missing_lot,missing_address"), "4": ("MULTIPLE", None, None), "5": ("NOT_FOUND", None, None)}


def test_footprint_verdicts(spark):
    rows = [("k", "k", None, True), ("x", "k", None, True), ("k", "k", "k", True), ("k", "k", "x", True), ("k", "k", "k", False), ("x", "k", "k", False)]
    df = spark.createDataFrame([(i, b, p, m, h) for i, (b, p, m, h) in enumerate(rows)], "i int, base_parcel string, parcel string, map_parcel string, has_map boolean")
    got = df.select("i", resolve.footprint_verdict("parcel").alias("p"), resolve.footprint_verdict("condo").alias("c")).orderBy("i").collect()
    assert [r.p for r in got] == [None, "BASE_MISMATCH", None, "MAP_MISMATCH", None, "BASE_MISMATCH"]
    assert [r.c for r in got] == ["MAP_MISMATCH", "MAP_MISMATCH", None, "MAP_MISMATCH", None, "BASE_MISMATCH"]


def test_or_join_is_two_equal_joins(spark):
    keys, prints = spark.createDataFrame([("a",)], "parcel string"), spark.createDataFrame([("1", "a", "a", True), ("2", "b", "a", True)], FOOTPRINT)
    found = resolve.footprint_candidates(keys, prints)
    assert found.count() == 2 and "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()


def test_candidates(spark):
    schema = "input_id int, pos int, address string, label string, name string, layer string, borough string, confidence double, parcel string, source_id string"
    rows = [
        (1, 0, "5 E Main St, Queens", "x", "5 East Main Street", "venue", "Queens", 0.9, "A", "1"), (1, 1, "5 E Main St, Queens", "y", "5 EAST MAIN ST", "address", "queens", 0.1, "B", "2"), (1, 2, "5 E Main St, Queens", "z", "5 EAST MAIN ST", "address", "Bronx", 1.0, "C", "3"),
        (2, 0, "1 A St", "1 A Street, NY", None, "address", None, 0.5, None, "4"),
        (3, 0, "1 A St", "1 A Street, NY", None, "address", None, 0.5, "A", "5"), (3, 1, "1 A St", "1 A St, NY", None, "address", None, 0.5, "B", "6"),
        (4, 0, "1 A St, Bronx", "1 A Street, NY", None, "address", "Queens", 0.5, "A", "7"),
        (5, 0, "q", "b", None, "venue", None, None, "P", "2"), (5, 1, "q", "a", None, "venue", None, None, "P", "1"),
    ]
    got = {r.input_id: (r.parcel, r.error) for r in resolve.select_candidate(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: ("B", None), 2: (None, "NO_IDENTIFIERS"), 3: (None, "AMBIGUOUS"), 4: (None, "AMBIGUOUS"), 5: ("P", None)}


def test_key_sets(spark):
    now = spark.createDataFrame([(1, 1, ["b", "a"]), (2, 1, ["a"]), (3, 4, ["a"]), (4, 1, ["a"])], "entity_id int, version int, keys array<string>")
    new = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["c"]), (3, [])], "entity_id int, keys array<string>")
    got = {r.entity_id: (r.version, r["keys"], r.changed) for r in resolve.key_set_changes(now, new).collect()}
    assert got == {1: (1, ["a", "b"], False), 2: (2, ["c"], True), 3: (4, ["a"], False), 4: (1, ["a"], False)}
    df = spark.createDataFrame([("1012345", ["1012345"]), ("1012346", ["1012345"]), (None, ["1012345"]), ("1000000", ["1012345"]), ("1012346", [])], "b string, bs array<string>")
    assert [r[0] for r in df.select(resolve.corroborated(F.col("b"), F.col("bs"))).collect()] == [True, False, True, True, True]


def test_addresses_are_parsed_once_and_dealt_to_tasks(spark):
    """Fields of a parsed address, selected one by one, must not each parse it anew; nor must one small file be one task."""
    inputs = spark.createDataFrame([(k, f"{k} main st apt {k}b") for k in range(400)], "input_id long, address string").coalesce(1)
    parsed = resolve.parse_addresses(inputs)
    plan = parsed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[A-Za-z0-9][A-Za-z0-9-]*$") == 2  # of the last word, and of what follows its mark
    tasks = parsed.select("key", F.spark_partition_id().alias("task")).collect()
    assert {r.key for r in tasks} == {f"{k} Main St Apt {k}B" for k in range(400)} and len({r.task for r in tasks}) > 4


def test_addresses_are_written_before_they_are_read_again(spark):
    from wardline.queries import QUERIES

    plan = QUERIES["address_resolution"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "[A-Za-z0-9][A-Za-z0-9-]*$" not in plan
