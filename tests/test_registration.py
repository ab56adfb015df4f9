import json

from wardline.__main__ import main
from wardline.operators import registration as reg
from wardline.plans.publish import COVERAGE
from wardline.sources import geocoder

RESOLVED = "parcel string, error string, address string, base_parcel string, billing_parcel string, buildings array<string>"
ENTITIES = "entity_id string, version int, parcel string, base_parcel string, billing_parcel string, address string, borough int, block int, lot int"


def test_entities_inputs_and_keys(spark):
    resolved = spark.createDataFrame([("1008350041", None, "350 5 Ave", None, None, ["1012345", "1012346"]), ("1000010002", "PARCEL_NOT_FOUND", None, None, None, None), ("1000030004", None, "x", None, None, [])], RESOLVED)
    none = spark.createDataFrame([], ENTITIES)
    added = reg.new_entities(none, resolved)
    assert {(r.parcel, r.version, r.borough, r.block, r.lot) for r in added.collect()} == {("1008350041", 1, 1, 835, 41), ("1000030004", 1, 1, 3, 4)}
    entities = spark.createDataFrame(added.collect(), ENTITIES)
    assert reg.new_entities(entities, resolved).count() == 0
    keys = spark.createDataFrame([(r.entity_id, "1012345") for r in entities.collect()], "entity_id string, scan_key string")
    changes = reg.next_key_sets(entities, keys, resolved)
    next_entities, next_keys = reg.apply_key_sets(entities, changes)
    assert {(r.parcel, r.version) for r in next_entities.collect()} == {("1008350041", 2), ("1000030004", 1)}
    assert sorted(r.scan_key for r in next_keys.collect()) == ["1012345", "1012345", "1012346"]
    old = spark.createDataFrame([(1, "CHECKED", None, "r", "r", None, None, None, "e")], COVERAGE)
    (one,) = reg.reset_coverage(old, spark.createDataFrame([(1, 2, ["a"], True), (2, 1, ["b"], False)], "entity_id int, version int, keys array<string>, changed boolean")).collect()
    assert (one.status, one.status_reason, one.last_attempt_run_id, one.last_success_run_id, one.last_error) == ("NOT_CHECKED", "IDENTIFIERS_CHANGED", None, "r", None)
    inputs = spark.createDataFrame([("ADDRESS", "a", "1")], "input_type string, input string, entity_id string")
    assert [r.input for r in reg.new_inputs(inputs, spark.createDataFrame([("ADDRESS", "a", "2"), ("ADDRESS", "b", "3"), ("ADDRESS", "b", "4")], inputs.schema)).collect()] == ["b"]


def test_addresses_become_entities_and_are_found_again(spark):
    """Two addresses of one parcel, one of a known parcel with other buildings, one that fails; the second time all good ones are
    cached and nothing changes."""
    from wardline.operators import resolve

    resolved = spark.createDataFrame([
        (1, "1 A St", None, None, "1000010001", "1 A ST", None, None, ["1000002", "1000001"]), (2, "1 A Street", None, None, "1000010001", "1 A ST", None, None, ["1000001", "1000002"]),
        (3, "2 B St", None, None, "1000020002", "2 B ST", None, None, ["1000009"]), (4, "3 C St", "NO_CANDIDATES", None, None, None, None, None, None), (5, "4 D St", None, None, "1000030003", "4 D ST", None, None, []),
    ], "input_id int, key string, error string, entity_id string, parcel string, address string, base_parcel string, billing_parcel string, buildings array<string>")
    entities = spark.createDataFrame([("old", 3, "1000020002", None, None, "2 B ST", 1, 2, 2)], ENTITIES)
    registry = reg.Registry(entities, spark.createDataFrame([("ADDRESS", "9 Z St", "old")], "input_type string, input string, entity_id string"), spark.createDataFrame([("old", "1000008")], "entity_id string, scan_key string"), spark.createDataFrame([("old", "CHECKED", None, "r", "r", None, None, None, None)], COVERAGE.replace("entity_id int", "entity_id string")))
    first = reg.register(registry, resolved, "ADDRESS")
    by_parcel = {r.parcel: r for r in first.entities.collect()}
    assert {p: (r.version, r.address, r.lot) for p, r in by_parcel.items()} == {"1000020002": (4, "2 B ST", 2), "1000010001": (1, "1 A ST", 1), "1000030003": (1, "4 D ST", 3)}
    own = {by_parcel[p].entity_id: p for p in by_parcel}
    assert {(r.input, own[r.entity_id]) for r in first.inputs.collect()} == {("9 Z St", "1000020002"), ("1 A St", "1000010001"), ("1 A Street", "1000010001"), ("2 B St", "1000020002"), ("4 D St", "1000030003")}
    assert sorted((own[r.entity_id], r.scan_key) for r in first.entity_keys.collect()) == [("1000010001", "1000001"), ("1000010001", "1000002"), ("1000020002", "1000009")]
    assert {(own[r.entity_id], r.status, r.status_reason, r.last_success_run_id) for r in first.coverage.collect()} == {("1000010001", "NOT_CHECKED", "NEVER_INGESTED", None), ("1000030003", "NOT_CHECKED", "NO_VALID_BUILDING", None), ("1000020002", "NOT_CHECKED", "IDENTIFIERS_CHANGED", "r")}
    again = reg.register(first, resolved, "ADDRESS")
    for name in ("entities", "inputs", "entity_keys", "coverage"):
        assert sorted(map(str, getattr(again, name).collect())) == sorted(map(str, getattr(first, name).collect()))
    candidates = "input_id int, pos int, address string, label string, name string, layer string, borough string, confidence double, parcel string, building string, source_id string"
    none = [spark.createDataFrame([], s) for s in (candidates, "bbl string, borocode string, block string, lot string, address string", "building string, base_parcel string, map_parcel string, has_map boolean", "unit_parcel string, base_parcel string, unit string", "base_parcel string, billing_parcel string")]
    inputs = spark.createDataFrame([(1, "1 a st"), (2, "3 c st")], "input_id int, address string")
    known = first.inputs.where("input_type = 'ADDRESS'").withColumnRenamed("input", "key")
    found = resolve.resolve_addresses(inputs, none[0], known, *none[1:])
    assert {(r.input_id, r.status, own.get(r.entity_id)) for r in found.collect()} == {(1, "cached", "1000010001"), (2, "failed", None)}


def test_seed(spark):
    rows = [(f"100000000{k}", k % 3, "1", "0", "0", "a" if k % 4 else None) for k in range(10)] * 2
    records = spark.createDataFrame(rows, "bbl string, district int, borocode string, block string, lot string, address string")
    assert [r.parcel for r in reg.select_seed(records, [0, 1], 3).collect()] == ["1000000001", "1000000003", "1000000006"]


def test_geocoder(spark):
    feature = lambda **p: {"geometry": {"coordinates": [1.0, 2.5]}, "properties": p}
    reply = {"features": [feature(label=" 1 A St, NY ", layer="address", confidence="0.8", pad_bbl=1008350041), feature(label="b", addendum={"pad": {"bbl": "1008350042", "bin": " 1012345"}}, confidence="high"), feature(name="no label")]}
    replies = spark.createDataFrame([(1, "x", json.dumps(reply)), (2, "y", '{"features":[]}'), (3, "z", "oops")], "input_id int, address string, reply string")
    one, two = geocoder.candidates(replies).orderBy("pos").collect()
    assert (one.label, one.confidence, one.parcel, one.building, one.coordinates) == ("1 A St, NY", 0.8, "1008350041", None, [1.0, 2.5])
    assert (two.confidence, two.parcel, two.building) == (None, "1008350042", "1012345")
    assert {r.input_id: r.status for r in geocoder.reply_status(replies).collect()} == {1: "FOUND", 2: "NO_CANDIDATES", 3: "MALFORMED"}
    lines = spark.createDataFrame([("start",), (' {"a": 1} ',), ("{broken",), ("[1]",)], "value string")
    assert [r.value for r in geocoder.json_lines(lines).collect()] == ['{"a": 1}']


def test_commands(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text('{"ID": "1"}\n{"id": 2}\n')
    assert main(["check", str(folder), "id"]) == 0
    (folder / "b.json").write_text('{"id": "1"}\n')
    assert main(["check", str(folder), "id"]) == 1
    assert main(["check", str(tmp_path / "none"), "id"]) == 2 and main(["what"]) == 2
