import json
import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from wardline.operators.merge import first_wins, last_wins
from wardline.sources import changes, landing
from wardline.streaming import versions

#: Where the fake source keeps its rows and writes down what it was asked; tasks find it by this name.
FOLDER = "WARDLINE_FAKE_SOURCE"


class Client:
    """Rows in a file beside the one that each request is noted in."""

    def __init__(self):
        self.folder = Path((Path("/tmp") / FOLDER).read_text())

    def rows(self):
        return sorted((tuple(json.loads(x)) for x in (self.folder / "rows").read_text().splitlines()), key=lambda r: (r[1], r[2]))

    def __call__(self, ask):
        found = [r for r in self.rows() if (ask.keys is None or r[0] in ask.keys) and (ask.after is None or r[1:3] > ask.after) and (ask.until is None or r[1:3] <= ask.until)][: ask.limit]
        with open(self.folder / "asked", "a") as f:
            f.write(json.dumps([ask.keys, ask.after, ask.until, [r[2] for r in found]]) + "\n")
        return found

    def newest(self):
        return max((r[1:3] for r in self.rows()), default=None)


def client():
    return Client()


class Fake:
    def __init__(self, folder):
        self.folder = folder
        (folder / "rows").write_text("")
        self.asked()

    def add(self, *rows):
        with open(self.folder / "rows", "a") as f:
            f.writelines(json.dumps(r) + "\n" for r in rows)

    def asked(self):
        """What has been asked since the last call."""
        path = self.folder / "asked"
        found = [json.loads(x) for x in path.read_text().splitlines()] if path.exists() else []
        path.write_text("")
        return found


@pytest.fixture
def fake(spark, tmp_path):
    (Path("/tmp") / FOLDER).write_text(str(tmp_path))
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")  # of state: a handful of keys
    yield Fake(tmp_path)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)


def row(source_id, at, key="1000001", row_id=None, **more):
    at = f"2026-01-{at:02d}T00:00:00.000Z"
    row_id = row_id or f"row-{source_id}-{at}"
    return (key, at, row_id, json.dumps({"isn_dob_bis_extract": source_id, ":id": row_id, ":updated_at": at, "bin": key, "balance_due": "1.50"} | more))


def read(spark, **options):
    return changes.table(spark, "tests.test_changes:client", **options)


def test_filters_become_requests(spark, fake):
    fake.add(*(row(f"s{k}", 1 + k % 20, f"{1000000 + k % 7}") for k in range(140)))
    assert read(spark).count() == 140
    (one, *_) = fake.asked()
    assert one[:3] == [None, None, None]
    wanted = read(spark).where(F.col("scan_key").isin("1000001", "1000003", "1000005") & (F.col("updated") > "2026-01-04T00:00:00.000Z") & (F.col("updated") <= "2026-01-09T00:00:00.000Z") & F.col("payload").contains("s1"))
    plan = wanted._jdf.queryExecution().executedPlan().toString()  # Spark filters by what the source has not taken alone
    assert "Filter (isnotnull(payload" in plan and "isin" not in plan and " IN " not in plan and "updated#" in plan and "(updated#" not in plan and wanted.rdd.getNumPartitions() == 1
    expected = sorted(r.row_id for r in read(spark).collect() if r.scan_key in ("1000001", "1000003", "1000005") and "2026-01-05" <= r.updated[:10] <= "2026-01-09" and "s1" in r.payload)
    fake.asked()
    assert sorted(r.row_id for r in wanted.collect()) == expected
    asked = fake.asked()
    assert [a[0] for a in asked] == [["1000001", "1000003", "1000005"]] and asked[0][1][0] == "2026-01-04T00:00:00.000Z" and asked[0][2][0] == "2026-01-09T00:00:00.000Z"
    assert sum(len(a[3]) for a in asked) < 140 / 4  # the rest never left the source
    dealt = read(spark, keys_per_request=2, page_size=4).where("scan_key IN ('1000000', '1000002', '1000004') AND updated >= '2026-01-02T00:00:00.000Z' AND updated < '2026-01-11T00:00:00.000Z'")
    rows = dealt.collect()
    asked = fake.asked()
    assert {tuple(a[0]) for a in asked} == {("1000000", "1000002"), ("1000004",)} and sorted(x for a in asked for x in a[3]) == sorted(r.row_id for r in rows) and {r.updated[8:10] for r in rows} <= {f"{d:02d}" for d in range(2, 11)}
    assert len(rows) == sum(k % 7 in (0, 2, 4) and 2 <= 1 + k % 20 <= 10 for k in range(140))
    assert read(spark).where("scan_key = '1000001' AND scan_key = '1000002'").count() == 0 and read(spark).where("scan_key = '1000001' OR updated = 'x'").count() == 20


def batch_form(spark, batches):
    """What ranking all rows that ever came gives. batches: lists of payloads, in their order."""
    rows = landing.parsed(spark.createDataFrame([(p, n) for n, ps in enumerate(batches) for p in ps], "payload string, batch_id int"), "batch_id")
    raw = first_wins(rows.where("source_id IS NOT NULL AND updated_text IS NOT NULL"), ["source_id", "updated_text"], ["batch_id", "payload"])
    good = last_wins(rows.where("error IS NULL"), ["source_id"], ["batch_id", "updated_at", "payload"])
    return sorted(map(str, raw.select("source_id", "updated_text", "payload").collect())), sorted(map(str, good.select(*landing.CANDIDATE).collect()))


def test_stream_asks_for_each_row_once_and_tells_versions(spark, fake, tmp_path):
    out = str(tmp_path / "out")
    batches = []

    def land(*rows, n=1, **options):
        fake.add(*rows)
        assert versions.land_changes(spark, "tests.test_changes:client", out, page_size=3, **options) == n
        asked = fake.asked()
        if n:
            batches.append([p for a in asked for i in a[3] for p in [next(r[3] for r in Client().rows() if r[2] == i)]])
        return asked

    first = [row(f"s{k}", 1 + k) for k in range(7)]
    asked = land(*first)
    assert sorted(i for a in asked for i in a[3]) == sorted(r[2] for r in first)
    assert land(n=0) == []
    # a version that comes again with another payload, a bad row, newer versions and one that changes nothing
    second = [row("s1", 10), row("s2", 10, balance_due="x"), row("s3", 11), row("s0", 12, issue_date="20260101"), row("s0", 12, row_id="row-zz", issue_date="20250101")]
    asked = land(*second, slices=3)
    assert sorted(i for a in asked for i in a[3]) == sorted(r[2] for r in second) and len({tuple(a[1]) for a in asked}) >= 3
    # late rows: not asked for without an overlap, asked for again with one, and told apart by state
    late = row("s5", 11, row_id="late")
    assert [i for a in land(late, row("s6", 13)) for i in a[3]] == ["row-s6-2026-01-13T00:00:00.000Z"]
    asked = land(row("s6", 14), overlap=3 * 86_400)
    assert {"late", "row-s6-2026-01-14T00:00:00.000Z", "row-s6-2026-01-13T00:00:00.000Z"} <= {i for a in asked for i in a[3]}
    told = [sorted(map(str, f(spark, out).collect())) for f in (versions.raw_versions, versions.candidates)]
    assert tuple(told) == batch_form(spark, batches)
    assert versions.news(spark, out).groupBy("source_id", "updated_text").agg(F.count_if(F.col("kind") == "version").alias("n")).where("n <> 1").count() == 0


def test_a_replayed_batch_asks_for_the_same_range(spark, fake, tmp_path):
    out = tmp_path / "out"
    fake.add(*(row(f"s{k}", 1 + k) for k in range(5)))
    versions.land_changes(spark, "tests.test_changes:client", str(out))
    before = fake.asked()
    told = sorted(map(str, versions.news(spark, str(out)).collect()))
    for name in ("0", ".0.crc"):  # as after a crash between the batch and its commit
        path = out / "checkpoint" / "commits" / name
        if path.exists():
            os.remove(path)
    fake.add(row("s9", 20))
    assert [versions.land_changes(spark, "tests.test_changes:client", str(out)) for _ in range(3)] == [1, 1, 0]
    replayed, fresh = fake.asked()
    assert [replayed] == before and fresh[3] == ["row-s9-2026-01-20T00:00:00.000Z"]
    assert sorted(map(str, versions.news(spark, str(out)).where("batch_id = 0").collect())) == told
    assert versions.raw_versions(spark, str(out)).count() == 6


def test_ranges():
    reader = changes.ChangesStreamReader({"client": "x:y", "slices": "4", "since": "2026-01-01T00:00:00.000Z"})
    a, b = {"updated": "2026-01-01T00:00:00.000Z", "row_id": ""}, {"updated": "2026-01-05T00:00:00.000Z", "row_id": "z"}
    asks = [p.ask for p in reader.partitions(a, b)]
    assert [x.after[0][8:10] for x in asks] == ["01", "02", "03", "04"] and asks[-1].until == ("2026-01-05T00:00:00.000Z", "z") and all(x.until == y.after for x, y in zip(asks, asks[1:], strict=False))
    assert [p.ask.keys for p in reader.partitions(b, b)] == [()]
    with pytest.raises(ValueError):
        changes.ChangesReader({"client": "x:y", "page_size": "0"})
