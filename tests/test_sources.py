import json

import pytest

from wardline.sources import paged
from wardline.streaming import landing_stream


def fake_client():
    """Three rows for each key; the first request of each task is refused once."""
    tries = []

    def client(keys, offset, limit):
        tries.append(1)
        if len(tries) == 1:
            raise paged.RemoteError(503)
        rows = [json.dumps({"bin": k, "n": n}) for k in keys for n in range(3)]
        return rows[offset : offset + limit]

    return client


def test_paged_source(spark):
    spark.dataSource.register(paged.PagedSource)
    read = spark.read.format("paged").option("client", "tests.test_sources:fake_client").option("batches", json.dumps([["a", "b"], ["c"]])).option("page_size", 2).load()
    assert read.rdd.getNumPartitions() == 2
    assert sorted((json.loads(r.payload)["bin"], json.loads(r.payload)["n"]) for r in read.collect()) == [(k, n) for k in "abc" for n in range(3)]


def test_paging_and_retries():
    client = paged.retrying(fake_client())
    assert len(list(paged.pages(client, ["a"], 2, 2))) == 3
    with pytest.raises(RuntimeError, match="FAILED_PAGE_LIMIT"):
        list(paged.pages(lambda *a: ["x"], ["a"], 1, 3))
    with pytest.raises(paged.RemoteError):
        paged.retrying(lambda: (_ for _ in ()).throw(paged.RemoteError(404)))()
    for keys in ([], ["b", "a"], ["a", "a"], [""], ["x" * 65], [str(k) for k in range(1001)]):
        with pytest.raises(ValueError):
            paged.checked_keys(keys)


def payload(source_id, at, **more):
    return json.dumps({"isn_dob_bis_extract": source_id, ":id": "r", ":updated_at": at, "BIN": "1000001"} | more)


def test_stream_lands_once_and_resumes(spark, tmp_path):
    incoming, out = tmp_path / "in", str(tmp_path / "out")
    incoming.mkdir()
    (incoming / "a.json").write_text("\n".join([payload("1", "2026-01-01"), payload("2", "2026-01-01", balance_due="oops"), "not json"]))
    landing_stream.land(spark, str(incoming), out)
    (incoming / "b.json").write_text("\n".join([payload("1", "2026-01-01", issue_date="20260101"), payload("1", "2026-01-02"), payload("3", "2026-01-01")]))
    landing_stream.land(spark, str(incoming), out)
    landing_stream.land(spark, str(incoming), out)
    raw = {(r.source_id, r.updated_text): json.loads(r.payload) for r in landing_stream.raw_versions(spark, out).collect()}
    assert set(raw) == {("1", "2026-01-01"), ("1", "2026-01-02"), ("2", "2026-01-01"), ("3", "2026-01-01")} and "issue_date" not in raw["1", "2026-01-01"]
    got = {r.source_id: r for r in landing_stream.candidates(spark, out).collect()}
    assert set(got) == {"1", "3"} and str(got["1"].updated_at).startswith("2026-01-02") and got["1"].scan_key == "1000001"
    errors = sorted(r.error for r in landing_stream.landed(spark, out).where("error IS NOT NULL").collect())
    assert errors == ["BALANCE:INVALID_NUMBER", "NOT_AN_OBJECT"]
