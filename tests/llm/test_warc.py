import gzip
import hashlib
import io

import pytest

from wardline.llm import warc

SCHEMA = "page_id long, url string, html string"


def brute(rows):
    first = {}
    for page_id, _, html in rows:
        b = (html or "").encode()
        if len(b) >= 100:
            first[b] = min(first.get(b, page_id), page_id)
    out = []
    for page_id, _, html in rows:
        b = (html or "").encode()
        again = len(b) >= 100 and first[b] != page_id
        out.append((page_id, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[b] if again else None))
    return sorted(out)


def run(spark, rows):
    return sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect())


@pytest.mark.parametrize("limit", [1, 1 << 20])
def test_round_trip(spark, monkeypatch, limit):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", limit)
    big = "WARC/1.1\r\n\r\n" * 60_000
    rows = [(5, "http://a/", "x" * 100), (2, None, "x" * 100), (9, "http://a/\r\nb", "x" * 99), (8, "", "x" * 99), (1, "u", None), (0, "u", ""), (7, "ü", "é" * 50), (6, "ü", "é" * 50), (3, "b", big), (4, "b", big), (10, "c", "\r\n\r\n" * 30)]
    assert run(spark, rows) == brute(rows)


def test_empty_null_and_repeated_ids(spark):
    assert run(spark, []) == []
    rows = [(None, "u", "y" * 200), (3, "u", "y" * 200), (4, "u", "z" * 200), (4, "u", "z" * 200)]
    got = warc.round_trip(spark.createDataFrame(rows, SCHEMA).coalesce(1)).select("page_id", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(3, "response", None), (None, "revisit", 3), (4, "response", None), (4, "revisit", 4)], key=str)


def test_files_are_plain_warc(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h/{i}", "t" * 150) for i in range(5)], SCHEMA).coalesce(1)
    folder = str(tmp_path)
    index = warc.normalise(warc.decisions(warc.capture(pages, folder)), folder).orderBy("page_id").collect()
    raw = next(p for p in tmp_path.iterdir() if p.name.startswith("raw-"))
    assert gzip.decompress(raw.read_bytes()).count(b"WARC-Type: response") == 5
    assert len((tmp_path / f"{index[0].archive}.idx").read_text().splitlines()) == 5
    data = (tmp_path / index[0].archive).read_bytes()
    for r in index:
        one = gzip.GzipFile(fileobj=io.BytesIO(data[r.offset : r.offset + r.length])).read()
        assert one.startswith(b"WARC/1.1\r\nWARC-Type: " + (b"response" if r.page_id == 0 else b"revisit")) and one.endswith(b"\r\n\r\n")


def test_stream_parser():
    data = b"".join(warc.record("response", i, None, "d", b"H\r\n\r\n", bytes([i]) * 1000 * i) for i in range(20))
    packed = gzip.compress(data[:30_000]) + gzip.compress(data[30_000:])
    assert [len(b) for _, b in warc.parsed(warc._inflated(io.BytesIO(packed)))] == [5 + 1000 * i for i in range(20)]
    with pytest.raises(ValueError):
        list(warc.parsed(iter([data[:-10]])))
