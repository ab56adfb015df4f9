"""WARC archives: raw captures in whole-file gzip streams, and their normaliser.

A capture task writes its pages as WARC records into one gzip stream for each archive, as a simple crawler does.
Such an archive can only be read from its start. The normaliser inflates every stream once, rewrites each record as
a gzip member of its own, turns repeated payloads into revisit records, and writes a sidecar index of offsets beside
the archive, so that any record can be read by one seek.

Only digests and positions are shuffled, never payloads. Archives are closed at ARCHIVE_BYTES of payload, which
bounds the work of one normaliser task; a file's name is fresh for each task attempt, and only files named in the
index table of the attempt that succeeded are ever read, so tasks may be lost and run again.

Defined cases: a null html is an empty payload; a null url leaves out WARC-Target-URI; payloads below
MIN_REVISIT_BYTES are always responses; of equal payloads, the smallest page_id is the response, a null page_id
counts as the largest, and of rows that repeat a page_id the first written is the response; extra columns are
ignored; no pages give no archives and no rows.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.storage import fresh_path, small_batches, spread, staged

MIN_REVISIT_BYTES = 100
ARCHIVE_BYTES = 32 << 20
CHUNK = 1 << 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"  # the tables hold no capture time

CAPTURES = "page_id long, archive string, ordinal int, payload_bytes long, payload_digest string"
RECORDS = "page_id long, archive string, offset long, length long"
READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long, length long"


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _record_id(page_id: int | None) -> str:
    return f"<urn:wardline:page:{'none' if page_id is None else page_id}>"


def _page_id(record_id: str) -> int | None:
    last = record_id.strip("<>").rpartition(":")[2]
    return None if last == "none" else int(last)


def _clean(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record(kind: str, page_id: int | None, url: str | None, digest: str, http: bytes, payload: bytes = b"", extra: tuple[tuple[str, str], ...] = ()) -> bytes:
    """One WARC/1.1 record; http is the block's HTTP head."""
    block = http + payload
    fields = [("WARC-Type", kind), ("WARC-Record-ID", _record_id(page_id)), ("WARC-Date", DATE), *([("WARC-Target-URI", _clean(url))] if url is not None else []), ("WARC-Payload-Digest", f"sha256:{digest}"), *extra, ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def _http(n: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()


def _inflated(stream) -> Iterator[bytes]:
    """The bytes of a gzip file of one or more members, in bounded pieces."""
    z = zlib.decompressobj(31)
    while data := stream.read(CHUNK):
        while data:
            if z.eof:
                z = zlib.decompressobj(31)
            yield z.decompress(data, CHUNK)
            data = z.unused_data if z.eof else z.unconsumed_tail
    while not z.eof and (rest := z.decompress(z.unconsumed_tail, CHUNK)):
        yield rest


def parsed(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record; holds one record at a time."""
    held = bytearray()

    def fill(until) -> bool:
        while not until():
            piece = next(pieces, None)
            if piece is None:
                return False
            held.extend(piece)
        return True

    while fill(lambda: b"\r\n\r\n" in held):
        head = bytes(held[: held.index(b"\r\n\r\n")])
        fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in head.decode().split("\r\n")[1:])}
        begin = len(head) + 4
        end = begin + int(fields["content-length"])
        if not fill(lambda: len(held) >= end + 4):
            raise ValueError("a WARC record is cut short")
        block = bytes(held[begin:end])
        del held[: end + 4]
        yield fields, block
    if held.strip():
        raise ValueError("bytes after the last WARC record")


def _captured(batches, folder: str, limit: int):
    """Writes pages as records of whole-file gzip streams; yields a row for each."""
    system, root = _fs(folder)
    system.create_dir(root, recursive=True)
    out = z = None
    size = ordinal = 0
    name = ""

    def close():
        if out is not None:
            out.write(z.flush())
            out.close()

    for batch in batches:
        rows: list[tuple] = []
        for page_id, url, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True):
            if out is None or size >= limit:
                close()
                name = f"raw-{uuid.uuid4().hex}.warc.gz"
                out, z, size, ordinal = system.open_output_stream(f"{root}/{name}", compression=None), zlib.compressobj(1, zlib.DEFLATED, 31), 0, 0
            payload = (html or "").encode()
            digest = hashlib.sha256(payload).hexdigest()
            out.write(z.compress(record("response", page_id, url, digest, _http(len(payload)), payload)))
            rows.append((page_id, name, ordinal, len(payload), digest))
            size, ordinal = size + len(payload), ordinal + 1
        if rows:
            yield _batch(rows, CAPTURES)
    close()


_TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[t]) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])


def capture(pages: DataFrame, folder: str) -> DataFrame:
    """Writes the raw archives; a row for each record: which archive, its place in it, and the payload's digest."""
    small_batches(pages.sparkSession)
    return staged(pages.select("page_id", "url", "html").mapInArrow(lambda it: _captured(it, folder, ARCHIVE_BYTES), CAPTURES), "captures")


def decisions(captures: DataFrame) -> DataFrame:
    """captures with ``revisit`` and ``refers_to``: the digest's first record stays a response."""
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "archive", "ordinal")
    repeated = captures.where(F.col("payload_bytes") >= MIN_REVISIT_BYTES).groupBy("payload_digest").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1")
    joined = captures.join(repeated.select("payload_digest", "first"), "payload_digest", "left")
    other = (F.col("first.archive") != F.col("archive")) | (F.col("first.ordinal") != F.col("ordinal"))
    again = F.coalesce((F.col("payload_bytes") >= MIN_REVISIT_BYTES) & other, F.lit(False))
    return joined.select("page_id", "archive", "ordinal", again.alias("revisit"), F.when(again, F.col("first.page_id")).alias("refers_to"))


class _Archive:
    """One normalised archive with its sidecar, both written as they grow."""

    def __init__(self, system, root: str, raw: str):
        self.system, self.name = system, f"{raw.removeprefix('raw-').removesuffix('.warc.gz')}-{uuid.uuid4().hex[:8]}.warc.gz"
        self.out = system.open_output_stream(f"{root}/{self.name}", compression=None)
        self.side = system.open_output_stream(f"{root}/{self.name}.idx", compression=None)
        self.at, self.ordinal = 0, -1
        self.source = system.open_input_stream(f"{root}/{raw}", compression=None)
        self.records = parsed(_inflated(self.source))

    def add(self, wanted: int, revisit: bool, refers_to: int | None) -> tuple[int | None, str, int, int]:
        fields, block = next(self.records)
        self.ordinal += 1
        if self.ordinal != wanted:
            raise ValueError(f"{self.name}: record {self.ordinal} where {wanted} was due")
        page_id = _page_id(fields["warc-record-id"])
        head = block[: block.index(b"\r\n\r\n") + 4]
        args = (page_id, fields.get("warc-target-uri"), fields["warc-payload-digest"].removeprefix("sha256:"), head)
        data = record("revisit", *args, extra=(("WARC-Profile", PROFILE), ("WARC-Refers-To", _record_id(refers_to)))) if revisit else record("response", *args, block[len(head) :])
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        member = z.compress(data) + z.flush()
        self.out.write(member)
        place = (page_id, self.name, self.at, len(member))
        self.side.write((json.dumps({"record": fields["warc-record-id"], "offset": self.at, "length": len(member)}) + "\n").encode())
        self.at += len(member)
        return place

    def close(self) -> None:
        if next(self.records, None) is not None:
            raise ValueError(f"{self.name}: more records than decisions")
        for x in (self.source, self.out, self.side):
            x.close()


def _normalised(batches, folder: str):
    """Decisions come sorted by archive and ordinal; each archive's stream is inflated once beside them."""
    system, root = _fs(folder)
    raw, archive = None, None
    for batch in batches:
        rows: list[tuple] = []
        for name, ordinal, revisit, refers_to in zip(*(batch.column(c).to_pylist() for c in ("archive", "ordinal", "revisit", "refers_to")), strict=True):
            if name != raw:
                if archive:
                    archive.close()
                raw, archive = name, _Archive(system, root, name)
            rows.append(archive.add(ordinal, revisit, refers_to))
        if rows:
            yield _batch(rows, RECORDS)
    if archive:
        archive.close()


def normalise(decided: DataFrame, folder: str) -> DataFrame:
    """Rewrites the raw archives; returns the sidecar index as a table."""
    spark = decided.sparkSession
    dealt = decided.repartition(spread(spark), "archive").sortWithinPartitions("archive", "ordinal")
    return staged(dealt.mapInArrow(lambda it: _normalised(it, folder), RECORDS), "warc-index")


def _read(batches, folder: str):
    system, root = _fs(folder)
    name, source = None, None
    for batch in batches:
        rows: list[tuple] = []
        for archive, offset, length in zip(*(batch.column(c).to_pylist() for c in ("archive", "offset", "length")), strict=True):
            if archive != name:
                name, source = archive, system.open_input_file(f"{root}/{archive}")
            source.seek(offset)
            (fields, block), *more = parsed(iter([zlib.decompress(source.read(length), 31)]))
            if more:
                raise ValueError(f"{archive}: more than one record in the member at {offset}")
            head, _, payload = block.partition(b"\r\n\r\n")
            n = int(head.decode().rpartition("Content-Length: ")[2])
            kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha256:")
            if kind == "response" and (len(payload) != n or hashlib.sha256(payload).hexdigest() != digest):
                raise ValueError(f"{archive}: the payload at {offset} differs from its digest")
            refers_to = _page_id(fields["warc-refers-to"]) if kind == "revisit" else None
            rows.append((_page_id(fields["warc-record-id"]), fields.get("warc-target-uri"), n, digest, kind, refers_to, archive, offset, length))
        if rows:
            yield _batch(rows, READ)


def read_archives(index: DataFrame, folder: str) -> DataFrame:
    """A row for each record, read from the archives by its index entry and checked against its digest."""
    spark = index.sparkSession
    dealt = index.repartition(spread(spark), "archive").sortWithinPartitions("archive", "offset")
    return dealt.mapInArrow(lambda it: _read(it, folder), READ)


def round_trip(pages: DataFrame) -> DataFrame:
    """Pages written as raw archives, normalised, and read back."""
    folder = fresh_path(pages.sparkSession, "warc")
    return read_archives(normalise(decisions(capture(pages, folder)), folder), folder)
