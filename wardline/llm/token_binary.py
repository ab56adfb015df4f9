"""Token ids of a corpus in binary shards: frequency-ranked ids, byte-aligned variable-length coding, control bytes apart.

1. Texts are encoded by the tokenizers library, in pieces, as the vocabulary's byte-level rules always start a new
   pre-token at a blank or line feed between two other characters, and at a mark behind a letter or digit. numpy cuts a group
   of texts at once, Arrow names each piece of the group once; a worker keeps the ids of pieces it has met, the library
   encodes all others of the group together, and numpy gathers the ids of the texts.
2. Ids are counted over the whole corpus (at most one row for each id) and ranked by frequency.
3. Documents are dealt in ranges of doc_id, sorted, and written: each id as the 1 to 4 bytes of its rank, with four 2-bit
   lengths in each control byte. A shard is closed at SHARD_TOKENS ids and carries its rank table; its blocks of
   BLOCK_IDS ids carry their directories.
4. Shards are decoded by numpy with table lookups.

Text is encoded once: the ids of step 1 are kept, compressed, in the shared folder. Rows of one doc_id and text, such as a
mixture repeats, are one entry with a number of copies: those that stand together from step 1 on, all others in their block,
whose directory has the number. Each copy counts in sizes and starts, and comes out as a row.

Defined cases: a null text is empty and has the end id alone; a null doc_id comes first; rows that repeat a doc_id stay
apart, in the order of their ids' bytes; special strings inside texts are handled as by the library; extra columns are
ignored; no rows give no shards.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardline.llm.pieces import byte_letters, tokenizer
from wardline.llm.storage import fresh_path, small_batches, spread, staged

END_ID = 2
#: Ids of a shard and of a block, the most that a task holds at once beside its longest document.
SHARD_TOKENS, BLOCK_IDS = 32 << 20, 1 << 20
#: Bytes of text that are cut and looked up at once, beside the last batch's; pieces that a worker keeps, and their most bytes.
GROUP_BYTES = 4 << 20
CACHE_ROWS, CACHE_BYTES = 1_000_000, 64
MAGIC = b"WLTOK2\n"

#: One pre-token: letters that every Unicode version calls letters, and the blank before them.
_WORD = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
#: What a byte may be at a cut. SPACE: cut before it; MARK: cut before it, behind ALNUM; FIRST, LAST: a character that is no
#: white space may begin, end so; OPENS: a special string begins so; WIDE: no ASCII.
_SPACE, _MARK, _ALNUM, _FIRST, _LAST, _OPENS, _WIDE = (1 << k for k in range(7))


def _kinds(special: list[bytes]):
    import numpy as np

    kinds = np.zeros(256, np.uint8)
    for c in range(256):
        if 0x20 < c < 0x7F:
            kinds[c] = _FIRST | _LAST | (_ALNUM if chr(c).isalnum() else _MARK)
        elif c >= 0x80:  # white space outside ASCII begins with C2, E1, E2 or E3
            kinds[c] = _WIDE | _LAST | (_FIRST if c >= 0xC3 and c not in (0xE1, 0xE2, 0xE3) else 0)
    kinds[list(b" \n")] = _SPACE
    for text in special:  # never cut inside
        kinds[list(text)] &= np.uint8(0xFF ^ _SPACE ^ _MARK)
        kinds[text[0]] |= _OPENS
    return kinds


@cache
def _rules(path: str):
    """The library with no rules but white space, for words in byte letters; which ids begin a word there; the kinds of bytes."""
    import numpy as np
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import WhitespaceSplit

    library, letters = tokenizer(path), byte_letters()
    split = Tokenizer.from_str(library.to_str())
    split.pre_tokenizer = WhitespaceSplit()
    known = library.get_vocab()
    begins = np.zeros(max(known.values()) + 1, bool)
    begins[[i for t, i in known.items() if t.startswith(letters[0x20]) or t == letters[0x0A]]] = True
    return split, begins, _kinds([t.content.encode() for t in library.get_added_tokens_decoder().values()])


class Encoder:
    """Ids of texts, little-endian unsigned integers of ``width`` bytes."""

    def __init__(self, path: str):
        import numpy as np

        self.library = tokenizer(path)
        self.split, self.begins, self.kinds = _rules(path)
        self.width = 2 if self.library.get_vocab_size() <= 1 << 16 else 4
        self.written = lambda ids: np.array(ids, f"<u{self.width}")
        self.between = {b: c for b, c in byte_letters().items() if b != 0x09}
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def cuts(self, data, starts, ends):
        """Where pieces begin, given the bytes of all texts and where each text that is not empty begins and ends."""
        import numpy as np

        kinds = self.kinds[data]
        at = np.flatnonzero(kinds[1:-1] & (_SPACE | _MARK)) + 1
        here, before, after = kinds[at], kinds[at - 1], kinds[at + 1]
        # a special string behind white space takes no blank from it, so it needs a character that surely is none
        space = (here & _SPACE > 0) & (before & _LAST > 0) & (after & _FIRST > 0) & ((before & _WIDE == 0) | (after & _OPENS == 0))
        cut = np.zeros(len(data), bool)
        cut[at[space | (here & _MARK > 0) & (before & _ALNUM > 0)]] = True
        lines = at[space]
        cut[lines[data[lines] == 0x0A] + 1] = True
        cut[ends - 1] = False  # what follows there is another text
        cut[starts] = True
        return np.flatnonzero(cut)

    def words(self, words: list[bytes]) -> list[bytes]:
        """Ids of words that are one pre-token each. The blank before a word shows where its ids begin; a line feed is put before others."""
        import numpy as np

        if not words:
            return []
        marked = [x if x[0] == 0x20 else b"\n\t" + x for x in words]
        lines = [b"\t".join(marked[k : k + 500]).decode("latin-1").translate(self.between) for k in range(0, len(marked), 500)]
        ids = np.concatenate([self.written(e.ids) for e in self.split.encode_batch_fast(lines, add_special_tokens=False)])
        raw, w = ids.tobytes(), self.width
        at = [*(w * np.flatnonzero(self.begins[ids])).tolist(), len(raw)]
        return [raw[a if x[0] == 0x20 else a + w : b] for x, a, b in zip(words, at[:-1], at[1:], strict=True)]

    def values(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each of these pieces, which differ, from the cache as far as it has them."""
        found = list(map(self.young.get, pieces))
        absent = [i for i, x in enumerate(found) if x is None]
        keys = [pieces[i] for i in absent]
        got = list(map(self.old.get, keys))
        new = [j for j, x in enumerate(got) if x is None]
        lone = [j for j in new if _WORD.fullmatch(keys[j])]
        for j, value in zip(lone, self.words([keys[j] for j in lone]), strict=True):
            got[j] = value
        others = [j for j in new if got[j] is None]
        for j, e in zip(others, self.library.encode_batch_fast([keys[j].decode() for j in others], add_special_tokens=False), strict=True):
            got[j] = self.written(e.ids).tobytes()
        for i, value in zip(absent, got, strict=True):
            found[i] = value
        half = max(1, CACHE_ROWS // 2)
        for k in range(0, len(keys), half):
            if len(self.young) + min(half, len(keys) - k) > half:
                self.old, self.young = self.young, {}
            self.young.update((x, v) for x, v in zip(keys[k : k + half], got[k : k + half], strict=True) if len(x) <= CACHE_BYTES)
        return found

    def encode_all(self, texts: list[str]):
        """The ids of all texts, one after the other, and where each ends."""
        import numpy as np

        raw = [t.encode() for t in texts]
        sizes = np.array([len(x) for x in raw], np.int64)
        data, ends = np.frombuffer(b"".join(raw), np.uint8), np.cumsum(sizes)
        if not len(data):
            return np.zeros(0, f"<u{self.width}"), ends
        at = self.cuts(data, (ends - sizes)[sizes > 0], ends[sizes > 0])
        named = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(np.append(at, len(data)).astype(np.int32)), pa.py_buffer(data)]).dictionary_encode()
        values = self.values(named.dictionary.to_numpy(zero_copy_only=False).tolist())
        # texts of under 2^31 bytes have fewer ids
        table, n = np.frombuffer(b"".join(values), f"<u{self.width}"), np.array([len(x) for x in values], np.int32) // self.width
        which = named.indices.to_numpy()
        many = n[which]
        last = np.cumsum(many, dtype=np.int32)
        from_ = (np.cumsum(n, dtype=np.int32) - n)[which] - last + many
        ids = table[np.repeat(from_, many) + np.arange(last[-1], dtype=np.int32)]
        return ids, np.append(0, last)[np.searchsorted(at, ends)]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0].tobytes()


@cache
def worker_encoder(path: str) -> Encoder:
    """One for each Python worker, which keeps its pieces from task to task."""
    return Encoder(path)


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int | None, str]]]:
    """doc_id and text of the rows of batches that follow one another, about GROUP_BYTES at once."""
    rows, held = [], 0
    for batch in batches:
        rows += zip(batch.column("doc_id").to_pylist(), (t or "" for t in batch.column("text").to_pylist()), strict=True)
        held += batch.column("text").nbytes
        if held >= GROUP_BYTES:
            yield rows
            rows, held = [], 0
    if rows:
        yield rows


def _packed(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    import numpy as np
    import zstandard

    names = ["doc_id", "n", "copies", "ids", "tally"]
    encoder = worker_encoder(path)
    width = encoder.width
    end = np.array([END_ID], f"<u{width}").tobytes()
    pack = zstandard.ZstdCompressor(level=1).compress
    total = np.zeros(END_ID + 1, np.int64)
    for rows in _grouped(batches):
        runs = [(*row, sum(1 for _ in same)) for row, same in groupby(rows)]
        docs, copies = ([r[k] for r in runs] for k in (0, 2))
        ids, ends = encoder.encode_all([t for _, t, _ in runs])
        parts = [ids[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
        packed = [pack(bytes([width]) + x.tobytes() + end) for x in parts]
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array([len(x) + 1 for x in parts], pa.int64()), pa.array(copies, pa.int64()), pa.array(packed, pa.binary()), pa.nulls(len(runs), pa.binary())], names=names)
        n = np.bincount(np.concatenate([ids, *(np.tile(x, k - 1) for x, k in zip(parts, copies, strict=True) if k > 1)]), minlength=len(total))
        n[END_ID] += sum(copies)
        n[: len(total)] += total
        total = n
    yield pa.RecordBatch.from_arrays([pa.array([None], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.binary())] + [pa.array([pack(total.astype("<i8").tobytes())], pa.binary())], names=names)


def unpacked(data: bytes):
    import numpy as np
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(data)
    return np.frombuffer(raw, np.uint16 if raw[0] == 2 else np.uint32, offset=1).astype(np.uint32)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n, copies, ids, tally), kept in the shared folder. A row for each document, its n ids packed, and for its copies
    that follow it in a group; and one for each task, without ids, with the task's count of every id."""
    small_batches(docs.sparkSession)
    return staged(docs.select("doc_id", "text").mapInArrow(lambda it: _packed(it, path), "doc_id long, n long, copies long, ids binary, tally binary"), "ids", "none")


def _tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import numpy as np
    import zstandard

    total = np.zeros(0, np.int64)
    for batch in batches:
        for data in batch.column("tally").to_pylist():
            n = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), "<i8").copy()
            short, long = sorted((n, total), key=len)
            long[: len(short)] += short
            total = long
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["id", "n"])


def ranking(encoded: DataFrame) -> list[int]:
    """Ids from the most to the least frequent; as many as the vocabulary has at most."""
    counts = encoded.where(F.col("tally").isNotNull()).select("tally").mapInArrow(_tallied, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    return [r.id for r in sorted(counts.collect(), key=lambda r: (-r.n, r.id))]


def pack_ranks(ranks) -> tuple[bytes, bytes]:
    """Control bytes (four 2-bit lengths each, low bits first) and data bytes (little-endian, leading zeros left out)."""
    import numpy as np

    ranks = np.ascontiguousarray(ranks, "<u4")
    extra = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    quads = np.zeros((-(-len(ranks) // 4), 4), np.uint8)
    quads.ravel()[: len(ranks)] = extra
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    width = 2 if ranks.max(initial=0) <= 0xFFFF else 4
    data = ranks.astype(f"<u{width}").view(np.uint8).reshape(-1, width)[np.arange(width) <= extra[:, None]]
    return control.tobytes(), data.tobytes()


def unpack_ranks(control: bytes, data: bytes, n: int):
    """The ranks again: a table gives each control byte's four lengths, another each length's mask."""
    import numpy as np

    lengths = np.array([[1 + (c >> 2 * k & 3) for k in range(4)] for c in range(256)], np.int64)
    masks = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)
    sizes = lengths[np.frombuffer(control, np.uint8)].ravel()[:n]
    starts = np.cumsum(sizes) - sizes
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    words = raw[starts].astype(np.uint32)
    for k in range(1, int(sizes.max(initial=1))):
        words |= raw[starts + k].astype(np.uint32) << np.uint32(8 * k)
    return words & masks[sizes]


class ShardWriter:
    """A shard: magic, size and table of ranked ids, then blocks of whole documents. A block: size and JSON of its
    header, its directory, control bytes, data bytes. Holds one block at a time."""

    def __init__(self, out, ranked):
        import numpy as np

        self.out, self.n_ids = out, 0
        self.rank_of = np.zeros(int(ranked.max()) + 1 if len(ranked) else 1, np.uint32)
        self.rank_of[ranked] = np.arange(len(ranked), dtype=np.uint32)
        self._clear()
        out.write(MAGIC + struct.pack("<I", len(ranked)) + ranked.astype("<u4").tobytes())

    def _clear(self) -> None:
        self.docs: list[int | None] = []
        self.copies: list[int] = []
        self.ids: list = []
        self.held = 0

    def add(self, doc_id: int | None, ids, copies: int = 1) -> None:
        """Copies count as ids of the shard and of the block, which has them once."""
        while copies:
            if self.held and self.held + len(ids) > BLOCK_IDS:
                self.flush()
            n = min(copies, max(1, (BLOCK_IDS - self.held) // max(1, len(ids))))
            self.docs.append(doc_id)
            self.copies.append(n)
            self.ids.append(ids)
            self.held += n * len(ids)
            self.n_ids += n * len(ids)
            copies -= n

    def flush(self) -> None:
        import numpy as np

        if not self.docs:
            return
        ids = np.concatenate(self.ids)
        control, data = pack_ranks(self.rank_of[ids])
        directory = np.array([0 if d is None else d for d in self.docs], "<i8").tobytes() + np.array([d is None for d in self.docs], np.uint8).tobytes() + np.array(list(map(len, self.ids)), "<i8").tobytes() + np.array(self.copies, "<i8").tobytes()
        header = json.dumps({"docs": len(self.docs), "ids": len(ids), "control": len(control), "data": len(data)}).encode()
        for part in (struct.pack("<I", len(header)), header, directory, control, data):
            self.out.write(part)
        self._clear()

    def close(self) -> None:
        self.flush()
        self.out.close()


def read_shard(source) -> Iterator[tuple[list[int | None], list[int], list[int], object]]:
    """doc_ids, sizes, numbers of copies and ids of each block of a shard; the ids of copies are there once."""
    import numpy as np

    if source.read(len(MAGIC)) != MAGIC:
        raise ValueError("not a token shard")
    (n,) = struct.unpack("<I", source.read(4))
    ranked = np.frombuffer(source.read(4 * n), "<u4")
    while size := source.read(4):
        h = json.loads(source.read(*struct.unpack("<I", size)))
        docs, none, sizes, copies = (np.frombuffer(source.read(w * h["docs"]), kind).tolist() for w, kind in ((8, "<i8"), (1, "u1"), (8, "<i8"), (8, "<i8")))
        control, data = source.read(h["control"]), source.read(h["data"])
        yield [None if x else d for d, x in zip(docs, none, strict=True)], sizes, copies, ranked[unpack_ranks(control, data, h["ids"])]


SHARDS = "range_no int, shard_no int, file string, n_ids long"


def _written(batches: Iterator[pa.RecordBatch], folder: str, ranked, limit: int) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs
    from pyspark import TaskContext

    worker_encoder.cache_clear()  # this worker needs the room
    system, root = fs.FileSystem.from_uri(folder)
    system.create_dir(root, recursive=True)
    range_no, made = TaskContext.get().partitionId(), []
    shard, name = None, ""

    def close():
        shard.close()
        made.append((range_no, len(made), name, shard.n_ids))

    rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "ids", "copies")), strict=True))
    for (doc_id, data), same in groupby(rows, lambda row: row[:2]):
        ids, left = unpacked(data), sum(copies for _, _, copies in same)
        while left:
            if shard is not None and shard.n_ids + len(ids) > limit:
                close()
                shard = None
            if shard is None:
                name = f"{range_no:06d}-{len(made):06d}-{uuid.uuid4().hex[:12]}.tokens"
                shard = ShardWriter(system.open_output_stream(f"{root}/{name}", compression=None), ranked)
            n = min(left, max(1, (limit - shard.n_ids) // len(ids)))  # there is an end id at least
            shard.add(doc_id, ids, n)
            left -= n
    if shard is not None:
        close()
    types = (pa.int32(), pa.int32(), pa.string(), pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], t) for k, t in enumerate(types)], names=["range_no", "shard_no", "file", "n_ids"])


def write_shards(encoded: DataFrame, folder: str) -> DataFrame:
    """Writes the shards in ascending order of doc_id; a row for each, with the ids of all shards before it."""
    import numpy as np

    spark = encoded.sparkSession
    ranked = spark.sparkContext.broadcast(np.array(ranking(encoded), np.uint32))
    dealt = encoded.where(F.col("ids").isNotNull()).repartitionByRange(spread(spark), "doc_id").sortWithinPartitions("doc_id", "ids")
    limit = SHARD_TOKENS
    shards = staged(dealt.select("doc_id", "ids", "copies").mapInArrow(lambda it: _written(it, folder, ranked.value, limit), SHARDS), "shards")
    # sums within each range, and over the ranges, of which there are as many as partitions
    before = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = shards.groupBy("range_no").agg(F.sum("n_ids").alias("n_ids")).select("range_no", before(Window.orderBy("range_no")).alias("range_start"))
    within = shards.withColumn("start", before(Window.partitionBy("range_no").orderBy("shard_no")))
    return within.join(ranges, "range_no").select("file", "n_ids", (F.col("range_start") + F.col("start")).alias("start"))


READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _decoded(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(folder)
    for batch in batches:
        for file, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
            with system.open_input_file(f"{root}/{file}") as source:
                for docs, sizes, copies, ids in read_shard(source):
                    raw, at, rows = memoryview(ids.astype("<u4").tobytes()), 0, []
                    for doc_id, n, k in zip(docs, sizes, copies, strict=True):
                        crc = zlib.crc32(raw[4 * at : 4 * (at + n)])
                        rows += ((doc_id, start + i * n, n, crc) for i in range(k))
                        at += n
                        start += k * n
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_shards(shards: DataFrame, folder: str) -> DataFrame:
    """A row for each document, from the files alone."""
    dealt = shards.select("file", "start").repartition(spread(shards.sparkSession), "file")
    return dealt.mapInArrow(lambda it: _decoded(it, folder), READ)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    folder = fresh_path(docs.sparkSession, "tokens")
    return read_shards(write_shards(encode(docs, path), folder), folder)
