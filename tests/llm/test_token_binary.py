import io
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from wardline.llm import token_binary as tb

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["it's we'll  two", " lead", "trail ", "trail\n", "a\n\nb \n c", "<|endoftext|> x<|endoftext|>y", "tab\t x\x1c \x85 z", "é́ 日本 👩‍👩‍👧", "", " ", "\n", "a" * 3000, "one two " * 4000, "x  \n  ", "nbsp\xa0 a b"]


def direct(text):
    return [*tb.tokenizer(PATH).encode(text or "", add_special_tokens=False).ids, 2]


def ids(encoder, text):
    return np.frombuffer(encoder.encode(text), "<u2").tolist()


@pytest.mark.parametrize("limit", [100, 8 << 20])
def test_round_trip(spark, monkeypatch, limit):
    monkeypatch.setattr(tb, "SHARD_TOKENS", limit)
    monkeypatch.setattr(tb, "BLOCK_IDS", max(30, limit // 5000))
    texts = [*ODD, None, *ODD]
    rows = [(1000 - 7 * i, t, "x", 0) for i, t in enumerate(texts)] + [(None, "no id", "x", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, n long").repartition(3)
    want, start = [], 0
    for d, t, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = direct(t)
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = [tuple(r) for r in tb.round_trip(docs, PATH).collect()]
    assert sorted(got, key=lambda r: r[1]) == want
    assert tb.round_trip(docs.limit(0), PATH).count() == 0


def test_repeated_ids(spark):
    docs = spark.createDataFrame([(1, "same"), (1, "same"), (1, "other text")], "doc_id long, text string")
    got = tb.round_trip(docs, PATH).collect()
    assert sorted(r.n_tokens for r in got) == sorted(len(direct(t)) for t in ("same", "same", "other text"))


@pytest.mark.parametrize("limit", [1000, 8 << 20])
def test_repeated_rows_are_stored_once(spark, monkeypatch, limit):
    """A mixture's repeated rows take no more room, in ids as in shards, than single ones; each has its row and its place."""
    monkeypatch.setattr(tb, "SHARD_TOKENS", limit)
    rows = [(i, " ".join(f"{i}w{j * j}" for j in range(150))) for i in range(40)]
    many = [r for r in rows for _ in range(3)] + rows[::2]  # beside one another, and apart
    sizes = []
    for some in (rows, many):
        docs = spark.createDataFrame(some, "doc_id long, text string").coalesce(1)
        encoded, folder = tb.encode(docs, PATH), tb.fresh_path(spark, "tokens")
        got = [tuple(r) for r in tb.read_shards(tb.write_shards(encoded, folder), folder).orderBy("start").collect()]
        want, start = [], 0
        for d, t in sorted(some):
            x = direct(t)
            want.append((d, start, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
            start += len(x)
        assert got == want
        sizes.append((encoded.where("ids IS NOT NULL").count(), sum(p.stat().st_size for p in Path(folder.removeprefix("file:")).iterdir())))
    assert sizes[0][0] == 40 and sizes[1][0] == 60
    if limit > 1000:  # a small shard is full before its copies end
        assert sizes[1][1] <= sizes[0][1] + 1000


@given(st.lists(st.tuples(st.none() | st.integers(0, 9), st.lists(st.integers(0, 5), max_size=12), st.integers(1, 40)), max_size=12))
def test_blocks_bound_copies(runs):
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(tb, "BLOCK_IDS", 30)
        out = io.BytesIO()
        shard = tb.ShardWriter(out, np.array([3, 1, 4, 5, 0, 2], np.uint32))
        for run in runs:
            shard.add(run[0], np.array(run[1], np.uint32), run[2])
        shard.flush()
        out.seek(0)
        back = []
        for docs, sizes, copies, ids in tb.read_shard(out):
            assert sum(n * k for n, k in zip(sizes, copies, strict=True)) <= 30
            parts = np.split(ids, np.cumsum(sizes)[:-1])
            back += [(d, p.tolist()) for d, p, k in zip(docs, parts, copies, strict=True) for _ in range(k)]
        assert back == [(d, x) for d, x, k in runs for _ in range(k)] and shard.n_ids == sum(len(x) * k for _, x, k in runs)


@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=60))
def test_codec(ranks):
    control, data = tb.pack_ranks(ranks)
    assert len(control) == -(-len(ranks) // 4) and tb.unpack_ranks(control, data, len(ranks)).tolist() == ranks


def test_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(tb, "CACHE_ROWS", 5)
    e = tb.Encoder(PATH)
    for i in range(30):
        t = f"the word{i} is number {i} of a few"
        assert [*ids(e, t), 2] == direct(t)


@settings(max_examples=400, deadline=None, suppress_health_check=[HealthCheck.too_slow])
@given(st.lists(st.text(st.one_of(st.sampled_from(" \n\t'sdllAB1é<|>\xa0\x1c\x85́"), st.characters(codec="utf-8")), max_size=30), max_size=5))
def test_random_texts(texts):
    e = tb.Encoder(PATH)
    assert [ids(e, t) + [2] for t in texts] == [direct(t) for t in texts]


def test_words_first_met_at_a_line():
    e = tb.Encoder(PATH)
    for t in ["a One.\nTwo, b", "a \nTwo b", "a Two b", "x \n", "x\n", " \nTwo", "\nTwo x", "x  Two", "a\nTwo b", "a b\n\nTwo, c", "\x00Two x", "x \x00Two"] * 2:
        assert [*ids(e, t), 2] == direct(t), t


def test_words_and_marks():
    e = tb.Encoder(PATH)
    for t in ["The, The. THE, ÀÉÿß, Straße. ÆØÞ. aª º, µ", "x I.B.M. e.g., it's, 'll, a.,", *("w " + chr(c) + "x" + chr(c) + ", end" for c in range(0xC0, 0x180))]:
        assert [*ids(e, t), 2] == direct(t)


class Counted:
    def __init__(self, library):
        self.library, self.asked = library, []

    def encode_batch_fast(self, texts, **options):
        self.asked.append(len(texts))
        return self.library.encode_batch_fast(texts, **options)


def test_new_pieces_are_encoded_together():
    """Not a call of the library for each word that a worker meets for the first time."""
    e = tb.Encoder(PATH)
    e.library, e.split = Counted(e.library), Counted(e.split)
    texts = [" ".join(f"{chr(97 + i % 26) * (1 + j)}{chr(97 + i // 26)}é, x{i}-{j}\n{chr(65 + j)}ß" for j in range(20)) for i in range(200)]
    for asked in (1, 2):  # what is known is not asked for again
        got, ends = e.encode_all(texts)
        assert [p.tolist() for p in np.split(got, ends[:-1])] == [direct(t)[:-1] for t in texts]
        assert len(e.split.asked) == 1 and len(e.library.asked) == asked and sum(e.library.asked) < 5000


PARTS = ["a", "Zé", "ß", "'s", "'", "<|endoftext|>", "<", "|", ">", ".", ",", "###", "7", " ", "  ", "\n", "\t", "\r", "\x0b", "\x1c", "\x7f", "\x85", "\xa0", "\xad", "\u1680", "\u180e", "\u2003", "\u200b", "\u2028", "\u3000", "“", "e\u0301", "×", "÷", "日", "👩", "Ġ", "Ċ"]
ENCODER = tb.Encoder(PATH)


@settings(max_examples=600, deadline=None, suppress_health_check=[HealthCheck.too_slow])
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=14).map("".join), max_size=8))
def test_texts_of_a_group_keep_apart(texts):
    got, ends = ENCODER.encode_all(texts)
    assert [p.tolist() for p in np.split(got, ends[:-1])][: len(texts)] == [direct(t)[:-1] for t in texts]


def test_all_short_texts():
    """Each three parts beside one another, behind a text and before another."""
    texts = [a + b + c for a in PARTS for b in PARTS for c in PARTS]
    got, ends = ENCODER.encode_all(texts)
    assert [p.tolist() for p in np.split(got, ends[:-1])] == [direct(t)[:-1] for t in texts]
    assert [ids(ENCODER, f"{t}a b") for t in texts[:3000]] == [direct(f"{t}a b")[:-1] for t in texts[:3000]]


def test_groups_of_batches(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(tb, "GROUP_BYTES", 40)
    batches = [pa.RecordBatch.from_pydict({"doc_id": pa.array(d, pa.int64()), "text": pa.array(t, pa.string())}) for d, t in (([], []), ([1, 1, 2], ["a b", "a b", None]), ([2, None], ["", "c" * 50]), ([None], ["c" * 50]))]
    got = pa.Table.from_batches(tb._packed(iter(batches), PATH)).to_pylist()
    assert [(r["doc_id"], r["n"], r["copies"]) for r in got[:-1]] == [(1, 3, 2), (2, 1, 2), (None, len(direct("c" * 50)), 1), (None, len(direct("c" * 50)), 1)]
    assert [tb.unpacked(r["ids"]).tolist() for r in got[:-1]] == [direct(t) for t in ("a b", "", "c" * 50, "c" * 50)]
    assert next(tb._tallied(iter([pa.RecordBatch.from_pylist(got[-1:])]))).to_pydict()["n"] == np.unique(sum((direct(t) * k for t, k in (("a b", 2), ("", 2), ("c" * 50, 2))), []), return_counts=True)[1].tolist()
