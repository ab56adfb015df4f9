import math
import re
from collections import Counter
from hashlib import sha256
from zlib import crc32

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wardline.llm import importance

_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def features(text, max_run):
    words = _WORD.findall((text or "").translate(_LOWER))
    return words, [" ".join(words[i : i + r]) for r in range(1, max_run + 1) for i in range(len(words) - r + 1)]


def brute(docs, target, max_run=1, buckets=10_000, min_words=20, percent=10, seed=2024):
    def tally(texts):
        return Counter(crc32(f.encode()) % buckets for t in texts for f in features(t, max_run)[1])

    s, t = tally(x for _, x in docs), tally(target)
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in s}
    rows = []
    for doc_id, text in docs:
        words, found = features(text, max_run)
        weight = math.floor(sum(gain[crc32(f.encode()) % buckets] for f in found) / len(found)) if found else 0
        h = int(sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)])
    fit = sorted((r for r in rows if r[4] >= min_words), key=lambda r: (-r[3], r[0]))
    rank = {r[0]: k + 1 for k, r in enumerate(fit[: percent * len(fit) // 100])}
    return sorted((*r[:4], rank.get(r[0])) for r in rows)


TEXTS = [None, "", " .,;\n", "Ab aB é日本 9x\x00y", "the Of THE of " * 30, "naïve café  x  " * 9, "w" * 5000, "one two\tthree-four_five " * 700]


def tables(spark, n=240):
    docs = [(i, TEXTS[i % len(TEXTS)] if i % 3 else f"word{i % 7} alpha beta gamma{i % 5} " * (4 + i % 6)) for i in range(n)]
    target = ["alpha beta gamma1", "word3 word3 of the", None, ""]
    extra = [(i, t, "x", 1, 2) for i, t in docs]
    return docs, target, spark.createDataFrame(extra, "doc_id long, text string, score string, __text int, stream int").repartition(3), spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int")


def test_equals_brute_force(spark):
    docs, target, d, t = tables(spark)
    assert sorted(map(tuple, importance.digest(d, t).collect())) == brute(docs, target)
    how = {"max_run": 3, "buckets": 97, "seed": 5}
    drawn = importance.ranked(importance.scored(d, t, **how), min_words=1, percent=50)
    assert sorted(map(tuple, drawn.select("doc_id", "n_features", "weight", "score", "rank").collect())) == brute(docs, target, min_words=1, percent=50, **how)


def test_drawn_documents_are_whole(spark):
    docs, target, d, t = tables(spark)
    won = {r[0] for r in brute(docs, target) if r[4]}
    got = importance.resampled(d, t)
    assert got.columns == d.columns
    assert sorted(map(tuple, got.collect())) == sorted((i, x, "x", 1, 2) for i, x in docs if i in won)


def test_empty_and_repeated(spark):
    _, _, d, t = tables(spark)
    assert importance.digest(d.limit(0), t).count() == 0
    assert importance.digest(d.limit(0), t.limit(0)).count() == 0
    rows = [(1, "a b c " * 10)] * 15 + [(None, "d e f " * 10)] * 5
    got = importance.digest(spark.createDataFrame(rows, "doc_id long, text string"), t.limit(0)).collect()
    assert sorted(r.rank for r in got if r.rank) == [1, 2] and len(got) == 20 and len({(r.doc_id, r.score) for r in got}) == 2
    with pytest.raises(ValueError):
        importance.streams(d, 1, 70_000)


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("aB9 é,\n日"), max_size=60), st.integers(1, 4), st.integers(1, 12))
def test_slices_change_nothing(text, max_run, size):
    _, expected = features(text, max_run)
    slices, importance.slices = importance.slices, lambda b: slices(b, size)
    try:
        n, found = importance.hashed(text.encode(), max_run, 1 << 16)
    finally:
        importance.slices = slices
    slices = importance.slices
    assert n == len(_WORD.findall(text.translate(_LOWER))) and sorted(found.tolist()) == sorted(crc32(f.encode()) % (1 << 16) for f in expected)
    ordered, lengths = importance.runs(found.tobytes())
    assert dict(zip(ordered.tolist(), lengths.tolist(), strict=True)) == Counter(found.tolist())
