from itertools import product
from zlib import crc32

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from wardline.llm import line_crf


def enumerated(odds, ties):
    """Chances of each position and the log of the sum over all labellings, by writing all of them out."""
    n = len(odds)
    weights = {ys: sum(o * y for o, y in zip(odds, ys, strict=True)) + sum(ties[2 * a + b] for a, b in zip(ys, ys[1:], strict=False)) for ys in product((0, 1), repeat=n)}
    total = np.logaddexp.reduce(list(weights.values()))
    return [sum(np.exp(w - total) for ys, w in weights.items() if ys[k]) for k in range(n)], total, weights


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 2**32), st.lists(st.integers(1, 7), min_size=1, max_size=6))
def test_messages_equal_enumeration(seed, counts):
    r = np.random.default_rng(seed)
    odds, ties = r.normal(0, 3, sum(counts)), r.normal(0, 2, 4)
    got = line_crf.chance(np.add(*line_crf.messages(odds, counts, ties)))
    at = np.cumsum([0, *counts])
    assert np.allclose(got, [p for a, b in zip(at[:-1], at[1:], strict=True) for p in enumerated(odds[a:b], ties)[0]])


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2**32))
def test_loss_and_gradient(seed):
    r = np.random.default_rng(seed)
    counts = [3, 1, 5]
    x, labels, parameters = r.normal(0, 1, (9, 4)), r.random(9) < 0.5, r.normal(0, 1, 8)
    value, gradient = line_crf.loss(x, counts, labels, parameters)
    odds, likelihood, at = x @ parameters[:4], 0.0, 0
    for n in counts:
        _, total, weights = enumerated(odds[at : at + n], parameters[4:])
        likelihood += (weights[tuple(labels[at : at + n].astype(int))] - total) / n / len(counts)
        at += n
    assert np.isclose(value, -likelihood + line_crf.PENALTY / 2 * (parameters**2).sum())
    for k in range(8):
        step = np.zeros(8)
        step[k] = 1e-5
        slope = (line_crf.loss(x, counts, labels, parameters + step)[0] - line_crf.loss(x, counts, labels, parameters - step)[0]) / 2e-5
        assert np.isclose(slope, gradient[k], atol=1e-6)


TEXTS = ["", "\n", "a b\n\nA B C.\na b", "é日本 12!? ##\n" * 3, "The The The The", "x" * 9000, "A.\n" * 400, "\ud83d\ude00 ok\r\n\tB |c|"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(TEXTS), max_size=6), st.integers(1, 50), st.integers(0, 2**32))
def test_measures_do_not_depend_on_slices_or_company(texts, size, seed):
    texts = [t.encode("utf-16", "surrogatepass").decode("utf-16") for t in texts]
    old, line_crf.SLICE = line_crf.SLICE, size
    try:
        own, chars, counts = line_crf.measured(texts)
    finally:
        line_crf.SLICE = old
    assert chars.tolist() == [len(x) for t in texts for x in t.split("\n")] and counts == [t.count("\n") + 1 for t in texts]
    alone = [line_crf.measured([t])[0] for t in texts]
    assert np.array_equal(own, np.concatenate(alone)) if texts else own.shape == (0, len(line_crf.MEASURES))
    if texts:
        weights = np.random.default_rng(seed).normal(0, 1, 3 * len(line_crf.MEASURES) + 3)
        assert np.allclose(line_crf.features(own, counts) @ weights, line_crf.line_odds(own, counts, weights))
        field = line_crf.Field(weights.tolist(), [1.0, 0.0, 0.0, 1.0])
        assert np.allclose(line_crf.scores(field, texts)[0], [line_crf.scores(field, [t])[0][0] for t in texts])


def tables(spark, sf="sf0.01"):
    return (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))


def test_held_out_documents(spark):
    docs, labels = tables(spark)
    got = line_crf.digest(docs, labels)
    assert got.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    rows = {r.doc_id: r for r in got.collect()}
    assert len(rows) == docs.count() and all(r.held_out == (crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows.values())
    unseen = [(rows[r.doc_id], r.quality) for r in labels.collect() if rows[r.doc_id].held_out]
    good, bad = ([r.score for r, q in unseen if q == k] for k in (1, 0))
    assert np.mean([(g > b) + (g == b) / 2 for g in good for b in bad]) > 0.98
    assert np.mean([r.predicted == q for r, q in unseen]) > 0.95 and np.mean([s >= 0.3 for s in good]) > 0.99


def test_lines_within_a_document(spark):
    """Lines of junk between good ones are told apart, and the longer part decides the score."""
    docs, labels = tables(spark)
    field = line_crf.fit(docs, labels)
    prose = "The and attion to thanedble the, anea. Eriner thanea, hesh of the whly onin it."
    junk = "the&&& of%%% ernd*** ### $$$ erre*** theationsh### nd%%% aning### onthha$$$"
    d = spark.createDataFrame([(1, "\n".join([prose] * 3 + [junk] * 3 + [prose] * 3)), (2, "\n".join([junk] * 5)), (3, prose), (None, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in line_crf.labelled(d, field).collect()}
    assert got[2].score < 0.2 and got[3].score > 0.8 and got[2].score < got[1].score < got[3].score
    assert got[2].good_lines == [False] * 5 and got[3].good_lines == [True] and len(got[1].chances) == 9
    assert max(got[1].chances[3:6]) < min(got[1].chances[0], got[1].chances[8]) and len(got[None].chances) == 1


def test_odd_rows(spark):
    docs, labels = tables(spark, "sf0.001")
    rows = [(None, None, 1), (1, "", 1), (1, "same", 2), (2, "same", 3), (3, "y " * 100_000, 4)]
    d = spark.createDataFrame(rows, "doc_id long, text string, __score int")
    field = line_crf.fit(docs, labels)
    got = line_crf.labelled(d.drop("__score"), field).collect()
    assert len(got) == 5 and len({r.score for r in got if r.doc_id in (1, 2)}) == 2
    assert line_crf.filtered(d, field, 0.0).columns == d.columns and line_crf.filtered(d, field, 0.0).count() == 5 and line_crf.filtered(d, field, 1.1).count() == 0
    assert line_crf.digest(docs.limit(0), labels).count() == 0
    none = line_crf.digest(d, labels.limit(0)).collect()
    assert len(none) == 5 and {r.score for r in none} == {0.5}
    one = line_crf.digest(docs, labels.where("quality = 1")).collect()
    assert {r.score for r in one} == {1.0}
    twice = spark.createDataFrame([(d, q) for d in range(40) for q in (1, 0, None)], "doc_id long, quality int")
    assert max(r.score for r in line_crf.digest(docs, twice).collect()) < 1e-100


def test_sample_is_bounded(spark, monkeypatch):
    docs, labels = tables(spark)
    seen = []
    monkeypatch.setattr(line_crf, "fitted", lambda x, counts, good: seen.append((len(x), len(counts))) or line_crf.Field([0.0] * 48, [0.0] * 4))
    monkeypatch.setattr(line_crf, "FIT_LINES", 600)
    line_crf.fit(docs, labels)
    monkeypatch.setattr(line_crf, "FIT_DOCS", 40)
    line_crf.fit(docs, labels)
    (lines, n), (_, fewer) = seen
    assert lines <= 600 and n < 399 and fewer <= 40
