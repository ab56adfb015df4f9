import hashlib
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wardline.llm import codebooks


def lloyd(rows, parts=16, entries=64, rounds=2):
    """Plain rounds over all distances; vec_ids are distinct."""
    good = sorted(((i, [math.floor(256 * x) for x in v], lab) for i, v, lab in rows if v and all(x is not None and math.isfinite(x) for x in v)), key=lambda r: r[0])
    width = len(good[0][1]) // parts
    split = [[tuple(v[p * width : (p + 1) * width]) for p in range(parts)] for _, v, _ in good]
    books = [[s[p] for s in split[:entries]] for p in range(parts)]

    def near(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), j) for j, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            own = [near(p, s[p])[1] for s in split]
            groups = [[s[p] for s, o in zip(split, own, strict=True) if o == j] for j in range(len(books[p]))]
            books[p] = [tuple(sum(c) // len(g) for c in zip(*g, strict=True)) if g else e for g, e in zip(groups, books[p], strict=True)]
    found = [[near(p, s[p]) for p in range(parts)] for s in split]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    errors = [sum(d for d, _ in f) for f in found]
    of_label = {}
    for (_, _, lab), e in zip(good, errors, strict=True):
        of_label[lab] = of_label.get(lab, 0) + e
    return [(i, "".join(f"{j:02x}" for _, j in f), e, of_label[lab], sha) for (i, _, lab), f, e in zip(good, found, errors, strict=True)]


SCHEMA = "vec_id long, embedding array<float>, label int, codes int, error string"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(3)


def test_equals_brute_force(spark):
    r = random.Random(4)
    rows = [(i, [np.float32(r.gauss(0, 0.1 + i % 3)).item() for _ in range(32)], r.choice([None, 1, 2])) for i in range(300)]
    rows += [(1000 + i, rows[7][1], None) for i in range(20)]  # repeated vectors
    rows += [(-9, None, 1), (-8, [None] * 32, 1), (-7, [math.nan] + [0.0] * 31, 1), (-6, [math.inf] * 32, 1), (-5, [-math.inf] + [0.0] * 31, None)]
    d = table(spark, rows)
    assert sorted(map(tuple, codebooks.digest(d).collect())) == lloyd(rows)
    for how in ({"entries": 5, "rounds": 0}, {"entries": 7, "rounds": 5, "parts": 4}):
        rows_, c = codebooks.compressed(d, **how)
        got = sorted((x.vec_id, x.codes.hex(), x.error, c.digest()) for x in rows_.collect())
        assert got == [(i, code, e, sha) for i, code, e, _, sha in lloyd(rows, **how)]
    first, c = codebooks.compressed(d)
    decoded = {x.vec_id: x.vector for x in codebooks.decoded(first, c).collect()}
    vectors = {i: v for i, v, _ in rows}
    for x in first.collect():
        assert sum((a - b) ** 2 for a, b in zip(decoded[x.vec_id], vectors[x.vec_id], strict=True)) <= (math.sqrt(x.error) + math.sqrt(32)) ** 2 / 256**2


def test_odd_rows(spark):
    rows = [(5, [0.5] * 16, None), (3, [0.25] * 16, 1), (4, [0.1] * 15, 1), (6, [], 1), (7, [1e6] * 16, 1), (8, [0.1] * 32, 2)]
    got = sorted(codebooks.digest(table(spark, rows)).collect())
    assert [(r.vec_id, r.code, r.error, r.label_error) for r in got] == [(3, "00" * 16, 0, 0), (5, "01" * 16, 0, 0)]
    assert codebooks.digest(table(spark, rows).limit(0)).count() == 0 and codebooks.digest(table(spark, rows[3:5])).count() == 0
    twice = codebooks.digest(table(spark, [rows[0], rows[0], (None, [0.5] * 16, 2)])).collect()
    assert {(r.code, r.error) for r in twice} == {("00" * 16, 0)} and len(twice) == 3
    with pytest.raises(ValueError):
        codebooks.compressed(table(spark, rows), entries=300)


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 4), st.integers(1, 9), st.integers(1, 3), st.sampled_from([1, 3, 300]))
def test_bounds_never_change_a_result(seed, parts, k, width, spread):
    """Small whole numbers make many ties; several rounds hand stale bounds on."""
    r = np.random.default_rng(seed)
    comps = r.integers(-spread, spread + 1, (40, parts, width))
    books = comps[:k].transpose(1, 0, 2).copy()
    c = codebooks.Codebooks(books, np.zeros((parts, k)), np.full(parts, 0.3 * spread))
    codes, upper, steps, _ = codebooks.nearest(comps, c)
    for _ in range(4):
        new = c.books + r.integers(-1, 2, books.shape) * r.integers(0, spread + 1, (parts, k, 1))
        c = codebooks.Codebooks(new, np.sqrt(((new - c.books) ** 2).sum(-1)) * codebooks.UP, c.unit)
        codes, upper, steps, _ = codebooks.renewed(comps, codes, upper, steps, c)
        d = ((comps[:, :, None] - c.books) ** 2).sum(-1)
        assert (codes == d.argmin(-1)).all()
        assert (upper >= np.sqrt(d.min(-1))).all() and (steps * c.unit[:, None] <= np.sqrt(d)).all()


def test_bounds_save_most_distances(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = codebooks.kept(d, 16)
    c = codebooks.start(rows, 16, 64)
    own = list(rows.schema.fields[:2])
    first = codebooks.staged(codebooks._mapped(rows, codebooks._first_round, c, own), "t")
    second = codebooks._mapped(first, codebooks._next_round, codebooks.moved(first, c), own)
    n = second.agg({"n_distances": "avg"}).collect()[0][0]
    assert n < 0.2 * 16 * 64
