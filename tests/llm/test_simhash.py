import random

import numpy as np
import pytest
import xxhash

from wardline.llm import simhash

SPACE = " \t\n\x0b\x0c\r"


def slow_fingerprint(text, n=3):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in SPACE:
        text = text.replace(c, " ")
    ws = [w for w in text.split(" ") if w]
    shingles = [" ".join(ws[i : i + n]) for i in range(len(ws) - n + 1)] or ([" ".join(ws)] if ws else [])
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(pairs, radius):
    """pairs: (doc_id, fingerprint). Component ids by repeated relabelling."""
    ids = [d for d, _ in pairs]
    comp = list(ids)
    near = [(i, j) for i in range(len(ids)) for j in range(i) if (pairs[i][1] ^ pairs[j][1]).bit_count() <= radius]
    while True:
        before = list(comp)
        for i, j in near:
            comp[i] = comp[j] = min(comp[i], comp[j])
        if comp == before:
            return sorted((d, f"{f:016x}", c) for (d, f), c in zip(pairs, comp, strict=True))


def test_fingerprints():
    for t in (None, "", " \t", "One", "one two", "Ä b C d É", "a a a a a", "x\x0by\x0cz w\x1cv " * 50, "w" * 100_000, " ".join(map(str, range(30_000)))):
        for n in (3, 5):
            assert simhash.fingerprint(t, n).tolist() == [slow_fingerprint(t, n)]


@pytest.mark.parametrize("radius", [2, 4, 6])
def test_bit_sliced_links(radius):
    rng = random.Random(radius)
    for n in (2, 63, 64, 65, 300):
        fps = [rng.getrandbits(64) for _ in range(n // 2)]
        while len(fps) < n:
            f = rng.choice(fps)
            for _ in range(rng.randrange(0, radius + 3)):
                f ^= 1 << rng.randrange(64)
            fps.append(f)
        got = {(int(i), j) for i, m in zip(*simhash.matches(np.array(fps, np.uint64), radius), strict=True) for j in np.flatnonzero(np.unpackbits(m.view(np.uint8), bitorder="little")).tolist()}
        assert got == {(i, j) for j in range(n) for i in range(j) if (fps[i] ^ fps[j]).bit_count() <= radius}


def test_wide_links():
    rng = random.Random(9)
    fps = [rng.getrandbits(256) for _ in range(100)]
    fps += [f ^ sum(1 << b for b in rng.sample(range(256), rng.randrange(30, 60))) for f in fps]
    words = np.array([[f >> 64 * k & (1 << 64) - 1 for k in range(4)] for f in fps], np.uint64)
    got = {(int(i), j) for i, m in zip(*simhash.matches(words, 44), strict=True) for j in np.flatnonzero(np.unpackbits(m.view(np.uint8), bitorder="little")).tolist()}
    assert got == {(i, j) for j in range(200) for i in range(j) if (fps[i] ^ fps[j]).bit_count() <= 44}


def test_similar_texts(spark):
    rng = random.Random(2)
    say = lambda n: [f"w{rng.randrange(9000)}" for _ in range(n)]
    rows, groups = [], []
    for g in range(60):
        ws = say(rng.randrange(60, 500))
        rows.append((g, " ".join(ws)))
        other = list(ws)
        for _ in range(max(1, len(ws) // 80)):  # of n shingles about n / 16 change: a similarity near 0.88
            other[rng.randrange(len(ws))] = "changed"
        rows.append((1000 + g, " ".join(other)))
        rows.append((2000 + g, " ".join(ws[: len(ws) // 2] + say(len(ws) // 2))))  # half the same: similarity 1/3
        groups.append((g, 1000 + g))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    comp = {r.doc_id: r.component_id for r in simhash.components(docs).collect()}
    assert sum(comp[b] == a for a, b in groups) >= 0.9 * len(groups)
    assert all(comp[2000 + g] == 2000 + g for g in range(60))


@pytest.mark.parametrize("tile", [3, 4096])
def test_components(spark, monkeypatch, tile):
    monkeypatch.setattr(simhash, "TILE_ROWS", tile)
    monkeypatch.setattr(simhash, "BLOCK_ROWS", 8)
    rng = random.Random(1)
    base = [" ".join(f"w{rng.randrange(5000)}" for _ in range(rng.randrange(100, 400))) for _ in range(12)]
    texts = [*base, *base[:6]]
    for _ in range(60):
        ws = rng.choice(base[:4]).split()
        ws[rng.randrange(len(ws))] = f"new{rng.randrange(50)}"
        texts.append(" ".join(ws))
    texts += [None, "", "short one", "Short  one", "x"]
    ids = rng.sample(range(1000), len(texts))
    rows = list(zip(ids, texts, strict=True))
    docs = spark.createDataFrame([(*r, 0, 1) for r in rows], "doc_id long, text string, fp long, node long").repartition(3)
    got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in simhash.digest(docs).collect())
    want = brute([(d, slow_fingerprint(t)) for d, t in rows], 2)
    assert got == want and len({c for *_, c in want}) < len(rows) - 20
    kept = simhash.representatives(docs, simhash.exact())
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted({c for *_, c in want})


def test_chain_empty_and_nulls(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 500)], "a long, b long")
    assert {r.component for r in simhash.connected(chain).collect()} == {0}
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.digest(empty).count() == 0 and simhash.representatives(empty).count() == 0
    rows = [(None, "a b c d"), (7, "a b c d"), (7, "a b c d"), (None, "other words go here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((str(r.doc_id), str(r.component_id)) for r in simhash.digest(docs).collect()) == [("7", "7"), ("7", "7"), ("None", "7"), ("None", "None")]
    assert simhash.representatives(docs, simhash.exact()).count() == 2


def test_similar_links_are_verified(spark):
    rng = random.Random(7)
    rows, want = [], {}
    grams = lambda t: {tuple(t[i : i + 5]) for i in range(len(t) - 4)}
    for g in range(40):
        ws = [f"w{rng.randrange(9000)}" for _ in range(300)]
        other, cut = list(ws), rng.choice((8, 11, 20, 24))  # a similarity near 0.77, 0.7, 0.5; chains none over 0.8
        for k in range(cut):
            other[k * 12 + 3] = "changed"
        rows += [(g, " ".join(ws)), (1000 + g, " ".join(other)), (2000 + g, " ".join([*ws, *ws[:60] * 3]))]  # the last repeats its own
        a, b, c = map(grams, (ws, other, rows[-1][1].split()))
        want |= {1000 + g: g if len(a & b) >= 0.8 * len(a | b) else 1000 + g, 2000 + g: g if len(a & c) >= 0.8 * len(a | c) else 2000 + g}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    comp = {r.doc_id: r.component_id for r in simhash.components(docs).collect()}
    assert {d: comp[d] for d in want} == want and {want[1000 + g] == g for g in range(40)} == {False} and all(want[2000 + g] == g for g in range(40))


def test_verified_forest():
    sets = [np.arange(a, a + 100, dtype=np.uint64) for a in (0, 5, 15, 60)]
    fps = np.zeros((4, 4), np.uint64)
    keys = np.zeros((4, 2), np.int64)
    judged = lambda keys: sorted(simhash.forest(fps, [1, 2, 3, 4], 47, sets=sets, keys=keys, similarity=0.8))
    assert judged(keys) == [(2, 1), (3, 1)]  # 90 of 110 links 3 to 2 alone
    assert judged(np.array([[1, 2], [3, 2], [3, 4], [5, 6]])) == [(2, 1), (3, 1)] and judged(np.array([[1, 2], [1, 3], [4, 5], [6, 7]])) == [(2, 1)]
    assert sorted(simhash.forest(fps, [1, 2, 3, 4], 47)) == [(2, 1), (3, 1), (4, 1)]


def grams(text, n=5):
    ws = text.split()
    return {tuple(ws[i : i + n]) for i in range(max(1, len(ws) - n + 1))}


def copies_at(rng, similarity, n):
    """Pairs of texts whose similarity is just at or above the given one, of many lengths."""
    for _ in range(n):
        ws = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(30, 400))]
        other, places = list(ws), rng.sample(range(len(ws)), len(ws))
        for at in places:
            changed = [*other[:at], f"x{rng.randrange(10**6)}", *other[at + 1 :]]
            a, b = grams(" ".join(ws)), grams(" ".join(changed))
            if len(a & b) < similarity * len(a | b):
                break
            other = changed
        yield " ".join(ws), " ".join(other)


def test_recall_at_the_similarity(spark):
    rows = [(g + 1000 * k, t) for g, pair in enumerate(copies_at(random.Random(11), 0.8, 400)) for k, t in enumerate(pair)]
    found = {r.doc_id: r.component_id for r in simhash.components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert sum(found[1000 + g] == g for g in range(400)) >= 397 and all(found[g] == g for g in range(400))


def test_links_depend_on_the_texts_alone(spark, monkeypatch):
    rng = random.Random(5)
    base = [[f"w{rng.randrange(2000)}" for _ in range(120)] for _ in range(20)]
    rows = []
    for k in range(400):
        ws = list(rng.choice(base))
        for _ in range(rng.randrange(0, 12)):
            ws[rng.randrange(len(ws))] = f"x{rng.randrange(40)}"
        rows.append((k, " ".join(ws)))
    sets = [grams(t) for _, t in rows]
    near = [(i, j) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]

    def brute(ids):
        comp = {i: i for i in ids}
        while True:
            before = dict(comp)
            for i, j in near:
                if i in comp and j in comp:
                    comp[i] = comp[j] = min(comp[i], comp[j])
            if comp == before:
                return comp

    def run(ids, partitions):
        docs = spark.createDataFrame([rows[i] for i in ids], "doc_id long, text string").repartition(partitions)
        return {r.doc_id: r.component_id for r in simhash.components(docs).collect()}

    want = brute(range(400))
    assert len(set(want.values())) > 20 and run(range(400), 3) == want
    spark.conf.set("spark.sql.shuffle.partitions", 23)
    monkeypatch.setattr(simhash, "TILE_ROWS", 7)
    monkeypatch.setattr(simhash, "VERIFY_ROWS", 5)
    monkeypatch.setattr(simhash, "BLOCK_ROWS", 16)
    try:
        assert run(range(400), 11) == want
        assert run(range(0, 400, 2), 2) == brute(range(0, 400, 2))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_large_components_move_once(spark, monkeypatch):
    """Near copies of one text in 30 tiles, with others that hang on by bits alone or by a few texts: texts are dealt about
    once, not once for each tile; and nothing is lost where a component stays in several trees."""
    rng = random.Random(8)
    base = [f"w{k}" for k in range(200)]

    def changed(words, n):
        words = list(words)
        for k in rng.sample(range(len(words)), n):
            words[k] = f"y{rng.randrange(10**6)}"
        return words

    # a chain leads away from the base: each link is near the one before, the last ones far from the base
    chain = [base]
    for _ in range(12):
        chain.append(changed(chain[-1], 3))
    rows = [(k, " ".join(changed(base, rng.randrange(2)))) for k in range(600)] + [(1000 + k, " ".join(c)) for k, c in enumerate(chain)] + [(2000 + k, " ".join(changed(chain[6], 9))) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    sets = {i: grams(t) for i, t in rows}
    comp = {i: i for i in sets}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and root(i) != root(j) and len(a & b) >= 0.8 * len(a | b):
                low, high = sorted((root(i), root(j)))
                comp[high] = low
    monkeypatch.setattr(simhash, "VERIFY_ROWS", 20)
    moved, dealt = [], simhash._dealt

    def counted(members, by, scheme, columns, judged):
        if judged:
            moved.append(members.selectExpr("sum(size(others)) AS n").collect()[0].n)
        return dealt(members, by, scheme, columns, judged)

    monkeypatch.setattr(simhash, "_dealt", counted)
    got = {r.doc_id: r.component_id for r in simhash.components(docs).collect()}
    assert got == {i: root(i) for i in sets} and len(set(got.values())) > 1
    copies = docs.where("doc_id < 600")
    moved.clear()
    assert {r.component_id for r in simhash.components(copies).collect()} == {0}
    assert sum(n or 0 for n in moved) < 1.5 * 600


def test_representatives_of_repeated_rows_and_ids(spark):
    rows = [(None, "a b c d e f", 3), (None, "other words go here now", 1), (7, "one two three four five", 2), (7, "one two three four five", 1), (7, "six seven eight nine ten", 1), (8, "six seven eight nine ten", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long").repartition(3)
    want = [rows[0], rows[1], rows[3], rows[4]]  # of equal ids and texts, the first as JSON
    assert sorted(map(tuple, simhash.representatives(docs).collect()), key=str) == sorted(want, key=str)
