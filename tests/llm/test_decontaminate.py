import math
import random
from collections import Counter

import pytest

from wardline.llm import decontaminate as dc


def brute(docs, items):
    """All pairs: BM25 over every passage, then the overlap of shingles."""
    found = [(i, t, dc.words_of(t)) for i, t in items if dc.words_of(t)]
    if not found:
        return {}
    n, mean = len(found), sum(len(w) for *_, w in found) / len(found)
    df = Counter(x for *_, w in found for x in set(w))
    texts = {i: t for i, t, _ in found}
    widths = {max(128, 1 << (2 * len(w) - 1).bit_length()) for *_, w in found}

    def impact(w, words):
        tf = words.count(w)
        return math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words) / mean))

    out = {}
    for d, text in docs:
        ws = dc.words_of(text)
        for width, s in [(width, s) for width in widths for s in range(0, max(1, len(ws)), width // 2)]:
            passage = ws[s : s + width]
            grams = {k: {tuple(passage[i : i + k]) for i in range(len(passage) - k + 1)} for k in range(1, 6)}

            def share(ws, grams=grams):
                own = {tuple(ws[k : k + 5]) for k in range(max(1, len(ws) - 4))}
                return sum(g in grams[len(g)] for g in own) / len(own)

            for i, _, w in found:
                if max(128, 1 << (2 * len(w) - 1).bit_length()) != width:
                    continue
                q = dc.question_and_answer(texts[i])[0]
                score, whole, asked = (sum(impact(x, w) for x in set(w) if x in own) for own in (set(passage), set(w), set(q)))
                overlap, of_q = share(w), share(q)
                long = len({tuple(q[k : k + 5]) for k in range(max(1, len(q) - 4))}) >= 8
                if score >= 0.6 * (asked if long else whole) - 1e-9 and (overlap >= 0.8 or long and of_q >= 0.8):
                    out[d, i] = max(out.get((d, i), 0), overlap)
    return out


def tables():
    rng = random.Random(5)
    vocab = [f"w{k}" for k in range(400)] + ["the", "of", "and"] * 60
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(k, f"{say(rng.randrange(8, 50))}? {say(rng.randrange(1, 9))}.") for k in range(60)]
    items += [(60, "tiny one"), (61, None), (62, ""), (63, items[0][1]), (64, "?!"), (65, say(150))]
    docs = [(k, say(rng.randrange(0, 300))) for k in range(40)]
    for k in range(60):
        own = items[rng.randrange(66)][1] or ""
        ws = own.split()
        for _ in range(rng.choice([0, 0, 0, 1, 3])):
            if ws:
                ws[rng.randrange(len(ws))] = "changed"
        docs.append((100 + k, f"{say(rng.randrange(0, 200))} {' '.join(ws).upper()} {say(rng.randrange(0, 200))}"))
    docs += [(300, None), (301, ""), (302, say(9000) + " " + items[3][1]), (303, items[5][1] + "\n" + items[6][1]), (303, items[7][1])]
    return docs, items


@pytest.mark.parametrize("block, shard", [(1, 16 << 20), (8, 2000)])
def test_against_brute_force(spark, monkeypatch, block, shard):
    monkeypatch.setattr(dc, "BLOCK_ITEMS", block)
    monkeypatch.setattr(dc, "SHARD_CHARS", shard)
    docs, items = tables()
    left = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, item_id string, score long").repartition(3)
    right = spark.createDataFrame([(*i, 0) for i in items], "item_id long, text string, doc_id long")
    got = {(r.doc_id, r.item_id): r.overlap for r in dc.pairs(left, right).collect()}
    want = brute(docs, items)
    assert got == pytest.approx(want) and len(want) > 30
    clean = dc.cleaned(left, right)
    assert clean.columns == left.columns
    bad = {d for d, _ in want}
    assert sorted(r.doc_id for r in clean.collect() if r.doc_id != 303) == sorted(d for d, _ in docs if d not in bad and d != 303)


def test_empty_tables_and_null_ids(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (1, "x")], "doc_id long, text string")
    items = spark.createDataFrame([(None, "a b c d e f"), (2, "a b c d e f")], "item_id long, text string")
    assert sorted((str(r.doc_id), str(r.item_id)) for r in dc.pairs(docs, items).collect()) == [("None", "2"), ("None", "None")]
    assert dc.pairs(docs, items.limit(0)).count() == 0 and dc.pairs(docs.limit(0), items).count() == 0
    assert [r.doc_id for r in dc.cleaned(docs, items).collect()] == [1]


def test_question_without_its_answer(spark):
    say = lambda a, n: " ".join(f"{a}{k}" for k in range(n))
    items = [(1, f"{say('q', 30)}? {say('a', 8)}."), (2, f"{say('r', 9)}? {say('b', 30)}."), (3, f"{say('s', 30)}? {say('c', 30)}.")]
    docs = [(1, f"{say('x', 60)} {say('q', 30)} {say('y', 60)}"), (2, f"{say('x', 60)} {say('r', 9)} {say('y', 9)}"), (3, f"{say('z', 9)} {say('b', 30)} {say('y', 9)}"), (4, say("c", 30)), (5, items[2][1]), (6, f"{say('s', 30)} {say('y', 3)} {say('c', 30)}")]
    found = dc.pairs(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    # 1: a question; 2: one of five shingles is not enough; 3, 4: answers, the one of most of an item; 5, 6: both
    assert sorted((r.doc_id, r.item_id, r.part) for r in found.collect()) == [(1, 1, "question"), (5, 3, "both"), (6, 3, "both")]


def test_other_items_do_not_change_a_match(spark):
    """The halves of an item lie 150 words apart: no leak, whatever long items the benchmark has beside it."""
    say = lambda a, n: " ".join(f"{a}{k}" for k in range(n))
    item = f"{say('p', 20)} {say('q', 20)}"
    docs = spark.createDataFrame([(1, f"{say('p', 20)} {say('x', 150)} {say('q', 20)}"), (2, f"{say('y', 90)} {item} {say('z', 90)}")], "doc_id long, text string")
    for longer in ([], [(2, say("long", 400))]):
        found = dc.pairs(docs, spark.createDataFrame([(1, item), *longer], "item_id long, text string")).collect()
        assert [(r.doc_id, r.item_id, r.overlap, r.answer_overlap, r.part) for r in found] == [(2, 1, 1.0, None, "question")]


def test_answers_are_verified_on_the_given_tables(spark):
    """Of the planted items most have an answer, and taking it out of a document that holds an item changes what is reported."""
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet").select(c, "text") for t, c in (("documents", "doc_id"), ("benchmark", "item_id")))
    found = dc.pairs(docs, items).collect()
    told = [r for r in found if r.answer_overlap is not None]
    assert len(told) > len(found) / 2 and {r.part for r in told} == {"both"} and {r.part for r in found if r.answer_overlap is None} <= {"question", "item"}
    texts = {r.item_id: r.text for r in items.collect()}
    cut = []
    for r in told:
        cut.append((r.item_id, "lead in words " + " ".join(dc.question_and_answer(texts[r.item_id])[0])))
    again = {r.doc_id: r for r in dc.pairs(spark.createDataFrame(cut, "doc_id long, text string"), items).collect() if r.doc_id == r.item_id}
    assert again and all(r.part == "question" and r.answer_overlap < 0.8 for r in again.values())


def test_question_and_answer():
    assert dc.question_and_answer("One thing. Then another one.") == (["one", "thing"], ["then", "another", "one"])
    assert dc.question_and_answer("A b. C d.\ne f\n") == (["a", "b", "c", "d"], ["e", "f"])
    assert dc.question_and_answer("What is it? A thing.") == (["what", "is", "it"], ["a", "thing"])
    assert dc.question_and_answer("Only one sentence.") == (["only", "one", "sentence"], [])
