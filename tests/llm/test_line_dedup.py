import hashlib
from collections import defaultdict

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from wardline.llm import line_dedup

SPACE = " \t\n\x0b\x0c\r"


def brute(rows):
    lines = [(d, (t or "").split("\n")) for d, t in rows]
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(SPACE))
    small = lambda d: (d is not None, d or 0)
    held = defaultdict(set)
    for d, ls in lines:
        for x in ls:
            held[key(x)].add(small(d))
    out = []
    for d, ls in lines:
        kept = [x for x in ls if not (len(key(x)) >= 10 and min(held[key(x)]) < small(d))]
        out.append((d, len(ls), len(ls) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, schema="doc_id long, text string"):
    got = line_dedup.digest(spark.createDataFrame(rows, schema)).collect()
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in got), key=str)


def test_edges(spark):
    long = "\n".join(f"line number {i} of many" for i in range(12_000))
    mixed = "\n".join(f"line number {i} of many" if i % 3 else f"only here {i} and new" for i in range(12_000))
    rows = [(3, "A shared LINE here\nown of three"), (1, " a shared line HERE\t\n\na shared line here"), (2, None), (None, "a shared line here"), (4, ""), (4, ""), (5, long), (6, long + "\nlast one is new"), (16, mixed), (7, "short\nshort"), (8, "short"), (9, "end of text \r\nA Shared line here\x0c"), (10, "éÉ upper stays É\nx"), (11, "éé upper stays É")]
    assert run(spark, rows) == brute(rows)


def test_empty_and_clashing_columns(spark):
    assert run(spark, []) == []
    rows = [(1, "same words in line", 1, 2), (2, "same words in line", 3, 4)]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, __pos long, first long"))
    assert {(r.doc_id, r["__pos"], r.kept_text) for r in out.collect()} == {(1, 1, "same words in line"), (2, 3, "")}


def test_hot_line(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT_SHARE", 0.0)
    rows = [(i, f"the very common line\nonly in {i} of all\nthe very common line") for i in range(1500)]
    assert run(spark, rows) == brute(rows)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 6), st.lists(st.sampled_from(["alpha beta gamma", " Alpha beta gamma", "delta epsilon x", "tiny", "", "\tdelta epsilon x\r"]), max_size=7).map("\n".join)), max_size=12))
def test_random(spark, rows):
    assert run(spark, rows) == brute(rows)
