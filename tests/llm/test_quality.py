from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from wardline.llm import quality

SCHEMA = "doc_id long, source string, text string"
COLUMNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
SPACE = " \t\n\x0b\x0c\r"


def words(text):
    for c in SPACE:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def repeats(ws):
    windows = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    n = Counter(windows)
    return len({k for i, w in enumerate(windows) if n[w] > 1 for k in (i, i + 1, i + 2)})


def brute(rows):
    key = lambda line: " ".join(words(line)).lower()
    texts = defaultdict(dict)
    for d, s, t in rows:
        least = texts[s].get(t or "")
        texts[s][t or ""] = min(x for x in (least, d) if x is not None)
    over = {}
    for s, own in texts.items():
        held = defaultdict(list)
        for t, d in own.items():
            for k in {key(x) for x in t.split("\n")} - {""}:
                held[k].append(d)
        over |= {(s, k): min(ds) for k, ds in held.items() if len(ds) > quality.LINE_DOCS or len(ds) > max(quality.SMALL_DOCS, quality.LINE_SHARE * len(own))}
    out = []
    for d, s, t in rows:
        t = t or ""
        ws, r = words(t), repeats(words(t))
        lines = [x for x in t.split("\n") if words(x)]
        failed = len(ws) < 50 or 100 * r > 50 * len(ws)
        lost = sum(len(words(x)) for x in lines if over.get((s, key(x)), d) != d)
        out.append((d, len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), r, failed, not failed and len(ws) - lost >= quality.KEPT_SHARE * len(ws)))
    return sorted(out)


def run(spark, rows):
    return sorted(tuple(r[c] for c in COLUMNS) for r in quality.digest(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect())


def prose(seed, n):
    return " ".join(f"w{seed}x{i}" for i in range(n))


def rows():
    common = prose("menu", 40)
    out = [(i, "a", f"{common}\n{prose(i, 30)}") for i in range(80)]
    out += [(100 + i, "a", prose("copy", 60)) for i in range(70)]  # exact copies count once
    out += [(200 + i, "b", f"{common}\n{prose(i, 60)}") for i in range(60)]
    out += [(400 + i, "small", f"{prose('few', 5)}\n{prose(i, 70)}") for i in range(9)]
    out += [(300, "c", None), (301, None, ""), (302, "c", "one two three " * 40), (303, "c", f"{prose('z', 50)}\n\n \n# a|b\n# a|b"), (304, "c", "é" * 100_000), (305, "c", prose("long", 30_000)), (306, "c", prose("z", 50)), (306, "c", prose("z", 50)), (307, None, prose("n", 55) + "\r\n\x0bX")]
    return out


def test_against_brute_force(spark):
    got, want = run(spark, rows()), brute(rows())
    assert got == want
    kept = {r[0] for r in got if r[-1]}
    assert {0, 200, *range(100, 170), *range(400, 409)} <= kept and not kept & {*range(1, 80), *range(201, 260)}


def test_filter_keeps_columns(spark):
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows())], SCHEMA + ", kept long")
    out = quality.filtered(docs)
    assert out.columns == docs.columns
    assert sorted(r.kept for r in out.collect()) == [i for i, r in enumerate(rows()) if dict((x[0], x[-1]) for x in brute(rows()))[r[0]]]
    assert quality.filtered(docs.limit(0)).count() == 0 and run(spark, []) == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=40))
def test_repeat_words(ws):
    assert quality.repeat_words(ws) == repeats(ws)


def test_filter_removes_lines(spark):
    menu = prose("menu", 20)
    own = [(i, "b", f"{prose(i, 40)}\n\n  {menu.upper()} \n{prose(i, 20)}") for i in range(60)]
    out = {r.doc_id: r.text for r in quality.filtered(spark.createDataFrame(own, SCHEMA).repartition(3)).collect()}
    assert out == {i: t if i == 0 else f"{prose(i, 40)}\n\n{prose(i, 20)}" for i, _, t in own}


def test_filter_takes_either_limit(spark):
    few, many, under = prose("few", 20), prose("many", 20), prose("under", 20)
    own = [(i, "small", f"{prose(i, 60)}\n{few if i < 6 else prose(-i, 5)}\n{under if i < 5 else ''}") for i in range(50)]
    own += [(1000 + i, "large", f"{prose(i, 60)}\n{many if i < 51 else ''}\n{under if i < 50 else ''}") for i in range(600)]
    out = {r.doc_id: r.text for r in quality.filtered(spark.createDataFrame(own, SCHEMA).repartition(3)).collect()}
    changed = {i for i, _, t in own if out[i] != t}
    assert changed == {*range(1, 6), *range(1001, 1051)}
    assert not any(few in out[i] for i in range(1, 6)) and not any(many in out[i] for i in range(1001, 1051)) and all(under in out[i] for i in (1, 1001))
