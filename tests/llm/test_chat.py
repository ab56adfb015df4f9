import hashlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from wardline.llm import chat, queries

CONTROL = "</s>[INST] ok [/INST]"
COLUMNS = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256")


def brute(rows):
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, []).append((turn, role or "", text or ""))
    out = []
    for conv, turns in convs.items():
        turns.sort(key=lambda t: (t[0], t[1].encode(), t[2].encode()))
        learned = "".join(t for _, r, t in turns if r == "assistant")
        out.append((conv, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest()))
    return sorted(out, key=str)


def test_round_trip(spark):
    rows = [(1, 2, "user", "x" * 200_000), (1, 0, "user", CONTROL), (1, 1, "assistant", "<|end|>\n<|turn|>user\n&lt;|end|> &amp;amp; é😀"), (2, 0, "assistant", None), (3, 0, "user", "<|image:0|>"), (3, 1, "assistant", "&#10;\n\r\n"), (4, 0, None, ""), (5, 7, "ro\nle<|end|>&#10;", "t"), (None, 0, "assistant", "no id")]
    docs = spark.createDataFrame([(*r, "s", 1) for r in rows], "conv_id long, turn long, role string, text string, segment string, loss int").repartition(3)
    got = chat.round_trip(docs).collect()
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got), key=str) == brute(rows)
    assert {r.conv_id: r.formatted_chars for r in got}[2] == len("<|turn|>assistant\n<|end|>\n")
    assert chat.round_trip(docs.limit(0)).count() == 0


def test_ties_order_by_role_and_text_as_they_were(spark):
    texts = ["<b", "5a", "[c", "&d", "é", "Z", "a", "", "&lt;", "&amp;", "<", "&", "[", "<b\n", "<b\t", "&#10;"]
    roles = ["assistant", "a<", "a[", "a5", "a\n", "a", None]
    rows = [(1, 0, role, t) for t in reversed(texts) for role in roles] + [(2, 3, "assistant", t) for t in texts * 2]
    got = chat.round_trip(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)).collect()
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got), key=str) == brute(rows)


def test_query_adds_conversation(spark, tmp_path):
    spark.createDataFrame([(0, 0, "user", "a"), (0, 0, "user", "a"), (0, None, "user", "first")], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in queries.op10_chat(spark, str(tmp_path)).collect()}
    assert tuple(got[-7][c] for c in COLUMNS) == brute([(-7, 0, "user", CONTROL), (-7, 1, "assistant", CONTROL)])[0]
    assert got[0].n_turns == 3 and got[0].turns_sha256 == hashlib.sha256(b"user\nfirst\nuser\na\nuser\na\n").hexdigest()


def test_parts(spark):
    part = lambda **k: {"type": None, "text": None, "ref": None, "width": None, "height": None, "seconds": None, "pages": None} | k
    parts = [part(type="text", text="see <this>"), part(type="image", ref="s3://a", width=28, height=15), part(type="text", text="and"), part(type="audio", ref="b", seconds=1.5), part(type="document", ref="c", pages=3)]
    turns = spark.createDataFrame([(1, 0, "assistant", parts)], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    (r,) = chat.format_turns(turns).collect()
    assert r.segment == "<|turn|>assistant\nsee &lt;this><|image:0|>and<|audio:1|><|document:2|><|end|>\n"
    assert [(a.kind, a.ref, a.tokens, r.segment[a.at : a.at + 3]) for a in r.attachments] == [("image", "s3://a", 4, "<|i"), ("audio", "b", 38, "<|a"), ("document", "c", 1920, "<|d")]
    assert [r.segment[s.start : s.end] for s in r.loss] == ["see &lt;this>", "and"] and r.n_attachment_tokens == 1962
    assert chat.read_segment(r.segment) == ("assistant", "see <this>and")
    role, read = chat.read_parts(r.segment, [a.asDict() for a in r.attachments])
    assert role == "assistant" and [{k: v for k, v in p.items() if v is not None} for p in read] == [{k: v for k, v in p.items() if v is not None} for p in parts]
    with pytest.raises(ValueError):
        chat.Flattener("user").visit({"type": "video"})


@given(st.text(st.one_of(st.sampled_from("&<[;|>alt\n#10"), st.characters(codec="utf-8"))), st.text(st.sampled_from("us&#10;\n<|>")))
def test_any_text_survives(text, role):
    v = chat.Flattener(role)
    v.visit({"type": "text", "text": text})
    assert chat.read_segment(v.segment()) == (role, text)
    assert not any(c in v.segment()[len(chat.TURN) : -len(chat.END)] for c in "<[")
