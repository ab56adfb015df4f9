import public_tokenizers
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from wardline.llm import token_counts

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["it's we'll I'D", "a<|endoftext|>b <|endoftext|> <|ENDOFTEXT|>", "x́ é é", "tab\there\r\nand nbsp em\x1cfs\x85nel\x0bvt", "ΣΑΣ İstanbul ſ ﬃ", "日本語 テスト 👩‍👩‍👧 🇩🇪", "12345 3.14", "", " ", "  lead", "́ start", "w" * 5000, "a b " * 3000, "한국어 각"]


def direct(texts):
    t = token_counts.tokenizer(PATH)
    return [len(t.encode(x or "", add_special_tokens=False).ids) for x in texts]


def test_query_equals_library(spark):
    texts = [*ODD, None, *ODD]
    rows = [(i // 2, t, "x", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, word long").repartition(2)
    for words in (None, [], ["the", "it's"]):
        got = token_counts.count_tokens(docs, PATH, words).collect()
        assert sorted((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == sorted((i // 2, len((t or "").encode()), n, n > 2048) for i, (t, n) in enumerate(zip(texts, direct(texts), strict=True)))
    assert token_counts.count_tokens(docs.limit(0), PATH).count() == 0


def test_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(token_counts, "CACHE_ROWS", 5)
    c = token_counts.Counter(PATH, {"the": 1})
    texts = [f"the word{i} is number {i} of a few" for i in range(50)]
    assert [c.count(t) for t in texts] == direct(texts)


@settings(max_examples=300, deadline=None, suppress_health_check=[HealthCheck.too_slow])
@given(st.lists(st.text(st.one_of(st.sampled_from(" \n\t'sdllABçé<|>́̇ΣİÅ"), st.characters(codec="utf-8")), max_size=30), max_size=5))
def test_random_texts(texts):
    counter = token_counts.Counter(PATH, {})
    assert [counter.count(t) for t in texts] == direct(texts)


def test_words_and_marks():
    texts = ["The, The. THE, ÀÉÿß, Straße. ÆØÞ. aª º, µ", "I.B.M. e.g., it's, 'll, a.,", *(chr(c) + "x" + chr(c) + "," for c in range(0xC0, 0x180))]
    counter = token_counts.Counter(PATH, {})
    assert [counter.count(t) for t in texts] == direct(texts)
