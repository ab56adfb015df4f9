"""Benchmark decontamination: a BM25 index of the test items, searched with every training passage.

The items are the indexed documents; each passage of a training text is a query of its distinct words. Items are put
in blocks by length, and for each word and block the index has the largest contribution that the word can make. As in
block-max WAND, a block is scored only if its bound can reach its threshold, and here all passages of a batch go
through each test at once:

1. for each block, words whose bounds together stay below the block's least threshold cannot lift an item over it
   alone, so passages without any other word of the block skip it;
2. the bounds of a passage's words are summed, and blocks below their threshold are skipped;
3. items of the blocks that are left get exact scores.

No test loses an item: all with a score of at least SCORE_SHARE of their own self-score, or of their question's where that
is less, are retrieved. The question goes up to the item's last question mark, the answer is what follows; without a mark
between two texts, the answer is the last line, or the last sentence of a single line. Both of
retrieved pairs are verified on five-word shingles, each apart. A pair is a leak if the passage holds at least OVERLAP of
the item's shingles, or of its question's alone if these are QUESTION_SHINGLES or more: a question is spoilt without its
answer, an answer alone says little. ``part`` says which of them reached OVERLAP: both, question, answer, or item if only the
whole did. An item of one sentence is all question: its ``answer_overlap`` is null and its part never both or answer.

Passages are half overlapping windows, whose width depends on the item alone (``width_of``): PASSAGE words, doubled until it is twice as
long as the item, so that each item lies whole in some window and no other item changes what it matches. Items of one width
share an index, all of a shard are searched in one pass. Indexes are broadcast; items are taken in shards of at most SHARD_CHARS characters, one
after the other, each with a search of its own whose pairs are written before the next, so what is broadcast at once is
bounded whatever the benchmark's size. Texts are never shuffled for the search.

Defined cases: null or empty texts have no words and match nothing; items of fewer words than a shingle are one shingle;
rows that repeat a doc_id or an item_id report each pair of ids once, with the largest overlap; a null doc_id or item_id
is reported as null; extra columns are ignored by ``leaks`` and kept by ``cleaned``; empty tables give no pairs.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.sieve import without
from wardline.llm.storage import carried, small_batches, staged

K1, B = 1.2, 0.75
SCORE_SHARE, OVERLAP, SHINGLE, QUESTION_SHINGLES = 0.6, 0.8, 5, 8
PASSAGE, BLOCK_ITEMS = 128, 2
SHARD_CHARS = 16 << 20
#: Cells of the table of block bounds; blocks grow where a shard's words and items would need more.
BOUND_CELLS = 16 << 20
NULL_ID = -(2**63)
_WORD = re.compile(r"\w+")
_ASKED = re.compile(r"(?s)^(.*\?)\s*(\S.*)$")
_LAST_LINE = re.compile(r"(?s)^(.*\S)\s*\n\s*(\S.*)$")
_LAST_SENTENCE = re.compile(r"(?s)^(.*[.!])\s+(\S.*)$")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def shingles(words: list[str]) -> list[tuple[str, ...]]:
    return list(dict.fromkeys(tuple(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1)))) if words else []


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """Words of the question and of the answer, see the module; an item without both is all question."""
    text = text.strip()
    found = _ASKED.match(text) or _LAST_LINE.match(text) or _LAST_SENTENCE.match(text)
    q, a = (words_of(found[1]), words_of(found[2])) if found else (words_of(text), [])
    return (q, a) if q else (a, [])


def width_of(n_words: int) -> int:
    """Words of the passages in which an item of so many words is looked for."""
    width = PASSAGE
    while width < 2 * n_words:
        width *= 2
    return width


class Statistics:
    """Of all items: their number, mean words, and each word's items."""

    def __init__(self, n: int, mean: float, df: dict[str, int]):
        self.n, self.mean, self.df = n, mean, df

    def impacts(self, words: list[str]) -> dict[str, float]:
        norm = K1 * (1 - B + B * len(words) / self.mean)
        return {w: math.log(1 + (self.n - self.df[w] + 0.5) / (self.df[w] + 0.5)) * tf * (K1 + 1) / (tf + norm) for w, tf in Counter(words).items()}


class Index:
    """Of items of one width."""

    def __init__(self, items: list[tuple[int | None, str]], stats: Statistics, width: int):
        import numpy as np

        found = sorted(((len(w), i, w, t) for i, (i_, t) in enumerate(items) if (w := words_of(t))), key=lambda x: x[:2])
        self.ids = [items[i][0] for _, i, *_ in found]
        self.width = width
        # shingles of each item, its question and its answer
        self.parts = [tuple(map(shingles, (words_of(t), *question_and_answer(t)))) for *_, t in found]
        scores = [stats.impacts(w) for *_, w, _ in found]
        self.whole = np.array([sum(s.values()) for s in scores])
        asked = [set(question_and_answer(t)[0]) if len(q) >= QUESTION_SHINGLES else s for (*_, t), (_, q, _), s in zip(found, self.parts, scores, strict=True)]
        self.need = np.array([SCORE_SHARE * sum(s[w] for w in q) for s, q in zip(scores, asked, strict=True)])
        self.terms = {w: k for k, w in enumerate(dict.fromkeys(w for s in scores for w in s))}
        n, v = len(found), max(1, len(self.terms))
        self.block_items = max(BLOCK_ITEMS, -(-n * v // BOUND_CELLS))
        blocks = max(1, -(-n // self.block_items))
        self.bound = np.zeros((v, blocks), np.float32)
        posting = sorted((self.terms[w] * n + i, x) for i, s in enumerate(scores) for w, x in s.items())
        self.keys, self.values = np.array([k for k, _ in posting], np.int64), np.array([x for _, x in posting])
        item, term = self.keys % max(1, n), self.keys // max(1, n)
        np.maximum.at(self.bound, (term, item // self.block_items), np.nextafter(self.values.astype(np.float32), np.float32(np.inf)))
        self.least = np.array([self.need[b * self.block_items : (b + 1) * self.block_items].min(initial=np.inf) for b in range(blocks)])
        # words that a passage must have one of to reach a block's threshold
        essential = np.zeros(self.bound.shape, bool)
        for b in range(blocks):
            order = np.argsort(self.bound[:, b], kind="stable")
            essential[order, b] = (np.cumsum(self.bound[order, b].astype(np.float64)) * (1 + 1e-6) >= self.least[b]) & (self.bound[order, b] > 0)
        at, self.essential_block = np.nonzero(essential)
        self.essential_from = np.searchsorted(at, np.arange(v + 1))

    def retrieve(self, window, term):
        """window, term: sorted distinct pairs. Returns windows and items at or above the items' thresholds, and scores."""
        import numpy as np

        blocks = self.bound.shape[1]
        none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        n = self.essential_from[term + 1] - self.essential_from[term]
        if not len(window) or not n.sum():
            return none
        place = np.repeat(self.essential_from[term] - np.cumsum(n) + n, n) + np.arange(n.sum())
        pairs = np.unique(np.repeat(window, n) * blocks + self.essential_block[place])
        w, b = pairs // blocks, pairs % blocks
        w, b, _ = self._at_least(w, b, window, term, lambda t, k: self.bound[t, b[k]].astype(np.float64), lambda b: self.least[b] * (1 - 1e-6))
        if not len(w):
            return none
        item = (b[:, None] * self.block_items + np.arange(self.block_items)).ravel()
        w = np.repeat(w, self.block_items)[item < len(self.ids)]
        item = item[item < len(self.ids)]

        def impact(t, k):
            key = t * len(self.ids) + item[k]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            return np.where(self.keys[at] == key, self.values[at], 0.0)

        return self._at_least(w, item, window, term, impact, lambda i: self.need[i] - 1e-9)

    def _at_least(self, w, other, window, term, value, need):
        """Of pairs (w, other), those whose sum of value over the words of w is at least need(other)."""
        import numpy as np

        first, last = np.searchsorted(window, w, "left"), np.searchsorted(window, w, "right")
        sums = np.zeros(len(w))
        step = 1 << 15
        for at in range(0, len(w), step):
            f, n = first[at : at + step], (last - first)[at : at + step]
            starts = np.cumsum(n) - n
            place = np.repeat(f - starts, n) + np.arange(n.sum())
            k = np.repeat(np.arange(at, at + len(n)), n)
            sums[at : at + step] = np.add.reduceat(value(term[place], k), starts)
        ok = sums >= need(other)
        return w[ok], other[ok], sums[ok]

    def verified(self, item: int, held: Callable) -> tuple[float, float, float | None, str] | None:
        """Overlap of the item, its question and its answer with a passage and what of it is held, if enough for a leak. held: whether
        the passage has a shingle."""
        every, q, a = self.parts[item]
        share = lambda own: sum(map(held, own)) / len(own)
        whole, asked = share(every), share(q)
        if whole < OVERLAP and (asked < OVERLAP or len(q) < QUESTION_SHINGLES):
            return None
        told = share(a) if a else None
        found = asked >= OVERLAP, told is not None and told >= OVERLAP
        return whole, asked, told, {(True, True): "both", (True, False): "question", (False, True): "answer"}.get(found, "item")

    def search(self, words: list[list[str]]) -> list[tuple[int, int, float, float, float, float | None, str]]:
        """words: of each text. (text's place, item's place, score over self-score, overlaps of item, question and answer, part): best for each pair."""
        import numpy as np

        stride = self.width // 2
        get = self.terms.get
        ids, own, first, count = [], [], [], 0
        for ws in words:
            n = max(1, -(-(len(ws) - self.width) // stride) + 1)
            first.append(count)
            t = np.fromiter((get(w, -1) for w in ws), np.int64, len(ws))
            at = np.flatnonzero(t >= 0)
            lead = at // stride
            for back in (0, 1):
                k = lead - back
                ok = (k >= 0) & (k < n)
                ids.append(t[at[ok]])
                own.append(count + k[ok])
            count += n
        v = max(1, len(self.terms))
        pairs = np.unique(np.concatenate(own) * v + np.concatenate(ids)) if own else np.zeros(0, np.int64)
        best: dict[tuple[int, int], tuple] = {}
        seen, passage, grams = -1, [], {}

        def held(shingle: tuple[str, ...]) -> bool:
            n = len(shingle)
            if n not in grams:
                grams[n] = set(zip(*(passage[k:] for k in range(n)), strict=False))
            return shingle in grams[n]

        for w, item, score in zip(*(x.tolist() for x in self.retrieve(pairs // v, pairs % v)), strict=True):
            doc = int(np.searchsorted(first, w, "right")) - 1
            if w != seen:  # windows come in order
                start = (w - first[doc]) * stride
                seen, passage, grams = w, words[doc][start : start + self.width], {}
            found = self.verified(item, held)
            if found:
                row = (found[0], score / self.whole[item], *found[1:])
                best[doc, item] = max(best.get((doc, item), row), row, key=lambda r: r[:3])
        return [(d, i, s, o, *rest) for (d, i), (o, s, *rest) in best.items()]


FOUND = "doc_id long, __text long, item_id long, score double, overlap double, question_overlap double, answer_overlap double, part string"


def _searched(batches: Iterator[pa.RecordBatch], shard: list[Index]) -> Iterator[pa.RecordBatch]:
    types = (pa.int64(), pa.int64(), pa.int64(), *[pa.float64()] * 4, pa.string())
    names = [x.split()[0] for x in FOUND.split(", ")]
    for batch in batches:
        docs, hashes = batch.column("doc_id").to_pylist(), batch.column("__text").to_pylist()
        words = [words_of(t) for t in batch.column("text").to_pylist()]
        rows = [(docs[d], hashes[d], index.ids[i], *rest) for index in shard for d, i, *rest in index.search(words)]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(shard, len(ws), sorted(set(ws))) for shard, ws in zip(batch.column("shard").to_pylist(), map(words_of, batch.column("text").to_pylist()), strict=True) if ws]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.list_(pa.string())))], names=["shard", "n", "words"])


def indexes(benchmark: DataFrame) -> Iterator[list[Index]]:
    """Of each shard of items an index for each width; statistics are those of all items."""
    items = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    chars = items.agg(F.coalesce(F.sum(F.length("text") + 64), F.lit(0)).alias("chars")).collect()[0].chars
    shards = -(-chars // SHARD_CHARS)
    split = items.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, shards))))
    words = staged(split.select("shard", "text").mapInArrow(_item_words, "shard long, n long, words array<string>"), "item-words")
    n, mean = words.agg(F.count("*"), F.avg("n")).collect()[0]
    each = words.select("shard", F.explode("words").alias("word"))
    df = each.groupBy("word").agg(F.count("*").alias("df"))
    for shard in range(shards if n else 0):
        own = each.where(F.col("shard") == shard).select("word").distinct().join(df, "word").collect()
        rows = split.where(F.col("shard") == shard).select("item_id", "text").collect()  # about SHARD_CHARS characters, and the words in them
        stats, widths = Statistics(n, mean, {r.word: r.df for r in own}), defaultdict(list)
        for r in rows:
            if ws := words_of(r.text):
                widths[width_of(len(ws))].append(tuple(r))
        if widths:
            yield [Index(widths[w], stats, w) for w in sorted(widths)]


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, __text, item_id, score, overlaps): a row for each text and item that it leaks."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("__text"), "text")
    found = spark.createDataFrame([], FOUND)
    for shard in indexes(benchmark):
        sent = spark.sparkContext.broadcast(shard)
        found = found.unionByName(staged(rows.mapInArrow(lambda it, sent=sent: _searched(it, sent.value), FOUND), "found"))
        sent.unpersist()
    best = F.max(F.struct("overlap", "score", "question_overlap", "answer_overlap", "part")).alias("best")
    return found.groupBy("doc_id", "__text", "item_id").agg(best).select("doc_id", "__text", "item_id", "best.*")


def pairs(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each pair of ids."""
    best = F.max(F.struct("overlap", "score", "question_overlap", "answer_overlap", "part")).alias("best")
    return leaks(docs, benchmark).groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.*")


def cleaned(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows that leak an item, all columns kept."""
    return carried(docs, lambda d: _cleaned(d, benchmark))


def _cleaned(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    leaked = staged(leaks(docs, benchmark).select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("__id"), "__text").distinct(), "leaked")
    keyed = docs.withColumns({"__id": F.coalesce("doc_id", F.lit(NULL_ID)), "__text": F.xxhash64(F.coalesce("text", F.lit("")))})
    return without(keyed, leaked, ["__id", "__text"]).select(*docs.columns)
