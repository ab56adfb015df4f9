"""Token counts of whole texts, by a two-tier lookup inside the map tasks.

A text is cut into pre-tokens at single ASCII blanks. The tokenizer drops white space and none of its rules look
across it, so a text's count is the sum over its pre-tokens. The lengths of the most frequent pre-tokens are
broadcast as one compact table, two arrays, which Arrow hashes and asks for a whole batch of pre-tokens at once; a
mergeable sketch over all texts names them, so no pre-token is shuffled. What that table misses goes, once for each batch,
to a cache of the Python worker, and what that misses is encoded by the library.
The table only saves time: counts are the library's own with any table, an empty one included.

Memory is bounded: the table by TABLE_ROWS entries of TABLE_CHARS characters, a worker's cache by CACHE_ROWS.

Defined cases: a null text is empty and has no tokens; special strings inside texts are handled as by the library;
rows that repeat a doc_id are counted each; extra columns are ignored; no input rows give no output rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm.exprs import top_items
from wardline.llm.pieces import Pieces, tokenizer
from wardline.llm.storage import small_batches

TABLE_ROWS, TABLE_TRACKED, TABLE_CHARS = 8_192, 32_768, 64
CACHE_ROWS = 1_000_000
LIMIT = 2048
#: Blanks that every party agrees on; other white space stays inside a pre-token, and the library drops it there.
BLANKS = " \t\n\r"


def frequent(docs: DataFrame) -> list[str]:
    """The most frequent pre-tokens of all texts, from a sketch of fixed size."""
    words = docs.select(F.explode(F.split("text", f"[{BLANKS}]+")).alias("word")).where(F.length("word").between(1, TABLE_CHARS))
    return [r["item"] for r in top_items(words, "word", TABLE_ROWS, TABLE_TRACKED).collect()]


SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def second_tier(path: str) -> Pieces:
    encode = tokenizer(path).encode
    return Pieces(path, CACHE_ROWS, "", True, len, lambda piece: len(encode(piece, add_special_tokens=False).ids))


@cache
def worker_tier(path: str) -> Pieces:
    """One for each Python worker, which keeps it from task to task."""
    return second_tier(path)


class Counter:
    """Both tiers. table: of the first, pre-tokens and their lengths."""

    def __init__(self, path: str, table: dict[str, int], sizes: Pieces | None = None):
        import numpy as np

        self.sizes = second_tier(path) if sizes is None else sizes
        self.words, self.lengths = pa.array(["", *table], pa.string()), np.array([0, *table.values()], np.int64)

    def counts(self, texts: pa.Array):
        """The first tier is asked for all pre-tokens of the batch at once; each that it lacks is asked of the second once."""
        import numpy as np

        split = pc.split_pattern_regex(pc.fill_null(texts, ""), f"[{BLANKS}]")  # at least one for each text, empty ones too
        flat = split.flatten()
        at = pc.index_in(flat, value_set=self.words)
        n = self.lengths[pc.fill_null(at, 0).to_numpy()]
        missed = at.is_null()
        if pc.any(missed).as_py():
            rest = flat.filter(missed).dictionary_encode()
            n[missed.to_numpy(zero_copy_only=False)] = np.array([self.sizes[w] for w in rest.dictionary.to_pylist()], np.int64)[rest.indices.to_numpy()]
        offsets = split.offsets.to_numpy()
        return np.add.reduceat(n, offsets[:-1] - offsets[0]) if len(texts) else n

    def count(self, text: str | None) -> int:
        return int(self.counts(pa.array([text], pa.string()))[0])


def _counted(batches: Iterator[pa.RecordBatch], path: str, table: tuple[pa.Array, pa.Array]) -> Iterator[pa.RecordBatch]:
    counter = Counter(path, {}, worker_tier(path))
    counter.words, counter.lengths = table[0], table[1].to_numpy()
    for batch in batches:
        texts = batch.column("text")
        n = counter.counts(texts)
        n_bytes = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), n_bytes, pa.array(n, pa.int64()), pa.array(n > LIMIT, pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])


def tokens(text: Column, path: str) -> Column:
    """The tokens of a text as a column, for plans that carry other columns along: by the worker caches alone."""

    def counted(texts: pa.Array) -> pa.Array:
        return pa.array(Counter(path, {}, worker_tier(path)).counts(texts), pa.int64())

    return F.arrow_udf(counted, "long")(text)


def count_tokens(docs: DataFrame, path: str, words: list[str] | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row. path: of the tokenizer's file, on every node;
    words: the pre-tokens of the broadcast table, by default the corpus's most frequent."""
    spark = docs.sparkSession
    small_batches(spark)
    sizes = worker_tier(path)
    known = Counter(path, {w: sizes[w] for w in (frequent(docs) if words is None else words) if w})
    table = spark.sparkContext.broadcast((known.words, pa.array(known.lengths)))
    return docs.select("doc_id", "text").mapInArrow(lambda it: _counted(it, path, table.value), SCHEMA)
