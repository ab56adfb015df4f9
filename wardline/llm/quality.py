"""Quality rules: base counts of each text, and lines that too many documents of one host share.

One pass over the texts makes a narrow table: the counts, and for each distinct line its hash and words. Everything
after it works on that table. For each host, a line's documents are counted with exact copies as one document, so a
copied text does not turn its own lines into boilerplate. A line is over the limits if it is in more than LINE_DOCS of
them, or in more than SMALL_DOCS and more than LINE_SHARE of the host's: a host of any size can have such lines, and a
large one has them at a number that does not grow with it. They are removed from all but the first document that holds
them; a document left with less than KEPT_SHARE of its words is depleted and rejected. ``filtered`` writes the other texts
without their removed lines.

Hot hosts and hot lines: copies are collapsed by text first, then counts are summed map-side; no group of documents
is ever gathered. The table of removed lines is written before it is joined, so Spark broadcasts it only if its
size on disk is below the session's limit and else joins by shuffle.

Defined cases: a null text has no words and fails the base rule; a null host is a host of its own; lines without
words are never counted; rows that repeat a doc_id are judged each by their own text; the base rules are those of the text as it came; extra columns
are ignored by ``digest`` and kept by ``filtered``, n_chars as it came; no input rows give no output rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, LongType, StructField, StructType

from wardline.llm.sieve import sifted
from wardline.llm.storage import carried, small_batches, staged

MIN_WORDS, REPEAT_PERCENT = 50, 50
LINE_DOCS, SMALL_DOCS, LINE_SHARE, KEPT_SHARE = 50, 5, 0.1, 0.75

KEYS = ["__id", "__text", "__host"]
NULL_ID = -(2**63)

_SPACE = " \t\n\x0b\x0c\r"
_WORD = re.compile(f"[^{_SPACE}]+")
_SYMBOLS = str.maketrans(dict.fromkeys("#*$%&|<>", None))

COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
SCHEMA = f"doc_id long, __id long, __text long, __host string, {COUNTS}, lines array<struct<hash:long,words:int>>"


def repeat_words(words: list[str]) -> int:
    """Words inside 3-word windows that the text has at least twice."""
    import numpy as np

    n = len(words)
    if n < 4:
        return 0
    seen: dict[str, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    if len(seen) == n:
        return 0
    pairs = np.unique(ids[:-1] * len(seen) + ids[1:], return_inverse=True)[1].astype(np.int64)
    _, inverse, counts = np.unique(pairs[:-1] * len(seen) + ids[2:], return_inverse=True, return_counts=True)
    found = counts[inverse] > 1
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= found
    return int(covered.sum())


def counts(text: str) -> tuple[int, int, int, int, int]:
    words = _WORD.findall(text)
    worded = [x for x in text.split("\n") if _WORD.search(x)]
    return len(words), sum(map(len, words)), len(text) - len(text.translate(_SYMBOLS)), len(worded) - len(set(worded)), repeat_words(words)


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _hash(words: list[str]) -> int:
    """Of a normalised line."""
    from xxhash import xxh64_intdigest

    return _signed(xxh64_intdigest(" ".join(words).lower().encode(), 42))


def _lines(text: str) -> list[dict]:
    """Hash and words of each distinct normalised line."""
    own: dict[int, int] = {}
    for line in text.split("\n"):
        words = _WORD.findall(line)
        if words:
            h = _hash(words)
            own[h] = own.get(h, 0) + len(words)
    return [{"hash": h, "words": n} for h, n in own.items()]


LINES = pa.list_(pa.struct([("hash", pa.int64()), ("words", pa.int32())]))


def _profiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        found = list(map(counts, texts))
        columns = zip(*found, strict=True) if found else [[]] * 5
        own = [batch.column(c) for c in ("doc_id", *KEYS)]
        yield pa.RecordBatch.from_arrays([*own, *(pa.array(c, pa.int64()) for c in columns), pa.array(list(map(_lines, texts)), LINES)], names=["doc_id", *KEYS, *names(COUNTS), "lines"])


def profile(docs: DataFrame) -> DataFrame:
    """The narrow table: counts and hashed lines of every text, with the keys of its row and host."""
    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text", *_keys()).mapInArrow(_profiled, SCHEMA)


def names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _keys() -> list[Column]:
    host = F.when(F.col("source").isNull(), F.lit("none")).otherwise(F.concat(F.lit("="), F.col("source").cast("string")))
    return [F.coalesce("doc_id", F.lit(NULL_ID)).alias("__id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("__text"), host.alias("__host")]


def removed_lines(profiles: DataFrame) -> DataFrame:
    """(__host, hash, first_id): lines over the limits, and the one document that keeps each."""
    texts = profiles.groupBy("__host", "__text").agg(F.min("__id").alias("id"), F.first("lines").alias("lines"))
    sizes = profiles.groupBy("__host").agg(F.count_distinct("__text").alias("n_docs"))
    held = texts.select("__host", "id", F.explode("lines.hash").alias("hash")).groupBy("__host", "hash").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))
    many, share = F.col("n") > LINE_DOCS, F.col("n") > F.col("n_docs") * LINE_SHARE
    over = held.where(F.col("n") > SMALL_DOCS).join(sizes, "__host").where(many | share)
    return over.select("__host", "hash", "first_id")


def removed_words(profiles: DataFrame) -> DataFrame:
    """Keys, n_removed_words and hashes of the lines removed, of the rows that lose some. profiles: keys and lines, staged."""
    removed = staged(removed_lines(profiles), "removed-lines")
    lines = profiles.select(*KEYS, F.explode("lines").alias("line")).select(*KEYS, F.col("line.hash").alias("hash"), F.col("line.words").alias("words"))
    hits = lines.join(removed, ["__host", "hash"]).where(F.col("__id") != F.col("first_id"))
    return hits.groupBy(*KEYS, "hash").agg(F.first("words").alias("words")).groupBy(*KEYS).agg(F.sum("words").alias("n_removed_words"), F.collect_list("hash").alias("removed"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def depleted() -> Column:
    return F.col("n_words") - F.col("n_removed_words") < KEPT_SHARE * F.col("n_words")


def judged(docs: DataFrame) -> DataFrame:
    """Keys, counts, base_failed, the words that removed lines held, and kept, for each row."""
    profiles = staged(profile(docs), "profiles")
    out = profiles.drop("lines").join(removed_words(profiles).drop("removed"), KEYS, "left").withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0)))
    return out.withColumns({"base_failed": base_failed(), "kept": ~base_failed() & ~depleted()})


_PREFIX = "__quality_"


def _carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches with their profiles; texts that fail the base rules have served and are left out."""
    for batch in batches:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        found = list(map(counts, texts))
        n_words, n_repeats = ([f[k] for f in found] for k in (0, 4))
        failed = pa.array([n < MIN_WORDS or 100 * r > REPEAT_PERCENT * n for n, r in zip(n_words, n_repeats, strict=True)], pa.bool_())
        columns = [pc.if_else(failed, None, c) if name == "text" else c for name, c in zip(batch.schema.names, batch.columns, strict=True)]
        yield pa.RecordBatch.from_arrays([*columns, failed, pa.array(n_words, pa.int64()), pa.array(list(map(_lines, texts)), LINES)], names=[*batch.schema.names, *(f"{_PREFIX}{c}" for c in ("failed", "n_words", "lines"))])


def without(text: str, removed: set[int]) -> str:
    """The text without the lines of these hashes; lines without words stay."""
    return "\n".join(line for line in text.split("\n") if not ((words := _WORD.findall(line)) and _hash(words) in removed))


def _rebuilt(text: pa.Array, removed: pa.Array) -> pa.Array:
    """A null text, of a row that loses no line, stays null."""
    rows = zip(text.to_pylist(), removed.to_pylist(), strict=True)
    return pa.array([None if t is None else without(t, set(hashes)) for t, hashes in rows], pa.string())


def filtered(docs: DataFrame) -> DataFrame:
    """docs without the rows that the rules reject, and texts without their removed lines; all columns kept. Texts are
    carried along while they are profiled; what the rows that lose lines lose is joined to those rows alone."""
    return carried(docs, lambda d: _filtered(d))


def _filtered(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    keyed = docs.withColumns(dict(zip(KEYS, _keys(), strict=True)))
    schema = StructType([*keyed.schema, *(StructField(f"{_PREFIX}{c}", t) for c, t in (("failed", BooleanType()), ("n_words", LongType()), ("lines", DataType.fromDDL("array<struct<hash:long,words:int>>"))))])
    rows = staged(keyed.mapInArrow(_carried, schema), "carried")
    profiles = rows.select(*KEYS, F.col(f"{_PREFIX}lines").alias("lines"))
    good = rows.where(~F.col(f"{_PREFIX}failed"))
    # one row for each key: rows of the same id and text share it
    lost = staged(removed_words(profiles).withColumnsRenamed({c: f"{_PREFIX}{c}" for c in ("n_removed_words", "removed")}), "lost")
    perhaps, whole = sifted(good, lost, KEYS)
    left = F.col(f"{_PREFIX}n_words") - F.coalesce(f"{_PREFIX}n_removed_words", F.lit(0))
    kept = perhaps.join(lost.hint("merge"), KEYS, "left").where(left >= KEPT_SHARE * F.col(f"{_PREFIX}n_words"))
    hit = F.col(f"{_PREFIX}removed").isNotNull()
    rebuilt = F.arrow_udf(_rebuilt, "string")(F.when(hit, F.col("text")), f"{_PREFIX}removed")
    return kept.withColumn("text", F.coalesce(rebuilt, "text")).select(*docs.columns).unionByName(whole.select(*docs.columns))


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns for each document, with the words that removed lines held."""
    return judged(docs).drop(*KEYS)
