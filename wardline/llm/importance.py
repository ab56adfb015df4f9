"""Target-distribution importance resampling: documents drawn as if from the distribution of a target collection.

Features are the runs of 1 to ``max_run`` consecutive words of a text, hashed into buckets. One pass over the texts writes
packed streams: for each Arrow batch the uint16 buckets of all its features, one document after the other, with each
document's size. Counting is external: every stream is sorted as one run (a radix sort, two bytes to an item) and
run-length encoded, a task adds the runs up in one table of all buckets, and Spark sums these tables. A later pass
over the streams, not the texts, gathers each feature's gain by its bucket and sums within documents by
``np.add.reduceat`` at their offsets. Gumbel noise from a hash of the doc_id makes the highest scores a draw
without replacement with chances in proportion to the weights.

Ranks need no global order in one task: scores are whole numbers in a range that arithmetic bounds (SCORES), so the
rows above a score are summed over classes of equal score, in two levels, and only rows inside a class are ordered.

Memory is bounded by an Arrow batch, a slice of a text (SLICE) and tables of ``buckets`` numbers.

Defined cases: a null or empty text, or one without words, has no features, a weight of 0, and takes no part in the draw;
a null doc_id is hashed as an empty string and comes last among ties; rows that repeat a doc_id and text are scored and
ranked each, in any order among themselves; an empty target has the counts 0; extra columns are ignored by ``digest``
and kept by ``resampled``; no input rows give no output rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardline.llm.sieve import sifted
from wardline.llm.storage import carried, small_batches, staged

BUCKETS, MAX_RUN = 10_000, 1
MIN_WORDS, PERCENT, SEED = 20, 10, 2024
SLICE = 1 << 20
#: How many different scores can occur: gains and noise both stay within 1000 times the logarithm of a 64-bit number.
SCORES = 1 << 17
CLASS = 256

_UPPER = range(ord("A"), ord("Z") + 1)
_KEPT = {*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), *range(128, 256)}
#: Bytes of UTF-8: A-Z lower-cased, those of words kept, all others blank.
_WORDED = bytes(b + 32 if b in _UPPER else b if b in _KEPT else 32 for b in range(256))


def slices(text: bytes, size: int = SLICE) -> Iterator[bytes]:
    """A text of words and blanks in pieces that end at a blank, each of about ``size`` bytes unless a word is longer."""
    at = 0
    while len(text) - at > size:
        cut = text.find(b" ", at + size)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


def hashed(text: bytes, max_run: int, buckets: int):
    """The number of words of a text (UTF-8), and the buckets of its features as uint16."""
    from zlib import crc32

    import numpy as np

    n, parts, tail = 0, [], []
    for piece in slices(text.translate(_WORDED)):
        own = piece.split()
        n += len(own)
        words, old = tail + own, len(tail)
        sums = list(map(crc32, words))
        for run in range(1, max_run + 1):
            if run > 1:  # the sum of a run goes on from that of the run without its last word
                sums = list(map(crc32, (b" " + w for w in words[run - 1 :]), sums))
            parts.append(np.array(sums[max(0, old - run + 1) :], np.uint32) % np.uint32(buckets))
        tail = words[1 - max_run :] if max_run > 1 else []
    return n, np.concatenate(parts).astype("<u2")


STREAMS = "ids array<long>, texts array<long>, words array<long>, sizes array<long>, stream binary"
_LISTS = pa.list_(pa.int64())


def _packed(batches: Iterator[pa.RecordBatch], max_run: int, buckets: int) -> Iterator[pa.RecordBatch]:
    import numpy as np

    for batch in batches:
        if not batch.num_rows:
            continue
        found = [hashed(t or b"", max_run, buckets) for t in batch.column("text").cast(pa.binary()).to_pylist()]
        words, sizes = [n for n, _ in found], [len(b) for _, b in found]
        stream = np.concatenate([b for _, b in found]).tobytes()
        lists = [batch.column("doc_id").to_pylist(), batch.column("__text").to_pylist(), words, sizes]
        yield pa.RecordBatch.from_arrays([*(pa.array([x], _LISTS) for x in lists), pa.array([stream], pa.binary())], names=["ids", "texts", "words", "sizes", "stream"])


def _text_key():
    return F.xxhash64(F.coalesce("text", F.lit("")))


def streams(docs: DataFrame, max_run: int = MAX_RUN, buckets: int = BUCKETS) -> DataFrame:
    """The packed bucket streams of all texts, kept in the shared folder."""
    if not 1 <= buckets <= 1 << 16:
        raise ValueError("a bucket must fit 16 bits")
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _text_key().alias("__text"))
    return staged(rows.mapInArrow(lambda it: _packed(it, max_run, buckets), STREAMS), "streams")


def runs(stream: bytes):
    """(buckets, lengths) of a stream once it is sorted."""
    import numpy as np

    ordered = np.sort(np.frombuffer(stream, "<u2"), kind="stable")
    heads = np.flatnonzero(np.diff(ordered, prepend=ordered[:1] ^ 1)) if len(ordered) else np.zeros(0, np.int64)
    return ordered[heads], np.diff(heads, append=len(ordered))


def _counted(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    import numpy as np

    total = np.zeros(buckets, np.int64)
    for batch in batches:
        for stream in batch.column("stream").to_pylist():
            found, lengths = runs(stream)
            total[found] += lengths
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["bucket", "n"])


def counts(packed: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Features of all documents in each bucket: a table of fixed size."""
    found = packed.select("stream").mapInArrow(lambda it: _counted(it, buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = [0] * buckets
    for r in found.collect():
        out[r.bucket] = r.n
    return out


def gains(corpus: list[int], target: list[int]) -> list[int]:
    """Of each bucket: thousandths of the logarithm of how much likelier the target is to have it, smoothed by one."""
    n, all_s, all_t = len(corpus), float(sum(corpus)), float(sum(target))
    return [math.floor(1000 * math.log((t + 1.0) * (all_s + n) / ((s + 1.0) * (all_t + n)))) for s, t in zip(corpus, target, strict=True)]


def noise(seed: int, doc_id: int | None) -> int:
    """Thousandths of a Gumbel variate, fixed by the doc_id."""
    from hashlib import sha256

    h = int.from_bytes(sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()[:4], "big")
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


SCORED = "doc_id long, __text long, n_words long, n_features long, weight long, score long"


def _scored(batches: Iterator[pa.RecordBatch], gain: list[int], seed: int) -> Iterator[pa.RecordBatch]:
    import numpy as np

    gain = np.array(gain, np.int64)
    for batch in batches:
        for row in batch.to_pylist():
            sizes = np.array(row["sizes"], np.int64)
            some = sizes > 0
            sums = np.zeros(len(sizes), np.int64)
            if some.any():
                sums[some] = np.add.reduceat(gain[np.frombuffer(row["stream"], "<u2")], (np.cumsum(sizes) - sizes)[some])
            weight = sums // np.maximum(sizes, 1)
            score = weight + np.array([noise(seed, d) for d in row["ids"]], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (row["ids"], row["texts"], row["words"], sizes, weight, score)], names=[x.split()[0] for x in SCORED.split(", ")])


def scored(docs: DataFrame, target: DataFrame, *, max_run: int = MAX_RUN, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """Weight and score of each document. target: texts of the distribution that is wanted."""
    packed = streams(docs, max_run, buckets)
    wanted = streams(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), max_run, buckets)
    gain = gains(counts(packed, buckets), counts(wanted, buckets))
    return staged(packed.mapInArrow(lambda it: _scored(it, gain, seed), SCORED), "scored")


def ranked(rows: DataFrame, *, min_words: int = MIN_WORDS, percent: int = PERCENT) -> DataFrame:
    """rows, staged, with their rank in the draw: ``percent`` of the rows that have ``min_words`` words, the rest null."""
    fit = F.col("n_words") >= min_words
    level = F.floor(F.col("score") / CLASS)
    scores = staged(rows.where(fit).groupBy("score").agg(F.count("*").alias("n")).withColumn("level", level), "scores")
    up = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    levels = scores.groupBy("level").agg(F.sum("n").alias("n"))  # SCORES / CLASS rows at most
    above = levels.select("level", up(Window.orderBy(F.desc("level"))).alias("higher"))
    placed = scores.withColumn("above", up(Window.partitionBy("level").orderBy(F.desc("score")))).join(F.broadcast(above), "level")
    size = (scores.agg(F.sum("n")).collect()[0][0] or 0) * percent // 100
    top = placed.select("score", (F.col("above") + F.col("higher")).alias("above")).where(F.col("above") < size)
    met = rows.join(F.broadcast(top.withColumn("__fit", F.lit(True)).withColumnRenamed("score", "__score")), fit & (F.col("score") == F.col("__score")), "left")  # SCORES rows at most
    order = Window.partitionBy("score").orderBy(F.asc_nulls_last("doc_id"), "__text")
    rank = F.col("above") + F.row_number().over(order)
    drawn = met.where("__fit").withColumn("rank", F.when(rank <= size, rank)).select(*rows.columns, "rank")
    return drawn.unionByName(met.where("__fit IS NULL").select(*rows.columns, F.lit(None).cast("long").alias("rank")))


def digest(docs: DataFrame, target: DataFrame) -> DataFrame:
    """The contract's columns for each document."""
    return ranked(scored(docs, target)).select("doc_id", "n_features", "weight", "score", "rank")


def resampled(docs: DataFrame, target: DataFrame, *, min_words: int = MIN_WORDS, percent: int = PERCENT, **how) -> DataFrame:
    """The documents drawn, with all their columns; texts that cannot be among them are not shuffled."""

    def work(d: DataFrame) -> DataFrame:
        rows = ranked(scored(d, target, **how), min_words=min_words, percent=percent)
        won = staged(rows.where("rank IS NOT NULL").select(F.col("doc_id").alias("__id"), "__text").distinct(), "drawn")
        keyed = d.withColumns({"__id": F.col("doc_id").cast("long"), "__text": _text_key()})
        perhaps, _ = sifted(keyed, won, ["__id", "__text"])
        same = F.col("__id").eqNullSafe(F.col("w_id")) & (F.col("__text") == F.col("w_text"))
        return perhaps.join(won.toDF("w_id", "w_text").hint("merge"), same, "left_semi").select(*d.columns)

    return carried(docs, work)
