"""Exact line dedup over a corpus, with DataFrame functions only.

Line keys are hashed to 128 bits and range-partitioned, sorted within each range by document and position, and
streamed once: the first document of a key keeps its lines, later ones lose theirs. The result is a run-length
bitmap for each document; texts never take part in the shuffle of lines.

A key found in a large share of all lines would fill one range. A mergeable sketch over all lines names such
keys; their first document comes from a map-side minimum instead and is broadcast. The sketch only picks the
route, either route gives the same verdict.

Defined cases: a null or empty text is one empty line; documents are told apart by doc_id, so rows that repeat
a doc_id are one document and share verdicts; a null doc_id counts as the smallest id; other columns are
ignored by ``keep_bitmaps`` and kept by ``apply_bitmaps``; no input rows give no output rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.llm.exprs import let, prefix_sums, top_items
from wardline.llm.sieve import sifted
from wardline.llm.storage import carried, staged

MIN_KEY_CHARS = 10
#: A key is hot from this share of the lines on; the sketch tracks HOT_TRACKED keys, so at most that many are broadcast.
HOT_SHARE, HOT_KEYS, HOT_TRACKED = 0.001, 1_000, 20_000
NULL_ID = -(2**63)
BLANK = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def text_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """ASCII white space stripped at both ends, A-Z lower-cased; the fast lower() where it means the same."""
    inner = F.btrim(line, F.lit(BLANK))
    return F.when(F.length(inner) == F.octet_length(inner), F.lower(inner)).otherwise(F.translate(inner, UPPER, LOWER))


def row_id(doc_id: Column, text: Column) -> list[Column]:
    """A row's identity: equal rows have equal lines, so they may share a bitmap."""
    return [F.coalesce(doc_id, F.lit(NULL_ID)).alias("__id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("__text")]


def _keyed_lines(docs: DataFrame) -> DataFrame:
    rows = docs.select(*row_id(F.col("doc_id"), F.col("text")), F.posexplode(text_lines(F.col("text"))).alias("__pos", "__line"))
    keyed = rows.select("__id", "__text", "__pos", line_key(F.col("__line")).alias("__key")).where(F.length("__key") >= MIN_KEY_CHARS)
    return keyed.select("__id", "__text", "__pos", F.xxhash64("__key").alias("__h1"), F.xxhash64(F.lit("second"), F.col("__key")).alias("__h2"))


def _hot_keys(lines: DataFrame) -> DataFrame:
    """First hashes of very common keys: at most HOT_KEYS rows."""
    n = lines.count()
    return top_items(lines, "__h1", HOT_KEYS, HOT_TRACKED).where(F.col("count") > max(1000, n * HOT_SHARE)).select(F.col("item").alias("__h1")).distinct()


def dropped_lines(docs: DataFrame) -> DataFrame:
    """(__id, __text, __pos) of every line that an earlier document holds."""
    lines = staged(_keyed_lines(docs), "line-keys")  # texts are read once; all that follows reads this narrow table
    hot = lines.sparkSession.createDataFrame(_hot_keys(lines).collect(), "__h1 long")  # HOT_KEYS rows at most
    first_of_hot = lines.join(F.broadcast(hot), "__h1", "left_semi").groupBy("__h1", "__h2").agg(F.min("__id").alias("__first"))
    seen_hot = lines.join(F.broadcast(first_of_hot), ["__h1", "__h2"]).where(F.col("__id") > F.col("__first"))
    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = lines.join(F.broadcast(hot), "__h1", "left_anti").repartitionByRange(parts, "__h1", "__h2").sortWithinPartitions("__h1", "__h2", "__id", "__pos")
    first = F.first("__id").over(Window.partitionBy("__h1", "__h2").orderBy("__id", "__pos").rowsBetween(Window.unboundedPreceding, 0))
    seen = ranged.withColumn("__first", first).where(F.col("__id") > F.col("__first"))
    return seen.select("__id", "__text", "__pos").unionByName(seen_hot.select("__id", "__text", "__pos"))


def _runs(dropped: Column) -> Column:
    """Sorted dropped positions as lengths of alternating runs: kept, dropped, kept, dropped, ..."""

    def runs(at: Column) -> Column:
        gaps = F.transform(at, lambda x, i: F.struct((x - F.when(i == 0, F.lit(-1)).otherwise(F.get(at, i - 1)) - 1).alias("gap"), i.alias("i")))
        starts = F.filter(gaps, lambda g: (g["i"] == 0) | (g["gap"] > 0))
        return let(starts, lambda ss: F.flatten(F.transform(ss, lambda s, k: F.array(s["gap"], F.coalesce(F.get(ss, k + 1)["i"], F.size(at)) - s["i"]))))

    return let(dropped, runs)


def keep_bitmaps(docs: DataFrame) -> DataFrame:
    """(doc key, keep_runs): the run-length bitmap of each document that loses lines; others need none."""
    marked = dropped_lines(docs).groupBy("__id", "__text").agg(F.array_sort(F.collect_set("__pos")).alias("__dropped"))
    return marked.select("__id", "__text", _runs(F.col("__dropped")).alias("keep_runs"))


def _kept_lines(lines: Column, runs: Column) -> Column:
    """Even runs are kept; what follows the last run is kept too."""

    def kept(ls: Column, rs: Column, ends: Column) -> Column:
        pieces = F.transform(F.sequence(F.lit(0), (F.size(rs) / 2).cast("int")), lambda k: F.slice(ls, F.get(ends, 2 * k) + 1, F.coalesce(F.get(rs, 2 * k), F.size(ls) - F.get(ends, 2 * k))))
        return F.flatten(pieces)

    return let(lines, lambda ls: let(runs, lambda rs: let(prefix_sums(rs), lambda ends: kept(ls, rs, ends))))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """docs with n_lines, n_dropped, keep_runs and the kept text in ``kept_text``, in place of columns so named."""
    return carried(docs.drop("n_lines", "n_dropped", "keep_runs", "kept_text"), lambda d: _apply_bitmaps(d, bitmaps))


def _apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    ids = row_id(F.col("doc_id"), F.col("text"))
    key = ["__id", "__text"]
    # texts that have no bitmap for certain stay where they are
    perhaps, whole = sifted(docs.withColumns({"__id": ids[0], "__text": ids[1]}), bitmaps, key)
    none = F.lit(None).cast(bitmaps.schema["keep_runs"].dataType)
    joined = perhaps.join(bitmaps.hint("merge"), key, "left").unionByName(whole.withColumn("keep_runs", none)).drop(*key)
    lines = text_lines(F.col("text"))
    odd = F.filter(F.col("keep_runs"), lambda n, i: i % 2 == 1)
    kept = F.when(F.col("keep_runs").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(_kept_lines(lines, F.col("keep_runs")), "\n"))
    n_dropped = F.coalesce(F.aggregate(odd, F.lit(0), lambda a, n: a + n), F.lit(0)).cast("long")
    return joined.withColumns({"n_lines": F.size(lines).cast("long"), "n_dropped": n_dropped, "kept_text": kept})


def dedup_lines(docs: DataFrame) -> DataFrame:
    return apply_bitmaps(docs, staged(keep_bitmaps(docs), "bitmaps"))


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns for each document, with the bitmap itself."""
    out = dedup_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"), "keep_runs")
