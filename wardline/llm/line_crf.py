"""Quality of documents from their lines: a linear-chain conditional random field calls each line good or bad.

A line's features are its own measures and those of the lines before and behind it; two weights for each pair of neighbouring
labels tie the chain. With two labels all messages are log-odds, so forward-backward is one number a line in each
direction, worked out for all documents of a batch side by side, position by position. A document's score is the mean of
its lines' chances of being good, each weighted by the line's length.

Only documents are labelled, so in fitting each line takes its document's label; the chain, not the single line, carries
it. The fit is by maximum likelihood (BFGS; every document weighs alike, whatever its length) on a bounded sample of the labelled rows
that are not held out: the FIT_DOCS lowest by a hash of the doc_id, without those that would bring the sample above FIT_LINES
lines. Everything else covers all documents and whole texts.

Labels, lang, source and doc_id are no inputs of a score: equal texts have equal scores.

Defined cases: a null or empty text is one empty line and is scored as such; a document labelled more than once has the
lowest label; null labels are left out; if the sample holds one label alone, every score is that label to within 1e-100, and 0.5 if it is empty; rows that repeat a doc_id are scored each; extra columns are ignored by ``digest`` and kept by
``filtered``; no input rows give no output rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from wardline.llm.storage import carried, small_batches

#: Bounds of the sample that the weights are fitted on: documents, and lines of all of them.
FIT_DOCS, FIT_LINES = 4_000, 100_000
FOLDS, THRESHOLD, SEED = 5, 0.3, 13
PENALTY, STEPS = 1e-4, 80
#: Bytes whose classes are counted at once.
SLICE = 1 << 22

#: Classes of bytes of UTF-8, by which lines are measured.
BLANK, DIGIT, UPPER, LOWER, STOP, MARK, SYMBOL, WIDE, REST = range(9)
_STOPS, _MARKS = ".,;:'\"()-", "!?"


def _class(b: int) -> int:
    c = chr(b)
    if b >= 128:
        return REST if b < 192 else WIDE  # bytes that go on with a character count nothing
    if c.isdigit():
        return DIGIT
    if c.isalpha():
        return UPPER if c.isupper() else LOWER
    return BLANK if b <= 32 or b == 127 else STOP if c in _STOPS else MARK if c in _MARKS else SYMBOL


CLASSES = bytes(map(_class, range(256)))
MEASURES = ("empty", "size", "words", "digits", "upper", "stops", "marks", "symbols", "blanks", "word_size", "repeated", "doubled", "ends", "begins", "again")


def class_counts(raw: bytes, n_lines: int):
    """Of each line the bytes of each class, but for the line feeds."""
    import numpy as np

    table, kinds = np.zeros((n_lines, 9), np.int64), np.frombuffer(CLASSES, np.uint8)
    line = 0
    for at in range(0, len(raw), SLICE):
        part = np.frombuffer(raw[at : at + SLICE], np.uint8)
        feeds = part == 10
        lines = np.cumsum(feeds) - feeds
        found = np.bincount(lines * 9 + kinds[part], minlength=9 * (int(lines[-1]) + 1)).reshape(-1, 9)
        table[line : line + len(found)] += found
        line += int(feeds.sum())
    table[:-1, BLANK] -= 1
    return table


def measured(texts: list[str]):
    """The measures of all lines, the lines' lengths in characters, and the number of lines of each text."""
    import numpy as np

    lines, counts, again = [], [], []
    for text in texts:
        own = text.split("\n")
        seen: set[str] = set()
        for line in own:
            again.append(line in seen)
            if line:
                seen.add(line)
        lines += own
        counts.append(len(own))
    words = np.zeros((len(lines), 5))
    for k, line in enumerate(lines):
        ws = line.split()
        if ws:
            n = len(ws)
            words[k] = n, n - len(set(ws)), sum(map(eq, ws, ws[1:])), ws[-1][-1] in ".!?…", ws[0][0].isupper()
    c = class_counts("\n".join(lines).encode("utf-8", "surrogatepass"), len(lines)).astype(float) if lines else np.zeros((0, 9))
    size = c.sum(axis=1) - c[:, REST]
    chars, letters, n = np.maximum(size, 1), np.maximum(c[:, UPPER] + c[:, LOWER] + c[:, WIDE], 1), np.maximum(words[:, 0], 1)
    columns = [
        size == 0, np.log1p(size) / 5, np.log1p(words[:, 0]) / 4, c[:, DIGIT] / chars, c[:, UPPER] / letters, c[:, STOP] / chars, c[:, MARK] / chars, c[:, SYMBOL] / chars, c[:, BLANK] / chars,
        np.minimum((size - c[:, BLANK]) / n / 10, 3), words[:, 1] / n, words[:, 2] / n, words[:, 3], words[:, 4], again,
    ]
    return np.column_stack(columns) if lines else np.zeros((0, len(MEASURES))), size, counts


def features(own, counts: list[int]):
    """Each line's measures, those of its neighbours (zeros beyond the ends), whether it is first or last, and a one."""
    import numpy as np

    n, k = own.shape
    ends = np.cumsum(counts)
    first, last = np.zeros(n, bool), np.zeros(n, bool)
    first[ends - counts], last[ends - 1] = True, True
    before, behind = np.zeros((n, k)), np.zeros((n, k))
    before[1:], behind[:-1] = own[:-1], own[1:]
    before[first], behind[last] = 0, 0
    return np.column_stack([own, before, behind, first, last, np.ones(n)])


def line_odds(own, counts: list[int], weights):
    """features(own, counts) @ weights, without the table of features."""
    import numpy as np

    w, ends = np.asarray(weights), np.cumsum(counts)
    k = len(MEASURES)
    first, last = ends - counts, ends - 1
    before, behind = np.roll(own @ w[k : 2 * k], 1), np.roll(own @ w[2 * k : 3 * k], -1)
    before[first], behind[last] = 0, 0
    odds = own @ w[:k] + before + behind + w[-1]
    odds[first] += w[-3]
    odds[last] += w[-2]
    return odds


@dataclass(frozen=True)
class Field:
    """weights: log-odds of a good line by its features. ties: of each pair of neighbouring labels (bad bad, bad good,
    good bad, good good)."""

    weights: list[float]
    ties: list[float]


def messages(odds, counts: list[int], ties):
    """Log-odds of each line from the lines before it with itself, and from those behind it, for chains one after the other."""
    import numpy as np

    counts = np.asarray(counts)
    order = np.argsort(-counts, kind="stable")
    starts, sizes = (np.cumsum(counts) - counts)[order], counts[order]
    bb, bg, gb, gg = ties
    forward, backward = odds.copy(), np.zeros_like(odds)
    longest = int(sizes[0]) if len(sizes) else 0
    alive = np.searchsorted(-sizes, -np.arange(longest), side="left")  # chains longer than a position
    for t in range(1, longest):
        at = starts[: alive[t]] + t
        a = forward[at - 1]
        forward[at] += np.logaddexp(a + gg, bg) - np.logaddexp(a + gb, bb)
    for t in range(longest - 2, -1, -1):
        at = starts[: alive[t + 1]] + t
        b = odds[at + 1] + backward[at + 1]
        backward[at] = np.logaddexp(b + gg, gb) - np.logaddexp(b + bg, bb)
    return forward, backward


def chance(odds):
    import numpy as np

    return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def scores(field: Field, texts: list[str]):
    """The quality of each text, and the chance of each line of being good."""
    import numpy as np

    own, size, counts = measured(texts)
    if not counts:
        return np.zeros(0), np.zeros(0)
    good = chance(np.add(*messages(line_odds(own, counts, field.weights), counts, field.ties)))
    starts = np.cumsum(counts) - counts
    weight = size + 1
    return np.clip(np.add.reduceat(good * weight, starts) / np.add.reduceat(weight, starts), 0, 1), good


def loss(x, counts: list[int], labels, parameters):
    """Minus the penalised log-likelihood, the mean over documents of the mean over lines, and its gradient. labels: of lines."""
    import numpy as np

    weights, ties = parameters[:-4], parameters[-4:]
    share = np.repeat(1 / np.maximum(counts, 1), counts) / len(counts)
    odds = x @ weights
    forward, backward = messages(odds, counts, ties)
    p = chance(forward + backward)
    inner = np.ones(len(odds), bool)
    inner[np.cumsum(counts) - counts] = False
    at = np.flatnonzero(inner)
    # pairs of a line and the one before: log-weights, made chances
    a, b = forward[at - 1], odds[at] + backward[at]
    pairs = np.stack([np.full(len(at), ties[0]), ties[1] + b, ties[2] + a, ties[3] + a + b], 1)
    pairs -= np.logaddexp.reduce(pairs, axis=1)[:, None]
    held = labels[at - 1].astype(int) * 2 + labels[at].astype(int)
    sure = np.where(labels, p, 1 - p)
    tiny = 1e-300
    first = ~inner
    joint = pairs[np.arange(len(at)), held] - np.log(np.maximum(sure[at - 1], tiny))
    likelihood = (share[first] * np.log(np.maximum(sure[first], tiny))).sum() + (share[at] * joint).sum()
    grad_ties = np.bincount(held, share[at], 4) - (share[at][:, None] * np.exp(pairs)).sum(axis=0)
    gradient = np.concatenate([x.T @ (share * (labels - p)), grad_ties])
    return -likelihood + PENALTY / 2 * (parameters**2).sum(), -gradient + PENALTY * parameters


def fitted(x, counts: list[int], good) -> Field:
    """The field of greatest penalised likelihood for documents whose lines are all good or all bad."""
    import numpy as np

    labels = np.repeat(np.asarray(good, bool), counts)
    here = np.zeros(x.shape[1] + 4)
    value, slope = loss(x, counts, labels, here)
    inverse = np.eye(len(here))
    for _ in range(STEPS):
        way = -inverse @ slope
        step = 1.0
        while step > 1e-8:
            there = here + step * way
            new, new_slope = loss(x, counts, labels, there)
            if new <= value + 1e-4 * step * (slope @ way):
                break
            step /= 2
        else:
            break
        moved, turned = there - here, new_slope - slope
        here, value, slope = there, new, new_slope
        if np.abs(slope).max() < 1e-6:
            break
        bend = moved @ turned
        if bend > 1e-12:
            side = np.eye(len(here)) - np.outer(moved, turned) / bend
            inverse = side @ inverse @ side.T + np.outer(moved, moved) / bend
    return Field(here[:-4].tolist(), here[-4:].tolist())


def held_out() -> Column:
    """Whether no label of the row may be learned from: a fifth of all rows, and those without a doc_id."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def _measures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tables = [measured([t or ""])[0].astype("<f8").tobytes() for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("good"), pa.array(tables, pa.binary())], names=["doc_id", "good", "measures"])


def fit(docs: DataFrame, labels: DataFrame) -> Field:
    """labels: (doc_id, quality), 1 for good and 0 for bad."""
    import numpy as np

    spark = docs.sparkSession
    small_batches(spark)
    judged = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg((F.min("quality") == 1).alias("good")).where(~held_out())
    lines = F.regexp_count(F.coalesce("text", F.lit("")), F.lit("\n")) + 1
    sized = docs.select("doc_id", lines.cast("long").alias("n")).join(judged, "doc_id").groupBy("doc_id", "good").agg(F.sum("n").alias("n"))
    chosen, room = [], FIT_LINES
    for r in sized.orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id").limit(FIT_DOCS).collect():
        if r.n <= room:
            room -= r.n
            chosen.append((r.doc_id, r.good))
    good = [g for _, g in chosen]
    if len(set(good)) < 2:
        share = sum(good) / len(good) if good else 0.5
        odds = 1e6 * (share - 0.5)  # one label alone: certainty; none: evens
        return Field([0.0] * (3 * len(MEASURES) + 2) + [odds], [0.0] * 4)
    sample = docs.select("doc_id", "text").join(F.broadcast(spark.createDataFrame(chosen, "doc_id long, good boolean")), "doc_id")  # FIT_DOCS rows
    place = {d: k for k, (d, _) in enumerate(chosen)}
    rows = sorted(sample.mapInArrow(_measures, "doc_id long, good boolean, measures binary").collect(), key=lambda r: (place[r.doc_id], r.measures))
    tables = [np.frombuffer(r.measures, "<f8").reshape(-1, len(MEASURES)) for r in rows]
    counts = list(map(len, tables))
    return fitted(features(np.concatenate(tables), counts), counts, [r.good for r in rows])


def _scored(batches: Iterator[pa.RecordBatch], field: Field, names: list[str], lines: bool) -> Iterator[pa.RecordBatch]:
    """Batches with their scores, and the chances of their lines if wanted."""
    import numpy as np

    for batch in batches:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        score, good = scores(field, texts)
        more = [pa.array(score, pa.float64())]
        if lines:
            ends = np.cumsum([0, *(t.count("\n") + 1 for t in texts)])
            more.append(pa.array([good[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.list_(pa.float64())))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *more], names=[*names, "__score", "__lines"][: len(names) + len(more)])


def _with_scores(docs: DataFrame, field: Field, columns: list[str], lines: bool = False) -> DataFrame:
    small_batches(docs.sparkSession)
    schema = StructType([*(docs.schema[c] for c in columns), StructField("__score", DoubleType()), *([StructField("__lines", ArrayType(DoubleType()))] if lines else [])])
    return docs.select(*dict.fromkeys([*columns, "text"])).mapInArrow(lambda it: _scored(it, field, columns, lines), schema)


def labelled(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, score, and for each line of the text its chance of being good and whether it is called good."""
    rows = _with_scores(docs, field, ["doc_id"], lines=True)
    return rows.select("doc_id", F.col("__score").alias("score"), F.col("__lines").alias("chances"), F.transform("__lines", lambda p: p >= 0.5).alias("good_lines"))


def filtered(docs: DataFrame, field: Field, threshold: float = THRESHOLD) -> DataFrame:
    """docs whose score reaches the threshold, all columns kept."""
    return carried(docs, lambda d: _with_scores(d, field, d.columns).where(F.col("__score") >= threshold).drop("__score"))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns."""
    rows = _with_scores(docs, fit(docs, labels), ["doc_id"])
    return rows.select("doc_id", held_out().alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= THRESHOLD).cast("int").alias("predicted"))
