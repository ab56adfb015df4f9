"""Vector codes from one codebook for each part of a vector, trained by Lloyd rounds with Elkan's bounds.

A component x becomes the integer floor(256 x), a vector is cut into equal parts, and each part is written as the index of the
nearest entry of its position's codebook. A round assigns all parts and then moves each entry to the floored mean of its
parts. The state of a round is a table: with each vector, for each part its entry, an upper bound of the distance to
it, and one lower bound for each entry of the codebook. When entries move, upper bounds grow and lower bounds shrink by what
they moved, and an entry is looked at only if no bound rules it out: one is ruled out when its lower bound, or half the
distance between it and the part's own entry, is strictly greater than the upper bound. So an entry as near as the
nearest is never ruled out; what is left is decided by integer squared distances, ties to the lower index.
Bounds are rounded outwards: lower ones down to one of LEVELS steps, two to a byte, upper ones up. They save work
and never change a result.

Only sums and counts of entries are shuffled, added up within each task first: a table of fixed size (entries x
components), as the codebooks themselves are.

Defined cases: rows whose vector is null, empty, of a length that the parts do not divide or other than that of the first
kept row, or with a null, non-finite or huge component (MAX_COMPONENT and more, whose squared distances might not fit a long)
are dropped; with fewer vectors than entries the codebooks have an entry for each; equal entries are all kept, the first
wins, and unused ones stay as they are; a null vec_id comes last; rows that repeat a vec_id are coded each; a null label is a label of its own;
extra columns are ignored; no kept rows give no output rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField, StructType

from wardline.llm.storage import small_batches, staged

PARTS, ENTRIES, ROUNDS = 16, 64, 2
SCALE, MAX_COMPONENT = 256, 1 << 19
LEVELS = 16
#: Elements of the largest array of differences at once.
CELLS = 1 << 21
#: Outward rounding: more than the errors of the floating-point operations it covers.
UP, DOWN = 1 + 1e-6, 1 - 1e-6


@dataclass(frozen=True)
class Codebooks:
    """books: int64 of (part, entry, position). moved: how far each entry went in the last round, rounded up. unit: of each part,
    the step of its lower bounds."""

    books: object
    moved: object
    unit: object

    @property
    def shape(self) -> tuple[int, int, int]:
        return self.books.shape

    def digest(self) -> str:
        return sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()


def kept(vectors: DataFrame, parts: int) -> DataFrame:
    """(vec_id, label, comps) of the rows that can be coded, but for the check of their lengths against each other."""
    v = F.col("embedding")
    sized = (F.size(v) > 0) & (F.size(v) % parts == 0)
    whole = F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < MAX_COMPONENT))  # NaN is greater than any number
    comps = F.transform(v, lambda x: F.floor(x.cast("double") * SCALE).cast("int"))
    return vectors.where(v.isNotNull() & sized & whole).select("vec_id", "label", comps.alias("comps"))


def start(rows: DataFrame, parts: int, entries: int) -> Codebooks | None:
    """The first vectors by vec_id, part by part."""
    import numpy as np

    order = [F.asc_nulls_last("vec_id"), F.asc("comps")]
    length = rows.orderBy(*order).select(F.size("comps").alias("n")).head()
    if length is None:
        return None
    first = [r.comps for r in rows.where(F.size("comps") == length.n).orderBy(*order).select("comps").limit(entries).collect()]
    books = np.array(first, np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2)
    widest = np.sqrt(_between(books).max(axis=(1, 2)))
    return Codebooks(books, np.zeros(books.shape[:2]), np.where(widest > 0, widest, 1.0) / LEVELS)


def _between(books):
    """Squared distances between the entries of each part."""
    return ((books[:, :, None] - books[:, None]) ** 2).sum(axis=-1)


def _own(comps, books, codes):
    """Squared distances of parts to their entries."""
    import numpy as np

    return ((comps - books[np.arange(books.shape[0]), codes]) ** 2).sum(axis=-1)


def nearest(comps, c: Codebooks):
    """Codes, upper bounds, lower bounds in steps and the number of distances, from all distances."""
    import numpy as np

    d = ((comps[:, :, None] - c.books) ** 2).sum(axis=-1)
    codes = d.argmin(axis=-1)
    upper = np.sqrt(np.take_along_axis(d, codes[..., None], -1)[..., 0]) * UP
    return codes, upper, _steps(np.sqrt(d), c.unit), np.full(len(comps), d[0].size if len(d) else 0)


def _steps(lower, unit):
    import numpy as np

    return np.clip(np.floor(lower * DOWN / unit[:, None]), 0, LEVELS - 1).astype(np.uint8)


def renewed(comps, codes, upper, steps, c: Codebooks):
    """The same after the entries have moved, from the bounds before. Distances are worked out only where they don't decide."""
    import numpy as np

    parts, k, _ = c.shape
    at = np.arange(parts)
    upper = (upper + c.moved[at, codes]) * UP
    lower = np.maximum(steps * c.unit[:, None] * DOWN - c.moved, 0)
    half = (np.sqrt(_between(c.books)) / 2 * DOWN)[at, codes]
    bound = np.maximum(lower, half)
    np.put_along_axis(bound, codes[..., None], np.inf, -1)
    doubtful = (bound <= upper[..., None]).any(axis=-1)
    # the distance to the part's own entry first: it may rule out the others
    i, p = np.nonzero(doubtful)
    own = ((comps[i, p] - c.books[p, codes[i, p]]) ** 2).sum(axis=-1)
    upper[i, p] = np.sqrt(own) * UP
    d = np.full((len(i), k), np.iinfo(np.int64).max)
    d[np.arange(len(i)), codes[i, p]] = own
    row, entry = np.nonzero(bound[i, p] <= upper[i, p][:, None])
    d[row, entry] = ((comps[i[row], p[row]] - c.books[p[row], entry]) ** 2).sum(axis=-1)
    best = d.argmin(axis=-1)
    known = d < np.iinfo(np.int64).max
    exact = np.where(known, np.sqrt(np.where(known, d, 0)), lower[i, p])
    lower[i, p] = exact
    codes, least = codes.copy(), d[np.arange(len(i)), best]
    codes[i, p] = best
    upper[i, p] = np.sqrt(least) * UP
    return codes, upper, _steps(lower, c.unit), np.bincount(i, minlength=len(comps)) + np.bincount(i[row], minlength=len(comps))


# rows between tasks: each vector's arrays as bytes


def _bytes(rows) -> pa.Array:
    """Binary values from the rows of an array."""
    import numpy as np

    raw = np.ascontiguousarray(rows)
    return pa.array([r.tobytes() for r in raw], pa.binary())


def _array(column: pa.Array, kind: str, *shape: int):
    import numpy as np

    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, *shape)


def _slices(batch: pa.RecordBatch, cells: int) -> Iterator[pa.RecordBatch]:
    rows = max(1, CELLS // cells)
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def _pair(steps):
    """Two lower bounds to a byte; the last of an odd number alone."""
    import numpy as np

    flat = steps.reshape(len(steps), -1)
    even = np.zeros((len(flat), -(-flat.shape[1] // 2), 2), np.uint8)
    even.reshape(len(flat), -1)[:, : flat.shape[1]] = flat
    return even[..., 0] | even[..., 1] << 4


def _unpair(column: pa.Array, parts: int, k: int):
    import numpy as np

    packed = _array(column, "u1", -(-parts * k // 2))
    return np.stack([packed & 15, packed >> 4], -1).reshape(len(packed), -1)[:, : parts * k].reshape(-1, parts, k)


def _first_round(batches: Iterator[pa.RecordBatch], c: Codebooks) -> Iterator[pa.RecordBatch]:
    import numpy as np

    parts, _, width = c.shape
    for whole in batches:
        for batch in _slices(whole, c.books.size):
            comps = batch.column("comps").flatten().to_numpy().astype(np.int64).reshape(-1, parts, width)
            yield _state(batch, comps, *nearest(comps, c))


def _next_round(batches: Iterator[pa.RecordBatch], c: Codebooks) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in _slices(whole, c.books.size):
            comps, codes, upper, steps = _read(batch, c)
            yield _state(batch, comps, *renewed(comps, codes, upper, steps, c))


STATE = [StructField("comps", BinaryType()), StructField("codes", BinaryType()), StructField("upper", BinaryType()), StructField("lower", BinaryType()), StructField("n_distances", IntegerType())]


def _state(batch: pa.RecordBatch, comps, codes, upper, steps, n) -> pa.RecordBatch:
    import numpy as np

    columns = [_bytes(comps.astype("<i4")), _bytes(codes.astype(np.uint8)), _bytes((upper * UP).astype("<f4")), _bytes(_pair(steps)), pa.array(n, pa.int32())]
    return pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), *columns], names=["vec_id", "label", *(f.name for f in STATE)])


def _read(batch: pa.RecordBatch, c: Codebooks):
    import numpy as np

    parts, k, width = c.shape
    comps = _array(batch.column("comps"), "<i4", parts, width).astype(np.int64)
    return comps, _array(batch.column("codes"), "u1", parts).astype(np.int64), _array(batch.column("upper"), "<f4", parts).astype(np.float64), _unpair(batch.column("lower"), parts, k)


def _summed(batches: Iterator[pa.RecordBatch], shape: tuple[int, int, int]) -> Iterator[pa.RecordBatch]:
    """Of a task's parts: for each entry and position the number and the sum."""
    import numpy as np

    parts, k, width = shape
    n, sums = np.zeros(parts * k, np.int64), np.zeros((parts * k, width), np.int64)
    for batch in batches:
        comps = _array(batch.column("comps"), "<i4", parts, width)
        slot = (np.arange(parts) * k + _array(batch.column("codes"), "u1", parts)).ravel()
        n += np.bincount(slot, minlength=len(n))
        for w in range(width):  # sums of one batch are exact in doubles
            sums[:, w] += np.bincount(slot, comps[..., w].ravel(), len(n)).astype(np.int64)
    used = np.flatnonzero(n)
    columns = (np.repeat(used, width), np.tile(np.arange(width), len(used)), np.repeat(n[used], width), sums[used].ravel())
    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["slot", "position", "n", "total"])


def moved(state: DataFrame, c: Codebooks) -> Codebooks:
    """The codebooks after their entries have moved to the floored means of their parts."""
    import numpy as np

    rows = state.select("comps", "codes").mapInArrow(lambda it: _summed(it, c.shape), "slot long, position long, n long, total long")
    books = c.books.copy()
    flat = books.reshape(-1, books.shape[2])
    for r in rows.groupBy("slot", "position").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():
        flat[r.slot, r.position] = r.total // r.n
    return Codebooks(books, np.sqrt(((books - c.books) ** 2).sum(axis=-1)) * UP, c.unit)


def _coded(batches: Iterator[pa.RecordBatch], c: Codebooks, work) -> Iterator[pa.RecordBatch]:
    for batch in work(batches, c):
        comps, codes, _, _ = _read(batch, c)
        error = _own(comps, c.books, codes).sum(axis=-1)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), batch.column("codes"), pa.array(error, pa.int64())], names=["vec_id", "label", "codes", "error"])


def compressed(vectors: DataFrame, *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks | None]:
    """(vec_id, label, codes, error) of each kept vector, a byte to a part, and the codebooks; None if no vector is kept."""
    if not 1 <= entries <= 256:
        raise ValueError("an index must fit a byte")
    spark = vectors.sparkSession
    small_batches(spark)
    rows = kept(vectors, parts)
    own = [f for f in rows.schema if f.name in ("vec_id", "label")]
    schema = StructType([*own, StructField("codes", BinaryType()), StructField("error", LongType())])
    c = start(rows, parts, entries)
    if c is None:
        return spark.createDataFrame([], schema), None
    rows = rows.where(F.size("comps") == F.lit(c.shape[0] * c.shape[2]))
    work = _first_round
    for _ in range(rounds):
        rows = staged(_mapped(rows, work, c, own), "codebook-state")
        c, work = moved(rows, c), _next_round
    return staged(rows.mapInArrow(lambda it: _coded(it, c, work), schema), "codes"), c


def _mapped(rows: DataFrame, work, c: Codebooks, own: list[StructField]) -> DataFrame:
    return rows.mapInArrow(lambda it: work(it, c), StructType([*own, *STATE]))


def decoded(codes: DataFrame, c: Codebooks) -> DataFrame:
    """codes with ``vector``: the middle of the cells that its entries stand for."""
    table = F.array(*(F.array(*(F.array(*(F.lit((x + 0.5) / SCALE) for x in entry)) for entry in part)) for part in c.books.tolist()))
    part = lambda p: F.element_at(F.element_at(table, p), F.conv(F.hex(F.substring("codes", p, F.lit(1))), 16, 10).cast("int") + 1)
    return codes.withColumn("vector", F.flatten(F.transform(F.sequence(F.lit(1), F.lit(c.shape[0])), part)))


def _code() -> Column:
    return F.lower(F.hex("codes"))


def digest(vectors: DataFrame) -> DataFrame:
    """The contract's columns. Sums of labels are written first, so Spark knows their size when it joins them."""
    rows, c = compressed(vectors)
    labels = staged(rows.groupBy(F.col("label").alias("of_label")).agg(F.sum("error").alias("label_error")), "label-errors")
    joined = rows.join(labels, F.col("label").eqNullSafe(F.col("of_label")), "left")
    return joined.select("vec_id", _code().alias("code"), "error", "label_error", F.lit(c.digest() if c else "").cast(StringType()).alias("codebooks_sha256"))
