"""SimHash near-duplicate detection.

Two schemes: ``exact`` links 64-bit fingerprints within a small radius and misses none; ``similar`` links texts of a given
Jaccard similarity, found by 256-bit fingerprints of their distinct shingles and verified.

1. Each text gets a fingerprint from its word shingles. Equal fingerprints (for ``similar``: equal shingle sets) become one
   node, so exact copies cost one row from here on.
2. Candidates: a node is keyed several times, by bits of its fingerprint (``exact``) or by minima of its shingle hashes
   (``similar``: bits could not tell 0.8 from unrelated texts, half of whose bits agree, in a corpus of any size). Only keys
   that several nodes have go on; those of more than TILE_ROWS nodes are dealt as pairs of tiles, which bounds a task's
   rows and misses no pair.
3. Comparison is bit-sliced: a block stores bit planes vertically, one bit of 64 nodes in a machine word. Distances of
   all nodes of the block to a probe are counted at once by carry-save counters over the planes, and probes whose
   lanes have all gone past the radius are abandoned. Only the edges of a spanning forest leave a block.
   For ``similar`` such links only find candidates: within each of their components every pair inside the radius that
   shares a key and that no link joins yet is compared by the exact Jaccard similarity of its distinct shingles, and only
   pairs that reach the threshold are links. Texts are read again for these components alone, and move once unless links
   leave a component of several tiles in several trees (``verified``).
4. Components: alternating large-star and small-star steps on Spark joins, each round written to the shared folder.

Whether two texts link depends on the two alone, not on the number of texts or how they are dealt.

Defined cases: a null or empty text, or one without words, has fingerprint zero and links like any other; a text with
fewer words than a shingle is one shingle; rows that repeat a doc_id link by their own texts alone; a null doc_id counts
as the largest, so a component of nothing else has a null id; extra columns are ignored by ``components`` and kept by
``representatives``; no input rows give no output rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.llm.sieve import sifted, without
from wardline.llm.storage import carried, small_batches, spread, staged

WORDS, RADIUS = 3, 2
TILE_ROWS = 4096
BLOCK_ROWS = 1024
VERIFY_ROWS, VERIFY_SHINGLES = 512, 1 << 20
NULL_ID = 2**63 - 1
SEED = 42


def shingles(text: str | None, words: int = WORDS):
    """XXH64 of each word shingle, as often as it occurs."""
    import numpy as np
    from xxhash import xxh64_intdigest

    tokens = (text or "").encode().lower().split()  # bytes: only A-Z change, only \x20 and \x09-\x0D separate
    if not tokens:
        return np.zeros(0, "<u8")
    joined = b" ".join(tokens)
    n = max(1, len(tokens) - words + 1)
    ends = np.append(np.flatnonzero(np.frombuffer(joined, np.uint8) == 32), len(joined)).tolist()
    starts = [0, *(e + 1 for e in ends[: n - 1])]
    last = ends[min(words, len(tokens)) - 1 :]
    return np.array([xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts, last, strict=True)], dtype="<u8")


def distinct_shingles(text: str | None, words: int):
    import numpy as np

    return np.unique(shingles(text, words))


def fingerprint(text: str | None, words: int = WORDS, parts: int = 1):
    """parts machine words of 64 fingerprint bits each, of all shingles."""
    return folded(shingles(text, words), parts)


def folded(hashes, parts: int = 1):
    """The fingerprint of shingle hashes. The first part is of the hashes; each other is of the same hashes mixed anew."""
    import numpy as np

    n = len(hashes)
    out = np.zeros(parts, np.uint64)
    for k in range(parts):
        ones = np.zeros(64, np.int64)
        for at in range(0, n, 4096):
            bits = hashes[at : at + 4096] if k == 0 else _mixed(hashes[at : at + 4096], k)
            ones += np.unpackbits(bits.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[k] = np.packbits(2 * ones > n, bitorder="little").view("<u8")[0]
    return out


def _mixed(hashes, k: int):
    """The k-th further hash: a golden-ratio step and two rounds of shift and multiply."""
    import numpy as np

    x = hashes + np.uint64(0x9E3779B97F4A7C15 * k & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def minima(hashes, bands: int, rows: int):
    """For each of bands a hash of the least of the set under each of ``rows`` own orders of all hashes: a key that two sets
    share with probability (their Jaccard similarity) ** rows, and unrelated sets never, however many there are."""
    import numpy as np
    from xxhash import xxh64_intdigest

    odd = np.random.default_rng(SEED).integers(0, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    least = np.full(bands * rows, 0xFFFFFFFFFFFFFFFF, np.uint64)
    for at in range(0, len(hashes), 4096):  # a multiple of a hash is as good as another hash: it orders them anew
        np.minimum(least, np.multiply.outer(odd, hashes[at : at + 4096]).min(axis=1), out=least)
    return [_signed(xxh64_intdigest(own.tobytes(), k)) for k, own in enumerate(least.reshape(bands, rows))]


@dataclass(frozen=True)
class Scheme:
    """What a fingerprint is, when two link, and the keys of which linked ones share some: bits of the fingerprint, or
    minima of the shingles. With a similarity, fingerprints are of distinct shingles, and links are verified by it."""

    words: int
    parts: int
    radius: int
    masks: tuple[int, ...] = ()
    bands: int = 0
    rows: int = 0
    similarity: float = 0.0


def exact(words: int = WORDS, radius: int = RADIUS) -> Scheme:
    """64 bits; of radius + 2 pieces, any two fingerprints within the radius share at least two, so no link is missed."""
    edges = [round(64 * k / (radius + 2)) for k in range(radius + 3)]
    pieces = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:], strict=False)]
    return Scheme(words, 1, radius, tuple(a | b for a, b in combinations(pieces, 2)))


def similar(words: int = 5, similarity: float = 0.8, parts: int = 4, bands: int = 20, rows: int = 5) -> Scheme:
    """For texts whose shingle sets have at least the given Jaccard similarity; alike for every number of texts. Bits of two
    such fingerprints differ at a rate below ``rate``; the radius is the mean and four deviations at that rate, so that a
    pair at the similarity itself passes with probability 0.9999, and shares a key with 0.9996."""
    rate = math.acos(2 * similarity / (1 + similarity)) / math.pi
    bits = 64 * parts
    return Scheme(words, parts, int(bits * rate + 4 * math.sqrt(bits * rate * (1 - rate))), (), bands, rows, similarity)


def _text() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias("__text")


FINGERPRINTS = "doc_id long, __text long, fp array<long>, node long, n int, keys array<long>"


def fingerprints(docs: DataFrame, scheme: Scheme) -> DataFrame:
    """Of each row: a hash of the text, the fingerprint's parts as signed longs, what makes rows one node (the first part, or
    where links are verified a hash of the whole shingle set), the number of shingles, and the keys."""
    small_batches(docs.sparkSession)

    def row(text: str | None):
        import numpy as np
        from xxhash import xxh64_intdigest

        hashes = distinct_shingles(text, scheme.words) if scheme.similarity else shingles(text, scheme.words)
        fp = folded(hashes, scheme.parts).view(np.int64)
        node = _signed(xxh64_intdigest(hashes.tobytes(), SEED)) if scheme.similarity else int(fp[0])
        return fp, node, len(hashes), minima(hashes, scheme.bands, scheme.rows) if scheme.bands else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in FINGERPRINTS.split(", ")]
        types = (pa.list_(pa.int64()), pa.int64(), pa.int32(), pa.list_(pa.int64()))
        for batch in batches:
            rows = [row(t) for t in batch.column("text").to_pylist()]
            made = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("__text"), *made], names=names)

    return docs.select("doc_id", "text", _text()).mapInArrow(run, FINGERPRINTS)


def matches(fps, radius: int, first=None, last=None):
    """fps: rows of fingerprint parts. Probes that have a fingerprint within the radius among those at first to last (the
    probe's own; by default all later ones), and a bit for each lane: which those are. Bit-sliced: the counters start so
    that they overflow, once and for good, past the radius."""
    import numpy as np

    fps = np.ascontiguousarray(fps, dtype="<u8").reshape(len(fps), -1)
    n, bits = len(fps), 64 * fps.shape[1]
    first = np.arange(1, n + 1) if first is None else first
    last = np.full(n, n) if last is None else last
    lanes = -(-n // 64)
    flat = np.zeros((lanes * 64, bits), np.uint8)
    flat[:n] = np.unpackbits(fps.view(np.uint8).reshape(n, -1), axis=1, bitorder="little")
    planes = np.packbits(np.ascontiguousarray(flat.T), axis=1, bitorder="little").view("<u8")  # a plane for each bit
    full, none = np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0)
    probes = np.flatnonzero(first < last)
    if not len(probes):
        return probes, np.zeros((0, lanes), np.uint64)
    lane = np.arange(lanes * 64)[None, :]
    out = ~np.packbits((lane >= first[probes, None]) & (lane < last[probes, None]), axis=1, bitorder="little").view("<u8")
    width = max(1, radius.bit_length())
    preset = (1 << width) - 1 - radius
    counters = [np.full((len(probes), lanes), full if preset >> k & 1 else none) for k in range(width)]
    for plane in range(bits):
        carry = planes[plane][None, :] ^ np.where(flat[probes, plane] == 1, full, none)[:, None]
        for k in range(width):
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        out |= carry
        if plane % 8 == 7:
            alive = (out != full).any(axis=1)
            if not alive.all():
                probes, out, counters = probes[alive], out[alive], [c[alive] for c in counters]
                if not len(probes):
                    break
    return probes, ~out


def alike(a, b, similarity: float) -> bool:
    """Whether two sorted arrays of distinct hashes have at least this Jaccard similarity."""
    import numpy as np

    if min(len(a), len(b)) < similarity * max(len(a), len(b)) - 1e-9:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both) - 1e-9


def forest(fps, nodes, radius: int, first=None, last=None, sets=None, keys=None, similarity: float = 0.0) -> list[tuple[int, int]]:
    """Links as (node, smallest node of its tree): one row for each node but the smallest. A link is within the radius; with
    sets and keys, it also shares a key and has at least the similarity. A probe's matches are merged as they are found,
    so no list of pairs is ever made, and pairs that other links have joined are not compared."""
    import numpy as np

    nodes = np.asarray(nodes, np.int64)
    tree = np.arange(len(nodes))
    if sets is not None:  # rows that stand for one tree found before are joined already
        _, at, inverse = np.unique(nodes, return_index=True, return_inverse=True)
        tree = at[inverse]
    least = nodes.copy()

    def judged(probe: int, near) -> Iterator:
        near = near[tree[near] != tree[probe]]
        near = near[(keys[near] == keys[probe]).any(axis=1)]
        return ([k] for k in near if tree[k] != tree[probe] and alike(sets[probe], sets[k], similarity))

    for probe, found in zip(*matches(fps, radius, first, last), strict=True):
        near = np.flatnonzero(np.unpackbits(found.view(np.uint8), bitorder="little"))
        for own in [near] if sets is None else judged(probe, near):
            trees = np.unique(np.append(tree[own], tree[probe]))
            if len(trees) > 1:
                least[trees[0]] = least[trees].min()
                tree[np.isin(tree, trees[1:])] = trees[0]
    least = least[tree]
    off = nodes != least
    return sorted(set(zip(nodes[off].tolist(), least[off].tolist(), strict=True)))


def _compared(batches: Iterator[pa.RecordBatch], scheme: Scheme, judged: bool, rows: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by group and tile. Blocks hold whole groups, small ones together; only rows of one group are
    compared, and in a group of two tiles only rows of different ones. If judged, rows have texts and keys, and links
    are verified on them."""
    import numpy as np

    def block(group, tile, fp, node, keys=None, sets=None) -> pa.RecordBatch:
        n = len(node)
        runs = np.flatnonzero(np.append(True, (group[1:] != group[:-1]) | (tile[1:] != tile[:-1])))
        starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        run_end = np.append(runs[1:], n)[np.searchsorted(runs, np.arange(n), "right") - 1]
        own = np.searchsorted(starts, np.arange(n), "right") - 1
        last = np.append(starts[1:], n)[own]
        alone = (run_end == last) & (runs[np.searchsorted(runs, np.arange(n), "right") - 1] == starts[own])
        edges = forest(fp, node, scheme.radius, np.where(alone, np.arange(1, n + 1), run_end), last, sets, keys, scheme.similarity)
        return pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], names=["node", "least"])

    held: list[list] = []
    size = 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        fp = batch.column("fp").flatten().to_numpy().view(np.uint64).reshape(n, -1)
        columns = [batch.column("group").to_numpy(), batch.column("own").to_numpy(), fp, batch.column("node").to_numpy()]
        if judged:
            sets = np.empty(n, object)
            for k, t in enumerate(batch.column("text").to_pylist()):
                sets[k] = distinct_shingles(t, scheme.words)
            columns += [batch.column("keys").flatten().to_numpy().reshape(n, -1), sets]
        held.append(columns)
        size += n
        if size < rows:
            continue
        whole = [np.concatenate(c) for c in zip(*held, strict=True)]
        starts = np.flatnonzero(np.append(True, whole[0][1:] != whole[0][:-1]))
        at = 0
        while (k := np.searchsorted(starts, at + rows)) < len(starts):  # the last group may go on in the next batch
            yield block(*(c[at : starts[k]] for c in whole))
            at = starts[k]
        held, size = [[c[at:] for c in whole]], size - at
    if size:
        yield block(*(np.concatenate(c) for c in zip(*held, strict=True)))


def _dealt(members: DataFrame, by: str, scheme: Scheme, columns: list[str], judged: bool) -> DataFrame:
    """Compares members (by, node, own, others and columns) that share ``by``: those of tile ``own`` with those of each of the tiles
    ``others``, its own among them or not."""
    spark = members.sparkSession
    small_batches(spark)
    dealt = members.select(by, "node", *columns, "own", F.explode("others").alias("other"))
    group = F.xxhash64(by, F.least("own", "other"), F.greatest("own", "other"))
    grouped = dealt.select("node", *columns, "own", group.alias("group")).repartition(spread(spark), "group").sortWithinPartitions("group", "own")
    rows = BLOCK_ROWS
    return grouped.mapInArrow(lambda it: _compared(it, scheme, judged, rows), "node long, least long")


def _tile(tiles: str | Column) -> Column:
    return F.pmod(F.xxhash64("node"), F.col(tiles) if isinstance(tiles, str) else tiles).cast("int")


def links(nodes: DataFrame, scheme: Scheme) -> DataFrame:
    """nodes: (node, fp, keys), one row for each fingerprint. Returns (node, least): edges that connect what links within the
    radius connect, for all links whose ends share a key. Only keys of several nodes meet fingerprints again."""
    bits = F.array(*(F.xxhash64(F.lit(i), F.get("fp", F.lit(0)).bitwiseAND(F.lit(_signed(m)))) for i, m in enumerate(scheme.masks)))
    keyed = nodes.select("node", F.explode(bits if scheme.masks else F.col("keys")).alias("key"))
    counts = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    tiled = staged(counts.select("key", F.ceil(F.col("n") / TILE_ROWS).cast("int").alias("tiles")), "shared-keys")
    members = keyed.join(tiled, "key").join(nodes.select("node", "fp"), "node")
    pairs = {"own": _tile("tiles"), "others": F.sequence(F.lit(0), F.col("tiles") - 1)}
    return _dealt(members.withColumns(pairs), "key", scheme, ["fp"], judged=False)


def _load(of: Column | None = None) -> Column:
    """How many tiles a group of nodes makes: of about VERIFY_ROWS texts and VERIFY_SHINGLES shingles."""
    of = F.lit(True) if of is None else of
    return F.ceil(F.greatest(F.count_if(of) / VERIFY_ROWS, F.sum(F.when(of, F.col("n"))) / VERIFY_SHINGLES)).cast("int")


_JUDGED = ["fp", "keys", "text"]


def verified(docs: DataFrame, nodes: DataFrame, found: DataFrame, scheme: Scheme) -> DataFrame:
    """(node, least): edges that connect what links of at least the scheme's similarity connect within the components found.
    nodes: with doc and __text of one of their rows.

    A component's texts are dealt to tiles, and each tile joins its own into trees. The trees' smallest nodes then meet in
    tiles again, as long as that halves their number; so a component of near copies, of whatever size, becomes one tree while its
    texts move once. Only in components that are still in several trees do tiles meet each other: the largest tree's
    those of the rest, and the rest's one another. Pairs that are in one tree by then need no comparison, and no other
    pair goes without."""
    members = found.unionByName(found.select(F.col("component").alias("node"), "component").distinct()).join(nodes, "node")
    sizes = members.groupBy("component").agg(_load().alias("tiles"))
    wanted = staged(members.join(sizes, "component").withColumnRenamed("doc", "__id"), "candidates")
    texts, _ = sifted(docs.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("__id"), _text(), "text"), wanted, ["__id", "__text"])
    texts = texts.join(wanted.hint("merge"), ["__id", "__text"]).drop("__id", "__text")

    def alone(rows: DataFrame) -> DataFrame:
        """Links within tiles."""
        pairs = rows.withColumn("own", _tile("tiles")).withColumn("others", F.array("own"))
        return _dealt(pairs, "component", scheme, _JUDGED, judged=True)

    single = alone(texts.where("tiles = 1"))
    if wanted.where("tiles > 1").isEmpty():
        return single
    large = staged(texts.where("tiles > 1"), "large-components")
    edges = staged(alone(large), "tile-links")
    every = [single, edges]
    # the tree of each node, by its smallest node
    trees = large.select("node", "component", "n").join(edges, "node", "left").select("node", "component", "n", F.coalesce("least", "node").alias("tree"))
    trees, before = staged(trees, "trees"), math.inf
    while True:
        tops = trees.where("node = tree")
        tiles = tops.groupBy("component").agg(_load().alias("tiles"), F.count("*").alias("trees")).where("trees > 1")
        meeting = staged(tops.join(tiles, "component").select("node", "component", "tiles"), "tops")
        n = meeting.count()
        if not n or 2 * n > before:  # few join now: what is apart meets below
            break
        before = n
        edges = staged(alone(_rejoined(large.drop("tiles"), meeting)), "top-links")
        every.append(edges)
        trees = staged(trees.join(edges.toDF("tree", "least"), "tree", "left").select("node", "component", "n", F.coalesce("least", "tree").alias("tree")), "trees")
        if edges.isEmpty() or meeting.where("tiles > 1").isEmpty():
            break
    loads = trees.groupBy("component", "tree").agg(F.count("*").alias("count"), F.sum("n").alias("n"))
    some = loads.groupBy("component").agg(F.max_by("tree", F.struct("count", "tree")).alias("largest"), F.count("*").alias("trees")).where("trees > 1").select("component", "largest")
    apart = staged(trees.join(some, "component").withColumn("big", F.col("tree") == F.col("largest")), "apart")
    sides = apart.groupBy("component").agg(_load(F.col("big")).alias("big_tiles"), _load(~F.col("big")).alias("rest_tiles"))
    total, first = F.col("big_tiles") + F.col("rest_tiles"), F.col("big_tiles")
    own = F.when(F.col("big"), _tile("big_tiles")).otherwise(first + _tile("rest_tiles"))
    others = F.sequence(F.when(F.col("big"), first).otherwise(F.lit(0)), total - 1)
    dealt = staged(apart.join(sides, "component").select("node", "component", "tree", own.alias("own"), others.alias("others")), "apart-tiles")
    crossing = _rejoined(large.drop("tiles"), dealt).drop("node").withColumnRenamed("tree", "node")
    return reduce(DataFrame.unionByName, [*every, _dealt(crossing, "component", scheme, _JUDGED, judged=True)])


def _rejoined(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of texts whose node and component are wanted, with its columns; the other texts stay where they are."""
    return sifted(texts, wanted, ["node", "component"])[0].join(wanted.hint("merge"), ["node", "component"])


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that has an edge; component: its component's smallest node.
    edges: two long columns. Large-star and small-star steps in turn until neither changes an edge. Both sides of the join
    by which a hub's edges learn their least neighbour are plain tables, so that Spark can split the hub."""
    a, b = edges.columns
    now = staged(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = staged(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least-neighbours")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = staged(large.where("u <> v").distinct(), "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        now = staged(small.where("u <> v").distinct(), "small-star")
        state = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 31)))).collect()[0])
        if state == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen = state


def classes(docs: DataFrame, scheme: Scheme) -> DataFrame:
    """(doc_id, __text, fp, component, component_id) of each row, written; component: of its component a node."""
    named = staged(fingerprints(docs, scheme), "fingerprints")
    doc = F.coalesce("doc_id", F.lit(NULL_ID))
    one = F.min(F.struct(doc.alias("doc"), "__text")).alias("one")
    nodes = staged(named.groupBy("node").agg(F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("keys").alias("keys"), one).select("node", "fp", "n", "keys", "one.*"), "nodes")
    found = connected(links(nodes, scheme))
    if scheme.similarity:
        found = connected(verified(docs, nodes, found, scheme))
    # both are written, so that the joins below read plain tables and Spark can split a component that holds many nodes
    labelled = staged(nodes.select("node", "doc").join(found, "node", "left").select("node", "doc", F.coalesce("component", "node").alias("component")), "labelled")
    least = staged(labelled.groupBy("component").agg(F.min("doc").alias("least")), "least")
    by_node = labelled.join(least, "component").select("node", "component", F.when(F.col("least") != NULL_ID, F.col("least")).alias("component_id"))
    return staged(named.join(staged(by_node, "components"), "node").select("doc_id", "__text", "fp", "component", "component_id"), "classes")


def components(docs: DataFrame, scheme: Scheme | None = None) -> DataFrame:
    """(doc_id, __text, fp, component_id) of each row. Without a scheme, texts link by ``similar``: five words and 0.8."""
    return classes(docs, scheme or similar()).drop("component")


def representatives(docs: DataFrame, scheme: Scheme | None = None) -> DataFrame:
    """docs with one row of each component: of its smallest doc_id, of that id's rows the one of the least hash of its text,
    and of rows equal in both the first by their values as JSON."""
    return carried(docs, lambda d: _representatives(d, scheme or similar()))


def _representatives(docs: DataFrame, scheme: Scheme) -> DataFrame:
    key = ["__id", "__text"]
    found = classes(docs, scheme).select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("__id"), "__text", "component")
    rows = found.groupBy("component", *key).agg(F.count("*").alias("n"))
    chosen = staged(rows.groupBy("component").agg(F.min(F.struct(*key, "n")).alias("one")), "chosen")
    # only rows that go, and the few that repeat a chosen one, meet texts
    gone = staged(rows.join(chosen, "component").where(F.struct(*key) != F.struct("one.__id", "one.__text")).select(*key), "gone")
    repeated = staged(chosen.where("one.n > 1").select("one.__id", "one.__text"), "repeated")
    keyed = docs.withColumns({"__id": F.coalesce("doc_id", F.lit(NULL_ID)), "__text": _text()})
    order = Window.partitionBy(*key).orderBy(F.to_json(F.struct(*docs.columns)))
    once = sifted(keyed, repeated, key)[0].join(repeated, key, "left_semi").withColumn("__rank", F.row_number().over(order)).where("__rank = 1")
    single = without(keyed, gone.unionByName(repeated), key)
    return single.select(*docs.columns).unionByName(once.select(*docs.columns))


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns for each document."""
    found = components(docs, exact())
    return found.select("doc_id", F.lpad(F.lower(F.hex(F.get("fp", F.lit(0)))), 16, "0").alias("fingerprint"), "component_id")
