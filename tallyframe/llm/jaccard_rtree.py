"""Exact similarity join of shingle sets: blocks by equal segments, an R-tree of group counts within blocks.

* Equal sets are one node; only distinct sets are compared.
* Two sets that link differ in at most ``d`` shingles (a bound from the smaller size).  With shingles dealt by
  hash into more than ``d`` segments, at least one segment is the same in both, so sets meet in the block of a common
  segment.  No link is lost; sets with too few filled segments have a block of their own.
* Each set is also a point: its shingles counted in 64 hashed groups.  The sum of coordinate minima bounds the
  overlap of two sets, or of two boxes of an R-tree of points, from above.
* In a first round every node is compared with the most connected node of its blocks, which ties groups of near copies
  together without pairing their members.  Blocks whose members are one component are done; in the others an
  R-tree per block finds the pairs of different components that the bound lets pass.
* Pairs that pass are bounded once more in finer groups, as many as the sets are large, and verified on the
  whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.llm import bloom
from tallyframe.llm import spans as S
from tallyframe.llm.components import components
from tallyframe.storage import settle

GROUPS = 64
#: Members of a larger block are dealt into tiles of about this size; pairs of tiles are then the tasks' units.
TILE = 4096
_LEAF = 32


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each whole text; a text of fewer words is one shingle of all of them."""
    spans = S.word_spans(texts, lower=True)
    hashes = S.span_hash(spans.buffer, spans.starts, spans.ends)
    grams = S.mix(S.gram_hash(hashes, words) + np.uint64(words))
    out = []
    for first, last in zip(spans.bounds[:-1], spans.bounds[1:]):
        count = last - first
        if count >= words:
            out.append(np.unique(grams[first : last - words + 1]))
        else:
            whole = S.gram_hash(hashes[first:last], int(count)) if count else np.zeros(0, dtype=np.uint64)
            out.append(S.mix(whole + np.uint64(count)))
    return out


def needed(total, percent: int):
    """Least overlap of two sets of together ``total`` shingles that link."""
    return -(-percent * total // (100 + percent))


def differing(size: int, percent: int) -> int:
    """Most shingles that are in one only of two linked sets, of which the smaller has ``size``."""
    return size * (100 - percent) // percent


def _enough(differ: int) -> int:
    """Segments for sets that differ in so many shingles: an eighth more, as those that chance leaves empty are of no use."""
    return differ + differ // 8 + 3


def _served(count: int) -> int:
    """Most differing shingles for which so many segments are enough."""
    return (8 * (count - 3) + 7) // 9


def _segment_counts(size: int, percent: int) -> list[int]:
    """Numbers of segments under which a set of ``size`` meets all its partners, smaller and larger ones."""
    low = -(-size * percent // 100)
    least = [_enough(differing(s, percent)) for s in (low, size)]
    out, count = [], 4
    while True:
        if count >= least[0]:
            out.append(count)
        if count >= least[1]:
            return out
        count = max(count + 1, count * 3 // 2)


def block_keys(shingles: np.ndarray, percent: int) -> np.ndarray:
    """Keys of the blocks of a set; none if only an equal set can link with it."""
    size = len(shingles)
    most = differing(size, percent)
    if not most:
        return np.zeros(0, dtype=np.uint64)
    value = S.mix(shingles ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    keys = []
    for count in _segment_counts(size, percent):
        segment = (shingles >> np.uint64(20)) % np.uint64(count)
        order = np.argsort(segment, kind="stable")
        ordered = segment[order]
        starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        sums = np.add.reduceat(value[order], starts)
        keys.append(S.mix(sums + S.mix(ordered[starts] + np.uint64(count << 32))))
        # With more filled segments than shingles that differ, one stays equal.
        if len(starts) <= min(most, _served(count)):
            keys.append(S.mix(np.array([count], dtype=np.uint64) ^ np.uint64(0x1234567)))
    return np.concatenate(keys)


def _point(shingles: np.ndarray) -> bytes:
    return np.bincount((shingles & np.uint64(GROUPS - 1)).astype(np.int64), minlength=GROUPS).astype("<i4").tobytes()


def _fine_point(shingles: np.ndarray) -> bytes:
    """Counts in so many groups that about eight shingles fall in each: the bound is then sharp for large sets too."""
    groups = GROUPS
    while groups * 8 < len(shingles):
        groups *= 2
    return np.bincount((shingles & np.uint64(groups - 1)).astype(np.int64), minlength=groups).astype("<u2").tobytes()


def _overlap_bound(x: bytes, y: bytes) -> int:
    """Summed coordinate minima of two fine points; the finer one is folded to the groups of the other."""
    a, b = np.frombuffer(x, dtype="<u2").astype(np.int64), np.frombuffer(y, dtype="<u2").astype(np.int64)
    size = min(len(a), len(b))
    return int(np.minimum(a.reshape(-1, size).sum(axis=0), b.reshape(-1, size).sum(axis=0)).sum())


def _points(column: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype="<i4").reshape(-1, GROUPS)


def _named_sets(docs: DataFrame, words: int) -> DataFrame:
    """(id, n, f1, f2) of every row; ``f1``, ``f2`` are a 128-bit fingerprint of the set."""
    schema = T.StructType([T.StructField("id", docs.schema["id"].dataType), *(T.StructField(c, T.LongType()) for c in ("n", "f1", "f2"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = S.texts_of(batch.column(1))
            for lo, hi in S.chunks(texts):
                sets = shingle_sets(texts[lo:hi], words)
                f1, f2 = zip(*map(fingerprint, sets))
                columns = [batch.column(0).slice(lo, hi - lo), *(pa.array(c, pa.int64()) for c in ([len(s) for s in sets], f1, f2))]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select("id", "text").mapInArrow(run, schema)


def _signatures(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(id, n, f1, f2, keys, point, fine) of every row: its fingerprint, blocks and points."""
    schema = T.StructType(
        [T.StructField("id", docs.schema["id"].dataType), T.StructField("n", T.LongType()), T.StructField("f1", T.LongType()), T.StructField("f2", T.LongType()),
         T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("point", T.BinaryType()), T.StructField("fine", T.BinaryType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = S.texts_of(batch.column(1))
            for lo, hi in S.chunks(texts):
                sets = shingle_sets(texts[lo:hi], words)
                f1, f2 = zip(*map(fingerprint, sets))
                keys = [block_keys(s, percent).view(np.int64) for s in sets]
                bounds = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()),
                     pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(keys))), pa.array([_point(s) for s in sets], pa.binary()), pa.array([_fine_point(s) for s in sets], pa.binary())],
                    names=schema.names,
                )

    return docs.select("id", "text").mapInArrow(run, schema)


def fingerprint(shingles: np.ndarray) -> tuple[int, int]:
    return tuple(int(S.mix(shingles ^ np.uint64(seed)).sum(dtype=np.uint64).view(np.int64)) for seed in (0x51ED2701, 0x9D0F4A3C))


def _bounded(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose summed coordinate minima, in fine groups, reach the needed overlap."""
    of = lambda c: nodes.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("fine").alias(f"p{c}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, na, nb = (batch.column(k).to_numpy() for k in range(4))
            most = [_overlap_bound(x, y) for x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())]
            ok = np.array(most, dtype=np.int64) >= needed(na + nb, percent)
            yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok])], names=["a", "b"])

    both = pairs.join(of("a"), "a").join(of("b"), "b")
    return both.select("a", "b", "na", "nb", "pa", "pb").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) that link, by their whole sets.

    Only the sets in question are made again from their texts: a filter of fixed size picks the rows of
    their documents inside the scan, an exact join follows.
    """
    pairs = settle(pairs, "pairs")
    asked = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    asked = settle(asked.join(nodes, "node").select("node", "rep", "f1", "f2"), "asked")
    blocks = bloom.blocks_for(asked.count())
    filled = bloom.bloom_words(asked.select(F.xxhash64("rep").alias("key")), blocks)
    rows = docs.where(bloom.may_contain(filled, blocks, F.xxhash64("id"))).join(
        asked.withColumnRenamed("rep", "asked_id"), F.col("id").eqNullSafe(F.col("asked_id"))
    )

    def remade(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = S.texts_of(batch.column(3))
            for lo, hi in S.chunks(texts):
                sets = shingle_sets(texts[lo:hi], words)
                same = np.array([(f1, f2) == fingerprint(s) for s, f1, f2 in zip(sets, *(batch.column(k).slice(lo, hi - lo).to_pylist() for k in (1, 2)))], dtype=bool)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo).filter(pa.array(same)), pa.array([s.tobytes() for s, ok in zip(sets, same) if ok], pa.binary())],
                    names=["node", "shingles"],
                )

    sets = rows.select("node", "f1", "f2", "text").mapInArrow(remade, "node long, shingles binary").dropDuplicates(["node"])
    sets = settle(sets, "sets")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(ok, pa.bool_())) for k in (0, 1)], names=["a", "b"])

    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b"
    )
    return settle(both.select("a", "b", "sa", "sb").mapInArrow(check, "a long, b long"), "links")


class _Tree:
    """Packed R-tree of points: leaves of neighbouring points, boxes of leaves, boxes of boxes."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        spread = points.var(axis=0)
        first, second = np.argsort(-spread)[:2]
        slabs = max(1, int(np.ceil(np.sqrt(len(points) / _LEAF))))
        by_size = np.argsort(sizes, kind="stable")
        slab = np.empty(len(points), dtype=np.int64)
        slab[by_size] = np.arange(len(points)) * slabs // max(1, len(points))
        self.order = np.lexsort((points[:, second], points[:, first], slab))
        low, top = sizes[self.order], points[self.order]
        self.levels = []
        while True:
            starts = np.arange(0, len(low), _LEAF)
            low, top = np.minimum.reduceat(low, starts), np.maximum.reduceat(top, starts, axis=0)
            self.levels.append((low, top))
            if len(low) == 1:
                return

    def pairs(self, other: _Tree, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Points of pairs of leaves whose boxes may hold linked points."""
        depth = max(len(self.levels), len(other.levels))
        level = lambda tree, k: tree.levels[min(k, len(tree.levels) - 1)]
        mine, theirs = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)
        for k in range(depth - 1, -1, -1):
            (low_a, top_a), (low_b, top_b) = level(self, k), level(other, k)
            kept = []
            for lo in range(0, len(mine), 1 << 14):
                a, b = mine[lo : lo + (1 << 14)], theirs[lo : lo + (1 << 14)]
                ok = np.minimum(top_a[a], top_b[b]).sum(axis=1) >= needed(low_a[a] + low_b[b], percent)
                kept.append((a[ok], b[ok]))
            mine, theirs = (np.concatenate(x) for x in zip(*kept))
            if self is other:
                ordered = mine <= theirs
                mine, theirs = mine[ordered], theirs[ordered]
            if k:
                mine, theirs = _expand(mine, theirs, len(self.levels) > k, len(other.levels) > k, len(level(self, k - 1)[0]), len(level(other, k - 1)[0]))
        for a, b in zip(mine.tolist(), theirs.tolist()):
            yield self.order[a * _LEAF : (a + 1) * _LEAF], other.order[b * _LEAF : (b + 1) * _LEAF]


def _expand(mine, theirs, split_a: bool, split_b: bool, count_a: int, count_b: int):
    fan = np.arange(_LEAF)
    a = mine[:, None, None] * _LEAF + fan[None, :, None] if split_a else mine[:, None, None]
    b = theirs[:, None, None] * _LEAF + fan[None, None, :] if split_b else theirs[:, None, None]
    a, b = np.broadcast_arrays(a, b)
    inside = (a < count_a) & (b < count_b)
    return a[inside], b[inside]


def block_pairs(nodes: np.ndarray, labels: np.ndarray, sizes: np.ndarray, points: np.ndarray, sides: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of different labels in a block that the bound lets pass; between the two sides if there are two."""
    left, right = (np.flatnonzero(sides == s) for s in (0, 1))
    if not len(left):
        return
    tree = _Tree(points[left], sizes[left])
    facing = _Tree(points[right], sizes[right]) if len(right) else tree
    inner = left if facing is tree else right
    for some, others in tree.pairs(facing, percent):
        a, b = left[some], inner[others]
        most = np.minimum(points[a][:, None, :], points[b][None, :, :]).sum(axis=2)
        ok = (most >= needed(sizes[a][:, None] + sizes[b][None, :], percent)) & (labels[a][:, None] != labels[b][None, :])
        x, y = np.nonzero(ok)
        if len(x):
            first, second = nodes[a[x]], nodes[b[y]]
            yield np.minimum(first, second), np.maximum(first, second)


def _tree_pairs(members: DataFrame, percent: int) -> DataFrame:
    """Distinct candidate pairs (a, b) of all open blocks; members: (key, size, node, label, n, point)."""
    tiles = F.ceil(F.col("size") / TILE).cast("int")
    tile = F.pmod(F.xxhash64("node"), tiles).cast("int")
    one, two = F.least(F.col("own"), F.col("with")), F.greatest(F.col("own"), F.col("with"))
    dealt = (
        members.withColumn("tiles", tiles).withColumn("own", tile)
        .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .select("key", one.alias("i"), two.alias("j"), (F.col("own") > F.col("with")).cast("int").alias("side"), "node", "label", "n", "point")
        .repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def results(table: pa.Table) -> Iterator[pa.RecordBatch]:
            key, i, j, side, node, label, n = (table.column(k).to_numpy() for k in range(7))
            points = _points(table.column(7).to_pylist())
            new = np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            found, size = [], 0
            for part in np.split(np.arange(len(key)), new):
                for pair in block_pairs(node[part], label[part], n[part], points[part], side[part], percent):
                    found.append(pair)
                    size += len(pair[0])
                    if size > 1 << 18:
                        yield distinct(found)
                        found, size = [], 0
            if found:
                yield distinct(found)

        def distinct(found: list) -> pa.RecordBatch:
            rows = np.unique(np.stack([np.concatenate(x) for x in zip(*found)]), axis=1)
            return pa.RecordBatch.from_arrays([pa.array(rows[0]), pa.array(rows[1])], names=["a", "b"])

        for batch in batches:  # the last block of a batch may go on in the next one
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([*held, batch])
            keys = [table.column(k).to_numpy() for k in range(3)]
            last = np.flatnonzero(np.logical_and.reduce([k == k[-1] for k in keys]))[0]
            if last:
                yield from results(table.slice(0, last))
            held = table.slice(last).to_batches()
        if held:
            yield from results(pa.Table.from_batches(held))

    return dealt.mapInArrow(run, "a long, b long").distinct()


def jaccard_components(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, set_id) of every row: the classes of documents tied by links.

    A-Z is lower-cased; words are runs without ASCII white space; a set has the distinct ``words``-word shingles of the
    whole text (one shingle of all words if there are fewer).  Sets link when 100 * intersection >= percent *
    union.  ``component_id`` is the smallest id of the class; rows with equal sets are in one class.  Null and empty texts
    have no shingles and are classes of their own, named by their ids.  Ids may repeat (each row is a
    member) or be null (never the smallest unless all are).  ``set_id`` names equal sets.  Shingles are
    compared by 64-bit, whole sets by 128-bit hashes.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    nodes = settle(
        _signatures(rows, words, percent).where("n > 0").groupBy("f1", "f2").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("point").alias("point"), F.first("fine").alias("fine"))
        .withColumn("node", F.monotonically_increasing_id()),
        "nodes",
    )
    keyed = nodes.select("node", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    # Most keys are those of one set only; a filter of the others keeps them out of the second exchange.
    shared = settle(shared, "shared-keys")
    blocks = bloom.blocks_for(shared.count())
    likely = keyed.where(bloom.may_contain(bloom.bloom_words(shared, blocks), blocks, F.col("key")))
    members = settle(likely.join(shared, "key"), "members")
    degree = members.groupBy("node").agg(F.sum("size").alias("degree"))
    pivots = members.join(degree, "node").groupBy("key").agg(F.max(F.struct("degree", "node"))["node"].alias("pivot"))
    chosen = members.join(pivots, "key").groupBy("node", "pivot").count().groupBy("node").agg(F.max(F.struct("count", "pivot"))["pivot"].alias("pivot"))
    star = chosen.where("node <> pivot").select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
    facts = nodes.select("node", "n", "point")
    first = _verified(_bounded(star, nodes, percent), nodes, rows, words, percent)
    labels = components(first)
    labelled = members.join(labels.withColumnRenamed("vertex", "node"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    labelled = settle(labelled, "labelled")
    open_keys = labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key")
    open_members = labelled.join(open_keys, "key").join(facts, "node")
    found = _tree_pairs(open_members, percent).join(star, ["a", "b"], "left_anti")
    more = _verified(_bounded(found, nodes, percent), nodes, rows, words, percent)
    labels = components(first.union(more))
    classes = nodes.select("f1", "f2", "node", "rep").join(labels.withColumnRenamed("vertex", "node"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    smallest = classes.groupBy("label").agg(F.min("rep").alias("component_id"))
    named = classes.join(smallest, "label").select("f1", "f2", "node", "component_id")
    return _named_sets(rows, words).join(named, ["f1", "f2"], "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
        F.col("node").alias("set_id"),
    )
