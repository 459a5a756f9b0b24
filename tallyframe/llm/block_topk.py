"""Exact top-k inner products of integer vectors, block at a time.

Vectors are put in an order in which like ones are neighbours and cut into blocks of consecutive documents; a
block holds its vectors as a forward index.  The greatest and the least value of a block in every position bound the score
of any of its vectors: the sum over positions of query value times maximum (minimum, where the query is negative).  A query
visits blocks by falling bound and stops when the next bound is below its k-th score; equal bounds are still visited,
because ties go to the smaller id.  What a query finds in its own block is its first threshold.

Blocks are dealt into stripes and queries into parts, both of bounded size.  A task holds one stripe and reads the queries of
a part one batch after the other, so neither side is broadcast, collected or held whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.storage import settle

#: Vectors of a block, queries of a batch.
BLOCK_ROWS = 128
BATCH_ROWS = 256
#: A stripe has about this many vectors at most (its forward index is in one task's memory), and no less than the second while
#: there are fewer stripes than shuffle partitions.
STRIPE_ROWS = 1 << 17
LEAST_STRIPE_ROWS = 1 << 11
#: Queries that one task answers for its stripe.
PART_ROWS = 1 << 20
#: Sampled vectors that order the others; the order decides how much is pruned, not what is found.
PIVOTS = 64

_LOW, _HIGH = -(1 << 63), (1 << 63) - 1
_BLOCK = "ids array<bigint>, rows array<bigint>, seeds array<bigint>, dims int, kind string, data binary"
_NAMES = ["ids", "rows", "seeds", "dims", "kind", "data"]


def _scaled(vec: Column, scale: int) -> Column:
    return F.transform(vec, lambda x: x.cast("double") * scale)


def _dense(lists: pa.Array, dims: int | None = None) -> np.ndarray:
    """Floors of a list column as a matrix; shorter rows end in zeros."""
    sizes = np.diff(lists.offsets.to_numpy())
    width = int(sizes.max(initial=0)) if dims is None else dims
    out = np.zeros((len(lists), width))
    out[np.arange(width) < sizes[:, None]] = np.floor(lists.flatten().to_numpy(zero_copy_only=False))
    return out


def _packed(matrix: np.ndarray) -> tuple[str, bytes]:
    """The narrowest exact form of a matrix of whole numbers."""
    most = np.abs(matrix).max(initial=0)
    kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<f8"
    return kind, matrix.astype(kind).tobytes()


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-number rows, held at the limits of a long where they pass them."""
    if np.abs(a).sum(axis=1).max(initial=0) * np.abs(b).max(initial=0) < 1 << 53:
        return (a @ b.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    exact = whole(a) @ whole(b).T if a.size and b.size else np.zeros((len(a), len(b)), dtype=object)
    return np.clip(exact, -_HIGH, _HIGH).astype(np.int64)


@dataclass
class Block:
    """Vectors with ids, row numbers and, where they are queries, first thresholds."""

    ids: np.ndarray
    unnamed: np.ndarray
    rows: np.ndarray
    seeds: np.ndarray
    asks: np.ndarray
    vectors: np.ndarray

    @classmethod
    def read(cls, row: dict) -> Block:
        rows = np.array(row["rows"], dtype=np.int64)
        ids = row["ids"]
        return cls(
            np.array([0 if i is None else i for i in ids], dtype=np.int64),
            np.array([i is None for i in ids], dtype=bool),
            rows,
            np.array([_LOW if s is None else s for s in row["seeds"]], dtype=np.int64),
            np.array([s is not None for s in row["seeds"]], dtype=bool),
            np.frombuffer(row["data"], dtype=row["kind"]).reshape(len(rows), row["dims"]),
        )

    def wide(self, dims: int) -> np.ndarray:
        return np.pad(self.vectors.astype(np.float64), ((0, 0), (0, dims - self.vectors.shape[1])))

    def record(self) -> tuple:
        kind, data = _packed(self.vectors.astype(np.float64))
        ids = [None if u else int(i) for i, u in zip(self.ids, self.unnamed)]
        seeds = [int(s) if a else None for s, a in zip(self.seeds, self.asks)]
        return ids, self.rows.tolist(), seeds, self.vectors.shape[1], kind, data


def _batch(records: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*records)) or [[] for _ in _NAMES]
    longs = pa.list_(pa.int64())
    types = longs, longs, longs, pa.int32(), pa.string(), pa.binary()
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=_NAMES)


def _kth(scores: np.ndarray, k: int) -> int:
    return int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else _LOW


def vector_blocks(vectors: DataFrame, k: int, block_rows: int = BLOCK_ROWS, pivots: int = PIVOTS) -> DataFrame:
    """Blocks of the rows (id, row, vec, asks) in an order by nearest pivot; settled.

    A query's seed is the k-th best score among the others of its block.
    """
    sample = vectors.where(F.size("vec") > 0).orderBy(F.xxhash64("vec", "row")).limit(pivots).select("vec").toArrow()["vec"].combine_chunks()
    width = max((len(v) for v in sample), default=0)
    with np.errstate(over="ignore"):
        points = _dense(sample, width) if len(sample) else np.zeros((1, 0))
        points = points / np.maximum(np.abs(points).max(axis=1, keepdims=True, initial=1), 1)
    points /= np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-300)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec = _dense(batch.column("vec"))
            length = np.maximum(np.abs(vec).max(axis=1, keepdims=True, initial=1), 1)
            both = min(vec.shape[1], points.shape[1])
            near = (vec / length)[:, :both] @ points[:, :both].T
            cell = near.argmax(axis=1).astype(np.int32)
            added = [pa.array(cell), pa.array(np.take_along_axis(near, cell[:, None], axis=1)[:, 0])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, "cell", "near"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            full = held.num_rows // block_rows * block_rows
            if full:
                yield _batch([pack(held.slice(i, block_rows)) for i in range(0, full, block_rows)])
                held = held.slice(full)
        if held is not None and held.num_rows:
            yield _batch([pack(held)])

    def pack(part: pa.Table) -> tuple:
        part = part.combine_chunks()
        vectors = _dense(part["vec"].combine_chunks())
        asks = part["asks"].to_numpy().astype(bool)
        seeds: list = [None] * part.num_rows
        at = np.flatnonzero(asks)
        for i, found in zip(at, products(vectors[at], vectors)):
            seeds[i] = _kth(np.delete(found, i), k)
        return part["id"].to_pylist(), part["row"].to_pylist(), seeds, vectors.shape[1], *_packed(vectors)

    placed = vectors.mapInArrow(place, "id bigint, row bigint, vec array<double>, asks boolean, cell int, near double")
    key = ["cell", "near", "id", "row"]
    ordered = placed.repartitionByRange(*key).sortWithinPartitions(*key)
    return settle(ordered.mapInArrow(build, _BLOCK), "vector-blocks")


def _query_batches(blocks: DataFrame) -> DataFrame:
    """The queries of the blocks, in batches: neighbours stay together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            dims = max(len(h[3]) for h in held)
            kind, data = _packed(np.array([np.pad(h[3].astype(np.float64), (0, dims - len(h[3]))) for h in held]).reshape(len(held), dims))
            ids, rows, seeds, _ = zip(*held)
            return _batch([(list(ids), list(rows), list(seeds), dims, kind, data)])

        for batch in batches:
            for row in batch.to_pylist():
                vectors = Block.read(row).vectors
                for i, seed in enumerate(row["seeds"]):
                    if seed is not None:
                        held.append((row["ids"][i], row["rows"][i], seed, vectors[i]))
                        if len(held) == BATCH_ROWS:
                            yield flush()
                            held = []
        if held:
            yield flush()

    asked = blocks.where(F.exists("seeds", lambda s: s.isNotNull()))
    return settle(asked.mapInArrow(run, _BLOCK), "query-batches")


def search(queries: Block, blocks: list[Block], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """(query, score, block, place) of the k best vectors of every query in these blocks, and how many (query, block) were scored.

    Vectors below the first threshold of a query may be left out; so may ties that lose by their id.
    """
    dims = max([queries.vectors.shape[1], *(b.vectors.shape[1] for b in blocks)])
    asked = queries.wide(dims)
    top = np.array([b.wide(dims).max(axis=0) for b in blocks])
    least = np.array([b.wide(dims).min(axis=0) for b in blocks])
    bounds = products(np.hstack([np.maximum(asked, 0), np.minimum(asked, 0)]), np.hstack([top, least]))
    order = np.argsort(-bounds, axis=1, kind="stable")
    bounds = np.take_along_axis(bounds, order, axis=1)
    kth, nothing = queries.seeds.copy(), np.zeros(0, dtype=np.int64)
    best = (nothing, nothing, nothing, nothing)
    active, done, step, scored = np.arange(len(asked)), 0, 1, 0
    while len(active):
        end = min(done + step, len(blocks))
        owner, turn = np.nonzero(bounds[active, done:end] >= kth[active][:, None])
        owner, block = active[owner], order[active[owner], done + turn]
        by_block = np.argsort(block, kind="stable")
        owner, block = owner[by_block], block[by_block]
        scored += len(owner)
        found = [best]
        starts = np.flatnonzero(np.diff(block, prepend=-1))
        for first, last in zip(starts, [*starts[1:], len(block)]):
            who, b = owner[first:last], int(block[first])
            scores = products(asked[who], blocks[b].wide(dims))
            hit, at = np.nonzero((scores >= kth[who][:, None]) & (blocks[b].rows != queries.rows[who][:, None]))
            found.append((who[hit], scores[hit, at], np.full(len(hit), b), at))
        best, kth = _best(found, blocks, kth, k)
        done, step = end, step * 2
        if done >= len(blocks):
            break
        active = active[bounds[active, done] >= kth[active]]
    return *best, scored


def _best(found: list[tuple], blocks: list[Block], kth: np.ndarray, k: int) -> tuple[tuple, np.ndarray]:
    """The k best of each query by score, ties to the smaller id (null last), and the raised thresholds."""
    query, score, block, at = (np.concatenate(c) for c in zip(*found))
    starts = np.concatenate([[0], np.cumsum([len(b.rows) for b in blocks])])
    place = starts[block] + at
    names = np.concatenate([b.ids for b in blocks])[place]
    order = np.lexsort((place, names, np.concatenate([b.unnamed for b in blocks])[place], -score, query))
    query, score, block, at = query[order], score[order], block[order], at[order]
    first = np.searchsorted(query, query)
    nth = np.arange(len(query)) - first
    kth = kth.copy()
    last = nth == k - 1
    kth[query[last]] = np.maximum(kth[query[last]], score[last])
    stays = nth < k
    return (query[stays], score[stays], block[stays], at[stays]), kth


def _answers(k: int):
    """Task function: the blocks of a stripe, then the query batches that meet it, sorted so."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, blocks = None, []
        for batch in batches:
            for row in batch.to_pylist():
                key = row["stripe"], row["part"]
                if key != at:
                    at, blocks = key, []
                if row["role"] == 0:
                    blocks.append(Block.read(row))
                    continue
                if not blocks:
                    continue
                queries = Block.read(row)
                query, score, block, place, _ = search(queries, blocks, k)
                starts = np.concatenate([[0], np.cumsum([len(b.rows) for b in blocks])])
                place = starts[block] + place
                ids, unnamed, rows = (np.concatenate([getattr(b, c) for b in blocks])[place] for c in ("ids", "unnamed", "rows"))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(queries.rows[query]), pa.array(queries.ids[query], mask=queries.unnamed[query]), pa.array(score),
                     pa.array(ids, mask=unnamed), pa.array(rows)],
                    names=["query_row", "query_id", "score", "id", "row"],
                )

    return run


def top_k(vectors: DataFrame, asks: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best other rows of every row for which ``asks`` holds; ids are whole numbers.

    A component x counts as floor(scale * x), taken as double; the score is the inner product of these whole numbers, and ties go to the smaller
    id.  Rows with a null vector, or one with a null or non-finite component (also after scaling), are neither
    queries nor candidates.  Vectors of different lengths meet as if the shorter one ended in zeros, an empty one scores zero with
    all.  Rows with a null id are candidates that lose all ties, and queries if ``asks`` holds for them.  Repeated rows are rows of their own: each of them
    is asked and found, only a row itself is left out.  Scores beyond a long are held at its limits and tie there.  An
    empty table, or no query, gives an empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    finite = F.forall(_scaled(F.col(vec_col), scale), lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    rows = vectors.where(F.col(vec_col).isNotNull() & finite).select(
        F.col(id_col).cast("bigint").alias("id"), F.monotonically_increasing_id().alias("row"),
        _scaled(F.col(vec_col), scale).alias("vec"), F.coalesce(asks, F.lit(False)).alias("asks"),
    )
    blocks = vector_blocks(rows, k)
    queries = _query_batches(blocks)
    total, asked = blocks.agg(F.sum(F.size("rows"))).first()[0] or 0, queries.agg(F.sum(F.size("rows"))).first()[0] or 0
    wanted = int(spark.conf.get("spark.sql.shuffle.partitions"))
    stripes = max(1, math.ceil(total / STRIPE_ROWS), min(wanted, math.ceil(total / LEAST_STRIPE_ROWS)))
    parts = max(1, math.ceil(asked / PART_ROWS))
    dealt = lambda n: F.pmod(F.xxhash64(F.element_at("rows", 1)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    stock = blocks.select("*", dealt(stripes).alias("stripe"), every(parts).alias("part"), F.lit(0).alias("role"))
    asking = queries.select("*", every(stripes).alias("stripe"), dealt(parts).alias("part"), F.lit(1).alias("role"))
    met = stock.unionByName(asking).repartition(stripes * parts, "stripe", "part").sortWithinPartitions("stripe", "part", "role")
    found = met.mapInArrow(_answers(k), "query_row bigint, query_id bigint, score bigint, id bigint, row bigint")
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", "rank", F.col("id").alias("vec_id"), "score"
    )
