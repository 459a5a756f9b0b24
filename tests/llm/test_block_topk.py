import random

import numpy as np
import pytest

from pyspark.sql import functions as F
from tallyframe.llm import block_topk
from tallyframe.llm.block_topk import Block, products, search, top_k

SCHEMA = "vec_id long, embedding array<double>, label int, row string, score double"


def brute(rows, k, step=3):
    kept = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for n, (q, v) in enumerate(kept):
        if q is None or q % step:
            continue
        scored = [(-max(-(2**63) + 1, min(2**63 - 1, sum(a * b for a, b in zip(v, w)))), i is None, i or 0) for m, (i, w) in enumerate(kept) if m != n]
        out += [(q, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def found(spark, rows, k, step=3):
    df = spark.createDataFrame([(i, v, 1, "x", 0.0) for i, v in rows], SCHEMA)
    return sorted((tuple(r) for r in top_k(df, F.col("vec_id") % step == 0, k).collect()), key=str)


def test_best_are_those_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(block_topk, "BLOCK_ROWS", 5)
    monkeypatch.setattr(block_topk, "BATCH_ROWS", 4)
    monkeypatch.setattr(block_topk, "LEAST_STRIPE_ROWS", 20)
    monkeypatch.setattr(block_topk, "PART_ROWS", 10)
    pick = random.Random(4)
    rows = [(i, [pick.gauss(0, 1) for _ in range(6)]) for i in range(90)]
    rows += [(100 + i, rows[3][1]) for i in range(40)]  # copies: ties go to the smaller id
    assert found(spark, rows, 4) == brute(rows, 4)


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, -2.5]), (3, None), (6, [1.0, None]), (9, [inf, 0.0]), (12, [nan, 1.0]), (15, []), (18, [0.5]), (21, [1.0, 2.0, 3.0]),
            (None, [1.0, -2.5]), (None, [1.0, -2.5]), (0, [1.0, -2.5]), (30, [-0.0001, 0.0001]), (33, [1e300, 1e300])]
    assert found(spark, rows, 3) == brute(rows, 3)
    assert found(spark, rows, 50) == brute(rows, 50)
    assert found(spark, [], 3) == [] == found(spark, [(1, [1.0])], 3)
    assert found(spark, [(0, [1.0])], 3) == []


def test_products_are_exact_beyond_doubles():
    a, b = np.array([[2.0**40 + 1, 3.0], [2.0**200, 0.0]]), np.array([[2.0**20 + 1, -1.0], [-(2.0**200), 5.0]])
    assert products(a, b).tolist() == [[(2**40 + 1) * (2**20 + 1) - 3, -(2**63) + 1], [2**63 - 1, -(2**63) + 1]]


def _block(vectors, start, seeds=None):
    n = len(vectors)
    rows = np.arange(start, start + n)
    return Block(rows, np.zeros(n, bool), rows, np.full(n, -(2**63)) if seeds is None else seeds, np.ones(n, bool), vectors)


def test_blocks_below_the_threshold_are_not_scored():
    spin = np.random.default_rng(1)
    centres = spin.integers(-900, 900, (20, 8))
    blocks = [_block(c + spin.integers(-9, 9, (32, 8)), 32 * i) for i, c in enumerate(centres)]
    queries = _block(centres + 1, 10_000)
    query, score, block, at, scored = search(queries, blocks, 5)
    every = np.hstack([queries.vectors @ b.vectors.T for b in blocks])
    assert [sorted(score[query == q])[::-1] for q in range(20)] == [sorted(r)[::-1][:5] for r in every.tolist()]
    assert scored < 0.3 * 20 * 20


@pytest.mark.parametrize("seed", range(3))
def test_search_by_rounds_is_exact(seed):
    spin = np.random.default_rng(seed)
    blocks = [_block(spin.integers(-3, 3, (7, 3)), 7 * i) for i in range(17)]
    queries = _block(spin.integers(-3, 3, (11, 3)), 1000)
    query, score, block, at, _ = search(queries, blocks, 6)
    names = np.array([blocks[b].ids[i] for b, i in zip(block, at)])
    for q in range(11):
        every = sorted((-int(queries.vectors[q] @ v), int(i)) for b in blocks for v, i in zip(b.vectors, b.ids))[:6]
        assert sorted(zip((-score[query == q]).tolist(), names[query == q].tolist())) == every
