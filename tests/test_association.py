import random
from collections import Counter
from math import sqrt

import pytest

from tallyframe.operators import association
from tallyframe.operators.association import contingency, cramers_v


def some_rows(n, columns, seed=0):
    pick = random.Random(seed)
    rows = []
    for i in range(n):
        base = pick.randint(0, 5)
        rows.append(tuple(None if pick.random() < 0.05 else (base + pick.randint(0, k % 4)) % (2 + k % 7) for k in range(columns)))
    return rows


def counted(rows, names):
    return {
        (a, b, str(x), str(y)): n
        for i, a in enumerate(names) for j, b in enumerate(names) if j >= i
        for (x, y), n in Counter((r[i], r[j]) for r in rows if r[i] is not None and r[j] is not None).items()
    }


@pytest.mark.parametrize("chunk,pair,held", [(1 << 16, 1 << 16, 1 << 23), (7, 1 << 16, 40), (11, 6, 1 << 23), (5, 0, 0)])
def test_tables_of_all_pairs(spark, monkeypatch, chunk, pair, held):
    """In one piece, handed on often, and with pairs too large for a table."""
    for name, value in (("CHUNK_ROWS", chunk), ("PAIR_CELLS", pair), ("HELD_CELLS", held)):
        monkeypatch.setattr(association, name, value)
    names = ["x", "y", "a", "at_a"]
    rows = some_rows(150, 4)
    df = spark.createDataFrame(rows, ", ".join(f"{n} int" for n in names)).repartition(3)
    got = {(r.task_a, r.task_b, r.a, r.b): r.o for r in contingency(df, names).collect()}
    assert got == counted(rows, names)


def test_forty_columns_without_an_exchange_of_rows(spark):
    names = [f"c{k}" for k in range(40)]
    rows = some_rows(400, 40, 3)
    df = spark.createDataFrame(rows, ", ".join(f"{n} int" for n in names))
    plan = contingency(df, names)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("HashAggregate") < plan.index("Exchange") < plan.index("MapInArrow")
    got = {(r.task_a, r.task_b): r.v for r in cramers_v(df, names).collect()}
    assert len(got) == 1600
    cells = counted(rows, names)
    for a, b in (("c1", "c5"), ("c12", "c33"), ("c0", "c39")):
        table = {k[2:]: n for k, n in cells.items() if k[:2] == (a, b)}
        r, c = Counter(), Counter()
        for (x, y), n in table.items():
            r[x] += n
            c[y] += n
        total = sum(table.values())
        phi2 = sum(n * n / (r[x] * c[y]) for (x, y), n in table.items()) - 1
        assert got[a, b] == got[b, a] == pytest.approx(sqrt(phi2 / (min(len(r), len(c)) - 1)))


def test_odd_columns(spark):
    df = spark.createDataFrame([(None, 1), (None, 2)], "x string, y int")
    assert {(r.task_a, r.a, r.o) for r in contingency(df, ["x", "y"]).collect()} == {("y", "1", 1), ("y", "2", 1)}
    assert contingency(df.limit(0), ["x", "y"]).count() == 0
