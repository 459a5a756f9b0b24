"""Percentiles by counting are those of the sorted values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.operators.percentiles import percentiles

SHARES = {"low": 0.025, "mid": 0.5, "third": 1 / 3, "high": 0.975, "least": 0.0, "most": 1.0}
INF, NAN = math.inf, math.nan

GROUPS = {
    "one value": [3.5],
    "two": [-1.0, 4.0],
    "ties": [2.0] * 50 + [1.0] * 7 + [2.0000000000000004],
    "signs": [0.0, -0.0, -5e-324, 5e-324, 1.7976931348623157e308, -1.7976931348623157e308],
    "infinite": [INF, -INF, 1.0, INF, 2.0],
    "not a number": [NAN, 1.0, INF, NAN],
    "gaps": [None, 1.0, None, 3.0],
    None: [7.0, 9.0, 8.0],
    "normal": [float(x) for x in np.random.default_rng(3).normal(size=5000)],
    "close": [1.0 + i * 2.0**-52 for i in range(300)],
}


def test_equal_to_the_sorted_values(spark, table):
    rows = [(name, x) for name, values in GROUPS.items() for x in values] + [("nothing", None)]
    frame = table("task string, x double", *rows).repartition(7)
    ours = {r["task"]: r.asDict() for r in percentiles(frame, "x", SHARES).collect()}
    spark_own = frame.groupBy("task").agg(F.count("x").alias("n"), *(F.percentile("x", F.lit(s)).alias(k) for k, s in SHARES.items()))
    theirs = {r["task"]: r.asDict() for r in spark_own.collect()}
    assert ours.keys() == theirs.keys()
    # Here zero has no sign; Spark keeps that of the zero it met first.
    assert repr(ours) == repr({k: theirs[k] for k in ours}).replace(": -0.0", ": 0.0")
    for name in ("one value", "ties", "normal", "close", None):
        assert ours[name]["mid"] == np.percentile(GROUPS[name], 50)
    assert ours["nothing"]["n"] == 0 and ours["nothing"]["mid"] is None
    assert ours["signs"]["least"] == -1.7976931348623157e308


def test_groups_of_several_columns_and_an_empty_table(table):
    frame = table("a int, b string, v int", (1, "x", 5), (1, "x", 6), (1, None, 1), (None, None, 2), (None, None, 4))
    got = {(r.a, r.b): (r.n, r.q) for r in percentiles(frame, F.col("v") * 2, {"q": 0.5}, ["a", "b"]).collect()}
    assert got == {(1, "x"): (2, 11.0), (1, None): (1, 2.0), (None, None): (2, 6.0)}
    assert percentiles(frame.where("false"), "v", {"q": 0.5}, ["a"]).collect() == []


def test_a_share_outside_one_is_refused(table):
    with pytest.raises(ValueError):
        percentiles(table("task string, x double", ("a", 1.0)), "x", {"q": 1.5})


def test_a_large_group_is_counted_before_the_exchange(spark):
    """One group of nearly all rows: the exchanges carry buckets, not rows."""
    frame = spark.range(400_000, numPartitions=8).select(
        F.when(F.col("id") % 1000 == 0, "b").otherwise("a").alias("task"), (F.col("id") % 777).cast("double").alias("x")
    )
    got = {r["task"]: (r.n, r.mid) for r in percentiles(frame, "x", {"mid": 0.5}).collect()}
    values = {t: [i % 777 for i in range(400_000) if (i % 1000 == 0) == (t == "b")] for t in "ab"}
    assert got == {t: (len(v), float(np.percentile(v, 50))) for t, v in values.items()}
