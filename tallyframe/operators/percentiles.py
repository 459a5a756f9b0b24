"""Exact percentiles of groups of any size, by counting.

A value is turned into 64 bits that order as the values do.  Rows are counted by the highest 16 bits; the bucket in which
a wanted rank lies is counted by the next 16 bits, and so on, four times at most.  No task holds the values of a group: it
adds up counts, of 65,536 buckets at most per group and rank.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.storage import lookup_join, settle

#: Bits counted in a round.
WIDTH = 16


@F.arrow_udf(T.LongType())
def _ordered_bits(values: pa.Array) -> pa.Array:
    """Bits of a double that compare, as signed numbers, like the doubles; one zero, one NaN above all."""
    numbers = values.to_numpy(zero_copy_only=False) + 0.0
    bits = np.where(np.isnan(numbers), np.nan, numbers).view(np.int64)
    return pa.array(np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits))


@F.arrow_udf(T.DoubleType())
def _value_of(bits: pa.Array) -> pa.Array:
    ordered = bits.to_numpy(zero_copy_only=False)
    return pa.array(np.where(ordered < 0, ordered ^ np.int64(0x7FFFFFFFFFFFFFFF), ordered).view(np.float64))


def _refine(keyed: DataFrame, targets: DataFrame, shift: int) -> DataFrame:
    """Narrow each target to the bucket of its rank: ``prefix`` grows by the bits at ``shift``, ``rank`` counts on from the bucket's start."""
    if shift + WIDTH < 64:
        wanted = targets.select("group", "prefix").distinct()
        keyed = lookup_join(keyed.withColumn("prefix", F.shiftright("bits", shift + WIDTH)), wanted, ["group", "prefix"], "inner")
        meet = ["group", "prefix"]
    else:
        meet = ["group"]
    counts = keyed.groupBy(*meet, F.shiftright("bits", shift).alias("bucket")).agg(F.count("*").alias("rows"))
    met = counts.join(targets, meet)
    upto = F.sum("rows").over(Window.partitionBy("group", "target").orderBy("bucket"))
    return met.withColumn("upto", upto).where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("rows"))).select(
        "group", "target", F.col("bucket").alias("prefix"), (F.col("rank") - F.col("upto") + F.col("rows")).alias("rank")
    )


def percentiles(df: DataFrame, value: str | Column, shares: Mapping[str, float], by: Sequence[str] = ("task",)) -> DataFrame:
    """``by``, ``n`` (values counted) and a column per name of ``shares``: the percentile of that share of 1.

    Between two values it is interpolated linearly, as ``percentile`` of Spark does, with which all
    results agree.  Null values are left out; a group without values has null percentiles.  NaN is greater than
    infinity.  The rows are written once in a narrow form and read four times.
    """
    if not shares or any(not 0 <= share <= 1 for share in shares.values()):
        raise ValueError(f"shares must be between 0 and 1: {dict(shares)}")
    number = (F.col(value) if isinstance(value, str) else value).cast("double")
    # A struct equals another one also where its fields are null.
    rows = settle(df.select(F.struct(*by).alias("group"), number.alias("number")), "numbers")
    counted = settle(rows.groupBy("group").agg(F.count("number").alias("n")), "counted")
    keyed = settle(rows.where("number is not null").select("group", _ordered_bits("number").alias("bits")), "bits")

    names = list(shares)
    position = {name: (F.col("n") - 1) * F.lit(float(shares[name])) for name in names}
    ends = F.array(*(
        F.struct(F.lit(2 * i + side).alias("target"), end(position[name]).cast("bigint").alias("rank"))
        for i, name in enumerate(names) for side, end in enumerate((F.floor, F.ceil))
    ))
    targets = counted.where("n > 0").select("group", F.explode(ends).alias("t")).select("group", "t.*", F.lit(0).cast("bigint").alias("prefix"))
    for shift in range(64 - WIDTH, -1, -WIDTH):
        targets = settle(_refine(keyed, targets, shift), "targets")

    found = targets.select("group", "target", _value_of("prefix").alias("number")).groupBy("group").agg(
        *(F.max(F.when(F.col("target") == t, F.col("number"))).alias(f"_{t}") for t in range(2 * len(names)))
    )

    def between(i: int, name: str) -> Column:
        low, high, at = F.col(f"_{2 * i}"), F.col(f"_{2 * i + 1}"), position[name]
        return F.when(low == high, low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high).alias(name)

    return counted.join(found, "group", "left").select("group.*", "n", *(between(i, name) for i, name in enumerate(names)))
