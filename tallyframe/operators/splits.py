"""Exact stratified three-way split without a shuffle of the rows.

Rows of a stratum are ordered by a keyed hash.  Instead of sorting them, the
operator looks for the two *cut points* of every stratum - the last training row
and the last validation row in hash order - and then labels each row by comparing
it with its stratum's cut points:

1. count rows per stratum, a map-side combined aggregate;
2. quotas by largest remainder, the remainders ranked by a sort of the strata;
3. where a cut has more than ``FEW_ROWS`` rows to choose from, count them by the next
   bits of the hash and go on in the bucket that holds the cut, until few are left;
4. rank those few to get the exact cut rows;
5. compare every row with its cut points (a lookup of one row per stratum).

A stratum holding a third of all rows costs no more than any other, and so do a
million strata: a window sees at most ``FEW_ROWS`` rows or the buckets of one
round, and no step has all strata in one task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from decimal import ROUND_CEILING, Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions import hash60
from tallyframe.storage import settle

_HASH_BITS = 60
#: Rows (with different hash and key) among which a cut is found by ranking them in one task.
FEW_ROWS = 1 << 12


def _rounded_up(total: int, share: float) -> int:
    """``ceil(total * share)`` with float noise such as 0.1 + 0.2 removed first."""
    return int((Decimal(total) * Decimal(repr(round(share, 12)))).quantize(Decimal("1.000000"))
               .to_integral_value(ROUND_CEILING))


def ranked(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """Add the place (from 1) of each row in an order of the whole table, by a sort and a prefix sum over its partitions.

    The only window without partition sees one row per sorted partition.
    """
    placed = settle(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns(
            {"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}
        ),
        "ranked",
    )
    parts = placed.groupBy("_part").agg(F.count("*").alias("_rows"))
    upto = F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    starts = parts.select("_part", (upto - F.col("_rows")).alias("_before"))
    return placed.join(starts, "_part").withColumn(name, F.col("_before") + F.col("_at") + 1).drop("_part", "_at", "_before")


def apportion(strata: DataFrame, size: str, total: int, draws: int, quota: str) -> DataFrame:
    """Share ``draws`` over the strata in proportion to ``size``, which adds up to ``total``.

    Everyone gets the floor of the exact share; the rest goes to the largest
    remainders, ties to the smaller stratum value.  Integer arithmetic throughout.
    """
    if total == 0:
        return strata.withColumn(quota, F.lit(0).cast("bigint"))
    wide = "decimal(38,0)"
    whole = F.lit(Decimal(total)).cast(wide)
    product = F.col(size).cast("decimal(19,0)") * F.lit(Decimal(draws)).cast("decimal(19,0)")
    shares = strata.withColumn("_rem", (product % whole).cast(wide))
    shares = shares.withColumn("_floor", ((product - F.col("_rem")) / whole).cast("bigint"))
    shares = ranked(shares, "_place", F.desc("_rem"), F.asc_nulls_first("stratum"))
    left = draws - (shares.agg(F.sum("_floor")).first()[0] or 0)
    return shares.withColumn(quota, F.col("_floor") + (F.col("_place") <= left).cast("bigint")).drop("_rem", "_floor", "_place")


def _prefix(bits: int) -> Column:
    """The first bits of the hash."""
    return F.shiftright("hash", _HASH_BITS - bits) if bits else F.lit(0).cast("bigint")


def _inside(base: DataFrame, groups: DataFrame, bits: int) -> DataFrame:
    """Rows of ``base`` whose stratum and first bits are among the groups (stratum, prefix, ...)."""
    rows = base.withColumn("_prefix", _prefix(bits))
    same = F.col("b._prefix").eqNullSafe(F.col("g.prefix")) & F.col("b.stratum").eqNullSafe(F.col("g.stratum"))
    return rows.alias("b").join(groups.alias("g"), same)


def _cut_points(base: DataFrame, quotas: DataFrame, cuts: Sequence[str], bucket_bits: int) -> DataFrame:
    """Per stratum, the (hash, key) pair of the row at each cumulative quota."""
    marks = quotas.select(
        "stratum", "n", F.explode(F.array(*(F.struct(F.lit(c).alias("cut"), F.col(c).alias("nth")) for c in cuts))).alias("m")
    ).select("stratum", F.lit(0).cast("bigint").alias("prefix"), "n", "m.cut", "m.nth")
    marks = settle(marks.where("nth > 0"), "cut-marks")
    found, bits = [], 0
    while True:
        few = marks if bits == _HASH_BITS else marks.where(F.col("n") <= FEW_ROWS)
        found.append(_ranked_cuts(base, few, bits))
        marks = marks.where(F.col("n") > FEW_ROWS)
        if bits == _HASH_BITS or marks.isEmpty():
            break
        step = min(bucket_bits, _HASH_BITS - bits)
        marks = settle(_refined(base, marks, bits, step), "cut-marks")
        bits += step
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    per_stratum = every.groupBy("stratum").agg(*(F.max(F.when(F.col("cut") == c, F.col("at"))).alias(c) for c in cuts))
    return settle(per_stratum, "cut-points")


def _refined(base: DataFrame, marks: DataFrame, bits: int, step: int) -> DataFrame:
    """Marks with ``step`` more bits: the bucket that holds the cut, its rows and the cut's place among them."""
    groups = marks.select("stratum", "prefix").distinct()
    bucket = F.col("b._prefix") * (1 << step) + F.shiftright("b.hash", _HASH_BITS - bits - step).bitwiseAND((1 << step) - 1)
    counts = _inside(base, settle(groups, "cut-groups"), bits).groupBy("b.stratum", F.col("b._prefix").alias("prefix"), bucket.alias("bucket")).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("stratum", "prefix").orderBy("bucket"))
    spans = settle(counts, "cut-counts").select("stratum", "prefix", "bucket", "n", (upto - F.col("n")).alias("before"), upto.alias("upto"))
    same = F.expr("s.prefix = m.prefix AND s.stratum <=> m.stratum AND m.nth > s.before AND m.nth <= s.upto")
    return spans.alias("s").join(marks.alias("m"), same).select(
        "s.stratum", F.col("s.bucket").alias("prefix"), "s.n", "m.cut", (F.col("m.nth") - F.col("s.before")).alias("nth")
    )


def _ranked_cuts(base: DataFrame, marks: DataFrame, bits: int) -> DataFrame:
    """(stratum, cut, at) of marks with few rows to choose from; rows of one hash and key count together."""
    groups = settle(marks.groupBy("stratum", "prefix").agg(F.collect_list(F.struct("cut", "nth")).alias("cuts")), "cut-groups")
    rows = _inside(base, groups, bits).groupBy("b.stratum", "b._prefix", "b.hash", "b.key").agg(F.count("*").alias("n"), F.first("g.cuts").alias("cuts"))
    upto = F.sum("n").over(Window.partitionBy("stratum", "_prefix").orderBy("hash", "key"))
    placed = rows.withColumn("upto", upto).select("stratum", "n", "upto", F.struct("hash", "key").alias("at"), F.explode("cuts").alias("c"))
    return placed.where("c.nth <= upto AND c.nth > upto - n").select("stratum", "c.cut", "at")


def require_unique(df: DataFrame, key: str) -> None:
    """Refuse tables whose key has duplicates or nulls (one combined aggregate)."""
    clash = df.groupBy(key).agg(F.count("*").alias("n")).where(
        (F.col("n") > 1) | F.col(key).isNull()
    )
    worst = clash.limit(1).collect()
    if worst:
        raise ValueError(f"{key} is not a unique key: {worst[0][key]!r} occurs {worst[0]['n']} times")


def stratified_split(
    df: DataFrame,
    key: str,
    strata: str,
    ratios: tuple[float, float, float] = (0.8, 0.1, 0.1),
    seed: int = 42,
    strict: bool = False,
    check_key: bool = True,
    bucket_bits: int = 12,
) -> DataFrame:
    """Add ``split`` (train | val | test) with exact quotas per stratum.

    A stratum is a value of ``strata``; null is a stratum of its own.  With
    ``strict`` a stratum of one row, or fewer held-out rows than strata, is an
    error; otherwise such rows simply go where the quotas put them.  ``bucket_bits`` of
    the hash are counted in one round.
    """
    if not math.isclose(sum(ratios), 1.0, abs_tol=1e-9):
        raise ValueError("split ratios must add up to 1")
    if check_key:
        require_unique(df, key)

    def digest(column: str) -> Column:
        return hash60(str(seed), F.col(column).cast("string")).alias("hash")

    base = df.select(F.col(strata).alias("stratum"), F.col(key).alias("key"), digest(key))
    sizes = settle(base.groupBy("stratum").agg(F.count("*").alias("n")), "strata")
    facts = sizes.agg(F.sum("n"), F.count("*"), F.min("n")).first()
    total, groups, smallest = int(facts[0] or 0), int(facts[1]), facts[2]
    held = min(total, _rounded_up(total, ratios[1] + ratios[2]))
    tested = 0
    if held:
        tested = min(held, _rounded_up(held, 1.0 - ratios[1] / (ratios[1] + ratios[2])))
    if strict and total:
        if smallest < 2:
            raise ValueError("a stratum has a single row")
        if min(held, tested, held - tested) < groups:
            raise ValueError("fewer held-out rows than strata")
    quotas = apportion(sizes, "n", total, total - held, "train")
    quotas = quotas.withColumn("left_over", F.col("n") - F.col("train"))
    quotas = apportion(quotas, "left_over", held, held - tested, "val")
    quotas = quotas.withColumn("val", F.col("train") + F.col("val"))

    cuts = _cut_points(base, quotas, ["train", "val"], bucket_bits)
    here = F.struct(digest(f"d.{key}"), F.col(f"d.{key}").alias("key"))
    label = (
        F.when(here <= F.col("c.train"), "train")
        .when(here <= F.col("c.val"), "val")
        .otherwise("test")
    )
    return (
        df.alias("d")
        .join(cuts.alias("c"), F.col(f"d.{strata}").eqNullSafe(F.col("c.stratum")), "left")
        .select("d.*", label.alias("split"))
    )


def split_info(df: DataFrame, seed: int, strata: str, columns: Sequence[str]) -> DataFrame:
    """One row: sizes and shares of the three parts and how they were made."""

    def part(name: str) -> Column:
        return F.count(F.when(F.col("split") == name, 1))

    return df.agg(
        F.count("*").alias("total"), *(part(s).alias(s) for s in ("train", "val", "test"))
    ).select(
        F.lit(seed).alias("seed"),
        "total",
        "train",
        "val",
        "test",
        *(
            F.round(F.try_divide(F.col(s) * 100.0, F.col("total")), 1).alias(f"{s}_pct")
            for s in ("train", "val", "test")
        ),
        F.lit(strata).alias("stratify_on"),
        F.array(*(F.lit(c) for c in columns)).alias("columns"),
    )
