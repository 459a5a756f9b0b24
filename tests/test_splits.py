import hashlib
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import splits
from tallyframe.operators.splits import apportion, ranked, split_info, stratified_split

RATIOS = (0.8, 0.1, 0.1)


def largest_remainder(sizes, draws):
    total = sum(sizes.values())
    quota = {s: n * draws // total for s, n in sizes.items()}
    spare = draws - sum(quota.values())
    for s in sorted(sizes, key=lambda s: (-(sizes[s] * draws % total), s))[:spare]:
        quota[s] += 1
    return quota


def brute_force(data, seed, ratios=RATIOS):
    """The definition, row by row: quotas per stratum, rows in md5 order."""
    sizes = Counter(s for _, s in data)
    n = len(data)
    held = math.ceil(round(n * (ratios[1] + ratios[2]), 6))
    train = largest_remainder(sizes, n - held)
    rest = {s: sizes[s] - train[s] for s in sizes}
    tested = math.ceil(round(held * (1 - ratios[1] / (ratios[1] + ratios[2])), 6))
    val = largest_remainder(rest, held - tested)
    out = {}
    for s in sizes:
        keys = sorted(
            (k for k, x in data if x == s),
            key=lambda k: (int(hashlib.md5(f"{seed}|{k}".encode()).hexdigest()[:15], 16), k),
        )
        for i, k in enumerate(keys):
            out[k] = "train" if i < train[s] else "val" if i < train[s] + val[s] else "test"
    return out


@pytest.mark.parametrize("bits", [1, 4, 12])
def test_split_equals_the_row_by_row_definition(spark, table, bits):
    sizes = {"one": 1, "two": 2, "three": 3, "seven": 7, "hundred": 100, "most": 400}
    names = [s for s, n in sizes.items() for _ in range(n)]
    data = list(enumerate(names))
    df = table("k int, s string", *data)
    got = {r.k: r.split for r in stratified_split(df, "k", "s", RATIOS, 5, bucket_bits=bits).collect()}
    assert got == brute_force(data, 5)


def test_published_split_sizes(spark):
    df = spark.range(5009).withColumn("s", F.concat(F.lit("c"), (F.col("id") % 14).cast("string")))
    split = stratified_split(df, "id", "s", RATIOS, 42)
    info = split_info(split, 42, "s", ["s"]).first()
    assert (info.total, info.train, info.val, info.test) == (5009, 4007, 501, 501)


def test_split_does_not_depend_on_partitioning(spark):
    df = spark.range(3000).withColumn("s", (F.col("id") % 7 == 0).cast("string"))
    one = stratified_split(df.repartition(1), "id", "s")
    many = stratified_split(df.repartition(13), "id", "s")
    assert one.exceptAll(many).count() == 0


def test_null_stratum_is_a_group_of_its_own(table):
    df = table("k int, s string", *((i, None if i < 50 else "x") for i in range(100)))
    split = stratified_split(df, "k", "s")
    parts = Counter((r.s, r.split) for r in split.collect())
    assert parts[(None, "train")] == 40 and parts[("x", "train")] == 40
    assert sum(parts.values()) == 100


def test_duplicate_or_null_keys_are_refused(table):
    for keys in ([1, 2, 2], [1, None, 3]):
        with pytest.raises(ValueError, match="unique"):
            stratified_split(table("k int, s string", *((k, "a") for k in keys)), "k", "s")


def test_strict_mode_refuses_what_cannot_be_stratified(table):
    lonely = table("k int, s string", *((i, "a" if i else "b") for i in range(50)))
    with pytest.raises(ValueError, match="single"):
        stratified_split(lonely, "k", "s", strict=True)
    assert stratified_split(lonely, "k", "s").count() == 50
    many = table("k int, s string", *((i, f"s{i % 20}") for i in range(40)))
    with pytest.raises(ValueError, match="held-out"):
        stratified_split(many, "k", "s", strict=True)


def test_empty_input_and_two_way_split(table):
    assert stratified_split(table("k int, s string"), "k", "s").count() == 0
    df = table("k int, s string", *((i, "a") for i in range(10)))
    parts = Counter(r.split for r in stratified_split(df, "k", "s", (0.7, 0.0, 0.3)).collect())
    assert parts == {"train": 7, "test": 3}
    with pytest.raises(ValueError, match="add up"):
        stratified_split(df, "k", "s", (0.7, 0.1, 0.3))


def test_quotas_stay_exact_for_huge_counts(table):
    strata = table("stratum string, n bigint", ("a", 3 * 10**12), ("b", 10**12 + 1), ("c", 7))
    total = 4 * 10**12 + 8
    draws = 3 * 10**12
    got = {r.stratum: r.q for r in apportion(strata, "n", total, draws, "q").collect()}
    assert got == largest_remainder({"a": 3 * 10**12, "b": 10**12 + 1, "c": 7}, draws)
    assert sum(got.values()) == draws and total > draws


@pytest.mark.parametrize("few,bits", [(1, 1), (4, 3), (16, 7)])
def test_refined_buckets_give_the_same_rows(spark, table, monkeypatch, few, bits):
    """Cuts found through many rounds, in a stratum of nearly all rows and in small ones."""
    monkeypatch.setattr(splits, "FEW_ROWS", few)
    sizes = {None: 3, "one": 1, "five": 5, "most": 300}
    data = list(enumerate(s for s, n in sizes.items() for _ in range(n)))
    got = {r.k: r.split for r in stratified_split(table("k int, s string", *data), "k", "s", RATIOS, 5, bucket_bits=bits).collect()}
    null_first = [(k, "" if s is None else s) for k, s in data]  # the smallest stratum
    assert got == brute_force(null_first, 5)


def test_no_window_sees_more_than_few_rows(spark, monkeypatch):
    monkeypatch.setattr(splits, "FEW_ROWS", 32)
    seen = []
    real = splits._inside

    def watched(base, groups, bits):
        rows = real(base, groups, bits)
        if "cuts" in groups.columns:
            seen.append(rows.groupBy("b.stratum", "b._prefix").count().agg(F.max("count")).first()[0] or 0)
        return rows

    monkeypatch.setattr(splits, "_inside", watched)
    df = spark.range(6000).withColumn("s", F.when(F.col("id") < 5500, F.lit(-1)).otherwise(F.col("id") % 400))
    got = stratified_split(df, "id", "s", bucket_bits=5)
    assert {r.split: r["count"] for r in got.groupBy("split").count().collect()} == {"train": 4800, "val": 600, "test": 600}
    assert max(seen) <= 32 and len(seen) >= 2


def test_a_key_on_a_third_of_the_rows_stays_together(spark, monkeypatch):
    """With ``check_key=False``: rows of one key share hash and key, and so their part."""
    monkeypatch.setattr(splits, "FEW_ROWS", 4)
    df = spark.range(300).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("k"), F.lit("x").alias("s"))
    got = stratified_split(df, "k", "s", check_key=False, bucket_bits=8).groupBy("k").agg(F.countDistinct("split").alias("n"), F.count("*").alias("rows"))
    assert got.where("n > 1").isEmpty() and got.agg(F.sum("rows")).first()[0] == 300


def test_places_of_a_sorted_table(spark):
    df = spark.range(500).select((F.col("id") % 50).alias("x"), F.col("id").alias("y")).repartition(7)
    rows = ranked(df, "place", F.desc("x"), F.asc("y")).collect()
    assert [(r.x, r.y) for r in sorted(rows, key=lambda r: r.place)] == sorted(((r.x, r.y) for r in rows), key=lambda r: (-r[0], r[1]))
    assert sorted(r.place for r in rows) == list(range(1, 501))
