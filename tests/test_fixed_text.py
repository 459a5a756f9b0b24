"""Numbers are written as Python writes them: by the exact value of the double."""

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.functions import fixed_text, interval_text, mean_std_text


def written(spark, numbers, digits, plus=False):
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(numbers)], "i int, x double")
    return [r.t for r in frame.select("i", fixed_text(F.col("x"), digits, plus).alias("t")).orderBy("i").collect()]


def test_all_multiples_of_half_a_step_in_one_unit(spark):
    numbers = [k * 0.00005 for k in range(20_001)] + [k / 20_000 for k in range(20_001)]
    assert written(spark, numbers, 4) == [f"{x:.4f}" for x in numbers]


@pytest.mark.parametrize("digits", [1, 3, 7])
def test_neighbours_of_ties_exact_ties_and_random_doubles(spark, digits):
    ties = [(2 * k + 1) / (2 * 10**digits) + whole for k in range(0, 10**digits, max(1, 10**digits // 300)) for whole in (0, 1, 977, 2**40)]
    exact = [k / 2.0**j for j in range(1, 12) for k in range(1, 60, 2)]
    random = np.random.default_rng(5).integers(0, 2**63 - 1, 2000).tolist()
    random = [x for x in (struct.unpack("<d", struct.pack("<q", b))[0] for b in random) if x < 2.0**63]
    numbers = [y for x in ties for y in (x, math.nextafter(x, math.inf), math.nextafter(x, 0), -x)] + exact + random
    assert written(spark, numbers, digits) == [f"{x:.{digits}f}" for x in numbers]
    assert written(spark, numbers, digits, True) == [f"{x:+.{digits}f}" for x in numbers]


def test_ends_of_the_range(spark):
    numbers = [0.0, -0.0, -0.00001, 0.99996, -9.99995, 5e-324, 2.0**53 + 2, 2.0**62, math.inf, -math.inf, math.nan, None]
    assert written(spark, numbers, 4) == [None if x is None else f"{x:.4f}" for x in numbers]
    assert [float(t) for t in written(spark, [2.0**63, -(2.0**70)], 1)] == [2.0**63, -(2.0**70)]


def test_texts_of_results(spark):
    row = spark.range(1).select(
        mean_std_text(F.lit(0.00015), F.lit(0.03125)).alias("m"), interval_text(F.lit(-0.0005), F.lit(0.0235)).alias("i")
    ).first()
    assert row.m == "0.0001 ± 0.0312" and row.i == f"[{-0.0005:+.3f}, {0.0235:+.3f}]"


def test_digits_out_of_range():
    with pytest.raises(ValueError):
        fixed_text(None, 8)


def test_code_is_small_enough_to_be_compiled(spark):
    frame = spark.range(1).select((F.col("id") / 32).alias("x")).select(fixed_text(F.col("x"), 4), fixed_text(F.col("x") / 7, 3, True))
    code = frame._jdf.queryExecution().debug().codegenToSeq()
    assert code.size() > 0 and all(0 < code.apply(i)._3().maxMethodCodeSize() < 8000 for i in range(code.size()))


def test_inside_a_lambda_and_null(spark):
    frame = spark.createDataFrame([([0.125, None, -2.5],)], "xs array<double>")
    assert frame.select(F.transform("xs", lambda x: fixed_text(x, 2))).first()[0] == ["0.12", None, "-2.50"]
