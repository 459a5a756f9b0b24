import pytest

from tallyframe.operators.resample import align_runs, profile_counts
from tallyframe.plans import compare_runs
from tallyframe.sources import append_aligned, read_aligned, store_aligned
from tallyframe.storage import fresh_path

RUNS = ["m_1", "m_2", "s_1", "s_2"]


def predictions(spark, runs=RUNS):
    rows = [
        (r[0], r, int(r[2]), i, t, i % 3 if t == "a" else i % 2, (i * (k + 2)) % 3 if t == "a" else (i + k) % 2, "extra")
        for k, r in enumerate(RUNS) if r in runs for t in "ab" for i in range(50)
    ]
    return spark.createDataFrame(rows, "prefix string, run string, seed int, row_idx long, task string, y_true int, y_pred int, other string")


def rows(df):
    return sorted(map(str, df.collect()))


def test_pairing_reads_buckets_without_an_exchange(spark):
    plain = predictions(spark)
    stored = store_aligned(plain, fresh_path(spark, "stored"), buckets=5)
    for joint in (False, True):
        aligned = align_runs(stored, ["a", "b"], RUNS, joint)
        plan = aligned._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SelectedBucketsCount: 5 out of 5" in plan
        assert rows(aligned) == rows(align_runs(plain, ["a", "b"], RUNS, joint))
        assert rows(profile_counts(stored, ["a", "b"], RUNS, joint)) == rows(profile_counts(plain, ["a", "b"], RUNS, joint))


def test_runs_are_added_to_their_buckets(spark):
    path = fresh_path(spark, "stored")
    store_aligned(predictions(spark, RUNS[:2]), path, buckets=3)
    append_aligned(predictions(spark, RUNS[2:]), path)
    stored = read_aligned(spark, path)
    aligned = align_runs(stored, ["a"], RUNS)
    assert "Exchange" not in aligned._jdf.queryExecution().executedPlan().toString()
    assert rows(aligned) == rows(align_runs(predictions(spark), ["a"], RUNS))
    assert stored.where("split IS NOT NULL").isEmpty() and stored.count() == 400
    other = read_aligned(spark.newSession(), path)
    assert other.count() == 400


def test_empty_and_missing(spark):
    path = fresh_path(spark, "stored")
    assert store_aligned(predictions(spark).limit(0), path).count() == 0
    with pytest.raises(FileNotFoundError):
        read_aligned(spark, path + "-none")


def test_comparison_aligns_once(spark):
    plain = predictions(spark)
    stored = compare_runs(plain, ["a", "b"], RUNS[:2], RUNS[2:], 20, method="hash")
    direct = compare_runs(plain, ["a", "b"], RUNS[:2], RUNS[2:], 20, method="hash", align=False)
    for name in direct:
        assert rows(stored[name]) == rows(direct[name])
