from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyframe.operators.cells import (
    confusion_cells,
    confusion_matrix,
    confusion_matrix_wide,
    rejected_rows,
)
from tallyframe.operators.errors import (
    attach_text,
    errors,
    errors_by_confidence,
    first_errors,
)
from tallyframe.operators.metrics import (
    accuracy,
    classification_report,
    evaluate,
    macro_f1,
    mean_macro_f1,
    per_class,
    task_metrics,
    weighted_f1,
)

SCHEMA = "run string, task string, row_idx bigint, y_true int, y_pred int, confidence double"


def brute_force(pairs):
    """Definitions applied to a list of (true, predicted)."""
    classes = sorted({t for t, _ in pairs} | {p for _, p in pairs if p is not None})
    out = {}
    for c in classes:
        tp = sum(t == c and p == c for t, p in pairs)
        support = sum(t == c for t, _ in pairs)
        predicted = sum(p == c for _, p in pairs)
        out[c] = (
            tp / predicted if predicted else 0.0,
            tp / support if support else 0.0,
            2 * tp / (support + predicted) if support + predicted else 0.0,
            support,
        )
    return out


def frame(table, pairs, run="r", task="t"):
    return table(SCHEMA, *((run, task, i, t, p, 0.5) for i, (t, p) in enumerate(pairs)))


MIXED = [(0, 0), (0, 1), (1, 1), (1, 3), (2, 0), (2, None)]


def test_per_class_with_one_sided_classes_and_null_predictions(table):
    scores = {r["class"]: r for r in per_class(confusion_cells(frame(table, MIXED))).collect()}
    expected = brute_force(MIXED)
    assert set(scores) == set(expected) == {0, 1, 2, 3}
    for c, (p, r, f1, support) in expected.items():
        row = scores[c]
        assert (row.precision, row.recall, row.f1, row.support) == (p, r, f1, support)


@pytest.mark.parametrize(
    "pairs",
    [MIXED, [(0, 0)], [(0, 1)], [(0, 0), (0, 0)], [(0, 1), (1, 0)], [(5, None)]],
)
def test_task_figures_match_their_definitions(table, pairs):
    cells = confusion_cells(frame(table, pairs))
    expected = brute_force(pairs)
    row = task_metrics(cells).first()
    assert row.accuracy == pytest.approx(sum(t == p for t, p in pairs) / len(pairs))
    assert row.macro_f1 == pytest.approx(sum(v[2] for v in expected.values()) / len(expected))
    assert row.weighted_f1 == pytest.approx(sum(v[2] * v[3] for v in expected.values()) / len(pairs))
    assert row.per_class_f1 == [expected[c][2] for c in sorted(expected)]
    assert row.errors == sum(t != p for t, p in pairs)
    assert accuracy(cells).first().accuracy == pytest.approx(row.accuracy)
    assert macro_f1(cells).first().macro_f1 == pytest.approx(row.macro_f1)
    assert weighted_f1(cells).first().weighted_f1 == pytest.approx(row.weighted_f1)


def test_class_names_work_like_class_ids(table):
    named = table("run string, task string, y_true string, y_pred string",
                  ("r", "t", "a", "a"), ("r", "t", "b", "a"))
    assert task_metrics(confusion_cells(named)).first().macro_f1 == pytest.approx((2 / 3 + 0) / 2)


def test_rows_without_truth_are_counted_not_judged(table):
    data = frame(table, [(0, 0), (None, 0), (None, None), (1, 0)])
    assert sum(r.n for r in confusion_cells(data).collect()) == 2
    assert rejected_rows(data).first().rejected == 2
    assert errors(data).count() == 1


def test_empty_predictions_give_empty_tables(table):
    data = frame(table, [])
    assert task_metrics(confusion_cells(data)).count() == 0
    assert errors_by_confidence(data).columns == data.columns
    assert evaluate(data).count() == 0


ENCODER = [("t", i, n) for i, n in enumerate("abcd")]


def test_dense_matrix_covers_the_encoder(table):
    encoder = table("task string, class_id int, class_name string", *ENCODER)
    matrix = confusion_matrix(confusion_cells(frame(table, MIXED)), encoder)
    got = {(r.y_true, r.y_pred): r.n for r in matrix.collect()}
    assert len(got) == 16
    seen = Counter(p for p in MIXED if p[1] is not None)
    assert got == {(t, p): seen.get((t, p), 0) for t in range(4) for p in range(4)}
    wide = {r.y_true: [r[f"pred_{c}"] for c in range(4)] for r in confusion_matrix_wide(matrix, 4).collect()}
    assert wide[1] == [0, 1, 0, 1] and wide[3] == [0, 0, 0, 0]


def test_macro_f1_over_all_encoder_classes(table):
    encoder = table("task string, class_id int, class_name string", *ENCODER)
    cells = confusion_cells(frame(table, [(0, 0), (1, 1)]))
    assert macro_f1(cells).first().macro_f1 == 1.0
    assert macro_f1(cells, encoder=encoder).first().macro_f1 == 0.5


def test_report_has_class_and_summary_rows(table):
    encoder = table("task string, class_id int, class_name string", *ENCODER)
    pairs = [(0, 0), (0, 1), (1, 1), (2, 2)]
    report = {r.label: r for r in classification_report(confusion_cells(frame(table, pairs)), encoder).collect()}
    assert list(sorted(report)) == ["a", "accuracy", "b", "c", "d", "macro avg", "weighted avg"]
    assert report["accuracy"].precision == report["accuracy"].support == 0.75
    assert report["d"].support == 0.0
    assert report["macro avg"].recall == pytest.approx((0.5 + 1 + 1) / 3)
    assert report["weighted avg"].recall == pytest.approx(0.75)
    assert report["macro avg"].support == 4.0


def test_evaluate_adds_the_mean_of_task_values(table):
    data = frame(table, [(0, 0), (1, 1)], task="x").unionByName(frame(table, [(0, 1), (1, 1)], task="y"))
    got = {r.task: r for r in evaluate(data).collect()}
    assert got["MEAN"].macro_f1 == pytest.approx((1.0 + 1 / 3) / 2)
    assert got["MEAN"].errors == 1
    by_task = macro_f1(confusion_cells(data))
    assert mean_macro_f1(by_task).first().mean_macro_f1 == pytest.approx(got["MEAN"].macro_f1)


def test_metrics_do_not_depend_on_shuffle_partitions(spark, table):
    data = frame(table, MIXED * 50)
    first = task_metrics(confusion_cells(data)).collect()
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert task_metrics(confusion_cells(data)).collect() == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_first_errors_follow_row_order_with_text(spark, table):
    data = spark.range(2000).select(
        F.lit("r").alias("run"), F.lit("t").alias("task"), F.col("id").alias("row_idx"),
        F.lit(0).alias("y_true"), (F.col("id") % 3 == 0).cast("int").alias("y_pred"),
        F.lit(0.5).alias("confidence"),
    )
    found = first_errors(data.repartition(7), 20)
    assert sorted((r.place, r.row_idx) for r in found.collect()) == [(i + 1, 3 * i) for i in range(20)]
    texts = spark.range(2000).select(F.col("id").alias("row_idx"), F.concat(F.lit("q"), "id").alias("text"))
    assert {r.text for r in attach_text(found, texts).collect()} == {f"q{3 * i}" for i in range(20)}


def test_errors_by_confidence_are_sorted_with_stable_ties(table):
    data = table(SCHEMA, ("r", "t", 3, 0, 1, 0.9), ("r", "t", 1, 0, 1, 0.9), ("r", "t", 2, 0, 0, 1.0),
                 ("r", "t", 4, 0, None, 0.99))
    assert [r.row_idx for r in errors_by_confidence(data).collect()] == [4, 1, 3]
    assert [r.row_idx for r in errors_by_confidence(data, 2).collect()] == [4, 1]
