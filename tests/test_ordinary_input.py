"""Input that is a little out of order: unknown classes, missing scores, texts and truths, headers, reruns."""

import math

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import cells, errors, metrics, resample
from tallyframe.plans.evaluate import evaluate_scores
from tallyframe.sources.questions import read_questions, read_split, write_splits
from tallyframe.sources.runs import read_predictions, write_predictions


def test_wide_matrix_refuses_an_unknown_class(table):
    counts = table("run string, task string, y_true int, y_pred int, n long", ("r", "t", 0, 7, 3), ("r", "t", 0, 0, 2))
    with pytest.raises(Exception, match="unknown class: 7"):
        cells.confusion_matrix_wide(counts, 5, ["run", "task"]).collect()
    row = cells.confusion_matrix_wide(counts.where("y_pred = 0"), 5, ["run", "task"]).first()
    assert row.pred_0 == 2


def test_report_lists_a_class_that_the_encoder_lacks(table):
    counts = table("run string, task string, y_true int, y_pred int, n long", ("r", "t", 0, 0, 5), ("r", "t", 2, 0, 3), ("r", "u", 0, 0, 1))
    encoder = table("task string, class_id int, class_name string", ("t", 0, "a"), ("t", 1, "b"))
    rows = {(r.task, r.label): r.support for r in metrics.classification_report(counts, encoder, ["run", "task"]).collect()}
    assert rows[("t", "a")] == 5 and rows[("t", "b")] == 0 and rows[("t", "2")] == 3 and rows[("u", "0")] == 1
    assert rows[("t", "macro avg")] == 8


def test_a_judged_row_without_a_score_is_wrong(table):
    from tallyframe.operators.scoring import centroid_heads

    vectors = table("row_idx long, v array<double>, t int", (1, [1.0, 0.0], 0), (2, [0.0, 1.0], 1))
    heads = centroid_heads(vectors, "v", {"t": "t"})
    truth = table("row_idx long, task string, y_true int", (1, "t", 0), (3, "t", 1))
    got = evaluate_scores(vectors, "v", heads, truth)["metrics"].first()
    assert (got.n, got.accuracy) == (2, 0.5)


def test_an_error_without_its_text_stays(table):
    found = table("row_idx long, task string", (1, "t"), (2, "t"))
    assert {r.row_idx: r.text for r in errors.attach_text(found, table("row_idx long, text string", (1, "a"))).collect()} == {1: "a", 2: None}


def predictions(table, *rows):
    schema = "prefix string, run string, seed int, split string, row_idx long, task string, y_true int, y_pred int, confidence double"
    return table(schema, *(("p", run, 1, "test", i, task, true, pred, 0.5) for run, task, i, true, pred in rows))


def test_rows_without_truth_are_left_out_of_pairing(table):
    rows = [(r, "x", i, i % 2, 0) for r in ("a", "b") for i in range(6)] + [("a", "x", 9, None, 1), ("b", "x", 9, None, 0)]
    aligned = resample.align_runs(predictions(table, *rows), ["x"], ["a", "b"])
    assert aligned.count() == 6
    with pytest.raises(Exception, match="cannot be paired"):
        resample.align_runs(predictions(table, *rows, ("a", "x", 1, 0, 0)), ["x"], ["a", "b"]).collect()


def many(table):
    rows = [(r, t, i, i % k, (i * (3 + j)) % k) for t, k, size in (("x", 3, 60), ("y", 5, 400)) for j, r in enumerate(("a", "b")) for i in range(size)]
    return predictions(table, *rows)


def counted(frame, task):
    return sorted((r.b, r.run, r.y_true, r.y_pred, r.n) for r in frame.where(F.col("task") == task).collect())


def test_draws_of_a_task_depend_on_nothing_but_itself(table):
    source = many(table)
    alone = counted(resample.replicate_counts(source, ["x"], ["a", "b"], 40, profiles_per_block=4), "x")
    beside = counted(resample.replicate_counts(source.repartition(5), ["x", "y"], ["a", "b"], 40, profiles_per_block=4), "x")
    assert alone == beside


@pytest.mark.parametrize("per_block", [1, 3, 4096])
def test_every_replicate_has_all_its_draws(table, per_block):
    drawn = resample.replicate_counts(many(table), ["x", "y"], ["a", "b"], 60, profiles_per_block=per_block)
    totals = {(r.task, r.run, r.b): r.n for r in drawn.groupBy("task", "run", "b").agg(F.sum("n").alias("n")).collect()}
    assert len(totals) == 2 * 2 * 60 and all(n == {"x": 60, "y": 400}[task] for (task, _, _), n in totals.items())
    hits = drawn.groupBy("task", "run", "b").agg((F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)) / F.sum("n")).alias("p"))
    spread = hits.where("task = 'y' and run = 'b'").agg(F.var_pop("p"), F.avg("p")).first()
    p = 80 / 400
    true = sum(1 for i in range(400) if i % 5 == (i * 4) % 5) / 400
    assert abs(spread[1] - true) < 4 * math.sqrt(true * (1 - true) / 400 / 60) and 0.5 < spread[0] / (p * (1 - p) / 400) < 1.8


def test_mean_of_deltas_is_rounded_like_each(table):
    deltas = table("b int, task string, delta double", (0, "a", 0.1), (0, "b", 0.2), (0, "c", -0.3))
    assert deltas.agg(F.round(F.avg("delta"), 12) + 0.0).first()[0] == 0.0


def test_files_with_other_headers_fail(spark, tmp_path):
    (tmp_path / "1.csv").write_text("q,x,y\none,a,b\n")
    (tmp_path / "2.csv").write_text("q,y,x\ntwo,b,a\n")
    with pytest.raises(Exception, match="header"):
        read_questions(spark, str(tmp_path), "q", ["x", "y"]).collect()


def test_splits_written_as_csv_are_read(table, spark, tmp_path):
    frame = table("row_idx long, text string, a_encoded int, split string", (1, 'x "q"\ny', 3, "train"), (2, "z", 4, "val"))
    write_splits(frame, f"{tmp_path}/s", "csv")
    assert [tuple(r) for r in read_split(spark, f"{tmp_path}/s", "train", ["a"], fmt="csv").collect()] == [(1, 'x "q"\ny', 3)]


def test_predictions_written_twice_are_there_once(table, spark, tmp_path):
    first = predictions(table, ("a", "x", 1, 0, 0), ("a", "x", 2, 0, 1), ("b", "x", 1, 0, 0))
    for frame in (first, first.where("run = 'a'")):
        write_predictions(frame, f"{tmp_path}/p")
    assert read_predictions(spark, f"{tmp_path}/p").count() == 3
    with pytest.raises(ValueError, match="confidence"):
        write_predictions(first.drop("confidence"), f"{tmp_path}/p")
