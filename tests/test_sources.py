import json

import pytest
from pyspark.sql import functions as F

from tallyframe import storage
from tallyframe.operators.association import association_matrix, cramers_v
from tallyframe.operators.cells import confusion_cells
from tallyframe.operators.labels import fit_encoder
from tallyframe.operators.metrics import task_metrics
from tallyframe.plans import analyse_errors, compare_runs, evaluate_scores, prepare
from tallyframe.operators.scoring import HEADS_SCHEMA
from tallyframe.sources import (
    missing_tasks,
    read_encoder,
    read_history,
    read_predictions,
    read_questions,
    read_runs,
    read_split,
    write_encoder,
    write_predictions,
    write_run_metrics,
    write_table,
)
from tallyframe.sources.runs import history_long


def test_csv_with_bom_quotes_and_line_breaks(spark, tmp_path):
    path = tmp_path / "q.csv"
    path.write_bytes(
        '﻿QuestionText,Intent,List,Other\n'
        '"first\nline two, ""quoted""",Why ,TRUE,x\n'
        'second,NA,FALSE,y\n'
        ',None,nan,z\n'.encode("utf-8")
    )
    rows = read_questions(spark, str(path), "QuestionText", ["Intent", "List"]).collect()
    assert [tuple(r) for r in rows] == [
        ('first\nline two, "quoted"', "Why ", "TRUE"), ("second", None, "FALSE"), (None, None, None)]
    with pytest.raises(ValueError, match="Missing"):
        read_questions(spark, str(path), "QuestionText", ["Missing"])


def test_encoder_json_round_trip_keeps_non_ascii(spark, table, tmp_path):
    long = table("task string, label string", ("t", "نعم"), ("t", "a\"b"), ("u", "x"))
    encoder = fit_encoder(long)
    write_encoder(encoder, str(tmp_path / "e"))
    text = "".join(p.read_text() for p in (tmp_path / "e").glob("part-*"))
    assert json.loads(text) == {"t": {"classes": ["a\"b", "نعم"], "num_classes": 2},
                                "u": {"classes": ["x"], "num_classes": 1}}
    assert read_encoder(spark, str(tmp_path / "e")).exceptAll(encoder).count() == 0


PREDICTIONS = "prefix string, run string, seed int, split string, row_idx bigint, task string, y_true int, y_pred int, confidence double"


def predictions(table):
    rows = [(p, f"{p}_seed{s}", s, split, i, t, i % 2, (i + (i % 5 == 0)) % 2, 0.5)
            for p in ("m", "m_1") for s in (1, 2) for split in ("val", "test") for t in ("a", "b") for i in range(10)]
    return table(PREDICTIONS, *rows)


def test_prediction_scan_is_pruned(spark, table, tmp_path):
    path = str(tmp_path / "p")
    write_predictions(predictions(table), path)
    found = read_predictions(spark, path, "m", "test", ["a"])
    assert found.count() == 20
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(prefix" in plan and "PushedFilters: [In(task, [a])" in plan or "EqualTo(task,a)" in plan
    assert {r.task for r in missing_tasks(found, ["a", "z"]).collect()} == {"z"}


def test_run_metrics_round_trip_and_exact_prefix(spark, table, tmp_path):
    by = ["run", "split", "task"]
    metrics = task_metrics(confusion_cells(predictions(table), by), by)
    write_run_metrics(metrics, str(tmp_path / "r"))
    line = next((tmp_path / "r").rglob("run=m_seed1/split=test/part-*")).read_text()
    stored = json.loads(line)
    assert set(stored) == {"a", "b", "mean_macro_f1", "split"}
    assert stored["mean_macro_f1"] == pytest.approx((stored["a"]["macro_f1"] + stored["b"]["macro_f1"]) / 2)
    back = read_runs(spark, str(tmp_path / "r"), "test", "m")
    assert {(r.run, r.seed) for r in back.collect()} == {("m_seed1", 1), ("m_seed2", 2)}
    both = back.select(*by, "macro_f1", "per_class_f1")
    wanted = metrics.where("split = 'test' AND run LIKE 'm_seed%'").select(*by, "macro_f1", "per_class_f1")
    assert both.exceptAll(wanted).count() == 0 and both.count() == 4


def test_flat_run_files_of_both_layouts(spark, tmp_path):
    (tmp_path / "exp_seed42_test_results.json").write_text(json.dumps(
        {"Intent": {"macro_f1": 0.9, "accuracy": 0.95, "per_class_f1": [1.0, 0.8]}, "mean_macro_f1": 0.9}, indent=2))
    (tmp_path / "exp_seed42_val_results.json").write_text(json.dumps({"Intent": {"macro_f1": 0.1}}))
    (tmp_path / "exp_10_seed7_test_results.json").write_text(json.dumps(
        {"Intent": {"accuracy": 0.5, "macro_f1": 0.4, "weighted_f1": 0.45}, "mean_macro_f1": 0.4,
         "split": "test", "checkpoint": "c.pt"}))
    rows = {r.run: r for r in read_runs(spark, str(tmp_path), "test").collect()}
    assert set(rows) == {"exp_seed42", "exp_10_seed7"}
    assert rows["exp_seed42"].per_class_f1 == [1.0, 0.8] and rows["exp_seed42"].weighted_f1 is None
    assert rows["exp_10_seed7"].weighted_f1 == 0.45 and rows["exp_10_seed7"].seed == 7
    assert [r.run for r in read_runs(spark, str(tmp_path), "test", "exp").collect()] == ["exp_seed42"]


def test_histories(spark, tmp_path):
    (tmp_path / "a_seed1_history.csv").write_text(
        "epoch,train_loss,val_mean_f1,x_f1,y_f1\n1,2.5,0.5,0.4,0.6\n2,1.5,0.6,0.5,0.7\n")
    history = read_history(spark, str(tmp_path / "*_history.csv"), ["x", "y"])
    assert {(r.run, r.epoch, r.val_mean_f1) for r in history.collect()} == {("a_seed1", 1, 0.5), ("a_seed1", 2, 0.6)}
    assert {(r.epoch, r.task, r.f1) for r in history_long(history, ["x", "y"]).collect()} == {
        (1, "x", 0.4), (1, "y", 0.6), (2, "x", 0.5), (2, "y", 0.7)}


def test_scratch_folder_is_the_one_the_session_names(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    folder = storage.scratch_dir(spark)
    assert folder == named.rstrip("/") if named else "tallyframe-" in folder
    assert storage.fresh_path(spark, "x") != storage.fresh_path(spark, "x")
    assert storage.settle(spark.range(3), "three").count() == 3


def test_cramers_v_against_chi_square(spark, table):
    counts = {("p", "x"): 20, ("p", "y"): 5, ("q", "x"): 3, ("q", "y"): 12, ("r", "x"): 7}
    rows = [(a, b, "k", a) for (a, b), n in counts.items() for _ in range(n)] + [("p", None, "k", "p")]
    pairs = cramers_v(table("a string, b string, c string, d string", *rows), ["a", "b", "c", "d"])
    got = {(r.task_a, r.task_b): (r.v, r.n) for r in pairs.collect()}
    n = sum(counts.values())
    rows_, cols = {}, {}
    for (a, b), o in counts.items():
        rows_[a] = rows_.get(a, 0) + o
        cols[b] = cols.get(b, 0) + o
    chi2 = sum((counts.get((a, b), 0) - r * c / n) ** 2 / (r * c / n) for a, r in rows_.items() for b, c in cols.items())
    assert got["a", "b"][0] == pytest.approx((chi2 / n) ** 0.5) and got["a", "b"][1] == n
    assert got["b", "a"] == got["a", "b"] and got["a", "a"] == (1.0, n + 1)
    assert got["a", "d"][0] == pytest.approx(1.0) and got["a", "c"][0] == 0.0
    wide = {r.task: r for r in association_matrix(pairs, ["a", "b", "c", "d"]).collect()}
    assert wide["b"]["a"] == got["a", "b"][0] and wide["d"]["d"] == 1.0


def test_prepare_writes_everything(spark, table, tmp_path):
    raw = table("id int, text string, Intent string, List string",
                *((i, f"q{i}", f" c{i % 3}", "TRUE" if i % 2 else "false") for i in range(60)),
                (60, None, "c1", "TRUE"), (61, "q", "c1", "maybe"))
    out = prepare(raw, "id", "text", ["Intent", "List"], "Intent", str(tmp_path / "o"),
                  {"List": {"TRUE": "List", "FALSE": "Single"}})
    info = out["split_info"].first()
    assert (info.total, info.train, info.val, info.test) == (60, 48, 6, 6)
    train = read_split(spark, str(tmp_path / "o/splits"), "train", ["List"], key="id")
    assert train.columns == ["id", "text", "List_encoded"] and train.count() == 48
    assert {r.task for r in out["imbalance"].collect()} == {"Intent", "List"}
    assert read_encoder(spark, str(tmp_path / "o/encoder")).count() == 5
    write_table(out["imbalance"], str(tmp_path / "csv"))
    assert list((tmp_path / "csv").glob("*.csv"))


def test_score_evaluate_compare_and_analyse(spark, table):
    heads = spark.createDataFrame([("a", 0, [1.0, 0.0], 0.0), ("a", 1, [0.0, 1.0], 0.0)], HEADS_SCHEMA)
    vectors = table("row_idx bigint, v array<double>", *((i, [float(i % 2), 0.5]) for i in range(20)))
    truth = vectors.select("row_idx", F.lit("a").alias("task"), (F.col("row_idx") % 4 == 0).cast("int").alias("y_true"))
    out = evaluate_scores(vectors, "v", heads, truth)
    assert out["metrics"].first().accuracy == 0.75
    found = compare_runs(predictions(table).where("split = 'test'"), ["a", "b"], ["m_seed1", "m_seed2"],
                         ["m_1_seed1"], 20)
    assert found["paired"].count() == 3 and found["summary"].count() == 6 and found["intervals"].count() == 2
    encoder = table("task string, class_id int, class_name string", ("a", 0, "no"), ("a", 1, "yes"),
                    ("b", 0, "n"), ("b", 1, "y"))
    texts = spark.range(10).select(F.col("id").alias("row_idx"), F.concat(F.lit("t"), "id").alias("text"))
    parts = analyse_errors(predictions(table).where("split = 'test'"), encoder, texts, k=1)
    assert parts["matrix"].count() == 4 * 2 * 4
    assert {(r.text, r.true_label) for r in parts["errors"].where("task = 'a'").collect()} == {("t0", "no")}
    assert parts["report"].where("label = 'macro avg'").count() == 8


def test_a_large_run_is_written_by_many_tasks(spark, tmp_path):
    """One run's rows are split by their size, small runs have one file."""
    big = spark.range(200_000).select(F.lit("big").alias("run"), F.col("id").alias("row_idx"), F.rand(1).alias("confidence"))
    small = spark.range(10).select(F.lit("small").alias("run"), F.col("id").alias("row_idx"), F.rand(1).alias("confidence"))
    table = big.unionByName(small).select(
        F.lit("p").alias("prefix"), "run", F.lit(1).alias("seed"), F.lit("test").alias("split"), "row_idx", F.lit("t").alias("task"),
        F.lit(0).alias("y_true"), F.lit(0).alias("y_pred"), "confidence",
    )
    advised = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "512k")
    try:
        write_predictions(table, str(tmp_path))
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", advised)
    files = {r: len(list(tmp_path.glob(f"**/run={r}/**/*.parquet"))) for r in ("big", "small")}
    assert files["big"] >= 3 and files["small"] == 1
    assert read_predictions(spark, str(tmp_path)).count() == 200_010
