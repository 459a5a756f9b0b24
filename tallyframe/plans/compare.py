"""Multi-run comparison: seed aggregates, intervals and paired tests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from tallyframe.operators.cells import confusion_cells
from tallyframe.operators.metrics import task_metrics
from tallyframe.operators.resample import bootstrap_ci, compare_paired, paired_deltas
from tallyframe.operators.runs import aggregate_seeds
from tallyframe.sources.aligned import align_once
from tallyframe.storage import settle


def compare_runs(
    predictions: DataFrame,
    tasks: Sequence[str],
    candidates: Sequence[str],
    baselines: Sequence[str] = (),
    replicates: int = 1000,
    seed: int = 0,
    method: str = "cells",
    align: bool = True,
) -> dict[str, DataFrame]:
    """All tables of a comparison.

    The predictions are dealt into buckets of examples once; metrics, intervals and pairs read these without another exchange of
    rows.  ``align=False`` is for predictions that are stored so already.
    """
    if align:
        predictions = align_once(predictions)
    by = ["prefix", "run", "task"]
    metrics = settle(task_metrics(confusion_cells(predictions, by), by), "metrics")
    summary = aggregate_seeds(metrics)
    out = {
        "metrics": metrics,
        "summary": summary,
        "intervals": bootstrap_ci(predictions, tasks, candidates, replicates, seed=seed, method=method),
    }
    if baselines:
        deltas = settle(
            paired_deltas(
                predictions, tasks, candidates, baselines, replicates, seed, method, across_tasks=True
            ),
            "deltas",
        )
        out["paired"] = compare_paired(deltas)
    return out
