from tallyframe.sources.aligned import append_aligned, read_aligned, store_aligned
from tallyframe.sources.encoders import read_encoder, write_encoder
from tallyframe.sources.questions import read_questions, read_split, write_splits
from tallyframe.sources.runs import (
    missing_tasks,
    read_history,
    read_predictions,
    read_runs,
    write_predictions,
    write_run_metrics,
    write_table,
)

__all__ = [
    "append_aligned",
    "read_aligned",
    "store_aligned",
    "missing_tasks",
    "read_encoder",
    "read_history",
    "read_predictions",
    "read_questions",
    "read_runs",
    "read_split",
    "write_encoder",
    "write_predictions",
    "write_run_metrics",
    "write_splits",
    "write_table",
]
