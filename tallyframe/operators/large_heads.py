"""Predictions of heads with more classes than a task can hold.

The heads are written as blocks of classes, packed task after task, and the rows are scored against one block at a time.  Of a block a row keeps its
largest logit, the first class that has it, and the sum of exponentials beside it; these merge into the prediction over all
classes (the running form of log-sum-exp), so no row ever has all its logits.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.storage import fresh_path, settle

#: Parameters of a block (64 MB of doubles): what the driver and each task hold of the heads.
BLOCK_PARAMETERS = 1 << 23
#: Logits worked out at once.
SLICE_LOGITS = 1 << 22

_PART = "row bigint, task int, top double, class_id int, total double, own double"


def _blocks(heads: DataFrame, block_parameters: int) -> tuple[DataFrame, list[str], int, int]:
    """Heads with their block, the tasks in order, the number of blocks and the vector length."""
    heads = settle(heads.select("task", "class_id", "weight", "bias"), "heads")
    facts = heads.groupBy("task").agg(
        F.count("*").alias("n"), F.min("class_id").alias("first"), F.max("class_id").alias("last"), F.countDistinct("class_id").alias("ids"),
        F.min(F.size("weight")).alias("least"), F.max(F.size("weight")).alias("width"),
    ).orderBy("task").collect()
    for f in facts:
        if f["first"] != 0 or f["last"] != f["n"] - 1 or f["ids"] != f["n"]:
            raise ValueError(f"class ids of {f['task']} are not 0..{f['n'] - 1}")
        if (f["least"], f["width"]) != (facts[0]["width"],) * 2:
            raise ValueError("the heads have vectors of different lengths")
    tasks = [f["task"] for f in facts]
    width = facts[0]["width"] if facts else 0
    rows = max(1, block_parameters // (width + 1))
    starts = [sum(f["n"] for f in facts[:i]) for i in range(len(facts) + 1)]
    start = heads.sparkSession.createDataFrame(list(zip(tasks, range(len(tasks)), starts)), "task string, task_no int, start bigint")
    placed = heads.join(start, "task").withColumn("block", F.floor((F.col("start") + F.col("class_id")) / rows).cast("int"))
    path = fresh_path(heads.sparkSession, "head-blocks")
    placed.select("task_no", "class_id", "weight", "bias", "block").repartition("block").write.partitionBy("block").parquet(path)
    return heads.sparkSession.read.schema("task_no int, class_id int, weight array<double>, bias double, block int").parquet(path), tasks, -(-starts[-1] // rows), width


def _scored(block: DataFrame, rows: DataFrame, truths: int):
    """What rows keep of one block of heads; the second result is to be destroyed when that is written."""
    table = block.orderBy("task_no", "class_id").toArrow()
    task, ids, bias = (table[c].to_numpy() for c in ("task_no", "class_id", "bias"))
    weight = np.asarray(table["weight"].combine_chunks().flatten(), dtype="float64").reshape(len(ids), -1)
    cuts = [0, *(np.flatnonzero(np.diff(task)) + 1).tolist(), len(task)]
    parts = [(int(task[a]), slice(a, b)) for a, b in zip(cuts, cuts[1:])]
    shared = rows.sparkSession.sparkContext.broadcast((weight, bias, ids, parts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, bias, ids, parts = shared.value
        for whole in batches:
            size = max(1, SLICE_LOGITS // len(bias))
            for batch in (whole.slice(i, size) for i in range(0, whole.num_rows, size)):
                vectors = batch.column("vec")
                if (np.diff(vectors.offsets.to_numpy()) != weight.shape[1]).any():
                    raise ValueError(f"a vector has not {weight.shape[1]} components")
                logits = np.asarray(vectors.flatten(), dtype="float64").reshape(-1, weight.shape[1]) @ weight.T + bias
                every = np.arange(len(logits))
                for t, part in parts:
                    z = logits[:, part]
                    best = z.argmax(axis=1)
                    top = z[every, best]
                    own = np.full(len(z), np.nan)
                    if truths:
                        truth = batch.column(f"y{t}").fill_null(-1).to_numpy() - ids[part][0]
                        here = np.flatnonzero((truth >= 0) & (truth < z.shape[1]))
                        own[here] = z[here, truth[here]]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("row"), pa.array(np.full(len(z), t, dtype=np.int32)), pa.array(top), pa.array(ids[part][best]),
                         pa.array(np.exp(z - top[:, None]).sum(axis=1)), pa.array(own, mask=np.isnan(own))],
                        names=["row", "task", "top", "class_id", "total", "own"],
                    )

    return rows.mapInArrow(run, _PART), shared


def predict_blocks(
    df: DataFrame, vec_col: str, heads: DataFrame, keep: Sequence[str] = ("row_idx",), truth: dict[str, str] | None = None,
    block_parameters: int | None = None,
) -> DataFrame:
    """(keep, task, y_pred, confidence, log_sum, ce): the prediction of every head for every row with a vector.

    The same as :func:`~tallyframe.operators.scoring.predict` of all logits, for any number of classes: memory is bounded by
    ``block_parameters``, and the rows are read once per block.  ``truth`` maps tasks to columns of true classes, for which ``ce`` is the
    cross entropy (null where the class is null or unknown).  Ties go to the first class.
    """
    blocks, tasks, count, width = _blocks(heads, block_parameters or BLOCK_PARAMETERS)
    truth = truth or {}
    rows = settle(
        df.where(F.col(vec_col).isNotNull()).select(
            *keep, F.monotonically_increasing_id().alias("_row"), F.col(vec_col).cast("array<double>").alias("_vec"),
            *((F.col(truth[t]).cast("int") if t in truth else F.lit(None).cast("int")).alias(f"_y{k}") for k, t in enumerate(tasks)),
        ),
        "rows",
    )
    asked = rows.select(F.col("_row").alias("row"), F.col("_vec").alias("vec"), *(F.col(f"_y{k}").alias(f"y{k}") for k in range(len(tasks))))
    path = fresh_path(df.sparkSession, "block-scores")
    for block in range(count):
        part, shared = _scored(blocks.where(F.col("block") == block), asked, len(truth))
        part.write.parquet(f"{path}/block={block}")
        shared.destroy()
    if not count:
        rows.limit(0).select(F.col("_row").alias("row")).selectExpr("row", "0 task", "0d top", "0 class_id", "0d total", "0d own").write.parquet(path)
    # A row has one entry for each block that holds classes of the task.
    merged = df.sparkSession.read.schema(_PART).parquet(path).groupBy("row", "task").agg(
        F.collect_list(F.struct("class_id", "top", "total")).alias("parts"), F.max("own").alias("own"), F.max("top").alias("most")
    )
    most = F.col("most")
    first = F.array_min(F.transform(F.filter("parts", lambda p: p["top"] == most), lambda p: p["class_id"]))
    total = F.aggregate("parts", F.lit(0.0), lambda acc, p: acc + p["total"] * F.exp(p["top"] - most))
    done = merged.select(
        F.col("row").alias("_row"), F.element_at(F.array(*map(F.lit, tasks or [""])), F.col("task") + 1).alias("task"),
        first.alias("y_pred"), (1.0 / total).alias("confidence"), (most + F.log(total)).alias("log_sum"), (most + F.log(total) - F.col("own")).alias("ce"),
    )
    return rows.select(*keep, "_row").join(done, "_row").drop("_row")
