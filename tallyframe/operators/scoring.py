"""From a shared vector to logits, probabilities, predictions and losses."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.storagelevel import StorageLevel

from tallyframe.functions import (
    argmax,
    confidence,
    cross_entropy,
    focal_term,
    log_softmax,
    softmax,
    symmetric_kl_term,
)
from tallyframe.storage import lookup_join, settle

HEADS_SCHEMA = T.StructType(
    [
        T.StructField("task", T.StringType()),
        T.StructField("class_id", T.IntegerType()),
        T.StructField("weight", T.ArrayType(T.DoubleType())),
        T.StructField("bias", T.DoubleType()),
    ]
)

# Model parameters travel to every task; this is 1 GB of doubles.  Larger heads are scored by ``large_heads.predict_blocks``.
_MAX_PARAMETERS = 1 << 27
_SLICE_LOGITS = 1 << 22


def centroid_heads(df: DataFrame, vec_col: str, labels: dict[str, str]) -> DataFrame:
    """Nearest-centroid heads: ``w = c``, ``b = -|c|^2 / 2`` per task and class.

    ``labels`` maps a task to its class-id column.  Every task is averaged in the
    same pass; the aggregate has one row per task, class and vector position.
    """
    tasks = F.array(
        *(
            F.struct(F.lit(t).alias("task"), F.col(c).cast("int").alias("class_id"))
            for t, c in labels.items()
        )
    )
    long = df.select(F.explode(tasks).alias("t"), F.col(vec_col).alias("vec")).select(
        "t.*", F.posexplode("vec").alias("pos", "x")
    )
    means = long.groupBy("task", "class_id", "pos").agg(F.avg(F.col("x").cast("double")).alias("w"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "w")))
    heads = means.groupBy("task", "class_id").agg(
        F.transform(ordered, lambda s: s["w"]).alias("weight"),
        (-F.sum(F.col("w") * F.col("w")) / 2.0).alias("bias"),
    )
    return settle(heads, "heads")


def _matrices(heads: DataFrame):
    """Heads as dense arrays per task.  Model parameters, not data: the size is checked."""
    import numpy as np

    size = heads.agg(F.sum(F.size("weight"))).first()[0] or 0
    if size > _MAX_PARAMETERS:
        raise ValueError(f"heads hold {size} parameters; use large_heads.predict_blocks")
    per_task: dict[str, list] = {}
    for row in heads.orderBy("task", "class_id").collect():
        per_task.setdefault(row["task"], []).append(row)
    for task, rows in per_task.items():
        if [r["class_id"] for r in rows] != list(range(len(rows))):
            raise ValueError(f"class ids of {task} are not 0..{len(rows) - 1}")
    tasks = list(per_task)
    weight = np.array([r["weight"] for t in tasks for r in per_task[t]], dtype="float64")
    bias = np.array([r["bias"] for t in tasks for r in per_task[t]], dtype="float64")
    return tasks, [len(per_task[t]) for t in tasks], weight, bias


def score_heads(
    df: DataFrame, vec_col: str, heads: DataFrame, keep: Sequence[str] = ("row_idx",)
) -> DataFrame:
    """Logits of every head in one pass: one output row per (row, task).

    A narrow operator - no shuffle, one scan whatever the number of tasks.  The
    products of a batch are one matrix multiplication; written with array
    functions they are interpreted element by element, about ten times slower.
    A row with a null vector has no logits and is left out.
    """
    tasks, sizes, weight, bias = _matrices(heads)
    rows = df.where(F.col(vec_col).isNotNull()).select(
        *keep, F.col(vec_col).cast("array<double>").alias("_vec")
    )
    kept = rows.drop("_vec").schema
    out = T.StructType([*kept.fields, T.StructField("_logits", T.ArrayType(T.DoubleType()))])
    names = list(keep)

    def multiply(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        step = max(1, _SLICE_LOGITS // max(len(bias), 1))
        for batch in (b.slice(i, step) for b in batches for i in range(0, b.num_rows, step)):
            vectors = batch.column("_vec")
            flat = np.asarray(vectors.flatten(), dtype="float64")
            logits = flat.reshape(len(vectors), weight.shape[1]) @ weight.T + bias
            offsets = np.arange(0, logits.size + 1, len(bias), dtype="int32")
            column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(logits.ravel()))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), column], names=[*names, "_logits"]
            )

    flat = rows.mapInArrow(multiply, out)
    starts = [1 + sum(sizes[:i]) for i in range(len(sizes))]
    per_task = F.array(
        *(
            F.struct(F.lit(t).alias("task"), F.slice("_logits", s, k).alias("logits"))
            for t, s, k in zip(tasks, starts, sizes)
        )
    )
    return flat.select(*keep, F.explode(per_task).alias("t")).select(*keep, "t.*")


def predict(scored: DataFrame) -> DataFrame:
    """Add probabilities, predicted class and confidence."""
    return scored.withColumn("probabilities", softmax(F.col("logits"))).withColumns(
        {
            "y_pred": argmax(F.col("logits")),
            "confidence": confidence(F.col("probabilities")),
        }
    )


def weight_arrays(weights: DataFrame) -> DataFrame:
    """``(task, class_id, weight)`` to one weight list per task in class order."""
    ordered = F.array_sort(F.collect_list(F.struct("class_id", "weight")))
    return weights.groupBy("task").agg(F.transform(ordered, lambda s: s["weight"]).alias("weights"))


def row_losses(
    scored: DataFrame,
    gamma: float = 5.0,
    weights: DataFrame | None = None,
    smoothing: float = 0.0,
    target: str = "y_true",
) -> DataFrame:
    """Cross entropy and focal term of each row; ``weights`` is one list per task."""
    rows = scored.withColumn("_logp", log_softmax(F.col("logits")))
    weight = None
    if weights is not None:
        rows = lookup_join(rows, weights, ["task"], "left")
        weight = F.col("weights")
    rows = rows.withColumn("ce", cross_entropy(F.col("_logp"), F.col(target), weight, smoothing))
    rows = rows.withColumn("focal", focal_term(F.col("ce"), gamma)).drop("_logp")
    return rows if weights is None else rows.drop("weights")


def focal_loss(
    scored: DataFrame,
    gamma: float = 5.0,
    weights: DataFrame | None = None,
    smoothing: float = 0.0,
    target: str = "y_true",
) -> DataFrame:
    """Plain mean over rows of the focal term, one value per task."""
    rows = row_losses(scored, gamma, weights, smoothing, target)
    return rows.groupBy("task").agg(F.avg("focal").alias("loss"), F.count("focal").alias("n"))


def combine_losses(losses: DataFrame, log_vars: DataFrame | None = None) -> DataFrame:
    """Total of the task losses, weighted by uncertainty when ``log_vars`` is given.

    Weighted: ``sum(exp(-s)*L + s/2)`` over the tasks; a task without ``s`` has ``s = 0``.
    """
    if log_vars is None:
        return losses.agg(F.sum("loss").alias("total_loss"))
    s = F.coalesce(F.col("log_var"), F.lit(0.0))
    return lookup_join(losses, log_vars, ["task"], "left").agg(
        F.sum(F.exp(-s) * F.col("loss") + s / 2.0).alias("total_loss")
    )


def symmetric_kl(
    first: DataFrame, second: DataFrame, keys: Sequence[str] = ("row_idx", "task")
) -> DataFrame:
    """Mean symmetric divergence of two scorings of the same rows, per task."""
    both = first.select(*keys, F.col("logits").alias("_a")).join(
        second.select(*keys, F.col("logits").alias("_b")), list(keys)
    )
    term = symmetric_kl_term(log_softmax(F.col("_a")), log_softmax(F.col("_b")))
    return both.groupBy("task").agg(F.avg(term).alias("kl"), F.count("*").alias("n"))


def mean_losses(first: DataFrame, second: DataFrame) -> DataFrame:
    """Task losses ``(task, loss)`` of two passes over the same rows, averaged; combine them afterwards."""
    return first.select("task", "loss").unionByName(second.select("task", "loss")).groupBy("task").agg(F.avg("loss").alias("loss"))


def regularised_loss(combined: DataFrame, kl: DataFrame, alpha: float) -> DataFrame:
    """Combined loss plus ``alpha`` times the divergences summed over the tasks."""
    parts = combined.select("total_loss").unionByName(
        kl.agg((F.sum("kl") * alpha).alias("total_loss"))
    )
    return parts.agg(F.sum("total_loss").alias("total_loss"))


def fit_heads(
    df: DataFrame,
    vec_col: str,
    labels: dict[str, str],
    weights: dict[str, str] | None = None,
    max_iter: int = 50,
    reg_param: float = 0.01,
    class_weights: DataFrame | None = None,
) -> DataFrame:
    """Train one multinomial linear head per task on a fixed vector column.

    ``labels`` maps a task to its class-id column and ``weights`` a task to its
    row-weight column; ``class_weights`` has one list of weights per task in class
    order (:func:`weight_arrays`) for the tasks without such a column.  The rows are prepared once and kept for all tasks; the
    objective is cross entropy (Spark's trainer has no focal term).
    """
    weights = dict(weights or {})
    if class_weights is not None:
        lists = settle(class_weights, "class-weights")
        for task, column in labels.items():
            if task not in weights:
                weights[task] = f"_weight_{task}"
                known = lists.where(F.col("task") == task).select("weights").scalar()
                df = df.withColumn(weights[task], F.coalesce(F.get(known, F.col(column).cast("int")), F.lit(1.0)))
    extra = sorted(set(labels.values()) | set(weights.values()))
    rows = df.where(F.col(vec_col).isNotNull()).select(
        array_to_vector(F.col(vec_col).cast("array<double>")).alias("features"),
        *(F.col(c).cast("double").alias(c) for c in extra),
    )
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    spark = df.sparkSession
    heads = []
    try:
        for task, column in labels.items():
            trainer = LogisticRegression(
                featuresCol="features",
                labelCol=column,
                family="multinomial",
                maxIter=max_iter,
                regParam=reg_param,
                **({"weightCol": weights[task]} if task in weights else {}),
            )
            model = trainer.fit(rows.where(F.col(column).isNotNull()))
            matrix = model.coefficientMatrix.toArray()
            heads += [
                (task, c, [float(x) for x in matrix[c]], float(model.interceptVector[c]))
                for c in range(matrix.shape[0])
            ]
    finally:
        rows.unpersist()
    return settle(spark.createDataFrame(heads, HEADS_SCHEMA), "heads")
