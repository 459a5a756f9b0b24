"""Joint training of all heads on a fixed vector: focal loss, learned task weights, two dropped-out passes.

Every step is one Spark job over the rows of its batch.  Tasks turn Arrow batches into partial gradients and hand on one sum per task and class;
the sums meet by class and are added in the order of their partitions.  Only gradients of model size reach the driver, which holds the
parameters and the optimiser's state and sends the parameters out again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.operators.scoring import _MAX_PARAMETERS, HEADS_SCHEMA
from tallyframe.storage import fresh_path, settle


@dataclass
class Objective:
    """What is minimised: ``sum_t exp(-s_t) L_t + s_t / 2`` (the plain sum if not ``uncertainty``), plus ``alpha`` times the divergences of two passes.

    ``L_t`` is the mean focal term of the class-weighted, smoothed cross entropy, over both passes if ``alpha`` is not 0.
    """

    gamma: float = 5.0
    smoothing: float = 0.0
    alpha: float = 0.0
    dropout: float = 0.0
    uncertainty: bool = True


@dataclass
class Heads:
    """Parameters of all tasks: rows of ``weight`` are classes, task after task; the last column is the bias."""

    tasks: list[str]
    sizes: list[int]
    weight: np.ndarray
    log_vars: np.ndarray
    class_weights: list[np.ndarray] = field(default_factory=list)

    def slices(self) -> list[slice]:
        ends = np.cumsum(self.sizes)
        return [slice(int(e - k), int(e)) for e, k in zip(ends, self.sizes)]

    def table(self, spark) -> DataFrame:
        rows = [
            (t, c, w[:-1].tolist(), float(w[-1])) for t, part in zip(self.tasks, self.slices()) for c, w in enumerate(self.weight[part])
        ]
        return settle(spark.createDataFrame(rows, HEADS_SCHEMA), "heads")


def _scatter(values: np.ndarray) -> np.ndarray:
    """64-bit values mixed so that each bit depends on all."""
    with np.errstate(over="ignore"):
        values = (values ^ (values >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        values = (values ^ (values >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return values ^ (values >> np.uint64(32))


def dropped(vectors: np.ndarray, keys: np.ndarray, rate: float, turn: int) -> np.ndarray:
    """Vectors with a share ``rate`` of their positions at zero, the rest scaled up; which ones depends on the row's key and the turn only."""
    if not rate:
        return vectors
    with np.errstate(over="ignore"):
        rows = _scatter(keys.astype(np.int64).view(np.uint64) + np.uint64(turn) * np.uint64(0x9E3779B97F4A7C15))
        bits = _scatter(rows[:, None] + np.arange(1, vectors.shape[1] + 1, dtype=np.uint64))
    stays = (bits >> np.uint64(11)) * 2.0**-53 >= rate
    return vectors * stays / (1.0 - rate)


def _log_softmax(z: np.ndarray) -> np.ndarray:
    shifted = z - z.max(axis=1, keepdims=True)
    return shifted - np.log(np.exp(shifted).sum(axis=1, keepdims=True))


def focal_gradient(z: np.ndarray, truth: np.ndarray, weights: np.ndarray, gamma: float, smoothing: float) -> tuple[np.ndarray, np.ndarray]:
    """Focal term of each row and its derivative by the logits."""
    log_p = _log_softmax(z)
    share = np.repeat(smoothing / z.shape[1] * weights[None, :], len(z), axis=0)
    share[np.arange(len(z)), truth] += (1.0 - smoothing) * weights[truth]
    ce = -(share * log_p).sum(axis=1)
    sure = np.exp(-ce)
    missed = -np.expm1(-ce)
    by_ce = missed**gamma + (gamma * missed ** (gamma - 1) * sure * ce if gamma else 0.0)
    return missed**gamma * ce, by_ce[:, None] * (share.sum(axis=1, keepdims=True) * np.exp(log_p) - share)


def divergence_gradient(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symmetric divergence of two passes per row and its derivatives by the logits of either."""
    log_p, log_q = _log_softmax(a), _log_softmax(b)
    p, q, apart = np.exp(log_p), np.exp(log_q), log_p - log_q
    forth, back = (p * apart).sum(axis=1), -(q * apart).sum(axis=1)
    by_a = (p * (apart - forth[:, None]) + p - q) / 2
    by_b = (q * (-apart - back[:, None]) + q - p) / 2
    return (forth + back) / 2, by_a, by_b


def batch_gradient(heads: Heads, goal: Objective, vectors: np.ndarray, truths: list[np.ndarray], keys: np.ndarray, turn: int) -> tuple[np.ndarray, np.ndarray]:
    """Summed gradients (like ``weight``) and, per task, sums of focal terms and divergences and the rows judged (truth not below 0)."""
    passes = [dropped(vectors, keys, goal.dropout, 2 * turn + k) for k in range(2 if goal.alpha else 1)]
    passes = [np.hstack([v, np.ones((len(v), 1))]) for v in passes]
    grads, sums = np.zeros_like(heads.weight), np.zeros((len(heads.tasks), 3))
    for t, (part, truth) in enumerate(zip(heads.slices(), truths)):
        judged = truth >= 0
        truth = truth[judged]
        inputs = [v[judged] for v in passes]
        logits = [v @ heads.weight[part].T for v in inputs]
        scale = np.exp(-heads.log_vars[t]) if goal.uncertainty else 1.0
        found = [focal_gradient(z, truth, heads.class_weights[t], goal.gamma, goal.smoothing) for z in logits]
        by_logits = [scale / len(passes) * d for _, d in found]
        if goal.alpha:
            apart, *by_apart = divergence_gradient(*logits)
            by_logits = [d + goal.alpha * e for d, e in zip(by_logits, by_apart)]
            sums[t, 1] = apart.sum()
        for d, v in zip(by_logits, inputs):
            grads[part] += d.T @ v
        sums[t, 0] = sum(f.sum() for f, _ in found) / len(passes)
        sums[t, 2] = judged.sum()
    return grads, sums


_SUMS = "row int, part bigint, total array<double>"


def gradient_sums(rows: DataFrame, heads: Heads, goal: Objective, turn: int) -> DataFrame:
    """(row, total): the gradient of every row of ``weight``, then from its length on one row of sums per task.  ``rows`` has key, vec and a truth per task."""
    context = rows.sparkSession.sparkContext
    shared, count = context.broadcast(heads), len(heads.weight)
    names = [f"y{t}" for t in range(len(heads.tasks))]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, grads, sums, part = shared.value, 0.0, 0.0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = batch.column("vec")
            flat = np.asarray(vectors.flatten(), dtype="float64")
            width = own.weight.shape[1] - 1
            if (np.diff(vectors.offsets.to_numpy()) != width).any():
                raise ValueError(f"a vector has not {width} components")
            truths = [batch.column(n).fill_null(-1).to_numpy() for n in names]
            g, s = batch_gradient(own, goal, flat.reshape(-1, width), truths, batch.column("key").to_numpy(), turn)
            grads, sums = grads + g, sums + s
            part = batch.column("part")[0].as_py() if part is None else part
        if part is not None:
            totals = [*grads.tolist(), *sums.tolist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(totals)), pa.int32()), pa.array([part] * len(totals), pa.int64()), pa.array(totals, pa.list_(pa.float64()))],
                names=["row", "part", "total"],
            )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, None

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([total.tolist()], pa.list_(pa.float64()))], names=["row", "total"])

        for batch in batches:
            for row, values in zip(batch.column("row").to_pylist(), batch.column("total")):
                values = np.asarray(values.values)
                if row != at:
                    if at is not None:
                        yield closed()
                    at, total = row, np.zeros(len(values))
                total = total + values
        if at is not None:
            yield closed()

    numbered = rows.select("key", "vec", *names, F.spark_partition_id().cast("bigint").alias("part"))
    partials = numbered.mapInArrow(partial, _SUMS)
    # The parts of a class are as many as tasks, whatever the rows: a hot class costs nothing extra.
    met = partials.repartition(min(count + len(names), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "row")
    return met.sortWithinPartitions("row", "part").mapInArrow(add, "row int, total array<double>")


def gradient(rows: DataFrame, heads: Heads, goal: Objective, turn: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Mean gradient by heads and by log variances, and (focal loss, divergence) per task and the objective."""
    grads, sums = np.zeros_like(heads.weight), np.zeros((len(heads.tasks), 3))
    for row, total in zip(*(c.to_pylist() for c in gradient_sums(rows, heads, goal, turn).toArrow().columns)):
        if row < len(grads):
            grads[row] = total
        else:
            sums[row - len(grads)] = total
    n = np.maximum(sums[:, 2], 1)
    for t, part in enumerate(heads.slices()):
        grads[part] /= n[t]
    losses = sums[:, :2] / n[:, None]
    value = goal.alpha * losses[:, 1].sum()
    if goal.uncertainty:
        by_vars = np.where(sums[:, 2] > 0, 0.5 - np.exp(-heads.log_vars) * losses[:, 0], 0.0)
        return grads, by_vars, losses, float(value + (np.exp(-heads.log_vars) * losses[:, 0] + heads.log_vars / 2).sum())
    return grads, np.zeros(len(heads.tasks)), losses, float(value + losses[:, 0].sum())


class _Steps:
    """Adam with decoupled decay of the parameters and a rate that rises over a tenth of the steps and then falls to zero."""

    def __init__(self, rate: float, decay: float, steps: int):
        self.rate, self.decay, self.steps, self.turn, self.state = rate, decay, steps, 0, {}

    def step(self, parameters: dict[str, np.ndarray], grads: dict[str, np.ndarray]) -> None:
        rise = int(0.1 * self.steps)
        share = self.turn / max(1, rise) if self.turn < rise else max(0.0, (self.steps - self.turn) / max(1, self.steps - rise))
        self.turn += 1
        for name, value in parameters.items():
            first, second = self.state.get(name, (0.0, 0.0))
            first, second = 0.9 * first + 0.1 * grads[name], 0.999 * second + 0.001 * grads[name] ** 2
            self.state[name] = first, second
            move = first / (1 - 0.9**self.turn) / (np.sqrt(second / (1 - 0.999**self.turn)) + 1e-8)
            value -= self.rate * share * (move + self.decay * value)


@dataclass
class Trained:
    """``heads`` (task, class_id, weight, bias), ``log_vars`` (task, log_var), ``history`` (step, task, loss, divergence, total_loss)."""

    heads: DataFrame
    log_vars: DataFrame
    history: DataFrame


def prepare_rows(df: DataFrame, key: str, vec_col: str, labels: dict[str, str], batches: int = 1, seed: int = 42) -> DataFrame:
    """Rows as the trainer reads them, written by batch; a row's batch and its dropped positions follow from its key and the seed."""
    path = fresh_path(df.sparkSession, "training-rows")
    rows = df.where(F.col(vec_col).isNotNull()).select(
        F.xxhash64(F.col(key), F.lit(seed)).alias("key"), F.col(vec_col).cast("array<double>").alias("vec"),
        *(F.col(c).cast("int").alias(f"y{t}") for t, c in enumerate(labels.values())),
        F.pmod(F.xxhash64(F.col(key), F.lit(seed), F.lit("batch")), F.lit(batches)).cast("int").alias("batch"),
    )
    rows.write.partitionBy("batch").parquet(path)
    return df.sparkSession.read.schema(rows.schema).parquet(path)


def zero_heads(rows: DataFrame, labels: dict[str, str], class_weights: DataFrame | None = None) -> Heads:
    """Heads of zeros for all classes met in prepared rows, with the weights given as one list per task."""
    columns = [f"y{t}" for t in range(len(labels))]
    facts = rows.agg(F.max(F.size("vec")).alias("width"), *(F.max(c).alias(c) for c in columns), F.least(F.lit(0), *(F.min(c) for c in columns)).alias("least")).first()
    sizes = [None if facts[c] is None else facts[c] + 1 for c in columns]
    if None in sizes or facts["least"] < 0:
        raise ValueError("every task needs labelled rows, and class ids from 0 on")
    if sum(sizes) * (facts["width"] + 1) > _MAX_PARAMETERS:
        raise ValueError("the heads are too large to be trained by one driver")
    given = {} if class_weights is None else {r["task"]: r["weights"] for r in class_weights.collect()}
    weights = [np.array(given.get(t, [1.0] * k), dtype="float64") for t, k in zip(labels, sizes)]
    if any(len(w) < k for w, k in zip(weights, sizes)):
        raise ValueError("a class has no weight")
    return Heads(list(labels), [len(w) for w in weights], np.zeros((sum(map(len, weights)), facts["width"] + 1)), np.zeros(len(sizes)), weights)


def started(heads: Heads, table: DataFrame) -> Heads:
    """``heads`` with the values of a table of heads, which must have the same tasks, classes and vector length."""
    at = {(r["task"], r["class_id"]): [*r["weight"], r["bias"]] for r in table.collect()}
    rows = [(t, c) for t, k in zip(heads.tasks, heads.sizes) for c in range(k)]
    if sorted(at) != sorted(rows) or any(len(w) != heads.weight.shape[1] for w in at.values()):
        raise ValueError("the heads to start from are not those of the rows")
    heads.weight[:] = [at[r] for r in rows]
    return heads


def train_heads(
    df: DataFrame,
    key: str,
    vec_col: str,
    labels: dict[str, str],
    goal: Objective | None = None,
    class_weights: DataFrame | None = None,
    epochs: int = 40,
    batches: int = 1,
    rate: float = 0.1,
    decay: float = 0.01,
    clip: float = 1.0,
    seed: int = 42,
    start: DataFrame | None = None,
) -> Trained:
    """Train one linear head per task together; ``labels`` maps a task to its class-id column.

    An epoch has one step per batch, each a job that reads its batch only.  Gradients longer than ``clip`` are shortened to
    it.  Training begins at zero, or at the heads ``start``.  A row without vector is left out, one without a task's label counts for the others.  Partitioning
    changes nothing but the last digits of float sums.
    """
    goal, spark = goal or Objective(), df.sparkSession
    rows = prepare_rows(df, key, vec_col, labels, batches, seed)
    heads = zero_heads(rows, labels, class_weights)
    if start is not None:
        heads = started(heads, start)
    optimiser, history = _Steps(rate, decay, epochs * batches), []
    for step in range(epochs * batches):
        grads, by_vars, losses, total = gradient(rows.where(F.col("batch") == step % batches), heads, goal, step)
        norm = np.sqrt((grads**2).sum())
        grads *= min(1.0, clip / (norm + 1e-6))
        history += [(step, t, float(loss), float(apart), total) for t, (loss, apart) in zip(heads.tasks, losses)]
        parameters = {"weight": heads.weight} | ({"log_vars": heads.log_vars} if goal.uncertainty else {})
        optimiser.step(parameters, {"weight": grads, "log_vars": by_vars})
    return Trained(
        heads.table(spark),
        spark.createDataFrame(list(zip(heads.tasks, heads.log_vars.tolist())), "task string, log_var double"),
        spark.createDataFrame(history, "step int, task string, loss double, divergence double, total_loss double"),
    )
