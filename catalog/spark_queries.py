"""One registered query per operator; every query reads whole driver tables."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog import inputs as I
from tallyframe import sources
from tallyframe.functions import fixed_text, run_prefix, run_seed, softmax
from tallyframe.operators import association, cells, errors, labels, large_heads, metrics
from tallyframe.operators import percentiles as counted_percentiles
from tallyframe.operators import resample, runs, scoring, splits, training
from tallyframe.plans import analyse_errors, compare_runs, evaluate_scores, prepare
from tallyframe.sources import cell_store
from tallyframe.sources.runs import history_long
from tallyframe.storage import fresh_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

REPLICATES = 1000
HEAD_TASKS = {"ten": "label", "two": "two", "three": "three"}


def register(query: Query) -> Query:
    QUERIES[query.__name__] = query
    return query


def r9(column: Column | str) -> Column:
    """Nine decimals, and no negative zero."""
    return F.round(F.col(column) if isinstance(column, str) else column, 9) + F.lit(0.0)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: r9(c) for c in columns})


def tagged(**tables: DataFrame) -> DataFrame:
    """All tables in one, by name; a column that a table lacks is null in its rows."""
    parts = [table.withColumn("part", F.lit(part)) for part, table in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def order_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.with_predictions(I.order_truth(spark, sf_dir))


def order_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells.confusion_cells(order_predictions(spark, sf_dir))


def order_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = ["prefix", "run", "task"]
    return metrics.task_metrics(cells.confusion_cells(order_predictions(spark, sf_dir), by), by)


def order_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = I.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("row_idx"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("priority"),
    )
    return labels.unpivot_labels(orders, ["row_idx"], ["status", "priority"])


def document_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = I.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("row_idx"), "lang", "source"
    )
    judged = I.table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("row_idx"), "quality", "toxic"
    )
    return labels.unpivot_labels(documents, ["row_idx"], ["lang", "source"]).unionByName(
        labels.unpivot_labels(judged, ["row_idx"], ["quality", "toxic"])
    )


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluate ten runs on two tasks: all metrics from one scan of the predictions."""
    table = metrics.evaluate(order_predictions(spark, sf_dir))
    return rounded(table, "accuracy", "macro_f1", "weighted_f1")


# --- preparation -----------------------------------------------------------------


@register
def label_clean(spark, sf_dir):
    """Padded labels, flag texts and gaps made from documents, then cleaned."""
    pads = ["\t", " ", "  ", "\r\n "]
    at = F.col("doc_id") % 4
    pad = F.lit(pads[0])
    for i, text in enumerate(pads[1:], start=1):
        pad = F.when(at == i, text).otherwise(pad)
    flags = ["true", " FALSE", "True\t", "maybe"]
    flag = F.when(F.col("doc_id") % 5 < 4, F.get(F.array(*map(F.lit, flags)),
                                                 (F.col("doc_id") % 5).cast("int")))
    raw = I.table(spark, sf_dir, "documents").select(
        "doc_id",
        F.when(F.col("doc_id") % 11 != 0, F.col("text")).alias("text"),
        F.concat(pad, "lang", pad).alias("lang"),
        flag.alias("flag"),
    )
    clean = labels.map_labels(
        labels.normalise_labels(raw, ["lang", "flag"]), "flag", {"TRUE": "List", "FALSE": "Single"}
    )
    kept = labels.drop_incomplete(clean, ["text", "lang", "flag"])
    return kept.select("doc_id", "lang", "flag", F.length("text").cast("bigint").alias("chars"))


@register
def labels_long(spark, sf_dir):
    return order_labels(spark, sf_dir)


@register
def encoder_fit(spark, sf_dir):
    segments = I.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("row_idx"), F.col("c_mktsegment").alias("segment")
    )
    long = order_labels(spark, sf_dir).unionByName(
        labels.unpivot_labels(segments, ["row_idx"], ["segment"])
    )
    return labels.fit_encoder(long)


@register
def encode_decode(spark, sf_dir):
    long = order_labels(spark, sf_dir)
    encoder = labels.fit_encoder(long)
    ids = labels.encode(long, encoder)
    return labels.decode(ids, encoder, {"class_id": "class_name"}).select(
        "row_idx", "task", "class_id", "class_name"
    )


@register
def encode_wide(spark, sf_dir):
    orders = I.table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("priority"),
    )
    tasks = ["status", "priority"]
    encoder = labels.fit_encoder(labels.unpivot_labels(orders, ["o_orderkey"], tasks))
    return labels.encode_wide(orders, encoder, tasks).select(
        "o_orderkey", "status_encoded", "priority_encoded"
    )


@register
def num_classes(spark, sf_dir):
    return labels.num_classes(labels.fit_encoder(document_labels(spark, sf_dir)))


@register
def stratified_split(spark, sf_dir):
    orders = I.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return splits.stratified_split(orders, "o_orderkey", "o_orderpriority").select(
        "o_orderkey", "split"
    )


def split_documents(spark, sf_dir):
    documents = I.table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return splits.stratified_split(documents, "doc_id", "lang", seed=7)


@register
def stratified_split_skewed(spark, sf_dir):
    return split_documents(spark, sf_dir).select("doc_id", "split")


@register
def split_info(spark, sf_dir):
    info = splits.split_info(split_documents(spark, sf_dir), 7, "lang", ["lang", "source"])
    return info.withColumn("columns", F.array_join("columns", ","))


@register
def class_counts(spark, sf_dir):
    return labels.class_counts(document_labels(spark, sf_dir))


@register
def imbalance(spark, sf_dir):
    train = split_documents(spark, sf_dir).where(F.col("split") == "train")
    long = labels.unpivot_labels(train, ["doc_id"], ["lang", "source"])
    return rounded(labels.imbalance_report(long), "ratio")


@register
def class_weights(spark, sf_dir):
    return rounded(labels.class_weights(document_labels(spark, sf_dir)), "weight")


# --- metrics ---------------------------------------------------------------------


@register
def confusion_sparse(spark, sf_dir):
    return order_cells(spark, sf_dir)


@register
def confusion_dense(spark, sf_dir):
    encoder = labels.fit_encoder(order_labels(spark, sf_dir))
    return cells.confusion_matrix(order_cells(spark, sf_dir), encoder)


@register
def confusion_wide(spark, sf_dir):
    events = I.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("row_idx"), F.col("event_type").alias("event")
    )
    encoder = labels.fit_encoder(labels.unpivot_labels(events, ["row_idx"], ["event"]))
    counted = cells.confusion_cells(I.with_predictions(I.event_truth(spark, sf_dir)))
    return cells.confusion_matrix_wide(cells.confusion_matrix(counted, encoder), 5)


@register
def rejected_rows(spark, sf_dir):
    """Truth withheld for one order in seven."""
    truth = I.order_truth(spark, sf_dir)
    known = F.when(F.col("row_idx") % 7 != 0, F.col("y_true"))
    return cells.rejected_rows(
        I.with_predictions(truth).withColumn("y_true", known)
    )


@register
def per_class(spark, sf_dir):
    table = metrics.per_class(order_cells(spark, sf_dir))
    return rounded(table, "precision", "recall", "f1")


@register
def accuracy(spark, sf_dir):
    return rounded(metrics.accuracy(order_cells(spark, sf_dir)), "accuracy")


@register
def macro_f1(spark, sf_dir):
    counted = cells.confusion_cells(I.with_predictions(I.event_truth(spark, sf_dir)))
    return rounded(metrics.macro_f1(counted), "macro_f1")


@register
def macro_f1_all_classes(spark, sf_dir):
    """The encoder knows every order status; completed orders never occur in the truth."""
    truth = I.order_truth(spark, sf_dir).where("task = 'status' AND y_true <> 2")
    encoder = labels.fit_encoder(order_labels(spark, sf_dir))
    counted = cells.confusion_cells(
        I.with_predictions(truth).where("y_pred IS NULL OR y_pred <> 2")
    )
    return rounded(metrics.macro_f1(counted, encoder=encoder), "macro_f1")


@register
def weighted_f1(spark, sf_dir):
    counted = cells.confusion_cells(I.with_predictions(I.document_truth(spark, sf_dir)))
    return rounded(metrics.weighted_f1(counted), "weighted_f1")


@register
def report(spark, sf_dir):
    encoder = labels.fit_encoder(order_labels(spark, sf_dir))
    table = metrics.classification_report(order_cells(spark, sf_dir), encoder)
    return rounded(table, "precision", "recall", "f1", "support").drop("position")


@register
def mean_macro_f1(spark, sf_dir):
    table = metrics.mean_macro_f1(metrics.macro_f1(order_cells(spark, sf_dir)))
    return rounded(table, "mean_macro_f1")


@register
def evaluate(spark, sf_dir):
    return flagship(spark, sf_dir)


@register
def per_class_lists(spark, sf_dir):
    """Task metrics with the per-class F1 list, as run files keep them."""
    table = metrics.task_metrics(
        cells.confusion_cells(I.with_predictions(I.event_truth(spark, sf_dir)))
    )
    listed = rounded(table, "accuracy", "macro_f1", "weighted_f1").select("*", F.posexplode("per_class_f1").alias("position", "f1"))
    return rounded(listed.drop("per_class_f1"), "f1")


# --- errors ----------------------------------------------------------------------


@register
def errors_first_k(spark, sf_dir):
    documents = I.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_idx"), "text")
    predictions = I.with_predictions(I.document_truth(spark, sf_dir))
    found = errors.attach_text(errors.first_errors(predictions), documents)
    return found.select("run", "task", "row_idx", "y_true", "y_pred", "place", "text")


@register
def errors_by_confidence(spark, sf_dir):
    """All errors with text and class names, most confident first."""
    documents = I.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("row_idx"), "text", "lang"
    )
    encoder = labels.fit_encoder(labels.unpivot_labels(documents, ["row_idx"], ["lang"]))
    predictions = I.with_predictions(I.document_truth(spark, sf_dir))
    named = labels.decode(
        errors.attach_text(errors.errors(predictions), documents), encoder
    )
    return named.select(
        "run", "task", "row_idx", "true_label", "pred_label", r9("confidence").alias("confidence"),
        F.length("text").cast("bigint").alias("chars"),
    ).orderBy(F.desc("confidence"), "run", "task", "row_idx")


@register
def errors_top_k(spark, sf_dir):
    top = errors.errors_by_confidence(order_predictions(spark, sf_dir), 100)
    return top.select("run", "task", "row_idx", "y_true", "y_pred", r9("confidence").alias("confidence"))


# --- runs ------------------------------------------------------------------------


@register
def run_names(spark, sf_dir):
    found = order_predictions(spark, sf_dir).groupBy("run").agg(F.count("*").alias("n"))
    return found.select(
        "run", run_prefix(F.col("run")).alias("prefix"), run_seed(F.col("run")).alias("seed"), "n"
    )


@register
def seed_aggregate(spark, sf_dir):
    table = runs.aggregate_seeds(order_metrics(spark, sf_dir))
    return rounded(table, "mean", "std", "min", "max")


@register
def comparison(spark, sf_dir):
    table = runs.compare_settings(
        runs.aggregate_seeds(order_metrics(spark, sf_dir)), "multi", "single"
    )
    return rounded(table, "first_mean", "first_std", "second_mean", "second_std", "delta_mean")


@register
def comparison_text(spark, sf_dir):
    return runs.comparison_text(comparison(spark, sf_dir))


@register
def leaderboard(spark, sf_dir):
    table = rounded(runs.leaderboard(order_metrics(spark, sf_dir)), "mean_macro_f1", "delta")
    return table.withColumn("place", F.col("place").cast("bigint"))


@register
def missing_baseline(spark, sf_dir):
    """Single-task runs exist for the status task only."""
    predictions = order_predictions(spark, sf_dir).where("prefix <> 'single' OR task = 'status'")
    return runs.missing_baselines(
        predictions, order_labels(spark, sf_dir).select("task"), "single", "test"
    )


@register
def best_epoch(spark, sf_dir):
    table = runs.best_epoch(I.history(spark, sf_dir))
    return rounded(table.withColumn("best_epoch", F.col("best_epoch").cast("bigint")), "best")


@register
def early_stopping(spark, sf_dir):
    table = runs.early_stopping(I.history(spark, sf_dir))
    return rounded(
        table.withColumns({c: F.col(c).cast("bigint") for c in ("epoch", "waited")}),
        "value", "best_so_far",
    )


@register
def stopping_summary(spark, sf_dir):
    table = runs.stopping_summary(I.history(spark, sf_dir))
    return rounded(
        table.withColumns({c: F.col(c).cast("bigint") for c in ("stop_epoch", "best_epoch")}), "best"
    )


@register
def epoch_loss(spark, sf_dir):
    batches = I.table(spark, sf_dir, "events").select(
        F.col("event_type").alias("run"), F.dayofmonth("ts").cast("bigint").alias("epoch"),
        F.col("value").alias("loss"),
    )
    return rounded(runs.epoch_loss(batches), "train_loss")


@register
def cost_ratio(spark, sf_dir):
    """Cost roll-up per region, compared with one of them."""
    nation = I.table(spark, sf_dir, "nation")
    region = I.table(spark, sf_dir, "region")
    costs = (
        I.table(spark, sf_dir, "supplier")
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .groupBy(F.col("r_name").alias("setup"))
        .agg(F.count("*").alias("units"), F.sum("s_acctbal").alias("cost"))
    )
    table = runs.cost_ratios(costs, "ASIA", ["units", "cost"])
    return table.withColumns(
        {c: F.round(c, 4) + F.lit(0.0) for c in ("cost", "units_ratio", "cost_ratio")}
    )


# --- association -----------------------------------------------------------------


def label_columns(spark, sf_dir):
    customer = I.table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    orders = I.table(spark, sf_dir, "orders")
    return orders.join(customer, orders.o_custkey == customer.c_custkey).select(
        F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"),
        F.col("c_mktsegment").alias("segment"), F.year("o_orderdate").alias("year"),
    )


ASSOCIATED = ["status", "priority", "segment", "year"]


@register
def cramers_v(spark, sf_dir):
    return rounded(association.cramers_v(label_columns(spark, sf_dir), ASSOCIATED), "v")


@register
def cramers_v_corrected(spark, sf_dir):
    table = association.cramers_v(label_columns(spark, sf_dir), ASSOCIATED, bias_corrected=True)
    return table.withColumn("v", F.round("v", 6) + F.lit(0.0))


@register
def association_matrix(spark, sf_dir):
    pairs = association.cramers_v(label_columns(spark, sf_dir), ASSOCIATED)
    return rounded(association.association_matrix(pairs, ASSOCIATED), *ASSOCIATED)


# --- resampling ------------------------------------------------------------------


@register
def bootstrap_draws(spark, sf_dir):
    """How often each position of a language's documents is drawn in 20 replicates."""
    sizes = I.table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("scope")).agg(
        F.count("*").alias("total")
    )
    return (
        resample.bootstrap_draws(sizes, 20, seed=3)
        .groupBy("scope", "b", "at").agg(F.count("*").alias("times"))
    )


@register
def bootstrap_ci(spark, sf_dir):
    predictions = I.with_predictions(I.document_truth(spark, sf_dir))
    table = resample.bootstrap_ci(predictions, ["lang"], I.MULTI, REPLICATES, method="hash")
    return rounded(table, "mean", "low", "high")


def document_deltas(spark, sf_dir, across: bool):
    predictions = I.with_predictions(I.document_truth(spark, sf_dir, joint=True))
    return resample.paired_deltas(
        predictions, ["lang", "half"], I.MULTI, I.SINGLE, REPLICATES, seed=0, method="hash",
        across_tasks=across,
    )


PAIRED = ("delta", "low", "high", "p_one_sided", "p_two_sided", "tost_low", "tost_high", "tost_p")


@register
def paired_bootstrap(spark, sf_dir):
    return rounded(resample.compare_paired(document_deltas(spark, sf_dir, across=False)), *PAIRED)


@register
def paired_mean(spark, sf_dir):
    """One draw for all tasks, with the mean over the tasks as a row of its own."""
    return rounded(resample.compare_paired(document_deltas(spark, sf_dir, across=True)), *PAIRED)


@register
def significance_text(spark, sf_dir):
    return runs.significance_text(
        rounded(resample.compare_paired(document_deltas(spark, sf_dir, across=False)), *PAIRED)
    )


@register
def bootstrap_cells(spark, sf_dir):
    table = resample.bootstrap_ci(
        order_predictions(spark, sf_dir), ["status", "priority"], I.MULTI
    )
    return rounded(table, "mean", "low", "high")


@register
def bootstrap_law(spark, sf_dir):
    """What holds of every right bootstrap: draws add up, the estimate is inside, the spread is that of the law.

    The variance of the accuracy over 1000 replicates of n draws is within a third of p (1 - p) / n.
    """
    predictions = order_predictions(spark, sf_dir)
    drawn = resample.replicate_counts(predictions, ["status", "priority"], I.MULTI, 1000)
    hit = F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0))
    each = drawn.groupBy("task", "run", "b").agg(F.sum("n").alias("drawn"), (hit / F.sum("n")).alias("accuracy"))
    law = each.groupBy("task", "run").agg(
        F.count("*").alias("replicates"), F.min("drawn").alias("least"), F.max("drawn").alias("most"),
        F.var_pop("accuracy").alias("spread"),
        F.percentile("accuracy", F.lit(0.001)).alias("low"), F.percentile("accuracy", F.lit(0.999)).alias("high"),
    )
    judged = cells.confusion_cells(predictions).where(F.col("run").isin(I.MULTI)).groupBy("task", "run").agg(F.sum("n").alias("n"), hit.alias("hits"))
    p = F.col("hits") / F.col("n")
    return law.join(judged, ["task", "run"]).select(
        "task", "run", "replicates", "n", F.col("least").alias("least_drawn"), F.col("most").alias("most_drawn"),
        F.round(p, 9).alias("accuracy"), (p.between(F.col("low"), F.col("high"))).alias("inside"),
        (F.col("spread") * F.col("n") / (p * (1 - p))).between(2 / 3, 4 / 3).alias("spread_fits"),
    )


@register
def interval_law(spark, sf_dir):
    """What holds of intervals and paired differences by the default draws: their centre and width are those of the estimate and of keyed draws.

    The mean of 1000 replicates is within a fifth of the interval's width of the estimate, the estimate inside, and the width
    within a quarter of that by the other method.
    """
    predictions = I.with_predictions(I.document_truth(spark, sf_dir))
    by = ["prefix", "run", "task"]
    f1 = metrics.task_metrics(cells.confusion_cells(predictions, by), by)
    single = F.avg(F.when(F.col("prefix") == "single", F.col("macro_f1")))
    multi = F.avg(F.when(F.col("prefix") == "multi", F.col("macro_f1")))
    estimates = f1.groupBy("task").agg(multi.alias("interval"), (multi - single).alias("paired"))
    found = {}
    for method in ("cells", "hash"):
        one = resample.bootstrap_ci(predictions, ["lang"], I.MULTI, REPLICATES, method=method)
        deltas = resample.paired_deltas(predictions, ["lang"], I.MULTI, I.SINGLE, REPLICATES, method=method)
        both = [t.withColumn("kind", F.lit(kind)) for kind, t in (("interval", one), ("paired", resample.interval(deltas, "delta")))]
        found[method] = both[0].unionByName(both[1])
    other = found["hash"].select("task", "kind", (F.col("high") - F.col("low")).alias("other"))
    width, off = F.col("high") - F.col("low"), F.abs(F.col("mean") - F.col("estimate"))
    return (
        found["cells"].join(estimates.unpivot(["task"], ["interval", "paired"], "kind", "estimate"), ["task", "kind"]).join(other, ["task", "kind"])
        .select(
            "task", "kind", "replicates", F.round("estimate", 9).alias("estimate"), F.col("estimate").between(F.col("low"), F.col("high")).alias("inside"),
            (off < width / 5).alias("centred"), (width / F.col("other")).between(0.75, 1.25).alias("width_fits"),
        )
    )


@register
def paired_cells(spark, sf_dir):
    deltas = resample.paired_deltas(
        order_predictions(spark, sf_dir), ["status", "priority"], I.MULTI, I.SINGLE,
        across_tasks=True,
    )
    return rounded(resample.compare_paired(deltas), *PAIRED)


# --- scoring ---------------------------------------------------------------------


def vectors(spark, sf_dir):
    return I.table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("row_idx"), "embedding", "label",
        (F.col("label") % 2).alias("two"), (F.col("label") % 3).alias("three"),
    )


def scored(spark, sf_dir):
    """Logits of nearest-centroid heads for three tasks, with the true class."""
    rows = vectors(spark, sf_dir)
    heads = scoring.centroid_heads(rows, "embedding", HEAD_TASKS)
    logits = scoring.score_heads(rows, "embedding", heads, ["row_idx", "label"])
    truth = (
        F.when(F.col("task") == "two", F.col("label") % 2)
        .when(F.col("task") == "three", F.col("label") % 3)
        .otherwise(F.col("label"))
    )
    return logits.select("row_idx", "task", "logits", truth.alias("y_true"))


def exploded(df: DataFrame, array: str, value: str) -> DataFrame:
    return df.select("row_idx", "task", F.posexplode(array).alias("class_id", value)).withColumn(
        value, F.round(value, 6) + F.lit(0.0)
    )


@register
def score_heads(spark, sf_dir):
    return exploded(scored(spark, sf_dir), "logits", "logit")


@register
def predict_blocks(spark, sf_dir):
    """Predictions of a head of 97 classes that is scored in blocks of 20."""
    rows = vectors(spark, sf_dir).withColumn("many", F.col("row_idx") % 97)
    heads = scoring.centroid_heads(rows, "embedding", {"many": "many"})
    found = large_heads.predict_blocks(rows, "embedding", heads, ["row_idx"], {"many": "many"}, block_parameters=20 * 65)
    return rounded(found, "confidence", "log_sum", "ce")


@register
def softmax_rows(spark, sf_dir):
    rows = scored(spark, sf_dir).select("row_idx", "task", softmax(F.col("logits")).alias("p"))
    return exploded(rows, "p", "probability")


@register
def predict(spark, sf_dir):
    table = scoring.predict(scored(spark, sf_dir))
    return table.select(
        "row_idx", "task", "y_true", "y_pred", F.round("confidence", 6).alias("confidence")
    )


@register
def score_and_evaluate(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    heads = scoring.centroid_heads(rows, "embedding", HEAD_TASKS)
    truth = rows.unpivot(
        ["row_idx"], [F.col("label").alias("ten"), "two", "three"], "task", "y_true"
    )
    out = evaluate_scores(rows, "embedding", heads, truth)
    return rounded(out["metrics"].drop("per_class_f1"), "accuracy", "macro_f1", "weighted_f1")


def train_weights(spark, sf_dir):
    long = vectors(spark, sf_dir).unpivot(
        ["row_idx"], [F.col("label").alias("ten"), "two", "three"], "task", "label"
    )
    weighted = labels.class_weights(long)
    return scoring.weight_arrays(
        weighted.select("task", F.col("label").alias("class_id"), "weight")
    )


@register
def row_losses(spark, sf_dir):
    """Weighted, smoothed cross entropy and focal term of every row."""
    table = scoring.row_losses(
        scored(spark, sf_dir), 5.0, train_weights(spark, sf_dir), smoothing=0.1
    )
    return table.select(
        "row_idx", "task",
        (F.round("ce", 6) + F.lit(0.0)).alias("ce"), (F.round("focal", 6) + F.lit(0.0)).alias("focal"),
    )


@register
def focal_loss(spark, sf_dir):
    table = scoring.focal_loss(scored(spark, sf_dir), 2.0)
    return table.withColumn("loss", F.round("loss", 6) + F.lit(0.0))


@register
def combined_loss(spark, sf_dir):
    """Uncertainty-weighted total; each task's log-variance is its log class count."""
    losses = scoring.focal_loss(
        scored(spark, sf_dir), 5.0, train_weights(spark, sf_dir), smoothing=0.1
    )
    log_vars = train_weights(spark, sf_dir).select("task", F.log(F.size("weights")).alias("log_var"))
    weighted = scoring.combine_losses(losses, log_vars).withColumn("kind", F.lit("weighted"))
    plain = scoring.combine_losses(losses).withColumn("kind", F.lit("plain"))
    return weighted.unionByName(plain).select(
        "kind", (F.round("total_loss", 6) + F.lit(0.0)).alias("total_loss")
    )


def damped(rows: DataFrame) -> DataFrame:
    return rows.withColumn("logits", F.transform("logits", lambda x: x * 0.5))


@register
def symmetric_kl(spark, sf_dir):
    rows = scored(spark, sf_dir)
    table = scoring.symmetric_kl(rows, damped(rows))
    return table.withColumn("kl", F.round("kl", 6) + F.lit(0.0))


@register
def regularised_loss(spark, sf_dir):
    rows = scored(spark, sf_dir)
    combined = scoring.combine_losses(scoring.focal_loss(rows, 2.0))
    total = scoring.regularised_loss(combined, scoring.symmetric_kl(rows, damped(rows)), alpha=0.7)
    return total.select((F.round("total_loss", 6) + F.lit(0.0)).alias("total_loss"))


@register
def fit_heads(spark, sf_dir):
    """Heads of all three tasks, trained with class weights: what holds of them whatever the optimiser's digits."""
    rows = vectors(spark, sf_dir)
    weights = train_weights(spark, sf_dir)
    heads = scoring.fit_heads(rows, "embedding", HEAD_TASKS, class_weights=weights)
    truth = (
        F.when(F.col("task") == "two", F.col("label") % 2)
        .when(F.col("task") == "three", F.col("label") % 3)
        .otherwise(F.col("label"))
    )
    logits = scoring.score_heads(rows, "embedding", heads, ["row_idx", "label"]).withColumn("y_true", truth)
    losses = scoring.row_losses(logits, weights=weights).groupBy("task").agg(F.avg("ce").alias("loss"))
    zero = F.transform("logits", lambda _: F.lit(0.0))
    untrained = scoring.row_losses(logits.withColumn("logits", zero), weights=weights).groupBy("task").agg(F.avg("ce").alias("before"))
    sums = heads.groupBy("task").agg((F.abs(F.sum("bias")) < 1e-6).alias("biases_cancel"))
    return (
        heads.select("task", "class_id", F.size("weight").alias("dims"))
        .join(sums, "task").join(losses, "task").join(untrained, "task")
        .select("task", "class_id", "dims", "biases_cancel", (F.col("loss") < F.col("before")).alias("learned"))
    )


def _joint(spark, sf_dir):
    return vectors(spark, sf_dir), dict(HEAD_TASKS)


@register
def joint_gradient(spark, sf_dir):
    """Gradient of the joint objective at nearest-centroid heads: class weights, smoothing, log variances of ln(classes); position 0 is the bias."""
    rows, tasks = _joint(spark, sf_dir)
    ready = training.prepare_rows(rows, "row_idx", "embedding", tasks)
    zeros = training.zero_heads(ready, tasks, train_weights(spark, sf_dir))
    heads = training.started(zeros, scoring.centroid_heads(rows, "embedding", tasks))
    heads.log_vars[:] = [math.log(k) for k in heads.sizes]
    sums = training.gradient_sums(ready, heads, training.Objective(5.0, 0.1), 0)
    owners = [(row, task, c) for task, part in zip(heads.tasks, heads.slices()) for c, row in enumerate(range(part.start, part.stop))]
    names = spark.createDataFrame(owners, "row int, task string, class_id int")
    judged = ready.agg(*(F.count(f"y{t}").alias(task) for t, task in enumerate(heads.tasks)))
    counts = judged.unpivot([], heads.tasks, "task", "n")
    whole = F.array_insert(F.slice("total", F.lit(1), F.size("total") - 1), 1, F.element_at("total", -1))
    return (
        sums.join(names, "row").join(counts, "task")
        .select("task", "class_id", "n", F.posexplode(whole).alias("pos", "value"))
        .select("task", "class_id", "pos", (F.round(F.col("value") / F.col("n"), 6) + F.lit(0.0)).alias("gradient"))
    )


@register
def train_heads(spark, sf_dir):
    """Heads trained together on the focal loss, from cross-entropy heads on: shape, and that their focal loss is the lower one."""
    rows, tasks = _joint(spark, sf_dir)
    plain = scoring.fit_heads(rows, "embedding", tasks)
    trained = training.train_heads(rows, "row_idx", "embedding", tasks, training.Objective(5.0), epochs=30, rate=0.1, decay=0.0, start=plain)
    truth = (
        F.when(F.col("task") == "two", F.col("label") % 2)
        .when(F.col("task") == "three", F.col("label") % 3)
        .otherwise(F.col("label"))
    )
    loss = {}
    for name, heads in (("joint", trained.heads), ("plain", plain)):
        logits = scoring.score_heads(rows, "embedding", heads, ["row_idx", "label"]).withColumn("y_true", truth)
        loss[name] = scoring.focal_loss(logits, 5.0).select("task", F.col("loss").alias(name))
    return (
        trained.heads.select("task", "class_id", F.size("weight").alias("dims"))
        .join(loss["joint"], "task").join(loss["plain"], "task").join(trained.log_vars, "task")
        .select("task", "class_id", "dims", (F.col("joint") < F.col("plain")).alias("learned"), (F.col("log_var") != 0).alias("weighted"))
    )


@register
def mean_losses(spark, sf_dir):
    """Losses of two passes, here with two focal exponents, averaged per task."""
    first, second = (scoring.focal_loss(scored(spark, sf_dir), gamma) for gamma in (2.0, 5.0))
    return scoring.mean_losses(first, second).withColumn("loss", F.round("loss", 6) + F.lit(0.0))


# --- sources and sinks -----------------------------------------------------------


@register
def io_predictions(spark, sf_dir):
    """Write the prediction table by run, read two prefixes back by folder."""
    path = fresh_path(spark, "predictions")
    sources.write_predictions(order_predictions(spark, sf_dir), path)
    back = sources.read_predictions(spark, path, "multi", "test", ["status"])
    return cells.confusion_cells(back)


@register
def io_encoder(spark, sf_dir):
    path = fresh_path(spark, "encoder")
    sources.write_encoder(labels.fit_encoder(document_labels(spark, sf_dir)), path)
    return sources.read_encoder(spark, path)


@register
def io_run_metrics(spark, sf_dir):
    path = fresh_path(spark, "metrics")
    by = ["run", "split", "task"]
    table = metrics.task_metrics(
        cells.confusion_cells(order_predictions(spark, sf_dir), by), by
    )
    sources.write_run_metrics(table, path)
    back = sources.read_runs(spark, path, "test", "multi")
    return rounded(
        back.select("run", "prefix", "seed", "task", "accuracy", "macro_f1",
                    F.size("per_class_f1").alias("classes")),
        "accuracy", "macro_f1",
    )


@register
def io_questions(spark, sf_dir):
    """Whole texts through CSV: quotes and line breaks survive, missing tokens become null."""
    path = fresh_path(spark, "questions")
    texts = I.table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("doc_id"), "text", "lang",
        F.when(F.col("doc_id") % 9 == 0, "NA").otherwise(F.col("source")).alias("source"),
    )
    texts.write.option("header", True).option("escape", '"').option("quoteAll", True).csv(path)
    back = sources.read_questions(spark, path, "text", ["lang", "source"], ["doc_id"])
    return back.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.md5("text").alias("digest"), "lang", "source"
    )


@register
def io_history(spark, sf_dir):
    """Histories written as CSV per run, read back and unpivoted by task."""
    from tallyframe.storage import settle

    path = fresh_path(spark, "histories")
    table = settle(
        I.history(spark, sf_dir).select(
            "run", "epoch", (F.col("val_mean_f1") * 2).alias("train_loss"), "val_mean_f1",
            F.col("val_mean_f1").alias("a_f1"), (F.col("val_mean_f1") * 2).alias("b_f1"),
        ),
        "history",
    )
    for name in I.EVENT_TYPES:
        one = table.where(F.col("run") == name).drop("run").orderBy("epoch").coalesce(1)
        sources.write_table(one, f"{path}/{name}_history.csv")
    back = sources.read_history(spark, f"{path}/*_history.csv", ["a", "b"])
    return rounded(
        history_long(back, ["a", "b"]).withColumn("epoch", F.col("epoch").cast("bigint")), "f1"
    )


@register
def prepare_pipeline(spark, sf_dir):
    """Clean, encode, split and store documents; class counts of each stored split."""
    documents = I.table(spark, sf_dir, "documents").select(
        "doc_id", "text", F.concat(F.lit(" "), "lang").alias("lang"), "source"
    )
    path = fresh_path(spark, "prepared")
    prepare(documents, "doc_id", "text", ["lang", "source"], "lang", path, seed=7)
    found = [
        sources.read_split(spark, f"{path}/splits", s, ["lang"], key="doc_id")
        .groupBy("lang_encoded").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
        .withColumn("split", F.lit(s))
        for s in ("train", "val", "test")
    ]
    return found[0].unionByName(found[1]).unionByName(found[2])


@register
def error_pipeline(spark, sf_dir):
    documents = I.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("row_idx"), "text", "lang"
    )
    encoder = labels.fit_encoder(labels.unpivot_labels(documents, ["row_idx"], ["lang"]))
    predictions = I.with_predictions(I.document_truth(spark, sf_dir), ("multi",))
    out = analyse_errors(predictions, encoder, documents, k=5)
    found = out["errors"].select(
        "run", "task", "row_idx", "true_label", "pred_label", F.md5("text").alias("digest"), "place"
    )
    report = rounded(out["report"], "precision", "recall", "f1", "support").drop("position")
    return tagged(errors=found, report=report, matrix=out["matrix"])


@register
def aligned_profiles(spark, sf_dir):
    """Examples per profile of all runs, counted on predictions that are stored by bucket of their example."""
    predictions = I.with_predictions(I.document_truth(spark, sf_dir))
    stored = sources.store_aligned(predictions, fresh_path(spark, "stored"))
    profiles = resample.profile_counts(stored, ["lang"], [*I.MULTI, *I.SINGLE])
    return profiles.select("scope", F.array_join(F.transform("code", lambda c: c.cast("string")), ",").alias("code"), "n")


@register
def compare_pipeline(spark, sf_dir):
    predictions = I.with_predictions(I.document_truth(spark, sf_dir, joint=True))
    out = compare_runs(
        predictions, ["lang", "half"], I.MULTI, I.SINGLE, REPLICATES, method="hash"
    )
    lists = F.transform("per_class_f1", lambda x: fixed_text(x, 6))
    return tagged(
        metrics=rounded(out["metrics"], "accuracy", "macro_f1", "weighted_f1").withColumn("per_class_f1", F.array_join(lists, " ")),
        summary=rounded(out["summary"], "mean", "std", "min", "max"),
        intervals=rounded(out["intervals"], "mean", "low", "high"),
        paired=rounded(out["paired"], *PAIRED),
    )


@register
def percentiles(spark, sf_dir):
    """Prices by return flag and status: percentiles from counts, whatever the size of a group."""
    shares = {"low": 0.025, "median": 0.5, "high": 0.975, "least": 0.0, "most": 1.0}
    found = counted_percentiles.percentiles(
        I.table(spark, sf_dir, "lineitem"), "l_extendedprice", shares, ["l_returnflag", "l_linestatus"]
    )
    return found.withColumns({c: F.round(c, 6) for c in shares})


@register
def number_texts(spark, sf_dir):
    """Shares of line items as texts; quantities in 32nds are exact ties, prices in 200ths near ones."""
    rows = I.table(spark, sf_dir, "lineitem").select(
        fixed_text(F.col("l_quantity") / 32, 4).alias("exact"), fixed_text(F.col("l_extendedprice") / 200, 3, True).alias("near")
    )
    return rows.groupBy("exact", "near").agg(F.count("*").alias("n"))


@register
def appended_cells(spark, sf_dir):
    """Cells of predictions that came in four batches, one of them first with other rows."""
    predictions = order_predictions(spark, sf_dir)
    path = fresh_path(spark, "cell-store")
    batch = F.pmod("row_idx", F.lit(4))
    cell_store.create_cells(predictions, path)
    cell_store.put_batch(predictions.where(batch == 0), path, "3")
    cell_store.put_batches(predictions, path, batch, ["0", "1", "2"])
    cell_store.put_batch(predictions.where(batch == 3), path, "3")
    return cell_store.stored_cells(spark, path)
