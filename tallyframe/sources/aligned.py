"""Predictions stored so that runs are paired without an exchange.

The rows of an example, of all runs and tasks, are in one bucket.  Grouping by example, or by task and example, then reads
each bucket in a task of its own; only counts per profile or cell are shuffled after it.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.storage import fresh_path

#: Prediction rows of a bucket, about.
BUCKET_ROWS = 4_000_000

_COLUMNS = {
    "prefix": "string", "run": "string", "seed": "int", "split": "string", "row_idx": "bigint", "task": "string",
    "y_true": "int", "y_pred": "int", "confidence": "double",
}


def _name(path: str) -> str:
    return "aligned_" + hashlib.md5(path.encode()).hexdigest()


def store_aligned(predictions: DataFrame, path: str, buckets: int | None = None) -> DataFrame:
    """Write predictions by bucket of their example under ``path`` and open them; one exchange.

    Rows may be added by :func:`append_aligned` later.  ``path`` must be new.  Columns that the table has and
    ``predictions`` lacks are null, other columns are left out.
    """
    spark = predictions.sparkSession
    if buckets is None:
        wanted = int(spark.conf.get("spark.sql.shuffle.partitions"))
        buckets = max(wanted, math.ceil(predictions.count() / BUCKET_ROWS))
    kind = dict(predictions.dtypes)["row_idx"]
    spark.createDataFrame([(buckets, kind)], "buckets int, row_idx string").write.parquet(f"{path}/layout")
    append_aligned(predictions, path)
    return read_aligned(spark, path)


def _open(spark: SparkSession, path: str) -> tuple[int, dict[str, str]]:
    """Buckets and column types of the stored predictions, which are a table of the session from now on."""
    buckets, key = spark.read.schema("buckets int, row_idx string").parquet(f"{path}/layout").first()
    types = _COLUMNS | {"row_idx": key}
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {_name(path)} ({', '.join(f'{c} {kind}' for c, kind in types.items())}) USING parquet "
        f"CLUSTERED BY (row_idx) SORTED BY (row_idx, task) INTO {buckets} BUCKETS LOCATION '{path}/rows'"
    )
    return buckets, types


def append_aligned(predictions: DataFrame, path: str) -> None:
    """Add the predictions of more runs, in the same buckets."""
    buckets, types = _open(predictions.sparkSession, path)
    columns = [(F.col(c) if c in predictions.columns else F.lit(None)).cast(kind).alias(c) for c, kind in types.items()]
    # One file per bucket: rows come in the order of their buckets already.
    dealt = predictions.select(*columns).repartition(buckets, "row_idx")
    dealt.write.insertInto(_name(path))
    predictions.sparkSession.catalog.refreshTable(_name(path))


def read_aligned(spark: SparkSession, path: str) -> DataFrame:
    """Open stored predictions, also in another session than that which wrote them."""
    try:
        _open(spark, path)
    except AnalysisException as error:
        raise FileNotFoundError(f"no aligned predictions in {path}") from error
    return spark.table(_name(path))


def align_once(predictions: DataFrame) -> DataFrame:
    """Predictions in buckets for the consumers of one comparison."""
    return store_aligned(predictions, fresh_path(predictions.sparkSession, "aligned"))
