"""Shared scratch space and settled (written) intermediate tables.

Small derived tables - encoders, quotas, cut points, joint counts - are written
once and read back.  That does three things at cluster scale: the lineage is cut
on storage that outlives a lost executor, the work is not repeated by each
consumer, and the planner sees the table's *real* size.  A lookup is therefore
broadcast only when it is under ``spark.sql.autoBroadcastJoinThreshold``; above
that it becomes a sort-merge join, whose hot keys adaptive execution splits.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession

_LOCAL_SCRATCH: dict[str, str] = {}
# Folder of what is written only to make one table, while that is made.
_PASSING: ContextVar[str | None] = ContextVar("passing", default=None)


def scratch_dir(spark: SparkSession) -> str:
    """Folder all executors can reach: ``spark.checkpoint.dir`` when the cluster names one.

    A single-machine session without the setting gets a fresh temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    app = context.applicationId
    if app not in _LOCAL_SCRATCH:
        _LOCAL_SCRATCH[app] = tempfile.mkdtemp(prefix="tallyframe-")
    return _LOCAL_SCRATCH[app]


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{_PASSING.get() or scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame, label: str = "settled") -> DataFrame:
    """Write ``df`` once to the shared scratch folder and read it back."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settle_only(spark: SparkSession, make: Callable[[], DataFrame], label: str = "settled") -> DataFrame:
    """The table that ``make`` returns, settled; all that was settled on the way is deleted once it is written.

    Whatever else is read after ``make`` must not come from tables that it settled.
    """
    path = fresh_path(spark, label)
    outer = _PASSING.set(f"{path}-made")
    try:
        df = make()
        df.write.parquet(path)
    finally:
        _PASSING.reset(outer)
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}-made")
        folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)
    return spark.read.schema(df.schema).parquet(path)


def lookup_join(
    big: DataFrame,
    small: DataFrame,
    on: list[str] | Column,
    how: str = "left",
) -> DataFrame:
    """Join ``big`` with a derived dimension whose size the planner can check."""
    return big.join(settle(small, "lookup"), on, how)
