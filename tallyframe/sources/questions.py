"""Labelled text tables and their splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Cell texts that common data-frame CSV readers take for missing by default.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def read_questions(
    spark: SparkSession,
    path: str,
    text_col: str,
    tasks: Sequence[str],
    extra: Sequence[str] = (),
    na_tokens: Sequence[str] = NA_TOKENS,
) -> DataFrame:
    """CSV with a header, quoted line breaks, doubled quotes and an optional BOM.

    All columns are text; the header decides their order, and a file whose header
    differs from the first one's fails the job.  A file with quoted line
    breaks cannot be cut into ranges, so a large table should come as many files:
    each is one task.
    """
    wanted = [text_col, *tasks, *extra]
    raw = (
        spark.read.option("header", True)
        .option("multiLine", True)
        .option("escape", '"')
        .option("encoding", "UTF-8")
        .option("inferSchema", False)
        .option("enforceSchema", False)
        .csv(path)
    )
    missing = [c for c in wanted if c not in raw.columns]
    if missing:
        raise ValueError(f"columns not in the file: {missing}")
    tokens = list(na_tokens)
    return raw.select(
        *(F.when(~F.col(c).isin(tokens), F.col(c)).alias(c) for c in wanted)
    )


def write_splits(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """One folder per split value."""
    writer = df.write.partitionBy("split").mode("errorifexists")
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"').option("quoteAll", True)
    writer.format(fmt).save(path)


def read_split(
    spark: SparkSession,
    path: str,
    split: str,
    tasks: Sequence[str],
    text_col: str = "text",
    key: str | None = "row_idx",
    suffix: str = "_encoded",
    fmt: str = "parquet",
) -> DataFrame:
    """One split: the text and the encoded labels of the active tasks only.

    The split is a partition folder and the projection reaches the scan, so
    neither other splits nor inactive tasks are read.  ``fmt="csv"`` reads what
    ``write_splits`` wrote as CSV; labels are integers then too.
    """
    columns = [*([key] if key else []), text_col, *(f"{t}{suffix}" for t in tasks)]
    if fmt == "parquet":
        return spark.read.parquet(path).where(F.col("split") == split).select(*columns)
    found = (
        spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("enforceSchema", False)
        .csv(path).where(F.col("split") == split)
    )
    types = {**({key: "bigint"} if key else {}), text_col: "string"}
    return found.select(*(F.col(c).cast(types.get(c, "int")).alias(c) for c in columns))
