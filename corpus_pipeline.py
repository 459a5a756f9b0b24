"""The corpus pipeline: five stages from raw documents to token ids, each over all that its predecessor kept.

Every stage but the last returns the columns of ``documents``; :func:`run` writes each result as Parquet and
reads it again for the next stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.decontaminate import find_contamination
from tallyframe.llm.duck_bpe import Ranks, bpe_round_trip
from tallyframe.llm.jaccard_rtree import jaccard_components
from tallyframe.llm.line_dedup import dedup_lines
from tallyframe.llm.quality_model import fit_quality, score_quality
from tallyframe.llm.queries import GOOD_SCORE, table
from tallyframe.storage import fresh_path


def _free(name: str, taken: list[str]) -> str:
    while name in taken:
        name = f"_{name}"
    return name


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """Rows with a number of their own: ids may repeat or be null.  Files give the same numbers whenever they are read."""
    row = _free("row", docs.columns)
    return docs.withColumn(row, F.monotonically_increasing_id()), row


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on all labelled ones, does not reject; all of them if no label meets a document."""
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    if not model.learned:
        return docs
    score = _free("score", docs.columns)
    return score_quality(docs, model, docs.columns, score_col=score).where(F.col(score) >= GOOD_SCORE).drop(score)


def distinct_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the lines that came before; ``n_chars`` follows the text."""
    return dedup_lines(docs).select(*(F.length("text").cast("long").alias(c) if c == "n_chars" else c for c in docs.columns))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies (five-word shingles, similarity 0.8 or more): that of the smallest id."""
    rows, row = _numbered(docs)
    named = rows.select(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", F.col(row).alias("row")).alias("doc_id"), "text")
    classes = jaccard_components(named, words=5, percent=80)
    stays = classes.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id.row").alias(row))
    return rows.join(stays, row, "left_semi").select(*docs.columns)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    rows, row = _numbered(docs)
    found = find_contamination(rows, table(spark, sf_dir, "benchmark"), id_col=row)
    return rows.join(found.where("n_hit > 0").select(row), row, "left_anti").select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document that is left."""
    ranks = Ranks.from_file(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    coded = bpe_round_trip(docs, ranks, public_tokenizers.PATTERN)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", good_documents),
    ("line dedup", distinct_lines),
    ("n-gram Jaccard join", one_of_near_copies),
    ("benchmark decontamination", uncontaminated),
    ("byte-level BPE", token_ids),
]

# A fitted network and BPE have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
