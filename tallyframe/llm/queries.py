"""One registered query per operator of this subpackage, on the driver tables."""

from __future__ import annotations

from pathlib import Path

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.block_topk import top_k
from tallyframe.llm.decontaminate import find_contamination
from tallyframe.llm.duck_bpe import Ranks, bpe_round_trip
from tallyframe.llm.jaccard_rtree import jaccard_components
from tallyframe.llm.lang_id import fit_languages, predict_language
from tallyframe.llm.lattice import Vocabulary
from tallyframe.llm.lattice_lm import fit_lattice, score_texts
from tallyframe.llm.line_dedup import dedup_lines
from tallyframe.llm.phrase_mining import mine_phrases
from tallyframe.llm.prefix_trie import conversation_turns, prefix_trie, rebuilt
from tallyframe.llm.quality_model import fit_quality, score_quality
from tallyframe.llm.repetition import COUNTS, repetition_rules
from tallyframe.llm.token_store import read_token_store, write_token_store
from tallyframe.llm.url_filter import filter_urls

#: (host, path, verdict) of the URL rules.
URL_RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)
#: A page of a host with one of these in its name is put on the list.
LISTED_HOSTS = ("cheap-pills", "ads-track")


GOOD_SCORE = 0.7


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    rules = spark.createDataFrame(list(URL_RULES), "host string, path string, verdict string")
    listed = pages.where(F.rlike("url", F.lit("|".join(LISTED_HOSTS)))).select("url")
    return filter_urls(pages, rules, listed)


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = repetition_rules(table(spark, sf_dir, "documents"))
    return measured.select("doc_id", *COUNTS, "base_failed", "kept")


def held_out(modulus: int, remainder: int) -> Column:
    """Rows kept out of training, by the crc32 of their id as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % modulus == remainder


def piece_vocabulary() -> Vocabulary:
    return Vocabulary.from_sentencepiece(public_tokenizers.path("piece_bpe_32k.model"))


def quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_quality(docs.where(~held_out(4, 2)), table(spark, sf_dir, "labels"), vector_docs=docs)
    scored = score_quality(docs, model, ["doc_id"])
    return scored.select(
        "doc_id", held_out(4, 2).alias("held_out"), "score", (F.col("score") >= GOOD_SCORE).cast("int").alias("predicted")
    )


def jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), words=3, percent=90).select("doc_id", "n_shingles", "component_id")


def lattice_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_lattice(docs.where(~held_out(7, 2)), piece_vocabulary())
    return score_texts(docs, model).select(
        "doc_id", held_out(7, 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    definition = Path(public_tokenizers.path("word_bpe_49k.json")).read_text()
    store = write_token_store(table(spark, sf_dir, "documents"), definition)
    return read_token_store(spark, store).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.array_join("dropped", ",").alias("dropped"))


def byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = Ranks.from_file(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    coded = bpe_round_trip(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return coded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def benchmark_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_languages(docs.where(~held_out(3, 1)), piece_vocabulary())
    return predict_language(docs, model).select("doc_id", held_out(3, 1).alias("held_out"), "lang_pred", "score")


def phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_phrases(table(spark, sf_dir, "documents"))


def conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(rebuilt(conversation_turns(table(spark, sf_dir, "conversations"))))


def vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


QUERIES = {
    "op1_url_filter": url_filter,
    "op2_quality_rules": quality_rules,
    "op3_quality_score": quality_score,
    "op4_jaccard_join": jaccard_join,
    "op5_lattice_score": lattice_score,
    "op6_token_files": token_files,
    "op7_line_dedup": line_dedup,
    "op8_byte_bpe": byte_bpe,
    "op9_benchmark_hits": benchmark_hits,
    "op10_language_id": language_id,
    "op11_phrases": phrases,
    "op12_prefix_trie": conversation_trie,
    "op13_top_k": vector_search,
}
