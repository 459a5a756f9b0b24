"""Language-model scores of texts: a word unigram base and the marginal probability over a piece lattice."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.llm import spans as S
from tallyframe.llm.lattice import Vocabulary, WordCache, expected_counts
from tallyframe.storage import settle

#: The most frequent words travel to every task; all others are looked up by a join.  Their number and
#: length are bounded (at most 200,000 x 64 bytes), whatever the input.
FREQUENT_WORDS = 200_000
_FREQUENT_BYTES = 64
_HELD_WORDS = 300_000
# The end of a text among the words, none of which is empty.
_END = b""


@dataclass
class LatticeModel:
    vocabulary: Vocabulary
    counts: DataFrame  # (word binary, n long): every training token with its count
    frequent: dict[bytes, int]
    n_tokens: int
    n_distinct: int
    n_ends: int
    log_weights: np.ndarray
    log_end: float


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n): all words of all texts, A-Z lower-cased, and one empty word per text for its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays(
                [pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], names=["word", "n"]
            )
            held.clear()
            return batch

        for batch in batches:
            for text in S.texts_of(batch.column(0)):
                held.update(text.translate(S.LOWER).split())
                held[_END] += 1
                if len(held) > _HELD_WORDS:
                    yield out()
        if held:
            yield out()

    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _frequent(counts: DataFrame) -> DataFrame:
    """At most ``FREQUENT_WORDS`` words, all more frequent than any short word left out."""
    short = counts.where(F.length("word").between(1, _FREQUENT_BYTES)).withColumn("step", F.floor(F.log2("n") * 16))
    steps = short.groupBy("step").count().orderBy(F.desc("step")).collect()  # 16 steps per doubling of the count
    total, least = 0, None
    for row in steps:
        total += row["count"]
        if total > FREQUENT_WORDS:
            break
        least = row["step"]
    return short.where(F.lit(False) if least is None else F.col("step") >= least).select("word", "n")


def fit_lattice(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text", smoothing: float = 0.5) -> LatticeModel:
    """Word counts of all texts, and piece probabilities re-estimated from them.

    The vocabulary's own scores weight all segmentations of every counted word; the expected use of each piece and
    the number of texts (ends) give the probabilities.  The counts stay a table; only sums per piece reach the driver.
    """
    counts = settle(word_counts(docs, text_col), "word-counts")
    facts = counts.agg(F.sum("n").alias("tokens"), F.count("*").alias("distinct"), F.sum(F.when(F.length("word") == 0, F.col("n"))).alias("ends")).first()
    top = _frequent(counts).toArrow()
    pieces = len(vocabulary.pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used = np.zeros(pieces)
        for batch in batches:
            words = batch.column(0).to_pylist()
            used += expected_counts(words, batch.column(1).to_numpy().astype(float), vocabulary, vocabulary.prior)
        some = np.flatnonzero(used)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(used[some])], names=["piece", "used"])

    spread = counts.where(F.length("word") > 0)
    found = spread.mapInArrow(run, "piece long, used double").groupBy("piece").agg(F.sum("used").alias("used")).toArrow()
    used = np.full(pieces, smoothing)
    used[found["piece"].to_numpy()] += found["used"].to_numpy()
    ends = (facts["ends"] or 0) + smoothing
    total = used.sum() + ends
    return LatticeModel(
        vocabulary, counts, dict(zip(top["word"].to_pylist(), top["n"].to_pylist())), facts["tokens"] or 0, facts["distinct"],
        facts["ends"] or 0,
        np.log(used / total), float(np.log(ends / total)),
    )


def score_texts(docs: DataFrame, model: LatticeModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) for every row, over its whole text.

    ``base_score`` is the add-one unigram score in log10; ``score`` the log10 of the text's probability summed
    over all segmentations of its words into pieces, with the end.  A null text is an empty one: only its
    end counts.  Repeated and null ids keep their rows; other columns are not looked at; with no training rows every
    token is unknown.  Words outside the frequent ones are joined with the counts: none of them is a
    hot key, because all words more frequent than they are were handled before.
    """
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")
    )
    kind = rows.schema["id"].dataType
    rare = T.ArrayType(T.BinaryType())
    schema = T.StructType(
        [T.StructField("row", T.LongType()), T.StructField("id", kind), T.StructField("n_tokens", T.LongType()), T.StructField("known", T.LongType()),
         T.StructField("logs", T.DoubleType()), T.StructField("score", T.DoubleType()), T.StructField("rare", rare)]
    )
    vocabulary, weights, frequent, log_end = model.vocabulary, model.log_weights, model.frequent, model.log_end
    end = model.n_ends

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordCache(vocabulary, weights)
        for batch in batches:
            texts = S.texts_of(batch.column(2))
            for lo, hi in S.chunks(texts):
                lists = [t.translate(S.LOWER).split() for t in texts[lo:hi]]
                words = [w for each in lists for w in each]
                sizes = np.array([len(each) for each in lists], dtype=np.int64)
                owner = np.repeat(np.arange(len(lists)), sizes)
                often = np.fromiter((frequent.get(w, 0) for w in words), dtype=np.int64, count=len(words))
                known = np.bincount(owner[often > 0], minlength=len(lists)) + (end > 0)
                logs = np.bincount(owner, np.log10(often + 1.0), minlength=len(lists)) + np.log10(end + 1.0)
                lattice = np.bincount(owner, cache.scores(words)[:, 0], minlength=len(lists)) + log_end
                seldom = np.flatnonzero(often == 0)
                bounds = np.concatenate([[0], np.cumsum(np.bincount(owner[seldom], minlength=len(lists)))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(sizes + 1), pa.array(known.astype(np.int64)),
                     pa.array(logs), pa.array(lattice / np.log(10.0)),
                     pa.ListArray.from_arrays(pa.array(bounds), pa.array([words[i] for i in seldom], pa.binary()))],
                    names=schema.names,
                )

    scored = settle(rows.mapInArrow(run, schema), "lattice-scores")
    looked_up = (
        scored.select("row", F.explode("rare").alias("word"))
        .join(model.counts, "word")
        .groupBy("row")
        .agg(F.count("*").alias("more"), F.sum(F.log10(F.col("n") + 1.0)).alias("more_logs"))
    )
    size = float(np.log10(model.n_tokens + model.n_distinct + 1))
    return scored.join(looked_up, "row", "left").select(
        F.col("id").alias(id_col), "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).cast("long").alias("n_known"),
        F.lit(model.n_tokens).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) - F.col("n_tokens") * F.lit(size)).alias("base_score"),
        "score",
    )
