"""Quality classifier: random-indexing word vectors, pooled per document, under a two-layer network in numpy.

A word's vector is the sum of fixed sparse random vectors of the words next to it, over all
occurrences in all documents.  Words share a fixed number of rows by hash, so the
table of vectors has one size for any corpus.  A document is the mean and spread of its words' vectors.  The network's
probabilities are calibrated by one temperature on labelled rows that it was not trained on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.llm import spans as S
from tallyframe.storage import settle

ROWS = 1 << 14  # rows that words share
DIMS = 32
REACH = 2  # neighbours on either side
NONZERO = 4  # entries of a word's random vector
#: The network is fitted on at most this many distinct labelled documents (id and text), taken by the hash of their ids.
TRAIN_ROWS = 20_000
HIDDEN = 32
FEATURES = 2 * DIMS + 4
ROUNDS = 400

# Classes of bytes: 0 blank, 1 letter or digit (any non-ASCII), 2 other signs; a word is a run of one class.
_CLASS = np.full(256, 2, dtype=np.int8)
_CLASS[S.BLANKS] = 0
_CLASS[[b for b in range(256) if b >= 0x80 or chr(b).isalnum()]] = 1


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words of all texts, bounds of each text)."""
    joined = b"\n".join(texts) + b"\n"
    buffer = np.frombuffer(joined, dtype=np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    kind = np.concatenate([[0], _CLASS[buffer]])
    edge = np.flatnonzero(kind[1:] != kind[:-1])
    starts = edge[kind[edge + 1] != 0]
    ends = np.append(edge, len(buffer))[np.searchsorted(edge, starts) + 1]
    return S.span_hash(buffer, starts, ends), np.searchsorted(starts, offsets)


def _row(hashes: np.ndarray) -> np.ndarray:
    return (hashes % np.uint64(ROWS)).astype(np.int64)


def _add_contexts(sums: np.ndarray, texts: list[bytes]) -> None:
    """Add the random vectors of the neighbours of every word to ``sums`` (words' rows by DIMS, flat)."""
    hashes, bounds = _words(texts)
    row = _row(hashes) * DIMS
    owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
    draw = S.mix(hashes ^ np.uint64(0x5DEECE66D))
    for k in range(NONZERO):
        bits = (draw >> np.uint64(16 * k)) & np.uint64(0xFFFF)
        place = (bits % np.uint64(DIMS)).astype(np.int64)
        sign = np.where(bits & np.uint64(0x8000), 1.0, -1.0)
        for gap in range(1, REACH + 1):
            same = np.flatnonzero(owner[gap:] == owner[:-gap])
            sums += np.bincount(row[same] + place[same + gap], sign[same + gap], minlength=len(sums))
            sums += np.bincount(row[same + gap] + place[same], sign[same], minlength=len(sums))


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Unit vectors of all word rows, from all documents: tasks add up whole numbers, so their order does not matter."""
    names = [f"v{i}" for i in range(DIMS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(ROWS * DIMS)
        for batch in batches:
            texts = S.texts_of(batch.column(0))
            for lo, hi in S.chunks(texts):
                _add_contexts(sums, texts[lo:hi])
        table = sums.reshape(ROWS, DIMS).astype(np.int64)
        used = np.flatnonzero(table.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used)] + [pa.array(c) for c in table[used].T], names=["row", *names])

    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(text_col).cast("string"))
    parts = texts.mapInArrow(run, "row long, " + ", ".join(f"{n} long" for n in names))
    found = parts.groupBy("row").agg(*(F.sum(n).alias(n) for n in names)).toArrow()
    vectors = np.zeros((ROWS, DIMS))
    if found.num_rows:
        vectors[found["row"].to_numpy()] = np.stack([found[n].to_numpy() for n in names], axis=1)
    size = np.linalg.norm(vectors, axis=1, keepdims=True)
    return (vectors / np.where(size == 0, 1.0, size)).astype(np.float32)


def pooled(texts: list[bytes], vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of the word vectors, the size of the mean, the log of the word count, per whole text; and
    of neighbouring words, the mean product of their vectors and the share with one vector."""
    out = np.zeros((len(texts), FEATURES), dtype=np.float32)
    hashes, bounds = _words(texts)
    count = np.diff(bounds)
    some = np.flatnonzero(count)
    if len(some):
        taken = vectors[_row(hashes)]
        mean = np.add.reduceat(taken, bounds[:-1][some], axis=0) / count[some, None]
        close = np.zeros(len(taken), dtype=np.float32)
        close[1:] = np.einsum("ij,ij->i", taken[1:], taken[:-1])
        close[bounds[:-1][some]] = 0
        near = np.stack([close, close > 0.9999], axis=1)
        near = np.add.reduceat(near, bounds[:-1][some], axis=0) / count[some, None]
        taken *= taken
        square = np.add.reduceat(taken, bounds[:-1][some], axis=0) / count[some, None]
        out[some] = np.hstack([
            mean, np.sqrt(np.maximum(square - mean * mean, 0)), np.linalg.norm(mean, axis=1, keepdims=True), np.log1p(count[some, None]), near,
        ])
    return out


@dataclass
class QualityModel:
    vectors: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    temperature: float
    learned: bool = True  # whether there was a label to learn from

    def logits(self, features: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh((features - self.centre) / self.scale @ w1 + b1) @ w2 + b2

    def scores(self, features: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.logits(features) / self.temperature, -500, 500)))


def fit_network(vectors: np.ndarray, features: np.ndarray, labels: np.ndarray, checking: np.ndarray) -> QualityModel:
    """Full-batch training on the rows not in ``checking``, then one temperature on the rows in it.

    Without rows of both classes the score is the share of good rows (a half without any).
    """
    features = features.astype(np.float64)
    width = features.shape[1]
    share = (labels.sum() + 0.5) / (len(labels) + 1.0)
    flat = [np.zeros((width, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), np.array(np.log(share / (1 - share)))]
    model = QualityModel(vectors, np.zeros(width), np.ones(width), flat, 1.0, len(labels) > 0)
    if not len(labels) or labels.min() == labels.max():
        return model
    learn = ~checking if 0 < checking.sum() < len(labels) else np.ones(len(labels), dtype=bool)
    model.centre, model.scale = features[learn].mean(axis=0), features[learn].std(axis=0) + 1e-6
    x, y = (features[learn] - model.centre) / model.scale, labels[learn]
    pick = np.random.default_rng(7)
    w = model.layers = [pick.normal(0, width**-0.5, (width, HIDDEN)), np.zeros(HIDDEN), pick.normal(0, HIDDEN**-0.5, HIDDEN), flat[3].copy()]
    first, second = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w]
    for step in range(1, ROUNDS + 1):
        hidden = np.tanh(x @ w[0] + w[1])
        error = (1.0 / (1.0 + np.exp(-np.clip(hidden @ w[2] + w[3], -500, 500))) - y) / len(y)
        back = np.outer(error, w[2]) * (1 - hidden**2)
        slopes = [x.T @ back + 1e-4 * w[0], back.sum(axis=0), hidden.T @ error + 1e-4 * w[2], error.sum()]
        for k, slope in enumerate(slopes):
            first[k] = 0.9 * first[k] + 0.1 * slope
            second[k] = 0.999 * second[k] + 0.001 * slope**2
            w[k] = w[k] - 0.02 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    held = checking if checking.any() else learn
    logits, truth = model.logits(features[held]), labels[held]
    tried = np.geomspace(0.25, 8.0, 61)
    losses = [np.mean(np.logaddexp(0, logits / t) - truth * logits / t) for t in tried]
    model.temperature = float(tried[int(np.argmin(losses))])
    return model


def fit_quality(
    docs: DataFrame, labels: DataFrame, label_col: str = "quality", train_rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text",
    vector_docs: DataFrame | None = None,
) -> QualityModel:
    """Word vectors from ``vector_docs`` (all documents, unlabelled) and a network from the labelled rows of ``docs``.

    Rows that repeat an id and a text are one; ``train_rows`` bounds what is left, which the driver collects.

    ``labels`` has (id, label 0/1); an id labelled twice counts with its mean label, ids or labels that are
    null are left out, and so are labels without a document.
    """
    vectors = word_vectors(docs if vector_docs is None else vector_docs, text_col)
    known = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
        .groupBy(F.col(id_col).alias("id")).agg(F.avg(label_col).alias("label"))
    )
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.where("text is not null").withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64("text", F.lit(1))})
    listed = rows.select("id", "h1", "h2").distinct().join(known, "id")
    chosen = settle(listed.orderBy(F.xxhash64("id"), "id", "h1", "h2").limit(train_rows), "labelled")
    schema = T.StructType(
        [T.StructField("id", rows.schema["id"].dataType), T.StructField("label", T.DoubleType()), T.StructField("checking", T.BooleanType()),
         T.StructField("features", T.BinaryType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = S.texts_of(batch.column(3))
            for lo, hi in S.chunks(texts):
                part = [r.tobytes() for r in pooled(texts[lo:hi], vectors)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(k).slice(lo, hi - lo) for k in range(3)] + [pa.array(part, pa.binary())], names=schema.names
                )

    checking = (F.xxhash64("id", F.lit(1)) % 5 == 0).alias("checking")
    once = rows.join(chosen, ["id", "h1", "h2"]).groupBy("id", "h1", "h2").agg(F.first("label").alias("label"), F.first("text").alias("text"))
    table = once.select("id", "label", checking, "text").mapInArrow(run, schema).toArrow()
    table = table.sort_by([("id", "ascending"), ("features", "ascending")])
    features = np.frombuffer(b"".join(table["features"].to_pylist()), dtype=np.float32).reshape(table.num_rows, FEATURES)
    return fit_network(vectors, features, table["label"].to_numpy(), np.array(table["checking"].to_pylist(), dtype=bool))


def score_quality(docs: DataFrame, model: QualityModel, columns: list[str], text_col: str = "text", score_col: str = "score") -> DataFrame:
    """The given columns of every row and its score from 0 to 1, over its whole text; a null text counts as empty.

    Empty texts get the score that the network gives a document without words.  Repeated rows are scored
    each; a column that is already called ``score_col`` is an error.
    """
    if score_col in columns:
        raise ValueError(f"there is a column {score_col!r} already")
    rows = docs.select(F.col(text_col).cast("string").alias("__text"), *columns)
    schema = T.StructType([*rows.schema.fields[1:], T.StructField(score_col, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = S.texts_of(batch.column(0))
            for lo, hi in S.chunks(texts):
                score = model.scores(pooled(texts[lo:hi], model.vectors))
                kept = [batch.column(k).slice(lo, hi - lo) for k in range(1, batch.num_columns)]
                yield pa.RecordBatch.from_arrays(kept + [pa.array(score)], names=schema.names)

    return rows.mapInArrow(run, schema)
