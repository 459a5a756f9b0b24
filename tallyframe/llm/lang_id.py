"""Language identification by segmentation-marginalised unigrams over a fixed piece vocabulary."""

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

UNKNOWN = "und"
# Distinct words that a task holds before it turns them into piece counts.
_HELD_WORDS = 300_000


@dataclass
class LanguageModel:
    vocabulary: Vocabulary
    languages: list[str]
    #: Log probability of each piece (rows) in each language (columns).
    log_weights: np.ndarray


def _words(text: bytes) -> list[bytes]:
    return text.decode("utf-8", "replace").lower().encode().split()


def fit_languages(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text", lang_col: str = "lang", smoothing: float = 0.5) -> LanguageModel:
    """Piece probabilities per language, from all rows with a text and a language.

    Each task sums, per language, the expected use of every piece over all segmentations of its words
    (weighted by the vocabulary's own scores); the sums meet in one row per language and piece, a number that does
    not depend on the number of documents.  ``smoothing`` is added to every count.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")
    )
    pieces = len(vocabulary.pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}
        sums: dict[str, np.ndarray] = {}

        def settle_words() -> None:
            for lang, words in held.items():
                counts = np.fromiter(words.values(), dtype=np.float64, count=len(words))
                part = expected_counts(list(words), counts, vocabulary, vocabulary.prior)
                sums[lang] = sums.get(lang, 0) + part
            held.clear()

        for batch in batches:
            for text, lang in zip(S.texts_of(batch.column(0)), batch.column(1).to_pylist()):
                held.setdefault(lang, Counter()).update(_words(text))
                if sum(map(len, held.values())) > _HELD_WORDS:
                    settle_words()
        settle_words()
        for lang, part in sums.items():
            used = np.flatnonzero(part)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * (len(used) + 1)), pa.array(np.append(used, -1)), pa.array(np.append(part[used], 0.0))],
                names=["lang", "piece", "used"],
            )

    found = (
        rows.mapInArrow(run, "lang string, piece long, used double").groupBy("lang", "piece").agg(F.sum("used").alias("used")).toArrow()
    )
    languages = sorted(set(found["lang"].to_pylist()))
    column = {lang: i for i, lang in enumerate(languages)}
    counts = np.zeros((pieces, len(languages)))
    for lang, piece, used in zip(found["lang"].to_pylist(), found["piece"].to_pylist(), found["used"].to_pylist()):
        if piece >= 0:
            counts[piece, column[lang]] = used
    counts += smoothing
    return LanguageModel(vocabulary, languages, np.log(counts / counts.sum(axis=0)))


def predict_language(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) for every row over its whole text; ``score`` is the posterior of the chosen language.

    A null text, a text without any letter and a model without languages give ``und`` and 0.
    Equal posteriors go to the language first in order.  Ids may repeat or be null; other columns are not looked at.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType(
        [T.StructField(id_col, rows.schema["id"].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordCache(model.vocabulary, model.log_weights)
        names = np.array([*model.languages, UNKNOWN], dtype=object)
        for batch in batches:
            texts = S.texts_of(batch.column(1))
            for lo, hi in S.chunks(texts):
                part = [t.decode("utf-8", "replace") for t in texts[lo:hi]]
                lettered = np.array([any(map(str.isalpha, t)) for t in part], dtype=bool)
                lists = [t.lower().encode().split() if has else [] for t, has in zip(part, lettered)]
                words = [w for each in lists for w in each]
                owner = np.repeat(np.arange(len(part)), [len(each) for each in lists])
                best, score = np.full(len(part), len(model.languages)), np.zeros(len(part))
                if words and model.languages:
                    by_word = cache.scores(words)
                    total = np.stack([np.bincount(owner, c, minlength=len(part)) for c in by_word.T], axis=1)
                    top = total.max(axis=1)
                    best = np.where(lettered, total.argmax(axis=1), best)
                    score = np.where(lettered, 1.0 / np.exp(total - top[:, None]).sum(axis=1), 0.0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(names[best].tolist(), pa.string()), pa.array(score)],
                    names=[id_col, "lang_pred", "score"],
                )

    return rows.mapInArrow(run, schema)
