"""Repetition rules: characters inside duplicated n-grams and lines, measured with rolling hashes in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tallyframe.llm import spans as S

# Published thresholds for repetition in web text, per cent of the word characters inside
# duplicated n-grams, by n; of lines and of their characters; symbols per 100 words.
GRAM_PERCENT = {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10}
LINE_PERCENT = 30
LINE_CHAR_PERCENT = 20
SYMBOL_PERCENT = 10
WINDOW = 3

_SYMBOLS = np.zeros(256, dtype=bool)
_SYMBOLS[list(b"#*$%&|<>")] = True

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MEASURES = ("n_lines", "dup_line_chars", *(f"dup_{n}gram_chars" for n in GRAM_PERCENT))


def _per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of ``flags`` between consecutive bounds."""
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _repeated(keys: np.ndarray, later: bool) -> np.ndarray:
    """Which keys occur twice or more; with ``later`` only those equal to an earlier one."""
    ordered = np.sort(keys)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(len(keys), dtype=bool)
    place = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    found = twice[place] == keys
    if later:
        which = np.flatnonzero(found)
        found[which[np.unique(keys[which], return_index=True)[1]]] = False
    return found


def _owned(hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Hashes that are equal only within one text."""
    with np.errstate(over="ignore"):
        return hashes + S.mix(owner + 1)


def measure(texts: list[bytes]) -> dict[str, np.ndarray]:
    """All counts of :data:`COUNTS` and :data:`MEASURES` for whole texts, one array each."""
    spans = S.word_spans(texts)
    owner = spans.owner
    heads = (spans.buffer & 0xC0) != 0x80
    blank = S.BLANKS[spans.buffer]
    letters = np.concatenate([[0], np.cumsum(heads & ~blank, dtype=np.int64)])
    hashes = S.span_hash(spans.buffer, spans.starts, spans.ends)
    chars = letters[spans.ends] - letters[spans.starts]
    out = {
        "n_words": np.diff(spans.bounds),
        "word_chars": letters[spans.offsets[1:]] - letters[spans.offsets[:-1]],
        "n_symbols": _per_text(_SYMBOLS[spans.buffer], spans.offsets),
    }
    ends = np.flatnonzero(spans.buffer == 0x0A)
    starts = np.concatenate([[0], ends[:-1] + 1])
    worded = letters[ends] > letters[starts]
    starts, ends = starts[worded], ends[worded]
    bounds = np.searchsorted(starts, spans.offsets)
    whose = np.repeat(np.arange(len(texts)), np.diff(bounds))
    keys = _owned(S.span_hash(spans.buffer, starts, ends), whose)
    first = np.zeros(len(keys), dtype=bool)
    first[np.unique(keys, return_index=True)[1]] = True
    out["n_lines"] = np.diff(bounds)
    out["n_dup_lines"] = _per_text(~first, bounds)
    out["dup_line_chars"] = _per_text(np.where(first, 0, letters[ends] - letters[starts]), bounds)
    for length in (WINDOW, *GRAM_PERCENT):
        at = S.windows_inside(spans, length)
        inside = np.zeros(len(owner) + 1, dtype=np.int64)
        if len(at):
            twice = at[_repeated(_owned(S.gram_hash(hashes, length)[at], owner[at]), later=length != WINDOW)]
            np.add.at(inside, twice, 1)
            np.subtract.at(inside, twice + length, 1)
        covered = np.cumsum(inside[:-1]) > 0
        if length == WINDOW:
            out["n_repeat_words"] = _per_text(covered, spans.bounds)
        else:
            out[f"dup_{length}gram_chars"] = _per_text(np.where(covered, chars, 0), spans.bounds)
    return out


def verdicts(m: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(base_failed, kept) by integer comparisons only."""
    base_failed = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
    bad = base_failed | (100 * m["n_symbols"] > SYMBOL_PERCENT * m["n_words"])
    bad |= 100 * m["n_dup_lines"] > LINE_PERCENT * m["n_lines"]
    bad |= 100 * m["dup_line_chars"] > LINE_CHAR_PERCENT * m["word_chars"]
    for length, percent in GRAM_PERCENT.items():
        bad |= 100 * m[f"dup_{length}gram_chars"] > percent * m["word_chars"]
    return base_failed, ~bad


def repetition_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, counts, measures, base_failed, kept) for every row, over its whole text.

    Null and empty texts have no words: all counts are zero, ``base_failed`` is true and they
    are not kept.  Repeated ids are judged row by row; other columns are left out, so
    their names do not matter.  Duplicate n-grams and
    lines are those equal to an earlier one of the text; only the three-word windows of ``n_repeat_words``
    count with their first occurrence too.  Texts are measured in
    pieces of about two megabytes of whole texts, so memory follows the longest text.
    """
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    kind = rows.schema["id"].dataType
    names = (*COUNTS, *MEASURES)
    schema = T.StructType(
        [T.StructField(id_col, kind)]
        + [T.StructField(n, T.LongType()) for n in names]
        + [T.StructField(n, T.BooleanType()) for n in ("base_failed", "kept")]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = S.texts_of(batch.column(1))
            for lo, hi in S.chunks(texts):
                m = measure(texts[lo:hi])
                base_failed, kept = verdicts(m)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo)]
                    + [pa.array(m[n].astype(np.int64)) for n in names]
                    + [pa.array(base_failed), pa.array(kept)],
                    names=[id_col, *names, "base_failed", "kept"],
                )

    return rows.mapInArrow(run, schema)
