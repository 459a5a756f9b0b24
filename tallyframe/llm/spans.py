"""Words and lines of many UTF-8 texts at once, as numpy spans over one byte buffer, with 64-bit span hashes.

Texts are handled as bytes: a batch is joined with line feeds (a separator in every
word rule used here), so one pass over the buffer serves all its texts and
offsets tell whose bytes are whose.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

# Bytes handled together.  Long texts form a batch of their own, whole.
CHUNK_BYTES = 1 << 21

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)

#: White space of the word rule ``[^\x20\x09-\x0D]+``.
BLANKS = np.zeros(256, dtype=bool)
BLANKS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Separators of the rule ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` on lower-cased text.
NOT_ALNUM = np.zeros(256, dtype=bool)
NOT_ALNUM[:0x30] = NOT_ALNUM[0x3A:0x61] = NOT_ALNUM[0x7B:0x80] = True
#: A-Z to a-z, all other bytes as they are.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 of a string column; a null is an empty text."""
    return [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]


def chunks(texts: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Index ranges of about ``limit`` bytes; every text is in exactly one of them."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        if held and held + len(text) > limit:
            yield start, i
            start, held = i, 0
        held += len(text) + 1
    if start < len(texts):
        yield start, len(texts)


@dataclass
class Spans:
    """``starts``/``ends`` (bytes) of the words of a buffer; ``bounds`` (words) of each text."""

    buffer: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def word_spans(texts: list[bytes], separators: np.ndarray = BLANKS, lower: bool = False) -> Spans:
    joined = b"\n".join(texts) + b"\n"
    buffer = np.frombuffer(joined.translate(LOWER) if lower else joined, dtype=np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
    inside = np.zeros(len(buffer) + 1, dtype=np.int8)
    inside[1:] = ~separators[buffer]
    edges = np.diff(inside)
    starts = np.flatnonzero(edges == 1)
    ends = np.flatnonzero(edges == -1)
    return Spans(buffer, offsets, starts, ends, np.searchsorted(starts, offsets))


def mix(values: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values (multiply and shift, twice)."""
    values = values.astype(np.uint64, copy=True)
    values ^= values >> np.uint64(31)
    values *= np.uint64(0x7FB5D329728EA185)
    values ^= values >> np.uint64(27)
    values *= np.uint64(0x81DADEF4BC2DD44D)
    values ^= values >> np.uint64(33)
    return values


def span_hash(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each span: a rolling polynomial, equal for equal bytes anywhere."""
    with np.errstate(over="ignore"):
        powers = np.full(len(buffer), _BASE, dtype=np.uint64)
        powers[:1] = 1
        np.multiply.accumulate(powers, out=powers)
        prefix = np.zeros(len(buffer) + 1, dtype=np.uint64)
        np.cumsum(_BYTE_VALUES[buffer] * powers, out=prefix[1:])
        inverse = np.full(len(buffer) + 1, _INVERSE, dtype=np.uint64)
        inverse[0] = 1
        np.multiply.accumulate(inverse, out=inverse)
        return mix((prefix[ends] - prefix[starts]) * inverse[starts])


def gram_hash(words: np.ndarray, length: int) -> np.ndarray:
    """Rolling hash of every window of ``length`` consecutive word hashes (windows may span texts)."""
    count = len(words) - length + 1
    if count <= 0:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        total = words[:count].copy()
        for k in range(1, length):
            total *= _BASE
            total += words[k : k + count]
        return mix(total)


def windows_inside(spans: Spans, length: int) -> np.ndarray:
    """Start words of the windows of ``length`` words that lie within one text."""
    first, last = spans.bounds[:-1], spans.bounds[1:] - length + 1
    count = np.maximum(last - first, 0)
    skip = np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count)
    return np.arange(count.sum()) + skip
