"""Piece lattices: the sum over all segmentations of a word into the pieces of a fixed vocabulary.

The vocabulary is that of a public tokenizer file; nothing is trained into it.  A word
is spelled with a leading blank that stands for the word-start sign; byte pieces make every
word spellable.  Forward and backward recursions run in log space over many words of
equal length at once, for one or several piece distributions.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

from tallyframe.llm.spans import mix

_NEVER = -1e30
_BASE = np.uint64(0x9E3779B97F4A7C15)
_FILTER_BITS = 20
# Words handled together, in bytes of their spelling.
_GROUP_BYTES = 1 << 15


class Vocabulary:
    """Spellings of the pieces, in the order of their ids, and a lookup of byte substrings."""

    def __init__(self, pieces: list[bytes], weights: np.ndarray):
        if len(set(pieces)) != len(pieces) or b"" in pieces:
            raise ValueError("pieces must differ and not be empty")
        self.pieces = pieces
        self.longest = max(map(len, pieces))
        #: Log weight of each piece by the vocabulary's own scores, normalised.
        self.prior = weights - np.log(np.exp(weights - weights.max()).sum()) - weights.max()
        hashes = np.array([_poly(p) for p in pieces], dtype=np.uint64)
        self._order = np.argsort(hashes).astype(np.int32)
        self._hashes = hashes[self._order]
        if (self._hashes[1:] == self._hashes[:-1]).any():
            raise ValueError("two pieces have the same hash")
        self._filter = np.zeros(1 << _FILTER_BITS, dtype=bool)
        self._filter[self._slot(hashes)] = True
        self._by_length = sorted({len(p) for p in pieces})

    @classmethod
    def from_sentencepiece(cls, path: str) -> Vocabulary:
        """Normal and byte pieces of a model file.

        Its scores fall by one per id (they are merge ranks), so the weight of the piece of rank r is taken
        as 1 / (r + 10), the usual law of word frequencies; byte pieces are ranked last.
        """
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        score: dict[bytes, float] = {}
        spare: list[bytes] = []
        for i in range(model.get_piece_size()):
            if model.is_byte(i):
                spare.append(bytes([int(model.id_to_piece(i)[3:5], 16)]))
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                piece = model.id_to_piece(i)
                if "▁" not in piece[1:]:
                    score.setdefault(piece.replace("▁", " ").encode(), model.get_score(i))
        pieces = sorted(score, key=lambda p: (-score[p], p))
        pieces += sorted(set(spare) - set(pieces))
        return cls(pieces, -np.log(np.arange(len(pieces)) + 10.0))

    @staticmethod
    def _slot(hashes: np.ndarray) -> np.ndarray:
        return (mix(hashes) >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Piece ids of substring hashes; the number of pieces where there is none."""
        flat = hashes.ravel()
        out = np.full(len(flat), len(self.pieces), dtype=np.int32)
        near = np.flatnonzero(self._filter[self._slot(flat)])
        wanted = flat[near]
        place = np.minimum(np.searchsorted(self._hashes, wanted), len(self._hashes) - 1)
        found = self._hashes[place] == wanted
        out[near[found]] = self._order[place[found]]
        return out.reshape(hashes.shape)

    def arcs(self, words: np.ndarray) -> dict[int, np.ndarray]:
        """Ids of the pieces that start at each byte, by piece length, for words (rows) of equal length."""
        count, size = words.shape
        with np.errstate(over="ignore"):
            prefix = np.zeros((count, size + 1), dtype=np.uint64)
            for j in range(size):
                prefix[:, j + 1] = prefix[:, j] * _BASE + words[:, j] + np.uint64(1)
            power, found = np.uint64(1), {}
            for length in range(1, min(self.longest, size) + 1):
                power = power * _BASE
                if length in self._by_length:
                    found[length] = self.find(prefix[:, length:] - prefix[:, :-length] * power)
        return found


def _poly(piece: bytes) -> int:
    value = 0
    for byte in piece:
        value = (value * int(_BASE) + byte + 1) & 0xFFFFFFFFFFFFFFFF
    return value


def _log_sum(terms: list[np.ndarray]) -> np.ndarray:
    if len(terms) == 1:
        return terms[0]
    stacked = np.stack(terms)
    top = stacked.max(axis=0)
    return top + np.log(np.exp(stacked - top).sum(axis=0))


def _padded(log_weights: np.ndarray) -> np.ndarray:
    """One row per piece and a last one for "no such piece", one column per distribution."""
    columns = log_weights.reshape(len(log_weights), -1)
    return np.vstack([columns, np.full((1, columns.shape[1]), _NEVER)])


def _groups(words: list[bytes]) -> Iterable[tuple[np.ndarray, np.ndarray]]:
    """(positions, bytes as a matrix) of words of equal length, with the leading blank."""
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    order = np.argsort(lengths, kind="stable")
    edges = np.flatnonzero(np.diff(lengths[order])) + 1
    for same in np.split(order, edges):
        if len(same):
            size = int(lengths[same[0]]) + 1
            step = max(1, _GROUP_BYTES // size)
            for lo in range(0, len(same), step):
                part = same[lo : lo + step]
                joined = b"".join(b" " + words[i] for i in part)
                yield part, np.frombuffer(joined, dtype=np.uint8).reshape(len(part), size)


def _forward(arcs: dict[int, np.ndarray], weights: np.ndarray, size: int) -> list[np.ndarray]:
    count = len(next(iter(arcs.values())))
    alpha = [np.zeros((count, weights.shape[1]))]
    for j in range(1, size + 1):
        alpha.append(_log_sum([alpha[j - n] + weights[ids[:, j - n]] for n, ids in arcs.items() if n <= j]))
    return alpha


def word_scores(words: list[bytes], vocabulary: Vocabulary, log_weights: np.ndarray) -> np.ndarray:
    """Natural log of the summed probability of all segmentations: one row per word, one column per distribution."""
    weights = _padded(log_weights)
    out = np.empty((len(words), weights.shape[1]))
    for place, matrix in _groups(words):
        out[place] = _forward(vocabulary.arcs(matrix), weights, matrix.shape[1])[-1]
    return out


def expected_counts(words: list[bytes], counts: np.ndarray, vocabulary: Vocabulary, log_weights: np.ndarray) -> np.ndarray:
    """How often each piece is used, on average over all segmentations of the words by their probability."""
    weights = _padded(log_weights)
    total = np.zeros(len(weights))
    for place, matrix in _groups(words):
        size = matrix.shape[1]
        arcs = vocabulary.arcs(matrix)
        alpha = _forward(arcs, weights, size)
        beta = [None] * size + [np.zeros_like(alpha[0])]
        for j in range(size - 1, -1, -1):
            beta[j] = _log_sum([beta[j + n] + weights[ids[:, j]] for n, ids in arcs.items() if j + n <= size])
        often = counts[place][:, None]
        for n, ids in arcs.items():
            start = np.stack(alpha[: size - n + 1], axis=1)[:, :, 0]
            end = np.stack(beta[n:], axis=1)[:, :, 0]
            share = np.exp(start + weights[ids][:, :, 0] + end - alpha[-1])
            total += np.bincount(ids.ravel(), (share * often).ravel(), minlength=len(weights))
    return total[:-1]


class WordCache:
    """Scores of the words met by one task; emptied when it holds ``limit`` words, so memory is bounded."""

    def __init__(self, vocabulary: Vocabulary, log_weights: np.ndarray, limit: int = 300_000):
        self.vocabulary, self.log_weights, self.limit = vocabulary, log_weights, limit
        self._clear()

    def _clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.rows = np.zeros((0, self.log_weights.reshape(len(self.log_weights), -1).shape[1]))

    def scores(self, words: list[bytes]) -> np.ndarray:
        """One row of log probabilities per given word."""
        if len(self.index) > self.limit:
            self._clear()
        new = list(set(words).difference(self.index))
        if new:
            start = len(self.index)
            fresh = word_scores(new, self.vocabulary, self.log_weights)
            if len(self.rows) < start + len(new):
                grown = np.empty((2 * start + len(new), fresh.shape[1]))
                grown[:start] = self.rows[:start]
                self.rows = grown
            self.rows[start : start + len(new)] = fresh
            self.index.update(zip(new, range(start, start + len(new))))
        return self.rows[np.fromiter(map(self.index.__getitem__, words), dtype=np.int64, count=len(words))]
