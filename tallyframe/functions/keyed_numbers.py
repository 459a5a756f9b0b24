"""The keyed hash of :func:`hash60` for many consecutive numbers under one key, on arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_SHIFTS = [s for row in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in row * 4]
_WORDS = [i if i < 16 else (5 * i + 1) % 16 if i < 32 else (3 * i + 5) % 16 if i < 48 else 7 * i % 16 for i in range(64)]
_SINES = [int(abs(np.sin(np.float64(i + 1))) * 2**32) for i in range(64)]
_STEPS = [(i // 16, w, k, np.uint32(s), np.uint32(32 - s)) for i, (w, k, s) in enumerate(zip(_WORDS, _SINES, _SHIFTS))]

#: Numbers hashed together: their state stays in the processor's cache.
_TOGETHER = 16384


def _digest_words(words: list[int | np.ndarray], size: int) -> list[np.ndarray]:
    """State of MD5 after the blocks of ``words``, each a number for all messages or an array with one per message."""
    state = [np.full(size, word, dtype=np.uint32) for word in _START]
    mixed, turned = np.empty(size, dtype=np.uint32), np.empty(size, dtype=np.uint32)
    for first in range(0, len(words), 16):
        a, b, c, d = (word.copy() for word in state)
        for kind, place, sine, left, right in _STEPS:
            if kind == 0:
                np.bitwise_xor(c, d, out=mixed)
                np.bitwise_and(mixed, b, out=mixed)
                np.bitwise_xor(mixed, d, out=mixed)
            elif kind == 1:
                np.bitwise_xor(b, c, out=mixed)
                np.bitwise_and(mixed, d, out=mixed)
                np.bitwise_xor(mixed, c, out=mixed)
            elif kind == 2:
                np.bitwise_xor(b, c, out=mixed)
                np.bitwise_xor(mixed, d, out=mixed)
            else:
                np.invert(d, out=mixed)
                np.bitwise_or(mixed, b, out=mixed)
                np.bitwise_xor(mixed, c, out=mixed)
            word = words[first + place]
            np.add(a, mixed, out=a)
            if isinstance(word, int):
                np.add(a, np.uint32((word + sine) & 0xFFFFFFFF), out=a)
            else:
                np.add(a, word, out=a)
                np.add(a, np.uint32(sine), out=a)
            np.left_shift(a, left, out=turned)
            np.right_shift(a, right, out=a)
            np.bitwise_or(a, turned, out=a)
            np.add(a, b, out=a)
            a, b, c, d = d, a, b, c
        for total, word in zip(state, (a, b, c, d)):
            np.add(total, word, out=total)
    return state


def _same_length(prefix: bytes, first: int, last: int, digits: int) -> np.ndarray:
    """Hashes of the numbers from ``first`` up to ``last``, all of ``digits`` digits."""
    length = len(prefix) + digits
    whole = prefix + bytes(digits) + b"\x80" + bytes(-(length + 9) % 64) + (8 * length).to_bytes(8, "little")
    words: list[int | np.ndarray] = np.frombuffer(whole, dtype="<u4").tolist()
    rest = np.arange(first, last, dtype=np.uint64)
    for at in range(length - 1, len(prefix) - 1, -1):
        above = rest // np.uint64(10)
        digit = (rest - above * np.uint64(10) + np.uint64(48)).astype(np.uint32) << np.uint32(at % 4 * 8)
        word = words[at // 4]
        words[at // 4] = digit + np.uint32(word) if isinstance(word, int) else digit + word
        rest = above
    high, low = (word.byteswap().astype(np.uint64) for word in _digest_words(words, last - first)[:2])
    return (high << np.uint64(28)) | (low >> np.uint64(4))


def hash60_of_numbers(prefix: str, first: int, last: int) -> Iterator[np.ndarray]:
    """``hash60(prefix, k)`` for k from ``first`` up to ``last`` without it, none negative, in arrays of some thousand."""
    key = f"{prefix}|".encode()
    while first < last:
        digits = len(str(first))
        upto = min(last, first + _TOGETHER, 10**digits)
        yield _same_length(key, first, upto, digits)
        first = upto
