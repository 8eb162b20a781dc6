"""Words of many texts at once as arrays, and hashes of them. Helpers for the code inside Spark tasks."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
"""Lower-cases A to Z and nothing else."""

BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
"""Bytes that end a word: space, tab, line feed, vertical tab, form feed, carriage return."""

NOT_ALNUM = ~((np.arange(256) >= 0x80) | np.isin(np.arange(256), [*range(0x30, 0x3A), *range(0x61, 0x7B)]))
"""After lower-casing: every ASCII byte but digits and letters. Bytes of other characters belong to words."""

CHUNK = 1 << 20
"""Bytes of text that are taken together; a longer text is taken alone."""

_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS = {}


class Words(NamedTuple):
    """Words of several texts in order. ``first[i]:first[i + 1]`` are the words of text ``i``."""

    data: bytes
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    first: np.ndarray


def chunks(values: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """Texts as UTF-8 with the index of the first; a null is an empty text."""
    batch: list[bytes] = []
    begin = size = 0
    for i in range(len(values)):
        value = values[i].as_py()
        value = b"" if value is None else value.encode("utf-8") if isinstance(value, str) else value
        if batch and size + len(value) > CHUNK:
            yield begin, batch
            batch, begin, size = [], i, 0
        batch.append(value)
        size += len(value)
    if batch:
        yield begin, batch


def words(texts: list[bytes], separators: np.ndarray, lower: bool) -> Words:
    data = b" ".join(texts) + b" "
    if lower:
        data = data.translate(LOWER)
    is_word = np.zeros(len(data) + 1, dtype=np.int8)
    is_word[1:] = ~separators[np.frombuffer(data, dtype=np.uint8)]
    edge = np.diff(is_word)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    limits = np.cumsum([len(t) + 1 for t in texts])
    first = np.concatenate([[0], np.searchsorted(start, limits)])
    return Words(data, start, end, np.repeat(np.arange(len(texts)), np.diff(first)), first)


def _powers(base: int, n: int) -> np.ndarray:
    table = _POWERS.get(base)
    if table is None or len(table) < n:
        steps = np.full(max(n, CHUNK + 4096), base, dtype=np.uint64)
        steps[0] = 1
        table = np.multiply.accumulate(steps)
        if n <= 8 * CHUNK:  # a single very long text does not keep its table
            _POWERS[base] = table
    return table[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _spans(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Hash of ``values[start:end]`` for each pair, the same for equal content at any place."""
    n = len(values)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(values * _powers(base, n), out=total[1:])
    inverse = _powers(pow(base, -1, 1 << 64), n + 1)
    return mix((total[end] - total[start]) * inverse[start])


def word_hashes(w: Words) -> np.ndarray:
    data = np.frombuffer(w.data, dtype=np.uint8).astype(np.uint64) + np.uint64(1)
    return _spans(data, w.start, w.end, _BASE)


def prefix_hashes(w: Words, lengths: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the beginnings of words, for words longer (in bytes) than the beginning, and the number of each word."""
    data = np.frombuffer(w.data, dtype=np.uint8).astype(np.uint64) + np.uint64(1)
    hashes, number = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)]
    for length in lengths:
        longer = np.flatnonzero(w.end - w.start > length)
        begin = w.start[longer]
        hashes.append(mix(_spans(data, begin, begin + length, _BASE) + np.uint64(length)))
        number.append(longer)
    return np.concatenate(hashes), np.concatenate(number)


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each ``k`` consecutive values; ``len(hashes) - k + 1`` of them."""
    if len(hashes) < k:
        return np.zeros(0, dtype=np.uint64)
    at = np.arange(len(hashes) - k + 1)
    return _spans(hashes, at, at + k, 0xC2B2AE3D27D4EB4F)


def minima(hashes: np.ndarray, first: np.ndarray, window: int) -> np.ndarray:
    """Places that hold the smallest value (the last of equals) of some ``window`` consecutive values of one text.

    ``first[i]:first[i + 1]`` are the values of text ``i``; a text of fewer values than the window is one window.
    The choice depends on the values in the window alone, so equal passages give equal places.
    """
    chosen = np.zeros(len(hashes), dtype=bool)
    sizes = np.diff(first)
    for i in np.flatnonzero((sizes > 0) & (sizes < window)):
        part = hashes[first[i]:first[i + 1]]
        chosen[first[i] + len(part) - 1 - np.argmin(part[::-1])] = True
    count = len(hashes) - window + 1
    if count > 0:
        text = np.repeat(np.arange(len(sizes)), sizes)
        open_ = text[:count] == text[window - 1:]  # windows inside one text that have no place yet
        least = hashes[:count].copy()
        for step in range(1, window):
            np.minimum(least, hashes[step:step + count], out=least)
        for step in range(window - 1, -1, -1):
            found = open_ & (hashes[step:step + count] == least)
            chosen[step:step + count] |= found
            open_ &= ~found
    return np.flatnonzero(chosen)


class Grams(NamedTuple):
    """The ``k``-word grams of several texts: hash, place of the first word, ``first[i]:first[i + 1]`` for text ``i``."""

    hash: np.ndarray
    word: np.ndarray
    first: np.ndarray


def grams(w: Words, hashes: np.ndarray, k: int) -> Grams:
    count = np.maximum(np.diff(w.first) - k + 1, 0)
    first = np.concatenate([[0], np.cumsum(count)])
    word = np.arange(first[-1]) + np.repeat(w.first[:-1] - first[:-1], count)
    return Grams(gram_hashes(hashes, k)[word] if len(word) else np.zeros(0, dtype=np.uint64), word, first)


BITMAP_BITS = 24


def in_bitmap(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the slot of each hash, its first bits, is set."""
    slots = hashes >> np.uint64(64 - BITMAP_BITS)
    return (bitmap[slots >> np.uint64(3)] >> (slots & np.uint64(7)).astype(np.uint8)) & 1 == 1
