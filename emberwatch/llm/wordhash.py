"""Words of a batch of texts as 64-bit hashes, worked out over bytes with numpy.

A word is a run of word bytes; every byte from 0x80 up belongs to words, so the
byte classes say the same as the code-point classes do. A-Z count as a-z.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that are looked at in one go; a longer text is a block of its own.
BLOCK_BYTES = 2 << 20

_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer."""
    x = x + _STEP
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _letters() -> np.ndarray:
    values = mix(np.arange(256, dtype=_U) * _U(0x2545F4914F6CDD1D))
    values[65:91] = values[97:123]
    return values


_LETTER = _letters()
_WORD_BASE, _GRAM_BASE = 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
_powers = np.ones(1, _U)


def _power_table(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        table = np.full(max(n, 64), _U(_WORD_BASE))
        table[0] = 1
        _powers = np.cumprod(table, dtype=_U)
    return _powers


def byte_class(not_word: list[tuple[int, int]]) -> np.ndarray:
    """Which bytes belong to words: all but the given ranges (ends included)."""
    table = np.ones(256, bool)
    for low, high in not_word:
        table[low : high + 1] = False
    return table


#: `[^\x20\x09-\x0D]` and `[^\x00-\x2F\x3A-\x60\x7B-\x7F]` after A-Z became a-z.
NOT_SPACE = byte_class([(0x20, 0x20), (0x09, 0x0D)])
LETTERS_DIGITS = byte_class([(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])


@dataclass
class Block:
    """Rows ``first`` to ``first + len(counts) - 1`` of a batch; ``words`` lists their words in order."""

    first: int
    counts: np.ndarray
    words: np.ndarray

    @property
    def starts(self) -> np.ndarray:
        return np.cumsum(self.counts) - self.counts

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)


def _hash_words(data: np.ndarray, cuts: np.ndarray, word_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = word_bytes[data]
    if not inside.any():
        return np.zeros(len(cuts) - 1, np.int64), np.zeros(0, _U)
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    before[cuts[:-1][cuts[:-1] < len(data)]] = False
    starts = np.flatnonzero(inside & ~before)
    counts = np.diff(np.searchsorted(starts, cuts))
    packed = data[inside]
    first = (np.cumsum(inside, dtype=np.int64) - 1)[starts]
    lengths = np.diff(first, append=len(packed))
    place = np.arange(len(packed)) - np.repeat(first, lengths)
    values = _LETTER[packed] * _power_table(int(lengths.max()))[place]
    return counts, mix(np.add.reduceat(values, first) + lengths.astype(_U))


def blocks(texts: pa.Array, word_bytes: np.ndarray) -> Iterator[Block]:
    """The words of each row; a null text has none."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    cuts = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(cuts, cuts[first] + BLOCK_BYTES, "right")) - 1
        last = min(max(last, first + 1), len(texts))
        own = cuts[first : last + 1]
        counts, words = _hash_words(data[own[0] : own[-1]], own - own[0], word_bytes)
        yield Block(first, counts, words)
        first = last


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words from each place on; runs over row ends, which ``gram_rows`` tells."""
    size = max(len(words) - n + 1, 0)
    total = np.full(size, _U(n))
    for i in range(n):
        total = total * _U(_GRAM_BASE) + words[i : i + size]
    return mix(total)


def gram_rows(block: Block, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``block.words`` where ``n`` words of one row begin, and their rows."""
    row = block.row
    size = max(len(row) - n + 1, 0)
    places = np.flatnonzero(row[:size] == row[n - 1 : n - 1 + size])
    return places, row[places]


def int64_lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(values).view(np.int64)))
