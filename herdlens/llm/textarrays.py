"""Words and shingles of a batch of texts as NumPy arrays, without a Python object for each word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are worked on in blocks of about so many bytes: the arrays of a block stay in the cache.
BLOCK_BYTES = 1 << 18

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Blanks: space and tab to carriage return. Word bytes of the other class: 0-9, a-z and all of non-ASCII characters.
NOT_BLANK = np.ones(256, dtype=bool)
NOT_BLANK[[32, *range(9, 14)]] = False
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, dtype=np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _pow(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        more = np.full(max(n, 64, 2 * len(_powers)), _BASE, dtype=np.uint64)
        more[0] = 1
        _powers = np.multiply.accumulate(more)
    return _powers


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes and the offsets of each text (int64, one more than texts); null is empty."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)), offsets


def blocks(offsets: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` bytes, one text at least."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield at, min(to, n)
        at = to


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, A-Z lower-cased, and where each text's words begin (one more than texts).

    data: the bytes from offsets[0] to offsets[-1].
    """
    offsets = offsets - offsets[0]
    low = _LOWER[data]
    inside = is_word[low]
    if not inside.any():
        return np.empty(0, np.uint64), np.zeros(len(offsets), np.int64)
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    first = inside & ~before
    starts = np.flatnonzero(first)
    chars = np.flatnonzero(inside)
    at = np.flatnonzero(first[chars])  # where each word begins among the word bytes
    lengths = np.diff(np.append(at, len(chars)))
    place = np.arange(len(chars)) - np.repeat(at, lengths)
    values = (low[chars].astype(np.uint64) + np.uint64(1)) * _pow(int(lengths.max()))[place]
    hashes = mix64(np.add.reduceat(values, at) ^ (lengths.astype(np.uint64) << np.uint64(56)))
    return hashes, np.searchsorted(starts, offsets).astype(np.int64)


def word_places(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes with A-Z lower-cased; where each word begins; its bytes; and where each text's words begin (one more
    than texts).

    data: the bytes from offsets[0] to offsets[-1].
    """
    offsets = offsets - offsets[0]
    low = _LOWER[data]
    inside = is_word[low]
    before = np.zeros_like(inside)
    before[1:] = inside[:-1]
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros_like(inside)
    after[:-1] = inside[1:]
    after[offsets[1:][(offsets[1:] > 0)] - 1] = False
    return low, starts, np.flatnonzero(inside & ~after) + 1 - starts, np.searchsorted(starts, offsets).astype(np.int64)


def shingles(hashes: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of each text's distinct k-word shingles, and their bounds.

    A text of fewer words is one shingle of all of them; one without words has none.
    """
    n = np.diff(bounds)
    full = np.maximum(n - k + 1, 0)
    short = (n > 0) & (n < k)
    out_n = full + short
    out_at = np.concatenate([[0], np.cumsum(out_n)])
    out = np.empty(out_at[-1], np.uint64)
    factors = _pow(k + 2)[1 : k + 1] * np.uint64(2) + np.uint64(1)
    if len(hashes) >= k:
        rolled = np.zeros(len(hashes) - k + 1, np.uint64)
        for j in range(k):
            rolled += hashes[j : len(hashes) - k + 1 + j] * factors[j]
        rolled = mix64(rolled)
        which = np.repeat(bounds[:-1][full > 0], full[full > 0]) + _ranges(full[full > 0])
        out[np.repeat(out_at[:-1][full > 0], full[full > 0]) + _ranges(full[full > 0])] = rolled[which]
    for i in np.flatnonzero(short):
        own = hashes[bounds[i] : bounds[i + 1]]
        out[out_at[i]] = mix64(np.array([(own * factors[: len(own)]).sum() + np.uint64(len(own))], np.uint64))[0]
    for i in range(len(n)):
        out[out_at[i] : out_at[i + 1]].sort()
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    new[out_at[:-1][out_n > 0]] = True
    counts = np.concatenate([[0], np.cumsum(new)])
    return out[new], counts[out_at]


def _ranges(n: np.ndarray) -> np.ndarray:
    """0 .. n[0]-1, 0 .. n[1]-1, ..."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
