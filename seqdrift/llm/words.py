"""Words of many texts at once, as numpy arrays over Arrow's bytes: the kernel that several operators share.

Words are hashed to 64 bits with fixed random weights, so that equal words have equal hashes on every executor.
Both kinds of words in use are runs of bytes of a set in UTF-8: every byte of a character outside ASCII is a word byte.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19  # of text that one step of a task works on; a longer text is a step of its own


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = np.asarray(x, np.uint64).copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def stream(seed: int, n: int) -> np.ndarray:
    """n fixed random odd 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


# The two kinds of words, as functions of the bytes after lower-casing A-Z
def NOT_SPACE(low: np.ndarray) -> np.ndarray:  # noqa: N802
    """[^\\x20\\x09-\\x0D]"""
    return (low != 32) & (low - np.uint8(9) > 4)


def ALNUM(low: np.ndarray) -> np.ndarray:  # noqa: N802
    """[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]"""
    return (low - np.uint8(97) < 26) | (low - np.uint8(48) < 10) | (low > 127)


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z as a-z, and eight zeros behind."""
    out = np.zeros(len(data) + 8, np.uint8)
    np.add(data, (data - np.uint8(65) < 26).view(np.uint8) << np.uint8(5), out=out[: len(data)])
    return out


class Words(NamedTuple):
    """All words of some texts, in order. `first` has one entry more than there are texts."""

    hashes: np.ndarray  # uint64
    starts: np.ndarray  # byte offsets within the slice
    ends: np.ndarray
    first: np.ndarray  # text i has words first[i] to first[i + 1]


class Texts(NamedTuple):
    """A few rows of a batch: their bytes end to end, and where each begins (one entry more than rows)."""

    data: np.ndarray
    bounds: np.ndarray
    rows: slice


def slices(column: pa.Array, most: int = SLICE_BYTES, rows: int = 1 << 16) -> Iterator[Texts]:
    """A text column in steps of about `most` bytes and at most `rows` texts; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return
    _, offsets, values = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(values, np.uint8) if values is not None and values.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, min(i + rows, int(np.searchsorted(at, at[i] + most, "right")) - 1))
        yield Texts(data[at[i] : at[j]], at[i : j + 1] - at[i], slice(i, j))
        i = j


FIRST_BYTES = np.append(np.uint64(2) ** (np.arange(8, dtype=np.uint64) * np.uint64(8)) - np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF))
LONG_WORD = 512


def hashed(low: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Hashes of stretches of bytes: eight bytes at a time, each mixed with its place, and the length. `low` ends with eight zeros."""
    eight = np.ndarray((len(low) - 7,), "<u8", low, strides=(1,))
    total = mix(lengths.astype(np.uint64) + np.uint64(11))
    weights, which, k = stream(2, LONG_WORD // 8 + 1), None, 0
    while True:
        at, left = (starts, lengths) if which is None else (starts[which] + 8 * k, lengths[which] - 8 * k)
        part = mix((eight[at] & FIRST_BYTES[np.minimum(left, 8)]) + weights[k])
        if which is None:
            total += part
        else:
            total[which] += part
        more = (left > 8) & (left + 8 * k <= LONG_WORD)
        which, k = (np.flatnonzero(more) if which is None else which[more]), k + 1
        if not len(which):
            break
    for i in np.flatnonzero(lengths > LONG_WORD):  # whole words at once
        word = low[starts[i] : starts[i] + lengths[i]]
        word = np.append(word, np.zeros(-len(word) % 8, np.uint8)).view("<u8")
        total[i : i + 1] = mix(lengths[i : i + 1].astype(np.uint64) + np.uint64(11)) + mix(word + stream(2, len(word))).sum(dtype=np.uint64)
    return mix(total)


def words_of(texts: Texts, kind: Callable[[np.ndarray], np.ndarray]) -> Words:
    """Splits texts into maximal runs of the bytes of a kind; no word reaches over the border of two texts."""
    data, bounds = texts.data, texts.bounds
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), none, none, np.zeros(len(bounds), np.int64))
    low = lowered(data)
    inside = kind(low[:-8])
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    edge = bounds[:-1][bounds[:-1] < len(data)]
    begin[edge] = inside[edge]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    last = bounds[1:][bounds[1:] > 0] - 1
    end[last] = inside[last]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    first = np.searchsorted(starts, bounds)
    return Words(hashed(low, starts, ends - starts) if len(starts) else np.zeros(0, np.uint64), starts, ends, first)


def grams(hashes: np.ndarray, k: int, seed: int = 3) -> np.ndarray:
    """Hashes of all runs of k words, also of those that reach over the border of two texts."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j, weight in enumerate(stream(seed, k)):
        total += hashes[j : j + n] * weight
    return mix(total)


def inside_text(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which k words of one text begin, and the number of the text of each."""
    counts = np.maximum(np.diff(first) - k + 1, 0)
    owner = np.repeat(np.arange(len(counts)), counts)
    return np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts) + first[:-1][owner], owner


def covered(starts: np.ndarray, length: int | np.ndarray, n: int) -> np.ndarray:
    """Which of n positions lie in a run that begins at one of `starts`."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + length, -1)
    return np.cumsum(edge[:-1]) > 0
