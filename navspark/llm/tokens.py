"""Hashing the words of many texts at once, inside Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)
_SLICE = 1_000_000


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads each bit over all."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), np.uint64(base))
    out[0] = 1
    return np.multiply.accumulate(out)[:n]


def slices(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, UTF-8 bytes, row offsets) for runs of rows of some megabytes; null is empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + _SLICE)))
        last = min(last, len(texts))
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def word_hashes(data: np.ndarray, offsets: np.ndarray, outside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of each word, A-Z lower-cased, and the row it stands in; ``outside`` marks the bytes between words, if not blanks."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    data = np.where((data >= 65) & (data <= 90), data | 32, data)
    blank = (data == 32) | ((data >= 9) & (data <= 13)) if outside is None else outside[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(~blank & (edge[:-1] | np.concatenate(([True], blank[:-1]))))
    ends = np.flatnonzero(~blank & (edge[1:] | np.concatenate((blank[1:], [True])))) + 1
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_ODD, len(data)), out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * _powers(_INVERSE, len(data))[starts]
    lengths = (ends - starts).astype(np.uint64)
    return mix64(hashes + mix64(lengths)), np.searchsorted(offsets, starts, side="right") - 1


def shingle_sets(texts: pa.Array, width: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sorted distinct shingle hashes of each row) for runs of rows.

    A text of fewer words than ``width`` has its whole sequence as one shingle, one without words none.
    """
    for first, data, offsets in slices(texts):
        words, rows = word_hashes(data, offsets)
        n = len(offsets) - 1
        bounds = np.searchsorted(rows, np.arange(n + 1))
        run = np.zeros(max(len(words) - width + 1, 0), np.uint64)
        for i in range(width):
            run = run * np.uint64(0x100000001B3) + words[i : len(words) - width + 1 + i]
        run = mix64(run)
        sets = []
        for i in range(n):
            a, b = bounds[i], bounds[i + 1]
            if b - a >= width:
                s = np.sort(run[a : b - width + 1])
                sets.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
            elif b > a:
                one = np.zeros(1, np.uint64)
                for w in words[a:b]:
                    one = mix64(one * np.uint64(0x100000001B3) + w)
                sets.append(one)
            else:
                sets.append(np.zeros(0, np.uint64))
        yield first, sets
