"""Numpy helpers for whole batches of texts: flat bytes, word spans, hashes of spans."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
# odd, so that powers of it can be divided out modulo 2^64
BASE = 0x9E3779B97F4A7C15
SLICE_BYTES = 1 << 18

# space, \t, \n, \v, \f, \r
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of BASE and of its inverse; kept per worker."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for i, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            steps = np.full(size, base, U64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts one after the other, and where each begins; a NULL text is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("")
    off = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
    return data, off - off[0]


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of texts of at most ``limit`` bytes, or one longer text: first row, bytes, offsets.

    The numpy steps need some 50 bytes for each byte of a run, so a task's memory follows the longest text at most.
    """
    data, off = flat(texts)
    row, n = 0, len(texts)
    while row < n:
        end = max(row + 1, int(np.searchsorted(off, off[row] + limit, "right")) - 1)
        yield row, data[off[row] : off[end]], off[row : end + 1] - off[row]
        row = end


def spans_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit polynomial hash of each span of bytes."""
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * up[: len(data)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U64))


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each run of non-space bytes, and the row it is in; a word never crosses rows."""
    solid = ~IS_SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    edges = off[1:-1]
    edges = edges[edges < len(data)]
    first[edges] = solid[edges]
    start = np.flatnonzero(first)
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    before = edges[edges > 0] - 1
    last[before] = solid[before]
    end = np.flatnonzero(last) + 1
    row = np.searchsorted(off, start, "right") - 1
    return start, end, row


def shingles(data: np.ndarray, off: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of the ``size``-word shingles of each row, sorted by row and hash: hashes, offsets by row.

    A-Z count as a-z. A row with fewer words has its whole sequence as one shingle, a row without words none.
    Hashes have 64 bits and stand for the shingles.
    """
    rows = len(off) - 1
    start, end, row = words(data, off)
    if not len(start):
        return np.zeros(0, U64), np.zeros(rows + 1, np.int64)
    word = spans_hash(LOWER[data], start, end)
    count = np.bincount(row, minlength=rows)
    begin = np.cumsum(count) - count
    n = len(word)
    total = np.zeros(n, U64)
    for i in range(min(size, n)):
        # words past the end of a short row do not count
        here = mix(word[i:] * U64(2 * i + 3) + U64(i + 1))
        same = row[i:] == row[: n - i]
        total[: n - i] += np.where(same, here, U64(0))
    left = count[row] - (np.arange(n) - begin[row])
    whole = (left >= size) | ((left == count[row]) & (count[row] < size))
    owner, h = row[whole], mix(total[whole] + np.minimum(left[whole], size).astype(U64))
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    owner, h = owner[new], h[new]
    return h, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=rows))])


def ranges(count: np.ndarray) -> np.ndarray:
    """0..count-1 for each entry, one after the other."""
    total = int(count.sum())
    return np.arange(total) - np.repeat(np.cumsum(count) - count, count)
