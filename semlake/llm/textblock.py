"""Words and their hashes for whole Arrow batches at once, with numpy. Works on UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes handled at a time; arrays of eight bytes for each then stay within the cache.
WINDOW = 1 << 18
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Letters and digits after lower-casing, and every byte of a character beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
_BASES = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each bit of the result depends on every bit of x."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get(which)
    if have is None or len(have[0]) < n:
        base = int(_BASES[which])
        inverse = pow(base, -1, 1 << 64)
        have = tuple(
            np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(max(n, 2 * WINDOW), b, np.uint64)]))
            for b in (base, inverse)
        )
        _POWERS[which] = have
    return have


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, nulls as empty, and where each row begins (one more at the end)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "") if len(column) else column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], at - at[0]


def _windows(data: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about WINDOW bytes that cut no word: each ends before a byte outside words, or at a row's first byte."""
    at, n = 0, len(data)
    while at < n:
        end = min(n, at + WINDOW)
        if end < n:
            free = np.flatnonzero(~ALNUM[LOWER[data[at + 1 : end]]] | first[at + 1 : end])
            if len(free):
                end = at + 1 + int(free[-1])
            else:
                more = np.flatnonzero(~ALNUM[LOWER[data[end:]]] | first[end:n])
                end = end + int(more[0]) if len(more) else n
        yield at, end
        at = end


def _spans(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each window: where it begins, its lower-cased bytes, and the first byte and end of each of its words."""
    first = np.zeros(len(data) + 1, dtype=bool)
    first[offsets] = True
    for a, b in _windows(data, first):
        low = LOWER[data[a:b]]
        word = ALNUM[low]
        edge = first[a : b + 1]
        before = np.concatenate([[False], word[:-1]])
        after = np.concatenate([word[1:], [False]])
        s = np.flatnonzero(word & (~before | edge[:-1]))
        e = np.flatnonzero(word & (~after | edge[1:])) + 1
        if len(s):
            yield a, low, s, e


def _prefix_sums(low: np.ndarray, which: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = _powers(which, len(low) + 1)
    value = (low.astype(np.uint64) + np.uint64(1)) * up[: len(low)]
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)]), down


def words(data: np.ndarray, offsets: np.ndarray, hashes: int = 1) -> tuple[np.ndarray, ...]:
    """(row, hash, ...) of every lower-cased word: row numbers, then ``hashes`` independent 64-bit hashes."""
    starts, out = [np.zeros(0, np.int64)], [[np.zeros(0, np.uint64)] for _ in range(hashes)]
    for a, low, s, e in _spans(data, offsets):
        starts.append(s + a)
        for k in range(hashes):
            total, down = _prefix_sums(low, k)
            out[k].append(mix((total[e] - total[s]) * down[s]))
    begins = np.concatenate(starts)
    return (np.searchsorted(offsets, begins, side="right") - 1, *[np.concatenate(x) for x in out])


def beginnings(data: np.ndarray, offsets: np.ndarray, sizes: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, hash) of whole words, and of the first bytes of each word longer than a size, told apart by size."""
    yield np.zeros(0, np.int64), np.zeros(0, np.uint64)
    for a, low, s, e in _spans(data, offsets):
        row = np.searchsorted(offsets, s + a, side="right") - 1
        total, down = _prefix_sums(low, 0)
        yield row, mix((total[e] - total[s]) * down[s])
        for n in sizes:
            longer = s[e - s > n]
            yield row[e - s > n], mix((total[longer + n] - total[longer]) * down[longer] + np.uint64(n))


def grams(row: np.ndarray, hashed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, hash) of every k words in a row of one text."""
    n = len(row) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total = total * np.uint64(0xD6E8FEB86659FD93) + hashed[j : j + n]
    whole = np.flatnonzero(row[:n] == row[k - 1 :])
    return whole, mix(total[whole] + np.uint64(k))


def batches(batch: pa.RecordBatch, column: str, limit: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of text each; a longer text comes alone."""
    text = batch.column(batch.schema.get_field_index(column))
    n = pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False)
    at = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
    i = 0
    while i < len(n):
        j = min(len(n), max(i + 1, int(np.searchsorted(at, at[i] + limit, side="right")) - 1))
        yield batch.slice(i, j - i)
        i = j


def components_of(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """The smallest index connected to each of n, given links a-b and what earlier calls found."""
    label = np.arange(n) if label is None else label
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        if not len(a):
            break
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return label
