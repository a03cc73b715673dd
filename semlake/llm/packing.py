"""Packing token sequences of a fixed length by pattern counts.

Documents are tokenised once, on the executors, into pieces of at most ``limit`` tokens. Only the histogram of piece
lengths (at most ``limit`` rows) reaches the driver, which enumerates patterns of one to three lengths that fill a
sequence exactly, fits how often to use each by non-negative least squares, rounds, packs the lengths that are left by
best fit, and sends back a plan that says for every length which ranks go where. Pieces get ranks within their length on
the executors; the plan's size depends on ``limit`` alone.

Defined results: a null text is an empty document, that is, the end token alone; rows are packed one by one, so repeated
rows are packed repeatedly; other columns, whatever their names, play no part.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semlake.llm import textblock
from semlake.llm.common import prefix_within, table
from semlake.llm.tokens import Encoder

END = 0
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, n_ids long"


def cut(n: int, limit: int) -> list[tuple[int, int]]:
    """(start, length) of each piece of n tokens: whole ones at the end, so that only the first may be shorter."""
    first = n % limit if n > limit else n
    bounds = ([first] if first else []) + [limit] * ((n - first) // limit)
    starts = np.cumsum([0, *bounds[:-1]]).tolist()
    return list(zip(starts, bounds, strict=True))


def pieces(docs: DataFrame, vocabulary: str, limit: int = 2048) -> DataFrame:
    """Every document's pieces with a checksum of their ids."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        for part in parts:
            for b in textblock.batches(part, "text"):
                rows = []
                for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    ids = np.array([*encoder.ids(text or ""), END], dtype="<u4")
                    for k, (start, length) in enumerate(cut(len(ids), limit)):
                        rows.append((doc, k, start, length, zlib.crc32(ids[start : start + length].tobytes()), len(ids)))
                columns = list(zip(*rows, strict=True)) or [[]] * 6
                types = [pa.int64(), pa.int32(), *[pa.int64()] * 4]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "n_ids"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


def patterns(present: np.ndarray, limit: int, spread: int = 64) -> np.ndarray:
    """Rows of up to three lengths (0 for none) that are present and add up to limit: alone, every pair, and the triples
    whose two smaller lengths differ by at most spread."""
    have = np.zeros(limit + 1, bool)
    have[present] = True
    found = [np.array([[limit, 0, 0]])] if have[limit] else []
    a = np.arange((limit + 1) // 2, limit)
    pair = a[have[a] & have[limit - a]]
    found.append(np.stack([pair, limit - pair, 0 * pair], 1))
    for gap in range(spread + 1):
        c = np.arange(1, limit)
        b, a = c + gap, limit - 2 * c - gap
        ok = (a >= b) & (b < limit)
        c, b, a = c[ok], b[ok], a[ok]
        ok = have[a] & have[b] & have[c]
        found.append(np.stack([a[ok], b[ok], c[ok]], 1))
    return np.concatenate(found)


def fit(shapes: np.ndarray, count: np.ndarray, rounds: int = 150) -> np.ndarray:
    """Repeats of each pattern, not negative, that bring the lengths used close to count: least squares by accelerated
    projected gradients. A length weighs by its tokens, as a long piece left over costs more than a short one."""
    weight = np.sqrt(np.arange(len(count)) / (len(count) - 1))
    weight[0] = 0
    flat = shapes.ravel()

    def use(x: np.ndarray) -> np.ndarray:
        return np.bincount(flat, np.repeat(x, shapes.shape[1]), minlength=len(count)) * weight

    def back(r: np.ndarray) -> np.ndarray:
        return (r * weight)[shapes].sum(axis=1)

    probe = np.ones(len(shapes))
    for _ in range(15):  # the largest eigenvalue bounds the step
        probe = back(use(probe))
        probe /= np.linalg.norm(probe)
    step = 1 / (1.05 * np.linalg.norm(back(use(probe))))
    x = ahead = np.zeros(len(shapes))
    goal, t = count * weight, 1.0
    for _ in range(rounds):
        new = np.maximum(0, ahead - step * back(use(ahead) - goal))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def rounded(shapes: np.ndarray, x: np.ndarray, count: np.ndarray) -> tuple[list[tuple[tuple[int, ...], int]], np.ndarray]:
    """Whole repeats that use no length more often than it occurs, and what is left of the lengths. Fractions are carried
    along to the next pattern, so neighbours with small values are still used about as often as fitted."""
    whole = np.diff(np.floor(np.concatenate([[0], np.cumsum(x)]) + 0.5)).astype(np.int64)
    left, plan = count.copy(), []
    for p in np.flatnonzero(whole):
        lengths = [int(v) for v in shapes[p] if v]
        n = min(int(whole[p]), *(int(left[v]) // lengths.count(v) for v in lengths))
        if n > 0:
            for v in lengths:
                left[v] -= n
            plan.append((tuple(lengths), n))
    return plan, left


def best_fit(count: np.ndarray, limit: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit decreasing over a histogram: sequences with equal contents are handled together."""
    room: dict[int, dict[tuple[int, ...], int]] = defaultdict(lambda: defaultdict(int))
    free = np.zeros(limit + 1, bool)
    for v in range(limit, 0, -1):
        n = int(count[v])
        while n:
            fits = np.flatnonzero(free[v:])
            if not len(fits):
                each = limit // v
                k = n // each
                shape, n = ((v,) * each, n - k * each) if k else ((v,) * n, 0)
                room[limit - len(shape) * v][shape] += max(k, 1)
                free[limit - len(shape) * v] = True
                continue
            r = v + int(fits[0])
            shape = next(iter(room[r]))
            k = min(n, room[r][shape])
            room[r][shape] -= k
            if not room[r][shape]:
                del room[r][shape]
                free[r] = bool(room[r])
            room[r - v][(*shape, v)] += k
            free[r - v] = True
            n -= k
    return [(shape, k) for shapes in room.values() for shape, k in shapes.items() if k]


def plan_sequences(count: np.ndarray, limit: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence's pieces, number of such sequences) for a histogram; each length is used exactly count times."""
    count = np.asarray(count, np.int64)
    shapes = patterns(np.flatnonzero(count), limit)
    plan, left = rounded(shapes, fit(shapes, count), count) if len(shapes) else ([], count)
    # Fitted patterns are full, so they never stand in the way of the rest.
    return plan + best_fit(left, limit)


def placements(plan: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, ...]:
    """Sorted by (length, first rank): length, first rank, first sequence, pieces of that length in a sequence, offset."""
    used: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for shape, k in plan:
        at = 0
        for v in dict.fromkeys(shape):
            m = shape.count(v)
            rows.append((v, used[v], sequence, m, at))
            used[v] += k * m
            at += v * m
        sequence += k
    rows.sort()
    return tuple(np.array(c, np.int64) for c in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 5


def pack(docs: DataFrame, vocabulary: str, limit: int = 2048) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece of every document."""
    found = table(pieces(docs, vocabulary, limit), "pieces")
    count = np.zeros(limit + 1, np.int64)
    for length, n in found.groupBy("length").count().collect():  # at most limit rows
        count[length] = n
    length_at, rank_at, sequence_at, each_at, offset_at = placements(plan_sequences(count, limit))
    span = np.int64(1 << 44)
    order = length_at * span + rank_at

    def place(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            v, rank = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("length", "before_one"))
            p = np.searchsorted(order, v * span + rank, side="right") - 1
            nth = rank - rank_at[p]
            yield pa.RecordBatch.from_arrays(
                [
                    *b.columns[:5],
                    pa.array(sequence_at[p] + nth // each_at[p]),
                    pa.array(offset_at[p] + nth % each_at[p] * v),
                ],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    key = F.xxhash64("doc_id", "piece", "ids_crc32")
    keyed = found.drop("n_ids").withColumns({"key": key, "one": F.lit(1)})
    ranked = prefix_within(keyed, "length", ["key", "doc_id", "piece"], ["one"])
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "before_one").mapInArrow(
        place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
