"""Toxicity scores by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; all other training texts are unlabelled, whatever their label, as what nobody
confirmed may still be toxic. A linear classifier minimises the class-prior-corrected risk
``prior * R+(positive) + max(0, R-(unlabelled) - prior * R-(positive))``; when the second part turns negative the step
goes against it, so that it cannot be fitted below zero. Several classifiers are trained on differently dealt batches
and averaged.

Features are the presence, repetition and frequent repetition of words and of word beginnings (hashed); those that occur
about as often in positive as in unlabelled texts are left out. Scores see nothing but the text.

Defined results: a null or empty text gets the score of a text without features; rows are scored one by one, so repeated
rows get equal scores; a row with a null doc_id is not held out (it has no remainder) and is scored, but never trained on;
rows that share doc_id and text are one training text; labels with a null doc_id or a null class are ignored, repeated ones
count once (1 wins); without any confirmed toxic text every score is 0; an empty table has an empty result; other columns,
whatever their names, play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semlake.llm import textblock
from semlake.llm.common import release, table

#: Bounds of the training sample: confirmed toxic texts and unlabelled texts, of any length.
POSITIVES, UNLABELLED = 3000, 6000
#: Hashed features; beginnings of words in bytes.
DIMENSIONS = 1 << 19
BEGINNINGS = (4, 5, 6, 7, 8)
TIERS = (1, 2, 4)
FEATURES = len(TIERS) * DIMENSIONS
THRESHOLD = 0.7
#: The share of toxic texts where the labels name no text that isn't.
PRIOR = 0.1


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _buckets(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, bucket) of every word and every word's beginnings."""
    for row, name in textblock.beginnings(*textblock.utf8(column), BEGINNINGS):
        yield row, (name & np.uint64(DIMENSIONS - 1)).astype(np.int64)


def _tiers(row: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature): a bucket's feature for each number of times in TIERS that the row reaches."""
    pair, n = np.unique(row * DIMENSIONS + bucket, return_counts=True)
    row, bucket = pair // DIMENSIONS, pair % DIMENSIONS
    some = [n >= least for least in TIERS]
    return (
        np.concatenate([row[x] for x in some]),
        np.concatenate([bucket[x] + t * DIMENSIONS for t, x in enumerate(some)]),
    )


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature), each once and ordered by row, for the texts of a column."""
    row, bucket = (np.concatenate(x) for x in zip(*_buckets(column), strict=True))
    row, feature = _tiers(row, bucket)
    order = np.argsort(row, kind="stable")
    return row[order], feature[order]


class Model:
    def __init__(self, weights: np.ndarray, bias: float, trained: bool = True) -> None:
        self.weights, self.bias, self.trained = weights.astype(np.float32), bias, trained
        self.chosen = weights.reshape(len(TIERS), DIMENSIONS).any(axis=0)

    def scores(self, column: pa.Array) -> np.ndarray:
        if not self.trained:
            return np.zeros(len(column))
        rows, buckets = [], []
        for row, bucket in _buckets(column):  # most buckets have no weight
            some = self.chosen[bucket]
            rows.append(row[some])
            buckets.append(bucket[some])
        row, feature = _tiers(np.concatenate(rows), np.concatenate(buckets))
        total = np.bincount(row, self.weights[feature].astype(np.float64), minlength=len(column)) + self.bias
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, models: int = 3, epochs: int = 40, seed: int = 5) -> Model:
    """A model from each text's features. Those with a z-score under 4 between the classes are left out."""
    if not positive:
        return Model(np.zeros(FEATURES), 0.0, trained=False)
    n_p, n_u = len(positive), max(1, len(unlabelled))
    counts = np.zeros((2, FEATURES), np.int32)
    for k, some in enumerate((positive, unlabelled)):
        for x in some:
            counts[k, x] += 1
    often = np.flatnonzero(counts.sum(axis=0) >= 4)
    in_p, in_u = counts[:, often].astype(float)
    del counts
    share = (in_p + in_u) / (n_p + n_u)
    z = (in_p / n_p - in_u / n_u) / np.sqrt(share * (1 - share) * (1 / n_p + 1 / n_u) + 1e-9)
    chosen = often[np.abs(z) >= 4]
    place = np.full(FEATURES, -1, np.int32)
    place[chosen] = np.arange(len(chosen), dtype=np.int32)
    texts = [place[x][place[x] >= 0] for x in (*positive, *unlabelled)]
    sizes = np.array([len(x) for x in texts])
    begins = np.concatenate([[0], np.cumsum(sizes)])
    flat = np.concatenate(texts)
    total_w, total_b = np.zeros(len(chosen)), 0.0
    for m in range(models):
        rng = np.random.default_rng(seed + m)
        w, b = np.zeros(len(chosen)), float(np.log(prior / (1 - prior)))
        gw, gb = np.full(len(chosen), 1e-4), 1e-4
        for _ in range(epochs):
            parts = max(1, (n_p + n_u) // 1000)
            for ps, us in zip(
                np.array_split(rng.permutation(n_p), parts), np.array_split(rng.permutation(n_u) + n_p, parts), strict=True
            ):
                us = us[us < len(texts)]
                some = np.concatenate([ps, us]).astype(np.int64)
                if not len(ps) or not len(us):
                    continue
                n = sizes[some]
                at = np.repeat(begins[some] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                row = np.repeat(np.arange(len(some)), n)
                s = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[flat[at]], minlength=len(some)) + b, -40, 40)))
                sp, su = s[: len(ps)], s[len(ps) :]
                # Logistic losses: as positive -log s, as negative -log(1 - s); slopes s - 1 and s.
                negative = -np.log1p(-np.minimum(su, 1 - 1e-12)).mean() + prior * np.log1p(-np.minimum(sp, 1 - 1e-12)).mean()
                slope_u, slope_p = su / len(us), -prior * sp / len(ps)
                if negative < 0:
                    slope = np.concatenate([-slope_p, -slope_u])
                else:
                    slope = np.concatenate([prior * (sp - 1) / len(ps) + slope_p, slope_u])
                g = np.bincount(flat[at], slope[row], minlength=len(chosen)) + 1e-4 * w
                gw += g * g
                gb += slope.sum() ** 2
                w -= 0.3 * g / np.sqrt(gw)
                b -= 0.3 * slope.sum() / np.sqrt(gb)
        total_w += w / models
        total_b += b / models
    weights = np.zeros(FEATURES)
    weights[chosen] = total_w
    return Model(weights, total_b)


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """A model from a bounded sample of the rows that are not held out."""
    own = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(
        F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))
    )
    known = own.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, toxic = known.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    if not toxic:
        return Model(np.zeros(FEATURES), 0.0, trained=False)
    prior = min(0.5, max(0.001, toxic / n)) if toxic < n else PRIOR
    texts = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    toss = F.xxhash64(F.lit(29), "doc_id")
    # Both samples are the rows with the smallest hashes, so they are the same in every run: at most so many ids first, and
    # of the rows with these ids at most so many texts, as any number of rows may share an id.
    some_p = known.where("toxic = 1").orderBy(toss, "doc_id").limit(positives).select("doc_id", F.lit(1).alias("y"))
    some_u = texts.select("doc_id").distinct().orderBy(toss, "doc_id").limit(unlabelled).select("doc_id", F.lit(0).alias("y"))
    ids = some_p.unionByName(some_u).groupBy("doc_id").agg(F.max("y").alias("y"))
    own = table(texts.join(F.broadcast(ids), "doc_id").select("doc_id", "y", "text", F.xxhash64("text").alias("key")), "sample")
    held = own.select("doc_id", "key", "y").distinct()
    chosen = [held.where(F.col("y") == y).orderBy(toss, "doc_id", "key").limit(n) for y, n in ((1, positives), (0, unlabelled))]
    chosen = chosen[0].unionByName(chosen[1]).drop("y")
    sample = own.join(F.broadcast(chosen), ["doc_id", "key"]).dropDuplicates(["doc_id", "key"])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for b in textblock.batches(part, "text"):
                row, name = features(b.column(1))
                at = np.searchsorted(row, np.arange(b.num_rows + 1)).astype(np.int32)
                found = pa.ListArray.from_arrays(pa.array(at), pa.array(name.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), found], names=["y", "key", "features"])

    # Ordered by content, as rows arrive in any order.
    rows = sample.select("y", "text", "key").mapInArrow(run, "y int, key long, features array<int>").toArrow()
    order = np.lexsort([rows.column("key").to_numpy(), rows.column("y").to_numpy()])
    y = rows.column("y").to_numpy()[order]
    parts = [c for c in rows.column("features").chunks if len(c)]
    del rows
    each = []
    for c in parts:
        at = c.offsets.to_numpy() - c.offsets[0].as_py()
        each += np.split(c.flatten().to_numpy(), at[1:-1])
    each = [each[i] for i in order]
    del parts
    made = fit([x for k, x in zip(y, each, strict=True) if k == 1], [x for k, x in zip(y, each, strict=True) if k == 0], prior)
    del each
    release()
    return made


def score(text: Column, model: Model) -> Column:
    @F.arrow_udf("double")
    def scored(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            one = pa.RecordBatch.from_arrays([part], names=["text"])
            done = [model.scores(b.column(0)) for b in textblock.batches(one, "text")]
            yield pa.array(np.concatenate([np.zeros(0), *done]))

    return scored(text)


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row."""
    return docs.select(F.col("doc_id"), held_out(F.col("doc_id")).alias("held_out"), score(F.col("text"), model).alias("score")).withColumn(
        "predicted", (F.col("score") >= THRESHOLD).cast("int")
    )


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """docs without the rows that score at the threshold or above."""
    return docs.where(score(F.col("text"), model) < THRESHOLD)
