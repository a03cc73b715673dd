"""Exact dedup through a minimal perfect hash over the distinct digests of historical documents.

Documents are dealt into history (the lower half of the doc_id range, or a table given as such) and arrivals. History's
distinct digests go, by their leading bits, into shards; each shard's minimal perfect hash gives every digest a slot of
its own that holds the full 32 bytes and the winner's locator. An arrival's digest is looked up and compared byte by
byte: a member repeats the slot's winner; nonmembers are grouped among themselves. There are as many shards as the larger
of the two sides asks for, so neither an index shard nor the look-ups that come to it outgrow a task.

Defined results: a null text counts as empty; of equal texts the row with the smallest doc_id stays (a null doc_id sorts
last, so it stays only in a group without any other); of rows that share text and that doc_id, one stays: any in the
query, whose rows then differ in ``kept`` alone, and in ``drop_duplicates`` the one with the smallest hash over all
columns; other columns, whatever their names, play no part; an empty table has an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semlake.llm import textblock
from semlake.llm.common import join_hot, pick_rows, table

SPACES = r"[\x20\x09-\x0D]+"
#: Distinct digests that a shard holds on average; about 50 bytes each while it is built.
SHARD_KEYS = 100_000
INDEX = "shard int, n long, seeds array<int>, sizes array<long>, bits binary, digests binary, winners binary"


def digest(text: Column) -> Column:
    """SHA-256 of the text with every run of white space replaced by one space, as 32 bytes."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ").cast("binary"), 256))


class PerfectHash:
    """Levels of bit arrays: a key takes the first level at which no other key has its position; its slot is that
    bit's rank over all levels. Keys are 64-bit prefixes of digests that differ (SHA-256 prefixes that collide within
    a shard fall through every level and are kept in a short sorted tail)."""

    LEVELS, GAMMA = 24, 2

    def __init__(self, sizes: list[int], bits: np.ndarray, tail: np.ndarray) -> None:
        self.sizes, self.bits, self.tail = sizes, bits, tail
        self.rank = np.concatenate([[0], np.cumsum(bits, dtype=np.int64)])
        self.starts = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int64)

    @staticmethod
    def place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (textblock.mix(keys + np.uint64(level * 0x9E3779B97F4A7C15 & (2**64 - 1))) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, parts, left = [], [], keys
        for level in range(cls.LEVELS):
            if not len(left):
                break
            size = max(1, cls.GAMMA * len(left))
            at = cls.place(left, level, size)
            seen = np.bincount(at, minlength=size)
            parts.append(seen == 1)
            sizes.append(size)
            left = left[seen[at] > 1]
        return cls(sizes, np.concatenate(parts) if parts else np.zeros(0, bool), np.sort(left))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key: of members their own, of others any slot or -1."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            if not len(left):
                break
            at = self.place(keys[left], level, size) + self.starts[level]
            hit = self.bits[at]
            out[left[hit]] = self.rank[at[hit]]
            left = left[~hit]
        if len(self.tail) and len(left):
            at = np.minimum(np.searchsorted(self.tail, keys[left]), len(self.tail) - 1)
            hit = self.tail[at] == keys[left]
            out[left[hit]] = self.rank[-1] + at[hit]
        return out


def _raw(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(-1, 32)


def _keys(raw: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(raw[:, 8:16]).view(np.uint64)[:, 0]


def build_index(groups: DataFrame, shards: int) -> DataFrame:
    """A row for each shard of the index, from distinct digests and their winners (a locator of 64 bits)."""

    def shard(pdf: pd.DataFrame) -> pd.DataFrame:
        raw = _raw(pdf["digest"])
        keys = _keys(raw)
        # Two digests with the same 64 bits can't both have a slot by those bits: the second is spare, behind the slots.
        order = np.argsort(keys, kind="stable")
        alone = np.ones(len(keys), bool)
        alone[order[1:]] = keys[order[1:]] != keys[order[:-1]]
        winners = pdf["winner"].to_numpy(np.int64)
        made = PerfectHash.build(keys[alone])
        at = np.concatenate([np.flatnonzero(alone)[np.argsort(made.slots(keys[alone]))], np.flatnonzero(~alone)])
        return pd.DataFrame(
            {
                "shard": [int(pdf["shard"].iloc[0])],
                "n": [int(alone.sum())],
                "seeds": [made.tail.view(np.int32).tolist()],
                "sizes": [made.sizes],
                "bits": [np.packbits(made.bits).tobytes()],
                "digests": [raw[at].tobytes()],
                "winners": [winners[at].tobytes()],
            }
        )

    return with_shard(groups, shards).groupBy("shard").applyInPandas(shard, INDEX)


def with_shard(df: DataFrame, shards: int) -> DataFrame:
    return df.withColumn("shard", F.pmod(F.conv(F.hex(F.substring("digest", 1, 7)), 16, 10).cast("long"), F.lit(shards)).cast("int"))


def look_up(arrivals: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """arrivals (digest, doc_id, row, n) with ``winner``: the locator in the slot whose digest has the same 32 bytes, else null."""

    def probe(asked: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        winner = pd.array([None] * len(asked), dtype="Int64")
        if len(asked) and len(shard):
            s = shard.iloc[0]
            sizes = [int(x) for x in s["sizes"]]
            bits = np.unpackbits(np.frombuffer(s["bits"], np.uint8), count=sum(sizes)).astype(bool)
            tail = np.array(s["seeds"], np.int32).view(np.uint64)
            raw = _raw(asked["digest"])
            slot = PerfectHash(sizes, bits, tail).slots(_keys(raw))
            held = np.frombuffer(s["digests"], np.uint8).reshape(-1, 32)
            same = slot >= 0
            same[same] = (held[slot[same]] == raw[same]).all(axis=1)
            winners = np.frombuffer(s["winners"], np.int64)
            winner[np.flatnonzero(same)] = winners[slot[same]]
            for k in range(int(s["n"]), len(held)):
                winner[(raw == held[k]).all(axis=1)] = winners[k]
        return asked[["digest", "row", "n", "id", "none"]].assign(winner=winner)

    # No column has nulls, so that pandas keeps 64-bit numbers.
    plain = arrivals.select("digest", "row", "n", F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("none"))
    found = (
        with_shard(plain, shards)
        .groupBy("shard")
        .cogroup(index.groupBy("shard"))
        .applyInPandas(probe, "digest binary, row long, n long, id long, none boolean, winner long")
    )
    return found.select("digest", F.when(~F.col("none"), F.col("id")).alias("doc_id"), "row", "n", "winner")


def shards_for(sides: DataFrame, shard_keys: int) -> int:
    """Shards of about shard_keys distinct digests for the larger side of (digest, old)."""
    n = [r["count"] for r in sides.groupBy("old").count().collect()]  # at most two rows
    return max(1, -(-max(n, default=0) // shard_keys))


def duplicate_groups(keyed: DataFrame, history: Column | None = None, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """(digest, keep_id, keep_row, group_size) for each distinct digest of keyed (doc_id, row, digest); row, the locator,
    is a number that no other row has.

    history marks the historical rows; it defaults to those in the lower half of the doc_id range. Any choice under
    which history's doc_ids are the smaller ones gives the same groups.
    """
    low, high = keyed.agg(F.min("doc_id"), F.max("doc_id")).first()
    if history is None:
        history = F.coalesce(F.col("doc_id") <= F.lit(0 if low is None else low + (high - low) // 2), F.lit(False))
    # Combined before they move: a group of copies is a row for each task, however large it is.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    sides = keyed.groupBy("digest", history.alias("old")).agg(first.alias("first"), F.count(F.lit(1)).alias("n"))
    sides = table(sides.select("digest", "old", "first.doc_id", "first.row", "n"), "digests")
    old, new = sides.where("old").drop("old"), sides.where("not old").drop("old")
    shards = shards_for(sides, shard_keys)
    index = build_index(old.select("digest", F.col("row").alias("winner")), shards)
    # Groups go by their locator: the slot's for members, who hand on no more than their number, and their own for others.
    found = look_up(new, index, shards)
    own = F.col("winner").isNull()
    seen = old.select(F.col("row").alias("keep_row"), "digest", "doc_id", "n").unionByName(
        found.select(F.coalesce("winner", "row").alias("keep_row"), F.when(own, F.col("digest")).alias("digest"), F.when(own, F.col("doc_id")).alias("doc_id"), "n")
    )
    whole = seen.groupBy("keep_row").agg(F.max("digest").alias("digest"), F.max("doc_id").alias("keep_id"), F.sum("n").alias("group_size"))
    return whole.select("digest", "keep_id", "keep_row", "group_size")


def numbered_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, row, digest), written: a row's number stays what it is."""
    return table(docs.select("doc_id", F.monotonically_increasing_id().alias("row"), digest(F.col("text")).alias("digest")), "keyed")


def exact_duplicates(docs: DataFrame, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row."""
    keyed = numbered_digests(docs)
    groups = table(duplicate_groups(keyed, shard_keys=shard_keys), "groups")
    return join_hot(keyed, groups, "digest", "group_size", keyed.count()).select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_duplicates(docs: DataFrame, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """docs without the rows whose text an earlier row has; one row of every group of equal texts stays."""
    keyed = numbered_digests(docs)
    groups = table(duplicate_groups(keyed, shard_keys=shard_keys), "groups")
    # Text and doc_id together spread a group of copies over all tasks, and only its first rows find a partner.
    row = lambda d, i: F.concat(d, F.coalesce(i.cast("string"), F.lit("none")).cast("binary"))
    winners = groups.select(row(F.col("digest"), F.col("keep_id")).alias("__row"))
    several = keyed.groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    several = several.select(row(F.col("digest"), F.col("doc_id")).alias("__row"))
    return pick_rows(docs, row(digest(F.col("text")), F.col("doc_id")), winners, several)


def oracle(documents: str = "documents") -> str:
    return f"""
    WITH k AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS h FROM {documents}),
    g AS (SELECT *, min(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
          row_number() OVER (PARTITION BY h, doc_id) AS nth FROM k)
    SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AND nth = 1 AS kept, h AS text_sha256 FROM g"""
