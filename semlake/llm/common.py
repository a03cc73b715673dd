"""Shared pieces: joins that split hot keys, sums over earlier rows, components; and tables in the shared folder."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from semlake.storage import drop_table, shared_dir, table

__all__ = ["components", "drop_table", "global_prefix", "join_hot", "pick_rows", "prefix_within", "release", "shared_dir", "table", "text_key"]

#: A key holding at least one row in HOT_PARTS is hot; so there are at most HOT_PARTS hot keys, whatever the data.
HOT_PARTS = 1000


def text_key(text: Column | str = "text") -> Column:
    """A row's identity beside its doc_id, for tables in which doc_ids repeat."""
    return F.xxhash64(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def join_hot(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """rows inner-joined with groups (one row a key; size = rows of that key).

    Keys with at least total / HOT_PARTS rows are at most HOT_PARTS many by arithmetic, so they are broadcast and their
    rows never move; the others are shuffled, with less than total / HOT_PARTS rows a key.
    """
    bound = F.lit(max(1, total // HOT_PARTS))
    hot = groups.where(F.col(size) >= bound)
    cold = groups.where(F.col(size) < bound)
    return rows.join(F.broadcast(hot), key).unionByName(
        rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    )


def prefix_within(
    df: DataFrame, group: str, order: Sequence[str], add: Sequence[str], carry: DataFrame | None = None
) -> DataFrame:
    """df with, for each column a of add, ``before_<a>``: the sum of a over the rows of the group that come earlier.
    carry: a row for each group whose other columns come along.

    A group is cut along ``order[0]`` (uniform 64-bit hashes) into equal hash ranges, as many as its share of all rows
    asks for, so that a window never sorts a hot group as a whole; the ranges' totals, a small table, are summed up in
    turn. df should be a written table, as it is read three times.
    """
    spark = df.sparkSession
    n = df.count()
    share = max(64, -(-n // (8 * int(spark.conf.get("spark.sql.shuffle.partitions")))))
    counts = df.groupBy(group).agg(F.count(F.lit(1)).alias("__n"))
    cuts = counts.select(group, F.ceil(F.col("__n") / F.lit(share)).cast("long").alias("__cuts"), "__n")
    cuts = table(cuts if carry is None else cuts.join(carry, group), "cuts")
    cut = join_hot(df, cuts, group, "__n", n)
    # The upper 32 bits as a fraction of 2^32, so ranges follow the order of the hashes themselves.
    place = (F.shiftright(F.col(order[0]), 32) + F.lit(1 << 31)) * F.col("__cuts")
    cut = cut.withColumn("__cut", F.shiftright(place, 32)).drop("__cuts", "__n")
    sums = cut.groupBy(group, "__cut").agg(*[F.sum(a).alias(f"__s_{a}") for a in add])
    earlier = Window.partitionBy(group).orderBy("__cut").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(group, "__cut", *[F.coalesce(F.sum(f"__s_{a}").over(earlier), F.lit(0)).alias(f"__b_{a}") for a in add])
    inside = Window.partitionBy(group, "__cut").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = cut.select("*", *[F.coalesce(F.sum(a).over(inside), F.lit(0)).alias(f"__i_{a}") for a in add])
    out = own.join(base, [group, "__cut"])
    for a in add:
        out = out.withColumn(f"before_{a}", (F.col(f"__b_{a}") + F.col(f"__i_{a}")).cast("long")).drop(f"__b_{a}", f"__i_{a}")
    return out.drop("__cut")


def global_prefix(df: DataFrame, order: Sequence[str], add: Sequence[str]) -> DataFrame:
    """df with ``before_<a>``: the sum of a over all rows that sort earlier by ``order``, and ``all_<a>``, the sum over all.

    Rows are dealt to sorted ranges; only one row of totals for each range is brought together.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = table(df.repartitionByRange(parts, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    sums = ranged.groupBy("__range").agg(*[F.sum(a).alias(f"__s_{a}") for a in add])
    earlier = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    base = sums.select(
        "__range",
        *[F.coalesce(F.sum(f"__s_{a}").over(earlier), F.lit(0)).alias(f"__b_{a}") for a in add],
        *[F.sum(f"__s_{a}").over(whole).alias(f"all_{a}") for a in add],
    )
    inside = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.select("*", *[F.coalesce(F.sum(a).over(inside), F.lit(0)).alias(f"__i_{a}") for a in add]).join(
        F.broadcast(base), "__range"  # a row for each range: as many as there are shuffle partitions
    )
    for a in add:
        out = out.withColumn(f"before_{a}", F.col(f"__b_{a}") + F.col(f"__i_{a}")).drop(f"__b_{a}", f"__i_{a}")
    return out.drop("__range")


def release() -> None:
    """Hand memory that the driver's Python no longer uses back to the system, after arrays that were large for a while."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def pick_rows(docs: DataFrame, row: Column, winners: DataFrame, several: DataFrame) -> DataFrame:
    """The rows of docs whose name (``row``) is in winners (__row, distinct), each name once. several: (__row) of the names
    that more than one row of docs has; of those the one with the smallest hash over all columns stays, found before rows
    move."""
    columns = docs.columns
    several = table(several, "several")
    rows = docs.withColumn("__row", row).join(winners.hint("shuffle_hash"), "__row", "left_semi")
    if several.isEmpty():
        return rows.select(*columns)
    whole = F.xxhash64(*[F.col(c).cast("string") if t.startswith("map") else F.col(c) for c, t in docs.dtypes])
    rows = table(rows, "winners")
    lone = rows.join(several.hint("shuffle_hash"), "__row", "left_anti").select(*columns)
    again = rows.join(several.hint("shuffle_hash"), "__row", "left_semi")
    one = again.groupBy("__row").agg(F.min_by(F.struct(*columns), whole).alias("__one"))
    return lone.unionByName(one.select(*[F.col("__one")[c].alias(c) for c in columns]))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (u, v): root is the smallest node that can be reached.

    Alternating large-star and small-star steps: each round hangs the larger neighbours, then the smaller ones, of each
    node under the smallest it knows, until nothing changes. Minima are combined before rows move, and the neighbours of a
    node with very many of them stay where they are.
    """
    now = table(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )
    seen = None
    while True:
        n, h = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % F.lit(1 << 31))).first()
        if not n or (n, h) == seen:
            break
        seen = (n, h)
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        least = table(least, "least")
        large = join_hot(both, least, "u", "n", 2 * n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = table(large.where("u <> v").distinct(), "large")
        down = table(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "down")
        # Large stars have at most as many rows as there are edges.
        small = join_hot(large, down, "u", "n", n).select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = table(small.union(down.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges")
        for done in (now, least, large, down):
            drop_table(done)
        now = after
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.union(stars.select(F.col("root").alias("node"), "root").distinct())
