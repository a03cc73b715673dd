"""Mixing sources to target weights.

Every row gets a hash-random key; within its source rows are dealt to ranges of that key, word counts are summed up in
front of each row (range totals first, then within a range), and the source is cut at its exact budget. A budget beyond
the source's size takes whole epochs first.

Defined results: a null or empty text has size 0; a null source is a source of its own that sorts last; rows that share
a doc_id are told apart by the hash of their text, and rows equal in both take places side by side (as documents, what
all of them take in whole texts is dealt evenly among them); a source without words has target 0 and takes nothing; an
empty table has an empty result. Other columns, whatever their names, play no part.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semlake.llm.common import global_prefix, join_hot, prefix_within, table, text_key

WORD = r"[^\x20\x09-\x0D]+"
#: Targets stop at so many times their source's size.
MOST_EPOCHS = 3


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, text_key, size): a row each, with its number of words."""
    return docs.select(
        "doc_id", "source", text_key().alias("text_key"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")
    )


def targets(sizes: DataFrame, weights: Mapping[str | None, float] | None = None, most: int = MOST_EPOCHS) -> DataFrame:
    """(source, source_size, target): shares of all words by weight, none above ``most`` times its source's size.

    Without weights, sources ordered by code point (null last) weigh 1, 2, 3, repeating. What a source can't take is
    shared out among the others by weight: with rate r the target is min(most * size, r * weight). Sources are sorted by
    the rate at which they are full; one is full if the rate that those before it leave is no smaller.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    if weights is None:
        placed = global_prefix(
            by_source.select("*", F.col("source").isNull().alias("__last"), F.lit(1).alias("one")), ["__last", "source"], ["one"]
        )
        weighed = placed.select("source", "source_size", (F.col("before_one") % 3 + 1).cast("double").alias("weight"))
    else:
        given = F.lit(None).cast("double")
        for k, w in weights.items():
            given = F.when(F.col("source").eqNullSafe(F.lit(k)), F.lit(float(w))).otherwise(given)
        weighed = by_source.select("source", "source_size", F.coalesce(given, F.lit(0.0)).alias("weight"))
    weighed = table(weighed, "sources")
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    bounded = weighed.withColumn("bound", F.col("source_size") * F.lit(float(most)))
    full_at = F.when(F.col("weight") > 0, F.col("bound") / F.col("weight")).otherwise(F.lit(float("inf")))
    ranked = global_prefix(bounded.withColumn("full_at", full_at), ["full_at", "source"], ["weight", "bound"])
    left, free = F.lit(float(total)) - F.col("before_bound"), F.col("all_weight") - F.col("before_weight")
    ranked = table(ranked.withColumn("full", F.coalesce((F.col("weight") > 0) & (left >= F.col("full_at") * free), F.lit(False))), "ranked")
    taken, open_ = ranked.agg(F.sum(F.when(F.col("full"), F.col("bound"))), F.sum(F.when(~F.col("full"), F.col("weight")))).first()
    rate = max(0.0, total - (taken or 0.0)) / open_ if open_ else 0.0
    goal = F.when(F.col("full"), F.col("bound")).otherwise(F.least("bound", F.lit(rate) * F.col("weight")))
    return ranked.select("source", "source_size", goal.alias("target"))


def mix(docs: DataFrame, weights: Mapping[str | None, float] | None = None, most: int = MOST_EPOCHS, seed: int = 17) -> DataFrame:
    """(doc_id, source, text_key, size, source_size, target, taken, copies) for every row.

    taken: words that the mix takes, over all epochs; the row at the cut gives a part. copies: the same in whole texts,
    where the row at the cut counts if its middle lies before the cut.
    """
    rows = sized(docs).withColumn("key", F.xxhash64(F.lit(seed), "doc_id", "text_key"))
    # A null source gets a name that no other has, as null joins with nothing.
    rows = table(rows.withColumn("part", F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), "source"))), "sized")
    goals = targets(rows, weights, most).select(
        F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), "source")).alias("part"),
        "source_size",
        "target",
        F.least(F.round("target").cast("long"), F.col("source_size") * most).alias("budget"),
    )
    placed = prefix_within(rows, "part", ["key", "doc_id", "text_key"], ["size"], goals)
    size, before = F.col("size"), F.col("before_size")
    epochs = F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0))
    rest = F.when(F.col("source_size") > 0, F.col("budget") % F.col("source_size")).otherwise(F.lit(0))
    last = F.greatest(F.lit(0), F.least(size, rest - before))
    return placed.select(
        "doc_id",
        "source",
        "text_key",
        "size",
        "source_size",
        "target",
        (epochs * size + last).cast("long").alias("taken"),
        (epochs + F.when(before * 2 + size < rest * 2, 1).otherwise(0)).cast("int").alias("copies"),
    )


def mixed_documents(docs: DataFrame, weights: Mapping[str | None, float] | None = None, most: int = MOST_EPOCHS, seed: int = 17) -> DataFrame:
    """docs with every row as often as the mix takes it in whole texts: rows beyond their source's budget go, others repeat."""
    name = lambda i, t: F.concat_ws("-", F.coalesce(i.cast("string"), F.lit("none")), t.cast("string"))
    plan = mix(docs, weights, most, seed).groupBy(name(F.col("doc_id"), F.col("text_key")).alias("__row"))
    plan = plan.agg(F.sum("copies").alias("__copies"), F.count(F.lit(1)).alias("__rows"))
    plan = table(plan.where("__copies > 0"), "plan")
    rows = docs.withColumn("__row", name(F.col("doc_id"), text_key()))
    repeated = F.explode(F.sequence(F.lit(1), F.col("__copies")))
    several = plan.where("__rows > 1")
    if several.isEmpty():
        return rows.join(plan, "__row").withColumn("__copy", repeated).select(*docs.columns)
    lone = rows.join(plan.where("__rows = 1"), "__row").withColumn("__copy", repeated).select(*docs.columns)
    # Rows that share doc_id and text are numbered, in ranges; the first ones get what an even share leaves over.
    again = join_hot(rows, several, "__row", "__rows", docs.count())
    again = table(again.withColumns({"__nth": F.xxhash64(F.monotonically_increasing_id()), "__one": F.lit(1)}), "again")
    keys = prefix_within(again.select("__row", "__nth", "__one", "__rows", "__copies"), "__row", ["__nth"], ["__one"])
    share = F.expr("__copies div __rows") + F.when(F.col("before___one") < F.col("__copies") % F.col("__rows"), 1).otherwise(0)
    keys = keys.select("__row", "__nth", share.alias("__share")).where("__share > 0")
    some = again.drop("__copies").join(keys, ["__row", "__nth"]).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__share").cast("int"))))
    return lone.unionByName(some.select(*docs.columns))
