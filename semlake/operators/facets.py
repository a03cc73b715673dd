"""Facets, tag-level set operators, refinement, and ordered and ranked collections."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semlake.plans import algebra as A
from semlake.plans.compile import Collection, evaluate
from semlake.storage import numbered_within, table


def facets(tags: DataFrame, selection: DataFrame | None = None, k: int | None = None) -> DataFrame:
    """(tag, n): how many selected objects have each tag, most first, ties by tag; counts are combined before they move."""
    rows = tags if selection is None else tags.join(selection.select("oid"), "oid", "left_semi")
    out = rows.groupBy("tag").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "tag")
    return out if k is None else out.limit(k)


def explore(c: Collection, q: A.Query, k: int | None = None) -> DataFrame:
    return facets(c.tags, evaluate(q, c), k)


def intersect(tags: DataFrame, names: Sequence[str]) -> DataFrame:
    """(oid) with all of the tags; none are named: none."""
    names = sorted(set(names))
    if not names:
        return tags.select("oid").where(F.lit(False))
    found = tags.where(F.col("tag").isin(names)).groupBy("oid").agg(F.count_distinct("tag").alias("n"))
    return found.where(F.col("n") == len(names)).select("oid")


def union(tags: DataFrame, names: Sequence[str]) -> DataFrame:
    """(oid) with any of the tags."""
    return tags.where(F.col("tag").isin(sorted(set(names)))).select("oid").distinct()


def refine(tags: DataFrame, names: Sequence[str]) -> DataFrame:
    """(kind, name) that a listing below the chosen tags shows: tags that still narrow it down, then the objects."""
    found = intersect(tags, names) if names else tags.select("oid").distinct()
    left = tags.join(found, "oid", "left_semi").where(~F.col("tag").isin(sorted(set(names)))).select(F.lit("tag").alias("kind"), F.col("tag").alias("name")).distinct()
    return left.unionByName(found.select(F.lit("object").alias("kind"), F.col("oid").cast("string").alias("name"))).orderBy(F.desc("kind"), "name")


def values_of(attrs: DataFrame, key: str) -> DataFrame:
    """The distinct values of a key."""
    return attrs.where(F.col("key") == key).drop("oid", "key").distinct()


def assertions_of(c: Collection, oid: int) -> DataFrame:
    """(kind, name, shown, origin) of one object."""
    own = F.col("oid") == oid
    out = c.tags.where(own).select(F.lit("tag").alias("kind"), F.col("tag").alias("name"), F.lit("").alias("shown"), "origin")
    if c.attrs is not None:
        shown = F.coalesce("v_text", F.col("v_int").cast("string"), F.col("v_float").cast("string"), F.concat(F.lit("ts:"), F.col("v_ts").cast("string")), F.concat(F.lit("blob["), F.octet_length("v_blob").cast("string"), F.lit("]")))
        out = out.unionByName(c.attrs.where(own).select(F.lit("attr").alias("kind"), F.col("key").alias("name"), shown.alias("shown"), F.lit("direct").alias("origin")))
    if c.rels is not None:
        out = out.unionByName(c.rels.where(own).select(F.lit("relation").alias("kind"), F.col("predicate").alias("name"), F.col("target").cast("string").alias("shown"), F.lit("direct").alias("origin")))
    return out


def object_counts(c: Collection) -> DataFrame:
    """(oid, tag_count, attr_count, relation_count): derived, never kept."""
    parts = [c.tags.select("oid", F.lit(1).alias("t"), F.lit(0).alias("a"), F.lit(0).alias("r"))]
    if c.attrs is not None:
        parts.append(c.attrs.select("oid", F.lit(0).alias("t"), F.lit(1).alias("a"), F.lit(0).alias("r")))
    if c.rels is not None:
        parts.append(c.rels.select("oid", F.lit(0).alias("t"), F.lit(0).alias("a"), F.lit(1).alias("r")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy("oid").agg(F.sum("t").alias("tag_count"), F.sum("a").alias("attr_count"), F.sum("r").alias("relation_count"))


def status(c: Collection) -> DataFrame:
    """One row: objects with a tag, memberships, distinct tags, attribute rows, relation rows."""
    out = c.tags.agg(F.count_distinct("oid").alias("objects"), F.count(F.lit(1)).alias("memberships"), F.count_distinct("tag").alias("tags"))
    for name, df in (("attributes", c.attrs), ("relations", c.rels)):
        n = c.tags.sparkSession.range(1).select(F.lit(0).cast("long").alias(name)) if df is None else df.agg(F.count(F.lit(1)).alias(name))
        out = out.join(F.broadcast(n), how="inner")  # one row each
    return out


# Ordered and ranked collections: (tag, oid, pos, score).

STRIDE = 1 << 20


def upgrade_to_ordered(members: DataFrame) -> DataFrame:
    """(tag, oid, pos): members of tags in ascending id order, with room between positions."""
    return numbered_within(members.select("tag", "oid"), "tag", ["oid"], "nth").select("tag", "oid", (F.col("nth") * STRIDE).alias("pos"))


def push_ordered(collection: DataFrame, added: DataFrame) -> DataFrame:
    """Append (tag, oid, seq) in the order of seq, repeated members included."""
    last = collection.groupBy("tag").agg(F.max("pos").alias("last"))
    new = numbered_within(added.select("tag", "oid", "seq"), "tag", ["seq"], "nth").join(last, "tag", "left")
    new = new.select("tag", "oid", (F.coalesce("last", F.lit(0)) + F.col("nth") * STRIDE).cast("long").alias("pos"))
    return collection.select("tag", "oid", "pos").unionByName(new)


def renumbered(collection: DataFrame) -> DataFrame:
    """The same order with even room, for when neighbours have come together."""
    return numbered_within(collection.select("tag", "oid", "pos"), "tag", ["pos"], "nth").select("tag", "oid", (F.col("nth") * STRIDE).alias("pos"))


def insert_ordered(collection: DataFrame, added: DataFrame) -> DataFrame:
    """Insert (tag, oid, after, seq) behind the first place of the member ``after`` (null: at the beginning), several at one
    place in the order of seq, midway between the neighbours; collections without the room are given even positions first.
    A place that isn't there is refused."""
    added = added.withColumn("place", F.concat_ws("/", F.coalesce(F.col("after").cast("string"), F.lit("first")), "tag"))
    wanted = numbered_within(added.select("tag", "oid", "after", "seq", "place"), "place", ["seq"], "k")
    wanted = wanted.join(wanted.groupBy("place").agg(F.count(F.lit(1)).alias("m")), "place")

    def gaps(c: DataFrame) -> DataFrame:
        nth = numbered_within(c.select("tag", "oid", "pos"), "tag", ["pos"], "nth")
        follows = nth.select("tag", (F.col("nth") - 1).alias("nth"), F.col("pos").alias("next"))
        first = nth.groupBy("tag", F.col("oid").alias("after")).agg(F.min(F.struct("nth", "pos")).alias("at"))
        places = first.select("tag", "after", "at.nth", "at.pos").unionByName(
            nth.select("tag").distinct().select("tag", F.lit(None).cast("long").alias("after"), F.lit(0).cast("long").alias("nth"), F.lit(0).cast("long").alias("pos"))
        )
        places = places.join(follows, ["tag", "nth"], "left").select(F.col("tag").alias("t"), F.col("after").alias("a"), "pos", F.coalesce("next", F.col("pos") + 2 * STRIDE).alias("next"))
        here = (F.col("tag") == F.col("t")) & F.col("after").eqNullSafe(F.col("a"))
        return table(wanted.join(places, here, "left").select("tag", "oid", "after", "k", "m", "pos", "next"), "gaps")

    found = gaps(collection)
    if not found.where("pos is null").isEmpty():
        raise ValueError("no such member to insert behind")
    if not found.where("next - pos <= m").isEmpty():
        collection = table(renumbered(collection), "collection")
        found = gaps(collection)
    new = found.select("tag", "oid", F.expr("pos + ((next - pos) * k) div (m + 1)").alias("pos"))
    return collection.select("tag", "oid", "pos").unionByName(new)


def upgrade_to_ranked(members: DataFrame) -> DataFrame:
    """(tag, oid, score, seq): members of tags in ascending id order, all with score 0."""
    return numbered_within(members.select("tag", "oid"), "tag", ["oid"], "seq").select("tag", "oid", F.lit(0).cast("long").alias("score"), "seq")


def insert_ranked(collection: DataFrame, added: DataFrame) -> DataFrame:
    """Add (tag, oid, score, seq) in the order of seq, behind what is there: ties are read in insertion order."""
    last = collection.groupBy("tag").agg(F.max("seq").alias("last"))
    new = numbered_within(added.select("tag", "oid", "score", "seq"), "tag", ["seq"], "nth").join(last, "tag", "left")
    new = new.select("tag", "oid", F.col("score").cast("long").alias("score"), (F.coalesce("last", F.lit(0)) + F.col("nth")).alias("seq"))
    return collection.select("tag", "oid", "score", "seq").unionByName(new)


def ranked(collection: DataFrame, tag: str, k: int | None = None) -> DataFrame:
    """(oid, score) of a ranked collection (tag, oid, score, seq): highest score first, ties in insertion order."""
    out = collection.where(F.col("tag") == tag).orderBy(F.desc("score"), "seq")
    return (out if k is None else out.limit(k)).select("oid", "score")


def without_members(collection: DataFrame, gone: DataFrame) -> DataFrame:
    return collection.join(gone.select("tag", "oid"), ["tag", "oid"], "left_anti")


def tag_summary(c: Collection) -> DataFrame:
    """(tag, n, direct): tags by how many objects have them, most first."""
    n = c.tags.groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("origin") == "direct", 1)).alias("direct"))
    return n.orderBy(F.desc("n"), "tag")


def without_context(attrs: DataFrame, key: str) -> DataFrame:
    """(oid, path): every path of an object, whatever its context; an object may have several."""
    return attrs.where((F.col("key") == key) & (F.col("v_type") == "text")).select("oid", F.col("v_text").alias("path")).distinct()


def visible_to(c: Collection, allowed: A.Query) -> Collection:
    """The collection as a caller sees it who may see only the objects of a query: results, counts, facets and universes
    are taken within it."""
    seen = evaluate(allowed, c)
    within = lambda df: None if df is None else df.join(seen, "oid", "left_semi")
    return replace(c, tags=within(c.tags), attrs=within(c.attrs), rels=within(c.rels), objects=within(c.objects))
