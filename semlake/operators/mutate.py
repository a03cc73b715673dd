"""The operation log and its fold.

ops: (lsn, physical_ns, logical, node, op, oid, tag, key, v_..., target, content_hash, size). Operations are ordered by
(physical_ns, logical, node, lsn); the same lsn twice is one operation. Kinds: create, delete, add_tag, remove_tag,
set_attr, remove_attr, add_relation, remove_relation, write_blob; others are ignored.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semlake.functions.values import VALUE_COLUMNS, VALUE_SCHEMA
from semlake.operators.ontology import Ontology
from semlake.plans.compile import Collection

KINDS = ("create", "delete", "add_tag", "remove_tag", "set_attr", "remove_attr", "add_relation", "remove_relation", "write_blob")
OPS_SCHEMA = T.StructType(
    [
        T.StructField("lsn", T.LongType()),
        T.StructField("physical_ns", T.LongType()),
        T.StructField("logical", T.IntegerType()),
        T.StructField("node", T.IntegerType()),
        T.StructField("op", T.StringType()),
        T.StructField("oid", T.LongType()),
        T.StructField("tag", T.StringType()),
        T.StructField("key", T.StringType()),
        *VALUE_SCHEMA.fields,
        T.StructField("target", T.LongType()),
        T.StructField("content_hash", T.StringType()),
        T.StructField("size", T.LongType()),
    ]
)


@dataclass(frozen=True, order=True)
class Timestamp:
    """A hybrid time: wall clock, then a counter, then the node."""

    physical_ns: int
    logical: int = 0
    node: int = 0


class Clock:
    def __init__(self, node: int = 0, wall=time.time_ns) -> None:
        self.now, self.wall = Timestamp(0, 0, node), wall

    def tick(self) -> Timestamp:
        """Later than all before: the wall clock if that is later, else one more."""
        wall, t = self.wall(), self.now
        self.now = Timestamp(wall, 0, t.node) if wall > t.physical_ns else Timestamp(t.physical_ns, t.logical + 1, t.node)
        return self.now

    def receive(self, other: Timestamp) -> Timestamp:
        wall, t = self.wall(), self.now
        most = max(wall, t.physical_ns, other.physical_ns)
        same = [x.logical for x in (t, other) if x.physical_ns == most]
        self.now = Timestamp(most, max(same) + 1 if same else 0, t.node)
        return self.now


def position() -> Column:
    return F.struct("physical_ns", "logical", "node", "lsn")


def as_of(ops: DataFrame, lsn: int | None = None, physical_ns: int | None = None) -> DataFrame:
    """The log up to and including a point."""
    out = ops if lsn is None else ops.where(F.col("lsn") <= lsn)
    return out if physical_ns is None else out.where(F.col("physical_ns") <= physical_ns)


def since(ops: DataFrame, lsn: int) -> DataFrame:
    return ops.where(F.col("lsn") >= lsn)


def newest(ops: DataFrame, n: int) -> DataFrame:
    """The last n operations, as a ring of that size keeps them."""
    return ops.orderBy(F.desc("lsn")).limit(n)


def live_ops(ops: DataFrame) -> DataFrame:
    """Each lsn once, and none of objects that are deleted: ids are never used again."""
    once = ops.where(F.col("op").isin(*KINDS)).dropDuplicates(["lsn"])
    return once.join(once.where("op = 'delete'").select("oid").distinct(), "oid", "left_anti")


def last_tag_ops(ops: DataFrame) -> DataFrame:
    """(oid, tag, op, at): the last operation on each tag of each object, and its position."""
    own = ops.where(F.col("op").isin("add_tag", "remove_tag"))
    return own.groupBy("oid", "tag").agg(F.max_by("op", position()).alias("op"), F.max(position()).alias("at"))


def direct_tags(ops: DataFrame) -> DataFrame:
    """(oid, tag) that are set at the end of the log: the last operation on each decides."""
    return last_tag_ops(ops).where("op = 'add_tag'").select("oid", "tag")


def tags(ops: DataFrame, ontology: Ontology) -> DataFrame:
    """(oid, tag, origin) at the end of the log, with implied tags. One that was removed by itself stays away until a tag
    that implies it is set again."""
    last = last_tag_ops(ops)
    closure = ontology.closure_table(ops.sparkSession)
    added = last.where("op = 'add_tag'").join(closure, "tag", "left").select(
        "oid", F.coalesce("ancestor", "tag").alias("ancestor"), F.coalesce(F.col("ancestor") == F.col("tag"), F.lit(True)).alias("direct"), "at", F.lit(None).cast("struct<physical_ns:bigint,logical:int,node:int,lsn:bigint>").alias("gone")
    )
    gone = last.where("op = 'remove_tag'").select("oid", F.col("tag").alias("ancestor"), F.lit(False).alias("direct"), F.lit(None).cast(added.schema["at"].dataType).alias("at"), F.col("at").alias("gone"))
    held = added.unionByName(gone).groupBy("oid", F.col("ancestor").alias("tag")).agg(F.bool_or("direct").alias("direct"), F.max("at").alias("at"), F.max("gone").alias("gone"))
    there = held.where(F.col("at").isNotNull() & (F.col("direct") | F.col("gone").isNull() | (F.col("at") > F.col("gone"))))
    return there.select("oid", "tag", F.when(F.col("direct"), "direct").otherwise("materialized").alias("origin"))


def attributes(ops: DataFrame) -> DataFrame:
    """(oid, key, v_...) at the end: set appends; a removal takes away the equal values set before it."""
    value = F.struct(*VALUE_COLUMNS)
    own = ops.where(F.col("op").isin("set_attr", "remove_attr")).withColumn("value", F.xxhash64(value))
    gone = F.max(F.when(F.col("op") == "remove_attr", position())).over(Window.partitionBy("oid", "key", "value"))
    return own.withColumn("gone", gone).where((F.col("op") == "set_attr") & (F.col("gone").isNull() | (position() > F.col("gone")))).select("oid", "key", *VALUE_COLUMNS)


def relations(ops: DataFrame) -> DataFrame:
    own = ops.where(F.col("op").isin("add_relation", "remove_relation"))
    last = own.groupBy("oid", F.col("key").alias("predicate"), "target").agg(F.max_by("op", position()).alias("op"))
    return last.where("op = 'add_relation'").select("oid", "predicate", "target")


def objects(ops: DataFrame) -> DataFrame:
    """(oid, state, created_ns, modified_ns, content_hash, blob_length, last_lsn) of every object ever named."""
    once = ops.where(F.col("op").isin(*KINDS)).dropDuplicates(["lsn"])
    blob = F.when(F.col("op") == "write_blob", position())
    return once.groupBy("oid").agg(
        F.when(F.bool_or(F.col("op") == "delete"), "tombstoned").otherwise("active").alias("state"),
        F.min("physical_ns").alias("created_ns"),
        F.max("physical_ns").alias("modified_ns"),
        F.max_by("content_hash", blob).alias("content_hash"),
        F.max_by("size", blob).alias("blob_length"),
        F.max("lsn").alias("last_lsn"),
    )


def fold(ops: DataFrame, ontology: Ontology) -> Collection:
    """The collection that the log leads to."""
    live = live_ops(ops)
    return Collection(tags(live, ontology), attributes(live), relations(live), ontology, objects(ops))


def add_closure(tags: DataFrame, oid: int, tag: str, ontology: Ontology) -> DataFrame:
    """tags (oid, tag, origin) after one tag is set on one object; the other objects' rows stay where they are."""
    spark = tags.sparkSession
    new = spark.createDataFrame([(oid, t, "direct" if t == tag else "materialized") for t in sorted(ontology.closure(tag))], "oid long, tag string, origin string")
    own = tags.where(F.col("oid") == oid).unionByName(new).groupBy("oid", "tag").agg(F.min("origin").alias("origin"))  # direct wins
    return tags.where(F.col("oid") != oid).unionByName(own)


def remove_cascade(tags: DataFrame, oid: int, tag: str, ontology: Ontology) -> DataFrame:
    """tags after one tag is removed from one object: implied ones that no direct tag implies any more go as well. An
    implied tag that is removed goes alone."""
    own = [(r.tag, r.origin) for r in tags.where(F.col("oid") == oid).select("tag", "origin").collect()]  # of one object
    direct = {t for t, o in own if o == "direct" and t != tag}
    implied = ontology.closure(*[t for t in direct if t in ontology.tags]) | direct
    if (tag, "direct") in own:
        stay = [(t, o) for t, o in own if t != tag and (o == "direct" or t in implied)]
        stay += [(tag, "materialized")] if tag in implied else []
    else:
        stay = [(t, o) for t, o in own if t != tag]
    spark = tags.sparkSession
    return tags.where(F.col("oid") != oid).unionByName(spark.createDataFrame([(oid, *x) for x in stay], "oid long, tag string, origin string"))


def changes(before: DataFrame, after: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows of two states (tables with these columns) that were added or removed, with change = added or removed."""
    both = after.select(*columns, F.lit(1).alias("__n")).unionByName(before.select(*columns, F.lit(-1).alias("__n")))
    net = both.groupBy(*columns).agg(F.sum("__n").alias("__n")).where("__n <> 0")
    change = F.when(F.col("__n") > 0, "added").otherwise("removed").alias("change")
    return net.select(*columns, change, F.explode(F.sequence(F.lit(1), F.abs("__n"))).alias("__nth")).drop("__nth")


def visible(versions: DataFrame, ancestors: Sequence[int]) -> DataFrame:
    """versions (oid, snapshot, value, whiteout) as a reader of the newest of these snapshots sees them."""
    seen = versions.where(F.col("snapshot").isin(list(ancestors)))
    last = seen.groupBy("oid").agg(F.max_by(F.struct("value", "whiteout"), "snapshot").alias("v"))
    return last.where("not v.whiteout").select("oid", F.col("v.value").alias("value"))


def merged(states: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """Last writer wins over (physical_ns, logical, node)."""
    return states.groupBy(*key).agg(F.max_by(value, F.struct("physical_ns", "logical", "node")).alias(value))


def ops_table(spark: SparkSession, rows: Sequence[dict]) -> DataFrame:
    """A log from dicts; what they leave out is null (0 for logical and node)."""
    full = [tuple(({"logical": 0, "node": 0} | r).get(f.name) for f in OPS_SCHEMA) for r in rows]
    return spark.createDataFrame(full, OPS_SCHEMA)
