"""What the algebra leaves to DataFrames: projection, grouping, ordering, traversal, and rules that derive assertions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semlake.functions.values import TYPES, VALUE_SCHEMA, Value
from semlake.operators.ontology import rule_table
from semlake.storage import drop_table, table

AGGREGATES = ("count", "sum", "avg", "min", "max", "count_distinct")


def project(attrs: DataFrame, selection: DataFrame, keys: dict[str, str]) -> DataFrame:
    """A row for each selected object; a column for each key (of the given type) with its values, sorted, in an array."""
    rows = attrs.where(F.col("key").isin(list(keys)) & F.col("v_ctx").isNull())
    columns = [
        F.array_sort(F.collect_list(F.when((F.col("key") == k) & (F.col("v_type") == t), F.col(TYPES[t])))).alias(k)
        for k, t in keys.items()
    ]
    found = rows.join(selection.select("oid"), "oid", "left_semi").groupBy("oid").agg(*columns)
    empty = [F.coalesce(f"`{k}`", F.array().cast(found.schema[k].dataType)).alias(k) for k in keys]
    return selection.select("oid").join(found, "oid", "left").select("oid", *empty)


def group_by(attrs: DataFrame, selection: DataFrame | None, key: tuple[str, str] | None, measures: dict[str, tuple[str, str, str]]) -> DataFrame:
    """(key, measures...): key and measures are (name, type) of attributes; a measure is name: (aggregate, key, type), and
    ("count", "*", "") counts objects. An object with several values is in several groups. No key: one row for all objects
    selected, or of all with an attribute."""
    for how, _, _ in measures.values():
        if how not in AGGREGATES:
            raise ValueError(how)
    rows = attrs.where(F.col("v_ctx").isNull())
    wanted = sorted({(k, t) for _, k, t in measures.values() if k != "*"})
    if key is not None:
        name, kind = key
        groups = rows.where((F.col("key") == name) & (F.col("v_type") == kind)).select("oid", F.col(TYPES[kind]).alias("g")).distinct()
        groups = groups if selection is None else groups.join(selection.select("oid"), "oid", "left_semi")
    else:
        name = "__all"
        groups = (attrs if selection is None else selection).select("oid").distinct().withColumn("g", F.lit(0))
    made = groups
    if wanted:
        own = [F.collect_list(F.when((F.col("key") == k) & (F.col("v_type") == t), F.col(TYPES[t]))).alias(f"m{i}") for i, (k, t) in enumerate(wanted)]
        made = groups.join(rows.where(F.col("key").isin([k for k, _ in wanted])).groupBy("oid").agg(*own), "oid", "left")
    out, distinct = [], {}
    for alias, (how, k, t) in measures.items():
        if k == "*":
            out.append(F.count(F.lit(1)).alias(alias))
            continue
        values = F.col(f"m{wanted.index((k, t))}")
        total = F.aggregate(values, F.lit(0.0) if t == "float" or how == "avg" else F.lit(0).cast("long"), lambda a, x: a + x)
        if how == "count":
            out.append(F.coalesce(F.sum(F.when(values.isNotNull(), F.size(values))), F.lit(0)).alias(alias))
        elif how == "sum":
            out.append(F.sum(F.when(F.size(values) > 0, total)).alias(alias))
        elif how == "avg":
            out.append((F.sum(F.when(F.size(values) > 0, total)) / F.sum(F.when(F.size(values) > 0, F.size(values)))).alias(alias))
        elif how in ("min", "max"):
            out.append((F.min(F.array_min(values)) if how == "min" else F.max(F.array_max(values))).alias(alias))
        else:
            distinct[alias] = made.select("g", F.explode(values).alias("x")).distinct().groupBy("g").agg(F.count(F.lit(1)).alias(alias))
    result = made.groupBy("g").agg(*out) if out else made.select("g").distinct()
    if key is None and not distinct:
        return made.agg(*out)
    for alias, counts in distinct.items():
        result = result.join(counts, "g", "left").withColumn(alias, F.coalesce(alias, F.lit(0)))
    return result.select(*([F.col("g").alias(name)] if key is not None else []), *measures)


def order_by(attrs: DataFrame, selection: DataFrame, key: str, kind: str, descending: bool = False, limit: int | None = None) -> DataFrame:
    """(oid, value): selected objects by their smallest (descending: largest) value of the key, then by id; without it last."""
    pick = F.max if descending else F.min
    values = attrs.where((F.col("key") == key) & (F.col("v_type") == kind) & F.col("v_ctx").isNull()).groupBy("oid").agg(pick(TYPES[kind]).alias("value"))
    order = F.desc_nulls_last("value") if descending else F.asc_nulls_last("value")
    out = selection.select("oid").join(values, "oid", "left").orderBy(order, "oid")
    return out if limit is None else out.limit(limit)


def traverse(rels: DataFrame, start: DataFrame, predicate: str, reverse: bool = False, symmetric: bool = False) -> DataFrame:
    """(oid): what one step along a relation reaches."""
    edges = _edges(rels, predicate, reverse, symmetric)
    return edges.join(start.select(F.col("oid").alias("a")), "a", "left_semi").select(F.col("b").alias("oid")).distinct()


def _edges(rels: DataFrame, predicate: str, reverse: bool, symmetric: bool) -> DataFrame:
    own = rels.where(F.col("predicate") == predicate)
    forward, back = own.select(F.col("oid").alias("a"), F.col("target").alias("b")), own.select(F.col("target").alias("a"), F.col("oid").alias("b"))
    return forward.union(back) if symmetric else back if reverse else forward


def reachable(rels: DataFrame, start: DataFrame, predicate: str, reverse: bool = False, symmetric: bool = False) -> DataFrame:
    """(oid, depth): everything that one or more steps reach, with the fewest steps; cycles are fine.

    Each round joins only the newest objects with the edges and leaves out those seen before. Seen objects lie in a table
    of the shared folder, so a plan never grows with the number of rounds.
    """
    edges = _edges(rels, predicate, reverse, symmetric)
    front, seen, depth = start.select("oid").distinct(), None, 0
    while True:
        depth += 1
        found = edges.join(front.withColumnRenamed("oid", "a"), "a", "left_semi").select(F.col("b").alias("oid")).distinct()
        new = found if seen is None else found.join(seen, "oid", "left_anti")
        new = table(new.select("oid", F.lit(depth).alias("depth")), "reached")
        if new.isEmpty():
            drop_table(new)
            return seen if seen is not None else new.limit(0)
        front = new.select("oid")
        seen = new if seen is None else seen.unionByName(new)


# Rules, in their fixed order: buckets, then implied by a value, then implied by a tag.


def bucket_tags(attrs: DataFrame, key: str, kind: str, bounds: Sequence[tuple[str, float | None, float | None]]) -> DataFrame:
    """(oid, tag): the tag of each half-open range [low, high) that a value of the key lies in."""
    value = F.col(TYPES[kind])
    tag: Column = F.lit(None).cast("string")
    for name, low, high in reversed(bounds):
        inside = (F.lit(True) if low is None else value >= low) & (F.lit(True) if high is None else value < high)
        tag = F.when(inside, name).otherwise(tag)
    rows = attrs.where((F.col("key") == key) & (F.col("v_type") == kind) & F.col("v_ctx").isNull())
    return rows.select("oid", tag.alias("tag")).where("tag is not null").distinct()


def value_implied_tags(attrs: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """(oid, tag) for rules (key, text value, tag)."""
    known = rule_table(attrs.sparkSession, list(rules), "key string, v_text string, tag string")
    keys = sorted({k for k, _, _ in rules})
    rows = attrs.where(F.col("key").isin(keys) & (F.col("v_type") == "text") & F.col("v_ctx").isNull()).select("oid", "key", "v_text")
    return rows.join(known, ["key", "v_text"]).select("oid", "tag").distinct()


def implied_values(tags: DataFrame, rules: Sequence[tuple[str, str, Value]]) -> DataFrame:
    """(oid, key, v_...): the value that each rule (tag, key, value) gives to the objects with its tag, once."""
    fields = VALUE_SCHEMA.fieldNames()
    known = [(t, k, *[v.row()[f] for f in fields]) for t, k, v in rules]
    schema = ", ".join(["tag string", "key string", *[f"{f.name} {f.dataType.simpleString()}" for f in VALUE_SCHEMA]])
    found = tags.where(F.col("tag").isin(sorted({t for t, _, _ in rules}))).select("oid", "tag")
    return found.join(rule_table(tags.sparkSession, known, schema), "tag").select("oid", "key", *fields).distinct()


def relation_target_violations(rels: DataFrame, tags: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """(oid, predicate, target, tag) for relations whose target lacks the tag that a rule (predicate, tag) asks for."""
    asked = rels.where(F.col("predicate").isin(sorted({p for p, _ in rules}))).select("oid", "predicate", "target")
    asked = asked.join(rule_table(rels.sparkSession, list(rules), "predicate string, tag string"), "predicate")
    have = tags.where(F.col("tag").isin(sorted({t for _, t in rules}))).select(F.col("oid").alias("target"), "tag")
    return asked.join(have, ["target", "tag"], "left_anti").select("oid", "predicate", "target", "tag")


def with_inverses(rels: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """(oid, predicate, target) with, for each pair of predicates, every relation of one as one of the other the other way
    round; a predicate that is its own inverse is symmetric."""
    both = sorted({(a, b) for p, q in pairs for a, b in ((p, q), (q, p))})
    known = rule_table(rels.sparkSession, both, "predicate string, other string")
    turned = rels.where(F.col("predicate").isin([a for a, _ in both])).join(known, "predicate").select(F.col("target").alias("oid"), F.col("other").alias("predicate"), F.col("oid").alias("target"))
    return rels.select("oid", "predicate", "target").unionByName(turned).distinct()


def composite(rels: DataFrame, name: str, first: str, second: str) -> DataFrame:
    """(oid, predicate, target): name holds from a to c where first holds from a to some b and second from b to c."""
    a = rels.where(F.col("predicate") == first).select("oid", F.col("target").alias("b"))
    c = rels.where(F.col("predicate") == second).select(F.col("oid").alias("b"), "target")
    return a.join(c, "b").select("oid", F.lit(name).alias("predicate"), "target").distinct()


def order_by_sequence(collection: DataFrame, selection: DataFrame, tag: str) -> DataFrame:
    """(oid, pos): the selected members of an ordered collection (tag, oid, pos), in its order."""
    own = collection.where(F.col("tag") == tag).select("oid", "pos")
    return own.join(selection.select("oid"), "oid", "left_semi").orderBy("pos", "oid")


def several_values(attrs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(oid, key, n) for objects with more than one value of a key that should have one."""
    return attrs.where(F.col("key").isin(list(keys))).groupBy("oid", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
