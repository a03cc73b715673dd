"""Compilation of the algebra: filtered scans of the assertions, one aggregation by object.

Every distinct leaf becomes a flag, whether any assertion of the object satisfies it; And, Or and Not combine flags after
the aggregation. Leaves filter the assertions of their kind where these are read: a source that gives each key and each
relation as a branch of its own (``sources.tables``) reads no column but the one asked for, and its scan takes the filter. So two comparisons of one key may hold for different values of the object, an empty And is empty, and a
complement is taken against the objects that have a tag.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semlake.functions.values import TYPES, VALUE_COLUMNS, Value, local_of
from semlake.operators.ontology import Ontology
from semlake.plans import algebra as A


@dataclass
class Collection:
    """Assertions of objects, narrow: tags (oid, tag, origin) with implied ones, attrs (oid, key, v_...), rels (oid,
    predicate, target; target_local, the target without its node, where the source can filter by it), and objects (oid,
    state, ...) where records are kept. types: the type of each key's values, where the source knows them."""

    tags: DataFrame
    attrs: DataFrame | None = None
    rels: DataFrame | None = None
    ontology: Ontology | None = None
    objects: DataFrame | None = None
    types: dict[str, str] = field(default_factory=dict)

    def resolve(self, name: str) -> str | None:
        return name if self.ontology is None else self.ontology.resolve(name)


def _literal(v: Value) -> Column:
    cast = {"text": "string", "int": "long", "float": "double", "timestamp": "long", "blob": "binary"}
    return F.lit(bytearray(v.raw) if v.type == "blob" else v.raw).cast(cast[v.type])


def _value(op: str, v: Value) -> Column:
    """The stored value against a literal of its own type; scoped values never compare."""
    if v.context is not None or (op in ("prefix", "contains", "like") and v.type != "text"):
        return F.lit(False)
    stored, wanted = F.col(TYPES[v.type]), _literal(v)
    test = {
        "=": lambda: stored == wanted,
        "<": lambda: stored < wanted,
        "<=": lambda: stored <= wanted,
        ">": lambda: stored > wanted,
        ">=": lambda: stored >= wanted,
        "prefix": lambda: stored.startswith(wanted),
        "contains": lambda: stored.contains(wanted),
        "like": lambda: stored.like(v.raw.replace("\\", "\\\\")),
    }[op]()
    return (F.col("v_type") == v.type) & F.col("v_ctx").isNull() & test


class Flags:
    """The leaves of a query, each once, as predicates on assertions."""

    def __init__(self, ontology: Ontology | None = None, universe: str = "tagged") -> None:
        self.ontology, self.universe = ontology, universe
        self.leaves: dict[tuple, tuple[str, Column]] = {}  # (kind of assertion, predicate)

    def leaf(self, key: tuple, kind: str, predicate: Column) -> Column:
        self.leaves.setdefault(key, (kind, predicate))
        return F.col(f"f{list(self.leaves).index(key)}")

    def descendants(self, tag: str) -> list[str]:
        return sorted(self.ontology.descendants(tag)) if self.ontology else [tag]

    def expression(self, q: A.Query) -> Column:
        if isinstance(q, A.HasTag):
            own = F.col("name") == q.tag
            return self.leaf(("tag", q.tag, q.direct), "tag", own & (F.col("origin") == "direct") if q.direct else own)
        if isinstance(q, A.IsA):
            below = self.descendants(q.tag)
            return self.leaf(("isa", *below), "tag", F.col("name").isin(below))
        if isinstance(q, A.HasKey):
            return self.leaf(("key", q.key), "attr", F.col("name") == q.key)
        if isinstance(q, A.HasAttr):
            own = F.col("name") == q.key
            if q.op == "!=":
                equal = self.expression(A.HasAttr(q.key, "=", q.value))
                return self.expression(A.HasKey(q.key)) & ~equal
            return self.leaf(("attr", q.key, q.op, q.value), "attr", own & _value(q.op, q.value))
        if isinstance(q, A.Under):
            path = q.path.rstrip("/")
            context = F.col("v_ctx").eqNullSafe(F.lit(q.context))
            below = (F.col("v_text") == path) | F.col("v_text").startswith(path + "/")
            return self.leaf(("under", q.key, path, q.context), "attr", (F.col("name") == q.key) & (F.col("v_type") == "text") & context & below)
        if isinstance(q, A.Related):
            local = q.target & ((1 << 48) - 1)
            edge = (F.col("target") == q.target) & (F.col("target_local") == local)
            return self.leaf(("rel", q.predicate, q.target), "rel", (F.col("name") == q.predicate) & edge)
        if isinstance(q, A.Not):
            inside = self.leaf(("all",), "tag", F.lit(True)) if self.universe == "tagged" else self.leaf(("live",), "live", F.lit(True))
            return inside & ~self.expression(q.part)
        parts = [self.expression(p) for p in q.parts]
        out = F.lit(False) if not parts else parts[0]
        for p in parts[1:]:
            out = out & p if isinstance(q, A.And) else out | p
        return out


def assertions(c: Collection, wanted: dict[str, Column]) -> DataFrame:
    """(oid, kind, name, origin, v_..., target, target_local) of the kinds that a query needs, those that are wanted."""
    null = {x: F.lit(None).cast(t) for x, t in zip(VALUE_COLUMNS, ("string", "string", "long", "double", "long", "binary", "string"), strict=True)}
    values = [null[x].alias(x) for x in VALUE_COLUMNS]
    no_target = [F.lit(None).cast("long").alias(x) for x in ("target", "target_local")]
    no_origin = F.lit(None).cast("string").alias("origin")
    parts = []

    def add(kind: str, rows: DataFrame, *columns) -> None:  # noqa: ANN002
        parts.append(rows.where(wanted[kind]).select("oid", F.lit(kind).alias("kind"), "name", *columns))

    if "tag" in wanted:
        add("tag", c.tags.withColumnRenamed("tag", "name"), "origin", *values, *no_target)
    if "attr" in wanted and c.attrs is not None:
        add("attr", c.attrs.withColumnRenamed("key", "name"), no_origin, *VALUE_COLUMNS, *no_target)
    if "rel" in wanted and c.rels is not None:
        rels = c.rels if "target_local" in c.rels.columns else c.rels.withColumn("target_local", local_of(F.col("target")))
        add("rel", rels.withColumnRenamed("predicate", "name"), no_origin, *values, "target", "target_local")
    if "live" in wanted:
        if c.objects is None:
            raise A.QueryError("the collection has no object records")
        add("live", c.objects.where("state = 'active'").withColumn("name", F.lit(None).cast("string")), no_origin, *values, *no_target)
    if not parts:
        return assertions(c, {"tag": F.lit(False)})
    return reduce(DataFrame.unionByName, parts)


def _rows(flags: Flags, c: Collection) -> DataFrame:
    """The assertions that any leaf asks for."""
    wanted: dict[str, Column] = {}
    for kind, predicate in flags.leaves.values():
        wanted[kind] = wanted[kind] | predicate if kind in wanted else predicate
    return assertions(c, wanted)


def _check(q: A.Query, c: Collection) -> None:
    for tag in {n.tag for n in A.walk(q) if isinstance(n, A.IsA)}:
        if c.ontology is not None and c.ontology.resolve(tag) is None:
            raise A.UnknownTag(tag)


def memberships(queries: Sequence[A.Query], c: Collection, universe: str = "tagged") -> DataFrame:
    """(oid, q0, q1, ...): whether each object is in each query's result, for all queries in one pass and one aggregation.
    Objects that no leaf of any query touches are left out; they are in none."""
    flags = Flags(c.ontology, universe)
    for q in queries:
        _check(q, c)
    expressions = [flags.expression(A.flatten(q)) for q in queries]
    if not flags.leaves:
        return c.tags.select("oid", *[F.lit(False).alias(f"q{i}") for i in range(len(queries))]).where(F.lit(False))
    # Typed columns are null for other types; a flag never is.
    tests = [F.coalesce(F.bool_or((F.col("kind") == k) & p), F.lit(False)).alias(f"f{i}") for i, (k, p) in enumerate(flags.leaves.values())]
    flagged = _rows(flags, c).groupBy("oid").agg(*tests)
    return flagged.select("oid", *[e.alias(f"q{i}") for i, e in enumerate(expressions)])


def evaluate(q: A.Query, c: Collection, universe: str = "tagged") -> DataFrame:
    """(oid): the objects in the query's result, each once."""
    _check(q, c)
    if isinstance(A.flatten(q), A.HasTag | A.IsA | A.HasKey | A.Related | A.Under) or (isinstance(q, A.HasAttr) and q.op != "!="):
        flags = Flags(c.ontology, universe)
        flags.expression(q)
        return _rows(flags, c).select("oid").distinct()
    return memberships([q], c, universe).where("q0").select("oid")
