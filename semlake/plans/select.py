"""What SQL asks for beyond the objects that match: columns, groups, order, and the range of rows.

A key may have several values, so a column of a key is an array, sorted; an object with several values of a GROUP BY key is in
several groups, and it is ordered by its smallest value (descending: largest), objects without one last, then by id. A
range without an order is taken in the order of ids (grouped: of the key), DISTINCT rows in that of all columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semlake.functions.values import TYPES
from semlake.operators import relational
from semlake.plans import algebra as A
from semlake.plans.compile import Collection, evaluate
from semlake.plans.sql import FIELDS, Item, PlannedQuery, Unsupported

RECORD = {"id": "oid", "size": "blob_length", "created": "created_ns", "modified": "modified_ns"}
_TESTS = {"=": Column.__eq__, "!=": Column.__ne__, "<": Column.__lt__, "<=": Column.__le__, ">": Column.__gt__, ">=": Column.__ge__}


def types_of(c: Collection, keys: list[str]) -> dict[str, str]:
    """The type of each key's values: as the source or the ontology has it, else the first that occurs, else text."""
    declared = {} if c.ontology is None else {t.name: t.value_type for t in c.ontology.tags.values() if t.value_type}
    known = {k: (c.types | declared)[k] for k in keys if k in c.types or k in declared}
    rest = [k for k in keys if k not in known]
    if rest and c.attrs is not None:
        found = c.attrs.where(F.col("key").isin(rest) & F.col("v_ctx").isNull()).groupBy("key").agg(F.min("v_type").alias("t"))
        known |= {r.key: r.t for r in found.collect()}  # a row for each key that the query names
    return {k: known.get(k, "text") for k in keys}


def is_field(c: Collection, name: str) -> bool:
    return name.lower() == "id" or (name.lower() in FIELDS and c.objects is not None and name not in c.types)


def _range(df: DataFrame, p: PlannedQuery) -> DataFrame:
    df = df.offset(p.offset) if p.offset else df
    return df if p.limit is None else df.limit(p.limit)


def run_sql(p: PlannedQuery, c: Collection) -> DataFrame:
    """Sorted oids for *, one row for COUNT(*) (LIMIT and OFFSET apply to the counted objects), else the columns asked for."""
    found = evaluate(p.query, c)
    if p.count:
        n = F.count(F.lit(1))
        n = F.greatest(n - (p.offset or 0), F.lit(0))
        return found.agg((n if p.limit is None else F.least(n, F.lit(p.limit))).cast("long").alias("count"))
    if p.items is None and not p.order:
        return _range(found.orderBy("oid"), p)
    if p.group is not None or any(i.how for i in p.items or ()):
        return _grouped(p, c, found)
    return _projected(p, c, found)


def _grouped(p: PlannedQuery, c: Collection, found: DataFrame) -> DataFrame:
    wanted = [*p.items, *[i for i, _, _ in p.having], *[i for i, _ in p.order]]
    aliases = {i.alias: i for i in p.items if i.alias}
    wanted = [aliases.get(i.name, i) if i.how is None else i for i in wanted]
    if any(i.how is None and i.name != p.group for i in wanted) or any(is_field(c, i.name) for i in wanted if i.name != "*"):
        raise Unsupported("a column that is neither the key of GROUP BY nor an aggregate of a key")
    types = types_of(c, sorted({i.name for i in wanted if i.name != "*"}))
    measures = {(i.how, i.name): f"__m{n}" for n, i in enumerate(wanted) if i.how}
    spec = {alias: (how, name, types.get(name, "")) for (how, name), alias in measures.items()}
    made = relational.group_by(c.attrs, found, None if p.group is None else (p.group, types[p.group]), spec)

    def column(i: Item) -> Column:
        i = aliases.get(i.name, i) if i.how is None else i
        return F.col(measures[i.how, i.name]) if i.how else F.col(f"`{p.group}`")

    for i, op, v in p.having:
        made = made.where(_TESTS[op](column(i), F.lit(v.raw)))
    by = [column(i).desc_nulls_last() if down else column(i).asc_nulls_last() for i, down in p.order]
    if by or p.limit is not None or p.offset:
        made = made.orderBy(*by, *([F.col(f"`{p.group}`")] if p.group is not None else []))
    return _range(made, p).select(*[column(i).alias(i.label()) for i in p.items])


def _projected(p: PlannedQuery, c: Collection, found: DataFrame) -> DataFrame:
    items = p.items or (Item("id", alias="oid"),)
    aliases = {i.alias: i for i in items if i.alias}
    order = [(aliases.get(i.name, i), down) for i, down in p.order]
    if p.distinct and any(i.name not in {x.name for x in items} for i, _ in order):
        raise Unsupported("ORDER BY of a column that DISTINCT leaves out")
    keys = sorted({i.name for i in (*items, *[i for i, _ in order]) if not is_field(c, i.name)})
    types = types_of(c, keys)
    made = relational.project(c.attrs, found, types) if keys else found
    fields = sorted({RECORD[i.name.lower()] for i in (*items, *[i for i, _ in order]) if is_field(c, i.name)} - {"oid"})
    if fields:
        made = made.join(c.objects.select("oid", *fields), "oid", "left")

    def column(i: Item) -> Column:
        return F.col(RECORD[i.name.lower()]) if is_field(c, i.name) else F.col(f"`{i.name}`")

    def rank(i: Item, down: bool) -> Column:
        one = column(i) if is_field(c, i.name) else (F.array_max if down else F.array_min)(column(i))
        return one.desc_nulls_last() if down else one.asc_nulls_last()

    by = [rank(i, down) for i, down in order]
    if p.distinct:
        shown = made.select(*[column(i).alias(f"`{i.name}`".strip("`")) for i in items]).distinct()
        names = [F.col(f"`{i.name}`") for i in items]
        if any(is_field(c, i.name) for i in items):
            raise Unsupported("DISTINCT over fields of the record")
        if by or p.limit is not None or p.offset:
            shown = shown.orderBy(*by, *names)
        return _range(shown, p).select(*[n.alias(i.label()) for n, i in zip(names, items, strict=True)])
    return _range(made.orderBy(*by, "oid"), p).select(*[column(i).alias(i.label()) for i in items])
