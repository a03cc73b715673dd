"""Subscriptions: saved queries that report how membership changes.

An operation's effect on its object is judged by the object before and after it. No to yes: Created if the operation
created it, else Entered. Yes to no: Deleted if it deleted it; else TagRemoved (if it removes a tag that the query asks
for) and Exited. Yes to yes: TagAdded or TagRemoved for tags, ContentChanged for attributes and content. No to no: none.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from semlake.functions.values import VALUE_COLUMNS
from semlake.operators import mutate
from semlake.operators.ontology import Ontology
from semlake.plans import algebra as A
from semlake.plans import dsl
from semlake.plans.compile import Flags, evaluate

EVENTS = ("TagAdded", "TagRemoved", "ContentChanged", "Deleted", "Created", "Entered", "Exited")
MASK_NAMES = ("TAG_ADDED", "TAG_REMOVED", "CONTENT_CHANGED", "DELETED", "CREATED", "ENTERED", "EXITED")
ALL = (1 << len(EVENTS)) - 1


def mask(*events: str) -> int:
    return sum(1 << EVENTS.index(e) for e in set(events))


def mask_names(interest: int) -> str:
    return "|".join(n for i, n in enumerate(MASK_NAMES) if interest >> i & 1)


@dataclass(frozen=True)
class Subscription:
    """retention: None keeps everything, n the newest n (1: at most once). since: the first lsn that it sees. dormant: the
    intervals (first lsn, first lsn after it or None) in which it slept; what happened then is lost."""

    id: int
    name: str
    query: A.Query
    interest: int = ALL
    retention: int | None = 1024
    since: int = 0
    active: bool = True
    debounce_ns: int | None = None
    dormant: tuple[tuple[int, int | None], ...] = ()

    def paused(self, at: int = 0) -> Subscription:
        """Asleep from that lsn on."""
        return replace(self, active=False, dormant=(*self.dormant, (at, None))) if self.active else self

    def resumed(self, at: int = 0) -> Subscription:
        """Awake again from that lsn on; events in between stay lost."""
        if self.active:
            return self
        *earlier, (first, _) = self.dormant or ((0, None),)
        return replace(self, active=True, dormant=(*earlier, (first, max(first, at))))

    def acknowledged(self, lsn: int) -> Subscription:
        """With everything up to that lsn taken; the next poll begins after it."""
        return replace(self, since=max(self.since, lsn + 1))

    def sees(self, lsn: Column) -> Column:
        awake = lsn >= self.since
        for first, after in self.dormant:
            awake = awake & ((lsn < first) if after is None else (lsn < first) | (lsn >= after))
        return awake & F.lit(self.active or bool(self.dormant))

    def sees_lsn(self, lsn: int) -> bool:
        slept = any(lsn >= first and (after is None or lsn < after) for first, after in self.dormant)
        return lsn >= self.since and not slept and (self.active or bool(self.dormant))


class Unknown(KeyError):
    pass


class Register:
    """Subscriptions by id; ids only grow."""

    def __init__(self) -> None:
        self.held: dict[int, Subscription] = {}
        self.last = 0

    def register(self, name: str, query: A.Query, **options) -> Subscription:
        self.last += 1
        self.held[self.last] = Subscription(self.last, name, query, **options)
        return self.held[self.last]

    def unregister(self, sub_id: int) -> None:
        if self.held.pop(sub_id, None) is None:
            raise Unknown(sub_id)

    def change(self, sub_id: int, how: str, *args) -> Subscription:  # noqa: ANN002
        """Keep what a method of the subscription (paused, resumed, acknowledged) gives."""
        if sub_id not in self.held:
            raise Unknown(sub_id)
        self.held[sub_id] = getattr(self.held[sub_id], how)(*args)
        return self.held[sub_id]

    def index(self, ontology: Ontology) -> dict[str, set[int]]:
        """The subscriptions that a tag can matter to; None stands for those that any operation can matter to."""
        out: dict[str | None, set[int]] = {}
        for s in self.held.values():
            wide = any(not isinstance(n, A.HasTag | A.IsA | A.And | A.Or) for n in A.walk(s.query))
            for t in (None,) if wide else _tags_for(s.query, ontology):
                out.setdefault(t, set()).add(s.id)
        return out

    def to_json(self) -> str:
        subs = [{**vars(s), "query": dsl.to_sexpr(s.query)} for s in self.held.values()]
        return json.dumps({"last": self.last, "subs": subs})

    @staticmethod
    def from_json(text: str, resolve: dsl.Resolver = lambda name: name) -> Register:
        raw, out = json.loads(text), Register()
        out.last = raw["last"]
        for s in raw["subs"]:
            dormant = tuple((a, b) for a, b in s["dormant"])
            out.held[s["id"]] = Subscription(**{**s, "query": dsl.parse(s["query"], resolve), "dormant": dormant})
        return out


def _tags_for(q: A.Query, ontology: Ontology) -> set[str]:
    """Tags whose removal can matter to the query: those it names and all that imply them."""
    named = {n.tag for n in A.walk(q) if isinstance(n, A.HasTag | A.IsA)}
    return {d for t in named for d in ontology.descendants(t)}


class _States:
    """Columns for what holds of an object after each operation: running sums of what appears (1) and goes (-1)."""

    def __init__(self, ontology: Ontology, so_far) -> None:  # noqa: ANN001
        self.ontology, self.so_far = ontology, so_far
        self.names: dict[tuple, str] = {}
        self.columns: list[Column] = []

    def column(self, key: tuple, made: Column) -> Column:
        if key not in self.names:
            self.names[key] = f"__s{len(self.names)}"
            self.columns.append(made.alias(self.names[key]))
        return F.col(self.names[key])

    def live(self, key: tuple, kind: str, test: Column) -> Column:
        """Whether any assertion of that kind that passes the test is there."""
        delta = F.when((F.col("kind") == kind) & test, F.col("delta")).otherwise(0)
        return self.column(("live", *key), F.sum(delta).over(self.so_far) > 0)

    def latest(self, op: str, tag: str) -> Column:
        mine = (F.col("op") == op) & (F.col("tag") == tag)
        return self.column((op, tag), F.coalesce(F.max(F.when(mine, F.col("nth"))).over(self.so_far), F.lit(0)))

    def held(self, tag: str) -> Column:
        return self.live(("tag", tag), "tag", F.col("tag") == tag)

    def member(self, q: A.Query) -> Column:
        if isinstance(q, A.IsA) or (isinstance(q, A.HasTag) and q.direct):
            tags = [q.tag] if isinstance(q, A.HasTag) else sorted(self.ontology.descendants(q.tag))
            return reduce(Column.__or__, map(self.held, tags))
        if isinstance(q, A.HasTag):
            # An implied tag that was removed by itself comes back with the next tag that implies it.
            out = self.held(q.tag)
            for t in sorted(self.ontology.descendants(q.tag) - {q.tag}):
                out = out | (self.held(t) & (self.latest("add_tag", t) > self.latest("remove_tag", q.tag)))
            return out
        if isinstance(q, A.HasAttr) and q.op == "!=":
            return self.member(A.HasKey(q.key)) & ~self.member(A.HasAttr(q.key, "=", q.value))
        if isinstance(q, A.HasAttr | A.HasKey | A.Under | A.Related):
            # The same predicates on assertions that a query over the whole collection is compiled to.
            flags = Flags(self.ontology)
            flags.expression(q)
            ((key, (kind, test)),) = flags.leaves.items()
            return self.live(key, kind, F.coalesce(test, F.lit(False)))
        if isinstance(q, A.Not):
            return self.live(("tagged",), "tag", F.lit(True)) & ~self.member(q.part)
        if not isinstance(q, A.And | A.Or):
            raise A.QueryError(f"can't be watched: {q}")
        parts = [self.member(p) for p in q.parts]
        return reduce(Column.__and__ if isinstance(q, A.And) else Column.__or__, parts) if parts else F.lit(False)


KIND_OF = {"add_tag": "tag", "remove_tag": "tag", "set_attr": "attr", "remove_attr": "attr", "add_relation": "rel", "remove_relation": "rel"}


def derive_all(ops: DataFrame, subs: Sequence[Subscription], ontology: Ontology) -> DataFrame:
    """(sub_id, lsn, physical_ns, logical, node, oid, tag, kind, step) that the log causes for any of the subscriptions, before
    interest and retention.

    All subscriptions are judged in one pass: a window by assertion tells what each operation makes appear or go, a window
    by object sums that up. An object's operations are the unit that is replayed, one after the other.
    """
    position = [F.col("physical_ns"), F.col("logical"), F.col("node"), F.col("lsn")]
    kind = F.create_map(*[F.lit(x) for pair in KIND_OF.items() for x in pair])[F.col("op")]
    once = ops.dropDuplicates(["lsn"]).repartition("oid").withColumns({"kind": kind, "name": F.col("key")})
    once = once.withColumn("target_local", F.col("target").bitwiseAND(F.lit((1 << 48) - 1)))
    # An assertion's last operation before this one: setting what is there, or removing what isn't, changes nothing.
    same = Window.partitionBy("oid", "kind", "tag", "key", *VALUE_COLUMNS, "target").orderBy(*position)
    adds = F.col("op").isin("add_tag", "set_attr", "add_relation")
    was = F.coalesce(F.lag(adds).over(same), F.lit(False))
    order = Window.partitionBy("oid").orderBy(*position)
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    once = once.withColumn("delta", F.when(F.col("kind").isNull(), 0).otherwise(adds.cast("int") - was.cast("int")))
    once = once.withColumn("nth", F.row_number().over(order))
    states = _States(ontology, so_far)
    members = [states.member(s.query) for s in subs]
    gone = F.max(F.col("op") == "delete").over(so_far)
    state = once.select("*", gone.alias("__gone"), *states.columns)
    state = state.select("*", *[(m & ~F.col("__gone")).alias(f"__after{i}") for i, m in enumerate(members)])
    state = state.select("*", *[F.coalesce(F.lag(f"__after{i}").over(order), F.lit(False)).alias(f"__before{i}") for i in range(len(subs))])
    op, none = F.col("op"), F.expr("cast(array() as array<string>)")

    def kinds(i: int, s: Subscription) -> Column:
        before, after = F.col(f"__before{i}"), F.col(f"__after{i}")
        tags = sorted(_tags_for(s.query, ontology))
        asked = F.col("tag").isin(tags) if tags else F.lit(False)
        found = (
            F.when(~before & after, F.when(op == "create", F.array(F.lit("Created"))).otherwise(F.array(F.lit("Entered"))))
            .when(before & ~after & (op == "delete"), F.array(F.lit("Deleted")))
            .when(before & ~after & (op == "remove_tag") & asked, F.array(F.lit("TagRemoved"), F.lit("Exited")))
            .when(before & ~after, F.array(F.lit("Exited")))
            .when(before & after & (op == "add_tag"), F.array(F.lit("TagAdded")))
            .when(before & after & (op == "remove_tag"), F.array(F.lit("TagRemoved")))
            .when(before & after & op.isin("set_attr", "remove_attr", "write_blob"), F.array(F.lit("ContentChanged")))
            .otherwise(none)
        )
        return F.struct(F.lit(s.id).cast("long").alias("sub_id"), F.when(s.sees(F.col("lsn")), found).otherwise(none).alias("kinds"))

    each = F.filter(F.array(*[kinds(i, s) for i, s in enumerate(subs)]), lambda x: F.size(x["kinds"]) > 0)
    base = ["lsn", "physical_ns", "logical", "node", "oid", "tag"]
    out = state.select(*base, F.explode(each).alias("e")).select(F.col("e.sub_id").alias("sub_id"), *base, F.posexplode("e.kinds").alias("step", "kind"))
    about_tag = F.col("kind").isin("TagAdded", "TagRemoved")
    return out.withColumn("tag", F.when(about_tag, F.col("tag")))


def derive(ops: DataFrame, sub: Subscription, ontology: Ontology) -> DataFrame:
    return derive_all(ops, [sub], ontology)


def interested(events: DataFrame, interest: int) -> DataFrame:
    return events.where(F.col("kind").isin([e for i, e in enumerate(EVENTS) if interest >> i & 1]))


def retained(events: DataFrame, n: int | None) -> DataFrame:
    """The newest n events of each subscription: the newest n of each of many shares first, so that no task sorts a
    subscription's whole history."""
    if n is None:
        return events
    newest = [F.desc(c) for c in ("physical_ns", "logical", "node", "lsn", "step")]
    shares = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = events.withColumn("__share", F.pmod(F.xxhash64("lsn", "step"), F.lit(shares)))
    for parts in (["sub_id", "__share"], ["sub_id"]):
        nth = F.row_number().over(Window.partitionBy(*parts).orderBy(*newest))
        dealt = dealt.withColumn("__nth", nth).where(F.col("__nth") <= n).drop("__nth")
    return dealt.drop("__share")


def debounced(events: DataFrame, gap_ns: int) -> DataFrame:
    """The last event of every burst on an object: bursts are apart by more than the gap."""
    order = Window.partitionBy("sub_id", "oid").orderBy("physical_ns", "logical", "node", "lsn", "step")
    following = F.lead("physical_ns").over(order)
    return events.withColumn("__next", following).where(F.col("__next").isNull() | (F.col("__next") - F.col("physical_ns") > gap_ns)).drop("__next")


def drain(ops: DataFrame, sub: Subscription, ontology: Ontology) -> DataFrame:
    """What the subscription delivers."""
    found = interested(derive(ops, sub, ontology), sub.interest)
    found = debounced(found, sub.debounce_ns) if sub.debounce_ns is not None else found
    return retained(found, sub.retention)


def poll(ops: DataFrame, sub: Subscription, ontology: Ontology, now: int) -> tuple[DataFrame, bool]:
    """What the subscription has not acknowledged, up to the lsn ``now``, and whether it overflowed. The same events come
    again until they are acknowledged. Beyond its bound the events are given up: what comes instead is how the result
    differs from the one at the last acknowledgement."""
    seen = mutate.as_of(ops, lsn=now)
    found = interested(derive(seen, sub, ontology), sub.interest)
    if sub.retention is None or found.limit(sub.retention + 1).count() <= sub.retention:
        return found, False
    then = mutate.fold(mutate.as_of(ops, lsn=sub.since - 1), ontology)
    diff = membership_diff(evaluate(sub.query, then), evaluate(sub.query, mutate.fold(seen, ontology)))
    none = {"lsn": F.lit(now).cast("long"), "physical_ns": F.lit(None).cast("long"), "tag": F.lit(None).cast("string"), "step": F.lit(0)}
    stamp = {"logical": F.lit(None).cast("int"), "node": F.lit(None).cast("int"), "sub_id": F.lit(sub.id).cast("long")}
    return interested(diff.withColumns(none | stamp).select(*found.columns), sub.interest), True


def deliver(ops: DataFrame, subs: Iterable[Subscription], ontology: Ontology) -> DataFrame:
    """What all subscriptions deliver, from one pass over the log."""
    subs = list(subs)
    events = derive_all(ops, subs, ontology)
    out = []
    for s in subs:
        mine = interested(events.where(F.col("sub_id") == s.id), s.interest)
        out.append(retained(debounced(mine, s.debounce_ns) if s.debounce_ns is not None else mine, s.retention))
    return reduce(DataFrame.unionByName, out)


def json_line(tag_ids: dict[str, int] | None = None) -> Column:
    """An event as a JSON line with its fields in a fixed order; tags by number where numbers are given."""
    tag = F.col("tag")
    if tag_ids is not None:
        tag = F.create_map(*[x for n, i in tag_ids.items() for x in (F.lit(n), F.lit(i))])[tag] if tag_ids else F.lit(None)
    stamp = F.struct("physical_ns", "logical", F.col("node").alias("node_id"))
    return F.to_json(F.struct("kind", "oid", tag.alias("tag"), stamp.alias("timestamp")))


def membership_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(oid, kind) between two results, for a consumer that lost its place: Entered and Exited."""
    added = new.select("oid").join(old.select("oid"), "oid", "left_anti").withColumn("kind", F.lit("Entered"))
    return added.unionByName(old.select("oid").join(new.select("oid"), "oid", "left_anti").withColumn("kind", F.lit("Exited")))


