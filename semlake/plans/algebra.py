"""The closed boolean query algebra: nodes, printing, and evaluation of one object."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from semlake.functions.values import Value, compare, format_oid

OPS = ("=", "!=", "<", "<=", ">", ">=", "prefix", "contains", "like")


class QueryError(Exception):
    """A query that can't be read or run."""


class ParseError(QueryError):
    def __init__(self, position: int, message: str) -> None:
        super().__init__(f"at {position}: {message}")
        self.position, self.message = position, message


class UnknownTag(QueryError):
    pass


class UnknownOp(QueryError):
    pass


class UnsupportedCmpOp(QueryError):
    pass


class ObjectIdTooLarge(QueryError):
    pass


class Query:
    """Base of all nodes."""


@dataclass(frozen=True)
class HasTag(Query):
    tag: str
    direct: bool = False  # only tags set by a user, not those implied


@dataclass(frozen=True)
class HasAttr(Query):
    key: str
    op: str
    value: Value

    def __post_init__(self) -> None:
        if self.op not in OPS:
            raise UnsupportedCmpOp(self.op)


@dataclass(frozen=True)
class HasKey(Query):
    key: str


@dataclass(frozen=True)
class Under(Query):
    """The key's text is the path or lies below it."""

    key: str
    path: str
    context: str | None = None


@dataclass(frozen=True)
class Related(Query):
    predicate: str
    target: int


@dataclass(frozen=True)
class IsA(Query):
    tag: str


@dataclass(frozen=True)
class And(Query):
    parts: tuple[Query, ...] = ()


@dataclass(frozen=True)
class Or(Query):
    parts: tuple[Query, ...] = ()


@dataclass(frozen=True)
class Not(Query):
    part: Query


def walk(q: Query) -> Iterable[Query]:
    yield q
    for part in q.parts if isinstance(q, And | Or) else (q.part,) if isinstance(q, Not) else ():
        yield from walk(part)


def mentioned_tags(q: Query) -> list[str]:
    """Every tag named anywhere in the query, keys and predicates among them, sorted."""
    found = set()
    for n in walk(q):
        found |= {getattr(n, a) for a in ("tag", "key", "predicate") if hasattr(n, a)}
    return sorted(found)


def flatten(q: Query) -> Query:
    """And in And and Or in Or become one node. A double negation stays: it drops objects without tags."""
    if isinstance(q, Not):
        return Not(flatten(q.part))
    if not isinstance(q, And | Or):
        return q
    parts: list[Query] = []
    for p in map(flatten, q.parts):
        # An empty list is empty on its own, but would vanish in a longer one.
        parts += p.parts if type(p) is type(q) and p.parts else (p,)
    return type(q)(tuple(parts))


def explain(q: Query) -> str:
    """An indented tree, a line for each node."""
    out: list[str] = []

    def render(n: Query, depth: int) -> None:
        if isinstance(n, And | Or):
            line, parts = f"{type(n).__name__} [{len(n.parts)} children]", n.parts
        elif isinstance(n, Not):
            line, parts = "Not", (n.part,)
        else:
            parts = ()
            line = {
                HasTag: lambda: f"HasTag({n.tag}{', direct' if n.direct else ''})",
                IsA: lambda: f"IsA({n.tag})",
                HasAttr: lambda: f"HasAttr(key={n.key}, op={n.op}, value={n.value})",
                HasKey: lambda: f"HasKey({n.key})",
                Under: lambda: f"Under(key={n.key}, path={n.path})",
                Related: lambda: f"Related(predicate={n.predicate}, target={format_oid(n.target)})",
            }[type(n)]()
        out.append("  " * depth + line)
        for p in parts:
            render(p, depth + 1)

    render(q, 0)
    return "\n".join(out) + "\n"


def like_pattern(pattern: str) -> re.Pattern:
    """SQL's LIKE without an escape: % for any text, _ for any character."""
    return re.compile("".join({"%": ".*", "_": "."}.get(c, re.escape(c)) for c in pattern), re.DOTALL)


def holds(op: str, stored: Value, wanted: Value) -> bool:
    """One stored value against one wanted value, for every op but !=."""
    if stored.context is not None or stored.type != wanted.type:
        return False
    if op == "prefix":
        return wanted.type == "text" and stored.raw.startswith(wanted.raw)
    if op == "contains":
        return wanted.type == "text" and wanted.raw in stored.raw
    if op == "like":
        return wanted.type == "text" and like_pattern(wanted.raw).fullmatch(stored.raw) is not None
    c = compare(stored, wanted)
    return c is not None and {"=": c == 0, "<": c < 0, "<=": c <= 0, ">": c > 0, ">=": c >= 0}[op]


@dataclass
class View:
    """All that is known of one object."""

    tags: set[str] = field(default_factory=set)  # with implied ones
    direct: set[str] = field(default_factory=set)
    attrs: list[tuple[str, Value]] = field(default_factory=list)
    relations: set[tuple[str, int]] = field(default_factory=set)
    live: bool = True


def matches(q: Query, o: View, descendants: Callable[[str], Iterable[str]] = lambda t: (t,), universe: str = "tagged") -> bool:
    """Whether the object is in the query's result."""
    again = lambda p: matches(p, o, descendants, universe)
    values = [v for k, v in o.attrs if k == getattr(q, "key", None)]
    if isinstance(q, HasTag):
        return q.tag in (o.direct if q.direct else o.tags)
    if isinstance(q, IsA):
        return any(t in o.tags for t in descendants(q.tag))
    if isinstance(q, HasAttr):
        if q.op == "!=":
            return bool(values) and not any(holds("=", v, q.value) for v in values)
        return any(holds(q.op, v, q.value) for v in values)
    if isinstance(q, HasKey):
        return bool(values)
    if isinstance(q, Under):
        path = q.path.rstrip("/")
        return any(v.type == "text" and v.context == q.context and (v.raw == path or v.raw.startswith(path + "/")) for v in values)
    if isinstance(q, Related):
        return (q.predicate, q.target) in o.relations
    if isinstance(q, And):
        return bool(q.parts) and all(map(again, q.parts))
    if isinstance(q, Or):
        return any(map(again, q.parts))
    return (bool(o.tags) if universe == "tagged" else o.live) and not again(q.part)
