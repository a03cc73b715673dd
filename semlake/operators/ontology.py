"""Tags' implications, modules and storage policies: a small graph that lives on the driver, and its closure as a table."""

from __future__ import annotations

import tomllib
from collections.abc import Iterable
from copy import deepcopy
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEMANTICS = ("label", "attribute", "grouping", "ordered-collection", "hierarchical")
VALUE_TYPES = ("text", "int", "float", "timestamp", "blob")
RELATIONS = {"mutex": "mutex", "mutually-exclusive": "mutex", "requires": "requires", "alias": "alias"}
AXES = ("chunking", "compression", "encryption")
DEFAULT_POLICY = {"chunking": None, "compression": {"algo": "none"}, "encryption": {"algo": "none"}}
#: A closure of more rows than this is joined without broadcasting it.
BROADCAST_ROWS = 500_000


class OntologyError(Exception):
    pass


class Cycle(OntologyError):
    pass


class UnknownName(OntologyError):
    pass


class AxisConflict(OntologyError):
    pass


class DuplicateModule(OntologyError):
    pass


class UpgradeRefused(OntologyError):
    pass


@dataclass
class Tag:
    name: str
    semantics: str = "label"
    value_type: str | None = None
    storage: dict | None = None


@dataclass
class Module:
    id: str
    version: str
    name: str
    tags: list[Tag] = field(default_factory=list)
    implications: list[tuple[str, str]] = field(default_factory=list)
    relations: list[tuple[str, str, str]] = field(default_factory=list)

    @staticmethod
    def parse(text: str) -> Module:
        """A module file; sections that it doesn't define are ignored."""
        raw = tomllib.loads(text)
        head = raw["module"]
        made = Module(head["id"], head["version"], head["name"])
        names = {t["name"] for t in raw.get("tags", [])}
        for t in raw.get("tags", []):
            if t["semantics"] not in SEMANTICS:
                raise OntologyError(f"no such semantics: {t['semantics']}")
            if t.get("value_type") not in (None, *VALUE_TYPES):
                raise OntologyError(f"no such value type: {t['value_type']}")
            if t.get("element_constraint", t["name"]) not in names:
                raise UnknownName(t["element_constraint"])
            storage = {a: {"algo": v} if isinstance(v, str) else v for a, v in (t.get("storage") or {}).items()}
            made.tags.append(Tag(t["name"], t["semantics"], t.get("value_type"), storage or None))
        made.implications = [(i["from"], i["to"]) for i in raw.get("implications", [])]
        for r in raw.get("relations", []):
            if r["kind"] not in RELATIONS:
                raise OntologyError(f"no such relation: {r['kind']}")
            made.relations.append((r["from"], RELATIONS[r["kind"]], r["to"]))
        return made

    def to_toml(self) -> str:
        quote = lambda s: '"' + s.replace("\\", "\\\\").replace('"', '\\"') + '"'
        value = lambda v: quote(v) if isinstance(v, str) else str(v)
        out = ["[module]", f"id = {quote(self.id)}", f"version = {quote(self.version)}", f"name = {quote(self.name)}"]
        for t in self.tags:
            out += ["", "[[tags]]", f"name = {quote(t.name)}", f"semantics = {quote(t.semantics)}"]
            if t.value_type:
                out.append(f"value_type = {quote(t.value_type)}")
            if t.storage:
                axes = ", ".join(f"{a} = {{ {', '.join(f'{k} = {value(x)}' for k, x in v.items())} }}" for a, v in t.storage.items())
                out.append(f"storage = {{ {axes} }}")
        for a, b in self.implications:
            out += ["", "[[implications]]", f"from = {quote(a)}", f"to = {quote(b)}"]
        for a, k, b in self.relations:
            out += ["", "[[relations]]", f"from = {quote(a)}", f"kind = {quote(k)}", f"to = {quote(b)}"]
        return "\n".join(out) + "\n"


class Ontology:
    """Operations give a new state; one that fails leaves the old one as it was."""

    def __init__(self) -> None:
        self.tags: dict[str, Tag] = {}
        self.ids: dict[str, int] = {}
        self.edges: dict[str, set[str]] = {}
        self.relations: set[tuple[str, str, str]] = set()
        self.modules: dict[str, Module] = {}
        self.largest = 0

    # -- names and ids

    def resolve(self, name: str) -> str | None:
        if name.startswith("@") and name[1:].isdigit():
            # A removed tag's members stay reachable by number.
            return next((n for n, i in self.ids.items() if i == int(name[1:])), name)
        return name if name in self.tags else None

    def register(self, name: str, semantics: str = "label", value_type: str | None = None) -> Ontology:
        """With this tag; one that exists stays as it is. Numbers are above all that were ever given."""
        if name in self.tags:
            return self
        out = deepcopy(self)
        out._add(Tag(name, semantics, value_type))
        return out

    def _add(self, tag: Tag) -> None:
        self.tags[tag.name] = tag
        self.edges.setdefault(tag.name, set())
        if tag.name not in self.ids:
            self.largest += 1
            self.ids[tag.name] = self.largest

    # -- the implication graph

    def add_implication(self, a: str, b: str) -> Ontology:
        out = deepcopy(self)
        out._imply(a, b)
        return out

    def _imply(self, a: str, b: str) -> None:
        for t in (a, b):
            if t not in self.tags:
                raise UnknownName(t)
        if a == b or a in self.closure(b):
            raise Cycle(f"{a} => {b}")
        self.edges[a].add(b)

    def remove_implication(self, a: str, b: str) -> Ontology:
        out = deepcopy(self)
        out.edges.get(a, set()).discard(b)
        return out

    def remove_tag(self, name: str) -> Ontology:
        out = deepcopy(self)
        out._drop(name)
        return out

    def _drop(self, name: str) -> None:
        self.tags.pop(name, None)
        self.edges.pop(name, None)
        for to in self.edges.values():
            to.discard(name)
        self.relations = {r for r in self.relations if name not in (r[0], r[2])}

    def closure(self, *tags: str) -> set[str]:
        """The tags and all that they imply, over any number of steps."""
        seen: set[str] = set()
        stack = list(tags)
        while stack:
            t = stack.pop()
            if t not in self.tags:
                raise UnknownName(t)
            if t not in seen:
                seen.add(t)
                stack += self.edges[t]
        return seen

    def is_a(self, a: str, b: str) -> bool:
        return a in self.tags and b in self.tags and b in self.closure(a)

    def direct_implies(self, tag: str) -> set[str]:
        return set(self.edges.get(tag, ()))

    def descendants(self, tag: str) -> set[str]:
        back: dict[str, set[str]] = {}
        for a, to in self.edges.items():
            for b in to:
                back.setdefault(b, set()).add(a)
        seen, stack = set(), [tag]
        while stack:
            t = stack.pop()
            if t not in seen:
                seen.add(t)
                stack += back.get(t, ())
        return seen

    def topological(self) -> list[str]:
        """Tags before what they imply; ties by number."""
        waiting = {t: 0 for t in self.tags}
        for to in self.edges.values():
            for b in to:
                waiting[b] += 1
        out, ready = [], sorted((t for t, n in waiting.items() if not n), key=self.ids.get)
        while ready:
            t = ready.pop(0)
            out.append(t)
            for b in self.edges[t]:
                waiting[b] -= 1
                if not waiting[b]:
                    ready = sorted([*ready, b], key=self.ids.get)
        return out

    # -- modules

    def install(self, m: Module) -> Ontology:
        if m.id in self.modules:
            raise DuplicateModule(m.id)
        return deepcopy(self)._merge(m)

    def upgrade(self, m: Module) -> Ontology:
        """Additions only: no tag goes and none changes its meaning."""
        old = self.modules.get(m.id)
        if old is None:
            raise UnknownName(m.id)
        new = {t.name: t for t in m.tags}
        for t in old.tags:
            if t.name not in new:
                raise UpgradeRefused(f"{t.name} is gone")
            if (new[t.name].semantics, new[t.name].value_type) != (t.semantics, t.value_type):
                raise UpgradeRefused(f"{t.name} changes its meaning")
        return deepcopy(self)._merge(m)

    def _merge(self, m: Module) -> Ontology:
        for t in m.tags:
            if t.name not in self.tags:
                self._add(deepcopy(t))
        for a, b in m.implications:
            self._imply(a, b)
        for a, kind, b in m.relations:
            for t in (a, b):
                if t not in self.tags:
                    raise UnknownName(t)
            self.relations.add((a, kind, b))
        self.modules[m.id] = m
        self._check_axes()
        return self

    def scrub(self, module_id: str) -> Ontology:
        """Without the module: what no other module claims goes."""
        if module_id not in self.modules:
            raise UnknownName(module_id)
        out = deepcopy(self)
        gone = out.modules.pop(module_id)
        rest = out.modules.values()
        for a, b in gone.implications:
            if not any((a, b) in m.implications for m in rest):
                out.edges.get(a, set()).discard(b)
        out.relations -= {r for r in gone.relations if not any(r in m.relations for m in rest)}
        for t in gone.tags:
            if not any(t.name == x.name for m in rest for x in m.tags):
                out._drop(t.name)
        return out

    def orphan_tags(self) -> list[str]:
        owned = {t.name for m in self.modules.values() for t in m.tags}
        return sorted(set(self.tags) - owned)

    def adopt(self, module_id: str, tag: str) -> Ontology:
        out = deepcopy(self)
        out.modules[module_id].tags.append(deepcopy(out.tags[tag]))
        return out

    # -- storage policies

    def declared(self, axis: str) -> list[str]:
        return [t for t, d in self.tags.items() if d.storage and d.storage.get(axis) is not None]

    def _check_axes(self) -> None:
        for axis in AXES:
            tags = self.declared(axis)
            for i, a in enumerate(tags):
                for b in tags[:i]:
                    if not self.is_a(a, b) and not self.is_a(b, a):
                        raise AxisConflict(f"{axis}: {a} and {b}")

    def policy(self, tags: Iterable[str]) -> dict:
        """For each axis what the most derived tag of the closure declares."""
        have, out = self.closure(*tags), dict(DEFAULT_POLICY)
        for axis in AXES:
            found = [t for t in self.declared(axis) if t in have]
            for t in found:
                if all(self.is_a(t, o) for o in found):
                    out[axis] = self.tags[t].storage[axis]
        return out

    # -- tables

    def closure_rows(self) -> list[tuple[str, str]]:
        return [(t, a) for t in self.tags for a in sorted(self.closure(t))]

    def closure_table(self, spark: SparkSession) -> DataFrame:
        """(tag, ancestor), each tag its own ancestor too."""
        return rule_table(spark, self.closure_rows(), "tag string, ancestor string")

    def tag_table(self, spark: SparkSession) -> DataFrame:
        owner = {t.name: m.id for m in self.modules.values() for t in m.tags}
        rows = [(self.ids[t.name], t.name, t.semantics, t.value_type, owner.get(t.name)) for t in self.tags.values()]
        return spark.createDataFrame(rows, "tag_id int, tag string, semantics string, value_type string, module string")


def rule_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """What the driver holds as a table; broadcast only up to a fixed number of rows."""
    made = spark.createDataFrame(rows, schema)
    return F.broadcast(made) if len(rows) <= BROADCAST_ROWS else made


def materialise(direct: DataFrame, ontology: Ontology) -> DataFrame:
    """(oid, tag, origin) with implied tags, from direct tags (oid, tag). A tag that is set stays direct."""
    closure = ontology.closure_table(direct.sparkSession)
    # Tags beyond the ontology imply only themselves.
    joined = direct.select("oid", "tag").join(closure, "tag", "left").select("oid", "tag", F.coalesce("ancestor", "tag").alias("ancestor"))
    return joined.groupBy("oid", F.col("ancestor").alias("tag")).agg(
        F.when(F.bool_or(F.col("tag") == F.col("ancestor")), "direct").otherwise("materialized").alias("origin")
    )


def mutex_violations(tags: DataFrame, ontology: Ontology) -> DataFrame:
    """(oid, tag, other) for objects with two tags that exclude each other: an audit, as nothing enforces it."""
    pairs = _pairs(tags.sparkSession, ontology, "mutex")
    return tags.select("oid", "tag").join(pairs, "tag").join(tags.select("oid", F.col("tag").alias("other")), ["oid", "other"]).select("oid", "tag", "other")


def missing_requirements(tags: DataFrame, ontology: Ontology) -> DataFrame:
    """(oid, tag, other) for objects that have tag but not the other one that it requires."""
    pairs = _pairs(tags.sparkSession, ontology, "requires")
    asked = tags.select("oid", "tag").join(pairs, "tag")
    return asked.join(tags.select("oid", F.col("tag").alias("other")), ["oid", "other"], "left_anti").select("oid", "tag", "other")


def _pairs(spark: SparkSession, ontology: Ontology, kind: str) -> DataFrame:
    return rule_table(spark, [(a, b) for a, k, b in sorted(ontology.relations) if k == kind], "tag string, other string")


def wrong_types(attrs: DataFrame, ontology: Ontology) -> DataFrame:
    """(oid, key, v_type, declared) for values of another type than their key declares."""
    rows = [(t.name, t.value_type) for t in ontology.tags.values() if t.value_type]
    declared = rule_table(attrs.sparkSession, rows, "key string, declared string")
    return attrs.join(declared, "key").where(F.col("v_type") != F.col("declared")).select("oid", "key", "v_type", "declared")
