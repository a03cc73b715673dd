"""A command line over a store: a folder with an operation log in Parquet and the installed ontology modules."""

from __future__ import annotations

import argparse
import json
import os
import sys
import time
import tomllib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semlake.functions import values
from semlake.operators import content, facets, mutate, paths, watch
from semlake.operators.ontology import Module, Ontology, OntologyError
from semlake.plans import algebra as A
from semlake.plans import dsl, sql
from semlake.plans.compile import Collection, evaluate
from semlake.plans.select import run_sql
from semlake.sources import files
from semlake.sources.files import ManifestError, MissingContent
from semlake.storage import table
from semlake.streaming.watch import watch_stream

#: What a user can get wrong.
ERRORS = (A.QueryError, values.ValueError_, paths.PathError, watch.Unknown, OntologyError, ManifestError, MissingContent, content.ContentError, tomllib.TOMLDecodeError, OSError)
BLOBS = "content_hash string, data binary"


class Store:
    """Small enough mutations arrive one by one here; the log itself is folded as a DataFrame."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, Path(folder)
        (self.folder / "ops").mkdir(parents=True, exist_ok=True)
        self.meta_file = self.folder / "meta.json"
        self.meta = json.loads(self.meta_file.read_text()) if self.meta_file.exists() else {"modules": [], "tags": [], "contexts": [], "subs": [], "lsn": 0, "oid": 0}
        self.ontology = Ontology()
        for text in self.meta["modules"]:
            self.ontology = self.ontology.install(Module.parse(text))
        for t in self.meta["tags"]:
            self.ontology = self.ontology.register(t)
        for c in self.meta["contexts"]:
            self.ontology = paths.create_context(self.ontology, c)
        self.clock = mutate.Clock()

    def save(self) -> None:
        new = self.meta_file.with_suffix(".new")
        new.write_text(json.dumps(self.meta))
        os.replace(new, self.meta_file)

    def ops(self) -> DataFrame:
        if not any((self.folder / "ops").iterdir()):
            return mutate.ops_table(self.spark, [])
        return self.spark.read.schema(mutate.OPS_SCHEMA).parquet(str(self.folder / "ops"))

    def append(self, *rows: dict) -> None:
        for r in rows:
            self.meta["lsn"] += 1
            t = self.clock.tick()
            r |= {"lsn": self.meta["lsn"], "physical_ns": t.physical_ns, "logical": t.logical, "node": t.node}
        mutate.ops_table(self.spark, rows).coalesce(1).write.mode("append").parquet(str(self.folder / "ops"))
        self.save()

    def append_table(self, ops: DataFrame, size: int) -> None:
        """Append a log whose lsns are 1 to size, in any order, without bringing it here."""
        t, base = self.clock.tick(), self.meta["lsn"]
        stamped = ops.withColumns({"lsn": F.col("lsn") + F.lit(base), "physical_ns": F.lit(t.physical_ns), "logical": F.lit(t.logical), "node": F.lit(t.node)})
        stamped.select(*mutate.OPS_SCHEMA.fieldNames()).write.mode("append").parquet(str(self.folder / "ops"))
        self.meta["lsn"] += size
        self.save()

    def blobs(self) -> DataFrame:
        there = (self.folder / "blobs").exists()
        return self.spark.read.schema(BLOBS).parquet(str(self.folder / "blobs")) if there else self.spark.createDataFrame([], BLOBS)

    def keep(self, contents: DataFrame) -> None:
        """Add contents (content_hash, data)."""
        contents.select("content_hash", "data").write.mode("append").parquet(str(self.folder / "blobs"))

    def put(self, oid: int, data: bytes) -> None:
        one = self.spark.createDataFrame([(bytearray(data),)], "data binary").withColumn("content_hash", content.content_hash(F.col("data")))
        self.keep(one)
        self.append({"op": "write_blob", "oid": self.require(oid), "content_hash": one.first().content_hash, "size": len(data)})

    def collection(self) -> Collection:
        return mutate.fold(self.ops(), self.ontology)

    def name(self, tag: str) -> str:
        """The tag, registered as a label if it is new."""
        if self.ontology.resolve(tag) is None:
            self.ontology = self.ontology.register(tag)
            self.meta["tags"].append(tag)
        return self.ontology.resolve(tag)

    def require(self, oid: int) -> int:
        if self.ops().where((F.col("oid") == oid) & (F.col("op") == "create")).isEmpty():
            raise A.QueryError(f"no such object: {values.format_oid(oid)}")
        return oid

    # -- mutations

    def create(self, tags: list[str]) -> int:
        self.meta["oid"] += 1
        oid = values.oid(0, self.meta["oid"])
        self.append({"op": "create", "oid": oid}, *[{"op": "add_tag", "oid": oid, "tag": self.name(t)} for t in tags])
        return oid

    def tag(self, oid: int, tags: list[str], remove: bool = False) -> None:
        self.require(oid)
        self.append(*[{"op": "remove_tag" if remove else "add_tag", "oid": oid, "tag": self.name(t)} for t in tags])

    def set(self, oid: int, key: str, value: values.Value) -> None:
        self.append({"op": "set_attr", "oid": self.require(oid), "key": self.name(key)} | value.row())

    def delete(self, oid: int) -> None:
        self.append({"op": "delete", "oid": self.require(oid)})

    def populate(self, manifest: str, seed: int = 0) -> int:
        """Objects, their assertions and contents; nothing of it is gathered here. Returns how many objects."""
        text, folder = Path(manifest).read_text(), str(Path(manifest).parent)
        made = files.Manifest.parse(text, folder)
        ops, self.ontology = files.load_manifest(self.spark, text, folder, self.ontology)
        contents = table(files.manifest_contents(self.spark, text, folder, seed).withColumn("content_hash", content.content_hash(F.col("data"))), "contents")
        self.meta["modules"] = [m.to_toml() for m in self.ontology.modules.values()]
        self.meta["tags"] = [t for t in self.ontology.orphan_tags() if not t.startswith(paths.CONTEXT_PREFIX)]
        shift, width = self.meta["oid"], 1 + (ops.agg(F.max("lsn")).first()[0] or 0)
        local = lambda df: df.withColumn("oid", F.col("oid") + F.lit(shift))
        self.meta["oid"] += made.size
        self.append_table(local(ops), width)
        blobs = contents.select("oid", "content_hash", F.octet_length("data").cast("long").alias("size"))
        none = {f.name: F.lit(None).cast(f.dataType) for f in mutate.OPS_SCHEMA if f.name not in ("oid", "content_hash", "size")}
        written = blobs.withColumns(none | {"op": F.lit("write_blob"), "lsn": F.col("oid")})
        if not contents.isEmpty():
            self.keep(contents.dropDuplicates(["content_hash"]))
            self.append_table(local(written), made.size + 1)
        return made.size

    def import_files(self, folder: str, context: str, links: str) -> int:
        found, attrs = files.import_directory(self.spark, folder, context, self.meta["oid"] + 1, links)
        n = found.count()
        if not n:
            return 0
        first, none = self.meta["oid"], {f.name: F.lit(None).cast(f.dataType) for f in mutate.OPS_SCHEMA}
        lsn = (F.col("oid") - F.lit(first + 1)) * 4
        fill = lambda df, **how: df.withColumns({k: v for k, v in none.items() if k not in df.columns} | how).select(*none)
        created = fill(found.select("oid"), op=F.lit("create"), lsn=lsn + 1)
        written = fill(found.where("content_hash is not null").withColumnRenamed("blob_length", "size"), op=F.lit("write_blob"), lsn=lsn + 2)
        named = fill(attrs, op=F.lit("set_attr"), lsn=lsn + F.when(F.col("key") == paths.PATH_KEY, 3).otherwise(4))
        for key in (paths.PATH_KEY, "link-target"):
            self.name(key)
        self.meta["oid"] += n
        self.append_table(created.unionByName(written).unionByName(named), 4 * n)
        self.keep(files.directory_contents(self.spark, folder).join(found.select("content_hash").distinct(), "content_hash", "left_semi").dropDuplicates(["content_hash"]))
        return n


def _show(df: DataFrame, out) -> int:
    """Rows as they stream in, never all at once."""
    n = 0
    for r in df.toLocalIterator():
        print(*[values.format_oid(v) if c == "oid" else v for c, v in r.asDict().items()], sep="\t", file=out)
        n += 1
    return n


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="semlake")
    p.add_argument("--store", default="store")
    s = p.add_subparsers(dest="command", required=True)

    def add(name: str, *args: str, of=s, **options):  # noqa: ANN202
        q = of.add_parser(name)
        for a in args:
            q.add_argument(a.rstrip("*+"), nargs=a[-1] if a[-1] in "*+" else None)
        for k, v in options.items():
            q.add_argument(f"--{k}", **v)
        return q

    flag = {"action": "store_true"}
    add("create", "tags*")
    add("tag", "oid", "tags+")
    add("untag", "oid", "tags+")
    add("set", "oid", "key", "value", type={"choices": list(values.TYPES)})
    add("delete", "oid")
    add("put", "oid", "file")
    add("analyze", json=flag, top={"type": int, "default": 20})
    add("info", "oid")
    add("query", "text", sql=flag, explain=flag)
    add("sql", "statement*")
    add("explore", "tag", max={"type": int, "default": 20})
    add("status")
    add("populate", "manifest")
    o = s.add_parser("ontology").add_subparsers(dest="action", required=True)
    for name, args in (("list", ()), ("install", ("file",)), ("upgrade", ("file",)), ("remove", ("module",)), ("orphans", ()), ("show", ("tag",)), ("adopt", ("module", "tag"))):
        add(name, *args, of=o)
    w = s.add_parser("watch").add_subparsers(dest="action", required=True)
    for name, args in (("register", ("name", "text")), ("list", ()), ("drain", ("id",)), ("unsubscribe", ("id",))):
        add(name, *args, of=w)
    add("stream", "id", of=w, follow=flag)
    r = s.add_parser("project").add_subparsers(dest="action", required=True)
    for name, args in (("create-context", ("name",)), ("list-contexts", ()), ("set-path", ("context", "oid", "path")), ("tree", ("context",))):
        add(name, *args, of=r)
    add("import", "context", "folder", of=r, links={"choices": list(files.LINKS), "default": "follow"})
    add("export", "context", "output", of=r, oid={})
    return p


def run(spark: SparkSession, argv: list[str], out=sys.stdout) -> int:
    a = parser().parse_args(argv)
    store = Store(spark, a.store)
    say = lambda *x, **how: print(*x, file=out, **how)
    try:
        if a.command == "create":
            say(values.format_oid(store.create(a.tags)))
        elif a.command in ("tag", "untag"):
            store.tag(values.parse_oid(a.oid), a.tags, a.command == "untag")
        elif a.command == "set":
            raw = values.bare(a.value, times=True)
            if a.type and a.type != raw.type:
                convert = {"text": str, "int": int, "float": float, "timestamp": int, "blob": str.encode}[a.type]
                raw = values.Value(a.type, convert(a.value))
            store.set(values.parse_oid(a.oid), a.key, raw)
        elif a.command == "delete":
            store.delete(values.parse_oid(a.oid))
        elif a.command == "put":
            store.put(values.parse_oid(a.oid), Path(a.file).read_bytes())
        elif a.command == "analyze":
            analyze(store, a, say)
        elif a.command == "info":
            oid = store.require(values.parse_oid(a.oid))
            c = store.collection()
            n = facets.object_counts(c).where(F.col("oid") == oid).first()
            record = c.objects.where(F.col("oid") == oid).first()
            counts = [0, 0, 0] if n is None else [n.tag_count, n.attr_count, n.relation_count]
            say(f"object={values.format_oid(oid)}")
            say(f"state={record.state} blob_length={record.blob_length or 0} tag_count={counts[0]} attr_count={counts[1]} relation_count={counts[2]}")
            for x in facets.assertions_of(c, oid).orderBy("kind", "name").toLocalIterator():
                say({"tag": f"tag={x.name}", "attr": f"attr={x.name} value={x.shown}", "relation": f"relation={x.name} target={x.shown}"}[x.kind] + f" origin={x.origin}")
        elif a.command in ("query", "sql"):
            resolve = store.ontology.resolve
            if a.command == "query" and not a.sql:
                q = dsl.parse(a.text, resolve)
                if a.explain:
                    say(A.explain(q).rstrip())
                    return 0
                n = _show(evaluate(q, store.collection()).orderBy("oid"), out)
                say(f"({n} results)")
            elif a.command == "query" or a.statement:
                text = a.text if a.command == "query" else " ".join(a.statement)
                if a.command == "query" and a.explain:
                    say(sql.explain(text, resolve).rstrip())
                else:
                    _show(run_sql(sql.plan(text, resolve), store.collection()), out)
            else:
                repl(store, sys.stdin, out)
        elif a.command == "explore":
            tag = store.ontology.resolve(a.tag)
            if tag is None:
                raise A.UnknownTag(a.tag)
            _show(facets.explore(store.collection(), A.HasTag(tag), a.max), out)
        elif a.command == "status":
            _show(facets.status(store.collection()), out)
        elif a.command == "populate":
            began = time.time()
            n = store.populate(a.manifest)
            say(f"{n} objects in {time.time() - began:.1f} s")
        elif a.command == "ontology":
            ontology(store, a, say)
        elif a.command == "watch":
            watching(store, a, say, out)
        else:
            projecting(store, a, say, out)
    except ERRORS as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


def ontology(store: Store, a: argparse.Namespace, say) -> None:
    o = store.ontology
    if a.action == "list":
        for m in sorted(o.modules.values(), key=lambda m: m.id):
            say(m.id, m.version, m.name)
    elif a.action in ("install", "upgrade"):
        m = Module.parse(Path(a.file).read_text())
        store.ontology = o.install(m) if a.action == "install" else o.upgrade(m)
    elif a.action == "remove":
        store.ontology = o.scrub(a.module)
    elif a.action == "orphans":
        say(*o.orphan_tags(), sep="\n")
    elif a.action == "adopt":
        store.ontology = o.adopt(a.module, a.tag)
    else:
        t = o.tags.get(a.tag)
        if t is None:
            raise A.UnknownTag(a.tag)
        say(f"{t.name} {t.semantics} {t.value_type or ''} closure: {' '.join(sorted(o.closure(t.name)))}")
    store.meta["modules"] = [m.to_toml() for m in store.ontology.modules.values()]
    store.meta["tags"] = [t for t in store.ontology.orphan_tags() if not t.startswith(paths.CONTEXT_PREFIX)]
    store.save()


def watching(store: Store, a: argparse.Namespace, say, out) -> None:
    held = {x["id"]: x for x in store.meta["subs"]}
    if a.action == "register":
        dsl.parse(a.text, store.ontology.resolve)
        new = {"id": max(held, default=0) + 1, "name": a.name, "query": a.text, "cursor": store.meta["lsn"] + 1}
        store.meta["subs"].append(new)
        say(new["id"])
    elif a.action == "list":
        for x in held.values():
            say(x["id"], x["name"], x["query"], watch.mask_names(watch.ALL))
    else:
        if int(a.id) not in held:
            raise watch.Unknown(a.id)
        x = held[int(a.id)]
        if a.action == "unsubscribe":
            store.meta["subs"].remove(x)
        elif a.action == "stream":
            streaming(store, x, a.follow, out)
            return
        else:
            sub = watch.Subscription(x["id"], x["name"], dsl.parse(x["query"], store.ontology.resolve), since=x["cursor"])
            events = watch.drain(store.ops(), sub, store.ontology).orderBy("physical_ns", "logical", "lsn", "step")
            _show(events.select(watch.json_line(store.ontology.ids)), out)
            x["cursor"] = store.meta["lsn"] + 1
    store.save()


def projecting(store: Store, a: argparse.Namespace, say, out) -> None:
    if a.action == "create-context":
        store.ontology = paths.create_context(store.ontology, a.name)
        store.meta["contexts"].append(a.name)
        store.save()
    elif a.action == "list-contexts":
        say(*paths.contexts(store.ontology), sep="\n")
    elif a.action == "set-path":
        value = values.Value("text", paths.check_path(a.path)).scoped(a.context)
        store.append({"op": "set_attr", "oid": store.require(values.parse_oid(a.oid)), "key": paths.PATH_KEY} | value.row())
    elif a.action == "tree":
        last = store.ops().where("op = 'set_attr'")
        _show(paths.tree(paths.paths(last, a.context, order="lsn")), out)
    elif a.action == "export":
        exporting(store, a, say)
    else:
        say(f"{store.import_files(a.folder, a.context, a.links)} files")


def exporting(store: Store, a: argparse.Namespace, say) -> None:
    """One object's content to a file, or all of a context's objects to a tree."""
    if a.context not in paths.contexts(store.ontology):
        raise paths.PathError(f"no context {a.context}: create it first")
    objects = store.collection().objects.where("state = 'active'")
    if a.oid is not None:
        oid = store.require(values.parse_oid(a.oid))
        found = objects.where(F.col("oid") == oid).join(store.blobs(), "content_hash").select("data").first()
        if found is None:
            raise MissingContent(f"no content for object {values.format_oid(oid)}")
        Path(a.output).parent.mkdir(parents=True, exist_ok=True)
        Path(a.output).write_bytes(found.data)
        say(f"wrote {len(found.data)} bytes for {values.format_oid(oid)} to {a.output}")
        return
    projected = paths.paths(store.ops().where("op = 'set_attr'"), a.context, order="lsn").join(objects.select("oid"), "oid", "left_semi")
    plan = table(files.export_plan(projected, objects), "plan")
    Path(a.output).mkdir(parents=True, exist_ok=True)
    n = files.execute_export(plan, store.blobs(), str(Path(a.output).absolute())).count()
    say(f"exported {n} objects from context {a.context} to {a.output}")


def streaming(store: Store, held: dict, follow: bool, out) -> None:
    """A subscription's events as JSON lines, as operations arrive; all that are there already, and on if asked to follow."""
    sub = watch.Subscription(held["id"], held["name"], dsl.parse(held["query"], store.ontology.resolve), since=held["cursor"])
    ops = store.spark.readStream.schema(mutate.OPS_SCHEMA).parquet(str(store.folder / "ops"))

    def show(batch: DataFrame, _: int) -> None:
        _show(batch.orderBy("physical_ns", "logical", "lsn", "step").select(watch.json_line(store.ontology.ids)), out)

    writer = watch_stream(ops, [sub], store.ontology).writeStream.foreachBatch(show).option("checkpointLocation", str(store.folder / f"stream-{held['id']}"))
    query = (writer if follow else writer.trigger(availableNow=True)).start()
    query.awaitTermination()


def analyze(store: Store, a: argparse.Namespace, say) -> None:
    """What the store holds: totals, the commonest tags, the newest objects and operations, modules and implications."""
    c, ops, o = store.collection(), store.ops(), store.ontology
    told = {
        "lsn": store.meta["lsn"],
        "status": facets.status(c).first().asDict(),
        "objects": {r.state: r["count"] for r in c.objects.groupBy("state").count().orderBy("state").collect()},
        "tags": [r.asDict() for r in facets.tag_summary(c).limit(a.top).collect()],
        "newest": [r.asDict() for r in c.objects.select("oid", "state", "blob_length", "last_lsn").orderBy(F.desc("last_lsn")).limit(a.top).collect()],
        "oplog": [r.asDict() for r in mutate.newest(ops.select("lsn", "op", "oid", "tag", "key"), a.top).collect()],
        "modules": [{"id": m.id, "version": m.version, "name": m.name, "tags": len(m.tags)} for m in sorted(o.modules.values(), key=lambda m: m.id)],
        "implications": [[x, y] for x in sorted(o.edges) for y in sorted(o.edges[x])],
    }
    if a.json:
        say(json.dumps(told))
        return
    for name, part in told.items():
        if isinstance(part, list):
            say(f"{name}:", *[f"  {' '.join(map(str, x.values() if isinstance(x, dict) else x))}" for x in part], sep="\n")
        else:
            say(f"{name}: {' '.join(f'{k}={v}' for k, v in part.items()) if isinstance(part, dict) else part}")


def repl(store: Store, lines, out) -> None:
    """Statements end with a semicolon; errors don't end the session."""
    held = ""
    for line in lines:
        word = line.strip()
        if not held and word in (".quit", ".exit"):
            return
        if not held and word.startswith("."):
            told = {".help": "statements end with ;  .tables .tags .schema .quit", ".tables": "objects", ".schema": "objects(<any attribute key>)", ".tags": "\n".join(sorted(store.ontology.tags))}
            print(told.get(word, f"unknown command {word}"), file=out)
            continue
        held += line
        if held.rstrip().endswith(";"):
            try:
                _show(run_sql(sql.plan(held, store.ontology.resolve), store.collection()), out)
            except ERRORS as e:
                print(f"error: {e}", file=out)
            held = ""


def main() -> int:
    spark = SparkSession.builder.appName("semlake").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    return run(spark, sys.argv[1:])


if __name__ == "__main__":
    sys.exit(main())
