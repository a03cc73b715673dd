"""Manifests of objects, their contents, directories of files, synthetic objects, and export."""

from __future__ import annotations

import os
import tomllib
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from semlake.functions.values import VALUE_SCHEMA, Value, from_python, typed
from semlake.operators.mutate import OPS_SCHEMA, ops_table
from semlake.operators.ontology import Module, Ontology
from semlake.operators.paths import PATH_KEY, check_path
from semlake.storage import numbered, table

OBJECT_KEYS, GENERATE_KEYS = {"tags", "attrs"}, {"name", "count", "content_type", "min_size", "max_size", "tags", "attrs"}
#: Smallest and largest content in bytes by type, and of any other type. Fixed values.
SIZES = {"music": (1 << 20, 15 << 20), "video": (100 << 20, 1 << 30), "text": (1 << 10, 15 << 10)}
OTHER_SIZE = (1 << 10, 1 << 20)
#: Words that generated texts are made of.
VOCABULARY = [a + b for a in ("ka", "lo", "mi", "ren", "tu", "sel", "vor") for b in ("da", "nim", "sto", "ri", "pel")]


class ManifestError(ValueError):
    pass


class MissingContent(ValueError):
    """An object that should be exported has no content."""


@dataclass(frozen=True)
class Group:
    """Objects first, first + 1, ... that a [[generate]] section asks for."""

    first: int
    count: int
    tags: tuple[str, ...]
    attrs: tuple[tuple[str, Value], ...]
    content_type: str | None
    least: int
    most: int


@dataclass(frozen=True)
class Manifest:
    modules: tuple[Module, ...]
    objects: tuple[tuple[int, tuple[str, ...], tuple[tuple[str, Value], ...]], ...]
    groups: tuple[Group, ...]

    @staticmethod
    def parse(text: str, folder: str = ".") -> Manifest:
        raw = tomllib.loads(text)
        if extra := set(raw) - {"ontology", "objects", "generate"}:
            raise ManifestError(f"unknown keys: {sorted(extra)}")
        values = lambda o: tuple((k, v if isinstance(v, Value) else from_python(v)) for k, v in o.get("attrs", {}).items())
        at, objects, groups = 1, [], []
        for o in raw.get("objects", []):
            if extra := set(o) - OBJECT_KEYS:
                raise ManifestError(f"unknown keys: {sorted(extra)}")
            objects.append((at, tuple(o.get("tags", [])), values(o)))
            at += 1
        for g in raw.get("generate", []):
            if extra := set(g) - GENERATE_KEYS:
                raise ManifestError(f"unknown keys: {sorted(extra)}")
            if not isinstance(g.get("count"), int) or g["count"] < 0:
                raise ManifestError("generate asks for a count")
            kind = g.get("content_type")
            least, most = SIZES.get(kind, OTHER_SIZE)
            least, most = g.get("min_size", least), g.get("max_size", most)
            if least > max(most, g.get("max_size", least)):
                raise ManifestError("min_size above max_size")
            groups.append(Group(at, g["count"], tuple(g.get("tags", [])), values(g), kind, least, max(least, most)))
            at += g["count"]
        read = tuple(Module.parse((Path(folder) / path).read_text()) for path in raw.get("ontology", []))
        return Manifest(read, tuple(objects), tuple(groups))

    @property
    def size(self) -> int:
        return len(self.objects) + sum(g.count for g in self.groups)


def _substituted(v: Value, seq: Column, kind: str | None) -> Column:
    text = F.replace(F.lit(v.raw), F.lit("{seq}"), seq.cast("string"))
    return F.replace(text, F.lit("{type}"), F.lit(kind or ""))


def _generated(spark: SparkSession, g: Group, stride: int) -> DataFrame:
    """The operations of a group: a range of ids and an array of operations for each, all made where they are written."""
    seq = F.col("oid") - F.lit(g.first)
    none = {f.name: F.lit(None).cast(f.dataType) for f in OPS_SCHEMA}

    def op(name: str, tag: str | None = None, key: str | None = None, value: Value | None = None) -> Column:
        columns = none | {"op": F.lit(name), "tag": F.lit(tag).cast("string"), "key": F.lit(key).cast("string")}
        if value is not None:
            raw = _substituted(value, seq, g.content_type) if value.type == "text" else F.lit(value.raw)
            columns |= dict(zip(VALUE_SCHEMA.fieldNames(), typed(value.type, raw), strict=True))
        return F.struct(*[c.alias(n) for n, c in columns.items() if n not in ("lsn", "physical_ns", "logical", "node", "oid")])

    made = [op("create"), *[op("add_tag", t) for t in g.tags], *[op("set_attr", key=k, value=v) for k, v in g.attrs]]
    rows = spark.range(g.first, g.first + g.count).withColumnRenamed("id", "oid").select("oid", F.posexplode(F.array(*made)).alias("nth", "o"))
    lsn = F.col("oid") * stride + F.col("nth")
    zero = F.lit(0).alias
    return rows.select(lsn.alias("lsn"), lsn.alias("physical_ns"), zero("logical"), zero("node"), *[F.col("oid") if f.name == "oid" else F.col(f"o.{f.name}") for f in OPS_SCHEMA.fields[4:]])


def load_manifest(spark: SparkSession, text: str, folder: str = ".", ontology: Ontology | None = None) -> tuple[DataFrame, Ontology]:
    """The operation log that a manifest's objects amount to, and the ontology with its modules. Objects that the manifest
    spells out come from it; generated ones are made as a range, wherever the log is written."""
    m = Manifest.parse(text, folder)
    ontology = ontology or Ontology()
    for module in m.modules:
        ontology = ontology.install(module)
    entries = [(tags, attrs) for _, tags, attrs in m.objects] + [(g.tags, g.attrs) for g in m.groups if g.count]
    for tags, attrs in entries:
        for name in (*tags, *[k for k, _ in attrs]):
            ontology = ontology.register(name)
    stride = 1 + max((1 + len(t) + len(a) for t, a in entries), default=0)
    rows = []
    for oid, tags, attrs in m.objects:
        own = [{"op": "create"}, *[{"op": "add_tag", "tag": t} for t in tags], *[{"op": "set_attr", "key": k} | v.row() for k, v in attrs]]
        rows += [{"oid": oid, "lsn": oid * stride + n, "physical_ns": oid * stride + n} | r for n, r in enumerate(own)]
    ops = ops_table(spark, rows)
    for g in m.groups:
        ops = ops.unionByName(_generated(spark, g, stride))
    return ops, ontology


def _content(rng: np.random.Generator, kind: str, size: int) -> bytes:
    """Text in lines of words; music and video as frames with a header each, which compress a little; else random bytes."""
    if kind == "text":
        words = rng.choice(VOCABULARY, size // 3 + 2)
        lines = [" ".join(words[i : i + 12]) for i in range(0, len(words), 12)]
        return "\n".join(lines).encode()[:size]
    if kind in ("music", "video"):
        frame = 417 if kind == "music" else 1316
        out = rng.integers(0, 256, (-(-size // frame), frame), dtype=np.uint8)
        out[:, :4] = np.frombuffer(b"frm" + kind[:1].encode(), np.uint8)
        out[:, frame // 2 :] &= 0x0F
        return out.tobytes()[:size]
    return rng.integers(0, 256, size, dtype=np.uint8).tobytes()


def manifest_contents(spark: SparkSession, text: str, folder: str = ".", seed: int = 0) -> DataFrame:
    """(oid, data) for the generated objects that have a content type: sizes log-uniform between the group's bounds, the same
    for the same seed. One content at a time is held."""
    parts = []
    for g in Manifest.parse(text, folder).groups:
        if g.content_type is None or not g.count:
            continue

        def run(rows: Iterator[pa.RecordBatch], g: Group = g) -> Iterator[pa.RecordBatch]:
            for b in rows:
                for oid in b.column(0).to_pylist():
                    rng = np.random.default_rng([seed, oid])
                    size = int(np.exp(rng.uniform(np.log(max(1, g.least)), np.log(max(1, g.most)))))
                    data = _content(rng, g.content_type, min(max(size, g.least), g.most))
                    yield pa.RecordBatch.from_arrays([pa.array([oid], pa.int64()), pa.array([data], pa.binary())], names=["oid", "data"])

        parts.append(spark.range(g.first, g.first + g.count).mapInArrow(run, "oid long, data binary"))
    out = spark.createDataFrame([], "oid long, data binary")
    for p in parts:
        out = out.unionByName(p)
    return out


LINKS = ("follow", "record", "skip")


def _link(root: str) -> Column:
    """Where the first symbolic link on a path below the root points, else null. Only paths that this machine sees have any."""

    @F.arrow_udf("struct<target:string,last:boolean>")
    def found(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            out = []
            for path in part.to_pylist():
                steps, at = path.split("/"), None
                for n in range(1, len(steps) + 1):
                    name = os.path.join(root, *steps[:n])
                    if os.path.islink(name):
                        at = {"target": os.readlink(name), "last": n == len(steps)}
                        break
                out.append(at)
            yield pa.array(out, pa.struct([("target", pa.string()), ("last", pa.bool_())]))

    return found(F.col("path"))


def import_directory(
    spark: SparkSession, path: str, context: str, first_oid: int = 1, links: str = "follow", hidden: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Files below a folder: (oid, content_hash, blob_length) and path attributes scoped to the context. Hidden files are
    skipped unless asked for; ids follow the order of paths, and are ranks taken from sorted ranges. links: follow symbolic
    links, skip them, or record a linked file as an object without content whose attribute link-target says where it points
    (what lies below a linked folder is left out)."""
    if links not in LINKS:
        raise ValueError(f"links: one of {LINKS}")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    root = path.removeprefix("file://").rstrip("/") + "/"
    relative = F.substring_index(F.col("path"), root, -1)
    files = files if hidden else files.where(~F.concat(F.lit("/"), relative).contains("/."))
    kept = files.select(relative.alias("path"), F.sha2("content", 256).alias("content_hash"), F.col("length").alias("blob_length"))
    if links != "follow":
        kept = kept.withColumn("link", _link(root))
        kept = kept.where("link is null" if links == "skip" else "link is null or link.last")
        empty = {"content_hash": F.lit(None).cast("string"), "blob_length": F.lit(None).cast("long")}
        kept = kept.withColumns({c: F.when(F.col("link").isNull(), F.col(c)).otherwise(e) for c, e in empty.items()})
        kept = kept.withColumn("target", F.col("link.target")).drop("link")
    else:
        kept = kept.withColumn("target", F.lit(None).cast("string"))
    with_ids = table(numbered(kept, ["path"], "oid", first_oid), "files")
    scoped = with_ids.select("oid", F.lit(PATH_KEY).alias("key"), *typed("text", F.col("path"), F.lit(context)))
    pointing = with_ids.where("target is not null").select("oid", F.lit("link-target").alias("key"), *typed("text", F.col("target")))
    return with_ids.select("oid", "content_hash", "blob_length"), scoped.unionByName(pointing)


def directory_contents(spark: SparkSession, path: str) -> DataFrame:
    """(content_hash, data) of the files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.sha2("content", 256).alias("content_hash"), F.col("content").alias("data"))


def synthetic(spark: SparkSession, count: int, tags: list[str], attrs: dict[str, tuple[int, int]], seed: int = 0, per_object: int = 3) -> tuple[DataFrame, DataFrame]:
    """(oid, tag) and attributes with values in ranges, for count objects; the same for the same seed."""
    ids = spark.range(1, count + 1).withColumnRenamed("id", "oid")
    pick = lambda n: F.element_at(F.array(*map(F.lit, tags)), (F.pmod(F.xxhash64("oid", F.lit(seed), F.lit(n)), F.lit(len(tags))) + 1).cast("int"))
    tagged = ids.select("oid", F.explode(F.array_distinct(F.array(*map(pick, range(per_object))))).alias("tag"))
    none = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in VALUE_SCHEMA}
    structs = [
        F.struct(F.lit(k).alias("key"), *(none | {"v_type": F.lit("int").alias("v_type"), "v_int": (F.pmod(F.xxhash64("oid", F.lit(seed), F.lit(k)), F.lit(high - low + 1)) + low).alias("v_int")}).values())
        for k, (low, high) in attrs.items()
    ]
    made = ids.select("oid", F.explode(F.array(*structs)).alias("a")).select("oid", "a.*")
    return tagged, made


def export_plan(projected: DataFrame, objects: DataFrame) -> DataFrame:
    """(oid, path, content_hash): what an export of a projection (oid, path) writes; objects (oid, content_hash) without
    content have null there. Objects outside the projection are left out."""
    return projected.join(objects.select("oid", "content_hash"), "oid", "left").select("oid", "path", "content_hash")


def execute_export(plan: DataFrame, contents: DataFrame, folder: str) -> DataFrame:
    """Write a plan's files below a folder, with contents (content_hash, data); (path, bytes) of what was written. Nothing is
    written if any content is missing."""
    each = contents.dropDuplicates(["content_hash"])
    lost = plan.join(each.select("content_hash"), "content_hash", "left_anti").orderBy("oid").first()
    if lost is not None:
        raise MissingContent(f"no content for object {lost.oid} ({lost.path})")
    return export(plan.join(each, "content_hash").select("path", "data"), folder)


def export(blobs: DataFrame, folder: str) -> DataFrame:
    """Write blobs (path, data) below a folder that all executors share; (path, bytes) of what was written."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            sizes = []
            for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                to = Path(folder) / check_path(path)
                to.parent.mkdir(parents=True, exist_ok=True)
                to.write_bytes(data)
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64())], names=["path", "bytes"])

    return blobs.select("path", F.col("data").cast("binary").alias("data")).mapInArrow(run, "path string, bytes long")
