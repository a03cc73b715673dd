"""Path projections: each context gives objects relative paths, kept as scoped attributes of the key unix-path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semlake.operators.ontology import Ontology, OntologyError

PATH_KEY = "unix-path"
CONTEXT_PREFIX = "unix-path-context:"


class PathError(ValueError):
    pass


def create_context(ontology: Ontology, name: str) -> Ontology:
    if CONTEXT_PREFIX + name in ontology.tags:
        raise OntologyError(f"context {name} exists")
    return ontology.register(CONTEXT_PREFIX + name, "grouping")


def contexts(ontology: Ontology) -> list[str]:
    return sorted(t.removeprefix(CONTEXT_PREFIX) for t in ontology.tags if t.startswith(CONTEXT_PREFIX))


def check_path(path: str) -> str:
    if not path or path.startswith("/") or "\0" in path or ".." in path.split("/"):
        raise PathError(f"not a relative path: {path!r}")
    return path


def paths(attrs: DataFrame, context: str, order: str | None = None) -> DataFrame:
    """(oid, path): the latest path of each object in the context (by the column order, else the largest path)."""
    own = attrs.where((F.col("key") == PATH_KEY) & (F.col("v_ctx") == context) & (F.col("v_type") == "text"))
    return own.groupBy("oid").agg(F.max_by("v_text", order or "v_text").alias("path"))


def tree(projected: DataFrame) -> DataFrame:
    return projected.select("path", "oid").orderBy("path", "oid")


def lookup(projected: DataFrame, path: str) -> DataFrame:
    """The first object with that path."""
    return projected.where(F.col("path") == path).orderBy("oid").limit(1).select("oid")


def listing(projected: DataFrame, directory: str = "") -> DataFrame:
    """(kind, name) in a directory: directories first, then files, each by name."""
    prefix = directory.strip("/") + "/" if directory.strip("/") else ""
    below = projected.where(F.col("path").startswith(prefix)).select(F.substr("path", F.lit(len(prefix) + 1)).alias("rest"))
    name = F.substring_index("rest", "/", 1)
    kind = F.when(F.instr("rest", "/") > 0, "dir").otherwise("file")
    return below.select(kind.alias("kind"), name.alias("name")).where("name <> ''").distinct().orderBy("kind", "name")
