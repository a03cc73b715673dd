"""The relational and text tables as collections of objects."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from semlake.functions.values import VALUE_COLUMNS, oid_column, typed
from semlake.operators.ontology import Module, Ontology, Tag, materialise
from semlake.plans.compile import Collection

NODES = {"part": 1, "supplier": 2, "customer": 3, "orders": 4, "documents": 5, "pages": 6, "conversations": 7, "users": 8, "embeddings": 9}
UNTAGGED_BELOW = 25_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nanoseconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) * 1000


def named(prefix: str, column: str) -> Column:
    return F.concat(F.lit(prefix + ":"), F.col(column))


def _tags(df: DataFrame, oid: Column, *names: Column, where: Column | None = None) -> DataFrame:
    rows = df if where is None else df.where(where)
    return rows.select(oid.alias("oid"), F.explode(F.array(*names)).alias("tag"))


def _attrs(df: DataFrame, oid: Column, values: dict[str, tuple[str, Column]], context: Column | None = None) -> DataFrame:
    """A row for each value that isn't null. Each key is a branch that reads its own column only: a filter on key and value
    reaches that column's scan, and the branches of other keys fall away."""
    parts = [df.where(c.isNotNull()).select(oid.alias("oid"), F.lit(k).alias("key"), *typed(t, c, context)) for k, (t, c) in values.items()]
    return reduce(DataFrame.unionByName, parts)


def _rels(df: DataFrame, oid: Column, predicate: str, node: int, local: Column) -> DataFrame:
    """A relation as a branch of its own, whose targets can be filtered by the column that they come from."""
    return df.select(oid.alias("oid"), F.lit(predicate).alias("predicate"), oid_column(node, local).alias("target"), local.cast("long").alias("target_local"))


def geo(spark: SparkSession, sf_dir: str) -> Ontology:
    """Nations imply their regions, regions the world: two small dimension tables."""
    regions = {r.r_regionkey: r.r_name for r in read(spark, sf_dir, "region").collect()}
    nations = [(r.n_name, r.n_regionkey) for r in read(spark, sf_dir, "nation").collect()]
    m = Module("geo", "1", "Geography", [Tag("world"), *[Tag(f"region:{n}") for n in sorted(regions.values())], *[Tag(f"nation:{n}") for n, _ in sorted(nations)]])
    m.implications = [(f"region:{n}", "world") for n in regions.values()] + [(f"nation:{n}", f"region:{regions[k]}") for n, k in nations]
    return Ontology().install(m)


def parts(spark: SparkSession, sf_dir: str) -> Collection:
    p, oid = read(spark, sf_dir, "part"), oid_column(NODES["part"], F.col("p_partkey"))
    tags = _tags(p, oid, named("type", "p_type"), named("brand", "p_brand")).withColumn("origin", F.lit("direct"))
    return Collection(tags, _attrs(p, oid, {"name": ("text", F.col("p_name")), "size": ("int", F.col("p_size")), "price": ("float", F.col("p_retailprice"))}), types={"name": "text", "size": "int", "price": "float"})


def customers(spark: SparkSession, sf_dir: str) -> Collection:
    nation = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    c, oid = read(spark, sf_dir, "customer"), oid_column(NODES["customer"], F.col("c_custkey"))
    ontology = geo(spark, sf_dir)
    tags = materialise(_tags(c.join(nation, "c_nationkey"), oid, named("nation", "n_name"), named("segment", "c_mktsegment")), ontology)
    return Collection(tags, _attrs(c, oid, {"name": ("text", F.col("c_name")), "acctbal": ("float", F.col("c_acctbal"))}), ontology=ontology)


def orders(spark: SparkSession, sf_dir: str, lines: bool = False, relations: bool = False) -> Collection:
    """Orders; with lines, the values of their line items as attributes (several of a key)."""
    o, oid = read(spark, sf_dir, "orders"), oid_column(NODES["orders"], F.col("o_orderkey"))
    tags = _tags(o, oid, named("status", "o_orderstatus"), where=F.col("o_totalprice") >= UNTAGGED_BELOW).withColumn("origin", F.lit("direct"))
    attrs = _attrs(o, oid, {"total": ("float", F.col("o_totalprice")), "priority": ("text", F.col("o_orderpriority")), "date": ("timestamp", nanoseconds(F.col("o_orderdate")))})
    rels = None
    item_oid = oid_column(NODES["orders"], F.col("l_orderkey"))
    if lines:
        items = read(spark, sf_dir, "lineitem")
        attrs = attrs.unionByName(_attrs(items, item_oid, {"quantity": ("float", F.col("l_quantity")), "returnflag": ("text", F.col("l_returnflag")), "shipdate": ("timestamp", nanoseconds(F.col("l_shipdate")))}))
    if relations:
        items = read(spark, sf_dir, "lineitem")
        rels = _rels(o, oid, "placed_by", NODES["customer"], F.col("o_custkey"))
        rels = rels.unionByName(_rels(items, item_oid, "contains", NODES["part"], F.col("l_partkey")))
        rels = rels.unionByName(_rels(items, item_oid, "supplied_by", NODES["supplier"], F.col("l_suppkey")))
    types = {"total": "float", "priority": "text", "date": "timestamp", "quantity": "float", "returnflag": "text", "shipdate": "timestamp"}
    return Collection(tags, attrs, rels, types=types)


def documents(spark: SparkSession, sf_dir: str) -> Collection:
    d, oid = read(spark, sf_dir, "documents"), oid_column(NODES["documents"], F.col("doc_id"))
    labels = read(spark, sf_dir, "labels")
    judged = labels.select(oid.alias("oid"), F.explode(F.array(F.when(F.col("toxic") == 1, "toxic"), F.when(F.col("quality") == 1, "good"))).alias("tag")).where("tag is not null")
    tags = _tags(d, oid, named("lang", "lang"), named("source", "source")).unionByName(judged).withColumn("origin", F.lit("direct"))
    return Collection(tags, _attrs(d, oid, {"n_chars": ("int", F.col("n_chars")), "text": ("text", F.col("text"))}))


def site_path(url: Column) -> Column:
    """Host and path, without scheme, query and fragment."""
    return F.rtrim(F.regexp_replace(F.regexp_replace(url, r"^[a-z]+://", ""), r"[?#].*$", ""), F.lit("/"))


def pages(spark: SparkSession, sf_dir: str) -> Collection:
    p, oid = read(spark, sf_dir, "pages"), oid_column(NODES["pages"], F.col("page_id"))
    host = F.concat(F.lit("site:"), F.substring_index(site_path(F.col("url")), "/", 1))
    attrs = _attrs(p, oid, {"unix-path": ("text", site_path(F.col("url")))}, context=F.lit("web"))
    return Collection(_tags(p, oid, host).withColumn("origin", F.lit("direct")), attrs)


def conversations(spark: SparkSession, sf_dir: str) -> Collection:
    c = read(spark, sf_dir, "conversations")
    oid = oid_column(NODES["conversations"], F.col("conv_id") * 1000 + F.col("turn"))
    rels = c.where("turn > 0").select(oid.alias("oid"), F.lit("in_conversation").alias("predicate"), oid_column(NODES["conversations"], F.col("conv_id") * 1000).alias("target"))
    return Collection(_tags(c, oid, named("role", "role")).withColumn("origin", F.lit("direct")), _attrs(c, oid, {"text": ("text", F.col("text"))}), rels)


def clusters(spark: SparkSession, sf_dir: str) -> Collection:
    e = read(spark, sf_dir, "embeddings")
    return Collection(_tags(e, oid_column(NODES["embeddings"], F.col("vec_id")), F.concat(F.lit("cluster:"), F.col("label").cast("string"))).withColumn("origin", F.lit("direct")))


def operations(events: DataFrame) -> DataFrame:
    """Events as an operation log over users: a signup creates and makes a member, a purchase makes a buyer and sets a
    value, an error marks and a click clears it, a view writes content. An event's operations are 4 n, 4 n + 1, ..."""
    kind = F.col("event_type")
    none = {c: F.lit(None).cast(t) for c, t in zip(VALUE_COLUMNS, ("string", "string", "long", "double", "long", "binary", "string"), strict=True)}

    def op(name: str, tag: str | None = None, key: str | None = None, value: bool = False, blob: bool = False) -> Column:
        columns = dict(none)
        if value:
            columns |= {"v_type": F.lit("float"), "v_float": F.col("value")}
        return F.struct(
            F.lit(name).alias("op"), F.lit(tag).cast("string").alias("tag"), F.lit(key).cast("string").alias("key"), *[columns[c].alias(c) for c in VALUE_COLUMNS],
            (F.sha2(F.col("props"), 256) if blob else F.lit(None).cast("string")).alias("content_hash"),
            (F.octet_length("props").cast("long") if blob else F.lit(None).cast("long")).alias("size"),
        )

    ops = (
        F.when(kind == "signup", F.array(op("create"), op("add_tag", "member")))
        .when(kind == "purchase", F.array(op("add_tag", "buyer"), op("set_attr", key="value", value=True)))
        .when(kind == "error", F.array(op("add_tag", "errored")))
        .when(kind == "click", F.array(op("remove_tag", "errored")))
        .when(kind == "view", F.array(op("write_blob", blob=True)))
    )
    rows = events.select("event_id", "ts", oid_column(NODES["users"], F.col("user_id")).alias("oid"), F.posexplode(ops).alias("nth", "o"))
    return rows.select(
        (F.col("event_id") * 4 + F.col("nth")).alias("lsn"), nanoseconds(F.col("ts")).alias("physical_ns"), F.lit(0).alias("logical"), F.lit(0).alias("node"),
        "o.op", "oid", "o.tag", "o.key", *[f"o.{c}" for c in VALUE_COLUMNS], F.lit(None).cast("long").alias("target"), "o.content_hash", "o.size",
    )


def histories(events: DataFrame) -> DataFrame:
    """Events as a log with operations of every kind. A signup creates and makes a member; a purchase makes a buyer, sets a
    value and relates the user to a part; an error takes the state away, and the implied tag account; a click sets the
    state; a view writes content and ends the relation to a part, or deletes the user if its value is above 300."""
    kind, part = F.col("event_type"), oid_column(NODES["part"], F.floor("value"))
    types = dict(zip(VALUE_COLUMNS, ("string", "string", "long", "double", "long", "binary", "string"), strict=True))

    def op(name: str, tag: str | None = None, key: str | None = None, target: Column | None = None, blob: bool = False, **values: Column) -> Column:
        columns = {c: values.get(c, F.lit(None)).cast(t).alias(c) for c, t in types.items()}
        return F.struct(
            F.lit(name).alias("op"), F.lit(tag).cast("string").alias("tag"), F.lit(key).cast("string").alias("key"), *columns.values(),
            (F.lit(None).cast("long") if target is None else target).alias("target"),
            (F.sha2(F.col("props"), 256) if blob else F.lit(None).cast("string")).alias("content_hash"),
            (F.octet_length("props").cast("long") if blob else F.lit(None).cast("long")).alias("size"),
        )

    state = {"v_type": F.lit("text"), "v_text": F.lit("open")}
    ops = (
        F.when(kind == "signup", F.array(op("create"), op("add_tag", "member")))
        .when(kind == "purchase", F.array(op("add_tag", "buyer"), op("set_attr", key="value", v_type=F.lit("float"), v_float=F.col("value")), op("add_relation", key="bought", target=part)))
        .when(kind == "error", F.array(op("remove_attr", key="state", **state), op("remove_tag", "account")))
        .when(kind == "click", F.array(op("set_attr", key="state", **state)))
        .when((kind == "view") & (F.col("value") > 300), F.array(op("delete")))
        .when(kind == "view", F.array(op("write_blob", blob=True), op("remove_relation", key="bought", target=part)))
    )
    rows = events.select("event_id", "ts", oid_column(NODES["users"], F.col("user_id")).alias("oid"), F.posexplode(ops).alias("nth", "o"))
    return rows.select(
        (F.col("event_id") * 4 + F.col("nth")).alias("lsn"), nanoseconds(F.col("ts")).alias("physical_ns"), F.lit(0).alias("logical"), F.lit(0).alias("node"),
        "o.op", "oid", "o.tag", "o.key", *[f"o.{c}" for c in VALUE_COLUMNS], "o.target", "o.content_hash", "o.size",
    )


def user_ontology() -> Ontology:
    """Buyers and members are accounts."""
    m = Module("users", "1", "Users", [Tag("account"), Tag("member"), Tag("buyer"), Tag("errored"), Tag("value", "attribute", "float")])
    m.implications = [("member", "account"), ("buyer", "account")]
    return Ontology().install(m)
