"""The library's queries by name, each over whole tables, and DuckDB SQL with the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semlake.functions.values import Value, oid, oid_column
from semlake.operators import content, facets, mutate, ontology, paths, relational, watch
from semlake.plans import algebra as A
from semlake.plans import dsl, sql
from semlake.plans.compile import Collection, evaluate
from semlake.plans.select import run_sql
from semlake.sources import tables as S

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

NODE = 1 << 48
PART, SUPPLIER, CUSTOMER, ORDER, DOC, PAGE, TURN, USER, VEC = (f"{n * NODE} + " for n in range(1, 10))
#: Part tags as a table in SQL: (oid, tag).
PART_TAGS = f"SELECT {PART}p_partkey AS oid, unnest(['type:' || p_type, 'brand:' || p_brand]) AS tag FROM part"
CUSTOMER_TAGS = (
    f"SELECT {CUSTOMER}c_custkey AS oid, unnest(['nation:' || n_name, 'segment:' || c_mktsegment, 'region:' || r_name, 'world']) AS tag, "
    "unnest(['direct', 'direct', 'materialized', 'materialized']) AS origin FROM customer JOIN nation ON c_nationkey = n_nationkey "
    "JOIN region ON n_regionkey = r_regionkey"
)
DOC_TAGS = (
    f"SELECT {DOC}doc_id AS oid, unnest(['lang:' || lang, 'source:' || source]) AS tag FROM documents UNION ALL "
    f"SELECT {DOC}doc_id, 'toxic' FROM labels WHERE toxic = 1 UNION ALL SELECT {DOC}doc_id, 'good' FROM labels WHERE quality = 1"
)
#: The operation log over users: (lsn, ns, op, oid, tag).
OPS = (
    f"SELECT event_id * 4 + nth AS lsn, epoch_us(ts) * 1000 AS ns, {USER}user_id AS oid, op, "
    "CASE WHEN event_type = 'signup' AND nth = 1 THEN 'member' WHEN event_type = 'purchase' AND nth = 0 THEN 'buyer' "
    "WHEN event_type IN ('error', 'click') THEN 'errored' END AS tag, value, props FROM (SELECT *, "
    "unnest(CASE event_type WHEN 'signup' THEN ['create', 'add_tag'] WHEN 'purchase' THEN ['add_tag', 'set_attr'] "
    "WHEN 'error' THEN ['add_tag'] WHEN 'click' THEN ['remove_tag'] ELSE ['write_blob'] END) AS op, "
    "unnest(CASE WHEN event_type IN ('signup', 'purchase') THEN [0, 1] ELSE [0] END) AS nth FROM events)"
)


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if oracle is not None:
            SQL[name] = oracle
        return f

    return add


def algebra(name: str, collection: Callable[[SparkSession, str], Collection], text: str | A.Query, oracle: str) -> None:
    """A query of the algebra, given as an S-expression or as nodes."""
    q = dsl.parse(text) if isinstance(text, str) else text
    query(name, oracle)(lambda spark, d: evaluate(q, collection(spark, d)))


def by_sql(name: str, collection: Callable[[SparkSession, str], Collection], text: str, oracle: str) -> None:
    query(name, oracle)(lambda spark, d: run_sql(sql.plan(text), collection(spark, d)))


def part_ids(where: str) -> str:
    return f"SELECT {PART}p_partkey AS oid FROM part WHERE {where}"


def lines(spark: SparkSession, d: str) -> Collection:
    return S.orders(spark, d, lines=True)


def related(spark: SparkSession, d: str) -> Collection:
    return S.orders(spark, d, relations=True)


def order_ids(having: str) -> str:
    return f"SELECT {ORDER}l_orderkey AS oid FROM lineitem GROUP BY l_orderkey HAVING {having}"


# ---- the algebra

algebra("q_has_tag", S.parts, "(tag type:PROMO)", part_ids("p_type = 'PROMO'"))
algebra("q_and", S.parts, "(and (tag type:PROMO) (tag brand:Brand#11))", part_ids("p_type = 'PROMO' AND p_brand = 'Brand#11'"))
algebra("q_or", S.parts, "(or (tag type:PROMO) (tag brand:Brand#11))", part_ids("p_type = 'PROMO' OR p_brand = 'Brand#11'"))
algebra("q_not", S.parts, "(not (tag type:PROMO))", part_ids("p_type <> 'PROMO'"))
algebra("q_and_empty", S.parts, "(or (and) (tag type:PROMO))", part_ids("p_type = 'PROMO'"))
algebra("q_or_empty", S.parts, "(and (not (or)) (not (and)) (not (tag type:PROMO)))", part_ids("p_type <> 'PROMO'"))
algebra("q_attr_eq_int", S.parts, "(attr size = 10)", part_ids("p_size = 10"))
algebra("q_attr_eq_text", S.parts, '(attr name = "blue bolt")', part_ids("p_name = 'blue bolt'"))
algebra("q_attr_eq_float", S.parts, "(attr price = 900.5)", part_ids("p_retailprice = 900.5"))
algebra("q_attr_ne", S.parts, "(attr size != 10)", part_ids("p_size <> 10"))
algebra("q_attr_ne_multi", lines, '(attr returnflag != "R")', order_ids("NOT bool_or(l_returnflag = 'R')"))
algebra("q_attr_lt", S.parts, "(attr size < 10)", part_ids("p_size < 10"))
algebra("q_attr_le", S.parts, "(attr price <= 950.0)", part_ids("p_retailprice <= 950"))
algebra("q_attr_gt", S.parts, '(attr name > "m")', part_ids("p_name > 'm'"))
algebra("q_attr_ge", S.parts, "(attr size >= 40)", part_ids("p_size >= 40"))
algebra(
    "q_attr_range_multi", lines, "(and (attr quantity >= 49.0) (attr quantity < 3.0))",
    order_ids("bool_or(l_quantity >= 49) AND bool_or(l_quantity < 3)"),
)
algebra(
    "q_attr_timestamp", S.orders, A.HasAttr("date", ">=", Value("timestamp", 978_307_200 * 10**9)),
    f"SELECT {ORDER}o_orderkey AS oid FROM orders WHERE o_orderdate >= TIMESTAMP '2001-01-01'",
)
algebra("q_type_mismatch", S.parts, "(or (attr size = 10.0) (attr price = 900) (attr size = \"10\") (attr size = 11))", part_ids("p_size = 11"))
algebra("q_prefix", S.parts, "(attr name prefix red)", part_ids("starts_with(p_name, 'red')"))
algebra("q_contains", S.documents, "(attr text contains License)", f"SELECT {DOC}doc_id AS oid FROM documents WHERE contains(text, 'License')")
algebra(
    "q_related", related, A.Related("placed_by", oid(3, 42)), f"SELECT {ORDER}o_orderkey AS oid FROM orders WHERE o_custkey = 42"
)
algebra("q_related_multi", related, A.Related("contains", oid(1, 7)), f"SELECT DISTINCT {ORDER}l_orderkey AS oid FROM lineitem WHERE l_partkey = 7")
CUSTOMERS_BY_REGION = f"SELECT {CUSTOMER}c_custkey AS oid FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
algebra("q_isa_region", S.customers, "(isa region:ASIA)", f"{CUSTOMERS_BY_REGION} WHERE r_name = 'ASIA'")
algebra("q_isa_world", S.customers, "(isa world)", CUSTOMERS_BY_REGION)
algebra("q_implied_tag", S.customers, '(tag "region:MIDDLE EAST")', f"{CUSTOMERS_BY_REGION} WHERE r_name = 'MIDDLE EAST'")
algebra(
    "q_universe_untagged", S.orders, '(not (attr priority = "1-URGENT"))',
    f"SELECT {ORDER}o_orderkey AS oid FROM orders WHERE o_totalprice >= 25000 AND o_orderpriority <> '1-URGENT'",
)
algebra(
    "q_double_not", S.orders, '(not (not (attr priority = "1-URGENT")))',
    f"SELECT {ORDER}o_orderkey AS oid FROM orders WHERE o_totalprice >= 25000 AND o_orderpriority = '1-URGENT'",
)
algebra(
    "q_design_doc", S.parts, "(and (tag type:PROMO) (attr size >= 10) (not (tag brand:Brand#13)))",
    part_ids("p_type = 'PROMO' AND p_size >= 10 AND p_brand <> 'Brand#13'"),
)
algebra("q_direct_only", S.customers, A.HasTag("nation:NATION_2", direct=True), f"{CUSTOMERS_BY_REGION} WHERE n_name = 'NATION_2'")
algebra("q_implied_not_direct", S.customers, A.And((A.HasTag("region:ASIA"), A.Not(A.HasTag("region:ASIA", direct=True)))), f"{CUSTOMERS_BY_REGION} WHERE r_name = 'ASIA'")
algebra("q_has_key", lines, A.HasKey("shipdate"), order_ids("true"))
algebra(
    "q_under", S.pages, A.Under("unix-path", "ththre.example.com", "web"),
    f"SELECT {PAGE}page_id AS oid FROM pages WHERE regexp_matches(url, '^[a-z]+://ththre\\.example\\.com([/?#]|$)')",
)


@query(
    "q_universe_live",
    f"SELECT {USER}user_id AS oid FROM events GROUP BY user_id HAVING coalesce(arg_max(event_type, (epoch_us(ts), event_id)) FILTER (event_type IN ('error', 'click')), 'click') <> 'error'",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    """Users that no error marks, with or without tags."""
    c = mutate.fold(S.operations(S.read(spark, d, "events")), S.user_ontology())
    return evaluate(A.Not(A.HasTag("errored")), c, universe="live")


# ---- SQL

by_sql("q_sql_star_limit_offset", S.parts, "SELECT * FROM objects WHERE size >= 40 LIMIT 20 OFFSET 5", part_ids("p_size >= 40 ORDER BY 1 LIMIT 20 OFFSET 5"))
by_sql("q_sql_star", S.orders, "SELECT * FROM objects", f"SELECT {ORDER}o_orderkey AS oid FROM orders WHERE o_totalprice >= 25000")
by_sql("q_sql_count", S.parts, "SELECT COUNT(*) FROM objects WHERE tag = 'type:PROMO' AND size < 25", "SELECT count(*) AS count FROM part WHERE p_type = 'PROMO' AND p_size < 25")
by_sql(
    "q_sql_count_limit", S.parts, "SELECT COUNT(*) FROM objects WHERE tag = 'type:PROMO' LIMIT 10 OFFSET 3",
    "SELECT least(greatest(count(*) - 3, 0), 10) AS count FROM part WHERE p_type = 'PROMO'",
)
by_sql("q_sql_in", S.parts, "SELECT * FROM objects WHERE tag IN ('type:PROMO', 'brand:Brand#8') AND size IN (1, 2, 3)", part_ids("(p_type = 'PROMO' OR p_brand = 'Brand#8') AND p_size IN (1, 2, 3)"))
by_sql("q_sql_not_in", S.parts, "SELECT * FROM objects WHERE size NOT IN (1, 2, 3)", part_ids("p_size NOT IN (1, 2, 3)"))
by_sql("q_sql_like_prefix", S.parts, "SELECT * FROM objects WHERE name LIKE 'small%'", part_ids("p_name LIKE 'small%'"))
by_sql("q_sql_like_contains", S.parts, "SELECT * FROM objects WHERE name LIKE '%widget'", part_ids("contains(p_name, 'widget')"))
by_sql(
    "q_sql_not_like", S.orders, "SELECT * FROM objects WHERE priority NOT LIKE '1%'",
    f"SELECT {ORDER}o_orderkey AS oid FROM orders WHERE o_totalprice >= 25000 AND o_orderpriority NOT LIKE '1%'",
)
by_sql("q_sql_isa", S.customers, "SELECT COUNT(*) FROM objects WHERE isa('region:EUROPE') OR acctbal < 0.0", f"SELECT count(*) AS count FROM ({CUSTOMERS_BY_REGION} WHERE r_name = 'EUROPE' OR c_acctbal < 0)")
by_sql("q_sql_related", related, f"SELECT * FROM objects WHERE related('placed_by', {oid(3, 7)})", f"SELECT {ORDER}o_orderkey AS oid FROM orders WHERE o_custkey = 7")

by_sql(
    "q_sql_project", S.parts, "SELECT id, name, size AS n FROM objects WHERE tag = 'type:PROMO' AND size >= 10",
    f"SELECT {PART}p_partkey AS id, [p_name] AS name, [p_size::BIGINT] AS n FROM part WHERE p_type = 'PROMO' AND p_size >= 10",
)
by_sql(
    "q_sql_project_multi", lines, "SELECT id, returnflag FROM objects WHERE quantity >= 50.0",
    f"SELECT {ORDER}l_orderkey AS id, list_sort(list(l_returnflag)) AS returnflag FROM lineitem GROUP BY l_orderkey "
    f"HAVING bool_or(l_quantity >= 50)",
)
by_sql("q_sql_distinct", S.orders, "SELECT DISTINCT priority FROM objects", "SELECT DISTINCT [o_orderpriority] AS priority FROM orders WHERE o_totalprice >= 25000")
by_sql(
    "q_sql_order_by", S.orders, "SELECT id, total FROM objects WHERE tag = 'status:F' ORDER BY total DESC, id LIMIT 50",
    f"SELECT {ORDER}o_orderkey AS id, [o_totalprice] AS total FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 25000 ORDER BY o_totalprice DESC, 1 LIMIT 50",
)
by_sql(
    "q_sql_group_by", S.orders, "SELECT priority, COUNT(*) AS n, MAX(total) AS most, COUNT(DISTINCT date) AS days FROM objects GROUP BY priority HAVING COUNT(*) > 100 ORDER BY n DESC",
    "SELECT o_orderpriority AS priority, count(*) AS n, max(o_totalprice) AS most, count(DISTINCT o_orderdate) AS days FROM orders WHERE o_totalprice >= 25000 GROUP BY ALL HAVING count(*) > 100",
)
by_sql(
    "q_count_distinct", lines, "SELECT COUNT(DISTINCT quantity) AS quantities, COUNT(DISTINCT returnflag) AS flags, COUNT(*) AS n, MIN(quantity) AS least FROM objects WHERE returnflag = 'R'",
    "WITH r AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R') SELECT count(DISTINCT l_quantity) AS quantities, count(DISTINCT l_returnflag) AS flags, "
    "count(DISTINCT l_orderkey) AS n, min(l_quantity) AS least FROM lineitem JOIN r USING (l_orderkey)",
)
by_sql("q_sql_like", S.parts, "SELECT * FROM objects WHERE name LIKE 's%_ll %t' OR name LIKE '%re%'", part_ids("p_name LIKE 's%_ll %t' OR p_name LIKE '%re%'"))


@query("q_sql_fields", f"SELECT oid AS id, created_ns AS created, blob_length AS size FROM (SELECT oid, min(ns) AS created_ns, (strlen(arg_max(props, (ns, lsn)) FILTER (op = 'write_blob')))::BIGINT AS blob_length FROM ({OPS}) GROUP BY oid HAVING bool_or(tag IN ('member', 'buyer')))")
def _(spark: SparkSession, d: str) -> DataFrame:
    c = mutate.fold(S.operations(S.read(spark, d, "events")), S.user_ontology())
    return run_sql(sql.plan("SELECT id, created, size FROM objects WHERE isa('account')"), c)


# ---- facets and tag sets


@query("q_facets_top10", f"SELECT tag, count(*) AS n FROM ({PART_TAGS}) GROUP BY tag ORDER BY n DESC, tag LIMIT 10")
def _(spark: SparkSession, d: str) -> DataFrame:
    return facets.facets(S.parts(spark, d).tags, k=10)


@query("q_facets_selection", f"SELECT tag, count(*) AS n FROM ({DOC_TAGS}) WHERE oid IN (SELECT {DOC}doc_id FROM documents WHERE lang = 'en' AND n_chars > 1000) GROUP BY tag")
def _(spark: SparkSession, d: str) -> DataFrame:
    return facets.explore(S.documents(spark, d), dsl.parse("(and (tag lang:en) (attr n_chars > 1000))"))


@query("q_facets_clusters", "SELECT 'cluster:' || label AS tag, count(*) AS n FROM embeddings WHERE label IS NOT NULL GROUP BY label")
def _(spark: SparkSession, d: str) -> DataFrame:
    return facets.facets(S.clusters(spark, d).tags.where("tag is not null"))


@query(
    "q_refine",
    f"WITH t AS ({PART_TAGS}), s AS (SELECT oid FROM t WHERE tag = 'type:PROMO' INTERSECT SELECT oid FROM t WHERE tag = 'brand:Brand#11') "
    "SELECT DISTINCT 'tag' AS kind, tag AS name FROM t WHERE oid IN (SELECT oid FROM s) AND tag NOT IN ('type:PROMO', 'brand:Brand#11') "
    "UNION ALL SELECT 'object', oid::VARCHAR FROM s",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return facets.refine(S.parts(spark, d).tags, ["type:PROMO", "brand:Brand#11"])


@query("q_tag_intersect", part_ids("p_type = 'SMALL' AND p_brand = 'Brand#8'"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return facets.intersect(S.parts(spark, d).tags, ["type:SMALL", "brand:Brand#8"])


@query("q_tag_union", part_ids("p_type = 'SMALL' OR p_brand = 'Brand#8'"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return facets.union(S.parts(spark, d).tags, ["type:SMALL", "brand:Brand#8", "no such tag"])


@query("q_value_catalogue", "SELECT DISTINCT o_orderpriority AS v_text FROM orders")
def _(spark: SparkSession, d: str) -> DataFrame:
    return facets.values_of(S.orders(spark, d).attrs, "priority").select("v_text")


@query("q_ordered_collection", f"SELECT 'conversation' AS tag, {TURN}conv_id * 1000 + turn AS oid, row_number() OVER (PARTITION BY conv_id ORDER BY turn) * 1048576 AS pos, {TURN}conv_id * 1000 AS of FROM conversations")
def _(spark: SparkSession, d: str) -> DataFrame:
    c = S.read(spark, d, "conversations")
    members = c.select(oid_column(7, F.col("conv_id") * 1000).cast("string").alias("tag"), oid_column(7, F.col("conv_id") * 1000 + F.col("turn")).alias("oid"))
    return facets.upgrade_to_ordered(members).select(F.lit("conversation").alias("tag"), "oid", "pos", F.col("tag").cast("long").alias("of"))


@query("q_ranked_topk", f"SELECT {DOC}doc_id AS oid, n_chars AS score FROM documents ORDER BY n_chars DESC, doc_id LIMIT 25")
def _(spark: SparkSession, d: str) -> DataFrame:
    docs = S.read(spark, d, "documents")
    members = docs.select(F.lit("long").alias("tag"), oid_column(5, F.col("doc_id")).alias("oid"), F.col("n_chars").alias("score"), F.col("doc_id").alias("seq"))
    return facets.ranked(members, "long", 25)


# ---- ontology


@query(
    "q_closure_table",
    "WITH RECURSIVE e AS (SELECT 'nation:' || n_name AS a, 'region:' || r_name AS b FROM nation JOIN region ON n_regionkey = r_regionkey "
    "UNION SELECT 'region:' || r_name, 'world' FROM region), t AS (SELECT a AS x FROM e UNION SELECT b FROM e), "
    "c AS (SELECT x AS tag, x AS ancestor FROM t UNION SELECT c.tag, e.b FROM c JOIN e ON c.ancestor = e.a) SELECT * FROM c",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return S.geo(spark, d).closure_table(spark)


@query("q_closure_add", CUSTOMER_TAGS)
def _(spark: SparkSession, d: str) -> DataFrame:
    return S.customers(spark, d).tags


@query(
    "q_remove_tag_cascade",
    f"WITH t AS ({CUSTOMER_TAGS}), gone AS (SELECT {CUSTOMER}7 AS oid) SELECT * FROM t WHERE oid NOT IN (SELECT oid FROM gone) UNION ALL "
    "SELECT * FROM t WHERE oid IN (SELECT oid FROM gone) AND tag LIKE 'segment:%'",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    """Customer 7 loses its nation: region and world, which nothing else implies, go with it."""
    c, one = S.customers(spark, d), oid(3, 7)
    nation = c.tags.where((F.col("oid") == one) & F.col("tag").startswith("nation:")).first().tag
    return mutate.remove_cascade(c.tags, one, nation, c.ontology)


@query("q_orphans", "SELECT DISTINCT 'segment:' || c_mktsegment AS tag FROM customer")
def _(spark: SparkSession, d: str) -> DataFrame:
    c = S.customers(spark, d)
    owned = c.ontology.tag_table(spark).where("module is not null")
    return c.tags.select("tag").distinct().join(owned, "tag", "left_anti")


@query("q_tag_cardinality", f"SELECT tag, count(*) AS n, count(*) FILTER (origin = 'direct') AS direct FROM ({CUSTOMER_TAGS}) GROUP BY tag")
def _(spark: SparkSession, d: str) -> DataFrame:
    return S.customers(spark, d).tags.groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("origin") == "direct", 1)).alias("direct"))


@query(
    "q_object_info",
    f"SELECT 'tag' AS kind, tag AS name, '' AS shown, origin FROM ({CUSTOMER_TAGS}) WHERE oid = {CUSTOMER}5 UNION ALL "
    "SELECT 'attr', 'name', c_name, 'direct' FROM customer WHERE c_custkey = 5 UNION ALL SELECT 'attr', 'acctbal', c_acctbal::VARCHAR, 'direct' FROM customer WHERE c_custkey = 5",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return facets.assertions_of(S.customers(spark, d), oid(3, 5))


@query("q_object_counts", f"SELECT {ORDER}o_orderkey AS oid, (o_totalprice >= 25000)::BIGINT AS tag_count, 3::BIGINT AS attr_count, 1 + 2 * (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS relation_count FROM orders UNION ALL SELECT {ORDER}l_orderkey, 0, 0, 2 * count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) GROUP BY l_orderkey")
def _(spark: SparkSession, d: str) -> DataFrame:
    return facets.object_counts(related(spark, d))


@query(
    "q_status",
    "SELECT (SELECT count(*) FROM part) AS objects, 2 * (SELECT count(*) FROM part) AS memberships, "
    "(SELECT count(DISTINCT p_type) + count(DISTINCT p_brand) FROM part) AS tags, 3 * (SELECT count(*) FROM part) AS attributes, 0::BIGINT AS relations",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return facets.status(S.parts(spark, d))


@query("q_audit_mutex", f"SELECT a.oid, 'toxic' AS tag, 'good' AS other FROM ({DOC_TAGS}) a JOIN ({DOC_TAGS}) b ON a.oid = b.oid AND a.tag = 'toxic' AND b.tag = 'good'")
def _(spark: SparkSession, d: str) -> DataFrame:
    o = ontology.Ontology().install(ontology.Module("m", "1", "m", [ontology.Tag("toxic"), ontology.Tag("good")], [], [("toxic", "mutex", "good")]))
    return ontology.mutex_violations(S.documents(spark, d).tags, o)


@query("q_audit_requires", f"SELECT {DOC}doc_id AS oid, 'toxic' AS tag, 'lang:en' AS other FROM labels JOIN documents USING (doc_id) WHERE toxic = 1 AND lang <> 'en'")
def _(spark: SparkSession, d: str) -> DataFrame:
    o = ontology.Ontology().install(ontology.Module("m", "1", "m", [ontology.Tag("toxic"), ontology.Tag("lang:en")], [], [("toxic", "requires", "lang:en")]))
    return ontology.missing_requirements(S.documents(spark, d).tags, o)


@query("q_audit_types", f"SELECT {PART}p_partkey AS oid, 'size' AS key, 'int' AS v_type, 'text' AS declared FROM part")
def _(spark: SparkSession, d: str) -> DataFrame:
    o = ontology.Ontology().register("size", "attribute", "text").register("name", "attribute", "text")
    return ontology.wrong_types(S.parts(spark, d).attrs, o)


@query("q_audit_single_valued", f"SELECT {ORDER}l_orderkey AS oid, 'quantity' AS key, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return relational.several_values(lines(spark, d).attrs, ["quantity"])


# ---- the operation log


def users(spark: SparkSession, d: str) -> DataFrame:
    return S.operations(S.read(spark, d, "events"))


FOLDED = (
    "SELECT oid, tag, 'direct' AS origin FROM (SELECT oid, tag, arg_max(op, (ns, lsn)) AS op FROM o WHERE tag IS NOT NULL GROUP BY ALL) WHERE op = 'add_tag'"
)


def folded(where: str) -> str:
    return (
        f"WITH o AS (SELECT * FROM ({OPS}) WHERE {where}), t AS ({FOLDED}) "
        "SELECT * FROM t UNION ALL SELECT DISTINCT oid, 'account', 'materialized' FROM t WHERE tag IN ('member', 'buyer')"
    )


@query("q_oplog_fold", folded("true"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return mutate.fold(users(spark, d), S.user_ontology()).tags


@query("q_as_of", folded("ns <= 1705000000000000000"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return mutate.fold(mutate.as_of(users(spark, d), physical_ns=1_705_000_000 * 10**9), S.user_ontology()).tags


@query("q_oplog_since", f"SELECT lsn, op, oid, tag FROM ({OPS}) WHERE lsn >= (SELECT 4 * max(event_id) // 2 FROM events)")
def _(spark: SparkSession, d: str) -> DataFrame:
    ops = users(spark, d)
    middle = S.read(spark, d, "events").agg(F.floor(4 * F.max("event_id") / 2)).first()[0] or 0
    return mutate.since(ops, middle).select("lsn", "op", "oid", "tag")


@query(
    "q_object_records",
    f"SELECT oid, 'active' AS state, min(ns) AS created_ns, max(ns) AS modified_ns, sha256(arg_max(props, (ns, lsn)) FILTER (op = 'write_blob')) AS content_hash, "
    f"(strlen(arg_max(props, (ns, lsn)) FILTER (op = 'write_blob')))::BIGINT AS blob_length, max(lsn) AS last_lsn FROM ({OPS}) GROUP BY oid",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return mutate.objects(users(spark, d))


@query("q_change_export", f"WITH a AS ({folded('ns <= 1705000000000000000')}), b AS ({folded('true')}) SELECT oid, tag, 'added' AS change FROM (SELECT oid, tag FROM b EXCEPT SELECT oid, tag FROM a) UNION ALL SELECT oid, tag, 'removed' FROM (SELECT oid, tag FROM a EXCEPT SELECT oid, tag FROM b)")
def _(spark: SparkSession, d: str) -> DataFrame:
    ops, o = users(spark, d), S.user_ontology()
    return mutate.changes(mutate.fold(mutate.as_of(ops, physical_ns=1_705_000_000 * 10**9), o).tags, mutate.fold(ops, o).tags, ["oid", "tag"])


@query(
    "q_snapshot_visible",
    "WITH v AS (SELECT user_id AS oid, day(ts) AS s, max(value) AS value, bool_or(event_type = 'error') AS gone FROM events GROUP BY ALL), "
    "w AS (SELECT oid, arg_max(value, s) AS value, arg_max(gone, s) AS gone FROM v GROUP BY oid) SELECT oid, value FROM w WHERE NOT gone",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    e = S.read(spark, d, "events").groupBy("user_id", F.dayofmonth("ts").alias("snapshot")).agg(F.max("value").alias("value"), F.bool_or(F.col("event_type") == "error").alias("whiteout"))
    return mutate.visible(e.withColumnRenamed("user_id", "oid"), range(1, 32))


@query("q_merge_lww", "SELECT user_id AS oid, arg_max(event_type, ts) AS state FROM events GROUP BY user_id")
def _(spark: SparkSession, d: str) -> DataFrame:
    e = S.read(spark, d, "events").select(F.col("user_id").alias("oid"), F.col("event_type").alias("state"), S.nanoseconds(F.col("ts")).alias("physical_ns"), F.lit(0).alias("logical"), F.lit(0).alias("node"))
    return mutate.merged(e, ["oid"], "state")


# ---- a log with operations of every kind

#: (lsn, ns, oid, op, tag, value, part, props) of S.histories.
LIFE = (
    f"SELECT event_id * 4 + nth AS lsn, epoch_us(ts) * 1000 AS ns, {USER}user_id AS oid, op, CASE WHEN op = 'remove_tag' THEN 'account' WHEN op = 'add_tag' AND event_type = 'signup' THEN 'member' "
    f"WHEN op = 'add_tag' THEN 'buyer' END AS tag, value, {PART}floor(value)::BIGINT AS part, props, event_type FROM (SELECT *, unnest(o) AS op, unnest(range(len(o))) AS nth FROM (SELECT *, "
    "CASE WHEN event_type = 'signup' THEN ['create', 'add_tag'] WHEN event_type = 'purchase' THEN ['add_tag', 'set_attr', 'add_relation'] WHEN event_type = 'error' THEN ['remove_attr', 'remove_tag'] "
    "WHEN event_type = 'click' THEN ['set_attr'] WHEN value > 300 THEN ['delete'] ELSE ['write_blob', 'remove_relation'] END AS o FROM events))"
)
#: The same without objects that are deleted in the end, and positions that sort as the log does.
LIVE = f"WITH o AS (SELECT *, row_number() OVER (ORDER BY ns, lsn) AS pos FROM ({LIFE})), l AS (SELECT * FROM o WHERE oid NOT IN (SELECT oid FROM o WHERE op = 'delete'))"


def lives(spark: SparkSession, d: str) -> DataFrame:
    return S.histories(S.read(spark, d, "events"))


def folded_lives(spark: SparkSession, d: str) -> Collection:
    return mutate.fold(lives(spark, d), S.user_ontology())


@query(
    "q_fold_implied_removed",
    f"{LIVE}, t AS (SELECT oid, tag, max(pos) AS pos FROM l WHERE op = 'add_tag' GROUP BY ALL), g AS (SELECT oid, max(pos) AS gone FROM l WHERE op = 'remove_tag' GROUP BY oid) "
    "SELECT oid, tag, 'direct' AS origin FROM t UNION ALL SELECT t.oid, 'account', 'materialized' FROM t LEFT JOIN g USING (oid) GROUP BY t.oid HAVING max(t.pos) > coalesce(max(gone), 0)",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    """Account is removed by itself, and comes back with the next member or buyer."""
    return folded_lives(spark, d).tags


@query(
    "q_fold_attrs",
    f"{LIVE}, g AS (SELECT oid, max(pos) AS gone FROM l WHERE op = 'remove_attr' GROUP BY oid) SELECT oid, CASE event_type WHEN 'click' THEN 'state' ELSE 'value' END AS key, "
    "CASE event_type WHEN 'click' THEN 'open' END AS v_text, CASE event_type WHEN 'purchase' THEN value END AS v_float FROM l LEFT JOIN g USING (oid) "
    "WHERE op = 'set_attr' AND (event_type = 'purchase' OR pos > coalesce(gone, 0))",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return folded_lives(spark, d).attrs.select("oid", "key", "v_text", "v_float")


@query("q_fold_relations", f"{LIVE} SELECT oid, 'bought' AS predicate, part AS target FROM (SELECT oid, part, arg_max(op, pos) AS op FROM l WHERE op LIKE '%relation' GROUP BY ALL) WHERE op = 'add_relation'")
def _(spark: SparkSession, d: str) -> DataFrame:
    return folded_lives(spark, d).rels


@query("q_fold_deleted", f"{LIVE} SELECT oid, CASE WHEN bool_or(op = 'delete') THEN 'tombstoned' ELSE 'active' END AS state, max(lsn) AS last_lsn FROM o GROUP BY oid")
def _(spark: SparkSession, d: str) -> DataFrame:
    return folded_lives(spark, d).objects.select("oid", "state", "last_lsn")


@query("q_fold_query", f"{LIVE} SELECT oid FROM l GROUP BY oid HAVING bool_or(op = 'add_tag' AND tag = 'buyer') AND NOT bool_or(op = 'set_attr' AND event_type = 'purchase' AND value > 200)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return evaluate(dsl.parse("(and (tag buyer) (not (attr value > 200.0)))"), folded_lives(spark, d))


@query(
    "q_hlc_ties",
    "SELECT user_id AS oid, arg_max(event_type, (event_id % 3, event_id % 5, event_id)) AS state FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_id % 3, event_id % 5 ORDER BY event_id DESC) AS r FROM events) WHERE r = 1 GROUP BY user_id",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    """One wall clock for all: counters decide, and nodes where these are equal."""
    e = S.read(spark, d, "events")
    e = e.groupBy(F.col("user_id").alias("oid"), (F.col("event_id") % 3).alias("logical"), (F.col("event_id") % 5).alias("node")).agg(F.max_by("event_type", "event_id").alias("state"))
    return mutate.merged(e.withColumn("physical_ns", F.lit(7)), ["oid"], "state")


# ---- subscriptions


def transitions(after: str, asked: str, sub_id: int = 1) -> str:
    """The events of a subscription over LIFE, from its membership after each operation, as SQL over windows w of o."""
    return (
        f"SELECT {sub_id}::BIGINT AS sub_id, lsn, ns AS physical_ns, oid, CASE WHEN kind LIKE 'Tag%' THEN tag END AS tag, kind, (kind = 'Exited' AND op = 'remove_tag' AND tag IN ({asked}))::INT AS step FROM ("
        f"SELECT *, unnest(CASE WHEN NOT before AND after THEN [CASE op WHEN 'create' THEN 'Created' ELSE 'Entered' END] WHEN before AND NOT after AND op = 'delete' THEN ['Deleted'] "
        f"WHEN before AND NOT after AND op = 'remove_tag' AND tag IN ({asked}) THEN ['TagRemoved', 'Exited'] WHEN before AND NOT after THEN ['Exited'] WHEN before AND after AND op = 'add_tag' THEN ['TagAdded'] "
        f"WHEN before AND after AND op = 'remove_tag' THEN ['TagRemoved'] WHEN before AND after AND op IN ('set_attr', 'remove_attr', 'write_blob') THEN ['ContentChanged'] ELSE [] END) AS kind FROM ("
        f"SELECT *, coalesce(lag(after) OVER (PARTITION BY oid ORDER BY pos), false) AS before FROM (SELECT *, coalesce({after}, false) AND NOT bool_or(op = 'delete') OVER w AS after "
        f"FROM (SELECT *, row_number() OVER (ORDER BY ns, lsn) AS pos FROM ({LIFE})) WINDOW w AS (PARTITION BY oid ORDER BY pos ROWS UNBOUNDED PRECEDING))))"
    )


LIFE_SUBS = [
    (dsl.parse('(attr state = "open")'), "coalesce(last_value(CASE WHEN op = 'remove_attr' THEN false WHEN op = 'set_attr' AND event_type = 'click' THEN true END IGNORE NULLS) OVER w, false)", "''"),
    (dsl.parse("(not (tag buyer))"), "bool_or(op = 'add_tag') OVER w AND NOT bool_or(op = 'add_tag' AND tag = 'buyer') OVER w", "'buyer'"),
    (dsl.parse("(tag account)"), "coalesce(max(pos) FILTER (op = 'add_tag') OVER w, 0) > coalesce(max(pos) FILTER (op = 'remove_tag') OVER w, 0)", "'account', 'member', 'buyer'"),
    (
        A.And((A.HasTag("buyer"), A.HasAttr("value", "<", Value("float", 20.0)))),
        "bool_or(op = 'add_tag' AND tag = 'buyer') OVER w AND bool_or(op = 'set_attr' AND event_type = 'purchase' AND value < 20) OVER w", "'buyer'",
    ),
]


def life_subscriptions() -> list[watch.Subscription]:
    return [watch.Subscription(i + 1, f"s{i + 1}", q, retention=None) for i, (q, _, _) in enumerate(LIFE_SUBS)]


for number, name in ((0, "q_watch_remove_attr"), (1, "q_watch_not"), (2, "q_watch_implied")):
    query(name, transitions(*LIFE_SUBS[number][1:], sub_id=number + 1))(
        lambda spark, d, n=number: watch.drain(lives(spark, d), life_subscriptions()[n], S.user_ontology()).select("sub_id", "lsn", "physical_ns", "oid", "tag", "kind", "step")
    )


@query("q_watch_several", " UNION ALL ".join(transitions(after, asked, i + 1) for i, (_, after, asked) in enumerate(LIFE_SUBS)))
def _(spark: SparkSession, d: str) -> DataFrame:
    """All subscriptions from one pass over the log."""
    return watch.derive_all(lives(spark, d), life_subscriptions(), S.user_ontology()).select("sub_id", "lsn", "physical_ns", "oid", "tag", "kind", "step")


@query("q_watch_retention_several", " UNION ALL ".join(f"SELECT * FROM (SELECT * FROM ({transitions(after, asked, i + 1)}) ORDER BY physical_ns DESC, lsn DESC, step DESC LIMIT 30)" for i, (_, after, asked) in enumerate(LIFE_SUBS)))
def _(spark: SparkSession, d: str) -> DataFrame:
    found = watch.derive_all(lives(spark, d), life_subscriptions(), S.user_ontology())
    return watch.retained(found, 30).select("sub_id", "lsn", "physical_ns", "oid", "tag", "kind", "step")


ERRORED_BUYERS = A.And((A.HasTag("errored"), A.HasTag("buyer")))
#: Membership after each operation, and before it.
STATES = (
    f"WITH o AS ({OPS}), s AS (SELECT *, coalesce(last_value(CASE WHEN tag = 'errored' THEN op = 'add_tag' END IGNORE NULLS) OVER w, false) AS e, "
    "coalesce(bool_or(tag = 'buyer') OVER w, false) AS b FROM o WINDOW w AS (PARTITION BY oid ORDER BY ns, lsn ROWS UNBOUNDED PRECEDING)), "
    "m AS (SELECT *, e AND b AS after, coalesce(lag(e AND b) OVER (PARTITION BY oid ORDER BY ns, lsn), false) AS before FROM s), "
    "k AS (SELECT *, unnest(CASE WHEN NOT before AND after THEN ['Entered'] WHEN before AND NOT after THEN ['TagRemoved', 'Exited'] "
    "WHEN before AND after AND op = 'add_tag' THEN ['TagAdded'] WHEN before AND after AND op = 'remove_tag' THEN ['TagRemoved'] "
    "WHEN before AND after AND op IN ('set_attr', 'write_blob') THEN ['ContentChanged'] ELSE [] END) AS kind FROM m), "
    "r AS (SELECT 1::BIGINT AS sub_id, lsn, ns AS physical_ns, oid, CASE WHEN kind LIKE 'Tag%' THEN tag END AS tag, kind, (kind = 'Exited')::INT AS step FROM k) "
)


def watched(spark: SparkSession, d: str, **options) -> DataFrame:  # noqa: ANN003
    sub = watch.Subscription(1, "errored buyers", ERRORED_BUYERS, **({"retention": None} | options))
    return watch.drain(users(spark, d), sub, S.user_ontology()).select("sub_id", "lsn", "physical_ns", "oid", "tag", "kind", "step")


query("q_watch_events", f"{STATES} SELECT * FROM r")(lambda spark, d: watched(spark, d))
query("q_watch_entered_exited", f"{STATES} SELECT * FROM r WHERE kind IN ('Entered', 'Exited')")(lambda spark, d: watched(spark, d, interest=watch.mask("Entered", "Exited")))
query("q_watch_mask", f"{STATES} SELECT * FROM r WHERE kind = 'ContentChanged'")(lambda spark, d: watched(spark, d, interest=watch.mask("ContentChanged")))
query("q_watch_retention", f"{STATES} SELECT * FROM r ORDER BY physical_ns DESC, lsn DESC, step DESC LIMIT 100")(lambda spark, d: watched(spark, d, retention=100))
query(
    "q_watch_debounce",
    f"{STATES}, n AS (SELECT *, lead(physical_ns) OVER (PARTITION BY oid ORDER BY physical_ns, lsn, step) AS next FROM r) SELECT * EXCLUDE next FROM n WHERE next IS NULL OR next - physical_ns > 3600000000000",
)(lambda spark, d: watched(spark, d, debounce_ns=3600 * 10**9))


# ---- relational forms


@query("q_group_by_having", "SELECT o_orderpriority AS priority, count(*) AS n, round(avg(o_totalprice), 4) AS mean, max(o_totalprice) AS most FROM orders WHERE o_totalprice >= 25000 GROUP BY ALL HAVING count(*) > 100")
def _(spark: SparkSession, d: str) -> DataFrame:
    c = S.orders(spark, d)
    made = relational.group_by(c.attrs, evaluate(A.Not(A.Or()), c), ("priority", "text"), {"n": ("count", "*", ""), "mean": ("avg", "total", "float"), "most": ("max", "total", "float")})
    return made.where("n > 100").withColumn("mean", F.round("mean", 4))


@query("q_project_multi", f"SELECT {ORDER}l_orderkey AS oid, list_sort(list(l_quantity)) AS quantity, list_sort(list(l_returnflag)) AS returnflag FROM lineitem GROUP BY l_orderkey HAVING bool_or(l_quantity >= 50)")
def _(spark: SparkSession, d: str) -> DataFrame:
    c = lines(spark, d)
    return relational.project(c.attrs, evaluate(dsl.parse("(attr quantity >= 50.0)"), c), {"quantity": "float", "returnflag": "text"})


@query("q_order_by_attr", f"SELECT {ORDER}o_orderkey AS oid, o_totalprice AS value FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 25000 ORDER BY o_totalprice DESC, 1 LIMIT 50")
def _(spark: SparkSession, d: str) -> DataFrame:
    c = S.orders(spark, d)
    return relational.order_by(c.attrs, evaluate(A.HasTag("status:F"), c), "total", "float", descending=True, limit=50)


@query("q_bucket", f"SELECT {DOC}doc_id AS oid, CASE WHEN n_chars < 500 THEN 'size:short' WHEN n_chars < 5000 THEN 'size:medium' ELSE 'size:long' END AS tag FROM documents")
def _(spark: SparkSession, d: str) -> DataFrame:
    return relational.bucket_tags(S.documents(spark, d).attrs, "n_chars", "int", [("size:short", None, 500), ("size:medium", 500, 5000), ("size:long", 5000, None)])


@query("q_value_implies", f"SELECT {ORDER}o_orderkey AS oid, CASE o_orderpriority WHEN '1-URGENT' THEN 'rush' ELSE 'soon' END AS tag FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def _(spark: SparkSession, d: str) -> DataFrame:
    return relational.value_implied_tags(S.orders(spark, d).attrs, [("priority", "1-URGENT", "rush"), ("priority", "2-HIGH", "soon")])


@query("q_implied_values", f"SELECT {PART}p_partkey AS oid, 'discount' AS key, CASE p_type WHEN 'PROMO' THEN 0.2 ELSE 0.1 END::DOUBLE AS v_float FROM part WHERE p_type IN ('PROMO', 'SMALL')")
def _(spark: SparkSession, d: str) -> DataFrame:
    rules = [("type:PROMO", "discount", Value("float", 0.2)), ("type:SMALL", "discount", Value("float", 0.1))]
    return relational.implied_values(S.parts(spark, d).tags, rules).select("oid", "key", "v_float")


@query(
    "q_audit_relation_target",
    f"SELECT {ORDER}l_orderkey AS oid, 'contains' AS predicate, {PART}l_partkey AS target, 'type:PROMO' AS tag FROM lineitem LEFT JOIN part ON l_partkey = p_partkey WHERE p_type IS DISTINCT FROM 'PROMO'",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return relational.relation_target_violations(related(spark, d).rels, S.parts(spark, d).tags, [("contains", "type:PROMO")])


@query("q_inverse", f"SELECT {CUSTOMER}o_custkey AS oid, 'placed' AS predicate, {ORDER}o_orderkey AS target FROM orders")
def _(spark: SparkSession, d: str) -> DataFrame:
    return relational.with_inverses(related(spark, d).rels, [("placed_by", "placed")]).where("predicate = 'placed'")


@query("q_composite", f"SELECT DISTINCT {CUSTOMER}o_custkey AS oid, 'bought' AS predicate, {PART}l_partkey AS target FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Customers bought what their orders contain: the inverse of placed_by, followed by contains."""
    rels = relational.with_inverses(related(spark, d).rels, [("placed_by", "placed")])
    return relational.composite(rels, "bought", "placed", "contains")


@query("q_order_by_sequence", f"SELECT {TURN}conv_id * 1000 + turn AS oid, row_number() OVER (ORDER BY conv_id, turn) * 1048576 AS pos FROM conversations WHERE role = 'assistant'")
def _(spark: SparkSession, d: str) -> DataFrame:
    c = S.conversations(spark, d)
    return relational.order_by_sequence(facets.upgrade_to_ordered(c.tags), evaluate(A.HasTag("role:assistant"), c), "role:assistant")


@query("q_presence", f"SELECT {DOC}doc_id AS oid, CASE WHEN text IS NULL THEN NULL WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'cached' WHEN sha256(text) IN (SELECT sha256(text) FROM documents JOIN labels USING (doc_id)) THEN 'cached' ELSE 'remote' END AS presence FROM documents")
def _(spark: SparkSession, d: str) -> DataFrame:
    """A node that has cached the contents of labelled documents."""
    docs = S.read(spark, d, "documents").select(oid_column(5, F.col("doc_id")).alias("oid"), "doc_id", content.content_hash(F.col("text")).alias("content_hash"))
    held = docs.join(S.read(spark, d, "labels").select("doc_id"), "doc_id", "left_semi").select("content_hash", F.lit("cached").alias("state"))
    return content.presence(docs, held)


@query("q_visible_facets", f"SELECT tag, count(*) AS n FROM ({PART_TAGS}) WHERE oid IN (SELECT {PART}p_partkey FROM part WHERE p_size < 20) GROUP BY tag")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Facets of all that a caller may see, who may see parts below a size."""
    return facets.facets(facets.visible_to(S.parts(spark, d), dsl.parse("(attr size < 20)")).tags)


@query("q_ranked_insert", f"SELECT {DOC}doc_id AS oid, n_chars AS score FROM documents")
def _(spark: SparkSession, d: str) -> DataFrame:
    docs = S.read(spark, d, "documents")
    added = docs.select(F.lit("long").alias("tag"), oid_column(5, F.col("doc_id")).alias("oid"), F.col("n_chars").alias("score"), F.col("doc_id").alias("seq"))
    return facets.ranked(facets.insert_ranked(facets.upgrade_to_ranked(added.limit(0)), added), "long")


@query("q_chunking_rules", f"SELECT {PART}p_partkey AS oid, CASE WHEN p_size >= 45 THEN 'cdc' ELSE 'fixed' END AS algo FROM part")
def _(spark: SparkSession, d: str) -> DataFrame:
    found = content.chunking_of(S.parts(spark, d), [({"algo": "cdc"}, dsl.parse("(attr size >= 45)"))], {"algo": "fixed"})
    return found.select("oid", F.col("params")["algo"].alias("algo"))


@query("q_traverse", f"SELECT DISTINCT {PART}l_partkey AS oid FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT'")
def _(spark: SparkSession, d: str) -> DataFrame:
    c = related(spark, d)
    return relational.traverse(c.rels, evaluate(dsl.parse('(attr priority = "1-URGENT")'), c), "contains")


@query("q_related_reverse", f"SELECT DISTINCT {ORDER}l_orderkey AS oid FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_type = 'PROMO'")
def _(spark: SparkSession, d: str) -> DataFrame:
    return relational.traverse(related(spark, d).rels, evaluate(A.HasTag("type:PROMO"), S.parts(spark, d)), "contains", reverse=True)


@query(
    "q_transitive",
    f"WITH RECURSIVE e AS (SELECT DISTINCT {ORDER}l_orderkey AS a, {PART}l_partkey AS b FROM lineitem), s AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), "
    f"r AS (SELECT b, 1 AS depth FROM s WHERE a = {PART}7 UNION SELECT s.b, depth + 1 FROM r JOIN s ON r.b = s.a WHERE depth < 12) "
    "SELECT b AS oid, min(depth) AS depth FROM r GROUP BY b",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    """Orders and parts that are reached from a part over what orders contain, either way: a relation full of cycles."""
    start = spark.createDataFrame([(oid(1, 7),)], "oid long")
    return relational.reachable(related(spark, d).rels, start, "contains", symmetric=True)


# ---- content, placement, paths


def piped(docs: DataFrame) -> DataFrame:
    stored = content.apply_pipeline(docs.select(oid_column(5, F.col("doc_id")).alias("oid"), F.col("text").alias("data")))
    intact = content.content_hash(content.decompress(F.col("stored"))).eqNullSafe(F.col("content_hash"))
    return stored.select("oid", "content_hash", "blob_length", intact.alias("intact"), (F.col("stored_size") < F.col("blob_length")).alias("smaller"), content.padded_length(F.col("blob_length")).alias("padded"))


def chunked(docs: DataFrame) -> DataFrame:
    return content.chunk_index(content.fixed_chunks(docs.select(F.col("doc_id").alias("oid"), F.col("text").alias("data")), 65_536))


@query("q_chunk_dedup", "WITH c AS (SELECT encode(text) AS data, unnest(range(0, strlen(text), 65536)) AS pos FROM documents) SELECT sha256(data[pos + 1 : pos + 65536]) AS hash, count(*) AS ref_count, any_value(least(65536, octet_length(data) - pos)) AS length FROM c GROUP BY ALL")
def _(spark: SparkSession, d: str) -> DataFrame:
    return chunked(S.read(spark, d, "documents"))


@query("q_content_dedup", "SELECT sha256(text) AS hash, count(*) AS ref_count, any_value(strlen(text)) AS length FROM documents GROUP BY sha256(text)")
def _(spark: SparkSession, d: str) -> DataFrame:
    docs = S.read(spark, d, "documents")
    return content.chunk_index(docs.select(content.content_hash(F.col("text")).alias("hash"), F.octet_length("text").cast("long").alias("length")))


@query("q_content_pipeline", f"SELECT {DOC}doc_id AS oid, sha256(text) AS content_hash, strlen(text) AS blob_length, true AS intact, (strlen(text) + 4095) // 4096 * 4096 AS padded FROM documents")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Whether a short text shrinks depends on the compressor, so SQL can't tell; no text comes back as none."""
    return piped(S.read(spark, d, "documents")).drop("smaller")


@query(
    "q_policy_resolution",
    f"SELECT oid, 'compression' AS axis, CASE WHEN bool_or(tag = 'nation:NATION_2') THEN 'nation:NATION_2' WHEN bool_or(tag = 'region:ASIA') THEN 'region:ASIA' ELSE 'world' END AS declared_by FROM ({CUSTOMER_TAGS}) GROUP BY oid",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    c = S.customers(spark, d)
    for tag, level in (("world", 1), ("region:ASIA", 5), ("nation:NATION_2", 9)):
        c.ontology.tags[tag].storage = {"compression": {"algo": "zstd", "level": level}}
    return content.policy_of_objects(c.tags, c.ontology)


@query(
    "q_placement",
    f"SELECT {PART}p_partkey AS oid, CASE WHEN p_size >= 45 THEN 'pin' WHEN p_type = 'PROMO' THEN 'prefer' WHEN p_brand = 'Brand#8' THEN 'replicate' ELSE 'default' END AS rule, "
    "CASE WHEN p_size >= 45 THEN 'nvme' WHEN p_type = 'PROMO' THEN 'ssd' WHEN p_brand = 'Brand#8' THEN 'two' ELSE 'hdd' END AS target FROM part",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    rules = [("replicate", "two", A.HasTag("brand:Brand#8")), ("prefer", "ssd", A.HasTag("type:PROMO")), ("pin", "nvme", A.HasAttr("size", ">=", Value("int", 45)))]
    return content.place(S.parts(spark, d), rules, "hdd")


SITE = "rtrim(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '/')"


@query("q_path_tree", f"SELECT {SITE} AS path, {PAGE}page_id AS oid FROM pages")
def _(spark: SparkSession, d: str) -> DataFrame:
    return paths.tree(paths.paths(S.pages(spark, d).attrs, "web"))


@query("q_path_ls", f"SELECT DISTINCT CASE WHEN contains({SITE}, '/') THEN 'dir' ELSE 'file' END AS kind, split_part({SITE}, '/', 1) AS name FROM pages")
def _(spark: SparkSession, d: str) -> DataFrame:
    return paths.listing(paths.paths(S.pages(spark, d).attrs, "web"))


@query("q_path_lookup", f"SELECT min({PAGE}page_id) AS oid FROM pages WHERE {SITE} = (SELECT {SITE} FROM pages WHERE page_id = 3)")
def _(spark: SparkSession, d: str) -> DataFrame:
    projected = paths.paths(S.pages(spark, d).attrs, "web")
    wanted = S.read(spark, d, "pages").where("page_id = 3").select(S.site_path(F.col("url"))).first()[0]
    return paths.lookup(projected, wanted)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
