"""The algebra, its languages, and evaluation."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from semlake.functions import values as V
from semlake.functions.values import Value
from semlake.operators.ontology import Module, Ontology, Tag, materialise
from semlake.plans import algebra as A
from semlake.plans import dsl, sql
from semlake.plans.compile import Collection, evaluate
from semlake.plans.select import run_sql

ATTRS = "oid long, key string, v_type string, v_text string, v_int long, v_float double, v_ts long, v_blob binary, v_ctx string"


def attrs_table(spark, rows):
    return spark.createDataFrame([(o, k, *v.row().values()) for o, k, v in rows], ATTRS)


def ids(df):
    return sorted(r.oid for r in df.collect())


@pytest.fixture(scope="module")
def shop(spark):
    tags = [(i, "electronics", "direct") for i in range(1, 11)] + [(i, "portable", "direct") for i in (3, 5, 7, 8)] + [(7, "discontinued", "direct")]
    attrs = [(i, "year", Value("int", 2024)) for i in (5, 7, 8, 9)] + [(20, "year", Value("int", 1)), (20, "year", Value("int", 9))]
    attrs += [(5, "year", Value("text", "old").scoped("ctx")), (6, "year", Value("float", 2024.0)), (1, "year", Value("int", 1).scoped("c"))]
    rels = spark.createDataFrame([(1, "near", 2), (3, "near", 2), (3, "far", 4)], "oid long, predicate string, target long")
    return Collection(spark.createDataFrame(tags, "oid long, tag string, origin string"), attrs_table(spark, attrs), rels)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("(and (tag electronics) (tag portable) (attr year = 2024) (not (tag discontinued)))", [5, 8]),
        ("(and)", []), ("(or)", []), ("(not (or))", list(range(1, 11))),
        ("(attr year = 2024.0)", [6]), ('(attr year = "2024")', []),
        ("(attr year != 2024)", [1, 6, 20]),  # has the key, no equal value; scoped values count as having it
        ("(and (attr year < 5) (attr year > 5))", [20]),  # by different values
        ("(not (attr year = 1))", list(range(1, 11))), ("(not (not (attr year = 1)))", []),  # untagged objects are not there
        ("(attr year prefix ol)", []), ("(related near obj:0:2)", [1, 3]), ("(tag ghost)", []),
    ],
)
def test_evaluate(shop, text, want):
    assert ids(evaluate(dsl.parse(text), shop)) == want


def test_nodes_beyond_the_language(spark):
    attrs = attrs_table(spark, [(1, "p", Value("text", "a/b").scoped("w")), (2, "p", Value("text", "a/bc").scoped("w")), (3, "p", Value("text", "a/b/c").scoped("w")), (4, "p", Value("text", "a/b"))])
    c = Collection(spark.createDataFrame([(1, "x", "direct"), (2, "x", "materialized")], "oid long, tag string, origin string"), attrs)
    assert ids(evaluate(A.Under("p", "a/b/", "w"), c)) == [1, 3]
    assert ids(evaluate(A.HasKey("p"), c)) == [1, 2, 3, 4]
    assert ids(evaluate(A.HasTag("x", direct=True), c)) == [1]
    with pytest.raises(A.QueryError):
        evaluate(A.Not(A.HasTag("x")), c, universe="live")


def test_extremes(spark):
    big = [("int", 2**63 - 1), ("float", float("inf")), ("float", float("nan")), ("text", "\U0010ffff" * 20), ("float", -0.0)]
    c = Collection(spark.createDataFrame([], "oid long, tag string, origin string"), attrs_table(spark, [(i, "k", Value(*v)) for i, v in enumerate(big)]))
    assert ids(evaluate(A.HasAttr("k", ">", Value("int", 0)), c)) == [0]
    assert ids(evaluate(A.HasAttr("k", ">=", Value("float", 1.0)), c)) == [1, 2]
    assert ids(evaluate(A.HasAttr("k", ">", Value("text", "\U0010ffff" * 19)), c)) == [3]
    assert ids(evaluate(A.HasAttr("k", "=", Value("float", 0.0)), c)) == [4]


NAMES = ["a", "b", "c", "d"]
LEAF = st.one_of(
    st.builds(A.HasTag, st.sampled_from(NAMES), st.booleans()), st.builds(A.IsA, st.sampled_from(NAMES)), st.builds(A.HasKey, st.sampled_from("kl")),
    st.builds(A.Related, st.sampled_from("pq"), st.integers(1, 3)),
    st.builds(A.HasAttr, st.sampled_from("kl"), st.sampled_from(A.OPS), st.one_of(st.builds(Value, st.just("int"), st.integers(0, 4)), st.builds(Value, st.just("text"), st.sampled_from(["x", "xy", "y"])))),
)
QUERY = st.recursive(LEAF, lambda q: st.one_of(st.builds(A.And, st.lists(q, max_size=3).map(tuple)), st.builds(A.Or, st.lists(q, max_size=3).map(tuple)), st.builds(A.Not, q)), max_leaves=6)


@pytest.fixture(scope="module")
def world(spark):
    rng = random.Random(3)
    o = Ontology().install(Module("m", "1", "m", [Tag(n) for n in NAMES], [("a", "b"), ("b", "c")]))
    views, tags, attrs, rels = {}, [], [], []
    for i in range(40):
        direct = {t for t in NAMES if rng.random() < 0.25}
        own = [(k, rng.choice([Value("int", rng.randint(0, 4)), Value("text", rng.choice(["x", "xy", "y"])), Value("int", 1).scoped("s")])) for k in "kkl" if rng.random() < 0.5]
        edges = {(p, rng.randint(1, 3)) for p in "pq" if rng.random() < 0.3}
        views[i] = A.View(o.closure(*direct), direct, own, edges)
        tags += [(i, t) for t in direct]
        attrs += [(i, k, v) for k, v in own]
        rels += [(i, *e) for e in edges]
    c = Collection(materialise(spark.createDataFrame(tags, "oid long, tag string"), o).cache(), attrs_table(spark, attrs).cache(), spark.createDataFrame(rels, "oid long, predicate string, target long").cache(), o)
    return views, c, o


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(q=QUERY)
def test_compiled_query_agrees_with_matching_each_object(world, q):
    views, c, o = world
    assert ids(evaluate(q, c)) == [i for i, v in views.items() if A.matches(q, v, o.descendants)]


# ---- S-expressions


def test_parse_and_print():
    for text in ('(and (tag a) (or (isa b) (not (attr k >= 5))))', '(attr k = "a \\"b\\" \\\\ é☃")', "(attr k < 2.0)", "(related p obj:ff:7)", '(tag "two words")', "(attr k prefix \"1\")"):
        q = dsl.parse(text)
        assert dsl.parse(dsl.to_sexpr(q)) == q
    assert dsl.parse("(attr k = 1_000)").value == Value("text", "1_000")
    assert dsl.parse("(attr k = +5)").value == Value("int", 5) and dsl.parse("(attr k = 1e5)").value == Value("float", 1e5)
    assert dsl.parse("(tag @42)", Ontology().resolve) == A.HasTag("@42")
    for q in (A.HasKey("k"), A.HasTag("a b", direct=True), A.Under("p", "x/y", "web"), A.Under("p", "x"), A.Not(A.HasAttr("k", "like", Value("text", "a%b")))):
        assert dsl.parse(dsl.to_sexpr(q)) == q
    with pytest.raises(A.QueryError):
        dsl.to_sexpr(A.HasAttr("k", "=", Value("blob", b"x")))


@pytest.mark.parametrize(
    ("text", "error"),
    [("(and (tag a) (tag b)", A.ParseError), ("(xor (tag a))", A.UnknownOp), ("(tag ghost)", A.UnknownTag), ("(tag a) x", A.ParseError), ("", A.ParseError), ('(tag "a', A.ParseError),
     ("(attr a ~ 1)", A.UnknownOp), ("(related a obj:7)", A.ParseError), ("(related a obj:1ffff:1)", A.ObjectIdTooLarge), ("(tag @x)", A.ParseError)],
)
def test_parse_errors(text, error):
    with pytest.raises(error):
        dsl.parse(text, lambda n: n if n in ("a", "b") else None)


def test_explain_and_tags():
    q = dsl.parse("(and (tag a) (not (attr k = 1)) (or))")
    assert A.explain(q) == "And [3 children]\n  HasTag(a)\n  Not\n    HasAttr(key=k, op==, value=1)\n  Or [0 children]\n"
    assert A.mentioned_tags(q) == ["a", "k"]
    assert A.flatten(A.And((A.And((A.HasTag("a"), A.HasTag("b"))), A.And()))) == A.And((A.HasTag("a"), A.HasTag("b"), A.And()))


# ---- SQL


def test_sql_plans():
    plan = lambda where: sql.plan(f"SELECT * FROM objects WHERE {where}").query
    assert sql.plan("select * from OBJECTS o").query == A.Not(A.Or())
    assert plan("tag = 'a' AND (year >= -3 OR o.year < 1.5) AND NOT isa('b')") == A.And(
        (A.HasTag("a"), A.Or((A.HasAttr("year", ">=", Value("int", -3)), A.HasAttr("year", "<", Value("float", 1.5)))), A.Not(A.IsA("b")))
    )
    assert plan("flag = TRUE") == A.HasAttr("flag", "=", Value("int", 1))
    assert plan("n LIKE '%é'") == A.HasAttr("n", "contains", Value("text", "é")) and plan("n NOT LIKE 'x%'") == A.Not(A.HasAttr("n", "prefix", Value("text", "x")))
    assert plan('"my key" = \'it\'\'s\'') == A.HasAttr("my key", "=", Value("text", "it's"))
    assert plan("related('p', 7)") == A.Related("p", 7)
    p = sql.plan("SELECT COUNT(*) AS n FROM objects LIMIT 2, 5;")
    assert (p.count, p.offset, p.limit) == (True, 2, 5)
    assert sql.explain("SELECT * FROM objects LIMIT 3").splitlines() == ["SQL:", "  SELECT * FROM objects LIMIT 3", "Projection: *", "Aggregate: none", "Limit: 3", "Query:", "  Not", "    Or [0 children]"]


@pytest.mark.parametrize(
    "text",
    ["SELECT * FROM other", "SELECT a + 1 FROM objects", "SELECT *, a FROM objects", "SELECT DISTINCT * FROM objects", "SELECT * FROM objects GROUP BY a", "SELECT b FROM objects GROUP BY a", "SELECT a FROM objects GROUP BY a, b", "SELECT * FROM objects ORDER BY 1", "SELECT * FROM objects JOIN x ON 1=1",
     "SELECT * FROM objects, x", "SELECT * FROM objects LIMIT -1", "WITH a AS (SELECT 1) SELECT * FROM a", "SELECT * FROM objects UNION SELECT * FROM objects", "INSERT INTO objects VALUES (1)", "DELETE FROM objects", "VALUES (1)",
     "SELECT * FROM objects WHERE n LIKE 'a' ESCAPE 'b'", "SELECT a, COUNT(*) FROM objects", "SELECT * FROM objects ORDER BY SUM(a)", "SELECT median(a) FROM objects", "SELECT SUM(DISTINCT a) FROM objects", "SELECT a, a FROM objects", "SELECT * FROM objects WHERE tag <> 'a'", "SELECT * FROM objects WHERE n BETWEEN 1 AND 2",
     "SELECT * FROM objects WHERE n IS NULL", "SELECT * FROM objects WHERE 1 = n", "SELECT * FROM objects WHERE n = 1 + 1", "SELECT * FROM objects WHERE f(n) = 1", "SELECT * FROM objects WHERE n IN (SELECT 1)", "SELECT * FROM objects FETCH FIRST 1 ROW ONLY",
     "SELECT SUM(*) FROM objects", "SELECT * FROM objects HAVING a = 1", "SELECT * FROM objects; SELECT * FROM objects", "", "SELECT * FROM objects WHERE n ILIKE 'a'", "SELECT * FROM objects WHERE n", "SELECT * FROM objects QUALIFY 1"],
)
def test_sql_refuses(text):
    with pytest.raises(sql.SqlError):
        sql.plan(text)


def test_sql_runs(shop):
    assert [r.oid for r in run_sql(sql.plan("SELECT * FROM objects LIMIT 3 OFFSET 2"), shop).collect()] == [3, 4, 5]
    assert run_sql(sql.plan("SELECT COUNT(*) FROM objects LIMIT 4 OFFSET 8"), shop).first()[0] == 2
    same = "SELECT * FROM objects WHERE tag = 'electronics' AND tag IN ('portable') AND year = 2024 AND NOT tag = 'discontinued'"
    assert ids(run_sql(sql.plan(same), shop)) == [5, 8]


def test_sql_columns_groups_and_order(spark):
    rows = [(1, "kind", Value("text", "a")), (1, "n", Value("int", 5)), (1, "n", Value("int", 7)), (2, "kind", Value("text", "a")), (2, "n", Value("int", 7)), (3, "kind", Value("text", "b")),
            (4, "kind", Value("text", "b")), (4, "kind", Value("text", "c")), (4, "n", Value("int", 1)), (4, "n", Value("int", 9).scoped("x"))]
    tags = spark.createDataFrame([(i, "t", "direct") for i in range(1, 5)], "oid long, tag string, origin string")
    c = Collection(tags, attrs_table(spark, rows))
    ask = lambda text: [tuple(r) for r in run_sql(sql.plan(text), c).collect()]
    assert ask("SELECT id, n AS m FROM objects") == [(1, [5, 7]), (2, [7]), (3, []), (4, [1])]
    assert ask("SELECT * FROM objects ORDER BY n") == [(4,), (1,), (2,), (3,)] and ask("SELECT * FROM objects ORDER BY n DESC LIMIT 2") == [(1,), (2,)]
    assert sorted(ask("SELECT DISTINCT kind FROM objects")) == [(["a"],), (["b"],), (["b", "c"],)]
    text = "SELECT kind, COUNT(*) AS k, SUM(n), MIN(n), COUNT(DISTINCT n) AS d, COUNT(n) FROM objects GROUP BY kind ORDER BY kind"
    assert ask(text) == [("a", 2, 19, 5, 2, 3), ("b", 2, 1, 1, 1, 1), ("c", 1, 1, 1, 1, 1)]
    assert ask("SELECT kind FROM objects GROUP BY kind HAVING COUNT(*) > 1 AND SUM(n) < 5") == [("b",)]
    assert ask("SELECT AVG(n) AS mean, COUNT(DISTINCT kind) AS k FROM objects WHERE tag = 't'") == [(5.0, 3)]
    assert ask("SELECT COUNT(n) FROM objects WHERE kind = 'none'") == [(0,)]
    assert ask("SELECT * FROM objects WHERE kind LIKE '_'") == [(1,), (2,), (3,), (4,)] and ask("SELECT * FROM objects WHERE kind LIKE '%x%'") == []


def test_sql_fields_of_the_record(spark):
    from semlake.operators import mutate

    log = mutate.ops_table(spark, [{"lsn": i, "physical_ns": 10 * i} | o for i, o in enumerate([{"op": "create", "oid": 1}, {"op": "add_tag", "oid": 1, "tag": "t"}, {"op": "add_tag", "oid": 2, "tag": "t"}, {"op": "write_blob", "oid": 2, "content_hash": "h", "size": 33}])])
    c = mutate.fold(log, Ontology().register("t"))
    got = run_sql(sql.plan("SELECT id, created, modified, size FROM objects ORDER BY size DESC"), c).collect()
    assert [tuple(r) for r in got] == [(2, 20, 30, 33), (1, 0, 10, None)]


# ---- values


def test_values_and_ids(spark):
    assert V.parse_oid("obj:42") == V.parse_oid("obj:0x2a") == V.parse_oid("obj:0:42") == 42
    assert V.format_oid(V.oid(0xFFFF, 5)) == "obj:ffff:5" and V.parse_oid("obj:ffff:5") == V.oid(0xFFFF, 5) < 0
    assert [str(V.bare(w, times=True)) for w in ("5", "5.0", "ns:7", "s:2", "x", "9" * 20)] == ["5", "5.0", "ts:7", "ts:2000000000", '"x"', str(float("9" * 20))]
    assert str(Value("blob", b"abc").scoped("c")) == "scoped(c,blob[3])"
    with pytest.raises(V.ValueError_):
        Value("int", 1).scoped("a").scoped("b")
    assert V.from_python(True) == Value("int", 1) and V.from_python([1]) == Value("text", "[1]")
    row = spark.range(1).select(V.node_of(V.oid_column(0xFFFF, V.F.lit(9))).alias("n"), V.local_of(V.oid_column(0xFFFF, V.F.lit(9))).alias("l")).first()
    assert (row.n, row.l) == (0xFFFF, 9)


# ---- plans


@pytest.mark.parametrize(
    ("name", "table", "columns", "pushed"),
    [("q_attr_eq_int", "part", "p_partkey p_size", "EqualTo(p_size,10)"), ("q_bucket", "documents", "doc_id n_chars", "IsNotNull(n_chars)"),
     ("q_related", "orders", "o_orderkey o_custkey", "EqualTo(o_custkey,42)"), ("q_attr_range_multi", "lineitem", "l_orderkey l_quantity", "GreaterThanOrEqual(l_quantity,49.0)"),
     ("q_facets_selection", "documents", "doc_id n_chars", "GreaterThan(n_chars,1000)"), ("q_prefix", "part", "p_partkey p_name", "StringStartsWith(p_name,red)")],
)
def test_filters_reach_the_scan_of_the_keys_column(spark, name, table, columns, pushed):
    import re

    from semlake import catalogue

    plan = catalogue.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    scans = re.findall(r"FileScan parquet \[([^\]]*)\].*?(\w+)\.parquet.*?PushedFilters: \[(.*?)\], ReadSchema", plan)
    read = [({c.split("#")[0] for c in s[0].split(",")}, s[2]) for s in scans if s[1] == table]
    assert any(c == set(columns.split()) and pushed in f for c, f in read)
    assert not any("text" in c for c, _ in read)
    if name in ("q_attr_eq_int", "q_related", "q_attr_range_multi", "q_bucket"):
        assert len(scans) == 1
