"""Ontology, facets, log, subscriptions (batch and stream), paths, content, sources and the command line."""

import io
import json
import random

import pytest
from pyspark.sql import functions as F

from semlake.functions.values import Value
from semlake.operators import content, facets, mutate, ontology, paths, relational, watch
from semlake.operators.ontology import Module, Ontology, Tag
from semlake.plans import algebra as A
from semlake.plans import dsl
from semlake.plans.compile import Collection, evaluate
from semlake.sources import files, tables
from semlake.streaming.watch import watch_stream

ROOT = "/root/testdata/sf0.001"


def ids(df):
    return sorted(r.oid for r in df.collect())


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: [(v is None, v) for v in r])


VEHICLES = Module("v", "1", "v", [Tag("car"), Tag("truck"), Tag("vehicle"), Tag("thing")], [("car", "vehicle"), ("truck", "vehicle"), ("vehicle", "thing")])


def test_ontology_graph():
    o = Ontology().install(VEHICLES)
    assert o.closure("car") == {"car", "vehicle", "thing"} and o.closure("car", "truck") == set(o.tags)
    assert o.is_a("car", "thing") and not o.is_a("vehicle", "car") and o.is_a("car", "car") and not o.is_a("ghost", "ghost")
    assert o.descendants("vehicle") == {"car", "truck", "vehicle"} and o.direct_implies("car") == {"vehicle"}
    assert [o.ids[t] for t in ("car", "truck", "vehicle", "thing")] == [1, 2, 3, 4]
    t = o.topological()
    assert t.index("car") < t.index("vehicle") < t.index("thing")
    for bad in (("thing", "car"), ("car", "car")):
        with pytest.raises(ontology.Cycle):
            o.add_implication(*bad)
    with pytest.raises(ontology.UnknownName):
        o.add_implication("car", "ghost")
    assert o.add_implication("car", "thing").direct_implies("car") == {"vehicle", "thing"} and o.direct_implies("car") == {"vehicle"}
    assert o.remove_implication("car", "vehicle").closure("car") == {"car"} and "car" not in o.remove_tag("car").tags
    assert o.register("x").register("x").ids["x"] == 5 and o.resolve("@1") == "car" and o.resolve("ghost") is None


def test_modules():
    o = Ontology().install(VEHICLES)
    with pytest.raises(ontology.DuplicateModule):
        o.install(VEHICLES)
    other = Module("w", "1", "w", [Tag("car"), Tag("boat")], [("boat", "vehicle")], [("car", "mutex", "boat")])
    both = o.install(other)
    assert both.scrub("v").tags.keys() == {"car", "boat"} and both.scrub("w").tags.keys() == o.tags.keys()
    with pytest.raises(ontology.UpgradeRefused):
        both.upgrade(Module("w", "2", "w", [Tag("boat")]))
    with pytest.raises(ontology.UpgradeRefused):
        both.upgrade(Module("w", "2", "w", [Tag("car", "grouping"), Tag("boat")]))
    assert "ship" in both.upgrade(Module("w", "2", "w", [Tag("car"), Tag("boat"), Tag("ship")])).tags
    assert both.register("loose").orphan_tags() == ["loose"] and both.register("loose").adopt("w", "loose").orphan_tags() == []
    assert Module.parse(both.modules["w"].to_toml()) == both.modules["w"]
    bad = '[module]\nid="m"\nversion="1"\nname="m"\n[requires]\nx="1"\n[[tags]]\nname="p"\nsemantics="ordered-collection"\nelement_constraint="audio"\n'
    with pytest.raises(ontology.UnknownName):
        Module.parse(bad)
    with pytest.raises(ontology.OntologyError):
        Module.parse(bad.replace("audio", "p") + '[[relations]]\nfrom="p"\nkind="implied-by"\nto="p"\n')


def test_policies(spark):
    z9, z1 = {"compression": {"algo": "zstd", "level": 9}}, {"compression": {"algo": "zstd", "level": 1}}
    o = Ontology().install(Module("p", "1", "p", [Tag("file", storage=z9), Tag("binary")], [("binary", "file")]))
    assert o.policy(["binary"])["compression"]["level"] == 9 and o.policy([])["compression"] == {"algo": "none"}
    o2 = Ontology().install(Module("p", "1", "p", [Tag("file", storage=z9), Tag("binary", storage=z1)], [("binary", "file")]))
    assert o2.policy(["binary"])["compression"]["level"] == 1
    with pytest.raises(ontology.AxisConflict):
        Ontology().install(Module("p", "1", "p", [Tag("a", storage=z9), Tag("b", storage=z1)]))
    assert Module.parse(o2.modules["p"].to_toml()) == o2.modules["p"]
    t = ontology.materialise(spark.createDataFrame([(1, "binary"), (2, "file")], "oid long, tag string"), o2)
    assert rows(content.policy_of_objects(t, o2)) == [(1, "compression", "binary"), (2, "compression", "file")]


def test_closure_of_objects(spark):
    o = Ontology().install(VEHICLES)
    none = spark.createDataFrame([], "oid long, tag string, origin string")
    one = mutate.add_closure(none, 1, "car", o)
    assert rows(one) == [(1, "car", "direct"), (1, "thing", "materialized"), (1, "vehicle", "materialized")]
    assert rows(mutate.remove_cascade(one, 1, "car", o)) == []
    two = mutate.add_closure(one, 1, "truck", o)
    assert rows(mutate.remove_cascade(two, 1, "car", o)) == [(1, "thing", "materialized"), (1, "truck", "direct"), (1, "vehicle", "materialized")]
    direct = mutate.add_closure(one, 1, "vehicle", o)  # set by the user as well: it stays
    assert (1, "vehicle", "direct") in rows(mutate.remove_cascade(direct, 1, "car", o))
    assert rows(mutate.remove_cascade(one, 1, "vehicle", o)) == [(1, "car", "direct"), (1, "thing", "materialized")]


def test_facets_and_collections(spark):
    tags = spark.createDataFrame([(i, "1", "direct") for i in range(1, 6)] + [(2, "2", "direct"), (3, "2", "direct"), (3, "3", "direct"), (9, "4", "direct")], "oid long, tag string, origin string")
    c = Collection(tags)
    assert [tuple(r) for r in facets.explore(c, A.HasTag("1")).collect()] == [("1", 5), ("2", 2), ("3", 1)]
    assert ids(facets.intersect(tags, ["1", "2"])) == [2, 3] and ids(facets.intersect(tags, [])) == [] and ids(facets.intersect(tags, ["1", "x"])) == []
    assert ids(facets.union(tags, ["3", "4", "x"])) == [3, 9]
    assert [tuple(r) for r in facets.refine(tags, ["2", "1"]).collect()] == [("tag", "3"), ("object", "2"), ("object", "3")]
    seq = facets.upgrade_to_ordered(tags.where("tag = '1'"))
    pushed = facets.push_ordered(seq, spark.createDataFrame([("1", 3, 0), ("1", 77, 1), ("new", 5, 0)], "tag string, oid long, seq long"))
    assert [r.oid for r in pushed.where("tag = '1'").orderBy("pos").collect()] == [1, 2, 3, 4, 5, 3, 77]
    assert [r.oid for r in facets.renumbered(pushed).where("tag = '1'").orderBy("pos").collect()] == [1, 2, 3, 4, 5, 3, 77]
    between = facets.insert_ordered(seq, spark.createDataFrame([("1", 50, 2, 0), ("1", 51, 2, 1), ("1", 52, None, 0), ("1", 53, 5, 0)], "tag string, oid long, after long, seq long"))
    assert [r.oid for r in between.orderBy("pos").collect()] == [52, 1, 2, 50, 51, 3, 4, 5, 53]
    tight = spark.createDataFrame([("t", 1, 1), ("t", 2, 2), ("t", 3, 3)], "tag string, oid long, pos long")
    assert [r.oid for r in facets.insert_ordered(tight, spark.createDataFrame([("t", 9, 2, 0)], "tag string, oid long, after long, seq long")).orderBy("pos").collect()] == [1, 2, 9, 3]
    with pytest.raises(ValueError):
        facets.insert_ordered(tight, spark.createDataFrame([("t", 9, 77, 0)], "tag string, oid long, after long, seq long"))
    board = facets.insert_ranked(facets.upgrade_to_ranked(tags.where("tag = '2'")), spark.createDataFrame([("2", 8, 4, 0), ("2", 9, 0, 1), ("2", 7, -1, 2)], "tag string, oid long, score long, seq long"))
    assert [(r.oid, r.score) for r in facets.ranked(board, "2").collect()] == [(8, 4), (2, 0), (3, 0), (9, 0), (7, -1)]
    part = facets.visible_to(c, A.HasTag("2"))
    assert [tuple(r) for r in facets.facets(part.tags).collect()] == [("1", 2), ("2", 2), ("3", 1)] and ids(evaluate(A.Not(A.HasTag("3")), part)) == [2]
    many = spark.range(5000).select(F.when(F.col("id") % 7 == 0, "b").otherwise("a").alias("tag"), F.col("id").alias("oid"))
    own = {t: [r.oid for r in facets.upgrade_to_ordered(many).where(F.col("tag") == t).orderBy("pos").collect()] for t in "ab"}
    assert own == {"a": [i for i in range(5000) if i % 7], "b": list(range(0, 5000, 7))} and facets.upgrade_to_ordered(many).agg(F.max("pos")).first()[0] == (5000 - 715) * facets.STRIDE
    gone = spark.createDataFrame([("1", 3)], "tag string, oid long")
    assert 3 not in ids(facets.without_members(pushed, gone))
    scored = spark.createDataFrame([("t", 1, 5, 0), ("t", 2, 9, 1), ("t", 3, 5, 2), ("u", 4, 99, 3)], "tag string, oid long, score long, seq long")
    assert [r.oid for r in facets.ranked(scored, "t").collect()] == [2, 1, 3]


def test_log(spark):
    o = Ontology().install(VEHICLES)
    ops = [
        {"op": "create", "oid": 1}, {"op": "add_tag", "oid": 1, "tag": "car"}, {"op": "set_attr", "oid": 1, "key": "n", **Value("int", 1).row()},
        {"op": "set_attr", "oid": 1, "key": "n", **Value("int", 1).row()}, {"op": "set_attr", "oid": 1, "key": "n", **Value("int", 2).row()},
        {"op": "add_relation", "oid": 1, "key": "near", "target": 2}, {"op": "create", "oid": 2}, {"op": "add_tag", "oid": 2, "tag": "truck"},
        {"op": "remove_attr", "oid": 1, "key": "n", **Value("int", 1).row()}, {"op": "remove_tag", "oid": 1, "tag": "car"}, {"op": "add_tag", "oid": 1, "tag": "truck"},
        {"op": "write_blob", "oid": 1, "content_hash": "h", "size": 3}, {"op": "delete", "oid": 2}, {"op": "set_attr", "oid": 1, "key": "n", **Value("int", 1).row()}, {"op": "mystery", "oid": 1},
    ]
    log = mutate.ops_table(spark, [r | {"lsn": i, "physical_ns": i} for i, r in enumerate(ops)])
    log = log.unionByName(log.where("lsn = 3"))  # replayed twice
    c = mutate.fold(log, o)
    assert rows(c.tags) == [(1, "thing", "materialized"), (1, "truck", "direct"), (1, "vehicle", "materialized")]
    assert sorted(r.v_int for r in c.attrs.collect()) == [1, 2] and rows(c.rels) == [(1, "near", 2)]
    assert [(r.oid, r.state, r.content_hash) for r in c.objects.orderBy("oid").collect()] == [(1, "active", "h"), (2, "tombstoned", None)]
    early = mutate.fold(mutate.as_of(log, lsn=8), o)
    assert rows(early.tags.where("origin = 'direct'")) == [(1, "car", "direct"), (2, "truck", "direct")] and early.attrs.count() == 1
    assert rows(mutate.changes(early.tags, c.tags, ["oid", "tag"])) == [(1, "car", "removed"), (1, "truck", "added"), (2, "thing", "removed"), (2, "truck", "removed"), (2, "vehicle", "removed")]
    assert mutate.newest(log, 2).count() == 2 and mutate.since(log, 13).count() == 2
    clock = mutate.Clock(3, wall=lambda: 100)
    assert clock.tick() == mutate.Timestamp(100, 0, 3) and clock.tick() == mutate.Timestamp(100, 1, 3)
    assert clock.receive(mutate.Timestamp(100, 7, 1)) == mutate.Timestamp(100, 8, 3) and clock.receive(mutate.Timestamp(500, 2, 1)) == mutate.Timestamp(500, 3, 3)


SUBS = [
    watch.Subscription(1, "both", A.And((A.HasTag("errored"), A.HasTag("buyer"))), retention=None),
    watch.Subscription(2, "accounts", A.And((A.IsA("account"), A.Not(A.HasAttr("value", ">", Value("float", 15.0))))), retention=None),
    watch.Subscription(3, "not", A.Not(A.HasTag("errored")), interest=watch.mask("Entered", "Exited", "Created"), retention=None),
    watch.Subscription(4, "asleep", A.HasTag("member"), active=False),
]


def test_watch_transitions(spark):
    o = Ontology().install(VEHICLES)
    ops = [{"op": "create", "oid": 1}, {"op": "add_tag", "oid": 1, "tag": "car"}, {"op": "add_tag", "oid": 1, "tag": "truck"}, {"op": "remove_tag", "oid": 1, "tag": "car"},
           {"op": "set_attr", "oid": 1, "key": "k", **Value("int", 1).row()}, {"op": "remove_tag", "oid": 1, "tag": "truck"}, {"op": "add_tag", "oid": 1, "tag": "car"}, {"op": "delete", "oid": 1}]
    log = mutate.ops_table(spark, [r | {"lsn": i, "physical_ns": i * 10} for i, r in enumerate(ops)])
    sub = watch.Register().register("v", A.HasTag("vehicle"))
    got = watch.drain(log, sub, o)
    assert [(r.lsn, r.kind, r.tag) for r in got.orderBy("lsn", "step").collect()] == [
        (1, "Entered", None), (2, "TagAdded", "truck"), (3, "TagRemoved", "car"), (4, "ContentChanged", None), (5, "TagRemoved", "truck"), (5, "Exited", None), (6, "Entered", None), (7, "Deleted", None)]
    assert watch.retained(got, 2).count() == 2 and [r.lsn for r in watch.debounced(got, 15).collect()] == [7]
    line = got.where("lsn = 2").select(watch.json_line(o.ids)).first()[0]
    assert line == '{"kind":"TagAdded","oid":1,"tag":2,"timestamp":{"physical_ns":20,"logical":0,"node_id":0}}'
    assert json.loads(got.where("lsn = 7").select(watch.json_line()).first()[0]).keys() == {"kind", "oid", "timestamp"}
    assert watch.mask_names(watch.mask("Entered", "TagAdded")) == "TAG_ADDED|ENTERED"
    with pytest.raises(watch.Unknown):
        watch.Register().unregister(5)
    a, b = (spark.createDataFrame([(i,) for i in x], "oid long") for x in ((1, 2), (2, 3)))
    assert rows(watch.membership_diff(a, b)) == [(1, "Exited"), (3, "Entered")]


def test_stream_equals_batch(spark, tmp_path):
    o = tables.user_ontology()
    ops = tables.operations(tables.read(spark, ROOT, "events"))
    bounds = ops.approxQuantile("lsn", [0.25, 0.5, 0.75], 0.0)
    for i, (a, b) in enumerate(zip([-1, *bounds], [*bounds, 1e18], strict=True)):
        ops.where((F.col("lsn") > a) & (F.col("lsn") <= b)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        assert i < 4
    stream = spark.readStream.schema(ops.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    # Files are taken in the order of their times, so batches follow the log.
    q = watch_stream(stream, SUBS, o).writeStream.format("memory").queryName("seen").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    columns = ["sub_id", "lsn", "oid", "tag", "step", "kind"]
    got = rows(spark.table("seen").select(*columns))
    want = []
    for s in SUBS:
        want += rows(watch.interested(watch.derive(ops, s, o), s.interest).select(*columns))
    assert len(want) > 100 and sorted(got, key=str) == sorted(want, key=str)


def full_log(spark):
    """All nine kinds of operations, an unknown one, replays, blobs, scoped paths, implied tags, relations and deletes."""
    rng, rows = random.Random(5), []
    values = [Value("int", 1), Value("int", 2), Value("float", 0.5), Value("text", "x"), Value("blob", b"\x00\xff"), Value("text", "a/b").scoped("web"), Value("text", "a").scoped("web"), Value("timestamp", 7)]
    for n in range(900):
        op = rng.choice(["create", "add_tag", "add_tag", "add_tag", "remove_tag", "remove_tag", "set_attr", "set_attr", "remove_attr", "add_relation", "remove_relation", "write_blob", "mystery"])
        op = "delete" if n % 97 == 0 and n else op
        r = {"op": op, "oid": rng.randrange(1, 30), "lsn": n, "physical_ns": 17 * 10**17 + n // 3 * 10**9, "logical": n % 3}
        if op.endswith("tag"):
            r["tag"] = rng.choice(["car", "truck", "vehicle", "thing", "loose"])
        elif op.endswith("attr"):
            v = rng.choice(values)
            r |= {"key": "path" if v.context else rng.choice("kl")} | v.row()
        elif op.endswith("relation"):
            r |= {"key": "near", "target": rng.randrange(1, 4)}
        rows.append(r)
    return mutate.ops_table(spark, rows)


FULL_SUBS = [
    watch.Subscription(i + 1, f"f{i}", dsl.parse(q), retention=None, **how)
    for i, (q, how) in enumerate([
        ("(tag vehicle)", {}), ("(direct vehicle)", {}), ("(isa thing)", {"since": 300}), ("(not (tag car))", {}), ("(not (attr k = 1))", {}), ("(key l)", {}), ("(attr k != 2)", {}), ("(attr k > 0)", {}), ('(under path "a" "web")', {}),
        ("(related near obj:0:2)", {}), ("(and (tag truck) (or (attr k = 0.5) (attr l = x)))", {"dormant": ((200, 400), (700, None))}), ("(and)", {}), ('(attr k like "%x")', {}),
    ])
]


def test_subscriptions_agree_with_replaying_each_operation(spark):
    """One pass over the log against a dictionary per object that is changed and asked again, operation by operation."""
    o, log = Ontology().install(VEHICLES), full_log(spark)
    got = watch.derive_all(log.unionByName(log.where("lsn % 5 = 0")), FULL_SUBS, o)
    ops, want = sorted((r.asDict() for r in log.collect()), key=lambda r: (r["physical_ns"], r["logical"], r["lsn"])), []
    state = {}
    for r in ops:
        s = state.setdefault(r["oid"], {"direct": {}, "gone": {}, "attrs": set(), "rels": set(), "dead": False, "n": 0})

        def ask(q, s=s):
            tags = set(s["direct"]) | {a for t, at in s["direct"].items() for a in (o.closure(t) if t in o.tags else {t}) if at > s["gone"].get(a, 0)}
            return not s["dead"] and A.matches(q, A.View(tags, set(s["direct"]), list(s["attrs"]), s["rels"]), o.descendants)

        before = [ask(x.query) for x in FULL_SUBS]
        s["n"] += 1
        op = r["op"]
        if op == "delete":
            s["dead"] = True
        elif op == "add_tag":
            s["direct"][r["tag"]] = s["n"]
        elif op == "remove_tag":
            s["direct"].pop(r["tag"], None)
            s["gone"][r["tag"]] = s["n"]
        elif op.endswith("attr"):
            raw = next(r[c] for c in ("v_text", "v_int", "v_float", "v_ts", "v_blob") if r[c] is not None)
            (s["attrs"].add if op == "set_attr" else s["attrs"].discard)((r["key"], Value(r["v_type"], bytes(raw) if r["v_type"] == "blob" else raw, r["v_ctx"])))
        elif op.endswith("relation"):
            (s["rels"].add if op == "add_relation" else s["rels"].discard)((r["key"], r["target"]))
        for x, b in zip(FULL_SUBS, before, strict=True):
            a, found = ask(x.query), []
            named = {d for n in A.walk(x.query) if isinstance(n, A.HasTag | A.IsA) for d in o.descendants(n.tag)}
            if not b and a:
                found = ["Created" if op == "create" else "Entered"]
            elif b and not a:
                found = ["Deleted"] if op == "delete" else ["TagRemoved"] * (op == "remove_tag" and r["tag"] in named) + ["Exited"]
            elif b and a:
                found = {"add_tag": ["TagAdded"], "remove_tag": ["TagRemoved"], "set_attr": ["ContentChanged"], "remove_attr": ["ContentChanged"], "write_blob": ["ContentChanged"]}.get(op, [])
            if x.sees_lsn(r["lsn"]):
                want += [(x.id, r["lsn"], r["oid"], r["tag"] if k.startswith("Tag") else None, i, k) for i, k in enumerate(found)]
    columns = ["sub_id", "lsn", "oid", "tag", "step", "kind"]
    assert len({w[0] for w in want}) == len(FULL_SUBS) - 1 and {w[5] for w in want} == set(watch.EVENTS) - {"Created"}
    assert sorted(rows(got.select(*columns)), key=str) == sorted(want, key=str)


def test_stream_equals_batch_on_every_kind_with_replays(spark, tmp_path):
    o, log = Ontology().install(VEHICLES), full_log(spark)
    for low in range(0, 900, 300):  # each file replays the end of the one before it
        log.where((F.col("lsn") >= low - 60) & (F.col("lsn") < low + 300)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    columns = ["sub_id", "lsn", "oid", "tag", "step", "kind"]
    want = rows(watch.derive_all(log, FULL_SUBS, o).select(*columns))
    for watermark in (None, "1 day"):
        stream = spark.readStream.schema(mutate.OPS_SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        name = f"full_{watermark is None}"
        q = watch_stream(stream, FULL_SUBS, o, watermark).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        assert sorted(rows(spark.table(name).select(*columns)), key=str) == sorted(want, key=str)


def test_poll_acknowledge_overflow_and_sleep(spark):
    o, log = Ontology().install(VEHICLES), full_log(spark)
    sub = watch.Subscription(1, "v", A.HasTag("vehicle"), retention=1000)
    first, over = watch.poll(log, sub, o, 400)
    again, _ = watch.poll(log, sub, o, 400)
    assert not over and rows(first.select("lsn", "kind")) == rows(again.select("lsn", "kind")) and first.count() > 50
    sub = sub.acknowledged(400)
    rest, _ = watch.poll(log, sub, o, 899)
    assert min(r.lsn for r in rest.collect()) > 400
    small = watch.Subscription(1, "v", A.HasTag("vehicle"), retention=3, since=401)
    diff, over = watch.poll(log, small, o, 899)
    then, now = (set(ids(evaluate(small.query, mutate.fold(mutate.as_of(log, lsn=n), o)))) for n in (400, 899))
    assert over and {(r.oid, r.kind) for r in diff.collect()} == {(i, "Entered") for i in now - then} | {(i, "Exited") for i in then - now}
    held = watch.Register()
    held.register("a", A.HasTag("car"))
    held.register("b", A.And((A.IsA("thing"), A.HasAttr("k", "=", Value("int", 1)))))
    held.change(1, "paused", 10)
    held.change(1, "resumed", 20)
    assert held.held[1].dormant == ((10, 20),) and not held.held[1].sees_lsn(15) and held.held[1].sees_lsn(20)
    assert held.index(o) == {"car": {1}, None: {2}} and watch.Register.from_json(held.to_json()).held == held.held
    two = [watch.Subscription(1, "v", A.HasTag("vehicle"), retention=5), watch.Subscription(2, "c", A.HasTag("car"), interest=watch.mask("Entered"), retention=1)]
    assert {r.sub_id: r.n for r in watch.deliver(log, two, o).groupBy("sub_id").agg(F.count("*").alias("n")).collect()} == {1: 5, 2: 1}


def test_relational(spark):
    rels = spark.createDataFrame([(1, "p", 2), (2, "p", 3), (3, "p", 1), (3, "p", 4), (9, "p", 1), (1, "q", 8)], "oid long, predicate string, target long")
    start = spark.createDataFrame([(1,)], "oid long")
    assert rows(relational.reachable(rels, start, "p")) == [(1, 3), (2, 1), (3, 2), (4, 3)]
    assert ids(relational.traverse(rels, start, "p", reverse=True)) == [3, 9] and ids(relational.traverse(rels, start, "p", symmetric=True)) == [2, 3, 9]
    assert relational.reachable(rels, start, "none").collect() == []


def test_paths(spark):
    o = paths.create_context(Ontology(), "web")
    assert paths.contexts(o) == ["web"]
    with pytest.raises(ontology.OntologyError):
        paths.create_context(o, "web")
    for bad in ("", "/a", "a/../b", "a\0"):
        with pytest.raises(paths.PathError):
            paths.check_path(bad)
    p = spark.createDataFrame([(1, "b/x"), (2, "a"), (3, "b/c/d"), (4, "b/c/e")], "oid long, path string")
    assert [tuple(r) for r in paths.listing(p).collect()] == [("dir", "b"), ("file", "a")]
    assert [tuple(r) for r in paths.listing(p, "b").collect()] == [("dir", "c"), ("file", "x")]
    assert [r.oid for r in paths.tree(p).collect()] == [2, 3, 4, 1] and ids(paths.lookup(p, "a")) == [2]


def test_content(spark):
    blobs = spark.createDataFrame([(1, b"abc" * 1000), (2, b""), (3, b"abc" * 1000), (4, b"x")], "oid long, data binary")
    stored = content.apply_pipeline(blobs)
    assert all(r.intact for r in content.invert_pipeline(stored).collect()) and stored.where("oid = 1").first().stored_size < 100
    wrong = stored.withColumn("content_hash", F.lit("no"))
    assert not any(r.intact for r in content.invert_pipeline(wrong).collect())
    with pytest.raises(content.UnsupportedAlgo):
        content.compress(F.col("data"), "lz4")
    with pytest.raises(content.EncryptionDisabled):
        content.apply_pipeline(blobs, encryption="xts")
    index = content.chunk_index(content.fixed_chunks(blobs, 999))
    assert sorted((r.ref_count, r.length) for r in index.collect()) == [(1, 1), (2, 3), (6, 999)]
    one = content.fixed_chunks(blobs.where("oid = 1"), 999).select("hash")
    assert sorted((r.ref_count, r.length) for r in content.release(index, one).collect()) == [(1, 1), (1, 3), (3, 999)]
    assert [r[0] for r in spark.createDataFrame([(0,), (1,), (4096,), (4097,)], "n long").select(content.padded_length(F.col("n"))).collect()] == [0, 4096, 4096, 8192]
    data = random.Random(1).randbytes(3_000_000)
    ends = content.cut_points(data, 64, 1024, 0xFF)
    sizes = [b - a for a, b in zip([0, *ends], ends)]
    assert ends[-1] == 3_000_000 and all(64 <= n <= 1024 for n in sizes[:-1])
    slow, start = [], 0  # byte by byte
    for i in range(20_000):
        h = sum(int(content.GEAR[data[i - k]]) << k for k in range(min(32, i + 1))) & 0xFFFFFFFF
        if i + 1 - start >= 1024 or (i + 1 - start >= 64 and not h & 0xFF):
            slow.append(i + 1)
            start = i + 1
    assert ends[: len(slow)] == slow
    two = spark.createDataFrame([(1, data), (2, data[:1_000_000] + b"inserted" + data[1_000_000:]), (3, b""), (4, None), (5, b"z")], "oid long, data binary")
    cdc = content.cdc_chunks(two, 1 << 12, 1 << 14, 1 << 16)
    shared = content.chunk_index(cdc).where("ref_count = 2").agg(F.sum("length")).first()[0]
    assert shared > 2_800_000 and cdc.groupBy("oid").agg(F.sum("length").alias("n")).orderBy("oid").select("n").toPandas().n.tolist() == [3_000_000, 3_000_008, 1]
    disks = spark.createDataFrame([(1, "ssd", 10, 4, "online"), (2, "ssd", 10, 4, "online"), (3, "ssd", 99, 0, "faulted"), (4, "hdd", 5, 5, "online")], "disk_id int, tier string, capacity long, used long, state string")
    assert content.pick_disk(disks, "ssd").first().disk_id == 1
    c = Collection(spark.createDataFrame([(1, "a", "direct"), (1, "b", "direct"), (2, "b", "direct"), (3, "c", "direct")], "oid long, tag string, origin string"))
    rules = [("prefer", "hdd", A.HasTag("a"), 1), ("prefer", "ssd", A.HasTag("b"), 5), ("pin", "nvme", A.HasTag("c"))]
    assert rows(content.place(c, rules, "hdd")) == [(1, "prefer", "ssd"), (2, "prefer", "ssd"), (3, "pin", "nvme")]
    assert [(r.oid, r.params["algo"]) for r in content.chunking_of(c, [({"algo": "cdc"}, A.HasTag("a"))], {"algo": "none"}).orderBy("oid").collect()] == [(1, "cdc"), (2, "none"), (3, "none")]
    assert rows(content.colocated(c, [A.HasTag("a"), A.HasTag("b")], disks)) == [(1, 0, 1), (2, 1, 2)]
    known = content.presence(spark.createDataFrame([(1, "h"), (2, "x"), (3, None), (4, "p")], "oid long, content_hash string"), spark.createDataFrame([("h", None), ("p", "partial")], "content_hash string, state string"))
    assert rows(known) == [(1, "local"), (2, "remote"), (3, None), (4, "partial")]
    assert rows(content.pool_status(disks)) == [("hdd", 1, 5, 5, []), ("ssd", 3, 119, 8, [3])]


SHELF = """
[[objects]]
tags = ["novel", "poem", "loved"]
[objects.attrs]
author = "Ada Stone"
year = 1931
[[objects]]
tags = ["novel"]
[objects.attrs]
year = 1948
[[generate]]
name = "reprints"
count = 3
content_type = "text"
min_size = 50
max_size = 90
tags = ["poem"]
[generate.attrs]
author = "{type} author {seq}"
[[generate]]
name = "scans"
count = 2
content_type = "music"
min_size = 1000
max_size = 1000
"""


def test_manifest(spark):
    o = Ontology().install(Module("shelf", "1", "m", [Tag("novel"), Tag("poem"), Tag("book")], [("poem", "novel"), ("novel", "book")]))
    ops, o = files.load_manifest(spark, SHELF, ontology=o)
    c = mutate.fold(ops, o)
    ask = lambda text: ids(evaluate(dsl.parse(text, o.resolve), c))
    assert ask("(tag novel)") == [1, 2, 3, 4, 5] and ask("(isa book)") == [1, 2, 3, 4, 5] and c.objects.count() == 7
    assert ask('(attr author = "text author 1")') == [4] and ask("(and (tag novel) (not (tag poem)))") == [2]
    made = {r.oid: bytes(r.data) for r in files.manifest_contents(spark, SHELF).collect()}
    assert sorted(made) == [3, 4, 5, 6, 7] and all(50 <= len(made[i]) <= 90 for i in (3, 4, 5)) and len(made[6]) == len(made[7]) == 1000
    assert made == {r.oid: bytes(r.data) for r in files.manifest_contents(spark, SHELF).collect()} and made[3].decode().split()[0] and made[6] != made[7]
    for bad in ("surprise = 1", "[[objects]]\nsize = 3", "[[generate]]\ncount = 1\nweight = 3", "[[generate]]\ntags = []", "[[generate]]\ncount = 1\nmin_size = 9\nmax_size = 3"):
        with pytest.raises(files.ManifestError):
            files.load_manifest(spark, bad)
    big, _ = files.load_manifest(spark, '[[generate]]\ncount = 5000000\ntags = ["x"]\n')
    assert "Range" in big._jdf.queryExecution().toString() and big.where("oid = 4999999").count() == 2


def test_import_and_synthetic(spark, tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/.hidden").write_text("no")
    (tmp_path / "in/a.txt").write_text("one")
    (tmp_path / "in/sub/b.txt").write_text("two")
    found, attrs = files.import_directory(spark, str(tmp_path / "in"), "home", first_oid=10)
    assert [tuple(r) for r in paths.tree(paths.paths(attrs, "home")).collect()] == [("a.txt", 10), ("sub/b.txt", 11)]
    assert sorted(r.blob_length for r in found.collect()) == [3, 3]
    done = files.export(spark.createDataFrame([("x/y.bin", b"123")], "path string, data binary"), str(tmp_path / "out"))
    assert rows(done) == [("x/y.bin", 3)] and (tmp_path / "out/x/y.bin").read_bytes() == b"123"
    (tmp_path / "in/link.txt").symlink_to("a.txt")
    (tmp_path / "elsewhere").mkdir()
    (tmp_path / "elsewhere/c.txt").write_text("three")
    (tmp_path / "in/way").symlink_to(tmp_path / "elsewhere")
    names = lambda attrs: [r.path for r in paths.tree(paths.paths(attrs, "home")).collect()]
    assert "link.txt" in names(files.import_directory(spark, str(tmp_path / "in"), "home")[1])
    assert names(files.import_directory(spark, str(tmp_path / "in"), "home", links="skip")[1]) == ["a.txt", "sub/b.txt"]
    found, attrs = files.import_directory(spark, str(tmp_path / "in"), "home", links="record")
    assert names(attrs) == ["a.txt", "link.txt", "sub/b.txt"] and [r.v_text for r in attrs.where("key = 'link-target'").collect()] == ["a.txt"]
    assert [r.blob_length for r in found.orderBy("oid").collect()] == [3, None, 3]
    projected = spark.createDataFrame([(1, "p/q.bin"), (2, "r.bin")], "oid long, path string")
    plan = files.export_plan(projected, spark.createDataFrame([(1, "h1"), (2, "h2"), (3, "h3")], "oid long, content_hash string"))
    held = spark.createDataFrame([("h1", b"1"), ("h2", b"22")], "content_hash string, data binary")
    assert rows(files.execute_export(plan, held, str(tmp_path / "tree")).select("path", "bytes")) == [("p/q.bin", 1), ("r.bin", 2)] and (tmp_path / "tree/r.bin").read_bytes() == b"22"
    with pytest.raises(files.MissingContent):
        files.execute_export(plan, held.limit(1), str(tmp_path / "none")).collect()
    tags, made = files.synthetic(spark, 50, ["a", "b", "c"], {"year": (1990, 2000)}, seed=2)
    assert rows(tags) == rows(files.synthetic(spark, 50, ["a", "b", "c"], {"year": (1990, 2000)}, seed=2)[0])
    assert made.count() == 50 and all(1990 <= r.v_int <= 2000 for r in made.collect())


def test_command_line(spark, tmp_path):
    from semlake import cli

    def do(*argv):
        out = io.StringIO()
        code = cli.run(spark, ["--store", str(tmp_path / "store"), *argv], out)
        return out.getvalue().strip() if code == 0 else code

    module = tmp_path / "m.toml"
    module.write_text(Module("m", "1", "m", [Tag("song"), Tag("media")], [("song", "media")]).to_toml())
    do("ontology", "install", str(module))
    for _ in range(3):
        do("create", "song", "electronic")
    assert do("create") == "obj:0:4" and do("watch", "register", "new songs", "(tag song)") == "1"
    do("tag", "obj:4", "song")
    do("set", "obj:4", "year", "1998")
    assert do("query", "(tag media)").splitlines()[-1] == "(4 results)" and do("query", "(attr year = 1998)").splitlines() == ["obj:0:4", "(1 results)"]
    assert do("query", "--sql", "SELECT COUNT(*) FROM objects WHERE tag = 'song'") == "4" and do("query", "(tag ghost)") == 1
    assert do("explore", "song").splitlines() == ["media\t4", "song\t4", "electronic\t3"]
    assert [json.loads(x)["kind"] for x in do("watch", "drain", "1").splitlines()] == ["Entered", "ContentChanged"] and do("watch", "drain", "1") == ""
    assert "tag=media origin=materialized" in do("info", "obj:4") and do("ontology", "orphans") == "electronic\nyear"
    do("project", "create-context", "web")
    do("project", "set-path", "web", "obj:4", "a/b")
    assert do("project", "tree", "web") == "a/b\tobj:0:4" and do("info", "obj:99") == 1
    assert do("project", "export", "web", str(tmp_path / "none")) == 1 and do("project", "export", "ghost", "x") == 1  # no content, no context
    (tmp_path / "blob").write_bytes(b"bytes")
    do("put", "obj:4", str(tmp_path / "blob"))
    assert do("project", "export", "web", str(tmp_path / "tree")).startswith("exported 1 objects") and (tmp_path / "tree/a/b").read_bytes() == b"bytes"
    assert do("project", "export", "web", str(tmp_path / "one/x"), "--oid", "obj:4").startswith("wrote 5 bytes") and (tmp_path / "one/x").read_bytes() == b"bytes"
    assert do("project", "export", "web", str(tmp_path / "two"), "--oid", "obj:1") == 1
    assert [json.loads(x)["kind"] for x in do("watch", "stream", "1").splitlines()] == ["ContentChanged"] * 2 and do("watch", "stream", "1") == ""
    do("delete", "obj:4")
    assert [json.loads(x)["kind"] for x in do("watch", "stream", "1").splitlines()] == ["Deleted"]
    assert do("project", "export", "web", str(tmp_path / "three")).startswith("exported 0 objects") and (tmp_path / "three").is_dir()
    assert do("sql", "SELECT COUNT(*) FROM objects") == "3"
    (tmp_path / "bad.toml").write_text("surprise = 1")
    (tmp_path / "worse.toml").write_text("[[[")
    assert [do(*x) for x in (("populate", str(tmp_path / "bad.toml")), ("populate", str(tmp_path / "worse.toml")), ("populate", "nowhere.toml"), ("ontology", "install", str(module)), ("ontology", "remove", "ghost"))] == [1] * 5
    (tmp_path / "files/sub").mkdir(parents=True)
    (tmp_path / "files/sub/f.txt").write_text("file")
    (tmp_path / "files/l.txt").symlink_to("sub/f.txt")
    do("project", "create-context", "disk")
    assert do("project", "import", "disk", str(tmp_path / "files"), "--links", "skip") == "1 files"
    assert do("project", "tree", "disk") == "sub/f.txt\tobj:0:5" and do("project", "export", "disk", str(tmp_path / "back")).startswith("exported 1") and (tmp_path / "back/sub/f.txt").read_text() == "file"
    shelf = tmp_path / "shelf.toml"
    shelf.write_text(SHELF)
    assert do("populate", str(shelf)).startswith("7 objects") and do("query", "(tag poem)").splitlines()[-1] == "(4 results)"
    assert do("sql", "SELECT COUNT(*) FROM objects WHERE author LIKE 'text author _'") == "3" and "blob_length=1000" in do("info", "obj:11")
    assert do("sql", "SELECT author FROM objects WHERE year = 1931").splitlines() == ["['Ada Stone']"]
    told = json.loads(do("analyze", "--json", "--top", "3"))
    assert told["objects"] == {"active": 11, "tombstoned": 1} and told["tags"][0]["n"] == 4 and told["implications"] == [["song", "media"]] and len(told["oplog"]) == 3
    assert do("analyze").splitlines()[0].startswith("lsn: ")
    lines = io.StringIO()
    cli.repl(cli.Store(spark, str(tmp_path / "store")), [".tables\n", "SELECT nonsense;\n", "SELECT COUNT(*)\n", "FROM objects WHERE tag = 'song';\n", ".quit\n"], lines)
    assert lines.getvalue().splitlines()[0] == "objects" and "error" in lines.getvalue() and lines.getvalue().strip().endswith("3")
