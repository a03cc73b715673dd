"""Operators on embeddings, pages and conversations."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from semlake.llm import chat_format, embed_dedup, line_dedup

duckdb = pytest.importorskip("duckdb")


def oracle(sql, **tables):
    c = duckdb.connect()
    for name, df in tables.items():
        c.register(name, df.toArrow())
    return c.execute(sql).to_arrow_table().to_pylist()


def same(got, want):
    assert sorted(map(lambda r: str(sorted(r.items())), got)) == sorted(map(lambda r: str(sorted(r.items())), want))


# ---- embeddings


def vectors(spark, n=300, size=16, seed=4):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, size)).astype(np.float32)
    base[50:90] = base[:40] + rng.normal(size=(40, size)).astype(np.float32) * 0.2
    base[100:130] = base[99]  # exact copies
    base[140:160] = base[139] * np.linspace(1, 3, 20, dtype=np.float32)[:, None]
    rows = [(i, v.tolist(), i % 5, "x", 1) for i, v in enumerate(base)]
    odd = [None, [], [0.0] * size, [math.nan] * size, [math.inf, *[1.0] * (size - 1)], [None, *[1.0] * (size - 1)], [1.0] * 3, [1.0, 1.0, 1.001], [2.0] * 3]
    rows += [(n + i, v, None, "x", 1) for i, v in enumerate(odd)]
    rows += [(7, base[7].tolist(), 0, "x", 1), (None, base[8].tolist(), 0, "x", 1)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, node string, n int")


def brute_links(rows, cosine=0.9):
    """{vec_id: (n_links, component_id)} by all products, dimension by dimension."""
    ok = [i for i, r in enumerate(rows) if r[1] and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])]
    want = {r[0]: (0, r[0]) for r in rows}
    for size in {len(rows[i][1]) for i in ok}:
        own = [i for i in ok if len(rows[i][1]) == size]
        x = np.array([rows[i][1] for i in own], np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        near = x @ x.T >= cosine
        label = np.arange(len(own))
        while True:
            new = np.where(near, label[None], len(own)).min(axis=1)
            if (new == label).all():
                break
            label = new
        for k, i in enumerate(own):
            ids = [rows[own[j]][0] for j in np.flatnonzero(label == label[k]) if rows[own[j]][0] is not None]
            want[rows[i][0]] = (int(near[k].sum()) - 1, min(ids))
    return want


@pytest.mark.parametrize(("slack", "block"), [(1.0, 8 << 20), (1.0, 16 * 128), (None, 16 * 128), (None, 8 << 20)])
def test_embedding_links(spark, slack, block):
    rows, df = vectors(spark)
    want = brute_links(rows)
    got = embed_dedup.near_duplicates(df, slack=slack, block_bytes=block).collect()
    assert len(got) == len(rows)
    wrong = [r for r in got if (r.n_links, r.component_id) != want[r.vec_id]]
    assert len(wrong) <= (0 if slack == 1.0 else 6)
    assert all(r.n_links <= want[r.vec_id][0] for r in got)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id is not None)


def at_the_threshold(rng, x, cosine, flat=0):
    """A partner for each unit vector at that cosine; flat: partners differ in so many directions only."""
    u = rng.normal(size=x.shape)
    if flat:
        u[:, flat:] = 0
    u -= (u * x).sum(axis=1, keepdims=True) * x
    return cosine * x + math.sqrt(1 - cosine**2) * u / np.linalg.norm(u, axis=1, keepdims=True)


def test_embedding_recall_against_brute_force(spark):
    """Pairs just above the threshold in tables of 2 to 64 dimensions at once, over many cells: of the links of the vectors
    whose id is divisible by 50, and of all links, about 1 in 100 is lost at most."""
    rng = np.random.default_rng(0)
    rows = []
    for size, n in ((2, 300), (8, 1500), (16, 1500), (32, 1500), (64, 1500)):
        x = rng.normal(size=(n, size))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        rows += [v.tolist() for v in np.concatenate([x, at_the_threshold(rng, x, 0.9005)])]
    rows = [(i, v) for i, v in enumerate(rows)]
    want = brute_links(rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in embed_dedup.near_duplicates(df, block_bytes=64 * 8 * 128).collect()}
    assert all(got[i] <= n for i, (n, _) in want.items())
    for ids in ([i for i in want if i % 50 == 0], list(want)):
        assert sum(got[i] for i in ids) >= 0.985 * sum(want[i][0] for i in ids)


@pytest.mark.parametrize(("size", "flat", "k"), [(8, 0, 226), (16, 0, 226), (16, 0, 1000), (32, 0, 110), (64, 0, 77), (64, 8, 77)])
def test_embedding_slack_is_wide_enough_in_each_dimension(size, flat, k):
    rng = np.random.default_rng(size)
    x = rng.normal(size=(8000, size)) * np.where(np.arange(size) < (flat or size), 1.0, 0.05)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    centres = embed_dedup.fit_centres(x, k)
    slack = embed_dedup.needed_slack(x, centres, 0.9)
    assert 0.05 < slack <= 0.4359
    y = at_the_threshold(rng, x, 0.9, flat)
    hx, rx, cx = embed_dedup.shown_to(x, centres, slack)
    hy, ry, cy = embed_dedup.shown_to(y, centres, slack)
    met = np.isin(np.arange(len(x)) << 32 | hy, rx << 32 | cx) | np.isin(np.arange(len(x)) << 32 | hx, ry << 32 | cy)
    assert met.mean() >= 0.97


def test_embedding_empty(spark):
    _, df = vectors(spark)
    assert embed_dedup.near_duplicates(df.limit(0)).collect() == []
    none = embed_dedup.near_duplicates(df.where("embedding is null")).collect()
    assert [(r.n_links, r.component_id == r.vec_id, r.kept) for r in none] == [(0, True, True)]


# ---- pages

NAV = "<nav>home</nav>"
PAGES = [
    *[(i, f"http://A.example.com:80/{i}?x=1", f"{NAV}\r\nbody {i}\n\n  {NAV} \nfoot", 1) for i in range(6)],
    (6, "https://user@b.example.com", f"{NAV}\nunique", 1),
    (7, None, "x\ny", 1), (8, "no host here", None, 1), (9, "http://a.example.com", "", 1), (9, "http://a.example.com", "é\n" * 2000, 1),
    (9, "http://a.example.com", "", 1), (None, "http://c.example.com", "\n\n", 1),
]


def pages(spark, rows=PAGES):
    return spark.createDataFrame(rows, "page_id long, url string, html string, host int")


def test_line_dedup(spark):
    got = [r.asDict() for r in line_dedup.drop_repeated_lines(pages(spark)).collect()]
    same(got, oracle(line_dedup.oracle(), pages=pages(spark)))
    first = next(r for r in got if r["page_id"] == 0)
    assert first["text"] == "body 0" and first["n_dropped"] == 3 and first["host"] == "a.example.com"
    assert next(r for r in got if r["page_id"] == 6)["text"] == "home\nunique"
    assert next(r for r in got if r["page_id"] == 8)["text"] is None
    html = "<html><head><title>T &amp;lt; &copy;</title><STYLE>p{}</STYLE><script>var t='</p>';\nx</script></head><!-- <p>no</p>\n --><p>a <b>b</b><br/>c"
    assert pages(spark, [(1, "", html, 1)]).select(line_dedup.lines_of(F.col("html"))).first()[0] == ["T &lt; ©", "a b", "c"]
    assert line_dedup.drop_repeated_lines(pages(spark, [])).collect() == []
    two = [(1, "http://x.de/1", "a\nb", 1), (2, "http://x.de/2", "a\nc", 1), (3, "http://y.de/1", "a\nb", 1)]
    assert sorted((r.page_id, r.text) for r in line_dedup.drop_repeated_lines(pages(spark, two)).collect()) == [(1, "b"), (2, "c"), (3, "a\nb")]


def test_line_dedup_plan_is_native(spark):
    plan = line_dedup.drop_repeated_lines(pages(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# ---- conversations

TURNS = [
    (0, 0, "user", "hi"), (0, 1, "assistant", "hello"), (0, 2, "user", "more"), (0, 3, "assistant", "yes"),
    (1, 0, "user", "hi"), (1, 1, "assistant", "hello"), (1, 2, "user", "more"), (1, 3, "assistant", "nö ☃𝔘"), (1, 4, "user", "?"),
    (2, 0, "user", "a"), (3, 0, "system", "a"), (4, 0, "user", "alone"),
    (6, 0, None, None), (6, 1, "assistant", "x"), (7, 0, None, None), (7, 1, "assistant", "x"),
    (8, None, "user", "z"), (8, 0, "user", ""), (8, 0, "user", ""), (9, None, "user", "z"), (11, 0, "assistant", "w" * 100_000),
    (None, 0, "user", "nobody's"),
]


def neighbours(conversations):
    """Conversations 2n and 2n + 1 as a pair whose even one is chosen."""
    return conversations.withColumns({"pair_id": F.floor(F.col("conv_id") / 2), "chosen": F.pmod("conv_id", F.lit(2)) == 0})


def test_preferences(spark):
    turns = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").withColumns({"c": F.lit(1), "n_common": F.lit(2)})
    made = chat_format.format_preferences(neighbours(turns))
    one = next(r for r in made.collect() if r.pair_id == 0)
    assert one.n_common == 3 and one.prompt.count("<|user|>") == 2
    assert [tuple(s) for s in one.rejected] == [("<|assistant|>\nnö ☃𝔘\n", True), ("<|user|>\n?\n", False)]
    assert next(r for r in made.collect() if r.pair_id == 3).chosen == []
    assert next(r for r in made.collect() if r.pair_id == 2).rejected is None
    assert chat_format.digest(chat_format.format_preferences(neighbours(turns.limit(0)))).collect() == []


def test_preferences_from_replies(spark):
    """Conversations that share their prompt with a rejected copy, among them repeated turns, nulls and missing replies."""
    turns = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").withColumns({"c": F.lit(1), "o": F.lit(2)})
    made = chat_format.formatted(chat_format.replies_as_pairs(turns))
    got = [r.asDict() for r in chat_format.digest(made).collect()]
    same(got, oracle(chat_format.ORACLE, conversations=turns))
    by_id = {r["pair_id"]: r for r in got}
    assert set(by_id) == {t[0] for t in TURNS if t[0] is not None}
    assert by_id[0]["n_common"] == 3 and by_id[0]["chosen"] == "<|assistant|>\nyes\n" and by_id[0]["rejected"] == "<|assistant|>\nnö ☃𝔘\n"
    assert by_id[1]["chosen_mask"] == "0:20" and by_id[1]["prompt"] == by_id[0]["prompt"]
    assert by_id[2]["rejected"] is None and by_id[11]["rejected"] is None
    root = "/root/testdata/sf0.001"
    own = spark.read.parquet(f"{root}/conversations.parquet")
    got = chat_format.digest(chat_format.formatted(chat_format.replies_as_pairs(own))).collect()
    same([r.asDict() for r in got], oracle(chat_format.ORACLE, conversations=own))
    assert sum(r.n_common > 0 for r in got) > len(got) * 0.6
    assert chat_format.formatted(chat_format.replies_as_pairs(turns.limit(0))).collect() == []


# ---- the checkpoint folder


def test_shared_folder_is_the_one_the_session_names(spark):
    from types import SimpleNamespace

    from semlake.llm.common import drop_table, shared_dir, table

    named = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: "hdfs://x/y/" if key == "spark.checkpoint.dir" else default))
    assert shared_dir(named) == "hdfs://x/y"
    t = table(spark.range(3), "x")
    folder = t._semlake_path.removeprefix("file:")
    assert os.listdir(folder) and t._semlake_path.startswith(shared_dir(spark)) and t.count() == 3
    drop_table(t)
    assert not os.path.exists(folder)
