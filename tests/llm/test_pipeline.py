"""The pipeline against brute force, stage by stage and as a whole."""

import collections
import re

import corpus_pipeline
from semlake.llm import toxicity
from semlake.llm.common import table


def test_stages_and_run(spark):
    root = "/root/testdata/sf0.001"
    docs = source = spark.read.parquet(f"{root}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = table(stage(spark, docs, root), name)
        seen[name] = [r.asDict() for r in out.collect()]
        if name != "packing":
            assert out.columns == source.columns
        docs = out
    model = toxicity.train(source, spark.read.parquet(f"{root}/labels.parquet"))
    toxic = {r.doc_id for r in toxicity.scores(source, model).collect() if r.predicted}
    want = [r.asDict() for r in source.collect() if r.doc_id not in toxic]
    assert sorted(map(str, seen["toxicity"])) == sorted(map(str, want))
    groups = collections.defaultdict(list)
    for r in want:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "")].append(r)
    want = [min(g, key=lambda r: r["doc_id"]) for g in groups.values()]
    assert sorted(map(str, seen["exact_dedup"])) == sorted(map(str, want))

    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    kept = {r["doc_id"] for r in seen["simhash_near_dedup"]}
    sets = {r["doc_id"]: shingles(r["text"]) for r in want}
    linked = {i: {j for j, t in sets.items() if 5 * len(s & t) >= 4 * len(s | t)} for i, s in sets.items()}
    least = dict.fromkeys(sets)
    for i in sorted(sets):
        todo = [i] if least[i] is None else []
        while todo:
            j = todo.pop()
            if least[j] is None:
                least[j] = i
                todo += linked[j]
    assert kept == {i for i in sets if least[i] == i}  # one of each group of similarity 0.8 stays, and all clean documents
    texts = {r["doc_id"]: r["text"] for r in seen["simhash_near_dedup"]}
    assert all(texts[r["doc_id"]] == r["text"] for r in seen["mixing"])
    assert max(collections.Counter(r["doc_id"] for r in seen["mixing"]).values()) <= 3
    packed = collections.Counter(r["doc_id"] for r in seen["packing"] if r["piece"] == 0)
    assert packed == collections.Counter(r["doc_id"] for r in seen["mixing"])
    assert sorted(map(str, (r.asDict() for r in corpus_pipeline.run(spark, root).collect()))) == sorted(map(str, seen["packing"]))


def written(spark, folder, rows, labels):
    from fixtures import documents

    documents(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_run_on_odd_tables(spark, tmp_path):
    """Nulls in every column, empty and very long texts, ties, repeated rows, null ids and labels, clashing extra columns."""
    from fixtures import corpus

    rows = [*corpus(), (None, None, None, None, None), (None, None, None, None, None), (700, "a b c", None, None, None), (700, "a b c", "de", "s1", 4)]
    labels = [(i, 1, int(i < 12)) for i in range(40)] + [(None, None, None), (3, None, 1), (900, None, None), (3, 1, 1)]
    root = written(spark, tmp_path / "odd", rows, labels)
    docs, seen = spark.read.parquet(f"{root}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = table(stage(spark, docs, root), name)
        seen[name] = docs.collect()
        assert name == "packing" or docs.columns == columns
    plain = [re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in seen["exact_dedup"]]
    assert len(set(plain)) == len(plain) == len({re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in seen["toxicity"]})
    assert sum(r.doc_id == 700 for r in seen["exact_dedup"]) <= 1 and 0 < len(seen["simhash_near_dedup"]) <= len(seen["exact_dedup"])
    full = collections.defaultdict(list)
    for r in seen["packing"]:
        full[r.sequence_id].append((r.offset, r.length))
    for places in full.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(corpus_pipeline.run(spark, root).collect()) == len(seen["packing"])


def test_run_on_empty_tables(spark, tmp_path):
    root = written(spark, tmp_path / "empty", [], [])
    assert corpus_pipeline.run(spark, root).collect() == []


def test_packing_at_the_querys_limit(spark):
    """Pieces of at most 2048 tokens hold every id once and in order, and sequences are full but for few."""
    import zlib

    import numpy as np
    from fixtures import corpus, documents
    from semlake.llm import packing, tokens
    from tokenizers import Tokenizer

    vocabulary = tokens.default_vocabulary()
    encode = Tokenizer.from_file(vocabulary)
    rows = [r for r in corpus() if r[0] is not None][:-2] + [(3000 + i, f"{i} " * (1 + i * 97 % 1900), None, None, None) for i in range(300)]
    got = collections.defaultdict(list)
    for r in packing.pack(documents(spark, rows), vocabulary).collect():
        got[r.doc_id].append(r)
    used = collections.Counter()
    for doc_id, text, *_ in rows:
        ids, at = np.array([*encode.encode(text or "", add_special_tokens=False).ids, 0], "<u4"), 0
        pieces = sorted(got[doc_id], key=lambda r: r.piece)
        for n, r in enumerate(pieces):
            assert (r.piece, r.start) == (n, at) and 0 < r.length <= 2048 and (n == 0 or r.length == 2048)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
            used[r.sequence_id] += r.length
        assert at == len(ids) and (len(ids) > 2048 or len(pieces) == 1)
    least = -(-sum(used.values()) // 2048)
    assert max(used.values()) <= 2048 and len(used) <= least * 1.01 + 2
