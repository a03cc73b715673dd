"""Near-duplicates that fingerprints alone would miss: of few shingles, or without a common root."""

import random

import numpy as np

from semlake.llm import simhash


def test_short_near_duplicates_are_all_found(spark):
    rng = random.Random(7)
    rows, gone = [], set()
    # (words of a text, words added, whether 5-word shingles are at 0.8): 4 of 5, 12 of 15, 29 of 36 (0.806), and 3 of 4, which isn't.
    for words, more, similar in [(8, 1, True)] * 60 + [(16, 3, True)] * 60 + [(33, 7, True)] * 20 + [(7, 1, False)] * 40:
        text = " ".join(f"{rng.getrandbits(40):x}" for _ in range(words))
        longer = text + "".join(f" {rng.getrandbits(40):x}" for _ in range(more))
        if similar:
            gone.add(len(rows) + 1)
        rows += [(len(rows), text), (len(rows) + 1, longer)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in simhash.drop_near_duplicates(docs).collect()}
    assert kept == set(range(len(rows))) - gone


def test_common_shingles_join_nothing_by_themselves(spark):
    """Texts that share a line but little else are compared, and all stay."""
    rng = random.Random(8)
    line = "this very common line of nine words stays everywhere"
    rows = [(n, line + "".join(f" {rng.getrandbits(40):x}" for _ in range(9))) for n in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert simhash.drop_near_duplicates(docs).count() == len(rows)


def test_pairs_that_no_root_brings_together_are_found(spark, monkeypatch):
    """Similar texts of any length are found by their shingles alone, in many small buckets, beside a line that all share."""
    monkeypatch.setattr(simhash, "WIDE_ROOTS", ((0, 0, 40),))
    monkeypatch.setattr(simhash, "BUCKET", 512)
    rng = random.Random(9)
    line = "this very common line of nine words stays everywhere "
    rows, want = [], set()
    for n in range(60):
        words = [f"{rng.getrandbits(40):x}" for _ in range(rng.choice([10, 40, 200, 500]))]
        other = words[:-1] if n % 2 else words[: len(words) // 2] + [f"{rng.getrandbits(40):x}" for _ in words]
        rows += [(2 * n, line + " ".join(words)), (2 * n + 1, line + " ".join(other))]
        sets = [set(simhash.shingle_hashes(text.encode(), 5).tolist()) for _, text in rows[-2:]]
        similar = len(sets[0] & sets[1]) >= 0.8 * len(sets[0] | sets[1])
        assert similar == bool(n % 2)
        want |= {2 * n} if similar else {2 * n, 2 * n + 1}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r.doc_id for r in simhash.drop_near_duplicates(docs).collect()} == want


def test_repeated_shingles_equal_a_count(spark):
    """Every shingle of several rows, by row, whatever the number of buckets and the frequent ones."""
    rng = random.Random(10)
    rows = [(n, " ".join(rng.choice("abcdef") for _ in range(rng.randrange(0, 40)))) for n in range(80)]
    sets = {n: set(simhash.shingle_hashes(t.encode(), 3).tolist()) for n, t in rows}
    having = {s: sum(s in x for x in sets.values()) for x in sets.values() for s in x}
    want = sorted((n, having[s]) for n, x in sets.items() for s in x if having[s] > 1)
    docs = spark.createDataFrame(rows, "name long, text string")
    none = np.zeros(0, np.uint64)
    for buckets in (1, 7):
        got = simhash.repeated_shingles(docs, 3, none, buckets).collect()
        assert sorted((r.name, r.n) for r in got) == want
    often = simhash.frequent_shingles(docs, 3, len(rows))
    assert {int(x) for x in often} == {s for s, n in having.items() if n >= 5}
    got = simhash.repeated_shingles(docs, 3, often, 3).collect()
    assert sorted(r.name for r in got) == [n for n, _ in want]
    assert len({r.shingle for r in got if r.shingle < 0}) == len(often)
