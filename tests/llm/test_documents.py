"""Operators on documents against brute force, row by row."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from fixtures import DOCS, corpus, documents
from pyspark.sql import functions as F

from semlake.llm import exact_dedup, license_scan, mixing, packing, simhash, tokens, toxicity

VOCABULARY = tokens.default_vocabulary()


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def key(r):
    return tuple((v is None, v) for v in r.values())


# ---- exact dedup


def brute_groups(rows):
    groups = collections.defaultdict(list)
    for r in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "")].append(r[0])
    return groups


@pytest.mark.parametrize("shard_keys", [3, 100_000])
def test_exact_duplicates(spark, shard_keys):
    want = []
    for text, ids in brute_groups(corpus()).items():
        keep = min((i for i in ids if i is not None), default=None)
        own, kept = hashlib.sha256(text.encode()).hexdigest(), False
        for i in ids:  # of rows that share the smallest doc_id, one
            want.append((i, keep, len(ids), i == keep and not kept, own))
            kept = kept or i == keep
    got = [tuple(r) for r in exact_dedup.exact_duplicates(documents(spark), shard_keys).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_drop_duplicates_keeps_one_row_of_each_group(spark):
    docs = documents(spark)
    out = exact_dedup.drop_duplicates(docs, shard_keys=5)
    assert out.columns == docs.columns
    got = collections.Counter(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in out.collect())
    groups = brute_groups(corpus())
    assert got == dict.fromkeys(groups, 1)
    kept = {re.sub(r"[\x20\x09-\x0D]+", " ", r.text or ""): r.doc_id for r in out.collect()}
    assert kept == {t: min((i for i in ids if i is not None), default=None) for t, ids in groups.items()}


def test_index_is_cut_by_the_larger_side(spark):
    """One far-off id leaves history a single row: arrivals alone ask for shards then."""
    rows = [(-(10**15), "far", None, None, None), *[(1000 + i, f"text {i % 700}", None, None, None) for i in range(1000)]]
    docs = documents(spark, rows)
    sides = exact_dedup.numbered_digests(docs).select("digest", (F.col("doc_id") < 0).alias("old")).distinct()
    assert exact_dedup.shards_for(sides, 50) == 14
    got = exact_dedup.exact_duplicates(docs, shard_keys=50).collect()
    assert sum(r.kept for r in got) == 701 and {r.group_size for r in got if r.doc_id and r.doc_id > 0} == {1, 2}


def test_repeated_rows_leave_one(spark):
    rows = [(5, "a  b", "en", "s", 1)] * 3 + [(5, "a b", "de", "s", 1), (9, "a b", "en", "s", 1), (None, "c", None, None, 1), (None, "c", None, None, 1)]
    got = exact_dedup.exact_duplicates(documents(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.kept) for r in got if r.kept) == [("5", True), ("None", True)] and len(got) == 7
    for docs in (documents(spark, rows), documents(spark, rows).repartition(5)):
        out = exact_dedup.drop_duplicates(docs).collect()
        assert sorted((str(r.doc_id), r.lang) for r in out) in ([("5", "en"), ("None", None)], [("5", "de"), ("None", None)])


def test_perfect_hash_gives_every_key_its_own_slot():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 20_000, dtype=np.uint64))
    made = exact_dedup.PerfectHash.build(keys)
    assert sorted(made.slots(keys)) == list(range(len(keys)))
    other = np.random.default_rng(2).integers(2**63, 2**64, 1000, dtype=np.uint64)
    assert ((made.slots(other) >= -1) & (made.slots(other) < len(keys))).all()


# ---- mixing


def test_mixing_targets_and_budgets(spark):
    rows = corpus()
    got = rows_of(mixing.mix(documents(spark)))
    assert len(got) == len(rows)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += size(r[1])
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, target, open_ = sum(sizes.values()), {}, set(order)
    while True:
        rate = (total - sum(target.values())) / sum(weight[s] for s in open_)
        over = [s for s in open_ if rate * weight[s] > 3 * sizes[s]]
        if not over:
            break
        for s in over:
            target[s] = 3 * sizes[s]
            open_.remove(s)
    target |= {s: rate * weight[s] for s in open_}
    taken = collections.Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"] and 0 <= r["copies"] <= 3
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in order)
    assert sorted(map(str, got)) == sorted(map(str, rows_of(mixing.mix(documents(spark).repartition(7)))))


def test_mixing_given_weights_and_whole_texts(spark):
    docs = documents(spark)
    plan = {(r.doc_id, r.text_key): r.copies for r in mixing.mix(docs, {"s0": 1, "s1": 3}).collect()}
    out = mixing.mixed_documents(docs, {"s0": 1, "s1": 3})
    assert out.columns == docs.columns and {r.source for r in out.collect()} == {"s0", "s1"}
    got = collections.Counter(r.doc_id for r in out.where("doc_id < 11").collect())
    assert all(got[i] == c for (i, _), c in plan.items() if i is not None and i < 11)


def test_mixing_repeated_rows_keeps_the_budget(spark):
    """Six rows equal in doc_id and text, of which the mix takes some more often than others."""
    rows = [(1, "ten words " * 5, "en", "a", n) for n in range(6)] + [(2 + i, "b c d " * 9, "en", "b", 1) for i in range(20)]
    docs = documents(spark, rows)
    copies = [r.copies for r in mixing.mix(docs, {"a": 1, "b": 5}).collect() if r.source == "a"]
    out = [r for r in mixing.mixed_documents(docs, {"a": 1, "b": 5}).collect() if r.source == "a"]
    assert len(set(copies)) > 1 and len(out) == sum(copies)
    each = collections.Counter(r.n_chars for r in out)
    assert set(each) == set(range(6)) and max(each.values()) - min(each.values()) == 1


def brute_targets(sizes, weights, most):
    total, full = sum(sizes.values()), set()
    while True:
        open_ = [s for s in sizes if s not in full and weights[s] > 0]
        rate = (total - sum(most * sizes[s] for s in full)) / sum(weights[s] for s in open_) if open_ else 0
        over = [s for s in open_ if rate * weights[s] >= most * sizes[s]]
        if not over:
            return {s: most * sizes[s] if s in full else rate * weights[s] for s in sizes}
        full |= set(over)


@pytest.mark.parametrize("seed", range(4))
def test_targets_of_many_sources(spark, seed):
    toss = random.Random(seed)
    sizes = {f"s{i}": int(10 ** toss.uniform(0, 5)) * (i != 3) for i in range(60)}
    weights = {s: toss.choice([0, 0.5, 1, 2, 30]) for s in sizes}
    df = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r.source: r.target for r in mixing.targets(df, weights, 3).collect()}
    assert got == pytest.approx(brute_targets(sizes, weights, 3))


# ---- packing


def test_pack_is_an_exact_round_trip(spark):
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(VOCABULARY)
    rows = [*corpus(), (500, "a <|endoftext|> b", None, None, None)]
    want = []
    for r in rows:
        ids = np.array([*encode.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) % 64 if len(ids) > 64 else len(ids)
        at = [0, *range(first, len(ids), 64)] if first else range(0, len(ids), 64)
        for k, (a, b) in enumerate(zip(at, [*at[1:], len(ids)], strict=True)):
            want.append((r[0], k, a, b - a, zlib.crc32(ids[a:b].tobytes())))
    got = rows_of(packing.pack(documents(spark, rows), VOCABULARY, 64))
    assert sorted((tuple(r.values())[:5] for r in got), key=str) == sorted(want, key=str)
    full = collections.defaultdict(list)
    for r in got:
        full[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in full.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    least = -(-sum(w[3] for w in want) // 64)
    assert least <= len(full) <= least * 1.02 + 2


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_every_length_and_fills_sequences(seed):
    rng = np.random.default_rng(seed)
    limit = 256
    lengths = np.clip(rng.lognormal(4, 1, 3000 * (seed + 1)).astype(int), 1, limit)
    count = np.bincount(lengths, minlength=limit + 1)
    used, n = np.zeros(limit + 1, int), 0
    for shape, k in packing.plan_sequences(count, limit):
        assert sum(shape) <= limit and k > 0
        n += k
        for v in shape:
            used[v] += k
    assert (used == count).all()
    assert n <= -(-lengths.sum() // limit) * 1.01 + 1
    assert packing.plan_sequences(np.zeros(limit + 1, int), limit) == []


# ---- token counts


def test_length_histogram(spark):
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(VOCABULARY)
    n = np.array([len(encode.encode(r[1] or "", add_special_tokens=False).ids) for r in corpus()])
    got = sorted(rows_of(tokens.length_histogram(documents(spark), VOCABULARY)), key=lambda r: r["length"])
    assert [r["length"] for r in got] == sorted(set(n.tolist()))
    for r in got:
        v = r["length"]
        assert (r["n_docs"], r["docs_up_to"], r["docs_longer"]) == ((n == v).sum(), (n <= v).sum(), (n > v).sum())
        assert (r["tokens"], r["tokens_up_to"]) == (n[n == v].sum(), n[n <= v].sum())
        assert r["truncated_total"] == np.minimum(n, v).sum() and r["quantile"] == pytest.approx((n <= v).mean())


# ---- SimHash


def brute_fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0
    some = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in some]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(n, linked):
    label = list(range(n))
    for i, j in linked:
        a, b = label[i], label[j]
        label = [min(a, b) if x in (a, b) else x for x in label]
    return label


def test_simhash(spark):
    rows = corpus()
    prints = [brute_fingerprint(r[1]) for r in rows]
    linked = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2]
    label = brute_components(len(rows), linked)
    least = {v: min((r[0] for r, x in zip(rows, label, strict=True) if x == v and r[0] is not None), default=None) for v in label}
    want = [(r[0], f"{p:016x}", least[v]) for r, p, v in zip(rows, prints, label, strict=True)]
    got = [tuple(r) for r in simhash.near_duplicates(documents(spark)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize(("budget", "spread", "n"), [(2, 3, 300), (2, 1, 5000), (9, 12, 400), (2, 40, 3000)])
def test_trie_join_finds_every_pair(budget, spread, n):
    """Fingerprints scattered around a few centres, in few and in one unit, dense ones among them."""
    rng = np.random.default_rng(n)
    centres = rng.integers(0, 2**64, 3, dtype=np.uint64)
    words = centres[rng.integers(0, 3, n)]
    for _ in range(spread):
        words = words ^ np.where(rng.random(n) < 0.6, np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64), np.uint64(0))
    words = np.unique(words)
    for unit in (np.zeros(len(words), np.int64), (words >> np.uint64(62)).astype(np.int64)):
        near = np.bitwise_count(words[:, None] ^ words[None]) <= budget
        near &= unit[:, None] == unit[None]
        want = np.arange(len(words))
        while True:
            new = np.where(near, want[None], len(words)).min(axis=1)
            if (new == want).all():
                break
            want = new
        label = np.arange(len(words))
        a, b = simhash.stars(unit, words[:, None], budget)
        from semlake.llm.textblock import components_of

        assert (components_of(len(words), a, b, label) == want).all()


def test_near_dedup_stage_keeps_one_of_each_group(spark):
    docs = documents(spark, [r for r in corpus() if r[0] is not None])
    out = simhash.drop_near_duplicates(docs)
    ids = {r.doc_id for r in out.collect()}
    n = 60
    assert out.columns == docs.columns and not ids & {n, n + 1, n + 2, n + 3, n + 10, n + 11}
    assert ids >= set(range(n)) and n + 12 in ids and not ids & {n + 13, n + 14}


def test_near_dedup_stage_and_repeated_rows(spark):
    """Rows with the same doc_id and text, and a null id: one row of each group stays."""
    long = " ".join(f"w{i}" for i in range(90))
    rows = [(5, long, "en", "s", 1)] * 3 + [(6, long + " more", "en", "s", 1)] * 2 + [(None, "x y z", "en", "s", 1)] * 2 + [(None, "other words", None, None, 1)]
    out = simhash.drop_near_duplicates(documents(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.text[:1]) for r in out) == [("5", "w"), ("None", "o"), ("None", "x")]


def test_clusters_are_checked_against_their_first_text(spark):
    sets = {1: range(100), 2: range(10, 100), 3: range(30, 100), 4: range(5, 105)}
    rows = [(9, n, n == 1, np.array(sorted(x), np.uint64).tobytes()) for n, x in sets.items()]
    df = spark.createDataFrame(rows, "cluster long, node long, first boolean, hashes binary")
    assert [r.node for r in simhash.unlike(df, 0.8).collect()] == [3]


@pytest.mark.parametrize("block", [simhash.BLOCK, 30_000])
def test_near_dedup_stage_decides_borderline_pairs_exactly(spark, monkeypatch, block):
    """Copies with more and more changed words, similarities on both sides of 0.8, and texts of few or repeated words."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(7)
    rows = []
    hub = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(300)]
    for i in range(40):  # a group of more than one small block
        words = hub[:]
        for at in rng.sample(range(300), rng.randint(3, 12)):
            words[at] = f"z{i}"
        rows.append((3000 + i, " ".join(words), "en", "s", 1))
    for i in range(0, 400, 4):
        words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(rng.randint(60, 400))]
        changed = words[:]
        for at in rng.sample(range(len(words)), max(1, round(len(words) * rng.uniform(0.005, 0.06)))):
            changed[at] = "zz"
        rows += [(i, " ".join(words), "en", "s", 1), (i + 1, " ".join(changed), "en", "s", 1)]
    filler = "the same five words again " * 300
    rows += [(1000 + i, filler + " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(80)), "en", "s", 1) for i in range(5)]
    rows += [(2000 + i, t, "en", "s", 1) for i, t in enumerate(["", None, "one", "One ", "one two", "a b c d e f", "a b c d e g"])]
    shingles = {}
    for r in rows:
        w = (r[1] or "").encode().lower().split()
        shingles[r[0]] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    ids = sorted(shingles)
    linked = []
    for i, a in enumerate(ids):
        for j, b in enumerate(ids[:i]):
            if 5 * len(shingles[a] & shingles[b]) >= 4 * len(shingles[a] | shingles[b]):
                linked.append((i, j))
    label = brute_components(len(ids), linked)
    out = simhash.drop_near_duplicates(documents(spark, rows)).collect()
    assert 30 < len(linked) < 700
    assert sorted(r.doc_id for r in out) == [ids[i] for i, x in enumerate(label) if i == x]


# ---- license scan


def brute_scan(text):
    words = license_scan.words_of(text or "")
    places = []
    for label, phrase in license_scan.PHRASES:
        p = phrase.split()
        places += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    at = [i for i, _ in places]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def test_license_scan(spark):
    full = license_scan.TEMPLATES[0][1]
    rows = [
        *corpus(),
        (900, "x " * 7 + full.replace("obtaining", "who now gets") + " y", None, None, None),
        (901, "permission is hereby granted to nobody of charge", None, None, None),
        (902, "General Public general public license license mit mit license", None, None, None),
    ]
    got = rows_of(license_scan.scan(documents(spark, rows)))
    want = sorted(((r[0], *brute_scan(r[1])) for r in rows), key=str)
    assert sorted((tuple(r.values())[:6] for r in got), key=str) == want
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[900]["labels"] == "mit" and 0.7 <= by_id[900]["score"] < 1
    assert by_id[901]["labels"] == "" and by_id[901]["score"] == 0
    assert all(set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) for r in got if r["base_labels"])


def brute_labels(text):
    """Labels and score, place by place: spans of a template's five-word grams in order, whose drift from one gram to the
    next is small, found by trying every gram of the text against every span that is still open."""
    words = license_scan.words_of(text or "")
    score, labels = (1.0, set()) if brute_scan(text)[1] else (0.0, set())
    labels |= set(brute_scan(text)[4].split(",")) - {""}
    for label, template in license_scan.TEMPLATES:
        t = license_scan.words_of(template)
        at = collections.defaultdict(list)
        for j in range(len(t) - 4):
            at[tuple(t[j : j + 5])].append(j)
        hits = [(i, j) for i in range(len(words) - 4) for j in at.get(tuple(words[i : i + 5]), ())]
        open_ = []
        for i, j in hits:
            fit = [(abs((i - j) - (s[-1][0] - s[-1][1])), -n) for n, s in enumerate(open_) if j > s[-1][1] and i > s[-1][0]]
            fit = [f for f in fit if f[0] <= license_scan.DRIFT]
            if fit:
                open_[-min(fit)[1]].append((i, j))
            else:
                open_.append([(i, j)])
        for s in open_:
            share = len({j + d for _, j in s for d in range(5)}) / len(t)
            if share >= license_scan.COVERED:
                labels.add(label)
                score = max(score, share)
    return ",".join(sorted(labels)), score


def test_license_labels_against_brute_force(spark):
    """Whole paragraphs, with words changed, lost, added, out of order, far apart and repeated, within other text."""
    toss = random.Random(11)
    noise = lambda n: toss.choices("river stone calendar license software the of and free".split(), k=n)
    texts = [None, "", "x"]
    for _, template in license_scan.TEMPLATES:
        w = license_scan.words_of(template)
        texts.append(" ".join(noise(9) + w + noise(5)))
        changed = [x for x in w]
        for at in toss.sample(range(len(w)), max(1, len(w) // 12)):
            changed[at] = toss.choice(["", "foo", changed[at] + " bar baz"])
        texts.append(" ".join(noise(3) + changed + noise(200)))
        half = len(w) // 2
        texts.append(" ".join(w[half:] + noise(4) + w[:half]))  # out of order
        texts.append(" ".join(w[:half] + noise(400) + w[half:]))  # far apart
        texts.append(" ".join(w[: half + 2] + noise(3) + w[half:]) + " " + " ".join(w * 3))
    whole = " ".join(t for _, t in license_scan.TEMPLATES)
    texts += [whole, whole.upper() * 2, " ".join(noise(3000)) + whole]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    got = {r.doc_id: (r.labels, r.score) for r in license_scan.scan(documents(spark, rows)).collect()}
    for i, t in enumerate(texts):
        labels, score = brute_labels(t)
        assert got[i] == (labels, pytest.approx(score)), t
    assert len(got) == len(texts) and sum(x[0] != "" for x in got.values()) > 40


def test_license_spans_keep_the_templates_order():
    forward = ([10, 11, 14, 15], [0, 1, 2, 3])  # two words added
    assert license_scan.runs(*forward, 5) == [(10, 20, 4, 8)]
    assert sorted(license_scan.runs([10, 11, 12], [2, 1, 0], 5)) == [(10, 15, 1, 5), (11, 16, 1, 5), (12, 17, 1, 5)]
    assert sorted(license_scan.runs([0, 500], [0, 3], 5)) == [(0, 5, 1, 5), (500, 505, 1, 5)]


# ---- toxicity


def test_toxicity_learns_from_positive_and_unlabelled(spark):
    root = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{root}/documents.parquet"), spark.read.parquet(f"{root}/labels.parquet")
    model = toxicity.train(docs, labels)
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    got = [r for r in toxicity.scores(docs, model).collect() if r.held_out and r.doc_id in truth]
    hit = [r.predicted for r in got if truth[r.doc_id]]
    false = [r.predicted for r in got if not truth[r.doc_id]]
    assert len(got) > 100 and np.mean(hit) >= 0.5 and np.mean(false) <= 0.05
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)


def test_toxicity_edges(spark):
    labels = spark.createDataFrame([(1, 0), (None, 1), (2, None)], "doc_id long, toxic int")
    model = toxicity.train(documents(spark), labels)
    assert {r.score for r in toxicity.scores(documents(spark), model).collect()} == {0.0}
    own = spark.createDataFrame([(i, int(i < 8)) for i in range(60)], "doc_id long, toxic int")
    model = toxicity.train(documents(spark), own)
    got = toxicity.scores(documents(spark), model).collect()
    assert len(got) == len(corpus()) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.drop_toxic(documents(spark), model).columns == documents(spark).columns


def brute_features(text):
    """The same features, word by word: a hash of whole words and of their beginnings, once for each number reached."""
    m = (1 << 64) - 1

    def mix(x):
        x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & m
        x = ((x ^ x >> 27) * 0x94D049BB133111EB) & m
        return x ^ x >> 31

    def hashed(b):
        return sum((c + 1) * pow(0x9E3779B97F4A7C15, i, 1 << 64) for i, c in enumerate(b)) & m

    n = collections.Counter()
    for w in re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower()):
        n[mix(hashed(w)) % toxicity.DIMENSIONS] += 1
        for size in toxicity.BEGINNINGS:
            if len(w) > size:
                n[mix(hashed(w[:size]) + size & m) % toxicity.DIMENSIONS] += 1
    return {b + t * toxicity.DIMENSIONS for b, k in n.items() for t, least in enumerate(toxicity.TIERS) if k >= least}


def brute_model(positive, unlabelled, prior):
    """Weights by feature and the bias, with whole matrices: the corrected risk and its gradient as the papers give them."""
    names = sorted(set().union(*positive, *unlabelled))
    x = np.array([[f in t for f in names] for t in positive + unlabelled], float)
    n_p, n_u = len(positive), len(unlabelled)
    in_p, in_u = x[:n_p].sum(axis=0), x[n_p:].sum(axis=0)
    share = (in_p + in_u) / (n_p + n_u)
    z = (in_p / n_p - in_u / n_u) / np.sqrt(share * (1 - share) * (1 / n_p + 1 / n_u) + 1e-9)
    keep = (abs(z) >= 4) & (in_p + in_u >= 4)
    x = x[:, keep]
    total_w, total_b = np.zeros(x.shape[1]), 0.0
    for m in range(3):
        rng = np.random.default_rng(5 + m)
        w, b, gw, gb = np.zeros(x.shape[1]), np.log(prior / (1 - prior)), np.full(x.shape[1], 1e-4), 1e-4
        for _ in range(40):
            p, u = x[rng.permutation(n_p)], x[n_p + rng.permutation(n_u)]
            sp, su = (1 / (1 + np.exp(-(y @ w + b))) for y in (p, u))
            # Risks with the logistic loss, and their slopes by the linear score of each text.
            rest = np.mean(-np.log(1 - su)) - prior * np.mean(-np.log(1 - sp))
            rest_p, rest_u = -prior * sp / n_p, su / n_u
            slope_p, slope_u = (-rest_p, -rest_u) if rest < 0 else (prior * (sp - 1) / n_p + rest_p, rest_u)
            g, h = slope_p @ p + slope_u @ u + 1e-4 * w, slope_p.sum() + slope_u.sum()
            gw, gb = gw + g * g, gb + h * h
            w, b = w - 0.3 * g / np.sqrt(gw), b - 0.3 * h / np.sqrt(gb)
        total_w, total_b = total_w + w / 3, total_b + b / 3
    return dict(zip(np.array(names)[keep].tolist(), total_w, strict=True)), total_b


def test_toxicity_against_brute_force(spark):
    """Training and every score, from features counted word by word and whole matrices."""
    toss = random.Random(3)
    bad = ["vile", "worthless", "filthyscum", "hateful"]
    rows = []
    for i in range(160):
        text = [" ".join(toss.choices(["river", "stone", "calendar", "Ünïcödé", "walk", "x1"], k=12))]
        text += toss.choices(bad, k=toss.randint(2, 7)) if i % 4 == 0 else []
        rows.append((i, " ".join(text), "en", "s", 1))
    rows += [(1, rows[1][1], "xx", None, 2), (None, "vile vile vile", None, None, 1), (900, None, None, None, 1), (901, "", None, None, 1), (904, "stone " * 9000 + "vile " * 900, "en", "s", 1)]
    labels = [(i, int(i % 4 == 0)) for i in range(0, 160, 2)] + [(904, 1)]
    docs = documents(spark, rows)
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 3 == 1
    known = {i: y for i, y in labels if not out(i)}
    texts = sorted({(int(known.get(r[0], 0) == 1), xxhash.xxh64_intdigest((r[1] or "").encode(), 42) - (1 << 64) * (xxhash.xxh64_intdigest((r[1] or "").encode(), 42) >> 63) if r[1] is not None else 42, r[0], r[1] or "") for r in rows if r[0] is not None and not out(r[0])})
    positive = [brute_features(t[3]) for t in texts if t[0]]
    unlabelled = [brute_features(t[3]) for t in texts if not t[0]]
    weight, bias = brute_model(positive, unlabelled, sum(known.values()) / len(known))
    assert len(positive) > 10 and 904 in known and len(weight) > 5
    got = toxicity.scores(docs, model).collect()
    assert len(got) == len(rows)
    want = {}
    for r in rows:
        s = 1 / (1 + np.exp(-(sum(weight.get(f, 0.0) for f in brute_features(r[1])) + bias)))
        want[r[0]] = s
    for r in got:
        assert r.score == pytest.approx(want[r.doc_id], abs=1e-4) and r.predicted == (r.score >= 0.7) and r.held_out == out(r.doc_id)
    assert max(want.values()) > 0.7 > min(want.values())


def test_toxicity_sample_is_bounded_by_rows(spark, monkeypatch):
    rows = [(i, f"text {n} of {i}", "en", "s", 1) for n in range(100) for i in range(20)]
    labels = spark.createDataFrame([(i, int(i < 10)) for i in range(20)], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda p, u, *a: seen.append((len(p), len(u))))
    toxicity.train(documents(spark, rows), labels, positives=10, unlabelled=7)
    assert seen == [(10, 7)]


# ---- all of them


def test_empty_tables(spark):
    none = documents(spark, [])
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    for out in (
        exact_dedup.exact_duplicates(none), exact_dedup.drop_duplicates(none), mixing.mix(none), mixing.mixed_documents(none),
        packing.pack(none, VOCABULARY), tokens.length_histogram(none, VOCABULARY), simhash.near_duplicates(none),
        simhash.drop_near_duplicates(none), license_scan.scan(none), toxicity.scores(none, toxicity.train(none, labels)),
    ):
        assert out.collect() == []


def test_schema_of_documents_is_all_that_is_needed(spark):
    assert spark.createDataFrame([], DOCS).columns == ["doc_id", "text", "lang", "source", "n_chars"]
