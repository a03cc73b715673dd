"""SimHash near-dedup: fingerprints of word shingles, linked by a self-join of their binary trie.

The trie over the fingerprints' bits is joined with itself: pairs of nodes go down together, differing bits add up, and
a pair whose sum exceeds the Hamming budget is pruned with all below it. To deal the join out, the trie is rooted in
several bit orders: fingerprints that agree in a root's bits meet in one unit (a node paired with itself), whose subtrie
is traversed in the remaining bits. With more roots than the budget, cut from disjoint bits, every pair within the budget
agrees in a root (three roots for two differing bits), so none is missed.

Only distinct fingerprints are joined; a unit hands on a star for each of its groups, never all pairs; components are
found by distributed rounds.

Defined results: a null text counts as empty; texts without words have fingerprint zero and link like any other; rows
that share a doc_id are fingerprinted one by one; a null doc_id never names a component unless no other id is in it; an
empty table has an empty result; other columns, whatever their names, play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semlake.llm import textblock
from semlake.llm.common import components, drop_table, join_hot, pick_rows, table, text_key

SEED = 42
#: Shingles counted at a time.
STEP = 1 << 14
Root = tuple[int, int, int]  # word, lowest bit, number of bits


def shingle_hashes(text: bytes, k: int) -> np.ndarray:
    """XXH64 of every k consecutive words, lower-cased and joined by spaces; of all words where there are fewer."""
    words = text.lower().split()  # for bytes: A-Z and the six ASCII spaces only
    if not words:
        return np.zeros(0, np.uint64)
    joined = memoryview(b" ".join(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - k + 1)
    last = ends[min(k, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    return np.fromiter(
        (digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), last.tolist(), strict=True)), np.uint64, n
    )


def fingerprint(hashes: np.ndarray, words: int = 1) -> bytes:
    """64 bits for each word, big-endian: a bit is 1 if it is set in over half the hashes. Words after the first use
    hashes of the hashes."""
    ones = np.zeros(64 * words, np.int64)
    for at in range(0, len(hashes), STEP):
        h = hashes[at : at + STEP, None]
        if words > 1:
            salts = np.arange(words, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            h = np.where(salts == 0, h, textblock.mix(h + salts))
        bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(len(h), -1), axis=1)
        ones += bits.sum(axis=0, dtype=np.uint16)  # STEP fits
    return np.packbits(ones * 2 > len(hashes)).tobytes()


def fingerprints(docs: DataFrame, k: int, words: int = 1, sets: bool = False) -> DataFrame:
    """(doc_id, text_key, fp, size) for every row; sets: repeats of a shingle don't count. size: shingles counted."""
    names = ["doc_id", "text_key", "fp", "size"]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for b in textblock.batches(part, "text"):
                texts = b.column(2).cast(pa.binary()).to_pylist()
                prints, size = [], []
                for t in texts:
                    h = shingle_hashes(t or b"", k)
                    h = np.unique(h) if sets else h
                    prints.append(fingerprint(h, words))
                    size.append(len(h))
                yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(prints, pa.binary()), pa.array(size, pa.int64())], names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), "text")
    return rows.mapInArrow(run, "doc_id long, text_key long, fp binary, size long")


class Trie:
    """Fingerprints of several units, each unit's sorted as the leaves of its trie."""

    #: Node pairs kept at a time; more are put aside and taken up later.
    MOST = 1 << 20

    def __init__(self, unit: np.ndarray, words: np.ndarray, budget: int) -> None:
        self.order = np.lexsort([*words.T[::-1], unit])
        self.unit, self.words, self.budget = unit[self.order], np.ascontiguousarray(words[self.order]), budget
        # A wide budget prunes nothing near the root; its small nodes are compared leaf by leaf.
        self.leaf = 64 if budget <= 4 else 4096

    def ones(self, level: int) -> np.ndarray:
        """How many of the leaves before each have this level's bit set."""
        bit = (self.words[:, level // 64] >> np.uint64(63 - level % 64)) & np.uint64(1)
        return np.concatenate([[0], np.cumsum(bit, dtype=np.int64)])

    def leaves(self, pairs: tuple[np.ndarray, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Linked leaves below pairs of nodes."""
        a0, a1, b0, b1, _ = pairs
        size = (a1 - a0) * (b1 - b0)
        at = 0
        total = np.cumsum(size)
        while at < len(size):
            end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + self.MOST, side="right")))
            n = size[at:end]
            nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            wide = np.repeat((b1 - b0)[at:end], n)
            i, j = np.repeat(a0[at:end], n) + nth // wide, np.repeat(b0[at:end], n) + nth % wide
            once = i < j
            i, j = i[once], j[once]
            apart = np.zeros(len(i), np.int64)
            for w in range(self.words.shape[1]):
                apart += np.bitwise_count(self.words[i, w] ^ self.words[j, w])
                if w + 1 < self.words.shape[1]:
                    near = apart <= self.budget
                    i, j, apart = i[near], j[near], apart[near]
            near = apart <= self.budget
            yield i[near], j[near]
            at = end

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All linked leaves within units, a batch at a time."""
        edge = np.flatnonzero(np.concatenate([[True], self.unit[1:] != self.unit[:-1], [True]]))
        a0, a1 = edge[:-1], edge[1:]
        many = a1 - a0 > 1
        stack = [(0, (a0[many], a1[many], a0[many], a1[many], np.zeros(many.sum(), np.int64)))]
        depth = 64 * self.words.shape[1]
        while stack:
            level, now = stack.pop()
            while len(now[0]):
                if len(now[0]) > self.MOST:
                    half = len(now[0]) // 2
                    stack.append((level, tuple(x[half:] for x in now)))
                    now = tuple(x[:half] for x in now)
                small = ((now[1] - now[0]) * (now[3] - now[2]) <= self.leaf) | (level == depth)
                yield from self.leaves(tuple(x[small] for x in now))
                a0, a1, b0, b1, d = (x[~small] for x in now)
                if not len(a0):
                    break
                ones = self.ones(level)
                am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
                same = a0 == b0
                children = [(a0, am, b0, bm, d), (am, a1, bm, b1, d), (a0, am, bm, b1, d + 1)]
                children.append(tuple(x[~same] for x in (am, a1, b0, bm, d + 1)))
                now = tuple(np.concatenate(x) for x in zip(*children, strict=True))
                a0, a1, b0, b1, d = now
                going = (d <= self.budget) & (a1 > a0) & (b1 > b0) & ((a0 != b0) | (a1 - a0 > 1))
                now = tuple(x[going] for x in now)
                level += 1

    def absorb(self, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Group the dense parts of large units ahead: all leaves within the budget of a unit's central leaf are one group
        already, so they need no comparison with each other; against them only leaves within twice the budget can link.
        Returns the labels and which leaves are left for the traversal."""
        left = np.ones(len(self.unit), bool)
        edge = np.flatnonzero(np.concatenate([[True], self.unit[1:] != self.unit[:-1], [True]]))
        for u in np.flatnonzero(np.diff(edge) > 2048):
            at = np.arange(edge[u], edge[u + 1])
            while len(at) > 2048:
                some = self.words[at[:: max(1, len(at) // 4096)]]
                bits = np.unpackbits(some.astype(">u8").view(np.uint8).reshape(len(some), -1), axis=1)
                middle = np.packbits(bits.mean(axis=0) > 0.5).view(">u8").astype(np.uint64)
                far = np.bitwise_count(self.words[at] ^ middle).sum(axis=1, dtype=np.int64)
                pivot = self.words[at[far.argmin()]]
                far = np.bitwise_count(self.words[at] ^ pivot).sum(axis=1, dtype=np.int64)
                near, border = at[far <= self.budget], at[(far > self.budget) & (far <= 2 * self.budget)]
                if len(near) < len(at) // 64:
                    break
                label = textblock.components_of(len(label), near[1:], np.full(len(near) - 1, near[0]), label)
                step = max(1, self.MOST // max(1, len(border)))
                for k in range(0, len(near) if len(border) else 0, step):
                    some = near[k : k + step]
                    apart = np.bitwise_count(self.words[some][:, None] ^ self.words[border][None]).sum(axis=2, dtype=np.int64)
                    i, j = np.nonzero(apart <= self.budget)
                    label = textblock.components_of(len(label), some[i], border[j], label)
                left[near] = False
                at = at[far > self.budget]
        return label, left


def stars(unit: np.ndarray, words: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """(member, centre) for the members of each group of linked fingerprints within the units."""
    trie = Trie(unit, words, budget)
    label, left = trie.absorb(np.arange(len(unit)))
    kept = np.flatnonzero(left)
    rest = Trie(trie.unit[kept], trie.words[kept], budget)
    for i, j in rest.pairs():
        label = textblock.components_of(len(label), kept[rest.order[i]], kept[rest.order[j]], label)
    member = np.flatnonzero(label != np.arange(len(label)))
    return trie.order[member], trie.order[label[member]]


def links(prints: DataFrame, roots: Sequence[Root], budgets: Sequence[int]) -> DataFrame:
    """(u, v, level): stars that join every group of distinct fingerprints (node, fp) which some root brings together; the
    budgets' places are the levels, so that fingerprints move once for all of them."""
    n_words = 1 + max(w for w, _, _ in roots)

    def words_of(b: pa.RecordBatch, column: str = "fp") -> np.ndarray:
        col = b.column(b.schema.get_field_index(column))
        return np.frombuffer(b"".join(col.to_pylist()), ">u8").astype(np.uint64).reshape(b.num_rows, -1)

    def route(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            words = words_of(b)
            for k, (w, low, width) in enumerate(roots):
                key = (words[:, w] >> np.uint64(low)) & np.uint64((1 << width) - 1)
                unit = (key | np.uint64(k << 40)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(unit), *b.columns], names=["unit", "node", "fp"])

    def join(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in parts if b.num_rows]
        if not held:
            return
        unit = np.concatenate([b.column(0).to_numpy() for b in held])
        node = np.concatenate([b.column(1).to_numpy() for b in held])
        words = np.concatenate([words_of(b) for b in held])
        del held
        shared = np.unique(unit, return_inverse=True, return_counts=True)
        many = shared[2][shared[1]] > 1
        unit, node, words = unit[many], node[many], words[many]
        for w in range(n_words):  # the root's bits go last, as all of a unit agree in them
            for low, width in {(x[1], x[2]) for x in roots if x[0] == w}:
                k = [i for i, x in enumerate(roots) if x == (w, low, width)]
                own = np.isin(unit >> 40, k)
                turn = np.uint64((64 - low) % 64)
                if turn and own.any():
                    words[own, w] = (words[own, w] << turn) | (words[own, w] >> (np.uint64(64) - turn))
        # Words are compared as a set, so a unit's own word may come first; unit order keeps that consistent.
        first = np.array([roots[i][0] for i in range(len(roots))])[unit >> 40] if len(unit) else np.zeros(0, int)
        for w in range(1, n_words):
            own = first == w
            words[own] = np.roll(words[own], -w, axis=1)
        for level, budget in enumerate(budgets):
            a, b = stars(unit, words, budget)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b]), pa.array(np.full(len(a), level, np.int32))], names=["u", "v", "level"])

    routed = prints.select("node", "fp").mapInArrow(route, "unit long, node long, fp binary")
    return routed.repartition("unit").mapInArrow(join, "u long, v long, level int")


def distinct(prints: DataFrame) -> DataFrame:
    """(fp, least, n, node): each fingerprint of prints (doc_id, fp) once, under its number in this written table."""
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    return table(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")


def labelled(prints: DataFrame, nodes: DataFrame, found: DataFrame) -> DataFrame:
    """prints (doc_id, fp) with root, a name of the component that the links found (u, v) make, and component_id, the
    smallest doc_id that they reach."""
    member = table(components(found.select("u", "v")), "components")
    # Fingerprints without a link are their own component and need no join beyond this one.
    rooted = nodes.join(member, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = table(rooted, "rooted")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("size"))
    groups = join_hot(rooted, table(least, "roots"), "root", "size", nodes.count())
    groups = table(groups.select("fp", "n", "node", "root", "component_id"), "groups")
    drop_table(member)
    return join_hot(prints, groups, "fp", "n", prints.count())


#: Every pair of 64-bit fingerprints within two bits agrees in one of these.
EXACT_ROOTS: tuple[Root, ...] = ((0, 42, 22), (0, 21, 21), (0, 0, 21))


def near_duplicates(docs: DataFrame, k: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row: 64 bits, linked at two differing bits or fewer."""
    prints = table(fingerprints(docs, k).drop("text_key", "size"), "prints")
    nodes = distinct(prints)
    found = table(links(nodes, EXACT_ROOTS, (2,)), "links")
    return labelled(prints, nodes, found).select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


#: For similar rather than almost equal texts: six words of 64 bits, rooted in five runs of 12 bits in each.
WIDE_WORDS = 6
WIDE_ROOTS: tuple[Root, ...] = tuple((w, 12 * b, 12) for w in range(WIDE_WORDS) for b in range(5))


def hamming_budget(similarity: float, bits: int, errors: float) -> int:
    """Differing bits to expect at a Jaccard similarity of shingles, and ``errors`` standard errors more: sets with that
    similarity have cosine 2J / (1 + J) or more, and a bit differs with the chance angle / pi."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.floor(bits * share + errors * math.sqrt(bits * share * (1 - share)))


def shingle_sets(docs: DataFrame, wanted: DataFrame, names: list[str], k: int) -> DataFrame:
    """(names, hashes): the distinct shingles, as sorted 64-bit hashes, of the texts that wanted (names, doc_id, text_key)
    names; docs has each doc_id and text once."""
    types = dict(wanted.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in names)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for b in textblock.batches(part, "text"):
                texts = b.column(len(names)).cast(pa.binary()).to_pylist()
                sets = [np.unique(shingle_hashes(t or b"", k)).tobytes() for t in texts]
                yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(sets, pa.binary())], names=[*names, "hashes"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), "text")
    same = rows["doc_id"].eqNullSafe(wanted["doc_id"]) & (rows["text_key"] == wanted["text_key"])
    return rows.join(wanted, same).select(*names, "text").mapInArrow(run, f"{schema}, hashes binary")


#: Shingles in a bucket, where those of several texts are told from those of one.
BUCKET = 1 << 20
#: Partitions that buckets are dealt to at most, as many partitions cost the driver; further buckets share them, one at a time.
PARTITIONS = 1 << 16
#: Frequent shingles are found in a sample of about so many texts, and so many of them are kept out of the buckets. Any
#: choice gives the same pairs, as it only says which shingles come last.
SAMPLE, FREQUENT = 10_000, 1 << 16


def text_name(doc_id: Column | str, key: Column | str) -> Column:
    """64 bits for a row. Two rows with one name could at worst hide a pair from shared_links; they join nothing."""
    return F.xxhash64(doc_id, key)


def frequent_shingles(rows: DataFrame, k: int, n_rows: int) -> np.ndarray:
    """The most frequent shingles of a sample of rows (name, text), sorted."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for b in textblock.batches(part, "text"):
                found = [np.unique(shingle_hashes(t or b"", k)) for t in b.column(1).cast(pa.binary()).to_pylist()]
                shingle, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *found]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(shingle.view(np.int64)), pa.array(n)], names=["shingle", "n"])

    share = min(1 << 30, SAMPLE * (1 << 30) // max(1, n_rows))
    some = rows.where(F.pmod(F.xxhash64(F.lit(31), "name"), F.lit(1 << 30)) < share).mapInArrow(run, "shingle long, n long")
    often = some.groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= max(4, SAMPLE // 2000))
    found = often.orderBy(F.desc("n"), "shingle").limit(FREQUENT).select("shingle").toArrow()
    return np.sort(found.column(0).to_numpy().view(np.uint64))


def repeated_shingles(rows: DataFrame, k: int, frequent: np.ndarray, buckets: int) -> DataFrame:
    """(name, n, shingle): the shingles of rows (name, text) that more than one row has, each under a number of its own
    (now and then several under one), n being the rows that have it or, for the frequent ones, more than all rows.

    Shingles move packed, by hash into buckets; the frequent ones by row, so no bucket holds what very many rows share.
    """

    def packed(values: np.ndarray, at: np.ndarray) -> pa.Array:
        offsets = (at * values.itemsize).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.tobytes())])

    def deal(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for b in textblock.batches(part, "text", 4 << 20):
                found = [np.unique(shingle_hashes(t or b"", k)) for t in b.column(1).cast(pa.binary()).to_pylist()]
                shingle = np.concatenate([np.zeros(0, np.uint64), *found])
                name = np.repeat(b.column(0).to_numpy(), [len(x) for x in found])
                bucket = ((shingle >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
                value = (shingle & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                if len(frequent):
                    place = np.minimum(np.searchsorted(frequent, shingle), len(frequent) - 1)
                    often = frequent[place] == shingle
                    bucket[often] = buckets + name[often] % buckets
                    value[often] = place[often]
                order = np.argsort(bucket, kind="stable")
                edge = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1))
                if len(order):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(bucket[order][edge[:-1]]), packed(value[order], edge), packed(name[order], edge)], names=["bucket", "value", "name"]
                    )

    def count(t: pa.Table) -> pa.Table:
        bucket = t.column("bucket")[0].as_py()
        value = np.frombuffer(b"".join(t.column("value").to_pylist()), np.uint32)
        name = np.frombuffer(b"".join(t.column("name").to_pylist()), np.int64)
        if bucket >= buckets:
            n, shingle = np.full(len(value), np.iinfo(np.int64).max), -1 - value.astype(np.int64)
        else:
            order = np.argsort(value, kind="stable")
            value, name = value[order], name[order]
            n = np.diff(np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1], [True]])))
            n = np.repeat(n, n)
            several = n > 1
            n, name, shingle = n[several], name[several], (bucket << 32) + value[several].astype(np.int64)
        return pa.table({"name": pa.array(name), "n": pa.array(n, pa.int64()), "shingle": pa.array(shingle, pa.int64())})

    # As many partitions as the shingles ask for, whatever the session's setting.
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.mapInArrow(deal, "bucket long, value binary, name binary")
    dealt = dealt.repartition(max(least, min(2 * buckets, PARTITIONS)), "bucket")
    return dealt.groupBy("bucket").applyInArrow(count, "name long, n long, shingle long")


def shared_links(docs: DataFrame, nodes: DataFrame, copies: DataFrame, k: int, similarity: float) -> DataFrame:
    """(u, v): stars that join any two nodes (node, name, size) whose shingles have that similarity, and others besides.
    Each node is the row of docs by its name; copies (name) are the rows that aren't nodes.

    A prefix filter: the rarest shingles of each text come first; similar sets then share one among the first
    n - ceil(similarity * n) + 1 of each, n being its own size. Shingles of one text join nothing but come before all
    others, so few texts have any that matters among their first.
    """
    n_rows, total = nodes.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    rows = docs.select(text_name(F.col("doc_id").cast("long"), text_key()).alias("name"), "text").join(copies, "name", "left_anti")
    frequent = frequent_shingles(rows, k, n_rows)
    repeated = repeated_shingles(rows, k, frequent, max(1, -(-total // BUCKET)))
    ranked = repeated.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("n", "shingle"))).alias("all")).join(nodes, "name")
    first = F.col("size") - F.ceil(F.col("size") * F.lit(similarity) - F.lit(1e-9)) + 1
    mine = (first - (F.col("size") - F.size("all"))).cast("int")
    some = ranked.where(mine > 0).select("node", F.explode(F.slice("all", F.lit(1), mine)).alias("x")).select("node", "x.shingle")
    some = table(some.distinct(), "first")
    stars = table(some.groupBy("shingle").agg(F.min("node").alias("v"), F.count(F.lit(1)).alias("n")), "firsts")
    return join_hot(some, stars, "shingle", "n", some.count()).where("node <> v").select(F.col("node").alias("u"), "v")


#: Bytes of shingles in a block, and in a unit of texts that are checked against one; smaller groups are cut into so many
#: blocks of at least so many bytes.
BLOCK, UNIT = 4 << 20, 64 << 10
PARTS, SMALL = 4, 256 << 10


def similar(cluster: np.ndarray, sets: Sequence[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(u, v): a star for each group of clusters that similar sets join. Texts are met through shared shingles; pairs
    within a cluster or a group found so far need no comparison, and none is handed on."""
    names, own = np.unique(cluster, return_inverse=True)
    size = np.array([len(x) for x in sets])
    shingle = np.unique(np.concatenate(sets), return_inverse=True)[1] if size.sum() else np.zeros(0, np.int64)
    order = np.argsort(shingle, kind="stable")
    text = np.repeat(np.arange(len(sets)), size)[order]
    first = np.concatenate([[0], np.cumsum(np.bincount(shingle))])
    at = np.concatenate([[0], np.cumsum(size)])
    label = np.arange(len(names))
    for i in range(len(sets)):
        mine = shingle[at[i] : at[i + 1]]
        n = first[mine + 1] - first[mine]
        if (label[own] == label[own[i]]).all() or not (n > 1).any():
            continue
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        both = np.bincount(text[np.repeat(first[mine], n) + nth], minlength=len(sets))
        like = np.flatnonzero((both > 0) & (both >= similarity * (size[i] + size - both) - 1e-9))
        label = textblock.components_of(len(label), np.full(len(like), own[i]), own[like], label)
    member = np.flatnonzero(label != np.arange(len(label)))
    return names[member], names[label[member]]


def similar_clusters(sets: DataFrame, similarity: float) -> DataFrame:
    """(u, v): links between clusters by similar texts, given sets (loose, cluster, node, hashes).

    All texts of a loose group are compared. Groups of up to SMALL bytes of shingles share units, several in each; larger
    ones are cut into blocks by hash, PARTS or as many of BLOCK bytes as it takes, and every two blocks meet in a unit.
    """
    block = F.least(F.greatest(F.col("bytes") / F.lit(PARTS), F.lit(min(SMALL, BLOCK))), F.lit(BLOCK))
    sizes = sets.groupBy("loose").agg(F.sum(F.length("hashes")).alias("bytes"))
    sizes = table(sizes.withColumn("blocks", F.ceil(F.col("bytes") / block).cast("int")), "sizes")
    shared = max(1, -(-(sizes.where("blocks <= 1").agg(F.sum("bytes")).first()[0] or 0) // SMALL))
    dealt = sets.join(sizes.drop("bytes"), "loose").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    small = dealt.where("blocks <= 1").select(F.pmod(F.xxhash64("loose"), F.lit(shared)).alias("unit"), F.lit(-1).alias("p"), F.lit(-1).alias("q"), "cluster", "hashes")
    large = dealt.where("blocks > 1").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    large = large.select(F.col("loose").alias("unit"), F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "cluster", "hashes")

    def run(t: pa.Table) -> pa.Table:
        rows = [np.frombuffer(x, np.uint64) for x in t.column("hashes").to_pylist()]
        u, v = similar(t.column("cluster").to_numpy(), rows, similarity)
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return small.unionByName(large).groupBy("unit", "p", "q").applyInArrow(run, "u long, v long")


def unlike(sets: DataFrame, similarity: float) -> DataFrame:
    """(node): texts of sets (cluster, node, first, hashes) that are less similar than that to the one text of their
    cluster which is marked first. A cluster's texts are dealt into units of about UNIT bytes, and its first text goes to
    each of them."""
    sizes = sets.groupBy("cluster").agg(F.ceil(F.sum(F.length("hashes")) / F.lit(UNIT)).cast("int").alias("units"))
    units = F.greatest("units", F.lit(1))
    dealt = sets.join(table(sizes, "sizes"), "cluster").withColumn(
        "unit", F.explode(F.when(F.col("first"), F.sequence(F.lit(0), units - 1)).otherwise(F.array(F.pmod(F.xxhash64("node"), units).cast("int"))))
    )

    def run(t: pa.Table) -> pa.Table:
        rows = [np.frombuffer(x, np.uint64) for x in t.column("hashes").to_pylist()]
        first, node = t.column("first").to_numpy(), t.column("node").to_numpy()
        one = rows[int(first.argmax())]
        both = np.array([np.isin(x, one, assume_unique=True).sum() for x in rows])
        size = np.array([len(x) for x in rows])
        far = ~first & (both < similarity * (size + len(one) - both) - 1e-9)
        return pa.table({"node": pa.array(node[far], pa.int64())})

    return dealt.groupBy("cluster", "unit").applyInArrow(run, "node long")


def drop_near_duplicates(docs: DataFrame, k: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one row of each group of near-duplicates: that with the smallest doc_id (then the smallest text hash, then
    the smallest hash over all columns; of rows equal in all of them one).

    Texts are compared by their sets of k-word shingles. Fingerprints of 384 bits that lie three standard errors nearer
    than ``similarity`` asks for make clusters, whose texts are each checked against the cluster's first by exact Jaccard
    similarity; those that fail stand alone. Fingerprints up to three standard errors further make loose groups, and so do
    texts that share one of their rarest shingles, which loses no pair. In loose groups of several clusters all texts are compared
    exactly, and clusters join where similarity is at least ``similarity``.
    """
    prints = table(fingerprints(docs, k, WIDE_WORDS, sets=True), "prints")
    row = lambda i, t: F.concat_ws("-", F.coalesce(i.cast("string"), F.lit("none")), t.cast("string"))
    names = prints.groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("n")).select(row(F.col("doc_id"), F.col("text_key")).alias("__row"), "n")
    several = table(names.where("n > 1").drop("n"), "several")
    if not several.isEmpty():
        docs = table(pick_rows(docs, row(F.col("doc_id"), text_key()), names.drop("n"), several), "documents")
    bits = 64 * WIDE_WORDS
    print_nodes = distinct(prints)
    found = table(links(print_nodes, WIDE_ROOTS, (hamming_budget(similarity, bits, -3), hamming_budget(similarity, bits, 3))), "links")
    clusters = labelled(prints, print_nodes, found.where("level = 0")).drop("component_id")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    nodes = clusters.groupBy("fp", "node", "root").agg(F.min(order).alias("k"), F.min_by("size", order).alias("size"))
    nodes = table(nodes.drop("fp").withColumn("name", text_name("k.doc_id", "k.text_key")), "nodes")
    copies = table(prints.select(text_name("doc_id", "text_key").alias("name")).join(nodes, "name", "left_anti").distinct(), "copies")
    near = found.where("level = 1").select("u", "v").unionByName(shared_links(docs, nodes.select("node", "name", "size"), copies, k, similarity))
    loose = table(components(near).withColumnRenamed("root", "loose"), "loose")
    # Texts in a loose group are read once: for the check of clusters, and for the comparison of what is left.
    firsts = nodes.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.min_by("node", "k").alias("first"))
    grouped = nodes.join(loose, "node").join(firsts, "root")
    grouped = grouped.select("loose", F.col("root").alias("cluster"), "node", "n", (F.col("node") == F.col("first")).alias("first"), "k.doc_id", "k.text_key")
    sets = table(shingle_sets(docs, grouped, ["loose", "cluster", "node", "n", "first"], k), "sets")
    # What lies near a cluster's first text is checked against it; what fails gets a name that no node has.
    far = table(unlike(sets.where("n > 1").drop("n"), similarity).withColumn("far", F.lit(True)), "unlike")
    rename = lambda df, root: df.join(far, "node", "left").withColumn("cluster", F.when(F.col("far"), -1 - F.col("node")).otherwise(F.col(root))).drop("far")
    sets = rename(sets.select("loose", "cluster", "node", "hashes"), "cluster")
    mixed = rename(grouped.select("loose", "cluster", "node"), "cluster").groupBy("loose").agg(F.min("cluster").alias("a"), F.max("cluster").alias("b")).where("a < b").select("loose")
    joined = components(similar_clusters(table(sets.join(mixed, "loose"), "mixed"), similarity)).select(F.col("node").alias("cluster"), F.col("root").alias("whole"))
    least = rename(nodes.select("node", "root", "k"), "root").groupBy("cluster").agg(F.min("k").alias("k")).join(joined, "cluster", "left")
    kept = least.groupBy(F.coalesce("whole", "cluster").alias("whole")).agg(F.min("k").alias("k"))
    kept = kept.select(row(F.col("k.doc_id"), F.col("k.text_key")).alias("__row"))
    # Fewer rows go than stay, as a rule: where they are few enough to send, no text moves.
    gone = table(names.select("__row").join(kept, "__row", "left_anti"), "gone")
    return docs.withColumn("__row", row(F.col("doc_id"), text_key())).join(gone, "__row", "left_anti").select(*docs.columns)
