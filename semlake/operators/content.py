"""Content: hash, compress, pad and back; chunks and their reference counts; placement."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from semlake.operators.ontology import rule_table
from semlake.plans import algebra as A
from semlake.plans.compile import Collection, memberships

PAD = 4096
TIERS = ("pin", "prefer", "replicate", "auto-tier")  # by precedence


class ContentError(ValueError):
    pass


class UnsupportedAlgo(ContentError):
    pass


class EncryptionDisabled(ContentError):
    pass


def content_hash(data: Column) -> Column:
    return F.sha2(data.cast("binary"), 256)


def padded_length(n: Column, block: int = PAD) -> Column:
    """The next multiple of block; nothing stays nothing."""
    return (F.ceil(n / F.lit(block)) * block).cast("long")


def _map(run, returns: str):  # noqa: ANN001, ANN202
    @F.arrow_udf(returns)
    def mapped(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            yield pa.array([None if x is None else run(x) for x in part.cast(pa.binary()).to_pylist()], pa.binary())

    return mapped


def compress(data: Column, algo: str = "zstd", level: int = 3) -> Column:
    if algo == "none":
        return data.cast("binary")
    if algo != "zstd":
        raise UnsupportedAlgo(algo)

    def run(x: bytes) -> bytes:
        import zstandard

        return zstandard.ZstdCompressor(level=level).compress(x)

    return _map(run, "binary")(data.cast("binary"))


def decompress(data: Column, algo: str = "zstd") -> Column:
    if algo == "none":
        return data
    if algo != "zstd":
        raise UnsupportedAlgo(algo)

    def run(x: bytes) -> bytes:
        import zstandard

        return zstandard.ZstdDecompressor().decompress(x)

    return _map(run, "binary")(data)


def apply_pipeline(blobs: DataFrame, algo: str = "zstd", level: int = 3, encryption: str = "none") -> DataFrame:
    """(oid, content_hash, blob_length, stored_size, stored) for blobs (oid, data)."""
    if encryption != "none":
        raise EncryptionDisabled(encryption)
    raw = F.col("data").cast("binary")
    return blobs.select(
        "oid", content_hash(raw).alias("content_hash"), F.octet_length(raw).cast("long").alias("blob_length"), compress(raw, algo, level).alias("stored")
    ).withColumn("stored_size", F.octet_length("stored").cast("long"))


def invert_pipeline(stored: DataFrame, algo: str = "zstd") -> DataFrame:
    """(oid, data, intact): contents again, and whether they have the hash that was recorded."""
    data = stored.withColumn("data", decompress(F.col("stored"), algo))
    return data.select("oid", "data", (content_hash(F.col("data")) == F.col("content_hash")).alias("intact"))


def fixed_chunks(blobs: DataFrame, size: int) -> DataFrame:
    """(oid, seq, hash, length) of (oid, data): pieces of that size, the last one shorter; no content, no chunk."""
    data = F.col("data").cast("binary")
    n = F.ceil(F.octet_length(data) / F.lit(size)).cast("int")
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.expr("cast(array() as array<int>)"))
    rows = blobs.select("oid", data.alias("data"), F.explode(starts).alias("seq"))
    piece = F.substring(F.col("data"), F.col("seq") * size + 1, F.lit(size))
    return rows.select("oid", "seq", content_hash(piece).alias("hash"), F.octet_length(piece).cast("long").alias("length"))


def chunk_index(chunks: DataFrame) -> DataFrame:
    """(hash, ref_count, length): equal chunks are kept once."""
    return chunks.groupBy("hash").agg(F.count(F.lit(1)).alias("ref_count"), F.first("length").alias("length"))


def release(index: DataFrame, released: DataFrame) -> DataFrame:
    """The index after chunks (hash) are given up: counts go down, and at none the entry goes."""
    gone = released.groupBy("hash").agg(F.count(F.lit(1)).alias("gone"))
    left = index.join(gone, "hash", "left").withColumn("ref_count", F.col("ref_count") - F.coalesce("gone", F.lit(0)))
    return left.where("ref_count > 0").drop("gone")


def _first_match(c: Collection, queries: Sequence[A.Query]) -> tuple[DataFrame, Column]:
    """Tagged objects, and the place of the first query that holds for each, else null; one pass for all queries."""
    found = memberships([A.Not(A.Or()), *queries], c).where("q0")
    first = F.lit(None).cast("int")
    for i in reversed(range(len(queries))):
        first = F.when(F.col(f"q{i + 1}"), F.lit(i)).otherwise(first)
    return found, first


def place(c: Collection, rules: Sequence[tuple], default: str) -> DataFrame:
    """(oid, rule, target) for every tagged object: the rule (kind, target, query[, priority]) of the highest precedence that
    holds, the one of higher priority and then the earlier one among equals, else the default. All rules are flags of one
    pass over the assertions."""
    order = sorted(range(len(rules)), key=lambda n: (TIERS.index(rules[n][0]), -(rules[n][3] if len(rules[n]) > 3 else 0), n))
    found, first = _first_match(c, [rules[n][2] for n in order])
    known = [F.struct(F.lit(rules[n][0]).alias("rule"), F.lit(rules[n][1]).alias("target")) for n in order]
    known.append(F.struct(F.lit("default").alias("rule"), F.lit(default).alias("target")))
    made = F.element_at(F.array(*known), F.coalesce(first, F.lit(len(order))) + 1)
    return found.select("oid", made.alias("r")).select("oid", "r.rule", "r.target")


def chunking_of(c: Collection, rules: Sequence[tuple[dict, A.Query]], default: dict) -> DataFrame:
    """(oid, params): the chunking (a map of names to texts) of the first Chunk rule (params, query) that holds."""
    found, first = _first_match(c, [q for _, q in rules])
    maps = [F.create_map(*[F.lit(str(x)) for pair in p.items() for x in pair]) for p in (*[p for p, _ in rules], default)]
    return found.select("oid", F.element_at(F.array(*maps), F.coalesce(first, F.lit(len(rules))) + 1).alias("params"))


def colocated(c: Collection, queries: Sequence[A.Query], disks: DataFrame) -> DataFrame:
    """(oid, rule, disk_id) for objects that Colocate rules hold together, the first rule that holds deciding: all of a rule
    are on one online disk, rules being dealt to disks by free room, most first."""
    found, first = _first_match(c, queries)
    online = disks.where("state = 'online'").orderBy(F.desc(F.col("capacity") - F.col("used")), "disk_id").limit(max(1, len(queries))).collect()
    if not online:
        raise ContentError("no disk is online")
    ids = F.array(*[F.lit(online[i % len(online)].disk_id) for i in range(len(queries))])
    return found.select("oid", first.alias("rule")).where("rule is not null").select("oid", "rule", F.element_at(ids, F.col("rule") + 1).alias("disk_id"))


def pool_status(disks: DataFrame) -> DataFrame:
    """(tier, disks, capacity, used, faulted) of disks (disk_id, tier, capacity, used, state)."""
    return disks.groupBy("tier").agg(
        F.count(F.lit(1)).alias("disks"), F.sum("capacity").alias("capacity"), F.sum("used").alias("used"),
        F.array_sort(F.collect_list(F.when(F.col("state") == "faulted", F.col("disk_id")))).alias("faulted"),
    )


def pick_disk(disks: DataFrame, tier: str) -> DataFrame:
    """The online disk of a tier with most room, the first among equals."""
    free = F.col("capacity") - F.col("used")
    return disks.where((F.col("tier") == tier) & (F.col("state") == "online")).orderBy(F.desc(free), "disk_id").limit(1)


#: A random word for each byte, by a rule; a gear hash adds them up, one bit further for each byte.
GEAR = np.array([int.from_bytes(hashlib.sha256(bytes([i])).digest()[:4], "little") for i in range(256)], np.uint32)


def cut_points(data: bytes, least: int, most: int, mask: int) -> list[int]:
    """Content-defined ends of chunks: where the gear hash of the 32 bytes up to there has the mask's bits clear, between
    least and most bytes after the last end."""
    raw = np.frombuffer(data, np.uint8)
    ends, start, step = [], 0, 1 << 20
    cuts = []
    for at in range(0, len(raw), step):  # a part at a time, with the 31 bytes before it
        word = GEAR[raw[max(0, at - 31) : at + step]]
        h = np.zeros(len(word), np.uint32)
        for k in range(min(32, len(word))):
            h[k:] += word[: len(word) - k] << np.uint32(k)
        cuts.append(np.flatnonzero((h[at - max(0, at - 31) :] & np.uint32(mask)) == 0) + at + 1)
    cuts = np.concatenate(cuts) if cuts else np.zeros(0, np.int64)
    while len(raw) - start > least:
        i = int(np.searchsorted(cuts, start + least))
        end = min(int(cuts[i]) if i < len(cuts) else len(raw), start + most, len(raw))
        ends.append(end)
        start = end
    return ends + [len(raw)] * (start < len(raw))


def cdc_chunks(blobs: DataFrame, least: int = 16 << 10, average: int = 64 << 10, most: int = 256 << 10) -> DataFrame:
    """(oid, seq, hash, length) of (oid, data): content-defined pieces, so that an insertion changes only the pieces near it.
    Pieces are between least and most bytes long, but for the last; no content, no chunk."""
    mask = (1 << max(1, round(math.log2(max(2, average - least))))) - 1
    schema = pa.schema([("oid", pa.int64()), ("seq", pa.int32()), ("hash", pa.string()), ("length", pa.int64())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            for i in range(b.num_rows):
                data = b.column(1)[i].as_py() or b""
                ends = cut_points(data, least, most, mask)
                pieces = [data[s:e] for s, e in zip([0, *ends], ends, strict=False)]
                columns = [[b.column(0)[i].as_py()] * len(ends), list(range(len(ends))), [hashlib.sha256(p).hexdigest() for p in pieces], list(map(len, pieces))]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return blobs.select("oid", F.col("data").cast("binary").alias("data")).mapInArrow(run, "oid long, seq int, hash string, length long")


def presence(objects: DataFrame, held: DataFrame) -> DataFrame:
    """(oid, presence) of objects (oid, content_hash) on a node that holds contents (content_hash, state): as the state says
    (cached, hydrating, partial), local where it says nothing else, remote where the node has none; null without content."""
    own = held.groupBy("content_hash").agg(F.min("state").alias("state"), F.lit(True).alias("here"))
    state = F.when(F.col("content_hash").isNull(), None).when(F.col("here").isNull(), "remote").otherwise(F.coalesce("state", F.lit("local")))
    return objects.join(own, "content_hash", "left").select("oid", state.alias("presence"))


def policy_of_objects(tags: DataFrame, ontology) -> DataFrame:  # noqa: ANN001
    """(oid, axis, declared_by): for each axis that a tag of the object declares, the most derived such tag."""
    declared = [(axis, t) for axis in ("chunking", "compression", "encryption") for t in ontology.declared(axis)]
    # How many declaring tags of its axis a tag implies; along one axis they are a chain, so most wins.
    rows = [(t, axis, sum(ontology.is_a(t, o) for a, o in declared if a == axis)) for axis, t in declared]
    known = rule_table(tags.sparkSession, rows, "tag string, axis string, depth int")
    found = tags.select("oid", "tag").join(known, "tag")
    nth = F.row_number().over(Window.partitionBy("oid", "axis").orderBy(F.desc("depth"), "tag"))
    return found.withColumn("nth", nth).where("nth = 1").select("oid", "axis", F.col("tag").alias("declared_by"))
