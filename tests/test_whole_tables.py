"""Queries over a small table of the cases that the generated tables hold few or none of, against brute force."""

from collections import Counter
from hashlib import sha256

import pytest

from pyspark.sql import functions as F

from semlake import catalogue
from semlake.functions.values import oid
from semlake.operators import content

TEXTS = [
    None, "", "a", "é", "plain text", "plain text", "naïve café", "x" * 65_536, "x" * 65_537, "é" * 32_768, "é" * 40_000,
    "a" + "é" * 40_000, "plain words, and one accent at the end of many: " * 3000 + "é", "y" * 300, "z" * 301, "word " * 5000,
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return path


def test_chunks_of_every_text(spark, folder):
    size = 65_536
    chunks = [b[at : at + size] for b in ((t or "").encode() for t in TEXTS) for at in range(0, len(b), size)]
    expected = {(sha256(c).hexdigest(), n, len(c)) for c, n in Counter(chunks).items()}
    got = catalogue.queries()["q_chunk_dedup"](spark, folder).select("hash", "ref_count", "length").collect()
    assert len(got) == len(expected) and {tuple(r) for r in got} == expected


def test_pipeline_of_every_text(spark, folder):
    got = {r.oid: r for r in catalogue.queries()["q_content_pipeline"](spark, folder).collect()}
    assert len(got) == len(TEXTS)
    for n, t in enumerate(TEXTS):
        r, b = got[oid(5, n)], None if t is None else t.encode()
        assert r.intact is True
        if b is None:
            assert (r.content_hash, r.blob_length, r.padded) == (None, None, None)
        else:
            assert (r.content_hash, r.blob_length, r.padded) == (sha256(b).hexdigest(), len(b), -(-len(b) // 4096) * 4096)


def test_sizes_as_the_compressor_gives_them(spark, folder):
    import zstandard

    rows = spark.read.parquet(f"{folder}/documents.parquet").select(F.col("doc_id").alias("oid"), F.col("text").alias("data"))
    got = {r.oid: r for r in content.apply_pipeline(rows).collect()}
    for n, t in enumerate(TEXTS):
        assert got[n].stored_size == (None if t is None else len(zstandard.ZstdCompressor(level=3).compress(t.encode())))
    assert any(r.blob_length is not None and r.stored_size >= r.blob_length for r in got.values())
