"""The corpus pipeline: toxicity filter, exact dedup, SimHash near-dedup, mixing to target weights, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet into the folder that the
cluster shares and rereads as the next stage's docs. All but the last return the columns of documents. The models and
hashes of the stages can't be expressed in SQL, so ORACLE_SQL is None; tests compare run() with a brute-force version.

Defined results: a null text counts as empty; documents score by their text alone, so a null doc_id or repeated row is kept
or dropped like any other; of equal texts, and of a group of near-duplicates, the row with the smallest doc_id stays (a
null one last), and of rows that share it one; a null source is a source of its own; rows that the mix takes several times
are packed as often; an empty table has an empty result; columns beyond those of documents, whatever their names, come
along to the last stage and play no part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from semlake.llm import exact_dedup, mixing, packing, simhash, tokens, toxicity
from semlake.llm.common import table


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs, toxicity.train(docs, labels))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_duplicates(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_duplicates(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokens.default_vocabulary())


STAGES = [
    ("toxicity", toxicity_filter),
    ("exact_dedup", exact_dedup_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = table(stage(spark, docs, sf_dir), name)
    return docs
