"""The subpackage's queries, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from semlake.llm import chat_format, embed_dedup, exact_dedup, license_scan, line_dedup, mixing, packing, simhash, tokens, toxicity

Query = Callable[[SparkSession, str], DataFrame]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def on(name: str, apply: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: apply(read(spark, sf_dir, name))


def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.scores(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def queries() -> dict[str, Query]:
    return {
        "op1_embedding_near_dedup": on("embeddings", embed_dedup.near_duplicates),
        "op2_pattern_packing": on("documents", lambda d: packing.pack(d, tokens.default_vocabulary())),
        "op3_exact_dedup": on("documents", exact_dedup.exact_duplicates),
        "op4_license_scan": on("documents", license_scan.scan),
        "op5_source_mixing": on(
            "documents", lambda d: mixing.mix(d).select("doc_id", "size", "source_size", "target", "taken", "copies")
        ),
        "op6_simhash_near_dedup": on("documents", simhash.near_duplicates),
        "op7_token_counts": on("documents", lambda d: tokens.length_histogram(d, tokens.default_vocabulary())),
        "op8_preference_format": on(
            "conversations", lambda c: chat_format.digest(chat_format.formatted(chat_format.replies_as_pairs(c)))
        ),
        "op9_site_line_dedup": on("pages", line_dedup.drop_repeated_lines),
        "op10_toxicity": toxicity_scores,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_exact_dedup": exact_dedup.oracle(),
        "op8_preference_format": chat_format.ORACLE,
        "op9_site_line_dedup": line_dedup.oracle(),
    }
