"""The operators as queries over the driver's tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataline.llm import secrets

    return secrets.scan(table(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataline.llm import packing

    return packing.pack(table(spark, sf_dir, "documents"), capacity=1024, end_id=2)


def op3_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataline.llm import ann

    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataline.llm import sharding

    docs = table(spark, sf_dir, "documents").select("doc_id")
    return sharding.place(docs, ["doc_id"], [f"shard-{i:04d}" for i in range(256)], slots=65_537).select("doc_id", F.col("slot").cast("long"), "shard", "shard_name")


def op5_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataline.llm import records

    return records.round_trip(table(spark, sf_dir, "documents"), end_id=0)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataline.llm import pii

    return pii.scan(table(spark, sf_dir, "documents"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataline.llm import quality

    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataline.llm import line_dedup

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup(docs).select("doc_id", "n_lines", "n_removed", "text")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataline.llm import decontam

    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataline.llm import minhash

    return minhash.groups(table(spark, sf_dir, "documents"), shingle=2, percent=80).select("doc_id", "n_shingles", "component_id", "kept")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataline.llm import fim

    return fim.digest(table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataline.llm import phrases

    return phrases.collocations(table(spark, sf_dir, "documents"), least=100, depth=5, top=2000)


def op13_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataline.llm import simhash

    return simhash.groups(table(spark, sf_dir, "documents"), shingle=4, radius=4)


def queries() -> dict[str, Query]:
    return {k: f for k, f in sorted(globals().items()) if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    from strataline.llm import sql

    return dict(sql.ORACLE)
