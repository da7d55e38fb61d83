"""Corpus pipeline: documents to packed training sequences in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of `documents`.  run() writes each stage's rows as
Parquet into the shared folder and reads them again as the next one's docs, so
a lost executor costs at most the stage at hand.

Defined cases: a null or empty text is scored like any other, keeps no line and
no shingle, is linked with nothing, and packs as its end id; null ids stay and
are one document each; rows equal in id and text are treated alike by every
stage; an empty table gives an empty result of the same columns; columns beside
doc_id and text pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.llm import decontam, line_dedup, minhash, packing, quality
from strataline.session import Scratch
from strataline.sources.tables import table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows go, and documents of which nothing is left; n_chars follows the text."""
    cleaned = line_dedup.dedup(docs).where(~((F.col("n_removed") > 0) & (F.trim(F.col("text")) == "")))
    return cleaned.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word shingle sets with similarity 0.8 or more stays."""
    return minhash.dedup(docs, shingle=5, percent=80)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a ten-word window of a benchmark item go."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 1024 tokens."""
    return packing.pack(docs, capacity=1024, end_id=2)


STAGES = [
    ("quality_classifier", good_quality),
    ("line_dedup", without_repeated_lines),
    ("minhash_near_dedup", without_near_duplicates),
    ("benchmark_decontamination", without_benchmark),
    ("best_fit_packing", packed),
]

#: SQL can't train the classifier, so the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over all of `documents`.

    What a stage made on its way is deleted when its rows are written.
    """
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch.within(f"{name}-work"):
            docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs
