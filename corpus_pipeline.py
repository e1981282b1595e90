"""From raw documents to packed sequences: five stages, each a Parquet table that the next one reads."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relweave.llm import neardup, packing, quality, suffixes, toxicity
from relweave.session import shared_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base and the risk-controlled rules keep."""
    judged = quality.judge(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _only(docs, judged.groupBy("doc_id").agg(F.max("kept").alias("kept")))


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(docs, model)
    return _only(docs, scored.groupBy("doc_id").agg((F.max("predicted") == 0).alias("kept")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the least id."""
    found = neardup.near_duplicates(docs)
    return _only(docs, found.groupBy("doc_id").agg(F.min("kept").alias("kept")))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of strings that occur more than once; bytes of a cut character go too.

    A text of which nothing is left stays, empty."""
    left = suffixes.remove_repeats(docs)
    # a cut inside a character leaves bytes that are no character; they become U+FFFD and go
    cut = F.replace(F.make_valid_utf8(F.col("kept").cast("string")), F.lit("\uFFFD"), F.lit(""))
    left = left.withColumn("text", F.when(F.col("n_removed") == 0, F.col("text")).otherwise(cut))
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 ids, mixed over the sources."""
    rows = packing.tokenised(docs, public_tokenizers.path("byte_bpe_50k.json"), 1, public_tokenizers.PATTERN)
    return packing.pack(spark, rows, 2)


def _only(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The rows of documents that a stage keeps; a row without an id stays."""
    gone = verdicts.filter(~F.col("kept")).select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", toxicity_filter),
    ("near duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("packing", packed),
]

#: Classifier and suffix stages have no SQL; tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written below the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        path = f"{shared_dir(spark).rstrip('/')}/pipeline/{uuid.uuid4().hex}-{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
