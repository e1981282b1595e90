"""The named queries of this subpackage and their SQL where SQL can say the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relweave.llm import bpe, divergence, grades, hardneg, katz, lsh, neardup, packing, quality, suffixes, tokenfiles, topk, toxicity
from relweave.session import shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@register
def op2_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of the ids and of the decoded bytes of every document."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = bpe.encode(table(spark, folder, "documents"), ranks, public_tokenizers.PATTERN)
    both = bpe.decode(coded, ranks)
    return both.select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@register
def op4_mixture_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's pieces in sequences of 2048 ids."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = packing.tokenised(table(spark, folder, "documents"), path, 1, public_tokenizers.PATTERN)
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return packing.pack(spark, rows, 2).select(*columns)


@register
def op8_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """What the written token files hold for every document."""
    path = f"{shared_dir(spark).rstrip('/')}/tokens/{uuid.uuid4().hex}"
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    tokenfiles.write(table(spark, folder, "documents"), path, tokenizer, 2, public_tokenizers.PATTERN)
    n_tokens = F.floor(F.octet_length("ids") / 4).cast("long")
    return tokenfiles.read(spark, path).select("doc_id", "start", n_tokens.alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


@register
def op3_risk_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Measures and verdict of every document."""
    judged = quality.judge(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return judged.select(*OP3_COLUMNS)


OP3_COLUMNS = [
    "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
]
SQL["op3_risk_rules"] = quality.judge_sql() + f"select {', '.join(OP3_COLUMNS)} from judged"


@register
def op5_ordinal_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Expected grade, chance of an acceptable grade and verdict of every document.

    The ratings are 0 for bad, 1 for good but toxic, 2 for good and clean text."""
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("toxic") == 0, 2)
    model = grades.fit(docs, labels.select("doc_id", grade.alias("grade")))
    return grades.rate(docs, model)


@register
def op9_weak_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = table(spark, folder, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, folder, "labels")))


@register
def op1_circulant_minhash(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate component of every document."""
    return neardup.near_duplicates(table(spark, folder, "documents"))


@register
def op10_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """What stays of every document without strings of 200 bytes that occur more than once."""
    left = suffixes.remove_repeats(table(spark, folder, "documents").select("doc_id", "text"))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@register
def op7_norm_buckets(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 best other vectors of every twentieth vector."""
    whole = F.transform("embedding", lambda v: F.floor(64 * v.cast("double")).cast("double"))
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rows = table(spark, folder, "embeddings").filter(finite).select("vec_id", whole.alias("embedding"))
    found = topk.top_k(rows, rows.filter(F.col("vec_id") % 20 == 0))
    return found.withColumn("score", F.col("score").cast("long"))


SQL["op7_norm_buckets"] = """with v as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * cast(x as double))) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, p.vec_id, cast(list_dot_product(q.e, p.e) as bigint) as score
  from v q join v p on p.vec_id <> q.vec_id where q.vec_id % 20 = 0)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score
from s qualify row_number() over (partition by query_id order by score desc, vec_id) <= 20"""


@register
def op6_katz_backoff(spark: SparkSession, folder: str) -> DataFrame:
    """Log probability of every document by the model of the training documents."""
    docs = table(spark, folder, "documents")
    return katz.score(docs, katz.fit(docs))


@register
def op13_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    """Divergence of every two sources of a language, and each source's over-used terms."""
    return divergence.ranked(divergence.audit(table(spark, folder, "documents")))


SQL["op13_source_divergence"] = divergence.AUDIT_SQL.format(least=10, most=10)


@register
def op11_multiprobe_hashing(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 nearest other vectors found for every twentieth vector."""
    rows = table(spark, folder, "embeddings")
    return lsh.nearest(rows, rows.filter(F.col("vec_id") % 20 == 0))


@register
def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Hard negatives of every hundredth vector; a seventh of the labels is moved on by one."""
    whole = F.transform("embedding", lambda v: F.floor(256 * v.cast("double")).cast("double"))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rows = table(spark, folder, "embeddings").filter(finite).select("vec_id", label.alias("label"), whole.alias("embedding"))
    return hardneg.mine(rows, F.col("vec_id") % 100 == 0)


SQL["op12_hard_negatives"] = hardneg.MINE_SQL
