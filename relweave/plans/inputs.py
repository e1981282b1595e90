"""Views of the sample tables in the roles this package works with.

Source names such as ``c_custkey`` collide with the logical prefixes, so every view renames
and types its columns. Timestamps are stored without a zone and read as UTC.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relweave.schema import MAIN, DatasetConfig, Relation, RelationalDataset


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A source table; its zone-less timestamps become UTC timestamps."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    zoneless = [c for c, t in df.dtypes if t == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in zoneless}) if zoneless else df


def main_orders(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("row_id"),
        F.col("o_custkey").cast("string").alias("c_cust"),
        F.col("o_orderkey").cast("string").alias("c_order"),
        F.col("o_orderstatus").alias("c_status"),
        F.col("o_orderpriority").alias("c_priority"),
        F.col("o_totalprice").alias("n_total"),
        F.col("o_orderdate").alias("t_01"),
    )


def customers(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select(
        F.col("c_custkey").cast("string").alias("c_cust"),
        F.col("c_nationkey").cast("string").alias("c_nation"),
        F.col("c_mktsegment").alias("c_segment"),
        F.col("c_acctbal").alias("n_acctbal"),
    )


def order_lines(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("c_order"),
        F.col("l_partkey").cast("string").alias("c_part"),
        F.col("l_suppkey").cast("string").alias("c_supp"),
        F.col("l_returnflag").alias("c_flag"),
        F.col("l_linestatus").alias("c_line"),
        F.col("l_quantity").alias("n_qty"),
        F.col("l_extendedprice").alias("n_price"),
        F.col("l_discount").alias("n_disc"),
        F.col("l_tax").alias("n_tax"),
        F.col("l_shipdate").alias("t_ship"),
    )


def parts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(
        F.col("p_partkey").cast("string").alias("c_part"),
        F.col("p_brand").alias("c_brand"),
        F.col("p_type").alias("c_type"),
        F.col("p_size").cast("double").alias("n_size"),
        F.col("p_retailprice").alias("n_retail"),
    )


def nations(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "nation").select(
        F.col("n_nationkey").cast("string").alias("c_nation"),
        F.col("n_regionkey").cast("string").alias("c_region"),
        F.col("n_name").alias("c_nname"),
    )


def regions(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "region").select(
        F.col("r_regionkey").cast("string").alias("c_region"), F.col("r_name").alias("c_rname")
    )


STAR = DatasetConfig(
    tables={
        MAIN: {}, "table_1": {}, "table_2": {}, "table_3": {}, "table_4": {}, "table_5": {},
    },
    relations=(
        Relation(MAIN, "table_1", "c_cust", "many_to_one"),
        Relation(MAIN, "table_2", "c_order", "one_to_many"),
        Relation("table_2", "table_3", "c_part", "many_to_one"),
        Relation("table_1", "table_4", "c_nation", "many_to_one"),
        Relation("table_4", "table_5", "c_region", "many_to_one"),
    ),
    time_col="t_01",
)


def star(spark: SparkSession, folder: str) -> RelationalDataset:
    """Orders as main, with customers, order lines, parts, nations and regions around it."""
    return RelationalDataset(
        {
            MAIN: main_orders(spark, folder),
            "table_1": customers(spark, folder),
            "table_2": order_lines(spark, folder),
            "table_3": parts(spark, folder),
            "table_4": nations(spark, folder),
            "table_5": regions(spark, folder),
        },
        STAR,
    )


def events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        F.col("event_id").alias("row_id"),
        F.col("user_id").alias("c_user"),
        F.col("event_type").alias("c_type"),
        F.col("value").alias("n_value"),
        F.col("ts").alias("t_01"),
        F.when(F.col("event_type") == "purchase", 1).otherwise(0).alias("label"),
    )


def events_with_nulls(spark: SparkSession, folder: str) -> DataFrame:
    """Events with holes: small values, every seventh type, every eleventh time, a sparse column."""
    e, i = events(spark, folder), F.col("row_id")
    return e.select(
        "row_id",
        "c_user",
        F.when(i % 7 != 0, F.col("c_type")).alias("c_type"),
        F.when(F.col("n_value") >= 2, F.col("n_value")).alias("n_value"),
        F.when(i % 11 != 0, F.col("t_01")).alias("t_01"),
        F.when(i % 5 == 0, F.col("n_value")).alias("n_sparse"),
        "label",
    )


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with their words as a multi-category column and the last word as a category."""
    words = F.split("text", " ")
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("row_id"),
        F.col("lang").alias("c_lang"),
        F.col("source").alias("c_source"),
        F.element_at(words, -1).alias("c_word"),
        words.alias("m_words"),
        F.col("n_chars").cast("double").alias("n_chars"),
    )


def labelled_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that have a quality label."""
    labels = table(spark, folder, "labels").select(F.col("doc_id").alias("row_id"), F.col("quality").alias("label"))
    return documents(spark, folder).join(labels, "row_id")
