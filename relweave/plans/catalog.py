"""The registry of named queries: a Spark plan and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under a name, with its SQL equivalent if there is one."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def in_utc(spark: SparkSession, folder: str) -> DataFrame:
            zone = spark.conf.get("spark.sql.session.timeZone")
            spark.conf.set("spark.sql.session.timeZone", "UTC")  # a plan keeps the zone it was made in
            try:
                return fn(spark, folder)
            finally:
                spark.conf.set("spark.sql.session.timeZone", zone)

        QUERIES[name] = in_utc
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Comparable output: rounded doubles (deviations to four digits at most), 64-bit integers,
    times as epoch milliseconds."""
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.DoubleType | T.FloatType | T.DecimalType):
            c = F.round(c.cast("double"), min(digits, 4) if "std" in f.name else digits) + F.lit(0.0)
        elif isinstance(f.dataType, T.IntegerType | T.ShortType | T.ByteType | T.BooleanType):
            c = c.cast("bigint")
        elif isinstance(f.dataType, T.TimestampType):
            c = F.unix_millis(c)
        out.append(c.alias(f.name))
    return df.select(*out)


def rnd(expression: str, name: str | None = None, digits: int = 6) -> str:
    """SQL for a rounded double without a negative zero."""
    text = f"round(cast({expression} as double), {digits}) + 0.0"
    return f"{text} as {name}" if name else text


def rnd_half_up(expression: str, name: str, digits: int = 6) -> str:
    """Like ``rnd``, but rounds the decimal digits of the double half up, as Spark does."""
    return f"cast(round(cast(cast({expression} as varchar) as decimal(38, 17)), {digits}) as double) as {name}"


# SQL of the shared input views.
EVENTS = """(select event_id as row_id, user_id as c_user, event_type as c_type, value as n_value, ts as t_01,
  cast(event_type = 'purchase' as bigint) as label from events)"""
EVENTS_NULLS = """(select event_id as row_id, user_id as c_user,
  case when event_id % 7 <> 0 then event_type end as c_type,
  case when value >= 2 then value end as n_value,
  case when event_id % 11 <> 0 then ts end as t_01,
  case when event_id % 5 = 0 then value end as n_sparse,
  cast(event_type = 'purchase' as bigint) as label from events)"""
LINES = """(select cast(l_orderkey as varchar) as c_order, cast(l_partkey as varchar) as c_part,
  cast(l_suppkey as varchar) as c_supp, l_returnflag as c_flag, l_linestatus as c_line, l_quantity as n_qty,
  l_extendedprice as n_price, l_discount as n_disc, l_tax as n_tax, l_shipdate as t_ship from lineitem)"""
ORDERS = """(select o_orderkey as row_id, cast(o_custkey as varchar) as c_cust, cast(o_orderkey as varchar) as c_order,
  o_orderstatus as c_status, o_orderpriority as c_priority, o_totalprice as n_total, o_orderdate as t_01 from orders)"""
PARTS = """(select cast(p_partkey as varchar) as c_part, p_brand as c_brand, p_type as c_type,
  cast(p_size as double) as n_size, p_retailprice as n_retail from part)"""
CUSTOMERS = """(select cast(c_custkey as varchar) as c_cust, cast(c_nationkey as varchar) as c_nation,
  c_mktsegment as c_segment, c_acctbal as n_acctbal from customer)"""
DOCUMENTS = """(select doc_id as row_id, lang as c_lang, source as c_source, string_split(text, ' ')[-1] as c_word,
  string_split(text, ' ') as m_words, cast(n_chars as double) as n_chars from documents)"""

STATS = {
    "mean": "avg({})", "sum": "coalesce(sum({}), 0)", "std": "stddev_samp({})",
    "median": "quantile_cont({}, 0.5)", "min": "min({})", "max": "max({})",
}


def stat_list(columns: list[str], prefix: str = "n_") -> str:
    """SQL select items of the numeric bundle (deviations to four digits)."""
    return ", ".join(
        rnd(sql.format(c), f"{prefix}{s}__{c}", 4 if s == "std" else 6) for c in columns for s, sql in STATS.items()
    )


def millis(expression: str) -> str:
    """SQL for epoch milliseconds, truncated."""
    return f"epoch_us({expression}) // 1000"
