"""Attaching per-value statistics to rows without a skewed shuffle."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relweave.functions.ordered import key_sizes
from relweave.session import DEFAULT_SCALE, Scale, materialize

_SLOTS = 1024


def counted(df: DataFrame) -> tuple[int, int]:
    """Rows of a table and about how many bytes they hold, from one pass."""
    width = F.lit(0).cast("bigint")
    for f in df.schema.fields:
        width = width + F.coalesce(_bytes(F.col(f"`{f.name}`"), f.dataType), F.lit(0))
    rows, size = df.agg(F.count(F.lit(1)), F.sum(width)).first()
    return rows, int(size or 0)


def _bytes(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType | T.BinaryType):
        return F.octet_length(c) + 16
    if isinstance(kind, T.ArrayType):
        return 16 + F.aggregate(c, F.lit(0).cast("bigint"), lambda s, x: s + F.coalesce(_bytes(x, kind.elementType), F.lit(0)))
    if isinstance(kind, T.StructType | T.MapType):
        return F.octet_length(F.to_json(c)) + 16
    return F.lit(8)


def lookup_join(
    df: DataFrame,
    table: DataFrame,
    on: Sequence[str],
    rows: int | None = None,
    weight: str | None = None,
    scale: Scale = DEFAULT_SCALE,
) -> DataFrame:
    """Left join of a table that is unique on ``on``.

    The table is broadcast when its counted rows and bytes are few. Otherwise both sides are shuffled with a
    salt (``salted``): values that meet many rows of ``df`` are spread over several tasks, and so are rows
    with a null key. ``weight`` says how many rows of ``df`` each entry meets; without it they are counted.
    ``rows`` is the table's size, if that is known.
    """
    on = list(on)
    extra = [c for c in table.columns if c not in on and c != weight]
    plain = table.select(*on, *extra)
    if rows is None or rows <= scale.broadcast_rows:
        rows, size = counted(plain)
        if rows <= scale.broadcast_rows and size <= scale.broadcast_bytes:
            return df.join(F.broadcast(plain), on, "left").select(*df.columns, *extra)
    if weight is None:
        hot = key_sizes(df, on, scale).counted
    else:
        total = table.agg(F.sum(weight)).first()[0] or 0
        limit = max(scale.block_rows, total // scale.max_hot_keys)
        hot = table.filter(F.col(weight) > limit).select(*on, F.col(weight).alias("__n"))  # at most max_hot_keys
    spread = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return salted(df, plain, on, hot, spread, scale).select(*df.columns, *extra)


def salted_left_join(
    df: DataFrame, table: DataFrame, key: str, base: DataFrame | None = None, scale: Scale = DEFAULT_SCALE
) -> DataFrame:
    """Left join on one key whose large groups on the left are dealt over several tasks.

    ``base`` is a cheaper table with the same key column, used for counting (``df`` itself if none); small
    tables are broadcast by Spark's own rule.
    """
    sizes = key_sizes(df if base is None else base, [key], scale)
    if sizes.hot is None and sizes.null_rows <= scale.block_rows:
        return df.join(table, key, "left")
    return salted(df, table, [key], sizes.counted, max(1, math.ceil(sizes.null_rows / scale.block_rows)), scale)


def salted(
    df: DataFrame, table: DataFrame, on: Sequence[str], hot: DataFrame | None, null_salts: int, scale: Scale
) -> DataFrame:
    """Left join in which a key of ``hot`` (on, ``__n`` rows) has a salt for every block of its rows.

    Entries of ``table`` are repeated once per salt. A row's salt comes from its contents and from the input
    partition it lies in, so that rows equal in every column are spread too; a task that runs
    again deals its rows alike. Rows with a null key are dealt over ``null_salts``.
    """
    absent = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in on])
    left, right, salts = df, table, F.lit(1).cast("bigint")
    for c in on:
        right = right.filter(F.col(c).isNotNull())
    if hot is not None:
        hot = F.broadcast(hot.select(*on, F.ceil(F.col("__n") / F.lit(scale.block_rows)).cast("bigint").alias("__salts")))
        left, right = left.join(hot, on, "left"), right.join(hot, on, "left")
        salts = F.coalesce(F.col("__salts"), salts)
        right = right.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("bigint"), salts - 1))).drop("__salts")
    else:
        right = right.withColumn("__salt", F.lit(0).cast("bigint"))
    plain = [F.col(f"`{f.name}`") for f in df.schema.fields if not isinstance(f.dataType, T.MapType)]
    dealt = F.xxhash64(F.spark_partition_id(), *plain)
    salt = F.pmod(dealt, F.when(absent, F.lit(null_salts).cast("bigint")).otherwise(salts))
    left = left.withColumn("__salt", salt).drop("__salts")
    return left.join(right, [*on, "__salt"], "left").drop("__salt")


def attach_statistics(
    df: DataFrame, by: Sequence[str], aggs: dict[str, Column], scale: Scale = DEFAULT_SCALE
) -> DataFrame:
    """Aggregate per group and attach the result to every row of the group.

    A window over the group would hold a hot group in one task; here the group is reduced
    with partial aggregation, and the one row per group is joined back.
    """
    keyed = df
    for c in by:
        keyed = keyed.filter(F.col(c).isNotNull())
    table = keyed.groupBy(*by).agg(F.count(F.lit(1)).alias("__w"), *[a.alias(n) for n, a in aggs.items()])
    return lookup_join(df, materialize(table), by, weight="__w", scale=scale)


def small_map(pairs: DataFrame, key: str, value: str, kind: T.DataType) -> "SmallMap":
    """A literal map of a table known to be small, for use inside expressions."""
    rows = pairs.select(_slot(F.col(key)).alias("s"), F.col(key).alias("k"), F.col(value).alias("v")).collect()
    slots: list[dict] = [{} for _ in range(_SLOTS)]
    for r in rows:
        slots[r["s"]][r["k"]] = r["v"]
    return SmallMap(json.dumps(slots), kind)


def _slot(c: Column) -> Column:
    return F.pmod(F.xxhash64(c.cast("string")), F.lit(_SLOTS)).cast("int")


class SmallMap:
    """String keys dealt into hashed slots, so that a lookup reads one short map."""

    def __init__(self, text: str, kind: T.DataType):
        self.text, self.kind = text, kind

    def get(self, key: Column) -> Column:
        literal = F.from_json(F.lit(self.text), T.ArrayType(T.MapType(T.StringType(), self.kind)))
        return F.try_element_at(F.get(literal, _slot(key)), key)
