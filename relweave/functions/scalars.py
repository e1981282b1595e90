"""Row-wise functions: dates, multi-category sets, arithmetic, bins and scaling."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relweave.functions.aggregates import extent

# ------------------------------------------------------------------------------- time

DATE_PARTS = {
    "year": F.year,
    "month": F.month,
    "day": F.dayofmonth,
    "hour": F.hour,
    "minute": F.minute,
    "second": F.second,
    "week": F.weekofyear,
    "weekday": F.weekday,
}
# The parts taken of the time column by default.
DEFAULT_DATE_PARTS = ("month", "day", "hour", "minute", "second")


def date_parts(column: str, parts: Sequence[str] = DEFAULT_DATE_PARTS) -> list[Column]:
    """``n_<part>__<column>`` for each part; Monday is weekday 0."""
    return [DATE_PARTS[p](F.col(column)).cast("double").alias(f"n_{p}__{column}") for p in parts]


def whole_days_apart(a: str | Column, b: str | Column) -> Column:
    """Whole 24-hour days between two times, without sign."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    micros = F.abs(F.unix_micros(a.cast("timestamp")) - F.unix_micros(b.cast("timestamp")))
    return F.floor(micros / F.lit(86_400_000_000)).cast("bigint")


def time_differences(columns: Sequence[str]) -> list[Column]:
    """Day differences of every pair of time columns; they are numbers that keep the time prefix."""
    return [
        whole_days_apart(a, b).alias(f"t_diff__{a}__{b}", metadata={"ltype": "num"})
        for a, b in combinations(columns, 2)
    ]


def time_bucket(column: str, unit: str = "day") -> Column:
    """Start of the calendar unit a time falls in."""
    return F.date_trunc(unit, F.col(column))


def epoch_millis_to_timestamp(column: Column) -> Column:
    """Epoch milliseconds (string or number, NaN allowed) to a timestamp."""
    number = column.try_cast("double")
    return F.timestamp_millis(F.when(~F.isnan(number), number).cast("bigint"))


# --------------------------------------------------------------------- multi-category


def split_set(column: Column, missing: str = "-1") -> Column:
    """Comma-joined set to array; a null cell becomes the one-element set of ``missing``."""
    return F.coalesce(F.split(column, ","), F.array(F.lit(missing)))


def set_size(column: Column) -> Column:
    """Number of elements of a multi-category array; a null cell counts as one."""
    return F.when(column.isNull(), 1).otherwise(F.size(column))


def first_element(column: Column) -> Column:
    """First element as an integer, null where it is not one."""
    return F.get(column, 0).try_cast("int")


def position_in_set(value: Column, members: Column) -> Column:
    """1-based place of a category value in a multi-category set, 0 if it is not there."""
    return F.coalesce(F.array_position(members, value), F.lit(0)).cast("int")


def domains_intersect(df: DataFrame, category: str, multi: str) -> bool:
    """Whether any value of a category also occurs in a multi-category column."""
    left = df.select(F.col(category).alias("v")).filter("v is not null").distinct()
    right = df.select(F.explode(multi).alias("v")).distinct()
    return not left.join(right, "v", "left_semi").isEmpty()


# ------------------------------------------------------------------------- arithmetic

# Fixed value: added to a denominator before dividing.
DIVIDE_SHIFT = 1e-8


def pair_arithmetic(a: str, b: str) -> list[Column]:
    """Sum, difference, product and shifted quotient of two numeric columns."""
    x, y = F.col(a), F.col(b)
    return [
        (x + y).alias(f"{a}_plus_{b}"),
        (x - y).alias(f"{a}_minus_{b}"),
        (x * y).alias(f"{a}_multiple_{b}"),
        F.try_divide(x, y + F.lit(DIVIDE_SHIFT)).alias(f"{a}_divide_{b}"),
    ]


def floor_modulo(a: Column, b: Column) -> Column:
    """Remainder that takes the sign of the divisor; null for a zero divisor."""
    return F.when(b != 0, a - F.floor(a / F.nullif(b, F.lit(0.0))) * b)


def absolute(a: Column) -> Column:
    return F.abs(a)


def equal_width_bins(df: DataFrame, columns: Sequence[str], bins: int = 10, suffix: str = "_disc") -> DataFrame:
    """Lower edge of the bin a value falls in; the grid starts at the truncated minimum."""
    edges = extent(df, columns)
    return df.select("*", *[_bin(F.col(c), *edges[c], bins).alias(c + suffix) for c in columns])


def _bin(x: Column, low, high, bins: int) -> Column:
    if low is None:
        return F.lit(None).cast("double")
    start = float(int(low))
    width = (high - start) / bins
    if width == 0:
        return F.when(x.isNotNull(), F.lit(start))
    return F.floor((x - F.lit(start)) / F.lit(width)) * F.lit(width) + F.lit(start)


# ---------------------------------------------------------------------------- scaling


def standardise(df: DataFrame, columns: Sequence[str], suffix: str = "_std") -> DataFrame:
    """(x - mean) / sample standard deviation; 0 for a constant column."""
    aggs = [f(c).alias(f"{p}{i}") for i, c in enumerate(columns) for f, p in ((F.avg, "m"), (F.stddev_samp, "s"))]
    row = df.agg(*aggs).first()
    out = []
    for i, c in enumerate(columns):
        mean, std = row[f"m{i}"], row[f"s{i}"]
        out.append(_scaled(F.col(c), mean, std).alias(c + suffix))
    return df.select("*", *out)


def min_max_scale(df: DataFrame, columns: Sequence[str], suffix: str = "_mm", edges: dict | None = None) -> DataFrame:
    """(x - min) / (max - min); 0 for a constant column. ``edges`` reuses fitted extents."""
    edges = edges or extent(df, columns)
    out = []
    for c in columns:
        low, high = edges[c]
        out.append(_scaled(F.col(c), low, None if low is None else high - low).alias(c + suffix))
    return df.select("*", *out)


def _scaled(x: Column, shift, width) -> Column:
    if shift is None:
        return F.lit(None).cast("double")
    if not width:
        return F.when(x.isNotNull(), F.lit(0.0))
    return (x - F.lit(shift)) / F.lit(width)


def log_ratio_score(actual: Column, null_p75: Column) -> Column:
    """Log of an importance over the upper quartile of its null importances."""
    return F.log(F.lit(1e-10) + actual / (F.lit(1.0) + null_p75))


def combine_categories(*columns: str) -> Column:
    """Joint category of several columns; null if any of them is."""
    joined = F.col(columns[0]).cast("string")
    for c in columns[1:]:
        joined = F.concat(joined, F.lit("_"), F.col(c).cast("string"))
    return joined
