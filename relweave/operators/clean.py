"""Missing values, sparse columns, imputation and column roles.

A fitted cleaner keeps the dropped columns and the fill values, so that later rows are
filled from the training rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relweave.functions.aggregates import mode_of, modes
from relweave.functions.selection import quantiles_of
from relweave.schema import CAT, MULTI, NUM, TIME, columns_of, logical_type
from relweave.session import DEFAULT_SCALE, Scale

# The null share above which a column is dropped, and the constant fills.
SPARSE_THRESHOLD = 0.7
MULTI_FILL = "-1"
TIME_FILL = "1970-01-01 00:00:00"
NUMERIC_CONSTANT = -1.0


def missing_profile(df: DataFrame) -> DataFrame:
    """(column, missing_ratio) for every column, from a single aggregate."""
    n = F.count(F.lit(1))
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.coalesce(F.try_divide(n - F.count(c), n), F.lit(0.0)).alias("missing_ratio"))
            for c in df.columns
        ]
    )
    return df.agg(cells.alias("cells")).select(F.explode("cells").alias("e")).select("e.*")


def sparse_columns(df: DataFrame, threshold: float = SPARSE_THRESHOLD) -> list[str]:
    """Columns whose share of nulls is above the threshold."""
    row = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count(c).alias(c) for c in df.columns]).first()
    n = row["__n"]
    return [c for c in df.columns if n and (n - row[c]) / n > threshold]


def drop_sparse_columns(df: DataFrame, threshold: float = SPARSE_THRESHOLD) -> DataFrame:
    return df.drop(*sparse_columns(df, threshold))


@dataclass
class Cleaner:
    """Fitted cleaning: which columns to drop and what to fill nulls with."""

    dropped: list[str] = field(default_factory=list)
    numeric: dict[str, float | None] = field(default_factory=dict)
    category: dict[str, str | None] = field(default_factory=dict)
    multi_fill: str = MULTI_FILL
    time_fill: str = TIME_FILL

    @classmethod
    def fit(
        cls,
        df: DataFrame,
        threshold: float = SPARSE_THRESHOLD,
        numeric: str = "mean",
        multi_fill: str = MULTI_FILL,
        protect: Sequence[str] = (),
        scale: Scale = DEFAULT_SCALE,
    ) -> Cleaner:
        """Fit on a table; ``numeric`` is mean, median, mode or constant; ``protect`` is never dropped.

        Null shares and means come from one aggregate over all columns; modes from one count
        over all category columns.
        """
        typed_cols = [c for c in df.columns if logical_type(df.schema[c]) is not None]
        nums = columns_of(df, NUM)
        aggs = [F.count(F.lit(1)).alias("__n")]
        aggs += [F.count(c).alias(f"n{i}") for i, c in enumerate(typed_cols)]
        aggs += [F.avg(c).alias(f"m{i}") for i, c in enumerate(nums)]
        row = df.agg(*aggs).first()
        n = row["__n"]
        dropped = [
            c
            for i, c in enumerate(typed_cols)
            if c not in protect and n and (n - row[f"n{i}"]) / n > threshold
        ]
        fills = {c: row[f"m{i}"] for i, c in enumerate(nums) if c not in dropped}
        if numeric == "constant":
            fills = {c: NUMERIC_CONSTANT for c in fills}
        elif numeric == "median":
            fills = {c: found[0] for c, found in quantiles_of(df, {c: [0.5] for c in fills}).items()}
        elif numeric == "mode":
            found = {c: mode_of(df, c).first()[0] for c in fills}
            fills = {c: None if v is None else float(v) for c, v in found.items()}
        elif numeric != "mean":
            raise ValueError(f"unknown numeric strategy {numeric!r}")
        nullable = {c for i, c in enumerate(typed_cols) if row[f"n{i}"] < n}
        cats = [c for c in columns_of(df, CAT) if c not in dropped]
        found = modes(df, [c for c in cats if c in nullable])
        return cls(dropped, fills, {c: found.get(c) for c in cats}, multi_fill)

    def fit_missing_modes(self, df: DataFrame) -> None:
        """Modes of the categories that had no null when fitted (needed before unseen rows)."""
        todo = [c for c, v in self.category.items() if v is None and c in df.columns]
        self.category.update(modes(df, todo))

    def transform(self, df: DataFrame) -> DataFrame:
        """Drop the fitted columns and fill the rest; column metadata is kept."""
        out = []
        for f in df.schema.fields:
            if f.name not in self.dropped:
                out.append(self._filled(f).alias(f.name, metadata=f.metadata or {}))
        return df.select(*out)

    def _filled(self, f: T.StructField) -> Column:
        kind, c = logical_type(f), F.col(f.name)
        if kind == NUM and self.numeric.get(f.name) is not None:
            return F.coalesce(c, F.lit(self.numeric[f.name]))
        if kind == CAT and self.category.get(f.name) is not None:
            return F.coalesce(c, F.lit(self.category[f.name]).cast(f.dataType))
        if kind == MULTI:
            return F.coalesce(c, F.array(F.lit(self.multi_fill)))
        if kind == TIME and isinstance(f.dataType, T.TimestampType | T.TimestampNTZType):
            return F.coalesce(c, F.lit(self.time_fill).cast(f.dataType))
        return c


def clean_tables(tables: dict[str, DataFrame], protect: Sequence[str] = (), scale: Scale = DEFAULT_SCALE):
    """Fit and apply a cleaner to every table; returns the cleaned tables and the cleaners."""
    cleaners = {name: Cleaner.fit(df, protect=protect, scale=scale) for name, df in tables.items()}
    return {name: cleaners[name].transform(df) for name, df in tables.items()}, cleaners


def drop_rows_without_time(df: DataFrame) -> DataFrame:
    """Keep the rows in which every time column is known."""
    return df.dropna("any", subset=columns_of(df, TIME)) if columns_of(df, TIME) else df


def drop_time_columns(df: DataFrame) -> DataFrame:
    return df.drop(*columns_of(df, TIME))


def replace_sentinel_year(df: DataFrame, column: str, sentinel: int = 1970) -> DataFrame:
    """Replace the sentinel year by the most frequent year (the smallest on ties)."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    best = counts.agg(F.min(F.struct(-F.col("n"), F.col(column).alias("y"))).alias("b")).first()["b"]
    if best is None:
        return df
    return df.withColumn(column, F.when(F.col(column) == sentinel, F.lit(best["y"])).otherwise(F.col(column)))


def narrow_numbers(df: DataFrame) -> DataFrame:
    """Cast numeric columns to the smallest type that holds every value without loss."""
    kinds = ("tinyint", "smallint", "int", "float")
    nums = [c for c in columns_of(df, NUM) if not isinstance(df.schema[c].dataType, T.DecimalType)]
    if not nums:
        return df
    checks = []
    for i, c in enumerate(nums):
        for k in kinds:
            ok = F.col(c).try_cast(k).cast("double") == F.col(c).cast("double")
            checks.append(F.bool_and(F.coalesce(ok, F.col(c).isNull())).alias(f"{k}{i}"))
    row = df.agg(*checks).first()
    chosen = {c: next((k for k in kinds if row[f"{k}{i}"]), None) for i, c in enumerate(nums)}
    return df.select(
        *[
            F.col(f.name).cast(chosen[f.name]).alias(f.name, metadata={**(f.metadata or {}), "ltype": NUM})
            if chosen.get(f.name)
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


# ----------------------------------------------------------------------- column roles


def distinct_counts(df: DataFrame, columns: Sequence[str], exact: bool = True) -> DataFrame:
    """(column, n_distinct) of several columns."""
    if exact:
        cells = F.explode(
            F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in columns])
        )
        pairs = df.select(cells.alias("e")).select("e.*").filter("v is not null").distinct()
        return pairs.groupBy("column").agg(F.count(F.lit(1)).alias("n_distinct"))
    row = df.agg(*[F.approx_count_distinct(c).alias(f"d{i}") for i, c in enumerate(columns)])
    cells = [F.struct(F.lit(c).alias("column"), F.col(f"d{i}").alias("n_distinct")) for i, c in enumerate(columns)]
    return row.select(F.explode(F.array(*cells)).alias("e")).select("e.*")


def detect_user_key(main: DataFrame, join_keys: Sequence[str], exact: bool = True) -> str:
    """The join key with the most distinct values in main (first name on ties)."""
    counts = distinct_counts(main, join_keys, exact)
    return counts.orderBy(F.desc("n_distinct"), "column").first()["column"]


def session_candidates(df: DataFrame, user: str, categories: Sequence[str]) -> DataFrame:
    """Categories each of whose values belongs to one user only, with their distinct counts."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in categories]))
    pairs = df.select(F.col(user).alias("__u"), cells.alias("e")).select("__u", "e.*").filter("v is not null")
    per_value = pairs.groupBy("column", "v").agg(F.min("__u").alias("lo"), F.max("__u").alias("hi"))
    per_column = per_value.groupBy("column").agg(
        F.count(F.lit(1)).alias("n_distinct"), F.bool_and(F.col("lo") == F.col("hi")).alias("determines_user")
    )
    return per_column.filter("determines_user").select("column", "n_distinct")


def detect_session(df: DataFrame, user: str, categories: Sequence[str]) -> str | None:
    """The session column: determines the user and has the most distinct values."""
    row = session_candidates(df, user, categories).orderBy(F.desc("n_distinct"), "column").first()
    return row["column"] if row else None


def binary_categories(df: DataFrame, categories: Sequence[str]) -> list[str]:
    """Categories with exactly two non-null values."""
    rows = distinct_counts(df, categories).filter("n_distinct = 2").collect()
    return sorted(r["column"] for r in rows)
