"""Encoders of categories and multi-categories.

An encoder is fitted once; its statistics are tables written to the shared folder (anything
that grows with the number of values) or short lists. Transforming joins them, so a value
gets the same code in training and in scoring; an unseen value gets -1, 0 or null.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relweave.functions.aggregates import value_counts
from relweave.functions.lookup import SmallMap, attach_statistics, lookup_join, small_map
from relweave.functions.ordered import Scan, prefix_scan, row_index
from relweave.functions.scalars import first_element, set_size
from relweave.schema import CAT, LABEL, MULTI, NUM, ROW_ID, columns_of, typed
from relweave.session import DEFAULT_SCALE, Scale, materialize

# Fixed value: ranks of multi-category values are capped here.
MULTI_RANK_CAP = 1000


@dataclass
class CategoryEncoder:
    """Codes by first appearance, value frequencies and capped one-hot columns.

    ``values`` has one row per (column, value): rows ``n``, code, frequency. All columns are
    counted in one pass.
    """

    columns: list[str]
    values: DataFrame | None
    sizes: dict[str, int]
    top: dict[str, list[str]] = field(default_factory=dict)
    scale: Scale = DEFAULT_SCALE
    small: set[str] = field(default_factory=set)

    @classmethod
    def fit(
        cls,
        df: DataFrame,
        columns: Sequence[str],
        row_id: str = ROW_ID,
        one_hot: int = 0,
        scale: Scale = DEFAULT_SCALE,
    ) -> CategoryEncoder:
        columns = list(columns)
        if not columns:
            return cls([], None, {}, {}, scale)
        cells = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]
        long = df.select(F.col(row_id).alias("__id"), F.explode(F.array(*cells)).alias("e")).select("__id", "e.*")
        counts = (
            long.filter("value is not null")
            .groupBy("column", "value")
            .agg(F.count(F.lit(1)).alias("n"), F.min("__id").alias("__first"))
        )
        counts = materialize(counts)
        sums = counts.groupBy("column").agg(
            F.count(F.lit(1)).alias("d"), F.sum("n").alias("t"), F.sum(F.octet_length("value") + 48).alias("b")
        )
        per_column = {r["column"]: r for r in sums.collect()}
        coded = row_index(counts, ["__first", "value"], "code", ["column"], scale=scale)
        share = F.lit(None).cast("double")
        for c, r in per_column.items():
            share = F.when(F.col("column") == c, F.col("n") / F.lit(float(r["t"]))).otherwise(share)
        values = materialize(coded.select("column", "value", "n", "code", share.alias("freq")))
        sizes = {c: (per_column[c]["d"] if c in per_column else 0) for c in columns}
        small = {c for c in columns if c not in per_column or (per_column[c]["d"] <= scale.broadcast_rows and per_column[c]["b"] <= scale.broadcast_bytes)}
        top: dict[str, list[str]] = {}
        if one_hot > 0:
            order = Window.partitionBy("column").orderBy(F.desc("n"), "value")
            leading = values.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= one_hot + 1)
            for r in sorted(leading.select("column", "value", "r").collect(), key=lambda r: r["r"]):
                if r["r"] <= min(one_hot, sizes[r["column"]] - 1) + 1 and sizes[r["column"]] > 1:
                    top.setdefault(r["column"], []).append(r["value"])
        return cls(columns, values, sizes, top, scale, small)

    def lookup(self, column: str) -> DataFrame:
        return self.values.filter(F.col("column") == column).drop("column")

    def transform(self, df: DataFrame, code: bool = True, freq: bool = True) -> DataFrame:
        """Replace each category by its code and add ``n_freq__<column>`` and one-hot columns.

        Values of a column that fit are broadcast, by the sizes counted when they were fitted, so that no
        job runs here. All larger columns go through one join: their cells (row, column, value) meet the
        values table once, heavy values over several tasks, and come back as one row per row.
        """
        columns = [c for c in self.columns if c in df.columns]
        for c in columns:
            df = df.select("*", *one_hot_columns(c, self.top.get(c, [])))
        df = df.withColumns({c: F.col(c).cast("string") for c in columns})
        names = df.columns
        found: dict[str, tuple[Column, Column]] = {}
        for i, c in enumerate(columns):
            if c in self.small:
                code_i, freq_i = f"__code{i}", f"__freq{i}"
                table = self.lookup(c).select(F.col("value").alias(c), F.col("code").alias(code_i), F.col("freq").alias(freq_i))
                df = df.join(F.broadcast(table), c, "left")
                found[c] = F.col(code_i), F.col(freq_i)
        large = [c for c in columns if c not in self.small]
        if large:
            df, more = self._joined(df, large)
            found |= more
        new = {c: [typed(F.coalesce(found[c][1], F.lit(0.0)), f"n_freq__{c}", NUM)] if freq else [] for c in columns}
        out = [typed(F.coalesce(found[n][0], F.lit(-1)), n, CAT) if n in found and code else F.col(n) for n in names]
        return df.select(*out, *[x for c in columns for x in new[c]])

    def _joined(self, df: DataFrame, large: list[str]) -> tuple[DataFrame, dict[str, tuple[Column, Column]]]:
        """The rows with the codes and shares of all large columns, from one join of their cells.

        The number that ties the cells to their row is written out once with the rows."""
        rows = materialize(df.withColumn("__cells", F.monotonically_increasing_id()))
        cells = [F.struct(F.lit(i).alias("__i"), F.lit(c).alias("column"), F.col(c).alias("value")) for i, c in enumerate(large)]
        long = rows.select("__cells", F.explode(F.array(*cells)).alias("e")).select("__cells", "e.*").filter("value is not null")
        table = self.values.filter(F.col("column").isin(large)).select("column", "value", "n", "code", "freq")
        met = lookup_join(long, table, ["column", "value"], sum(self.sizes[c] for c in large), "n", self.scale)
        picks = [F.max(F.when(F.col("__i") == i, F.col(x))).alias(f"__{x}__{i}") for i in range(len(large)) for x in ("code", "freq")]
        back = met.groupBy("__cells").agg(*picks)
        out = rows.join(back, "__cells", "left").drop("__cells")
        return out, {c: (F.col(f"__code__{i}"), F.col(f"__freq__{i}")) for i, c in enumerate(large)}


def one_hot_columns(column: str, top: Sequence[str]) -> list[Column]:
    """0/1 columns of the leading values; the last listed value labels all others pooled."""
    if not top:
        return []
    c = F.col(column).cast("string")
    out = [F.when(c == v, 1).otherwise(0).alias(f"c_{column}__dummy_{i}") for i, v in enumerate(top[:-1], 1)]
    rest = F.when(c.isNull() | c.isin(*top[:-1]), 0).otherwise(1) if top[:-1] else F.lit(1)
    return [*out, rest.alias(f"c_{column}__dummy_rest")]


def align_to_schema(df: DataFrame, wanted: Sequence[str], one_hot: dict[str, tuple[str, str]]) -> DataFrame:
    """Rebuild missing one-hot columns: ``one_hot`` maps a column name to (category, value)."""
    out = []
    for name in wanted:
        if name in df.columns:
            out.append(F.col(name))
        elif name in one_hot:
            column, value = one_hot[name]
            out.append(F.when(F.col(column).cast("string") == value, 1).otherwise(0).alias(name))
        else:
            raise KeyError(f"column {name} is neither present nor a fitted one-hot column")
    return df.select(*out)


def factorize(df: DataFrame, column: str, row_id: str = ROW_ID, scale: Scale = DEFAULT_SCALE) -> DataFrame:
    """Replace a category by the order of its first appearance; null becomes -1."""
    return CategoryEncoder.fit(df, [column], row_id, scale=scale).transform(df, freq=False)


def frequency_encode(df: DataFrame, column: str, name: str | None = None, scale: Scale = DEFAULT_SCALE) -> DataFrame:
    """Add the share of rows that have the value (of the rows that have any)."""
    table = materialize(value_counts(df, column, "__f"))
    name = name or f"n_freq__{column}"
    return lookup_join(df, table.withColumnRenamed("__f", name), [column], weight="n", scale=scale)


# --------------------------------------------------------------------- multi-category


@dataclass
class MultiCategoryEncoder:
    """Per column: the smallest frequency rank in the set (``code``), or the set size (``count``)."""

    columns: list[str]
    method: str
    ranks: dict[str, SmallMap] = field(default_factory=dict)
    cap: int = MULTI_RANK_CAP

    @classmethod
    def fit(
        cls,
        df: DataFrame,
        columns: Sequence[str],
        method: str = "code",
        cap: int = MULTI_RANK_CAP,
    ) -> MultiCategoryEncoder:
        """Rank the values of each column (``code``, at any size; ``auto`` means the same), or count.

        Ranks above the cap collapse into one, so the list of ranked values never exceeds it.
        """
        columns = list(columns)
        if method == "auto":
            method = "code"
        if method not in ("code", "count"):
            raise ValueError(f"unknown multi-category method {method!r}")
        ranks = {}
        for c in columns if method == "code" else []:
            values = df.select(F.explode(F.coalesce(F.col(c), F.array(F.lit("-1")))).alias("v"))
            top = values.groupBy("v").count().orderBy(F.desc("count"), "v").limit(cap)
            ranked = top.withColumn("r", F.row_number().over(Window.orderBy(F.desc("count"), "v")) - 1)
            ranks[c] = small_map(ranked, "v", "r", T.IntegerType())
        return cls(columns, method, ranks, cap)

    def _rank_of(self, column: str):
        known = self.ranks[column]
        return lambda x: F.coalesce(known.get(x), F.lit(self.cap))

    def transform(self, df: DataFrame, keep: bool = False) -> DataFrame:
        out = []
        for c in self.columns:
            m = F.coalesce(F.col(c), F.array(F.lit("-1")))
            if self.method == "count":
                out.append(typed(set_size(F.col(c)), f"c_mvcount__{c}", CAT))
            else:
                out.append(typed(F.array_min(F.transform(m, self._rank_of(c))), f"c_mvcode__{c}", CAT))
        rest = [c for c in df.columns if keep or c not in self.columns]
        return df.select(*rest, *out)


def multi_frequency(
    df: DataFrame, column: str, row_id: str = ROW_ID, scale: Scale = DEFAULT_SCALE
) -> DataFrame:
    """Sum, mean and deviation of the element frequencies of each set, added to the rows."""
    cells = df.select(row_id, F.explode(column).alias("__v"))
    table = materialize(value_counts(cells, "__v", "__f"))
    joined = lookup_join(cells, table, ["__v"], weight="n", scale=scale)
    stats = joined.groupBy(row_id).agg(
        F.sum("__f").alias(f"n_mvfreq_sum__{column}"),
        F.avg("__f").alias(f"n_mvfreq_mean__{column}"),
        F.coalesce(F.stddev_samp("__f"), F.lit(0.0)).alias(f"n_mvfreq_std__{column}"),
    )
    return df.join(stats, row_id, "left")


# ------------------------------------------------------------- target and other encoders


def target_mean_expanding(
    df: DataFrame,
    column: str,
    order: Sequence[str],
    label: str = LABEL,
    prior: float = 0.0,
    prior_weight: float = 0.0,
    name: str | None = None,
    scale: Scale = DEFAULT_SCALE,
) -> DataFrame:
    """Mean label of the earlier rows of the same category, smoothed; sees no later row."""
    y = F.col(label).cast("double")
    scans = {
        "__s": Scan("sum", y, inclusive=False, skip_null=False),
        "__n": Scan("count", y, inclusive=False, skip_null=False),
    }
    out = prefix_scan(df, order, scans, [column], scale)
    num = F.coalesce(F.col("__s"), F.lit(0.0)) + F.lit(prior * prior_weight)
    value = F.try_divide(num, F.col("__n") + F.lit(prior_weight))
    return out.select(*df.columns, value.alias(name or f"n_ctr__{column}"))


def target_mean_out_of_fold(
    df: DataFrame,
    column: str,
    label: str = LABEL,
    fold: str = "fold",
    prior: float = 0.0,
    prior_weight: float = 0.0,
    name: str | None = None,
    scale: Scale = DEFAULT_SCALE,
) -> DataFrame:
    """Mean label of the same category in the other folds, smoothed."""
    y = F.col(label).cast("double")
    per_fold = df.filter(F.col(column).isNotNull()).groupBy(column, fold).agg(
        F.sum(y).alias("s"), F.count(y).alias("c"), F.count(F.lit(1)).alias("w")
    )
    every = Window.partitionBy(column)
    num = F.sum("s").over(every) - F.col("s") + F.lit(prior * prior_weight)
    den = F.sum("c").over(every) - F.col("c") + F.lit(prior_weight)
    name = name or f"n_ctr__{column}"
    table = materialize(per_fold.select(column, fold, "w", F.try_divide(num, den.cast("double")).alias(name)))
    return lookup_join(df, table, [column, fold], weight="w", scale=scale)


def hash_code(column: str | Column, buckets: int) -> Column:
    """Bucket of a category by its md5, the same in any engine; needs no fitting, and null has none."""
    c = F.col(column) if isinstance(column, str) else column
    digits = F.substring(F.md5(c.cast("string").cast("binary")), 1, 12)
    return (F.conv(digits, 16, 10).cast("bigint") % F.lit(buckets)).cast("int")


def hash_code_set(column: str, buckets: int) -> Column:
    """Sorted distinct hash buckets of a multi-category set."""
    return F.array_sort(F.array_distinct(F.transform(F.col(column), lambda x: hash_code(x, buckets))))


def contrast_levels(df: DataFrame, column: str, row_id: str = ROW_ID, max_levels: int = 200) -> list[str]:
    """Levels in order of first appearance; refuses a category too wide for contrast columns."""
    firsts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.min(row_id).alias("f"))
    rows = firsts.orderBy("f").limit(max_levels + 1).collect()
    if len(rows) > max_levels:
        raise ValueError(f"{column} has more than {max_levels} levels; use another encoder")
    return [r[column] for r in rows]


def contrast_columns(column: str, levels: Sequence[str]) -> list[Column]:
    """Backward-difference contrasts: k levels give k - 1 columns; an unseen level gives zeros."""
    k = len(levels)
    out = []
    for j in range(1, k):
        low, high = -(k - j) / k, j / k
        c = F.col(column)
        value = F.when(c.isin(*levels[:j]), F.lit(low)).when(c.isin(*levels[j:]), F.lit(high)).otherwise(F.lit(0.0))
        out.append(value.alias(f"n_{column}__bd_{j}"))
    return out


def encode_by_method(
    df: DataFrame,
    category: str = "freq",
    multi: str = "count",
    row_id: str = ROW_ID,
    scale: Scale = DEFAULT_SCALE,
) -> DataFrame:
    """Replace every category and multi-category column by the chosen method.

    ``category``: fact, freq, bd or ohe (left alone). ``multi``: base, count or freq.
    """
    cats, multis = columns_of(df, CAT), columns_of(df, MULTI)
    if category in ("fact", "freq"):
        enc = CategoryEncoder.fit(df, cats, row_id, scale=scale)
        df = enc.transform(df, code=category == "fact", freq=category == "freq")
        if category == "freq":
            df = df.select(
                *[typed(F.col(f"n_freq__{c}"), c, NUM) if c in cats else F.col(c) for c in df.columns if not c.startswith("n_freq__")]
            )
    elif category == "bd":
        for c in cats:
            levels = contrast_levels(df, c, row_id)
            df = df.select(*[x for x in df.columns if x != c], *contrast_columns(c, levels))
    elif category != "ohe":
        raise ValueError(f"unknown category method {category!r}")
    for m in multis:
        if multi == "base":
            df = df.withColumn(m, first_element(F.col(m)))
        elif multi == "count":
            df = df.withColumn(m, set_size(F.col(m)))
        elif multi == "freq":
            df = multi_frequency(df, m, row_id, scale).drop(m)
        else:
            raise ValueError(f"unknown multi-category method {multi!r}")
    return df


# ------------------------------------------------------------------ grouped statistics


def group_statistics(
    df: DataFrame,
    by: Sequence[str],
    numeric: Sequence[str] = (),
    category: Sequence[str] = (),
    statistics: Sequence[str] = ("mean",),
    scale: Scale = DEFAULT_SCALE,
) -> DataFrame:
    """Attach per-group statistics: row count, numeric statistics, distinct counts of categories."""
    tag = "_".join(by)
    fns = {"mean": F.avg, "sum": F.sum, "std": F.stddev_samp, "min": F.min, "max": F.max}
    aggs: dict[str, Column] = {f"n_count__{tag}": F.count(F.lit(1))}
    for c in numeric:
        for s in statistics:
            aggs[f"n_{s}__{c}__by__{tag}"] = fns[s](c)
    for c in category:
        aggs[f"n_nunique__{c}__by__{tag}"] = F.count_distinct(c)
    return attach_statistics(df, by, aggs, scale)


def pair_frequency(
    df: DataFrame, a: str, b: str, name: str | None = None, scale: Scale = DEFAULT_SCALE
) -> DataFrame:
    """Share of rows with the same pair of category values."""
    total = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).count()
    share = F.count(F.lit(1)) / F.lit(float(max(total, 1)))
    return attach_statistics(df, [a, b], {name or f"n_freq__{a}__{b}": share}, scale)
