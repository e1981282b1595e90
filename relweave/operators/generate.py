"""Feature generation: the default generator, the primitive registry and combinations."""

from __future__ import annotations

import random
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relweave.functions.aggregates import AGGREGATES, average_rank, most_common
from relweave.functions.ordered import Scan, lag, prefix_scan
from relweave.functions.scalars import (
    DATE_PARTS,
    DEFAULT_DATE_PARTS,
    combine_categories,
    date_parts,
    equal_width_bins,
    floor_modulo,
    pair_arithmetic,
    time_bucket,
    time_differences,
)
from relweave.operators.clean import drop_time_columns, replace_sentinel_year
from relweave.operators.encode import (
    CategoryEncoder,
    MultiCategoryEncoder,
    encode_by_method,
    frequency_encode,
    group_statistics,
)
from relweave.operators.sampling import simple_sample
from relweave.schema import CAT, MULTI, NUM, ROW_ID, TIME, columns_of
from relweave.session import DEFAULT_SCALE, Scale, materialize

# Cumulative primitives used by default and how many levels deep.
DEFAULT_CUMULATIVE = ("mean", "sum", "max", "min")
GENERATE_ORDER = 2
PAIR_PICKS = 20


def cumulative_features(
    df: DataFrame,
    columns: Sequence[str],
    order: Sequence[str] = (ROW_ID,),
    primitives: Sequence[str] = DEFAULT_CUMULATIVE,
    levels: int = GENERATE_ORDER,
    scale: Scale = DEFAULT_SCALE,
) -> DataFrame:
    """Running statistics along the row order; each level applies them to the one before."""
    level = list(columns)
    for _ in range(1, levels):
        inputs = {c: F.col(c) for c in level}
        scans = {f"n_cum{p}__{c}": Scan(p, inputs[c]) for p in primitives for c in level}
        if not scans:
            break
        df = prefix_scan(df, order, scans, scale=scale)
        level = list(scans)
    return df


@dataclass
class FeatureGenerator:
    """The default generator: multi-category codes, category codes, frequencies and one-hot
    columns, running statistics, date parts of the time column and day differences.

    ``fit`` learns the encoders; ``transform`` gives one numeric row per input row.
    """

    time_col: str
    row_id: str = ROW_ID
    multi_method: str = "auto"
    one_hot: int = 0
    cumulative: Sequence[str] = DEFAULT_CUMULATIVE
    levels: int = GENERATE_ORDER
    parts: Sequence[str] = DEFAULT_DATE_PARTS
    passthrough: Sequence[str] = ()
    scale: Scale = DEFAULT_SCALE
    categories: CategoryEncoder | None = None
    multis: MultiCategoryEncoder | None = None

    def fit(self, df: DataFrame) -> FeatureGenerator:
        cats = [c for c in columns_of(df, CAT) if c not in self._plain()]
        self.categories = CategoryEncoder.fit(df, cats, self.row_id, self.one_hot, self.scale)
        self.multis = MultiCategoryEncoder.fit(df, columns_of(df, MULTI), self.multi_method)
        self.multi_method = self.multis.method
        return self

    def _plain(self) -> set[str]:
        return {self.row_id, *self.passthrough}

    def transform(self, df: DataFrame) -> DataFrame:
        numeric = [c for c in columns_of(df, NUM) if c not in self._plain()]
        times = [c for c in columns_of(df, TIME) if c not in self._plain()]
        dates = date_parts(self.time_col, self.parts) if self.time_col in df.columns else []
        df = df.select("*", *dates, *time_differences(times)).drop(*times)
        df = self.multis.transform(df)
        df = cumulative_features(df, numeric, (self.row_id,), self.cumulative, self.levels, self.scale)
        return self.categories.transform(df)

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)

    def fit_joint(self, train: DataFrame, other: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Fit and compute on both tables stacked, in the order train then other."""
        both = train.withColumn("__tag", F.lit(0)).unionByName(other.withColumn("__tag", F.lit(1)), True)
        keep = FeatureGenerator(
            self.time_col, "__rid", self.multi_method, self.one_hot, self.cumulative, self.levels,
            self.parts, [*self.passthrough, self.row_id, "__tag"], self.scale,
        )
        stacked = both.withColumn("__rid", F.struct("__tag", self.row_id))
        out = materialize(keep.fit_transform(stacked).drop("__rid"))
        self.categories, self.multis, self.multi_method = keep.categories, keep.multis, keep.multi_method
        return out.filter("__tag = 0").drop("__tag"), out.filter("__tag = 1").drop("__tag")


# --------------------------------------------------------------- primitives by registry


def trend(value: str, time: str) -> Column:
    """Slope of a value over time, per second."""
    seconds = F.unix_micros(F.col(time).cast("timestamp")) / F.lit(1e6)
    return F.regr_slope(F.col(value), seconds)


def last_value(value: str, *order: str) -> Column:
    """Value of the last row along the order."""
    return F.max_by(F.col(value), F.struct(*order))


AGGREGATE_PRIMITIVES = ("std", "min", "max", "mean", "count", "percent_true", "last", "trend", "n_most_common")
TRANSFORM_PRIMITIVES = (
    "percentile", "cum_mean", "cum_min", "cum_max", "cum_sum", "cum_prod", "cum_count",
    "subtract_numeric", "add_numeric", "diff", "absolute", "modulo_numeric", *DATE_PARTS,
)


def aggregate_primitives(
    df: DataFrame, key: str, primitives: Sequence[str], numeric: Sequence[str], category: Sequence[str] = (),
    flags: Sequence[str] = (), order: Sequence[str] = (ROW_ID,), time: str | None = None, top: int = 3,
) -> DataFrame:
    """Aggregate primitives of one entity key: numeric, boolean (flags) and category inputs."""
    aggs: list[Column] = []
    for p in primitives:
        if p in ("std", "min", "max", "mean"):
            aggs += [AGGREGATES[p](F.col(c)).alias(f"n_{p}__{c}") for c in numeric]
        elif p == "count":
            aggs.append(F.count(F.lit(1)).alias(f"n_count__{key}"))
        elif p == "percent_true":
            aggs += [AGGREGATES[p](F.col(c)).alias(f"n_percent_true__{c}") for c in flags]
        elif p == "last":
            aggs += [last_value(c, *order).alias(f"{c[:2]}last__{c}") for c in [*numeric, *category]]
        elif p == "trend":
            aggs += [trend(c, time).alias(f"n_trend__{c}") for c in numeric]
        elif p != "n_most_common":
            raise ValueError(f"unknown aggregate primitive {p!r}")
    rows = df.filter(F.col(key).isNotNull())
    out = rows.groupBy(key).agg(*(aggs or [F.count(F.lit(1)).alias(f"n_count__{key}")]))
    if "n_most_common" in primitives:
        for c in category:
            out = out.join(most_common(rows, key, c, top), key, "left")
    return out


def transform_primitives(
    df: DataFrame,
    primitives: Sequence[str],
    numeric: Sequence[str],
    times: Sequence[str] = (),
    order: Sequence[str] = (ROW_ID,),
    scale: Scale = DEFAULT_SCALE,
) -> DataFrame:
    """Row-level primitives over one table; all running ones share a single scan."""
    unknown = set(primitives) - set(TRANSFORM_PRIMITIVES)
    if unknown:
        raise ValueError(f"unknown transform primitives {sorted(unknown)}")
    scans: dict[str, Scan] = {}
    inputs = {c: F.col(c) for c in numeric}
    for p in primitives:
        if p == "cum_count":
            scans["n_cumcount"] = Scan("index")
        elif p.startswith("cum_"):
            scans |= {f"n_cum{p[4:]}__{c}": Scan(p[4:], inputs[c]) for c in numeric}
    out = prefix_scan(df, order, scans, scale=scale) if scans else df
    if "diff" in primitives:
        out = lag(out, order, {f"__prev_{c}": c for c in numeric}, scale=scale)
        out = out.withColumns({f"n_diff__{c}": F.col(c) - F.col(f"__prev_{c}") for c in numeric})
        out = out.drop(*[f"__prev_{c}" for c in numeric])
    if "percentile" in primitives:
        for c in numeric:
            out = average_rank(out, c, f"n_percentile__{c}", scale)
    pairs = list(combinations(numeric, 2))
    new: list[Column] = []
    for p in primitives:
        if p == "absolute":
            new += [F.abs(c).alias(f"n_abs__{c}") for c in numeric]
        elif p == "add_numeric":
            new += [(F.col(a) + F.col(b)).alias(f"n_add__{a}__{b}") for a, b in pairs]
        elif p == "subtract_numeric":
            new += [(F.col(a) - F.col(b)).alias(f"n_subtract__{a}__{b}") for a, b in pairs]
        elif p == "modulo_numeric":
            new += [floor_modulo(F.col(a), F.col(b)).alias(f"n_modulo__{a}__{b}") for a, b in pairs]
        elif p in DATE_PARTS:
            new += [c for t in times for c in date_parts(t, [p])]
    return out.select("*", *new)


def synthesise(
    df: DataFrame, primitives: Sequence[str], row_id: str = ROW_ID, category: str = "freq", multi: str = "count",
    scale: Scale = DEFAULT_SCALE,
) -> DataFrame:
    """Depth-one synthesis: primitives on the base columns, then category encoding, then the
    sentinel year replaced in year columns."""
    numeric, times = columns_of(df, NUM), columns_of(df, TIME)
    out = transform_primitives(df, primitives, numeric, times, (row_id,), scale)
    out = encode_by_method(out, category, multi, row_id, scale)
    for c in [c for c in out.columns if c.startswith("n_year__")]:
        out = replace_sentinel_year(out, c)
    return out


def baseline(df: DataFrame, category: str = "freq", multi: str = "count", row_id: str = ROW_ID) -> DataFrame:
    """Category encoding only, times dropped."""
    return drop_time_columns(encode_by_method(df, category, multi, row_id))


# ------------------------------------------------------------------------ combinations


def pick_pairs(columns: Sequence[str], n: int = PAIR_PICKS, seed: int = 0) -> tuple[list[str], list[str]]:
    """Two seeded picks of columns, kept so that later tables get the same pairs."""
    rng, n = random.Random(seed), min(n, len(columns))
    ordered = sorted(columns)
    return rng.sample(ordered, n), rng.sample(ordered, n)


def expand_pairs(df: DataFrame, picks: tuple[Sequence[str], Sequence[str]], binned: Sequence[str] = ()) -> DataFrame:
    """Bins of single columns, then the four arithmetic results of every picked pair."""
    if binned:
        df = equal_width_bins(df, binned)
    return df.select("*", *[x for a in picks[0] for b in picks[1] for x in pair_arithmetic(a, b)])


def first_order(
    df: DataFrame,
    entities: Sequence[str],
    numeric: Sequence[str],
    category: Sequence[str] = (),
    statistics: Sequence[str] = ("mean", "sum"),
    scale: Scale = DEFAULT_SCALE,
) -> DataFrame:
    """Entity (user, key, session) by numeric statistics, and entity by category counts."""
    for e in entities:
        df = group_statistics(df, [e], numeric, category, statistics, scale)
        for c in category:
            df = group_statistics(df, [e, c], scale=scale)
    return df


def bucket_statistics(
    df: DataFrame,
    time: str,
    category: str,
    numeric: Sequence[str],
    unit: str = "day",
    statistics: Sequence[str] = ("mean",),
    scale: Scale = DEFAULT_SCALE,
) -> DataFrame:
    """Statistics per (time bucket, category) attached to the rows."""
    bucket = f"t_{unit}__{time}"
    return group_statistics(df.withColumn(bucket, time_bucket(time, unit)), [bucket, category], numeric, (), statistics, scale)


def category_pairs(
    df: DataFrame, categories: Sequence[str], scale: Scale = DEFAULT_SCALE
) -> DataFrame:
    """Frequencies of joint categories, for every pair of the named categories."""
    for a, b in combinations(categories, 2):
        joint = f"c_{a}__x__{b}"
        df = frequency_encode(df.withColumn(joint, combine_categories(a, b)), joint, scale=scale)
    return df


def expand_and_select(
    df: DataFrame,
    expand: Callable[[DataFrame], DataFrame],
    choose: Callable[[DataFrame], Sequence[str]],
    sample_rows: int = 20_000,
    row_id: str = ROW_ID,
    seed: int = 0,
) -> DataFrame:
    """Expand a sample, choose features on it, then build only those on the whole table.

    The full expansion is never computed: projecting to the chosen names lets the optimizer
    prune every other generated column.
    """
    kept = choose(materialize(expand(simple_sample(df, sample_rows, seed, row_id))))
    return expand(df).select(*dict.fromkeys([*df.columns, *kept]))
