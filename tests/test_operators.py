"""Operators on small hand-made tables: nulls, ties, hot keys, missing column types."""

import math
import pathlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from relweave import DatasetConfig, Relation, RelationalDataset, Scale
from relweave.functions import aggregates as A
from relweave.functions import scalars as S
from relweave.functions.lookup import counted, lookup_join, salted, salted_left_join, small_map
from relweave.functions.ordered import key_sizes
from relweave.functions.rolling import rolling
from relweave.functions.selection import quantiles_of
from relweave.operators import clean as C
from relweave.operators import encode as E
from relweave.operators import generate as G
from relweave.operators import sampling as P
from relweave.operators import selection
from relweave.operators.merge import MergeOptions, MergePlan, merge_tables, relation_edges, table_depths, to_many_join, to_one_join
from relweave.operators.skyline import choose_rows, skyline
from relweave.operators.temporal import as_of_join, as_of_joins, bucket_count, rolling_join, window_size
from relweave.plans.ensemble import select_trials
from relweave.schema import columns_of, logical_type


@pytest.fixture(scope="module")
def skewed(spark):
    """Half of the rows share one key; values repeat; some are null."""
    rows = [(i, "hot" if i % 2 else f"k{i % 30}", float(i * 7 % 23) if i % 9 else None, i % 3 == 0) for i in range(400)]
    df = spark.createDataFrame(rows, "row_id long, c_k string, n_v double, f boolean")
    return df.withColumn("label", F.col("f").cast("int")), pd.DataFrame(rows, columns=["row_id", "c_k", "n_v", "f"])


def test_keyed_rolling_frame_of_seven_rows(spark):
    rows = [(i, *r) for i, r in enumerate([("K0", 1, 3), ("K1", 2, 5), ("K1", 3, 2), ("K3", 4, 5), ("K1", 5, 2), ("K1", 6, 3), ("K3", 7, 2)])]
    df = spark.createDataFrame(rows, "id int, key string, A int, B int")
    out = rolling(df, ["id"], 3, {"a": ("sum", "A"), "b": ("sum", "B")}, ["key"]).orderBy("id").collect()
    assert [(r.a, r.b) for r in out] == [(None, None)] * 4 + [(10.0, 9.0), (14.0, 7.0), (None, None)]


def test_bundle_with_hot_key_equals_pandas(skewed, tiny):
    df, pdf = skewed
    got = A.aggregate_by_key(df, "c_k", ["n_v"], scale=tiny).toPandas().set_index("c_k").sort_index()
    g = pdf.groupby("c_k").n_v
    assert got["n_median__n_v"].tolist() == g.median().tolist()
    assert got["n_sum__n_v"].tolist() == g.sum().tolist()
    assert got["n_std__n_v"].round(9).tolist() == g.std().round(9).tolist()
    assert got["n_count__c_k"].tolist() == pdf.groupby("c_k").size().tolist()


def test_empty_sum_is_zero_and_single_deviation_is_null(spark):
    df = spark.createDataFrame([("a", None), ("b", 2.0), (None, 1.0)], "c_k string, n_v double")
    rows = {r.c_k: r for r in A.aggregate_by_key(df, "c_k").collect()}
    assert set(rows) == {"a", "b"}
    assert rows["a"]["n_sum__n_v"] == 0.0 and rows["a"]["n_mean__n_v"] is None
    assert rows["b"]["n_std__n_v"] is None and rows["b"]["n_median__n_v"] == 2.0


def test_time_and_sets_are_not_aggregated():
    for kind in ("time", "multi-cat", None):
        with pytest.raises(ValueError):
            A.statistics_for(kind)


def test_quantiles_equal_numpy(skewed, tiny):
    df, pdf = skewed
    got = A.quantiles(df, "n_v", {"a": 0.25, "b": 0.75}, scale=tiny).first()
    assert (got.a, got.b) == tuple(pdf.n_v.quantile([0.25, 0.75]))
    by = A.quantiles(df, "n_v", {"a": 0.3}, ["c_k"], tiny).toPandas().set_index("c_k").a.sort_index()
    want = pdf.groupby("c_k").n_v.quantile(0.3).sort_index()
    assert by.round(9).tolist() == want.round(9).tolist()


def test_quantiles_by_narrowing(spark):
    rows = [(None if i % 50 == 0 else 3.0 if i % 3 else math.tan(i), float(i) ** 7 * (-1) ** i, None, float("nan") if i % 2 else 1.0) for i in range(3_000)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(5)
    shares = [0.0, 0.1, 0.333, 0.5, 0.75, 1.0]
    got = quantiles_of(df, {c: shares for c in "abcd"}, few=3)  # several rounds
    for i, c in enumerate("ab"):
        values = [r[i] for r in rows if r[i] is not None]
        assert got[c] == pytest.approx(np.quantile(values, shares).tolist(), rel=1e-12)
    assert got["c"] == [None] * 6 and got["d"][:3] == [1.0] * 3 and math.isnan(got["d"][4])
    assert quantiles_of(df.limit(0), {"a": [0.5]}) == {"a": [None]} and quantiles_of(df, {}) == {}


def test_lookup_join_spreads_equal_rows_and_null_keys(spark, tiny):
    rows = [("hot", 1)] * 2_000 + [(None, 2)] * 500 + [(f"k{i % 90}", i) for i in range(900)]
    df = spark.createDataFrame(rows, "c_k string, x int").repartition(8)
    table = df.filter("c_k is not null").groupBy("c_k").agg(F.max("x").alias("hi"), F.count("*").alias("n"))
    want = sorted(df.join(table.drop("n"), "c_k", "left").select("c_k", "x", "hi").collect(), key=str)
    for weight, known in (("n", table), (None, table.drop("n"))):
        got = lookup_join(df, known, ["c_k"], weight=weight, scale=tiny)
        assert sorted(got.collect(), key=str) == want
    sizes = key_sizes(df, ["c_k"], tiny)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # it would put these few rows into one task
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        dealt = salted(df, table.drop("n"), ["c_k"], sizes.counted, 4, tiny)
        places = dealt.filter("c_k = 'hot' or c_k is null").select("c_k", F.spark_partition_id().alias("p")).distinct()
        places = {r["c_k"]: r["count"] for r in places.groupBy("c_k").count().collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert set(places) == {"hot", None} and min(places.values()) > 1
    wide = spark.createDataFrame([(f"k{i}", "x" * 1_000) for i in range(5)], "c_k string, s string")
    assert counted(wide)[0] == 5 and 5_000 < counted(wide)[1] < 6_000
    small = Scale(broadcast_bytes=1_000)
    plan = lookup_join(df, wide, ["c_k"], scale=small)._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" not in plan and "__salt" in plan


def test_modes_take_the_smallest_on_ties(spark):
    df = spark.createDataFrame([("b", "x"), ("a", "x"), ("a", "y"), ("b", None)], "c_1 string, c_2 string")
    assert A.modes(df, ["c_1", "c_2"]) == {"c_1": "a", "c_2": "x"}
    assert A.mode_of(df, "c_1").first()[0] == "a"


def test_average_rank_and_auc_with_ties(spark):
    df = spark.createDataFrame([(1, 0.1, 0), (2, 0.5, 1), (3, 0.5, 0), (4, 0.9, 1)], "row_id long, s double, label int")
    ranks = {r.row_id: r.r for r in A.average_rank(df, "s", "r").collect()}
    assert ranks == {1: 0.25, 2: 0.625, 3: 0.625, 4: 1.0}
    assert A.roc_auc(df, "s", "label").first().auc == 3.5 / 4
    assert A.roc_auc(df.filter("label = 1"), "s", "label").first().auc is None


def test_correlation_of_a_constant_is_zero(spark):
    df = spark.createDataFrame([(1.0, 5.0, 0), (2.0, 5.0, 1), (4.0, 5.0, 1)], "n_a double, n_b double, label int")
    got = {r.feature: r.score for r in A.label_correlations(df, ["n_a", "n_b"], "label").collect()}
    assert got["n_b"] == 0.0 and math.isclose(got["n_a"], 0.755928946, rel_tol=1e-8)


def test_scalar_edges(spark):
    df = spark.createDataFrame([(5.0, -3.0, "a,b", "b"), (-5.0, 3.0, None, "z"), (2.0, 0.0, "7", "7")], "n_a double, n_b double, m string, c string")
    m = S.split_set(F.col("m"))
    rows = df.select(
        S.floor_modulo(F.col("n_a"), F.col("n_b")).alias("mod"), S.set_size(m).alias("size"),
        S.position_in_set(F.col("c"), m).alias("at"), S.first_element(m).alias("base"),
    ).collect()
    assert [r.mod for r in rows] == [-1.0, 1.0, None]
    assert [r["size"] for r in rows] == [2, 1, 1]
    assert [r["at"] for r in rows] == [2, 0, 1]
    assert [r.base for r in rows] == [None, -1, 7]
    flat = spark.createDataFrame([(3.5,), (3.5,)], "n_x double")
    assert S.equal_width_bins(flat, ["n_x"]).first()[1] == 3.0 + math.floor(0.5 / 0.05) * 0.05
    assert S.standardise(flat, ["n_x"]).first()[1] == 0.0


def test_lookup_join_splits_heavy_values(skewed, tiny):
    df, pdf = skewed
    table = df.groupBy("c_k").agg(F.count("*").alias("n"), F.max("row_id").alias("hi"))
    got = lookup_join(df, table, ["c_k"], weight="n", scale=tiny).toPandas()
    want = pdf.groupby("c_k").row_id.transform("max")
    assert got.sort_values("row_id").hi.tolist() == want.tolist()


def test_salted_join_equals_plain_join(skewed, tiny):
    df, _ = skewed
    left = df.withColumn("c_k", F.when(F.col("row_id") % 4 != 0, F.col("c_k")))
    right = df.groupBy("c_k").agg(F.max("n_v").alias("hi")).filter("c_k != 'k2'")
    twice = right.unionByName(right.withColumn("hi", F.col("hi") + 1))
    for table in (right, twice):
        a = salted_left_join(left, table, "c_k", scale=tiny).orderBy("row_id", "hi")
        b = left.join(table, "c_k", "left").orderBy("row_id", "hi")
        assert a.select(*b.columns).collect() == b.collect()
    only_null = left.filter("c_k is null")
    assert salted_left_join(only_null, right, "c_k", scale=tiny).filter("hi is null").count() == 100


def test_expand_and_select_equals_the_full_expansion(skewed):
    df = skewed[0].select("row_id", "label", (F.col("row_id") % 7).cast("double").alias("n_a"), F.col("row_id").cast("double").alias("n_b"))
    picks = G.pick_pairs(["n_a", "n_b"])
    got = G.expand_and_select(df, lambda d: G.expand_pairs(d, picks), lambda s: ["n_a_plus_n_b"], sample_rows=50)
    assert got.columns == [*df.columns, "n_a_plus_n_b"]
    assert got.filter("n_a_plus_n_b != n_a + n_b").count() == 0 and got.count() == 400


def test_hash_codes_are_in_range_and_stable(skewed):
    codes = skewed[0].select("c_k", E.hash_code("c_k", 8).alias("h")).distinct().collect()
    assert {r.h for r in codes} <= set(range(8)) and len(codes) == len({r.c_k for r in codes})


def test_small_map_takes_any_string(spark):
    odd = ['"', "\\", "a,b", "", "naïve", "\n"]
    pairs = spark.createDataFrame(list(enumerate(odd)), "v int, k string")
    from pyspark.sql.types import IntegerType

    known = small_map(pairs, "k", "v", IntegerType())
    assert [r[0] for r in pairs.orderBy("v").select(known.get(F.col("k"))).collect()] == list(range(6))


# --------------------------------------------------------------------------------- clean


def test_cleaner_on_missing_types(spark):
    only_numbers = spark.createDataFrame([(1.0,), (None,), (3.0,)], "n_x double")
    assert [r[0] for r in C.Cleaner.fit(only_numbers).transform(only_numbers).collect()] == [1.0, 2.0, 3.0]
    empty = spark.createDataFrame([], "n_x double, c_y string, m_z array<string>, t_01 timestamp")
    assert C.Cleaner.fit(empty).transform(empty).count() == 0


def test_all_null_column_is_dropped_and_fills_carry_over(spark):
    df = spark.createDataFrame([(None, "a", 1.0), (None, "a", 3.0), (None, "b", None)], "n_gone double, c_k string, n_x double")
    cleaner = C.Cleaner.fit(df)
    cleaner.fit_missing_modes(df)
    later = spark.createDataFrame([(9.0, None, None)], df.schema)
    assert cleaner.dropped == ["n_gone"]
    assert cleaner.transform(later).first().asDict() == {"c_k": "a", "n_x": 2.0}


def test_narrowing_is_lossless(spark):
    df = spark.createDataFrame([(1.0, 300.0, 0.1, 0.5), (None, 2.0, 2.0, 4.0)], "n_a double, n_b double, n_c double, n_d double")
    out = C.narrow_numbers(df)
    assert [t for _, t in out.dtypes] == ["tinyint", "smallint", "double", "float"]


def test_metadata_carries_the_logical_type(spark):
    v = spark.createDataFrame([("a", 1.0)], "c_k string, n_x double")
    out = to_one_join(v.select("c_k"), v, "t", "c_k")
    assert logical_type(out.schema["n_t__n_x"]) == "num" and columns_of(out, "cat") == ["c_k"]


# --------------------------------------------------------------------------------- merge


def _dataset(spark, with_time=False):
    main = spark.createDataFrame([(1, "a", 10), (2, "b", 20), (3, None, 30)], "row_id long, c_k string, t long")
    main = main.select("row_id", "c_k", F.timestamp_seconds("t").alias("t_01"))
    one = spark.createDataFrame([("a", "x", 1.0), ("b", "y", 2.0)], "c_k string, c_j string, n_p double")
    many = spark.createDataFrame([("x", 1.0, 5), ("x", 3.0, 15), ("y", 7.0, 25)], "c_j string, n_q double, t long")
    many = many.select("c_j", "n_q", F.timestamp_seconds("t").alias("t_01")) if with_time else many.drop("t")
    relations = (Relation("main", "one", "c_k", "many_to_one"), Relation("one", "many", "c_j", "one_to_many"))
    return RelationalDataset({"main": main, "one": one, "many": many}, DatasetConfig({}, relations, "t_01"))


def test_graph_has_both_directions_and_depths(spark):
    edges = relation_edges(_dataset(spark).config.relations)
    assert [(e.to, e.to_many) for e in edges["one"]] == [("main", True), ("many", True)]
    assert table_depths(edges) == {"main": 0, "one": 1, "many": 2}


def test_merge_keeps_rows_and_null_keys(spark):
    out = merge_tables(_dataset(spark)).orderBy("row_id").collect()
    assert [r["n_one__n_many__n_mean__n_q"] for r in out] == [2.0, 7.0, None]


def test_timed_table_is_not_joined_into_untimed(spark):
    out = merge_tables(_dataset(spark, with_time=True))
    assert not [c for c in out.columns if "n_q" in c]


def test_repeated_key_fans_out_or_fails(spark):
    u = spark.createDataFrame([("a",)], "c_k string")
    v = spark.createDataFrame([("a", 1.0), ("a", 2.0)], "c_k string, n_x double")
    assert to_one_join(u, v, "t", "c_k", "keep").count() == 2
    with pytest.raises(ValueError):
        to_one_join(u, v, "t", "c_k")
    bad = RelationalDataset({"main": u.withColumn("row_id", F.lit(1)), "t": v}, DatasetConfig({}, (Relation("main", "t", "c_k", "many_to_one"),), "t_01"))
    with pytest.raises(ValueError, match="t.c_k"):
        merge_tables(bad)
    assert merge_tables(bad, MergeOptions(duplicates="keep")).count() == 2
    assert to_many_join(u, v, "t", "c_k").count() == 1
    assert to_many_join(u, v.limit(0), "t", "c_k").first()["n_t__n_mean__n_x"] is None


def test_as_of_join_with_hot_key_null_key_and_ties(spark, tiny):
    u = spark.createDataFrame([(i, "hot" if i % 5 else None, i) for i in range(200)], "row_id long, c_k string, t long")
    v = spark.createDataFrame([(i, "hot", i // 2 * 2, float(i)) for i in range(0, 200, 3)], "vid long, c_k string, t long, n_x double")
    u = u.withColumn("t_01", F.timestamp_seconds("t")).drop("t")
    v = v.withColumn("t_01", F.timestamp_seconds("t")).drop("t")
    got = as_of_join(u, v, "v", "c_k", "t_01", v_order=["vid"], scale=tiny).toPandas()
    vp = v.toPandas()
    assert len(got) == 200
    for r in got.itertuples():
        earlier = vp[vp.t_01 < r.t_01].sort_values(["t_01", "vid"]) if r.c_k else vp[:0]
        want = earlier.n_x.iloc[-1] if len(earlier) else None
        assert (pd.isna(r.n_v__n_x) and want is None) or r.n_v__n_x == want


def test_rolling_join_same_with_and_without_splitting(spark, tiny):
    rows = [(i, "hot" if i % 3 else f"k{i % 7}", i * 37 % 400, float(i % 11)) for i in range(300)]
    e = spark.createDataFrame(rows, "row_id long, c_k string, t long, n_x double").withColumn("t_01", F.timestamp_seconds("t")).drop("t")
    u, v = e.filter("row_id % 2 = 0").select("row_id", "c_k", "t_01"), e.filter("row_id % 2 = 1")
    for scope in ("stream", "key", "bucket"):
        kw = {"window": 6, "scope": scope, "min_periods": 1, "v_order": ["row_id"], "buckets": 3}
        a = rolling_join(u, v, "v", "c_k", "t_01", scale=tiny, **kw).toPandas().sort_values("row_id")
        b = rolling_join(u, v, "v", "c_k", "t_01", **kw).toPandas().sort_values("row_id")
        pd.testing.assert_frame_equal(a.reset_index(drop=True), b.reset_index(drop=True))
        assert len(a) == 150


def _timed(spark, n, tables):
    rows = [(i, None if i % 11 == 0 else f"k{i % 4}", None if i % 17 == 0 else i * 29 % 97, float(i)) for i in range(n)]
    e = spark.createDataFrame(rows, "row_id long, c_k string, t long, n_x double").withColumn("t_01", F.timestamp_seconds("t")).drop("t")
    return e.filter("row_id % 5 = 0").drop("n_x"), {f"s{j}": e.filter(F.col("row_id") % 5 == j + 1) for j in range(tables)}


def test_several_as_of_joins_equal_one_by_one(spark, tiny):
    u, sides = _timed(spark, 400, 3)
    orders = {s: ["row_id"] for s in sides}
    for kw in ({}, {"allow_exact": True}, {"tolerance_seconds": 3.0}):
        got = as_of_joins(u, sides, "c_k", "t_01", orders=orders, scale=tiny, **kw)
        want = u
        for s, v in sides.items():
            want = as_of_join(want, v, s, "c_k", "t_01", v_order=["row_id"], **kw)
        assert got.columns == want.columns and sorted(got.collect(), key=str) == sorted(want.collect(), key=str)


def _exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_several_timed_sides_share_one_timeline(spark):
    def merged(n):
        u, sides = _timed(spark, 200, n)
        relations = tuple(Relation("main", s, "c_k", "one_to_many") for s in sides)
        return merge_tables(RelationalDataset({"main": u, **sides}, DatasetConfig({}, relations, "t_01")))

    one, three = merged(1), merged(3)
    assert _exchanges(one) == _exchanges(three) and three.count() == 40
    assert [c for c in three.columns if c.startswith("n_")] == ["n_s0__n_x", "n_s1__n_x", "n_s2__n_x"]


def test_fitted_merge_reads_no_side_table_again(spark, tmp_path):
    main = spark.createDataFrame([(i, f"k{i % 5}", f"j{i % 3}") for i in range(40)], "row_id long, c_k string, c_j string")
    one = spark.createDataFrame([(f"k{i}", f"r{i % 2}", float(i)) for i in range(5)], "c_k string, c_r string, n_a double")
    two = spark.createDataFrame([(f"j{i % 3}", f"r{i % 2}", float(i)) for i in range(30)], "c_j string, c_r string, n_b double")
    low = spark.createDataFrame([("r0", 1.0), ("r1", 2.0)], "c_r string, n_c double")
    relations = (
        Relation("main", "one", "c_k", "many_to_one"), Relation("main", "two", "c_j", "one_to_many"),
        Relation("one", "low", "c_r", "many_to_one"), Relation("two", "low", "c_r", "many_to_one"),
    )
    data = RelationalDataset({"main": main, "one": one, "two": two, "low": low}, DatasetConfig({}, relations, "t_01"))
    plan = MergePlan.fit(data)
    got, want = plan.join(main), merge_tables(data)
    assert got.columns == want.columns and sorted(got.collect()) == sorted(want.collect())
    text = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in text and "LogicalRDD" in text  # main alone is read from where it was
    files = [f for df in plan.written for f in df.inputFiles()]
    plan.drop()
    assert files and not [f for f in files if pathlib.Path(f.removeprefix("file:").replace("//", "/")).exists()] and plan.sides == []


def test_skyline_of_three_objectives(spark, tiny, monkeypatch):
    rng = np.random.default_rng(8)
    pts = [(i, *map(float, p)) for i, p in enumerate(rng.integers(0, 9, size=(300, 3)))]
    pts += [(300 + i, float(i), float(40 - i), 3.0) for i in range(41)]  # many that do not dominate each other
    pts += [(400, None, 0.0, 0.0), (401, float("nan"), -1.0, 0.0), (402, -0.0, 9.0, 9.0), (403, 0.0, 9.0, 9.0)]
    df = spark.createDataFrame(pts, "i int, a double, b double, c double")
    worst = {i: tuple(math.inf if x != x else x for x in p) for i, *p in pts if None not in p}
    want = sorted(i for i, p in worst.items() if not any(all(x <= y for x, y in zip(o, p)) and o != p for o in worst.values()))
    assert sorted(r["i"] for r in skyline(df, ["a", "b", "c"]).collect()) == want
    monkeypatch.setattr("relweave.operators.skyline._TILE", 7)
    monkeypatch.setattr("relweave.operators.skyline._STRONG", 1)
    assert sorted(r["i"] for r in skyline(df, ["a", "b", "c"], tiny).collect()) == want
    assert skyline(df.limit(0), ["a", "b"]).count() == 0


def test_choice_by_fronts_equals_the_one_of_trials(spark):
    rows = [(0, -0.9, -0.01), (1, -0.8, -0.05), (2, -0.7, -0.02), (3, -0.85, -0.03), (4, -0.6, -0.06), (5, -0.5, -0.01)]
    s = spark.createDataFrame(rows, "trial int, loss double, agreement double")
    for k in (2, 3, 5):
        got = [r["trial"] for r in choose_rows(s, k, ["loss", "agreement"], "trial").orderBy("place").collect()]
        assert got == select_trials(s, k)


def test_large_categories_share_one_join(spark):
    rows = [(i, f"a{i % 90}" if i % 8 else None, "hot" if i % 3 else f"b{i % 70}", f"c{i % 4}") for i in range(600)]
    df = spark.createDataFrame(rows + rows[:1], "row_id long, c_a string, c_b string, c_c string").repartition(5)
    later = spark.createDataFrame([(9, "new", None, "c1"), (9, "a1", "b0", None)], df.schema)
    split = Scale(block_rows=40, oversample=8, broadcast_rows=10)
    one, two = (E.CategoryEncoder.fit(df, ["c_a", "c_b", "c_c"], one_hot=2, scale=s) for s in (Scale(), split))
    assert one.small == {"c_a", "c_b", "c_c"} and two.small == {"c_c"} and one.top == two.top
    for rows in (df, later, df.limit(0)):
        a, b = one.transform(rows), two.transform(rows)
        assert a.columns == b.columns and sorted(a.collect()) == sorted(b.collect())
    plan = two.transform(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "__salt" in plan and plan.count("explode(array(struct(__i") == 1  # one join for both large columns


def test_window_and_bucket_rules():
    assert (window_size(1000), window_size(1_000_000)) == (5, 100)
    assert (bucket_count(30_000), bucket_count(5_000), bucket_count(10)) == (200, 50, 1)


def test_merge_options_for_timed_tables(spark):
    main = spark.createDataFrame([(i, "a", i) for i in range(10)], "row_id long, c_k string, t long").withColumn("t_01", F.timestamp_seconds("t")).drop("t")
    side = spark.createDataFrame([("a", i + 1, float(i)) for i in range(0, 10, 2)], "c_k string, t long, n_x double").withColumn("t_01", F.timestamp_seconds("t")).drop("t")
    data = RelationalDataset({"main": main, "side": side}, DatasetConfig({}, (Relation("main", "side", "c_k", "one_to_many"),), "t_01"))
    assert "n_side__n_x" in merge_tables(data).columns
    for scope in ("rolling_stream", "rolling_key", "rolling_bucket"):
        out = merge_tables(data, MergeOptions(temporal=scope))
        assert out.count() == 10 and "n_mean_rolling__side__n_x" in out.columns


# ------------------------------------------------------------------------------ encoders


def test_codes_are_stable_and_unseen_is_minus_one(spark, tiny):
    train = spark.createDataFrame([(0, "b"), (1, "a"), (2, "b"), (3, None)], "row_id long, c_x string")
    enc = E.CategoryEncoder.fit(train, ["c_x"], one_hot=1, scale=tiny)
    test = spark.createDataFrame([(9, "a"), (8, "new")], train.schema)
    got = {r.row_id: (r.c_x, r["n_freq__c_x"], r["c_c_x__dummy_1"], r["c_c_x__dummy_rest"]) for r in enc.transform(test).collect()}
    assert got == {9: (1, 1 / 3, 0, 1), 8: (-1, 0.0, 0, 1)}
    assert [r.c_x for r in enc.transform(train).orderBy("row_id").collect()] == [0, 1, 0, -1]


def test_multi_code_caps_ranks(spark):
    df = spark.createDataFrame([(0, ["a", "b"]), (1, ["b", "c"]), (2, ["d"]), (3, None)], "row_id long, m_x array<string>")
    enc = E.MultiCategoryEncoder.fit(df, ["m_x"], "code", cap=2)
    assert [r[1] for r in enc.transform(df).orderBy("row_id").collect()] == [0, 0, 2, 1]
    assert E.MultiCategoryEncoder.fit(df, ["m_x"], "auto").method == "code"


def test_target_mean_sees_only_earlier_rows(skewed, tiny):
    df, pdf = skewed
    got = E.target_mean_expanding(df, "c_k", ["row_id"], scale=tiny, name="m").toPandas().sort_values("row_id")
    y = pdf.f.astype(float)
    want = y.groupby(pdf.c_k).transform(lambda s: s.shift(1).expanding().mean())
    assert got.m.round(9).fillna(-1).tolist() == want.round(9).fillna(-1).tolist()


def test_contrast_columns_sum_to_zero_over_levels(spark):
    df = spark.createDataFrame([(0, "x"), (1, "y"), (2, "z")], "row_id long, c_a string")
    levels = E.contrast_levels(df, "c_a")
    rows = df.select(*E.contrast_columns("c_a", levels)).collect()
    assert all(abs(sum(r[i] for r in rows)) < 1e-12 for i in range(2)) and rows[0][0] == -2 / 3
    with pytest.raises(ValueError):
        E.contrast_levels(df, "c_a", max_levels=2)


def test_generator_with_missing_types(spark):
    for schema in ("row_id long, n_a double", "row_id long, c_a string", "row_id long, t_01 timestamp", "row_id long"):
        df = spark.createDataFrame([], schema)
        assert G.FeatureGenerator("t_01").fit_transform(df).count() == 0
    two = spark.createDataFrame([(i, float(i), "x", ["p", "q"]) for i in range(5)], "row_id long, n_a double, c_a string, m_a array<string>")
    gen = G.FeatureGenerator("t_01").fit(two)
    assert gen.transform(two).count() == 5
    pd.testing.assert_frame_equal(gen.transform(two).toPandas(), G.FeatureGenerator("t_01").fit_transform(two).toPandas())


def test_second_level_of_running_values(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(4)], "row_id long, n_a double")
    out = G.cumulative_features(df, ["n_a"], primitives=("sum",), levels=3).orderBy("row_id").collect()
    assert [r["n_cumsum__n_cumsum__n_a"] for r in out] == [0.0, 1.0, 4.0, 10.0]


# ------------------------------------------------------------------------------ sampling


def test_samples_have_exact_sizes_and_do_not_move(skewed):
    df, _ = skewed
    a = sorted(r.row_id for r in P.simple_sample(df, 37, seed=5).collect())
    b = sorted(r.row_id for r in P.simple_sample(df.repartition(7), 37, seed=5).collect())
    assert len(a) == 37 and a == b
    assert P.simple_sample(df, 10_000).count() == 400
    assert P.stratified_sample(df, 100).groupBy("label").count().orderBy("label").collect()[1][1] == math.ceil(134 * 100 / 400)


def test_sampling_through_several_hash_levels(skewed, monkeypatch):
    monkeypatch.setattr(P, "_FEW", 3)
    monkeypatch.setattr(P, "_DIGITS", 1)
    assert P.simple_sample(skewed[0], 123).count() == 123


def test_folds_are_balanced(skewed):
    sizes = P.folds(skewed[0]).groupBy("fold", "label").count().collect()
    for label, n in ((0, 266), (1, 134)):
        assert {r["count"] for r in sizes if r.label == label} <= {n // 5, n // 5 + 1}


def test_permutation_keeps_the_label_counts(skewed, tiny):
    out = P.permute_label(skewed[0], scale=tiny)
    assert out.count() == 400 and out.agg(F.sum("permuted")).first()[0] == 134


def test_every_row_is_a_donor_once(spark):
    rows = [(i % 5 if i % 7 else None, float(i) if i % 3 else None, i) for i in range(60)] + [(1, 2.0, 60)] * 2
    df = spark.createDataFrame(rows, "row_id long, x double, n long")
    for some in (df, df.limit(1), df.limit(0)):
        out = selection.shuffle_rows(some, ["x", "n"]).collect()
        have = sorted(some.collect(), key=repr)
        assert sorted([r[:3] for r in out], key=repr) == [tuple(r) for r in have]
        assert sorted([tuple(r["__donor"]) for r in out], key=repr) == sorted([tuple(r)[1:] for r in have], key=repr)
    out = selection.shuffle_rows(df, ["x", "n"]).collect()
    assert sum(r["__donor"]["n"] == r["n"] for r in out) <= 2  # the two equal rows may be each other's


def test_weighted_sample_prefers_heavy_rows(spark):
    df = spark.range(2000).select(F.col("id").alias("row_id"), F.when(F.col("id") < 1000, 9.0).otherwise(1.0).alias("weight"))
    heavy = P.weighted_sample(df, 500).filter("row_id < 1000").count()
    assert 400 < heavy < 490
    assert P.weighted_sample(df.withColumn("weight", F.when(F.col("row_id") < 10, 1.0).otherwise(0.0)), 50).count() == 10


def test_up_balancing_repeats_the_minority(skewed):
    out = P.balance_up(skewed[0])
    assert out.count() == 200 and out.filter("label = 1").count() > 70


def test_exact_samples_of_repeated_and_null_ids(spark):
    tens = spark.range(1_000).select((F.col("id") % 100).alias("row_id"), F.col("id").alias("x"))
    assert P.simple_sample(tens, 105).count() == 105
    one = spark.range(30_000).select(F.lit(7).cast("bigint").alias("row_id"), F.col("id").alias("x"))
    assert P.simple_sample(one, 10).count() == 10
    none = spark.range(50).select(F.lit(None).cast("bigint").alias("row_id"), F.col("id").alias("x"))
    assert P.simple_sample(none, 10).count() == 10
