"""Samples and splits of exact size, whatever the ids and the partitioning."""

from __future__ import annotations

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from relweave.functions.aggregates import class_counts
from relweave.operators import cells as C
from relweave.operators import sampling as P
from relweave.operators import selection as L

#: How 900 rows get their ids: each its own, ten rows each, one for all, none, or a mix.
IDS = {
    "own": lambda i: i,
    "tenfold": lambda i: i // 10,
    "equal": lambda i: 7,
    "null": lambda i: None,
    "mixed": lambda i: None if i % 3 == 0 else i // 4,
}
#: What tells rows of one id apart: nothing, or a value (null in places), for all or some.
VALUES = {"same": lambda i: "x", "other": lambda i: None if i % 13 == 0 else f"v{i}", "pairs": lambda i: f"v{i // 90}"}
SCHEMA = "row_id long, label int, value string, parts array<int>"


def table(spark, ids, values, partitions=3):
    rows = [(IDS[ids](i), int(i % 5 == 0), VALUES[values](i), [None, 1] if i % 2 else [1, None]) for i in range(900)]
    return spark.createDataFrame(rows, SCHEMA).repartition(partitions)


def bag(df):
    return collections.Counter(str(r) for r in df.collect())


def classes(df, by="label"):
    return {r[by]: r["count"] for r in df.groupBy(by).count().collect()}


#: Every sampling step with the rows per class (0, 1) that it has to return from 720 and 180.
SAMPLES = {
    "simple": (lambda d: P.simple_sample(d, 333), 333),
    "cap": (lambda d: P.cap_rows(d, 100), 100),
    "balanced": (lambda d: P.balanced_sample(d, 123), 123),
    "stratified": (lambda d: P.stratified_sample(d, 211), {0: 168, 1: 43}),
    "down": (lambda d: P.down_sample(d, 0.3), {0: 216, 1: 54}),
    "balance_down": (lambda d: P.balance_down(d), {0: 216, 1: 180}),
    "balance_up": (lambda d: P.balance_up(d), 450),
}


CASES = [(n, i, v) for n in sorted(SAMPLES) for i, v in (("tenfold", "same"), ("mixed", "other"))]
CASES += [("simple", "equal", "pairs"), ("stratified", "null", "pairs"), ("balance_up", "equal", "other"), ("down", "own", "same")]


@pytest.mark.parametrize("name,ids,values", CASES)
def test_samples_are_exact_and_do_not_depend_on_partitioning(spark, name, ids, values):
    fn, size = SAMPLES[name]
    whole = table(spark, ids, values)
    got = fn(whole)
    assert (got.count() if isinstance(size, int) else classes(got)) == size
    first = bag(got)
    assert first == bag(fn(table(spark, ids, values, 7)))
    if name != "balance_up":
        assert not first - bag(whole)  # no row more often than it is there


@pytest.mark.parametrize("ids,values", [("tenfold", "same"), ("equal", "pairs"), ("mixed", "other")])
def test_splits_are_exact_and_whole(spark, ids, values):
    whole = table(spark, ids, values)
    for label, share, want in (("label", 0.2, {0: 144, 1: 36}), (None, 0.1, 90)):
        marked = P.split(whole, share, label)
        valid = marked.filter("is_valid")
        assert (valid.count() if label is None else classes(valid)) == want
        assert bag(marked.drop("is_valid")) == bag(whole)
        assert bag(marked) == bag(P.split(table(spark, ids, values, 5), share, label))
    parts = P.double_holdout(whole, rows=50)
    assert classes(parts, "part") == {"holdout": 50, "valid": 170, "train": 680}
    assert bag(parts.drop("part")) == bag(whole)
    assert bag(parts) == bag(P.double_holdout(table(spark, ids, values, 5), rows=50))


def test_rows_that_differ_have_other_contents(spark):
    rows = [(1, None, None, [None, 1]), (1, None, None, [1, None]), (None, 1, None, [1]), (1, None, "1", None), (1, None, "", None), (1, None, None, [])]
    df = spark.createDataFrame(rows, "a int, b int, c string, d array<int>")
    assert df.select(P.contents(df)).distinct().count() == len(rows)


def test_samples_of_few_and_no_rows(spark):
    whole = table(spark, "mixed", "other")
    assert P.simple_sample(whole, 5_000).count() == P.stratified_sample(whole, 900).count() == 900
    none = whole.limit(0)
    assert P.simple_sample(none, 5).count() == P.simple_sample(whole, 0).count() == P.split(none).count() == 0
    unlabelled = whole.withColumn("label", F.when(F.col("row_id") % 2 == 0, F.col("label")))
    marked = P.split(unlabelled, 0.5)
    for r in marked.groupBy("label").agg(F.count_if("is_valid").alias("v"), F.count(F.lit(1)).alias("n")).collect():
        assert r["v"] == round(r["n"] * 0.5)


def test_weights_steer_a_sample(spark):
    rows = [(i, 0, "x", None, float(i % 10)) for i in range(20_000)]
    df = spark.createDataFrame(rows, SCHEMA + ", weight double")
    got = {r["w"]: r["n"] for r in P.weighted_sample(df, 2_000).groupBy(F.col("weight").alias("w")).agg(F.count(F.lit(1)).alias("n")).collect()}
    assert 0.0 not in got and sum(got.values()) == 2_000 and 5 < got[9.0] / got[1.0] < 14


def test_classes_are_dealt_out_anew_without_moving_rows(spark):
    df = spark.range(3000).select(F.lit(None).cast("long").alias("row_id"), (F.col("id") % 7).alias("at"), "id")
    df = df.withColumn("label", F.when(F.col("id") < 500, "b").when(F.col("id") < 2999, "a"))  # one row has no class
    sizes = class_counts(df)
    out = df.withColumn("y", P.permute_classes(df, sizes, seed="x", row_id=("row_id", "id")))
    assert class_counts(out, "y") == sizes  # ids alike are told apart by the second column
    both = out.filter("label = 'b' and y = 'b'").count()
    assert 45 < both < 125  # 83 expected
    other = df.withColumn("y", P.permute_classes(df, sizes, seed="z", row_id=("row_id", "id")))
    assert out.join(other.select("id", F.col("y").alias("y2")), "id").filter("not y <=> y2").count() > 400
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_nth_numbers_narrow_to_the_rank(spark, monkeypatch):
    monkeypatch.setattr(P, "_FEW", 3)
    values = sorted([(i * 2654435761 * 40503) % 2**64 - 2**63 for i in range(500)] + [7] * 20)
    df = spark.createDataFrame([(v,) for v in reversed(values)], "h long")
    ranks = [1, 2, 250, values.index(7) + 1, values.index(7) + 20, 519, 520]
    assert P.nth_numbers(df, F.col("h"), ranks) == [values[r - 1] for r in ranks]
    assert P.nth_numbers(df, F.col("h"), []) == []


def test_nth_counts_all_rows_without_sorting_them(spark, monkeypatch):
    df = spark.range(5000).select(F.col("id").alias("row_id"))
    plans = []
    collect = type(df).collect
    monkeypatch.setattr(type(df), "collect", lambda d: plans.append(d._jdf.queryExecution().executedPlan().toString()) or collect(d))
    value, taken, tied = P.nth(df, P.draw(0), 1234)
    monkeypatch.undo()
    assert "Sort" not in plans[0]
    draws = sorted(r[0] for r in df.select(P.draw(0)).collect())
    assert (value, taken, tied) == (draws[1233], 1, 1)


def _signal(spark, ids):
    i = F.col("id")
    noise = F.pmod(F.xxhash64("id"), F.lit(97)).cast("double")
    return spark.range(1200).select(ids.alias("row_id"), (i % 3 == 0).cast("int").alias("label"), (i % 3).cast("double").alias("x"), noise.alias("z"))


@pytest.mark.parametrize("ids", ["id", "id div 40", "cast(null as bigint)"])
def test_null_importance_orders_no_rows(spark, monkeypatch, ids):
    def refused(*args, **kw):
        raise AssertionError("rows are ordered")

    monkeypatch.setattr(P, "row_index", refused)
    out = L.null_importance(_signal(spark, F.expr(ids)), ["x", "z"], runs=3, trees=4, max_depth=3).collect()
    found = {r["feature"]: r for r in out}
    assert set(found) == {"x", "z"}
    assert found["x"]["gain_score"] == 100.0 and found["x"]["gain_log"] > 1


def test_backward_elimination_fits_each_feature_set_once(spark, monkeypatch):
    fitted = []
    forest = L.random_forest
    monkeypatch.setattr(L, "random_forest", lambda *a, **kw: fitted.append(1) or forest(*a, **kw))
    assert L.backward_elimination(_signal(spark, F.col("id")), ["x", "z"], trees=4, max_depth=3) == ["x"]
    assert len(fitted) == 2  # both features, and the one that stays


def test_null_importance_query_grows_the_whole_forests(monkeypatch):
    from relweave.plans import catalog_models as M

    seen = []
    monkeypatch.setattr(M, "_lines", lambda *a: None)
    monkeypatch.setattr(M, "tidy", lambda d: d)
    monkeypatch.setattr(L, "null_importance", lambda df, names, **kw: seen.append(kw))
    M.null_importance(None, "")
    whole = {"runs": L.NULL_RUNS, "trees": L.FOREST_TREES, "max_depth": L.FOREST["max_depth"]}
    assert [{**whole, **kw} for kw in seen] == [whole]  # it was 3 runs of 5 trees of depth 4


def test_forests_of_cells_match_those_of_rows(spark):
    i = F.col("id")
    y = (F.pmod(F.xxhash64("id"), F.lit(10)) < F.when(i % 40 > 18, 8).otherwise(2)).cast("int")
    df = spark.range(4000).select((i % 40).cast("double").alias("a"), (i % 3).cast("double").alias("b"), y.alias("label"), i.alias("row_id"))
    kw = {"max_depth": 4, "bagging_fraction": 0.8, "feature_fraction": "sqrt"}
    actual, nulls = L._on_cells(df, ["a", "b"], "label", 1, 0, "row_id", 80, kw)
    mine = {r["feature"]: r for r in actual.collect()}
    theirs = {r["feature"]: r for r in L.forest_importance(df, ["a", "b"], trees=80, **kw).collect()}
    for f in ("a", "b"):
        assert mine[f]["gain_actual"] == pytest.approx(theirs[f]["gain"], rel=0.15, abs=0.02 * theirs["a"]["gain"])
        assert mine[f]["split_actual"] == pytest.approx(theirs[f]["split"], rel=0.25, abs=20)
    assert max(r["gain"] for r in nulls.collect()) < 0.2 * mine["a"]["gain_actual"]


@pytest.mark.parametrize("ids,most", [("id", C.MAX_CELLS), ("cast(null as bigint)", C.MAX_CELLS), ("id", 1)])
def test_null_importance_of_many_trees(spark, monkeypatch, ids, most):
    monkeypatch.setattr(C, "MAX_CELLS", most)  # 1: too many cells, so forests of rows
    grown, grow = [], L.importances
    monkeypatch.setattr(L, "importances", lambda *a: grown.append(1) or grow(*a))
    out = L.null_importance(_signal(spark, F.expr(ids)), ["x", "z"], runs=3, trees=L.FEW_TREES + 1, max_depth=3).collect()
    found = {r["feature"]: r for r in out}
    assert set(found) == {"x", "z"} and found["x"]["gain_score"] == 100.0 and found["x"]["gain_log"] > 1
    assert len(grown) == (most > 1)


def test_trees_of_cells_split_and_prune_like_the_rows():
    class Once:  # every row is drawn once
        random = np.random.default_rng(0).random

        def poisson(self, sizes):
            return np.asarray(sizes)

    rng = Once()
    bins = np.array([[0, 0, 1, 1], [0, 1, 0, 1]], "uint8")
    gain, split = C.grow(bins, np.array([[30, 10, 0, 0], [0, 0, 20, 20]]), rng)
    assert split.tolist() == [1, 0] and gain[0] == pytest.approx(40.0)  # gini 0.5 of 80 rows
    gain, split = C.grow(bins, np.array([[30, 30, 30, 30], [1, 2, 3, 4]]), rng)
    assert split.tolist() == [0, 0] and gain.tolist() == [0, 0]  # all leaves predict class 0
    gain, split = C.grow(bins, np.array([[9, 0, 0, 9], [0, 9, 9, 0]]), rng)
    assert split.sum() == 0  # no first split gains anything


def test_bins_are_every_value_of_few_and_quantiles_of_many(spark):
    df = spark.range(3200).select((F.col("id") % 5).cast("double").alias("few"), F.col("id").cast("double").alias("many"), F.lit(1.0).alias("one"))
    df = df.unionByName(spark.createDataFrame([(9.0, 5e9, 1.0)], df.schema))
    few, many, one = C.bin_edges(df, ["few", "many", "one"])
    assert few == [0, 1, 2, 3, 4] and one == [] and len(many) == 31  # a rare value has its own bin
    assert all(abs(e - 100 * (j + 1)) <= 1 for j, e in enumerate(many))
    at = df.select(C.bin_of(F.col("many"), many).alias("b")).groupBy("b").count().collect()
    assert sorted(r["b"] for r in at) == list(range(32)) and all(98 <= r["count"] <= 102 for r in at)


def test_null_importance_refuses_rows_without_a_class(spark):
    with pytest.raises(ValueError, match="classes"):
        L.null_importance(_signal(spark, F.col("id")).withColumn("label", F.when(F.col("row_id") > 3, F.col("label"))), ["x"], runs=1, trees=L.FEW_TREES + 1)
