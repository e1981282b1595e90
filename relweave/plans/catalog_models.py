"""Queries that train models: importance, reduction, outliers, search and the whole pipeline.

A trained model has no SQL, but what it must find or keep often has: the feature a label was made from, the
variance components explain, the rows of every class, a floor under the AUC. The queries that end in
such a statement have SQL. Forests with ``_SMALL`` are smaller than the library's default of 200 trees of depth 8, which
takes 55 s for one forest on the 60,000 lines of scale 0.01 (8 cores).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from relweave.functions.aggregates import roc_auc
from relweave.operators import reduce as R
from relweave.operators import selection as L
from relweave.operators.encode import CategoryEncoder
from relweave.operators.merge import MergeOptions
from relweave.operators.sampling import folds
from relweave.plans import inputs as I
from relweave.plans import models as T
from relweave.plans.automl import ModelOptions, RelationalModel
from relweave.plans.catalog import EVENTS, LINES, ORDERS, query, rnd, tidy
from relweave.schema import MAIN, DatasetConfig, Relation, RelationalDataset
from relweave.session import materialize
from relweave.sources.tables import attach_label

_NUMS = ["n_qty", "n_price", "n_disc", "n_tax"]
_SMALL = {"trees": 5, "max_depth": 4}


def _lines(spark, sf):
    """Order lines with a content hash as row id; the label is whether the line was returned."""
    lines = I.order_lines(spark, sf)
    keyed = lines.withColumn("row_id", F.xxhash64(*lines.columns))
    return keyed.withColumn("label", (F.col("c_flag") == "R").cast("int"))


@query("importance_select")
def importance_select(spark, sf):
    return L.forest_importance(_lines(spark, sf), _NUMS, **_SMALL)


@query("null_importance")
def null_importance(spark, sf):
    return tidy(L.null_importance(_lines(spark, sf), _NUMS))


@query("permutation_importance")
def permutation_importance(spark, sf):
    return tidy(L.permutation_importance(_lines(spark, sf), _NUMS, **_SMALL))


def _names(spark, names):
    return spark.createDataFrame([(i, n) for i, n in enumerate(names)], "place int, feature string")


@query("select_from_model")
def select_from_model(spark, sf):
    return _names(spark, L.select_above_median(_lines(spark, sf), _NUMS, **_SMALL))


@query("backward_elimination")
def backward_elimination(spark, sf):
    return _names(spark, L.backward_elimination(_lines(spark, sf), _NUMS, **_SMALL))


_SIGNAL = f"""l as (select n_qty, n_price, n_disc, n_tax, cast(n_disc + n_tax / 1000 > 0.05 as int) as label from {LINES}),
  best as (select feature from (""" + " union all ".join(f"select '{c}' as feature, abs(corr({c}, label)) as a from l" for c in _NUMS) + ") order by a desc limit 1)"
_METHODS = ("imp", "sfm", "shap", "backward")


@query(
    "selection_of_signal",
    f"with {_SIGNAL} select method, feature from best, (values " + ", ".join(f"('{m}')" for m in _METHODS) + ") v(method)",
)
def selection_of_signal(spark, sf):
    """The feature that each way of selecting puts first, for a label made from one feature."""
    lines = _signal(spark, sf)
    found = [(m, L.select_features(lines, _NUMS, m, 0.25, **_SMALL)[0]) for m in _METHODS]
    return spark.createDataFrame(found, "method string, feature string")


def _signal(spark, sf):
    return materialize(_lines(spark, sf).withColumn("label", (F.col("n_disc") + F.col("n_tax") / 1000 > 0.05).cast("int")))


@query("null_importance_of_signal", f"with {_SIGNAL} select feature from best")
def null_importance_of_signal(spark, sf):
    """The feature that stands out most from forests fitted on permuted labels."""
    found = L.select_by_null_importance(_signal(spark, sf), _NUMS, runs=2, **_SMALL)
    return spark.createDataFrame([(found[0],)], "feature string")


@query(
    "pca_explained",
    f"""with m as (select (n_qty - min(n_qty) over ()) / (max(n_qty) over () - min(n_qty) over ()) as x,
        (n_price - min(n_price) over ()) / (max(n_price) over () - min(n_price) over ()) as y from {LINES}),
      c as (select var_samp(x) as a, var_samp(y) as b, covar_samp(x, y) as k from m),
      e as (select (a + b) / 2 + sqrt(((a - b) / 2) ** 2 + k * k) as one, a + b as total from c)
    select 0 as component, {rnd("one / total", "share", 8)} from e union all select 1, {rnd("1 - one / total", "share", 8)} from e""",
)
def pca_explained(spark, sf):
    """Shares of the variance that the two components of quantity and price explain."""
    shares = R.Reducer.fit(_lines(spark, sf), ["n_qty", "n_price"], 1.0).explained
    return tidy(spark.createDataFrame(list(enumerate(shares)), "component int, share double"), 8)


@query("pca_95")
def pca_95(spark, sf):
    lines = _lines(spark, sf)
    return tidy(R.Reducer.fit(lines, _NUMS).transform(lines))


@query("isolation_forest")
def isolation_forest(spark, sf):
    lines = _lines(spark, sf)
    forest = R.IsolationForest.fit(lines, _NUMS, trees=20)
    return forest.score(lines.select("row_id", *_NUMS)).select("row_id", F.round("outlier_score", 6).alias("outlier_score"))


@query("drop_outliers")
def drop_outliers(spark, sf):
    lines = _lines(spark, sf).select("row_id", "label", *_NUMS)
    return R.drop_outliers(lines, _NUMS, trees=20)


@query("outlier_share", "select count(*) - floor(0.15 * count(*))::bigint as kept, floor(0.15 * count(*))::bigint as dropped from lineitem")
def outlier_share(spark, sf):
    """How many lines stay and go when 15 % are to go."""
    lines = _lines(spark, sf).select("row_id", "label", *_NUMS)
    kept = R.drop_outliers(lines, _NUMS, share=0.15)
    counts = kept.select(F.lit(1).alias("k")).unionByName(lines.select(F.lit(0).alias("k")))
    n = F.count_if(F.col("k") == 1)
    return counts.agg(n.alias("kept"), (F.count_if(F.col("k") == 0) - n).alias("dropped"))


def _coded(spark, sf):
    e = I.events(spark, sf)
    cats = CategoryEncoder.fit(e, ["c_user", "c_type"])
    hour = F.hour("t_01").alias("n_hour")
    return cats.transform(e.select("row_id", "c_user", "c_type", "n_value", hour, "label"))


_FEATURES = ["c_user", "n_value", "n_hour", "n_freq__c_user"]


def _searched(spark, sf):
    """Out-of-fold scores of the tuning sample, and scores of all rows."""
    rows = materialize(_coded(spark, sf))
    trials, scores = T.random_search(rows, _FEATURES, trials=2, rounds=2, n_folds=2)
    return scores, T.score_all(rows, _FEATURES, trials, scores, rounds=2)


@query("random_search")
def random_search(spark, sf):
    return _searched(spark, sf)[1]


@query(
    "search_counts",
    f"select trial, label, count(*) as n from {EVENTS}, (values (0), (1)) t(trial) group by all",
)
def search_counts(spark, sf):
    """Rows scored by every trial of a random search, per class: all of them."""
    return _searched(spark, sf)[1].groupBy("trial", "label").agg(F.count(F.lit(1)).alias("n"))


@query("staged_search")
def staged_search(spark, sf):
    trials, _ = T.staged_search(_coded(spark, sf), _FEATURES, per_stage=1, rounds=2, n_folds=2)
    return spark.createDataFrame([(t.number, float(t.auc)) for t in trials], "trial int, auc double")


@query("stacking")
def stacking(spark, sf):
    scores, every = _searched(spark, sf)
    model = T.train_stacker(scores, [0, 1], "logistic")
    wide = T.stack_rows(every, [0, 1])
    return T.score(model, T.assemble(wide, ["p_0", "p_1"]))


def _urgent(spark, sf):
    """Orders as main with the urgent ones labelled, customers and lines as side tables."""
    main = I.main_orders(spark, sf)
    urgent = F.col("c_priority").isin("1-URGENT", "2-HIGH").cast("int").alias("label")
    main = attach_label(main, main.select("row_id", urgent)).drop("c_priority", "c_order")
    main = main.withColumn("c_order", F.col("row_id").cast("string"))
    config = DatasetConfig(
        {}, (Relation(MAIN, "table_1", "c_cust", "many_to_one"), Relation(MAIN, "table_2", "c_order", "one_to_many")), "t_01"
    )
    tables = {MAIN: main, "table_1": I.customers(spark, sf), "table_2": I.order_lines(spark, sf)}
    return RelationalDataset(tables, config)


@query("gbt_fit_predict")
def gbt_fit_predict(spark, sf):
    """The whole pipeline: four folds of the orders train, the fifth is scored."""
    data = _urgent(spark, sf)
    marked = folds(data.main, 5)
    options = ModelOptions(merge=MergeOptions(numeric=("mean", "max")))
    model = RelationalModel(options).fit(data.with_table(MAIN, marked.filter("fold > 0").drop("fold")))
    return model.predict(marked.filter("fold = 0").drop("fold", "label"))


_LARGE = f"""(select o.row_id, cast(coalesce(sum(l.n_qty), 0) > 90 as int) as label from {ORDERS} o left join {LINES} l using (c_order) group by 1)"""


@query(
    "pipeline_auc",
    f"select cast(sum(cast(ceil(n / 5.0) as bigint)) as bigint) as scored, 1 as above_floor from (select label, count(*) as n from {_LARGE} group by 1)",
)
def pipeline_auc(spark, sf):
    """Rows scored by the whole pipeline, and whether it tells large orders, which only their lines
    show, from small ones: an AUC of 0.8 at least on the fold that was left out."""
    data = _urgent(spark, sf)
    amount = data.tables["table_2"].groupBy("c_order").agg(F.sum("n_qty").alias("__q"))
    large = (F.coalesce("__q", F.lit(0.0)) > 90).cast("int")
    main = data.main.join(amount, "c_order", "left").withColumn("label", large).drop("__q")
    marked = materialize(folds(main, 5))
    options = ModelOptions(
        merge=MergeOptions(numeric=("mean", "sum")), selection_trees=5, trials=2, trial_rounds=3, folds=2, final_rounds=5,
    )
    model = RelationalModel(options).fit(data.with_table(MAIN, marked.filter("fold > 0").drop("fold")))
    held = marked.filter("fold = 0")
    scores = materialize(model.predict(held.drop("fold", "label")).join(held.select("row_id", "label"), "row_id"))
    model.drop()
    auc = roc_auc(scores, "score", "label").first()["auc"]
    return scores.agg(F.count(F.lit(1)).alias("scored"), F.lit(int(auc >= 0.8)).cast("bigint").alias("above_floor"))
