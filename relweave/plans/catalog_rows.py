"""Queries over sampling, splitting, sorting, scores, selection and ensembles."""

from __future__ import annotations

from pyspark.sql import functions as F

from relweave.functions import aggregates as A
from relweave.functions.scalars import log_ratio_score
from relweave.operators import sampling as P
from relweave.operators import selection as L
from relweave.operators.skyline import choose_rows, skyline
from relweave.plans import ensemble as M
from relweave.plans import inputs as I
from relweave.plans.catalog import EVENTS, LINES, PARTS, millis, query, rnd, tidy


def _labelled(spark, sf):
    return I.events(spark, sf).select("row_id", "label", "n_value")


# ----------------------------------------------------------------------------- sampling

_H = "md5('0|' || row_id)"
_U = "((cast('0x' || substr(md5('{seed}|' || row_id), 1, 12) as bigint) + 0.5) / 281474976710656.0)"
_E = f"with e as (select row_id, label, n_value, {_H} as h from {EVENTS}), n as (select count(*) as n, sum(label) as p from e)"
_PICK = f"select row_id, label, {rnd('n_value', 'n_value')} from r"


def _ranked(sizes: str, more: str = "") -> str:
    """SQL that keeps the ``sizes`` smallest draws of each class."""
    return f"""{_E}{more}, k as (select *, row_number() over (partition by label order by h) as i from e),
  r as (select k.* from k, n where i <= {sizes}) {_PICK}"""


@query("simple_sample", f"{_E}, r as (select * from e order by h limit 2500) {_PICK}")
def simple_sample(spark, sf):
    return tidy(P.simple_sample(_labelled(spark, sf), 2500))


@query("cap_rows", f"{_E}, r as (select * from e order by h limit 4000000) {_PICK}")
def cap_rows(spark, sf):
    return tidy(P.cap_rows(_labelled(spark, sf)))


@query("cap_rows_bound", f"{_E}, r as (select * from e order by h limit 1000) {_PICK}")
def cap_rows_bound(spark, sf):
    return tidy(P.cap_rows(_labelled(spark, sf), 1_000))


@query(
    "weighted_sample",
    f"""{_E}, w as (select e.*, -ln({_U.format(seed=0)}) / (case when label = 1 then n.n - n.p else n.p end) as k from e, n),
      r as (select * from w order by k limit 2000) {_PICK}""",
)
def weighted_sample(spark, sf):
    return tidy(P.balanced_sample(_labelled(spark, sf), 2000))


@query(
    "class_weights",
    f"""{_E} select row_id, label, case when label = 1 then n.n - n.p else n.p end as weight from e, n""",
)
def class_weights(spark, sf):
    return tidy(P.with_class_weights(_labelled(spark, sf).drop("n_value")))


@query(
    "stratified_sample",
    _ranked("(case when label = 1 then ceil(p * 3000.0 / n) else 3000 - ceil(p * 3000.0 / n) end)"),
)
def stratified_sample(spark, sf):
    return tidy(P.stratified_sample(_labelled(spark, sf), 3000))


@query("down_sample", _ranked("floor((case when label = 1 then p else n - p end) * 0.5)"))
def down_sample(spark, sf):
    return tidy(P.down_sample(_labelled(spark, sf)))


@query(
    "balance_down",
    _ranked(
        """(case when (label = 1) = (p <= n - p) then n else
      floor(greatest(p, n - p) * (case when greatest(p, n - p) > 6 * least(p, n - p) then 0.16 else 0.3 end)) end)"""
    ),
)
def balance_down(spark, sf):
    return tidy(P.balance_down(_labelled(spark, sf)))


@query(
    "balance_up",
    f"""{_E}, q as (select *, cast((n - p) // p as bigint) as whole, (n - p) % p as extra from n),
      up as (select row_id, label, n_value, row_number() over (order by md5('0|up|' || row_id)) as i from e where label = 1),
      c as (select row_id, label, n_value, unnest(range(0, whole + cast(i <= extra as bigint))) as copy from up, q),
      both_ as (select row_id, label, n_value, copy from c union all select row_id, label, n_value, 0 from e where label = 0),
      r as (select * from both_ order by md5('0|half|' || row_id || '-' || copy) limit (select cast(floor(n * 0.5) as bigint) from n))
    select row_id, label, copy, {rnd('n_value', 'n_value')} from r""",
)
def balance_up(spark, sf):
    """Purchases are the minority at every scale, so the SQL writes the minority as label 1."""
    return tidy(P.balance_up(_labelled(spark, sf)))


@query(
    "fresh_negatives",
    f"""{_E}, s as (select case when n - p <= 3 * p then 1 else cast(ceil((n - p) / (3.0 * p)) as bigint) end as slices from n),
      r as (select e.* from e, s where label = 1 or slices = 1 or floor({_U.format(seed=0)} * slices) = 1 % slices) {_PICK}""",
)
def fresh_negatives(spark, sf):
    return tidy(P.fresh_negatives(_labelled(spark, sf), 1, 5))


@query(
    "class_union",
    f"""{_E}, k as (select *, row_number() over (partition by label order by h) as i from e),
      r as (select * from k where label = 1 and i <= 500 union all select * from k where label = 0 and i <= 700) {_PICK}""",
)
def class_union(spark, sf):
    e = _labelled(spark, sf)
    ones, zeros = e.filter("label = 1"), e.filter("label = 0")
    return tidy(P.class_union(P.simple_sample(ones, 500), P.simple_sample(zeros, 700)))


@query(
    "stratified_split",
    f"""{_E}, k as (select *, row_number() over (partition by label order by h) as i, count(*) over (partition by label) as c from e)
    select row_id, label, cast(i <= round(c * 0.2) as bigint) as is_valid from k""",
)
def stratified_split(spark, sf):
    return tidy(P.split(_labelled(spark, sf).drop("n_value")))


@query(
    "plain_split",
    f"""{_E}, k as (select *, row_number() over (order by h) as i from e)
    select row_id, label, cast(i <= ceil(n.n * 0.1) as bigint) as is_valid from k, n""",
)
def plain_split(spark, sf):
    return tidy(P.split(_labelled(spark, sf).drop("n_value"), 0.1, None))


@query(
    "kfold",
    f"{_E} select row_id, label, (row_number() over (partition by label order by h) - 1) % 5 as fold from e",
)
def kfold(spark, sf):
    return tidy(P.folds(_labelled(spark, sf).drop("n_value")))


@query(
    "kfold_by_hash",
    f"select row_id, label, cast(floor({_U.format(seed=0)} * 5) as bigint) as fold from {EVENTS}",
)
def kfold_by_hash(spark, sf):
    return tidy(P.folds(_labelled(spark, sf).drop("n_value"), exact=False))


@query(
    "double_holdout",
    f"""with e as (select row_id, label, md5('0|hold|' || row_id) as a, md5('0|' || row_id) as b from {EVENTS}),
      s as (select case when count(*) > 200000 then 20000.0 / count(*) else 0.1 end as s from e),
      h as (select *, row_number() over (partition by label order by a) <= round(count(*) over (partition by label) * s) as held from e, s),
      v as (select *, row_number() over (partition by label order by b) <= round(count(*) over (partition by label) * 0.2) as valid from h where not held)
    select row_id, label, case when valid then 'valid' else 'train' end as part from v
    union all select row_id, label, 'holdout' from h where held""",
)
def double_holdout(spark, sf):
    return tidy(P.double_holdout(_labelled(spark, sf).drop("n_value")))


@query(
    "label_permutation",
    f"""with e as {EVENTS}, a as (select row_id, label, row_number() over (order by md5('0|to|' || row_id)) as i from e),
      b as (select label as permuted, row_number() over (order by md5('0|from|' || row_id)) as i from e)
    select row_id, label, permuted from a join b using (i)""",
)
def label_permutation(spark, sf):
    return tidy(P.permute_label(_labelled(spark, sf).drop("n_value")))


# ------------------------------------------------------------------------ sort and top-k


@query(
    "time_sort_head",
    f"select row_id, c_type, {millis('t_01')} as t_01 from {EVENTS} order by t_01, row_id limit 100",
)
def time_sort_head(spark, sf):
    return tidy(I.events(spark, sf).orderBy("t_01", "row_id").select("row_id", "c_type", "t_01").limit(100))


def _part_scores(spark, sf):
    p = I.parts(spark, sf)
    return p.select(F.col("c_part").alias("feature"), (F.col("n_size") * F.col("n_retail")).alias("score"), "n_size")


@query(
    "top_n_score",
    f"select c_part as feature, {rnd('n_size * n_retail', 'score')} from {PARTS} order by n_size * n_retail desc, c_part limit 20",
)
def top_n_score(spark, sf):
    return tidy(_part_scores(spark, sf).select("feature", "score").orderBy(F.desc("score"), "feature").limit(20))


@query(
    "top_n_abs",
    f"""select c_part as feature, {rnd('n_retail - 1000', 'score')} from {PARTS} order by abs(n_retail - 1000) desc, c_part limit 20""",
)
def top_n_abs(spark, sf):
    p = I.parts(spark, sf).select(F.col("c_part").alias("feature"), (F.col("n_retail") - 1000).alias("score"))
    best = p.orderBy(F.desc(F.abs("score")), "feature").limit(20)
    return tidy(best.orderBy(F.abs("score")))


@query(
    "two_key_top",
    f"select c_part, {rnd('n_size', 'n_size')}, {rnd('n_retail', 'n_retail')} from {PARTS} order by n_size desc, n_retail desc, c_part limit 50",
)
def two_key_top(spark, sf):
    p = I.parts(spark, sf).select("c_part", "n_size", "n_retail")
    return tidy(p.orderBy(F.desc("n_size"), F.desc("n_retail"), "c_part").limit(50))


@query(
    "value_rank",
    f"""select c_part, count(*) as n, row_number() over (order by count(*) desc, c_part) - 1 as rank from {LINES} group by 1""",
)
def value_rank(spark, sf):
    return A.value_ranks(I.order_lines(spark, sf), "c_part")


# --------------------------------------------------------------------- scores, selection

_NUMS = ["n_qty", "n_price", "n_disc", "n_tax"]
_LAB = f"(select *, cast(c_flag = 'R' as bigint) as label from {LINES})"


def _lines(spark, sf):
    return I.order_lines(spark, sf).withColumn("label", (F.col("c_flag") == "R").cast("int"))


@query(
    "roc_auc",
    f"""with c as (select n_value, sum(label) as p, count(*) - sum(label) as q from {EVENTS} group by 1),
      r as (select *, sum(q) over (order by n_value) - q as below from c)
    select {rnd("sum(p * (below + q / 2.0)) / (sum(p) * sum(q))", "auc", 9)} from r""",
)
def roc_auc(spark, sf):
    return tidy(A.roc_auc(I.events(spark, sf), "n_value", "label"), 9)


@query(
    "roc_auc_by_group",
    f"""with c as (select c_user, n_value, sum(label) as p, count(*) - sum(label) as q from {EVENTS} group by 1, 2),
      r as (select *, sum(q) over (partition by c_user order by n_value) - q as below from c)
    select c_user, {rnd("sum(p * (below + q / 2.0)) / nullif(sum(p) * sum(q), 0)", "auc", 9)} from r group by 1""",
)
def roc_auc_by_group(spark, sf):
    return tidy(A.roc_auc(I.events(spark, sf), "n_value", "label", ["c_user"]), 9)


@query(
    "f1_score",
    f"""with s as (select label, case when n_value / 40 > 0.5 and n_value / 40 < 1.5 then 1 else 0 end as hit from {EVENTS})
    select {rnd("2.0 * count(*) filter (hit = 1 and label = 1) / (2.0 * count(*) filter (hit = 1 and label = 1) + count(*) filter (hit <> label))", "f1", 9)} from s""",
)
def f1_score(spark, sf):
    return tidy(A.f1_score(I.events(spark, sf).withColumn("s", F.col("n_value") / 40), "s", "label"), 9)


@query(
    "pearson_rank",
    f"with l as {_LAB} " + " union all ".join(f"select '{c}' as feature, {rnd(f'corr({c}, label)', 'score', 8)} from l" for c in _NUMS),
)
def pearson_rank(spark, sf):
    return tidy(A.label_correlations(_lines(spark, sf), _NUMS, "label"), 8)


def _chi_sql() -> str:
    parts = [
        f"""select '{c}' as feature, {rnd("sum((o - e) * (o - e) / e)", "score", 6)} from (
      select sum({c}) as o, (select sum({c}) from l) * count(*) / (select count(*) from l) as e from l group by label)"""
        for c in _NUMS
    ]
    return f"with l as {_LAB} " + " union all ".join(parts)


@query("chi_rank", _chi_sql())
def chi_rank(spark, sf):
    return tidy(A.chi_square_scores(_lines(spark, sf), _NUMS, "label"))


def _gain_sql(c: str) -> str:
    return f"""select '{c}' as feature, {rnd("log2(n) - o / n - i / n", "score", 8)} from (
      with s as (select min({c}) as a, (max({c}) - min({c})) / 10 as w from l),
      b as (select least(floor(({c} - a) / w), 9) as b, label from l, s),
      c as (select b, label, count(*) as c from b group by 1, 2),
      t as (select b, sum(c) as t, sum(c * log2(c)) as h from c group by 1),
      y as (select sum(t * log2(t)) as o from (select label, sum(c) as t from c group by 1)),
      i as (select sum(t) as n, sum(t * log2(t) - h) as i from t)
      select n, o, i from i, y)"""


@query("info_gain", f"with l as {_LAB} " + " union all ".join(_gain_sql(c) for c in _NUMS))
def info_gain(spark, sf):
    return tidy(L.gain_ranking(_lines(spark, sf), _NUMS, "label"), 8)


@query(
    "chi_select",
    f"""with l as {_LAB}, m as (select label, """
    + ", ".join(f"(n.{c} - lo.{c}) / (hi.{c} - lo.{c}) as {c}" for c in _NUMS)
    + " from l n, (select " + ", ".join(f"min({c}) as {c}" for c in _NUMS) + " from l) lo, (select "
    + ", ".join(f"max({c}) as {c}" for c in _NUMS) + " from l) hi), s as ("
    + " union all ".join(
        f"""select {i} as place, '{c}' as feature, sum((o - e) * (o - e) / e) as score from (
      select sum({c}) as o, (select sum({c}) from m) * count(*) / (select count(*) from m) as e from m group by label)"""
        for i, c in enumerate(_NUMS)
    )
    + ") select place, feature from s qualify row_number() over (order by score desc, feature) <= 3",
)
def chi_select(spark, sf):
    """The three features of largest chi-square after min-max scaling."""
    names = L.select_features(_lines(spark, sf), _NUMS, "chi")
    return spark.createDataFrame([(_NUMS.index(f), f) for f in names], "place long, feature string")


@query(
    "correlation_select",
    f"""with l as {_LAB}, s as ("""
    + " union all ".join(f"select '{c}' as feature, abs(corr({c}, label)) as a from l" for c in _NUMS)
    + ") select feature, row_number() over (order by a desc, feature) as place from s order by a desc, feature limit 3",
)
def correlation_select(spark, sf):
    names = L.select_features(_lines(spark, sf), _NUMS, "cor")
    return spark.createDataFrame([(f, len(names) - i) for i, f in enumerate(names)], "feature string, place long")


@query(
    "null_ratio_score",
    f"""with r as (select c_part as feature, c_supp as run, sum(n_price) as gain, count(*) as split from {LINES} group by 1, 2),
      a as (select c_part as feature, avg(n_price) as gain, avg(n_qty) as split from {LINES} group by 1),
      q as (select feature, quantile_cont(gain, 0.75) as g75, quantile_cont(cast(split as double), 0.75) as s75 from r group by 1)
    select feature, {rnd("ln(1e-10 + a.gain / (1 + g75))", "gain_log", 5)}, {rnd("ln(1e-10 + a.split / (1 + s75))", "split_log", 5)}
    from q join a using (feature)""",
)
def null_ratio_score(spark, sf):
    lines = I.order_lines(spark, sf)
    runs = lines.groupBy(F.col("c_part").alias("feature"), F.col("c_supp").alias("run")).agg(
        F.sum("n_price").alias("gain"), F.count("*").alias("split")
    )
    actual = lines.groupBy(F.col("c_part").alias("feature")).agg(F.avg("n_price").alias("g"), F.avg("n_qty").alias("s"))
    q = A.quantiles(runs, "gain", {"g75": 0.75}, ["feature"]).join(A.quantiles(runs, "split", {"s75": 0.75}, ["feature"]), "feature")
    both = q.join(actual, "feature")
    return tidy(
        both.select(
            "feature",
            log_ratio_score(F.col("g"), F.col("g75")).alias("gain_log"),
            log_ratio_score(F.col("s"), F.col("s75")).alias("split_log"),
        ),
        5,
    )


# ----------------------------------------------------------------------------- ensembles

# Three scorings of every line stand in for the trials of a search.
_TRIAL_SQL = {0: "n_disc * 10", 1: "n_qty / 50", 2: "(n_tax * 10 + n_qty / 50) / 2"}
_TRIALS = f"""t as ("""+ " union all ".join(
    f"select {k} as trial, row_id, label, least({e}, 1.0) as p from l" for k, e in _TRIAL_SQL.items()
) + ")"
_LINE_IDS = f"""l as (select *, row_number() over (order by c_order, c_part, c_supp, c_flag, c_line, n_qty, n_price, n_disc, n_tax, t_ship) as row_id from {_LAB})"""


def _trials(spark, sf):
    l = _lines(spark, sf)
    keyed = l.withColumn("row_id", F.xxhash64(*[c for c in l.columns if c != "label"]))
    scores = {0: F.col("n_disc") * 10, 1: F.col("n_qty") / 50, 2: (F.col("n_tax") * 10 + F.col("n_qty") / 50) / 2}
    cells = F.array(*[F.struct(F.lit(k).alias("trial"), F.least(s, F.lit(1.0)).alias("p")) for k, s in scores.items()])
    return keyed.select("row_id", "label", F.explode(cells).alias("e")).select("row_id", "label", "e.*")


_SUMMARY = f"""{_LINE_IDS}, {_TRIALS}, m as (select row_id, avg(p) as m from t group by 1),
      d as (select trial, -avg((p - m) ** 2) as agreement,
        -2.0 * count(*) filter (p > 0.5 and label = 1)
          / (2.0 * count(*) filter (p > 0.5 and label = 1) + count(*) filter ((p > 0.5) <> (label = 1))) as neg_f1
        from t join m using (row_id) group by 1),
      c as (select trial, p, sum(label) as y, count(*) - sum(label) as q from t group by 1, 2),
      r as (select *, sum(q) over (partition by trial order by p) - q as below from c),
      a as (select trial, -sum(y * (below + q / 2.0)) / (sum(y) * sum(q)) as loss from r group by 1)"""


@query(
    "ensemble_diversity",
    f"""with {_SUMMARY}
    select trial, {rnd("loss", "loss", 8)}, {rnd("agreement", "agreement", 8)}, {rnd("neg_f1", "neg_f1", 8)} from d join a using (trial)""",
)
def ensemble_diversity(spark, sf):
    return tidy(M.trial_summary(_trials(spark, sf)), 8)


@query(
    "bagging_score",
    f"""with l as {_LAB} select {rnd("sum(a)", "total", 3)}, count(*) as n from (
      select (least(n_disc * 10, 1.0) + least((n_tax * 10 + n_qty / 50) / 2, 1.0)) / 2 as a from l)""",
)
def bagging_score(spark, sf):
    """The averages are summed up, since lines have no key to list them by."""
    scores = M.bagging(_trials(spark, sf), [0, 2])
    return tidy(scores.agg(F.sum("score").alias("total"), F.count("*").alias("n")), 3)


_SUPP = f"""s as (select c_part, avg(n_price) as cost, -sum(n_qty) as volume from {LINES} group by 1)"""


@query(
    "pareto_trials",
    f"""with {_SUPP} select c_part, {rnd("cost", "cost", 4)}, {rnd("volume", "volume", 4)} from s where not exists (
      select 1 from s o where o.cost <= s.cost and o.volume <= s.volume and (o.cost < s.cost or o.volume < s.volume))""",
)
def pareto_trials(spark, sf):
    """Parts that are cheap and sell much: no other part is better in both."""
    s = I.order_lines(spark, sf).groupBy("c_part").agg(F.avg("n_price").alias("cost"), (-F.sum("n_qty")).alias("volume"))
    return tidy(M.pareto_front(s, "cost", "volume"), 4)


_PART_GOALS = f"""s as (select c_part, avg(n_price) as cost, -sum(n_qty) as volume, avg(n_tax) as tax from {LINES} group by 1),
      f as (select * from s where not exists (select 1 from s o where o.cost <= s.cost and o.volume <= s.volume and o.tax <= s.tax
        and (o.cost < s.cost or o.volume < s.volume or o.tax < s.tax)))"""


def _part_goals(spark, sf):
    goals = [F.avg("n_price").alias("cost"), (-F.sum("n_qty")).alias("volume"), F.avg("n_tax").alias("tax")]
    return I.order_lines(spark, sf).groupBy("c_part").agg(*goals)


@query("pareto_three", f"with {_PART_GOALS} select c_part, {rnd('cost', 'cost', 4)}, {rnd('volume', 'volume', 4)}, {rnd('tax', 'tax')} from f")
def pareto_three(spark, sf):
    """Parts that are cheap, sell much and are taxed little: no other part is better in all three."""
    out = skyline(_part_goals(spark, sf), ["cost", "volume", "tax"])
    return tidy(out.withColumns({c: F.round(c, 4) for c in ("cost", "volume")}))


def _gap_sql(goal: str) -> str:
    order = f"over (order by {goal}, c_part)"
    return f"""case when lag({goal}) {order} is null or lead({goal}) {order} is null then 'infinity'::double
        else (lead({goal}) {order} - lag({goal}) {order}) / (max({goal}) over () - min({goal}) over ()) end"""


@query(
    "pareto_choice",
    f"""with {_PART_GOALS}, g as (select c_part, {_gap_sql("cost")} + {_gap_sql("volume")} + {_gap_sql("tax")} as spread from f),
      r as (select c_part, row_number() over (order by spread desc, c_part) - 1 as place from g)
    select c_part, place from r where place < 12""",
)
def pareto_choice(spark, sf):
    """Twelve parts of the front of three objectives, spread over it as widely as possible."""
    return choose_rows(_part_goals(spark, sf), 12, ["cost", "volume", "tax"], "c_part").select("c_part", "place")


def _front_sql(rows: str) -> str:
    return f"""select * from {rows} x where not exists (select 1 from {rows} o where o.loss <= x.loss
        and o.agreement <= x.agreement and (o.loss < x.loss or o.agreement < x.agreement))"""


def _spread_sql(goal: str) -> str:
    order = f"over (partition by front order by {goal}, trial)"
    return f"""case when lag({goal}) {order} is null or lead({goal}) {order} is null then 'infinity'::double
        else (lead({goal}) {order} - lag({goal}) {order}) / (max({goal}) over (partition by front) - min({goal}) over (partition by front)) end"""


@query(
    "nsga_choice",
    f"""with {_SUMMARY}, s as (select trial, loss, agreement from d join a using (trial)),
      one as ({_front_sql("s")}), rest as (select * from s where trial not in (select trial from one)), two as ({_front_sql("rest")}),
      f as (select *, 1 as front from one union all select *, 2 from two),
      g as (select trial, front, count(*) over (order by front) as upto, {_spread_sql("loss")} + {_spread_sql("agreement")} as spread from f),
      k as (select trial, row_number() over (order by front, case when upto <= 2 then 0 else -spread end, trial) - 1 as place from g)
    select cast(place as int) as place, cast(trial as int) as trial from k where place < 2""",
)
def nsga_choice(spark, sf):
    """Two of the three scorings, by non-dominated sorting on loss and agreement."""
    chosen = M.select_trials(M.trial_summary(_trials(spark, sf)), 2)
    return spark.createDataFrame([(i, t) for i, t in enumerate(chosen)], "place int, trial int")


def _greedy_sql(place: int) -> str:
    """The trial that lowers the absolute error of the average most, given those chosen before."""
    before = "".join(f" join t t{i} on t{i}.row_id = t.row_id and t{i}.trial = (select trial from b{i})" for i in range(place))
    total = " + ".join(["t.p", *(f"t{i}.p" for i in range(place))])
    unused = " and ".join(f"t.trial <> (select trial from b{i})" for i in range(place)) or "true"
    return f"""b{place} as (select {place} as place, t.trial, avg(abs(t.label - ({total}) / {place + 1}.0)) as e
      from t{before} where {unused} group by t.trial order by e, trial limit 1)"""


@query(
    "greedy_ensemble",
    f"""with {_LINE_IDS}, {_TRIALS}, {_greedy_sql(0)}, {_greedy_sql(1)}, {_greedy_sql(2)},
      s as (select * from b0 union all select * from b1 union all select * from b2)
    select cast(place as int) as place, cast(trial as int) as trial from s
    where place <= (select min(place) from s where e = (select min(e) from s))""",
)
def greedy_ensemble(spark, sf):
    chosen = M.greedy_selection(_trials(spark, sf), 3)
    return spark.createDataFrame([(i, t) for i, t in enumerate(chosen)], "place int, trial int")
