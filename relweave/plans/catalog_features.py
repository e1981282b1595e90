"""Queries over ordered functions, scalars, encoders and feature generation."""

from __future__ import annotations

from pyspark.sql import functions as F

from relweave.functions import aggregates as A
from relweave.functions import scalars as S
from relweave.functions.lookup import attach_statistics
from relweave.functions.ordered import Scan, lag, prefix_scan, row_index
from relweave.operators import encode as E
from relweave.operators import generate as G
from relweave.operators.sampling import folds
from relweave.plans import inputs as I
from relweave.plans.catalog import DOCUMENTS, EVENTS, LINES, ORDERS, PARTS, millis, query, rnd, rnd_half_up, tidy

# ------------------------------------------------------------------ ordered functions

_BY_TIME = "over (order by t_01, row_id rows unbounded preceding)"


_CENTS = "cast(round(n_value * 100) as bigint)"


def _events(spark, sf, exact=False):
    """Events; ``exact`` gives the values as decimals, whose sums do not depend on the order."""
    value = F.col("n_value").cast("decimal(18,2)").alias("n_value") if exact else F.col("n_value")
    return I.events(spark, sf).select("row_id", "c_user", "c_type", value, "t_01", "label")


@query(
    "cumulative",
    f"""select row_id, {rnd(f"sum(n_value) {_BY_TIME}", "n_cumsum__n_value")},
      {rnd_half_up(f"cast(sum({_CENTS}) {_BY_TIME} as double) / (100.0 * row_number() over (order by t_01, row_id))", "n_cummean__n_value")},
      {rnd(f"max(n_value) {_BY_TIME}", "n_cummax__n_value")}, {rnd(f"min(n_value) {_BY_TIME}", "n_cummin__n_value")},
      count(*) {_BY_TIME} as n_cumcount from {EVENTS}""",
)
def cumulative(spark, sf):
    v = F.col("n_value")
    scans = {f"n_cum{k}__n_value": Scan(k, v) for k in ("sum", "mean", "max", "min")}
    e = _events(spark, sf, exact=True).select("row_id", "t_01", "n_value")
    out = prefix_scan(e, ["t_01", "row_id"], scans | {"n_cumcount": Scan("index")})
    return tidy(out.drop("t_01", "n_value"))


@query(
    "cumulative_with_nulls",
    f"""with e as (select row_id, t_01, case when n_value >= 2 then n_value end as v from {EVENTS})
    select row_id, case when v is not null then {rnd(f"sum(v) {_BY_TIME}")} end as n_cumsum__v,
      case when v is not null then {rnd(f"max(v) {_BY_TIME}")} end as n_cummax__v from e""",
)
def cumulative_with_nulls(spark, sf):
    e = I.events_with_nulls(spark, sf).select("row_id", F.col("n_value").alias("v"))
    times = _events(spark, sf).select("row_id", "t_01")
    v = F.col("v")
    scans = {"n_cumsum__v": Scan("sum", v), "n_cummax__v": Scan("max", v)}
    return tidy(prefix_scan(e.join(times, "row_id"), ["t_01", "row_id"], scans).drop("t_01", "v"))


@query(
    "cum_prod",
    f"""select row_id, {rnd("product(1 + n_value / 1000) over (partition by c_user order by t_01, row_id rows unbounded preceding)",
      "n_cumprod__n_value")} from {EVENTS}""",
)
def cum_prod(spark, sf):
    e = _events(spark, sf).select("row_id", "c_user", "t_01", (F.lit(1) + F.col("n_value") / 1000).alias("v"))
    out = prefix_scan(e, ["t_01", "row_id"], {"n_cumprod__n_value": Scan("prod", F.col("v"))}, ["c_user"])
    return tidy(out.select("row_id", "n_cumprod__n_value"))


@query("row_index", f"select row_id, row_number() over (order by t_01, row_id) - 1 as position from {EVENTS}")
def index(spark, sf):
    return row_index(_events(spark, sf).select("row_id", "t_01"), ["t_01", "row_id"], "position").drop("t_01")


@query(
    "diff_prev",
    f"select row_id, {rnd('n_value - lag(n_value) over (order by t_01, row_id)', 'n_diff__n_value')} from {EVENTS}",
)
def diff_prev(spark, sf):
    e = lag(_events(spark, sf).select("row_id", "t_01", "n_value"), ["t_01", "row_id"], {"p": "n_value"})
    return tidy(e.select("row_id", (F.col("n_value") - F.col("p")).alias("n_diff__n_value")))


@query(
    "pct_rank",
    f"""with c as (select n_value, count(*) as n from {EVENTS} group by 1),
      r as (select n_value, sum(n) over (order by n_value) - (n - 1) / 2.0 as r from c)
    select row_id, {rnd("r / (select count(*) from events)", "n_percentile__n_value")} from {EVENTS} join r using (n_value)""",
)
def pct_rank(spark, sf):
    e = _events(spark, sf).select("row_id", "n_value")
    return tidy(A.average_rank(e, "n_value", "n_percentile__n_value").drop("n_value"))


@query(
    "time_since_prev",
    f"""select row_id, c_type, (epoch_us(t_01) - epoch_us(lag(t_01) over (partition by c_type order by t_01, row_id)))
      as micros from {EVENTS}""",
)
def time_since_prev(spark, sf):
    e = lag(_events(spark, sf).select("row_id", "c_type", "t_01"), ["t_01", "row_id"], {"p": "t_01"}, ["c_type"])
    return e.select("row_id", "c_type", (F.unix_micros("t_01") - F.unix_micros("p")).alias("micros"))


# ---------------------------------------------------------------------------- scalars


@query(
    "date_parts",
    f"""select row_id, year(t_01) as n_year__t_01, month(t_01) as n_month__t_01, day(t_01) as n_day__t_01,
      hour(t_01) as n_hour__t_01, minute(t_01) as n_minute__t_01, second(t_01) as n_second__t_01,
      weekofyear(t_01) as n_week__t_01, isodow(t_01) - 1 as n_weekday__t_01 from {EVENTS}""",
)
def date_parts(spark, sf):
    parts = [c.cast("bigint") for c in S.date_parts("t_01", list(S.DATE_PARTS))]
    return _events(spark, sf).select("row_id", *parts).toDF("row_id", *[f"n_{p}__t_01" for p in S.DATE_PARTS])


@query(
    "time_diff",
    """select o_orderkey, l_linenumber, l_partkey,
      abs(epoch_us(l_shipdate) - epoch_us(o_orderdate)) // 86400000000 as t_diff__o_orderdate__l_shipdate
    from orders join lineitem on o_orderkey = l_orderkey""",
)
def time_diff(spark, sf):
    o = I.table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    rows = o.join(I.table(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return tidy(rows.select("o_orderkey", "l_linenumber", "l_partkey", *S.time_differences(["o_orderdate", "l_shipdate"])))


@query(
    "time_bucket",
    f"""select {millis("date_trunc('day', t_01)")} as day, count(*) as n from {EVENTS} group by 1""",
)
def time_bucket(spark, sf):
    days = _events(spark, sf).groupBy(S.time_bucket("t_01", "day").alias("day"))
    return tidy(days.agg(F.count("*").alias("n")))


@query(
    "set_position",
    f"""select row_id, coalesce(list_position(m_words, c_word), 0) as word_at,
      coalesce(list_position(m_words, c_lang), 0) as lang_at from {DOCUMENTS}""",
)
def set_position(spark, sf):
    d = I.documents(spark, sf)
    at = [S.position_in_set(F.col(c), F.col("m_words")).alias(n) for c, n in (("c_word", "word_at"), ("c_lang", "lang_at"))]
    return tidy(d.select("row_id", *at))


@query(
    "first_element",
    """select l_orderkey, l_linenumber, l_partkey, try_cast(string_split(strftime(l_shipdate, '%d,%m,%Y'), ',')[1] as bigint) as base,
      len(string_split(strftime(l_shipdate, '%d,%m,%Y'), ',')) as size from lineitem""",
)
def first_element(spark, sf):
    m = S.split_set(F.date_format("l_shipdate", "dd,MM,yyyy"))
    rows = I.table(spark, sf, "lineitem")
    return tidy(rows.select("l_orderkey", "l_linenumber", "l_partkey", S.first_element(m).alias("base"), S.set_size(m).alias("size")))


@query(
    "pair_arith",
    f"""select c_order, c_part, {rnd("n_qty + n_tax", "n_qty_plus_n_tax")}, {rnd("n_qty - n_tax", "n_qty_minus_n_tax")},
      {rnd("n_qty * n_tax", "n_qty_multiple_n_tax")}, {rnd("n_tax / (n_qty + 1e-8)", "n_tax_divide_n_qty")} from {LINES}""",
)
def pair_arith(spark, sf):
    a = S.pair_arithmetic("n_qty", "n_tax")[:3]
    b = S.pair_arithmetic("n_tax", "n_qty")[3:]
    return tidy(I.order_lines(spark, sf).select("c_order", "c_part", *a, *b))


@query(
    "equal_width_bin",
    f"""with s as (select trunc(min(n_price)) as c, (max(n_price) - trunc(min(n_price))) / 10 as w from {LINES})
    select c_order, c_part, {rnd("n_price", "n_price")}, {rnd("floor((n_price - c) / w) * w + c", "n_price_disc")} from {LINES}, s""",
)
def equal_width_bin(spark, sf):
    lines = I.order_lines(spark, sf).select("c_order", "c_part", "n_price")
    return tidy(S.equal_width_bins(lines, ["n_price"]))


@query(
    "standardise",
    f"""with s as (select avg(n_qty) as m, stddev_samp(n_qty) as d from {LINES})
    select c_order, c_part, {rnd("(n_qty - m) / d", "n_qty_std", 4)} from {LINES}, s""",
)
def standardise(spark, sf):
    lines = I.order_lines(spark, sf).select("c_order", "c_part", "n_qty")
    return tidy(S.standardise(lines, ["n_qty"]).drop("n_qty"))


@query(
    "min_max_scale",
    f"""with s as (select min(n_price) as a, max(n_price) as b from {LINES})
    select c_order, c_part, {rnd("(n_price - a) / (b - a)", "n_price_mm")} from {LINES}, s""",
)
def min_max_scale(spark, sf):
    lines = I.order_lines(spark, sf).select("c_order", "c_part", "n_price")
    return tidy(S.min_max_scale(lines, ["n_price"]).drop("n_price"))


@query(
    "abs_mod_primitives",
    f"""select row_id, {rnd("abs(n_total - 250000)", "n_abs__shift")},
      {rnd("(n_total - 250000) - floor((n_total - 250000) / -7.5) * -7.5", "n_modulo__shift", 4)} from {ORDERS}""",
)
def abs_mod_primitives(spark, sf):
    shift = F.col("n_total") - F.lit(250000.0)
    o = I.main_orders(spark, sf)
    mod = S.floor_modulo(shift, F.lit(-7.5))
    return tidy(
        o.select("row_id", S.absolute(shift).alias("n_abs__shift"), F.round(mod, 4).alias("n_modulo__shift"))
    )


@query(
    "pair_expansion",
    f"""select c_part, {", ".join(rnd(f"{a} {op} {b}" if op != "/" else f"{a} / ({b} + 1e-8)", f"{a}_{w}_{b}")
        for a, b in (("n_size", "n_size"), ("n_size", "n_retail"), ("n_retail", "n_size"), ("n_retail", "n_retail"))
        for op, w in (("+", "plus"), ("-", "minus"), ("*", "multiple"), ("/", "divide")))} from {PARTS}""",
)
def pair_expansion(spark, sf):
    """Both picks cover both columns, whatever the seed, since there are only two."""
    p = I.parts(spark, sf)
    picks = G.pick_pairs(["n_size", "n_retail"], seed=4)
    out = G.expand_pairs(p, picks)
    return tidy(out.select("c_part", *[c for c in out.columns if c not in p.columns]))


# --------------------------------------------------------------------------- encoders


@query(
    "freq_encode",
    f"""select row_id, c_user, {rnd("count(*) over (partition by c_user) * 1.0 / (select count(*) from events)", "n_freq__c_user")}
    from {EVENTS}""",
)
def freq_encode(spark, sf):
    return tidy(E.frequency_encode(_events(spark, sf).select("row_id", "c_user"), "c_user"))


@query(
    "factorize",
    f"""with f as (select c_user, min(row_id) as f from {EVENTS} group by 1),
      d as (select c_user, row_number() over (order by f) - 1 as code from f)
    select row_id, d.code as c_user from {EVENTS} e join d using (c_user)""",
)
def factorize(spark, sf):
    e = _events(spark, sf).select("row_id", F.col("c_user").cast("string"))
    return tidy(E.factorize(e, "c_user"))


@query(
    "one_hot_top_n",
    f"""with r as (select c_brand, row_number() over (order by count(*) desc, c_brand) as r from {PARTS} group by 1)
    select c_part, cast(r = 1 as bigint) as c_c_brand__dummy_1, cast(r = 2 as bigint) as c_c_brand__dummy_2,
      cast(r = 3 as bigint) as c_c_brand__dummy_3, cast(r > 3 as bigint) as c_c_brand__dummy_rest
    from {PARTS} join r using (c_brand)""",
)
def one_hot_top_n(spark, sf):
    p = I.parts(spark, sf).select("c_part", "c_brand")
    out = E.CategoryEncoder.fit(p, ["c_brand"], "c_part", one_hot=3).transform(p, code=False, freq=False)
    return tidy(out.drop("c_brand"))


_WORD_RANKS = f"""x as (select row_id, unnest(m_words) as v from {DOCUMENTS}),
  r as (select v, row_number() over (order by count(*) desc, v) - 1 as r, count(*) as n from x group by v)"""


@query(
    "mv_code",
    f"with {_WORD_RANKS} select row_id, min(least(r, 1000)) as c_mvcode__m_words from x join r using (v) group by row_id",
)
def mv_code(spark, sf):
    d = I.documents(spark, sf).select("row_id", "m_words")
    return tidy(E.MultiCategoryEncoder.fit(d, ["m_words"], "code").transform(d))


@query("mv_count", f"select row_id, len(m_words) as c_mvcount__m_words from {DOCUMENTS}")
def mv_count(spark, sf):
    d = I.documents(spark, sf).select("row_id", "m_words")
    return tidy(E.MultiCategoryEncoder.fit(d, ["m_words"], "count").transform(d))


@query(
    "mv_freq",
    f"""with {_WORD_RANKS}, t as (select sum(n) as t from r)
    select row_id, {rnd("sum(n / t)", "n_mvfreq_sum__m_words")}, {rnd("avg(n / t)", "n_mvfreq_mean__m_words")},
      {rnd("coalesce(stddev_samp(n / t), 0)", "n_mvfreq_std__m_words", 4)} from x join r using (v), t group by row_id""",
)
def mv_freq(spark, sf):
    return tidy(E.multi_frequency(I.documents(spark, sf).select("row_id", "m_words"), "m_words").drop("m_words"))


@query(
    "num_by_cat",
    f"""select c_order, c_part, {rnd("avg(n_price) over (partition by c_supp)", "n_mean__n_price__by__c_supp", 4)},
      {rnd("max(n_price) over (partition by c_supp)", "n_max__n_price__by__c_supp")},
      count(*) over (partition by c_supp) as n_count__c_supp from {LINES}""",
)
def num_by_cat(spark, sf):
    lines = I.order_lines(spark, sf).select("c_order", "c_part", "c_supp", "n_price")
    out = E.group_statistics(lines, ["c_supp"], ["n_price"], statistics=["mean", "max"]).drop("c_supp", "n_price")
    return tidy(out.withColumn("n_mean__n_price__by__c_supp", F.round("n_mean__n_price__by__c_supp", 4)))


@query(
    "nunique_by_cat",
    f"""with g as (select c_supp, count(distinct c_part) as n from {LINES} group by 1)
    select l.c_order, l.c_part, g.n as n_nunique__c_part__by__c_supp from {LINES} l join g using (c_supp)""",
)
def nunique_by_cat(spark, sf):
    lines = I.order_lines(spark, sf).select("c_order", "c_part", "c_supp")
    return E.group_statistics(lines, ["c_supp"], category=["c_part"]).drop("c_supp", "n_count__c_supp")


@query(
    "cat_pair_freq",
    f"""select row_id, {rnd("count(*) over (partition by c_status, c_priority) * 1.0 / (select count(*) from orders)",
      "n_freq__c_status__c_priority")} from {ORDERS}""",
)
def cat_pair_freq(spark, sf):
    o = I.main_orders(spark, sf).select("row_id", "c_status", "c_priority")
    return tidy(E.pair_frequency(o, "c_status", "c_priority").drop("c_status", "c_priority"))


@query(
    "category_pairs",
    f"""select row_id, c_status || '_' || c_priority as c_c_status__x__c_priority,
      {rnd("count(*) over (partition by c_status, c_priority) * 1.0 / (select count(*) from orders)",
      "n_freq__c_c_status__x__c_priority")} from {ORDERS}""",
)
def category_pairs(spark, sf):
    o = I.main_orders(spark, sf).select("row_id", "c_status", "c_priority")
    return tidy(G.category_pairs(o, ["c_status", "c_priority"]).drop("c_status", "c_priority"))


@query(
    "time_bucket_stats",
    f"""select row_id, {millis("date_trunc('day', t_01)")} as t_day__t_01, count(*) over w as n_count__t_day__t_01_c_type,
      {rnd("sum(n_value) over w", "n_sum__n_value__by__t_day__t_01_c_type", 4)} from {EVENTS}
    window w as (partition by date_trunc('day', t_01), c_type)""",
)
def time_bucket_stats(spark, sf):
    e = _events(spark, sf).select("row_id", "c_type", "n_value", "t_01")
    out = G.bucket_statistics(e, "t_01", "c_type", ["n_value"], statistics=["sum"]).drop("c_type", "n_value", "t_01")
    return tidy(out, 4)


@query(
    "entity_stats",
    f"""with g as (select c_part, count(*) as n, count(distinct c_supp) as d, sum(n_price) as m, max(n_price) as x from {LINES} group by 1)
    select c_order, l.c_part, g.n as lines, g.d as suppliers, {rnd("g.m", "sum_price", 4)}, {rnd("g.x", "max_price")}
    from {LINES} l join g using (c_part)""",
)
def entity_stats(spark, sf):
    lines = I.order_lines(spark, sf).select("c_order", "c_part", "c_supp", "n_price")
    aggs = {
        "lines": F.count("*"), "suppliers": F.count_distinct("c_supp"),
        "sum_price": F.round(F.sum("n_price"), 4), "max_price": F.max("n_price"),
    }
    return tidy(attach_statistics(lines, ["c_part"], aggs).drop("c_supp", "n_price"))


@query(
    "first_order_combo",
    f"""with g as (select c_user, count(*) as n, avg(n_value) as m, sum(n_value) as s, count(distinct c_type) as d from {EVENTS} group by 1),
      h as (select c_user, c_type, count(*) as n from {EVENTS} group by 1, 2)
    select row_id, g.n as n_count__c_user, {rnd("g.m", "n_mean__n_value__by__c_user", 4)}, {rnd("g.s", "n_sum__n_value__by__c_user", 4)},
      g.d as n_nunique__c_type__by__c_user, h.n as n_count__c_user_c_type
    from {EVENTS} e join g using (c_user) join h using (c_user, c_type)""",
)
def first_order_combo(spark, sf):
    e = _events(spark, sf).select("row_id", "c_user", "c_type", "n_value")
    return tidy(G.first_order(e, ["c_user"], ["n_value"], ["c_type"]).drop("c_user", "c_type", "n_value"), 4)


@query(
    "ctr_expanding",
    f"""select row_id, c_user, {rnd("(coalesce(sum(label) over w, 0) + 0.2 * 10) / (count(*) over w + 10)", "n_ctr__c_user")} from {EVENTS}
    window w as (partition by c_user order by t_01, row_id rows between unbounded preceding and 1 preceding)""",
)
def ctr_expanding(spark, sf):
    e = _events(spark, sf).select("row_id", "c_user", "t_01", "label")
    out = E.target_mean_expanding(e, "c_user", ["t_01", "row_id"], prior=0.2, prior_weight=10)
    return tidy(out.drop("t_01", "label"))


_FOLDED = f"""(select *, (row_number() over (partition by label order by md5('7|' || row_id)) - 1) % 5 as fold from {EVENTS})"""


@query(
    "ctr_oof",
    f"""with f as {_FOLDED}, g as (select c_user, fold, sum(label) as s, count(*) as n from f group by 1, 2),
      t as (select c_user, sum(s) as s, sum(n) as n from g group by 1)
    select row_id, c_user, fold, {rnd("(t.s - g.s + 0.2 * 10) / (t.n - g.n + 10)", "n_ctr__c_user")}
    from f join g using (c_user, fold) join t using (c_user)""",
)
def ctr_oof(spark, sf):
    e = folds(_events(spark, sf).select("row_id", "c_user", "label"), seed=7)
    out = E.target_mean_out_of_fold(e, "c_user", prior=0.2, prior_weight=10).drop("label")
    return tidy(out)


def _bucket(value: str, buckets: int) -> str:
    return f"cast('0x' || substr(md5({value}), 1, 12) as bigint) % {buckets}"


@query(
    "hash_encode",
    f"""select row_id, {_bucket("c_source", 32)} as c_source, array_to_string(list_sort(list_distinct(
      list_transform(m_words, lambda x: {_bucket("x", 64)}))), ',') as m_words from {DOCUMENTS}""",
)
def hash_encode(spark, sf):
    d = I.documents(spark, sf)
    sets = F.array_join(E.hash_code_set("m_words", 64).cast("array<string>"), ",")
    return tidy(d.select("row_id", E.hash_code("c_source", 32).alias("c_source"), sets.alias("m_words")))


_LEVELS = "with f as (select o_orderpriority as p, min(o_orderkey) as f from orders group by 1), l as (select p, row_number() over (order by f) as i, count(*) over () as k from f)"


@query(
    "contrast_encode",
    f"""{_LEVELS} select o_orderkey as row_id, {", ".join(
        rnd(f"case when i <= {j} then -(k - {j}) * 1.0 / k else {j} * 1.0 / k end", f"n_c_priority__bd_{j}") for j in range(1, 5))}
    from orders join l on o_orderpriority = p""",
)
def contrast_encode(spark, sf):
    o = I.main_orders(spark, sf)
    levels = E.contrast_levels(o, "c_priority")
    return tidy(o.select("row_id", *E.contrast_columns("c_priority", levels)))


@query(
    "categorical_dispatch",
    f"""select row_id, {rnd("count(*) over (partition by c_lang) * 1.0 / (select count(*) from documents)", "c_lang")},
      {rnd("count(*) over (partition by c_source) * 1.0 / (select count(*) from documents)", "c_source")},
      len(m_words) as m_words from {DOCUMENTS}""",
)
def categorical_dispatch(spark, sf):
    d = I.documents(spark, sf).select("row_id", "c_lang", "c_source", "m_words")
    return tidy(E.encode_by_method(d, "freq", "count"))


@query(
    "categorical_dispatch_codes",
    f"""with a as (select c_status as v, row_number() over (order by min(row_id)) - 1 as a from {ORDERS} group by 1),
      b as (select c_priority as v, row_number() over (order by min(row_id)) - 1 as b from {ORDERS} group by 1)
    select row_id, a as c_status, b as c_priority, {rnd("n_total", "n_total")} from {ORDERS} o
    join a on a.v = c_status join b on b.v = c_priority""",
)
def categorical_dispatch_codes(spark, sf):
    o = I.main_orders(spark, sf).select("row_id", "c_status", "c_priority", "n_total", "t_01")
    return tidy(G.baseline(o, "fact"))


# ------------------------------------------------------------------------- generation

_GEN_PARTS = ", ".join(f"{p}(t_01) * 1.0 as n_{p}__t_01" for p in ("month", "day", "hour", "minute", "second"))


@query(
    "generate_default",
    f"""with e as {EVENTS}, tot as (select count(*) as t from e),
      a as (select c_user as v, row_number() over (order by min(row_id)) - 1 as code, count(*) as n from e group by 1),
      b as (select c_type as v, row_number() over (order by min(row_id)) - 1 as code, count(*) as n from e group by 1)
    select row_id, label, a.code as c_user, b.code as c_type, {rnd("a.n / t", "n_freq__c_user")}, {rnd("b.n / t", "n_freq__c_type")},
      {rnd("n_value", "n_value")}, {rnd("sum(n_value) over w", "n_cumsum__n_value")},
      {rnd_half_up(f"cast(sum({_CENTS}) over w as double) / (100.0 * count(*) over w)", "n_cummean__n_value")}, {rnd("max(n_value) over w", "n_cummax__n_value")},
      {rnd("min(n_value) over w", "n_cummin__n_value")}, {_GEN_PARTS}
    from e join a on a.v = c_user join b on b.v = c_type, tot window w as (order by row_id rows unbounded preceding)""",
)
def generate_default(spark, sf):
    e = _events(spark, sf, exact=True)
    gen = G.FeatureGenerator("t_01", passthrough=("label",))
    return tidy(gen.fit_transform(e))


@query(
    "generate_documents",
    f"""with d as {DOCUMENTS}, {_WORD_RANKS}, code as (select row_id, min(least(r, 1000)) as c from x join r using (v) group by row_id),
      s as (select c_source as v, row_number() over (order by min(row_id)) - 1 as code, count(*) as n from d group by 1),
      g as (select c_lang as v, row_number() over (order by min(row_id)) - 1 as code, count(*) as n from d group by 1)
    select d.row_id, s.code as c_source, g.code as c_lang, {rnd("s.n * 1.0 / (select count(*) from d)", "n_freq__c_source")},
      {rnd("g.n * 1.0 / (select count(*) from d)", "n_freq__c_lang")}, code.c as c_mvcode__m_words, {rnd("n_chars", "n_chars")},
      {rnd("sum(n_chars) over w", "n_cumsum__n_chars")}, {rnd_half_up("sum(n_chars) over w / count(*) over w", "n_cummean__n_chars")},
      {rnd("max(n_chars) over w", "n_cummax__n_chars")}, {rnd("min(n_chars) over w", "n_cummin__n_chars")}
    from d join code using (row_id) join s on s.v = c_source join g on g.v = c_lang
    window w as (order by d.row_id rows unbounded preceding)""",
)
def generate_documents(spark, sf):
    d = I.documents(spark, sf).select("row_id", "c_source", "c_lang", "m_words", "n_chars")
    return tidy(G.FeatureGenerator("t_01").fit_transform(d))


@query(
    "joint_scope",
    f"""with e as {EVENTS}, t as (select *, row_number() over (order by label desc, row_id) as o from e),
      a as (select c_user as v, row_number() over (order by min(o)) - 1 as code, count(*) as n from t group by 1),
      g as (select row_id, label, a.code as c_user, {rnd("a.n * 1.0 / (select count(*) from e)", "n_freq__c_user")},
        {rnd("n_value", "n_value")}, {rnd("sum(n_value) over w", "n_cumsum__n_value")}
        from t join a on a.v = c_user window w as (order by o rows unbounded preceding))
    select * exclude (label) from g where label = 0""",
)
def joint_scope(spark, sf):
    """Train rows are the purchases, test rows all others; features come from both stacked."""
    e = _events(spark, sf).select("row_id", "c_user", "n_value", "label")
    gen = G.FeatureGenerator("t_01", cumulative=("sum",), passthrough=("label",))
    _, test = gen.fit_joint(e.filter("label = 1"), e.filter("label = 0"))
    return tidy(test.drop("label"))


@query(
    "depth1_primitives",
    f"""with e as {EVENTS} select row_id, {rnd("n_value", "n_value")}, {rnd("abs(n_value)", "n_abs__n_value")},
      {rnd("n_value - lag(n_value) over (order by row_id)", "n_diff__n_value")}, {rnd("max(n_value) over w", "n_cummax__n_value")},
      count(*) over w as n_cumcount, year(t_01) * 1.0 as n_year__t_01, week(t_01) * 1.0 as n_week__t_01,
      {rnd("count(*) over (partition by c_user) * 1.0 / (select count(*) from e)", "c_user")}
    from e window w as (order by row_id rows unbounded preceding)""",
)
def depth1_primitives(spark, sf):
    e = _events(spark, sf).select("row_id", "c_user", "n_value", "t_01")
    out = G.synthesise(e, ["absolute", "diff", "cum_max", "cum_count", "year", "week"])
    return tidy(out.drop("t_01"))


@query(
    "aggregate_primitives",
    f"""select c_user, count(*) as n_count__c_user, {rnd("stddev_samp(n_value)", "n_std__n_value", 4)}, {rnd("min(n_value)", "n_min__n_value")},
      {rnd("max(n_value)", "n_max__n_value")}, {rnd("avg(n_value)", "n_mean__n_value", 6)} from {EVENTS} group by c_user""",
)
def aggregate_primitives(spark, sf):
    return tidy(G.aggregate_primitives(_events(spark, sf), "c_user", ["std", "min", "max", "mean", "count"], ["n_value"]))


@query("percent_true", f"select c_user, {rnd('avg(label)', 'n_percent_true__label')} from {EVENTS} group by 1")
def percent_true(spark, sf):
    out = G.aggregate_primitives(_events(spark, sf), "c_user", ["percent_true"], [], flags=["label"])
    return tidy(out)


@query(
    "last_value",
    f"""select c_user, {rnd("arg_max(n_value, row_id)", "n_last__n_value")}, arg_max(c_type, row_id) as c_last__c_type
    from {EVENTS} group by 1""",
)
def last_value(spark, sf):
    return tidy(G.aggregate_primitives(_events(spark, sf), "c_user", ["last"], ["n_value"], ["c_type"]))


@query(
    "trend",
    f"""select c_user, {rnd("regr_slope(n_value, epoch_us(t_01) / 1e6) * 86400", "n_trend__n_value", 4)} from {EVENTS} group by 1""",
)
def trend(spark, sf):
    out = G.aggregate_primitives(_events(spark, sf), "c_user", ["trend"], ["n_value"], time="t_01")
    return tidy(out.withColumn("n_trend__n_value", F.col("n_trend__n_value") * 86400), 4)


@query(
    "n_most_common",
    f"""with c as (select c_user, c_type, count(*) as n from {EVENTS} group by 1, 2),
      r as (select *, row_number() over (partition by c_user order by n desc, c_type) as r from c)
    select c_user, max(case when r = 1 then c_type end) as top1_c_type, max(case when r = 2 then c_type end) as top2_c_type,
      max(case when r = 3 then c_type end) as top3_c_type from r group by 1""",
)
def n_most_common(spark, sf):
    return A.most_common(_events(spark, sf), "c_user", "c_type", 3)


@query("expand_select")
def expand_select(spark, sf):
    """Expand on a sample, keep the five features most correlated with the label, build those."""
    from relweave.functions.aggregates import label_correlations
    from relweave.operators.selection import top_features

    lines = I.order_lines(spark, sf).withColumn("label", (F.col("c_flag") == "R").cast("int"))
    keyed = lines.withColumn("row_id", F.xxhash64(*lines.columns))
    nums = ["n_qty", "n_price", "n_disc", "n_tax"]

    def choose(sample):
        new = [c for c in sample.columns if c.startswith("n_") and c not in nums]
        scores = label_correlations(sample, new, "label").withColumn("a", F.abs("score"))
        return top_features(scores, 5, "a")

    picks = G.pick_pairs(nums, seed=1)
    base = keyed.select("row_id", "label", *nums)
    return tidy(G.expand_and_select(base, lambda d: G.expand_pairs(d, picks), choose))
