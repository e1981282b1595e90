"""Queries over sources, cleaning, joins and aggregation."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from relweave.functions import aggregates as A
from relweave.functions.ordered import row_index
from relweave.functions.rolling import rolling
from relweave.functions.scalars import domains_intersect, epoch_millis_to_timestamp
from relweave.operators import clean as C
from relweave.operators.encode import align_to_schema
from relweave.operators.merge import MergeOptions, bind_columns, merge_tables, to_many_join, to_one_join
from relweave.operators.temporal import as_of_join, as_of_joins, rolling_join, tagged_union
from relweave.plans import inputs as I
from relweave.plans.catalog import (
    CUSTOMERS,
    EVENTS,
    EVENTS_NULLS,
    LINES,
    ORDERS,
    PARTS,
    millis,
    query,
    rnd,
    stat_list,
    tidy,
)
from relweave.schema import columns_of, keep_columns
from relweave.session import shared_dir
from relweave.sources.tables import attach_label, read_main, read_table, with_file_order, write_predictions, write_table

# ------------------------------------------------------------------------------ merging

_LINE_NUMS = ["n_qty", "n_price", "n_disc", "n_tax", "n_table_3__n_size", "n_table_3__n_retail"]
_LINE_CATS = ["c_part", "c_supp", "c_flag", "c_line", "c_table_3__c_brand", "c_table_3__c_type"]


def _star_sql() -> str:
    items = ["count(*) as n_count__c_order", stat_list(_LINE_NUMS)]
    items += [f"count({c}) as n_count__{c}" for c in _LINE_CATS]
    names = [f"n_{s}__{c}" for c in _LINE_NUMS for s in ("mean", "sum", "std", "median", "min", "max")]
    names += ["n_count__c_order"] + [f"n_count__{c}" for c in _LINE_CATS]
    joined = ", ".join(f"g.{n} as n_table_2__{n}" for n in names)
    return f"""
with lines as (
  select l.*, p.c_brand as c_table_3__c_brand, p.c_type as c_table_3__c_type, p.n_size as n_table_3__n_size,
    p.n_retail as n_table_3__n_retail
  from {LINES} l left join {PARTS} p using (c_part)),
g as (select c_order, {", ".join(items)} from lines group by c_order)
select m.row_id, m.c_cust, m.c_order, m.c_status, m.c_priority, {rnd("m.n_total", "n_total")}, {millis("m.t_01")} as t_01,
  c.c_nation as c_table_1__c_nation, c.c_segment as c_table_1__c_segment, {rnd("c.n_acctbal", "n_table_1__n_acctbal")},
  cast(n.n_regionkey as varchar) as c_table_1__c_table_4__c_region, n.n_name as c_table_1__c_table_4__c_nname,
  r.r_name as c_table_1__c_table_4__c_table_5__c_rname, {joined}
from {ORDERS} m left join {CUSTOMERS} c using (c_cust)
left join nation n on cast(n.n_nationkey as varchar) = c.c_nation
left join region r on r.r_regionkey = n.n_regionkey
left join g on g.c_order = m.c_order"""


@query("merge_tables_star", _star_sql())
def merge_tables_star(spark, sf):
    return tidy(merge_tables(I.star(spark, sf)))


@query(
    "to_one_join",
    f"""select m.row_id, m.c_cust, m.c_status, {rnd("m.n_total", "n_total")}, c.c_nation as c_cust__c_nation,
    c.c_segment as c_cust__c_segment, {rnd("c.n_acctbal", "n_cust__n_acctbal")}
    from {ORDERS} m left join {CUSTOMERS} c using (c_cust)""",
)
def to_one(spark, sf):
    u = I.main_orders(spark, sf).select("row_id", "c_cust", "c_status", "n_total")
    return tidy(to_one_join(u, I.customers(spark, sf), "cust", "c_cust"))


_ORDER_STATS = ", ".join(f"g.n_{s}__n_total as n_ord__n_{s}__n_total" for s in ("mean", "sum", "std", "median", "min", "max"))


@query(
    "to_many_join",
    f"""with g as (select c_cust, count(*) as n_count__c_cust, count(c_order) as n_count__c_order,
      count(c_status) as n_count__c_status, count(c_priority) as n_count__c_priority, {stat_list(["n_total"])}
      from {ORDERS} group by c_cust)
    select c.c_cust, c.c_segment, {rnd("c.n_acctbal", "n_acctbal")}, g.n_count__c_cust as n_ord__n_count__c_cust,
      g.n_count__c_order as n_ord__n_count__c_order, g.n_count__c_status as n_ord__n_count__c_status,
      g.n_count__c_priority as n_ord__n_count__c_priority, {_ORDER_STATS}
    from {CUSTOMERS} c left join g using (c_cust)""",
)
def to_many(spark, sf):
    u = I.customers(spark, sf).select("c_cust", "c_segment", "n_acctbal")
    return tidy(to_many_join(u, I.main_orders(spark, sf).drop("row_id"), "ord", "c_cust"))


_VIEWS = "(select * from e where c_type = 'view')"
_BUYS = "(select * from e where c_type = 'purchase')"


def _buys_and_views(spark, sf):
    e = I.events(spark, sf)
    u = e.filter("c_type = 'purchase'").select("row_id", "c_user", "t_01")
    v = e.filter("c_type = 'view'").select("row_id", "c_user", "t_01", "c_type", "n_value")
    return u, v


@query(
    "asof_join",
    f"""with e as {EVENTS} select u.row_id, u.c_user, {millis("u.t_01")} as t_01, v.row_id as row_view__row_id,
      {millis("v.t_01")} as t_view__t_01, v.c_type as c_view__c_type, {rnd("v.n_value", "n_view__n_value")}
    from {_BUYS} u asof left join {_VIEWS} v on u.c_user = v.c_user and u.t_01 > v.t_01""",
)
def asof(spark, sf):
    u, v = _buys_and_views(spark, sf)
    return tidy(as_of_join(u, v, "view", "c_user", "t_01", v_order=["row_id"]))


@query(
    "asof_join_tolerance",
    f"""with e as {EVENTS}, j as (select u.row_id, u.t_01, v.row_id as vid, v.t_01 as vt, v.n_value
      from {_BUYS} u asof left join {_VIEWS} v on u.c_user = v.c_user and u.t_01 >= v.t_01)
    select row_id, case when t_01 - vt <= interval 1 day then vid end as row_view__row_id,
      case when t_01 - vt <= interval 1 day then {rnd("n_value")} end as n_view__n_value from j""",
)
def asof_tolerance(spark, sf):
    u, v = _buys_and_views(spark, sf)
    j = as_of_join(u, v, "view", "c_user", "t_01", v_order=["row_id"], allow_exact=True, tolerance_seconds=86_400)
    return tidy(j.select("row_id", "row_view__row_id", "n_view__n_value"))


_SIDES = ("view", "click", "error")


@query(
    "asof_join_three",
    f"""with e as {EVENTS}, u as {_BUYS} select u.row_id, u.c_user, {millis("u.t_01")} as t_01, """
    + ", ".join(f"{s}.row_id as row_{s}__row_id, {millis(f'{s}.t_01')} as t_{s}__t_01, {rnd(f'{s}.n_value', f'n_{s}__n_value')}" for s in _SIDES)
    + " from u "
    + " ".join(
        f"left join (select u.row_id as uid, v.* from u asof join (select * from e where c_type = '{s}') v on u.c_user = v.c_user and u.t_01 > v.t_01) {s} on {s}.uid = u.row_id"
        for s in _SIDES
    ),
)
def asof_three(spark, sf):
    e = I.events(spark, sf)
    u = e.filter("c_type = 'purchase'").select("row_id", "c_user", "t_01")
    sides = {s: e.filter(F.col("c_type") == s).select("row_id", "c_user", "t_01", "n_value") for s in _SIDES}
    return tidy(as_of_joins(u, sides, "c_user", "t_01", orders={s: ["row_id"] for s in _SIDES}))


def _rolling_sql(partition: str, window: str, literal: bool) -> str:
    frame = f"over ({partition} order by t_01, side, row_id rows between {window} preceding and current row)"
    items = []
    for s, f in (("mean", "avg"), ("sum", "sum"), ("std", "stddev_samp"), ("median", "median"), ("min", "min"), ("max", "max")):
        name = f"n_{s}_rolling__view__n_value"
        items.append(f"cast(null as double) as {name}" if literal else rnd(f"{f}(n_value) {frame}", name, 4))
    return f"""with e as {EVENTS},
  w as (select cast(greatest(5, floor(count(*) * 0.0001)) as bigint) as w, count(*) as n from {_BUYS}),
  line as (
    select row_id, c_user, t_01, 0 as side, null as c_type, cast(null as double) as n_value from {_BUYS}
    union all select row_id, c_user, t_01, 1, c_type, n_value from {_VIEWS}),
  r as (select row_id, c_user, side, {", ".join(items)},
      cast(count(c_type) {frame} as double) as n_count_rolling__view__c_type
    from line, w)
  select * exclude (side) from r where side = 0"""


def _rolled(spark, sf, **kw):
    u, v = _buys_and_views(spark, sf)
    out = rolling_join(u, v, "view", "c_user", "t_01", v_order=["row_id"], **kw)
    return tidy(out.drop("t_01"), 4)


@query("temporal_rolling_keyed", _rolling_sql("partition by c_user", "4", False))
def temporal_rolling_keyed(spark, sf):
    return _rolled(spark, sf, window=5, scope="key", min_periods=1)


@query("temporal_rolling_stream", _rolling_sql("", "(w - 1)", True))
def temporal_rolling_stream(spark, sf):
    return _rolled(spark, sf)


@query("temporal_rolling_stream_partial", _rolling_sql("", "(w - 1)", False))
def temporal_rolling_stream_partial(spark, sf):
    return _rolled(spark, sf, min_periods=1)


# Means of hundreds of amounts in cents often lie just between two rounded numbers; scaled by this, none does.
_ROOT = 1.4142135623730951


@query("temporal_rolling_wide", _rolling_sql("", "999", False).replace("t_01, 1, c_type, n_value", f"t_01, 1, c_type, n_value * {_ROOT}e0"))
def temporal_rolling_wide(spark, sf):
    u, v = _buys_and_views(spark, sf)
    v = v.withColumn("n_value", F.col("n_value") * _ROOT)
    return tidy(rolling_join(u, v, "view", "c_user", "t_01", v_order=["row_id"], window=1_000, min_periods=1).drop("t_01"), 4)


@query(
    "hash_bucket_rolling",
    _rolling_sql(
        "partition by c_user % (case when n / 200 > 100 then 200 else greatest(n // 100, 1) end)", "4", False
    ),
)
def hash_bucket_rolling(spark, sf):
    return _rolled(spark, sf, window=5, scope="bucket", min_periods=1, bucket_hash=F.col("__k"))


@query(
    "rolling_keyed",
    f"""select row_id, c_user, case when count(n_value) over w = 3 then {rnd("sum(n_value) over w", None, 4)} end as sum3,
      case when count(n_value) over w = 3 then {rnd("max(n_value) over w", None, 4)} end as max3
    from {EVENTS} window w as (partition by c_user order by t_01, row_id rows between 2 preceding and current row)""",
)
def rolling_keyed(spark, sf):
    e = I.events(spark, sf).select("row_id", "c_user", "t_01", "n_value")
    out = rolling(e, ["t_01", "row_id"], 3, {"sum3": ("sum", "n_value"), "max3": ("max", "n_value")}, ["c_user"])
    return tidy(out.drop("t_01", "n_value"), 4)


@query(
    "rolling_wide_keyed",
    f"""select row_id, c_type, {", ".join(rnd(f"{f}(n_value * {_ROOT}e0) over w", n, 4) for n, f in
        (("mean", "avg"), ("std", "stddev_samp"), ("median", "median"), ("low", "min")))}, count(n_value) over w as n
    from {EVENTS} window w as (partition by c_type order by t_01, row_id rows between 299 preceding and current row)""",
)
def rolling_wide_keyed(spark, sf):
    e = I.events(spark, sf).select("row_id", "c_type", "t_01", (F.col("n_value") * _ROOT).alias("n_value"))
    aggs = {"mean": ("mean", "n_value"), "std": ("std", "n_value"), "median": ("median", "n_value"), "low": ("min", "n_value")}
    out = rolling(e, ["t_01", "row_id"], 300, {**aggs, "n": ("count", "n_value")}, ["c_type"], 1)
    return tidy(out.drop("t_01", "n_value"), 4)


@query(
    "tagged_union",
    f"""select row_id, c_user, c_type, {rnd("n_value", "n_value")}, {millis("t_01")} as t_01, 'u' as side from {EVENTS} where label = 1
    union all select row_id, null, null, {rnd("n_total")}, {millis("t_01")}, 'v' from {ORDERS}""",
)
def tagged(spark, sf):
    u = I.events(spark, sf).filter("label = 1").drop("label")
    v = I.main_orders(spark, sf).select("row_id", "t_01", F.col("n_total").alias("n_value"))
    return tidy(tagged_union(u, v))


@query(
    "column_bind",
    f"""select row_id, a.c_type, {rnd("a.n_value", "n_value")}, b.c_user from
      (select row_id, c_type, n_value from {EVENTS} where n_value > 20) a
      full join (select row_id, c_user from {EVENTS} where label = 1) b using (row_id) order by row_id""",
)
def column_bind(spark, sf):
    e = I.events(spark, sf)
    left = e.filter("n_value > 20").select("row_id", "c_type", "n_value")
    return tidy(bind_columns(left, e.filter("label = 1").select("row_id", "c_user"), how="full").orderBy("row_id"))


@query(
    "domain_intersect",
    """select cast(exists (select l_returnflag from lineitem intersect select o_orderstatus from orders) as bigint) as flag_status,
      cast(exists (select unnest(string_split(p_name, ' ')) from part intersect select p_brand from part) as bigint) as name_brand,
      cast(exists (select unnest(string_split(p_type, ' ')) from part intersect select p_type from part) as bigint) as type_type""",
)
def domain_intersect(spark, sf):
    part = I.table(spark, sf, "part")
    named = part.select(F.split("p_name", " ").alias("m"), F.col("p_brand").alias("c"))
    typed = part.select(F.split("p_type", " ").alias("m"), F.col("p_type").alias("c"))
    flags = I.order_lines(spark, sf).select(F.col("c_flag").alias("v")).distinct()
    status = I.main_orders(spark, sf).select(F.col("c_status").alias("v")).distinct()
    one = int(not flags.intersect(status).isEmpty())
    two, three = int(domains_intersect(named, "c", "m")), int(domains_intersect(typed, "c", "m"))
    return spark.createDataFrame([(one, two, three)], "flag_status long, name_brand long, type_type long")


# ---------------------------------------------------------------------- sources, labels


@query(
    "epoch_ms_parse",
    f"""select row_id, case when row_id % 11 <> 0 then {millis("t_01")} end as t_01 from {EVENTS}""",
)
def epoch_ms_parse(spark, sf):
    e = I.events(spark, sf)
    text = F.when(F.col("row_id") % 11 == 0, "NaN").otherwise(F.unix_millis("t_01").cast("string"))
    return tidy(e.select("row_id", epoch_millis_to_timestamp(text).alias("t_01")))


@query(
    "label_attach",
    f"""select o.row_id, o.c_status, case when o.c_priority in ('1-URGENT', '2-HIGH') then 1 else 0 end as label
    from {ORDERS} o""",
)
def label_attach(spark, sf):
    main = row_index(I.main_orders(spark, sf), ["row_id"], "position")
    urgent = F.when(F.col("c_priority").isin("1-URGENT", "2-HIGH"), 1).otherwise(0)
    labels = row_index(I.main_orders(spark, sf).select("row_id", urgent.alias("label")), ["row_id"], "position")
    return tidy(attach_label(main, labels, "position").select("row_id", "c_status", "label"))


# ----------------------------------------------------------------------------- cleaning


@query(
    "missing_profile",
    f"""with e as {EVENTS_NULLS} """
    + " union all ".join(
        f"select '{c}' as \"column\", {rnd(f'avg(case when {c} is null then 1.0 else 0.0 end)', 'missing_ratio')} from e"
        for c in ("row_id", "c_user", "c_type", "n_value", "t_01", "n_sparse", "label")
    ),
)
def missing_profile(spark, sf):
    return tidy(C.missing_profile(I.events_with_nulls(spark, sf)))


@query(
    "drop_sparse",
    f"select row_id, c_user, c_type, {rnd('n_value', 'n_value')}, {millis('t_01')} as t_01, label from {EVENTS_NULLS}",
)
def drop_sparse(spark, sf):
    return tidy(C.drop_sparse_columns(I.events_with_nulls(spark, sf)))


def _cleaned(spark, sf, **kw):
    e = I.events_with_nulls(spark, sf)
    return C.Cleaner.fit(e, **kw).transform(e)


@query(
    "impute_mean",
    f"with e as {EVENTS_NULLS} select row_id, {rnd('coalesce(n_value, (select avg(n_value) from e))', 'n_value')} from e",
)
def impute_mean(spark, sf):
    return tidy(_cleaned(spark, sf).select("row_id", "n_value"))


@query(
    "impute_median",
    f"with e as {EVENTS_NULLS} select row_id, {rnd('coalesce(n_value, (select median(n_value) from e))', 'n_value')} from e",
)
def impute_median(spark, sf):
    return tidy(_cleaned(spark, sf, numeric="median").select("row_id", "n_value"))


@query(
    "impute_numeric_mode",
    f"""with e as {EVENTS_NULLS}, m as (select n_value from e where n_value is not null group by 1 order by count(*) desc, 1 limit 1)
    select row_id, {rnd('coalesce(n_value, (select n_value from m))', 'n_value')} from e""",
)
def impute_numeric_mode(spark, sf):
    return tidy(_cleaned(spark, sf, numeric="mode").select("row_id", "n_value"))


@query("impute_constant", f"select row_id, {rnd('coalesce(n_value, -1)', 'n_value')} from {EVENTS_NULLS}")
def impute_constant(spark, sf):
    return tidy(_cleaned(spark, sf, numeric="constant").select("row_id", "n_value"))


@query(
    "impute_mode",
    f"""with e as {EVENTS_NULLS}, m as (select c_type from e where c_type is not null group by 1 order by count(*) desc, 1 limit 1)
    select row_id, coalesce(c_type, (select c_type from m)) as c_type from e""",
)
def impute_mode(spark, sf):
    return _cleaned(spark, sf).select("row_id", "c_type")


@query(
    "impute_time",
    f"select row_id, {millis("coalesce(t_01, timestamp '1970-01-01 00:00:00')")} as t_01 from {EVENTS_NULLS}",
)
def impute_time(spark, sf):
    return tidy(_cleaned(spark, sf).select("row_id", "t_01"))


@query(
    "impute_multi",
    "select doc_id as row_id, array_to_string(case when n_chars >= 200 then string_split(text, ' ') else ['-1'] end, ' ') as m_words from documents",
)
def impute_multi(spark, sf):
    d = I.documents(spark, sf).select("row_id", F.when(F.col("n_chars") >= 200, F.col("m_words")).alias("m_words"))
    out = C.Cleaner.fit(d, threshold=1.0).transform(d)
    return out.select("row_id", F.array_join("m_words", " ").alias("m_words"))


@query(
    "clean_table",
    f"""with e as {EVENTS_NULLS}, m as (select c_type from e where c_type is not null group by 1 order by count(*) desc, 1 limit 1)
    select row_id, c_user, label, coalesce(c_type, (select c_type from m)) as c_type,
      {rnd('coalesce(n_value, (select avg(n_value) from e))', 'n_value')},
      {millis("coalesce(t_01, timestamp '1970-01-01 00:00:00')")} as t_01 from e""",
)
def clean_table(spark, sf):
    cleaned, _ = C.clean_tables({"main": I.events_with_nulls(spark, sf)})
    return tidy(cleaned["main"])


@query(
    "drop_time_columns",
    f"select row_id, c_user, c_type, {rnd('n_value', 'n_value')}, {rnd('n_sparse', 'n_sparse')}, label from {EVENTS_NULLS} where t_01 is not null",
)
def drop_time_columns(spark, sf):
    return tidy(C.drop_time_columns(C.drop_rows_without_time(I.events_with_nulls(spark, sf))))


@query(
    "row_predicates",
    f"select row_id, c_type, {rnd('n_value', 'n_value')} from {EVENTS} where n_value > 25 and c_type = 'click' and not (label = 1)",
)
def row_predicates(spark, sf):
    kept = I.events(spark, sf).filter((F.col("n_value") > 25) & (F.col("c_type") == "click") & ~(F.col("label") == 1))
    return tidy(keep_columns(kept, ["row_id", "c_type", "n_value", "not_there"]))


@query(
    "sentinel_year",
    """with y as (select o_orderkey as row_id, case when o_orderstatus = 'P' then 1970 else year(o_orderdate) end as n_year from orders),
      m as (select n_year from y group by 1 order by count(*) desc, 1 limit 1)
    select row_id, case when n_year = 1970 then (select n_year from m) else n_year end as n_year from y""",
)
def sentinel_year(spark, sf):
    """Unshipped orders get the sentinel; where the sentinel itself is the mode, it stays."""
    o = I.main_orders(spark, sf)
    year = F.when(F.col("c_status") == "P", 1970).otherwise(F.year("t_01")).alias("n_year")
    return tidy(C.replace_sentinel_year(o.select("row_id", year), "n_year"))


@query(
    "align_schema",
    """select p_partkey as row_id, cast(p_brand = 'Brand#7' as bigint) as c_brand__dummy_1,
      cast(p_brand = 'Brand#11' as bigint) as c_brand__dummy_2, cast(p_type = 'PROMO' as bigint) as c_type__dummy_1 from part""",
)
def align_schema(spark, sf):
    p = I.table(spark, sf, "part").select(F.col("p_partkey").alias("row_id"), F.col("p_brand").alias("c_brand"), F.col("p_type").alias("c_type"))
    known = {
        "c_brand__dummy_1": ("c_brand", "Brand#7"),
        "c_brand__dummy_2": ("c_brand", "Brand#11"),
        "c_type__dummy_1": ("c_type", "PROMO"),
    }
    return tidy(align_to_schema(p, ["row_id", *known], known))


@query(
    "narrow_numbers",
    "select l_orderkey, l_linenumber, cast(l_quantity as bigint) as n_qty, l_linenumber as n_line, "
    + rnd("l_extendedprice", "n_price") + " from lineitem",
)
def narrow_numbers(spark, sf):
    rows = I.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_quantity").alias("n_qty"),
        F.col("l_linenumber").cast("double").alias("n_line"), F.col("l_extendedprice").alias("n_price"),
    )
    return tidy(C.narrow_numbers(rows))


@query(
    "user_key_detect",
    """select k as "column", n as n_distinct from (
      select 'c_order' as k, count(distinct l_orderkey) as n from lineitem
      union all select 'c_part', count(distinct l_partkey) from lineitem
      union all select 'c_supp', count(distinct l_suppkey) from lineitem) order by n desc, k limit 1""",
)
def user_key_detect(spark, sf):
    lines = I.order_lines(spark, sf)
    user = C.detect_user_key(lines, ["c_order", "c_part", "c_supp"])
    return C.distinct_counts(lines, [user])


@query(
    "session_detect",
    f"""with o as {ORDERS}, s as (
      select 'c_order' as k, c_order as v, count(distinct c_cust) as n from o group by c_order
      union all select 'c_status', c_status, count(distinct c_cust) from o group by c_status)
    select k as "column", count(*) as n_distinct from s group by k having max(n) = 1""",
)
def session_detect(spark, sf):
    return C.session_candidates(I.main_orders(spark, sf), "c_cust", ["c_order", "c_status"])


@query(
    "binary_detect",
    f"""with l as {LINES} select c as "column" from (
      select 'c_flag' as c, count(distinct c_flag) as n from l union all select 'c_line', count(distinct c_line) from l
      union all select 'c_supp', count(distinct c_supp) from l) where n = 2""",
)
def binary_detect(spark, sf):
    lines = I.order_lines(spark, sf)
    found = C.binary_categories(lines, ["c_flag", "c_line", "c_supp"])
    return C.distinct_counts(lines, columns_of(lines, "cat")).filter(F.col("column").isin(found)).select("column")


# -------------------------------------------------------------------------- aggregation


@query(
    "agg_numeric_bundle",
    f"select c_order, {stat_list(['n_qty', 'n_price', 'n_disc', 'n_tax'])} from {LINES} group by c_order",
)
def agg_numeric_bundle(spark, sf):
    cols = ["n_qty", "n_price", "n_disc", "n_tax"]
    return tidy(A.aggregate_by_key(I.order_lines(spark, sf), "c_order", cols, include_key=False))


@query(
    "agg_category_bundle",
    f"""select c_part, count(*) as n_count__c_part, count(c_order) as n_count__c_order, count(c_supp) as n_count__c_supp,
      count(c_flag) as n_count__c_flag, count(c_line) as n_count__c_line from {LINES} group by c_part""",
)
def agg_category_bundle(spark, sf):
    return A.aggregate_by_key(I.order_lines(spark, sf), "c_part", ["c_order", "c_supp", "c_flag", "c_line"])


@query(
    "agg_nunique",
    f"""select c_part, count(distinct c_supp) as n_nunique__c_supp, count(distinct c_flag) as n_nunique__c_flag
    from {LINES} group by c_part""",
)
def agg_nunique(spark, sf):
    lines = I.order_lines(spark, sf)
    return A.aggregate_by_key(lines, "c_part", ["c_supp", "c_flag"], category=["nunique"], include_key=False)


@query(
    "agg_custom",
    f"select c_supp, {rnd('max(n_price) - min(n_price)', 'n_spread__n_price', 4)} from {LINES} group by c_supp",
)
def agg_custom(spark, sf):
    def spread(c):
        return F.max(c) - F.min(c)

    out = A.aggregate_by_key(I.order_lines(spark, sf), "c_supp", ["n_price"], numeric=[spread], include_key=False)
    return tidy(out, 4)


@query(
    "value_counts",
    f"""select c_user, count(*) as n, {rnd("count(*) * 1.0 / (select count(*) from events)", "share")}
    from {EVENTS} group by c_user""",
)
def value_counts(spark, sf):
    return tidy(A.value_counts(I.events(spark, sf), "c_user", "share"))


@query(
    "mode_value",
    """select p_partkey from (select l_partkey as p_partkey, count(*) as n from lineitem group by 1)
    order by n desc, p_partkey limit 1""",
)
def mode_value(spark, sf):
    return A.mode_of(I.table(spark, sf, "lineitem").withColumnRenamed("l_partkey", "p_partkey"), "p_partkey")


@query(
    "extent",
    f"""select 'n_qty' as "column", {rnd("min(n_qty)", "low")}, {rnd("max(n_qty)", "high")} from {LINES}
    union all select 'n_price', {rnd("min(n_price)")}, {rnd("max(n_price)")} from {LINES}""",
)
def extent(spark, sf):
    edges = A.extent(I.order_lines(spark, sf), ["n_qty", "n_price"])
    return tidy(spark.createDataFrame([(c, *e) for c, e in edges.items()], "column string, low double, high double"))


@query(
    "class_counts",
    f"select label, count(*) as n, {rnd('count(*) * 1.0 / (select count(*) from events)', 'share')} from {EVENTS} group by label",
)
def class_counts(spark, sf):
    sizes = A.class_counts(I.events(spark, sf))
    total = sum(sizes.values())
    rows = [(k, n, n / total) for k, n in sizes.items()]
    return tidy(spark.createDataFrame(rows, "label long, n long, share double"))


@query(
    "quantiles",
    f"""select {rnd("quantile_cont(n_price, 0.25)", "q25")}, {rnd("quantile_cont(n_price, 0.5)", "q50")},
    {rnd("quantile_cont(n_price, 0.75)", "q75")}, {rnd("quantile_cont(n_price, 0.99)", "q99")} from {LINES}""",
)
def quantiles(spark, sf):
    wanted = {"q25": 0.25, "q50": 0.5, "q75": 0.75, "q99": 0.99}
    return tidy(A.quantiles(I.order_lines(spark, sf), "n_price", wanted))


@query(
    "quantiles_by_key",
    f"""select c_supp, {rnd("quantile_cont(n_price, 0.25)", "q25")}, {rnd("quantile_cont(n_price, 0.75)", "q75")}
    from {LINES} group by c_supp""",
)
def quantiles_by_key(spark, sf):
    return tidy(A.quantiles(I.order_lines(spark, sf), "n_price", {"q25": 0.25, "q75": 0.75}, ["c_supp"]))


_MERGED = MergeOptions(numeric=("mean", "sum"))


@query(
    "merge_depth_two",
    f"""with t as (select c.c_cust, c.c_nation, n.n_name as c_nation__c_nname from {CUSTOMERS} c
      left join nation n on cast(n.n_nationkey as varchar) = c.c_nation)
    select m.row_id, t.c_nation__c_nname as c_cust__c_nation__c_nname from {ORDERS} m left join t using (c_cust)""",
)
def merge_depth_two(spark, sf):
    from relweave.schema import DatasetConfig, Relation, RelationalDataset

    config = DatasetConfig(
        {}, (Relation("main", "cust", "c_cust", "many_to_one"), Relation("cust", "nation", "c_nation", "many_to_one")), "t_01"
    )
    tables = {
        "main": I.main_orders(spark, sf),
        "cust": I.customers(spark, sf),
        "nation": I.nations(spark, sf).select("c_nation", "c_nname"),
    }
    out = merge_tables(RelationalDataset(tables, config), _MERGED)
    return out.select("row_id", F.col("c_cust__c_nation__c_nname"))


# ------------------------------------------------------------------------ files and back

_ORDER_TYPES = {"c_order": "cat", "n_total": "num", "m_parts": "multi-cat", "t_01": "time"}


def _folder(spark) -> str:
    return f"{shared_dir(spark).rstrip('/')}/files/{uuid.uuid4().hex}"


def _orders_with_parts(spark, sf):
    """Orders with the parts of their lines as a set, null for orders without lines."""
    parts = I.order_lines(spark, sf).groupBy("c_order").agg(F.sort_array(F.collect_list("c_part")).alias("m_parts"))
    return I.main_orders(spark, sf).join(parts, "c_order", "left").select("row_id", *_ORDER_TYPES)


@query(
    "read_typed_table",
    f"""with p as (select c_order, string_agg(c_part, '|' order by c_part) as m_parts from {LINES} group by 1)
    select o.c_order, {rnd("n_total", "n_total")}, m_parts, {millis("t_01")} as t_01 from {ORDERS} o left join p using (c_order)""",
)
def read_typed_table(spark, sf):
    """Orders written as tab-separated text and read in their declared types."""
    path = _folder(spark)
    write_table(_orders_with_parts(spark, sf), path, _ORDER_TYPES)
    return tidy(read_table(spark, path, _ORDER_TYPES).withColumn("m_parts", F.array_join("m_parts", "|")))


@query(
    "read_main_in_file_order",
    f"select row_number() over (order by row_id) - 1 as row_id, c_order, {rnd('n_total', 'n_total')}, {millis('t_01')} as t_01 from {ORDERS}",
)
def read_main_in_file_order(spark, sf):
    """A main table without a key: its rows are numbered as they stand in the files."""
    types = {c: t for c, t in _ORDER_TYPES.items() if c != "m_parts"}
    path = _folder(spark)
    write_table(I.main_orders(spark, sf).orderBy("row_id"), path, types)
    return tidy(read_main(spark, path, types))


@query("write_predictions", f"select row_number() over (order by row_id) - 1 as row_id, {rnd('n_total / 1000000', 'label', 9)} from {ORDERS}")
def predictions(spark, sf):
    """Scores written in row order, read back and numbered as they stand in the files."""
    path = _folder(spark)
    scores = I.main_orders(spark, sf).select("row_id", (F.col("n_total") / 1_000_000).alias("score"))
    write_predictions(scores.repartition(5), path)
    back = with_file_order(spark.read.schema("label double").option("header", True).csv(path))
    return tidy(back.select("row_id", "label"), 9)
