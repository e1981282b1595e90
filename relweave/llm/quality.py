"""Quality rules whose cutoffs carry a guarantee against false rejection.

Every rule compares a score of a text with a cutoff. Cutoffs are not guessed: labelled documents serve
as a hold-out, apart for each stratum. A cutoff of a rule is admissible in a stratum if the exact
binomial test at the rule's share of the risk rejects "this cutoff turns away more good documents than
allowed"; the level is divided by the number of tests (Bonferroni over strata, rules and cutoffs).
Hence, with confidence 1 - ``delta``, in every stratum at most ``risk`` of the good documents are lost
to all rules together. Of the admissible cutoffs the one with the best balance of bad over good
rejections is taken, and the loosest of equals; a stratum with too few labels gets no cutoff.

Everything is DataFrame functions: one pass measures the texts, and only the measures move.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relweave.llm.common import SPACE
from relweave.session import materialize

WINDOW = 8
RISK = 0.05
DELTA = 0.05
#: Rules: a score over the measures, and the cutoffs to try, from tight to loose.
RULES: dict[str, tuple[str, tuple[float, ...]]] = {
    "symbols": ("n_symbols / greatest(word_chars, 1)", (0.02, 0.05, 0.1, 0.2, 0.3)),
    "dup_lines": ("n_dup_lines / greatest(n_lines, 1)", (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7)),
    "repeats": ("n_repeat_words / greatest(n_words, 1)", (0.02, 0.05, 0.1, 0.15, 0.2, 0.25)),
    "long_words": ("word_chars / greatest(n_words, 1)", (5.5, 6.0, 6.5, 7.0, 7.5, 8.0, 10.0)),
    "short_words": ("0 - word_chars / greatest(n_words, 1)", (-4.5, -4.25, -4.0, -3.75, -3.5, -3.0)),
    "loud": ("n_marks / greatest(n_words, 1)", (0.05, 0.1, 0.25, 0.5, 0.9)),
}


def measures(df: DataFrame, doc_id: str = "doc_id", text: str = "text", stratum: str | None = "lang") -> DataFrame:
    """One row of counts per row of ``df``: doc_id, stratum, n_words, word_chars, n_symbols, n_lines,
    n_dup_lines, n_repeat_words, n_marks.

    A null or empty text counts nothing; a null stratum, or none, is the stratum ''. Other columns are
    not read. Rows are measured one by one, repeated ids too.
    """
    s = F.coalesce(F.col(stratum).cast("string"), F.lit("")) if stratum in df.columns else F.lit("")
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(t, SPACE), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    gone = lambda pattern: F.length(t) - F.length(F.regexp_replace(t, pattern, ""))
    split = df.select(
        F.col(doc_id).alias("doc_id"),
        s.alias("stratum"),
        words.alias("words"),
        lines.alias("lines"),
        gone("[#*$%&|<>]").cast("long").alias("n_symbols"),
        gone("!").cast("long").alias("n_marks"),
    )
    hashed = split.select(
        "doc_id",
        "stratum",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "n_marks",
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    last = F.size("hashes") - (WINDOW - 1)
    grams = F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice("hashes", i, WINDOW)))
    with_grams = hashed.withColumn("grams", F.when(last > 1, grams)).drop("hashes")
    # most texts repeat no window: only the others are sorted
    again = F.size(F.array_distinct("grams")) < F.size("grams")
    placed = F.sort_array(F.transform("grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    ordered = with_grams.withColumn("placed", F.when(again, placed)).drop("grams")
    twin = lambda x, i, by: F.coalesce(F.get("placed", i + F.lit(by))["g"] == x["g"], F.lit(False))
    repeated = F.filter("placed", lambda x, i: twin(x, i, -1) | twin(x, i, 1))
    starts = F.sort_array(F.transform(repeated, lambda x: x["i"]))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last")),
        lambda a: a["n"],
    )
    return ordered.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("placed")


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(at most k of n) for chance p, exactly summed from the terms' ratios; 1 if k is above n * p."""
    odds = math.log(p / (1 - p))
    first = n * F.lit(math.log1p(-p))
    term = lambda a, j: a["t"] + F.log((n - j + 1) / j) + F.lit(odds)
    total = F.aggregate(
        F.sequence(F.lit(1).cast("long"), k),
        F.struct(first.alias("t"), F.exp(first).alias("s")),
        lambda a, j: F.struct(term(a, j).alias("t"), (a["s"] + F.exp(term(a, j))).alias("s")),
        lambda a: a["s"],
    )
    return F.when(k > n * p, F.lit(1.0)).when(k == 0, F.exp(first)).otherwise(total)


def cutoffs(labelled: DataFrame, good: str = "good", risk: float = RISK, delta: float = DELTA, rules: dict = RULES) -> DataFrame:
    """(stratum, one column per rule): the chosen cutoffs, null where no cutoff is admissible.

    ``labelled`` has the measures and the boolean ``good``; rows with a null label are left out. The
    result has one row per stratum. No labelled rows give no rows.
    """
    tests = [(r, i, score, c) for r, (score, grid) in rules.items() for i, c in enumerate(grid)]
    hits = []
    for r, i, score, c in tests:
        above = F.expr(f"({score}) > {c}")
        hits += [F.sum((above & F.col(good)).cast("long")).alias(f"g_{r}_{i}"), F.sum((above & ~F.col(good)).cast("long")).alias(f"b_{r}_{i}")]
    counted = (
        labelled.filter(F.col(good).isNotNull())
        .groupBy("stratum")
        .agg(F.sum(F.col(good).cast("long")).alias("n"), *hits)
    )
    cells = F.array(
        *[
            F.struct(
                F.lit(r).alias("rule"), F.lit(i).alias("place"), F.lit(float(c)).alias("cutoff"),
                F.col(f"g_{r}_{i}").alias("lost"), F.col(f"b_{r}_{i}").alias("caught"),
            )
            for r, i, _, c in tests
        ]
    )
    table = materialize(counted.select("stratum", "n", F.explode(cells).alias("c")).select("stratum", "n", "c.*"))
    level = F.lit(delta / max(1, table.select("stratum").distinct().count()) / len(tests))
    ok = table.filter(
        (binomial_tail(F.col("lost"), F.col("n"), risk / len(rules)) <= level) & (F.col("caught") > F.col("lost"))
    )
    best = ok.groupBy("stratum").pivot("rule", list(rules)).agg(
        F.max(F.struct((F.col("caught") - F.col("lost")).alias("gain"), "place", "cutoff"))["cutoff"]
    )
    return materialize(best)


def judge(
    df: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    stratum: str | None = "lang",
    label: str = "quality",
    risk: float = RISK,
    delta: float = DELTA,
    rules: dict = RULES,
) -> DataFrame:
    """The measures of every row, base_failed and kept.

    A text fails the base if it has under 20 words, or over 30 in 100 words in repeated windows; it is
    kept if it passes the base and no rule's score is above the cutoff of its stratum. ``labels`` holds
    (doc_id, label), label 1 for good; several labels of a document count as their least; a label
    without a document, or a document without one, only takes no part in choosing cutoffs.
    """
    seen = materialize(measures(df, doc_id, text, stratum))
    marks = labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull())
    marks = marks.groupBy(F.col(doc_id).alias("doc_id")).agg((F.min(label) == 1).alias("good"))
    chosen = cutoffs(seen.join(marks, "doc_id"), "good", risk, delta, rules)
    chosen = chosen.select(F.col("stratum").alias("__s"), *[F.col(r).alias(f"__{r}") for r in rules])
    judged = seen.join(chosen, seen["stratum"] == chosen["__s"], "left")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    caught = F.lit(False)
    for r, (score, _) in rules.items():
        caught = caught | F.coalesce(F.expr(score) > F.col(f"__{r}"), F.lit(False))
    return judged.select(*seen.columns, failed.alias("base_failed"), (~failed & ~caught).alias("kept"))


def judge_sql(risk: float = RISK, delta: float = DELTA, rules: dict = RULES) -> str:
    """DuckDB SQL of ``judge`` over ``documents`` and ``labels``: common table expressions that end in ``judged``."""
    tests = [(r, i, score, c) for r, (score, grid) in rules.items() for i, c in enumerate(grid)]
    cells = " union all ".join(
        f"select stratum, count(*) filter (good) as n, '{r}' as rule, {i} as place, cast({c} as double) as cutoff, "
        f"count(*) filter (good and ({s}) > {c}) as lost, count(*) filter (not good and ({s}) > {c}) as caught "
        f"from labelled group by stratum"
        for r, i, s, c in tests
    )
    p = risk / len(rules)
    caught = " or ".join(
        f"coalesce(({s}) > (select cutoff from chosen where chosen.stratum = m.stratum and rule = '{r}'), false)"
        for r, (s, _) in rules.items()
    )
    return rf"""with d as (select doc_id, coalesce(lang, '') as stratum, coalesce(text, '') as t from documents),
w as (select *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from d),
g as (select doc_id, unnest(list_transform(range(1, len(ws) - 6), lambda i: {{'p': i, 'g': array_to_string(ws[i:i+7], ' ')}})) as s from w),
r as (select doc_id, s.p as p from g qualify count(*) over (partition by doc_id, s.g) > 1),
c as (select doc_id, sum(least(8, p - prev)) as n from
  (select doc_id, p, coalesce(lag(p) over (partition by doc_id order by p), -8) as prev from r) group by doc_id),
m as (select w.doc_id, stratum, len(ws) as n_words, length(array_to_string(ws, '')) as word_chars,
  length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols, len(ls) as n_lines,
  len(ls) - len(list_distinct(ls)) as n_dup_lines, length(t) - length(replace(t, '!', '')) as n_marks,
  cast(coalesce(c.n, 0) as bigint) as n_repeat_words from w left join c using (doc_id)),
labelled as (select m.*, l.quality = 1 as good from m join labels l using (doc_id) where l.quality is not null),
cells as ({cells}),
chosen as (select stratum, rule, arg_max(cutoff, (caught - lost) * 1000 + place) as cutoff from cells
  where caught > lost and case when lost > n * {p!r} then 1 else list_sum(list_transform(range(0, lost + 1),
    lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({p!r}) + (n - j) * ln(1 - {p!r})))) end
    <= {delta!r} / (select count(distinct stratum) from cells) / {len(tests)}
  group by stratum, rule),
judged as (select *, base_failed is false and not ({caught}) as kept from
  (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from m) m)
"""
