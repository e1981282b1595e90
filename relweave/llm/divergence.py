"""How far the sources of a language differ in their words, from count-level bitmaps.

Every group (language, source) counts each kept term of its language. Terms with the same count in a
group form a level, stored as a bitset of term ids: one row (language, word of 64 ids, source, count, bits).
The smoothed share p of a term depends on the group and the count alone, so the divergence of two groups is
a sum over joint cells: for each pair of levels, the popcount of the AND of their bitsets, times
f = floor((p - q)^2 / (p + q)). Terms that a group lacks are not stored; their cells follow by complement.

Term ids follow the terms' frequency in the language, so terms of like counts share words of ids and a word
has few levels. Joint cells add up over words and are found side by side for spans of words and tiles of
sources; only sums per pair and span move on. All arithmetic is in whole numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relweave.functions.lookup import lookup_join
from relweave.functions.ordered import row_index
from relweave.llm.common import slices
from relweave.session import discard, materialize

#: Words of 64 term ids that one task handles at once, and sources in a tile.
SPAN, TILE = 32, 24
UNIT = 1_000_000_000
#: Distinct terms a task counts before it hands them on, and bytes of text it holds as words at once.
HELD, SLICE_BYTES = 400_000, 4_000_000
#: A-Z in lower case, other ASCII characters but a-z as spaces; all bytes of other characters stay.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))


class Audit:
    """The written tables: ``terms`` (lang, term, tid, n), ``counts`` (lang, source, term, tid, n, p),
    ``groups`` (lang, source, p0) and ``langs`` (lang, total, v)."""

    def __init__(self, terms: DataFrame, counts: DataFrame, groups: DataFrame, langs: DataFrame):
        self.terms, self.counts, self.groups, self.langs = terms, counts, groups, langs


def audit(df: DataFrame, least_docs: int = 10, text: str = "text", lang: str = "lang", source: str = "source") -> Audit:
    """Count the kept terms of every group: those in at least ``least_docs`` documents of their language.

    Null texts, languages and sources are empty ones; a row is a document, so repeated rows count again. A
    language without kept terms has groups, but no counts; an empty table has neither. Other columns are
    not read, whatever their names.
    """
    blank = F.lit("")
    docs = df.select(*(F.coalesce(F.col(c).cast("string"), blank).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))))
    found = _counted(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    found = materialize(found)
    vocabulary = found.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least_docs)
    vocabulary = materialize(vocabulary.select("lang", "term", "n", (-F.col("n")).alias("order")))
    terms = materialize(row_index(vocabulary, ["order", "term"], "tid", ["lang"]).select("lang", "term", "tid", "n"))
    counts = materialize(found.join(terms.select("lang", "term", "tid"), ["lang", "term"]).select("lang", "source", "term", "tid", "n"))
    discard(found)
    discard(vocabulary)
    langs = materialize(terms.groupBy("lang").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("v")))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("of_group"))
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left")
    groups = lookup_join(groups, langs, ["lang"]).na.fill(0, ["of_group", "v"])
    groups = materialize(groups.withColumn("p0", F.when(F.col("v") > 0, share(F.lit(0), F.col("of_group"), F.col("v")))))
    counts = lookup_join(counts, groups.select("lang", "source", "of_group", "v"), ["lang", "source"])
    counts = counts.withColumn("p", share(F.col("n"), F.col("of_group"), F.col("v"))).drop("of_group", "v")
    return Audit(terms, counts, groups, langs)


def share(n, total, v):
    """1 + floor(10^9 (n + 2) / (total + 2 v)), exact for any counts."""
    whole = (n.cast("decimal(20,0)") + F.lit(2).cast("decimal(1,0)")) * F.lit(UNIT).cast("decimal(10,0)")
    parts = total.cast("decimal(20,0)") + v.cast("decimal(20,0)") * F.lit(2).cast("decimal(1,0)")
    return F.call_function("div", whole, parts) + 1


def gap(p, q):
    """floor((p - q)^2 / (p + q)) of whole numbers."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _counted(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents that hold the term; several rows per term."""

    def rows(held: dict) -> pa.RecordBatch:
        keys, terms = [], []
        n, docs = [], []
        for key, (times, within) in held.items():
            keys += [key] * len(times)
            terms += times
            n += times.values()
            docs += map(within.__getitem__, times)
        columns = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string())]
        term = pa.array(terms, pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([*columns, term, pa.array(n, pa.int64()), pa.array(docs, pa.int64())], ["lang", "source", "term", "n", "docs"])

    def count(batches):
        held, size = {}, 0
        for batch in (part for whole in batches for part in slices(whole, "text", SLICE_BYTES)):
            for lang, source, text in zip(batch["lang"].to_pylist(), batch["source"].to_pylist(), batch["text"]):
                found = text.as_py().translate(_LETTERS).split()
                times, within = held.setdefault((lang, source), ({}, {}))
                before = len(times)
                for w in found:
                    times[w] = times.get(w, 0) + 1
                for w in set(found):
                    within[w] = within.get(w, 0) + 1
                size += len(times) - before
                if size > HELD:
                    yield rows(held)
                    held, size = {}, 0
        if size:
            yield rows(held)

    texts = docs.select("lang", "source", F.col("text").cast("binary").alias("text"))
    return texts.mapInArrow(count, "lang string, source string, term string, n long, docs long")


# ------------------------------------------------------------------------------- pairs


def levels(found: Audit) -> DataFrame:
    """The count-level bitmaps: (lang, source, n, p, word, bits), the term ids of a word with that count."""
    tid = F.col("tid")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(tid, F.lit(64)).cast("int"))
    return found.counts.groupBy("lang", "source", "n", "p", F.floor(tid / 64).alias("word")).agg(F.bit_or(bit).alias("bits"))


def pairs(found: Audit, span: int = SPAN, tile: int = TILE) -> DataFrame:
    """(lang, source, item, value): the summed f of every two different sources of a language, both ways."""
    sizes = found.groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources"), F.max("v").alias("v"))
    sizes = materialize(sizes.select("lang", F.ceil(F.col("sources") / tile).cast("int").alias("tiles"), F.col("v").alias("size")))
    of = F.pmod(F.xxhash64("source"), F.col("tiles")).cast("int")

    def dealt(rows: DataFrame) -> DataFrame:
        """Each row once for every tile that its own one meets."""
        rows = lookup_join(rows, sizes, ["lang"]).withColumn("own", of)
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        return rows.withColumns({"a": F.least("own", "other"), "b": F.greatest("own", "other")}).drop("other", "tiles")

    stored = dealt(levels(found).withColumn("span", F.floor(F.col("word") / span)))
    stored = stored.select("lang", "span", "a", "b", "own", "source", "p", "word", "bits")
    last = F.floor((F.greatest(F.col("size"), F.lit(1)) - 1) / (64 * span))
    known = dealt(found.groups.select("lang", "source", "p0")).withColumn("span", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    known = known.select("lang", "span", "a", "b", "own", "source", "p0", "size")
    keys = ["lang", "span", "a", "b"]

    def cell(key, groups: pa.Table, bitmaps: pa.Table) -> pa.Table:
        lang, at, a, b = (k.as_py() for k in key)
        return _joint(lang, at * span, span, a, b, groups, bitmaps)

    schema = "lang string, source string, item string, value long"
    summed = known.groupBy(*keys).cogroup(stored.groupBy(*keys)).applyInArrow(cell, schema)
    once = summed.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    return once.select("lang", both.alias("s"), "value").select("lang", "s.source", "s.item", "value")


def _joint(lang: str, first: int, span: int, a: int, b: int, groups: pa.Table, bitmaps: pa.Table) -> pa.Table:
    """The sums over one span of words for every pair of a source of tile ``a`` and one of tile ``b``."""
    own = groups["own"].to_numpy()
    names = np.array(groups["source"].to_pylist(), object)
    left, right = np.flatnonzero(own == a), np.flatnonzero(own == b)
    place = {(t, s): i for t, side in ((a, left), (b, right)) for i, s in enumerate(names[side])}
    p0 = np.array([0 if v is None else v for v in groups["p0"].to_pylist()], np.int64)
    zero_a, zero_b = p0[left], p0[right]
    size = groups["size"][0].as_py() if groups.num_rows else 0
    value = np.zeros((len(left), len(right)), np.int64)
    if bitmaps.num_rows:
        of, word = bitmaps["own"].to_numpy(), bitmaps["word"].to_numpy()
        who = np.array([place[t, s] for t, s in zip(of.tolist(), bitmaps["source"].to_pylist())], np.int64)
        p, bits = bitmaps["p"].to_numpy(), bitmaps["bits"].to_numpy().view(np.uint64)
    else:
        of = word = who = p = np.zeros(0, np.int64)
        bits = np.zeros(0, np.uint64)
    order = np.lexsort((who, word))
    of, word, who, p, bits = of[order], word[order], who[order], p[order], bits[order]
    for w in range(first, min(first + span, -(-size // 64))):
        here = slice(*np.searchsorted(word, [w, w + 1]))
        n = min(64, size - 64 * w)  # kept terms in this word
        sides = [_side(who[here][of[here] == t], p[here][of[here] == t], bits[here][of[here] == t], m) for t, m in ((a, len(left)), (b, len(right)))]
        value += _word(*sides, zero_a, zero_b, n)
    i, j = np.nonzero(np.ones(value.shape, bool) if a != b else names[left][:, None] < names[right][None, :])
    columns = [pa.array([lang] * len(i), pa.string()), pa.array(names[left][i], pa.string()), pa.array(names[right][j], pa.string())]
    return pa.table([*columns, pa.array(value[i, j])], ["lang", "source", "item", "value"])


def _side(who, p, bits, m):
    """Levels of one tile in a word, sorted by source, and where each source's levels begin and end."""
    return who, p, bits, np.searchsorted(who, np.arange(m)), np.searchsorted(who, np.arange(m), "right")


def _f(p, q):
    d = p - q
    return d * d // (p + q)


def _by_source(x: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sums of the rows of each source."""
    run = np.concatenate([np.zeros((1, x.shape[1]), np.int64), np.cumsum(x, 0, dtype=np.int64)])
    return run[end] - run[start]


def _word(one, two, zero_a, zero_b, n: int) -> np.ndarray:
    """The sum over the joint cells of all pairs of sources within one word of ids."""
    who_a, p_a, bits_a, start_a, end_a = one
    who_b, p_b, bits_b, start_b, end_b = two
    joint = np.bitwise_count(bits_a[:, None] & bits_b[None, :])
    i, j = np.nonzero(joint)
    value = np.zeros((len(zero_a), len(zero_b)), np.int64)
    np.add.at(value, (who_a[i], who_b[j]), joint[i, j] * _f(p_a[i], p_b[j]))
    # terms of a level that the other source lacks
    of_a, of_b = np.bitwise_count(bits_a).astype(np.int64), np.bitwise_count(bits_b).astype(np.int64)
    met_a = _by_source(joint.T, start_b, end_b).T  # level of a x source of b
    met_b = _by_source(joint, start_a, end_a)  # source of a x level of b
    value += _by_source((of_a[:, None] - met_a) * _f(p_a[:, None], zero_b[None, :]), start_a, end_a)
    value += _by_source(((of_b[None, :] - met_b) * _f(zero_a[:, None], p_b[None, :])).T, start_b, end_b).T
    # terms that both lack: the complement of the union
    held = _by_source(of_a[:, None], start_a, end_a) + _by_source(of_b[:, None], start_b, end_b).T - _by_source(met_a, start_a, end_a)
    return value + (n - held) * _f(zero_a[:, None], zero_b[None, :])


# ------------------------------------------------------------------------------- terms


def over_used(found: Audit, most: int = 10) -> DataFrame:
    """(lang, source, item, value, rank): each group's terms of the largest f against its language, p above its q."""
    of_lang = lookup_join(found.terms, found.langs, ["lang"]).select("lang", "term", share(F.col("n"), F.col("total"), F.col("v")).alias("q"))
    rows = found.counts.join(of_lang, ["lang", "term"]).filter(F.col("p") > F.col("q"))
    rows = rows.select("lang", "source", F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def ranked(found: Audit, most: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank): all pairs and the over-used terms, each ranked within its group.

    A pair's list holds the other sources of the language, so its length is their number."""
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    of_pairs = pairs(found).withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit("pair"))
    of_terms = over_used(found, most).withColumn("part", F.lit("term"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return of_pairs.select(*columns).unionByName(of_terms.select(*columns))


#: The same rows, directly from the definition: every kept term of every group, present or not.
AUDIT_SQL = """with docs as (
  select row_number() over () as doc, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text from documents),
hits as (
  select doc, lang, source, translate(unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as term from docs),
kept as (select lang, term, count(*) as n from hits group by lang, term having count(distinct doc) >= {least}),
langs as (select lang, sum(n)::hugeint as total, count(*)::hugeint as v from kept group by lang),
seen as (select h.lang, h.source, h.term, count(*) as n from hits h join kept using (lang, term) group by h.lang, h.source, h.term),
groups as (select distinct lang, source from docs),
totals as (select lang, source, sum(n)::hugeint as total from seen group by lang, source),
cells as (
  select g.lang, g.source, k.term, coalesce(s.n, 0) as n,
    (1 + (1000000000::hugeint * (coalesce(s.n, 0) + 2)) // (coalesce(t.total, 0) + 2 * l.v))::bigint as p,
    (1 + (1000000000::hugeint * (k.n + 2)) // (l.total + 2 * l.v))::bigint as q
  from groups g join kept k using (lang) join langs l using (lang)
  left join seen s on s.lang = g.lang and s.source = g.source and s.term = k.term
  left join totals t on t.lang = g.lang and t.source = g.source),
summed as (
  select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) as value
  from cells a join cells b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by a.lang, a.source, b.source),
pair as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(s.value, 0) as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source
  left join summed s on s.lang = a.lang and s.source = a.source and s.item = b.source),
listed as (
  select *, row_number() over (partition by lang, source order by value desc, item) as rank from pair
  union all
  select lang, source, 'term', term, (p - q) * (p - q) // (p + q) as value,
    row_number() over (partition by lang, source order by (p - q) * (p - q) // (p + q) desc, term) as rank
  from cells where n > 0 and p > q qualify rank <= {most})
select lang, source, part, item, cast(value as bigint) as value, cast(rank as integer) as rank from listed"""
