"""The source audit against its definition, term by term."""

from __future__ import annotations

import collections
import re

from pyspark.sql import functions as F

from relweave.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}
WORDS = ["Ana", "ana", "ÉTÉ", "été", "x9y", "日本", "b\x00c", "don't", "zz", "Q"]


def rows():
    out = [(None, None, None), ("alone once", "xx", "s"), ("", "en", "empty"), (None, "en", None), ("ana " * 40_000, "en", "long")]
    for i in range(120):
        words = [WORDS[(i * k * k + k) % len(WORDS)] for k in range(1, 2 + i % 9)] + ["the"] * (i % 4)
        out.append((" ".join(words), ("en", "fr")[i % 3 == 0], f"s{i % 7}"))
        if i % 10 == 0:
            out.append(out[-1])
    return out


def by_definition(docs, least, most):
    docs = [(t or "", a or "", s or "") for t, a, s in docs]
    split = [([w.translate(UPPER) for w in TERM.findall(t)], a, s) for t, a, s in docs]
    groups = sorted({(a, s) for _, a, s in docs})
    want = set()
    for lang in {a for a, _ in groups}:
        df = collections.Counter(w for ws, a, _ in split if a == lang for w in set(ws))
        kept = sorted(w for w, n in df.items() if n >= least)
        count = {s: collections.Counter() for a, s in groups if a == lang}
        for ws, a, s in split:
            if a == lang:
                count[s].update(w for w in ws if df[w] >= least)
        whole = sum(count.values(), collections.Counter())

        def share(c, w):
            return 1 + 10**9 * (c[w] + 2) // (c.total() + 2 * len(kept))

        def f(p, q):
            return (p - q) ** 2 // (p + q)

        for s in count:
            found = [(sum(f(share(count[s], w), share(count[o], w)) for w in kept), o) for o in count if o != s]
            want |= {(lang, s, "pair", o, v, k + 1) for k, (v, o) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode())))}
            found = [(f(share(count[s], w), share(whole, w)), w) for w in kept if count[s][w] and share(count[s], w) > share(whole, w)]
            want |= {(lang, s, "term", w, v, k + 1) for k, (v, w) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most])}
    return want


def test_audit_equals_the_definition(spark):
    df = spark.createDataFrame(rows(), "text string, lang string, source string")
    clash = df.withColumns({c: F.lit("clash") for c in ("term", "n", "tid", "p", "word", "own", "size")})
    for least, most in ((10, 10), (1, 3), (1_000, 10)):
        got = divergence.ranked(divergence.audit(clash, least), most).collect()
        assert len(got) == len(set(got)) and {tuple(r) for r in got} == by_definition(rows(), least, most)
    none = divergence.ranked(divergence.audit(df.limit(0)))
    assert none.count() == 0 and none.columns == ["lang", "source", "part", "item", "value", "rank"]


def test_tiles_and_spans_do_not_matter(spark):
    words = [f"w{''.join(chr(97 + int(d)) for d in str(k))}" for k in range(300)]
    docs = [(" ".join(words[(i * 7 + k * k) % 300] for k in range(40)), "en", f"s{i % 11}") for i in range(200)]
    found = divergence.audit(spark.createDataFrame(docs, "text string, lang string, source string"), 2)
    want = sorted(divergence.pairs(found).collect())
    assert {tuple(r) for r in want} == {(a, s, o, v) for a, s, part, o, v, _ in by_definition(docs, 2, 1) if part == "pair"}
    assert sorted(divergence.pairs(found, span=1, tile=2).collect()) == want


def test_large_counts_stay_exact(spark):
    n, total, v = 3 * 10**14, 10**15 + 7, 10**6
    row = spark.createDataFrame([(n, total, v)], "n long, total long, v long")
    assert row.select(divergence.share(F.col("n"), F.col("total"), F.col("v"))).first()[0] == 1 + 10**9 * (n + 2) // (total + 2 * v)
