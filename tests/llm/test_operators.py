"""Each operator against a plain version, on awkward rows and on the smallest tables."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import tracemalloc
import zlib
from array import array

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from relweave.llm import bpe, grades, katz, mixcoder, neardup, packing, quality, suffixes, tokenfiles, tokens, topk, toxicity
from relweave.llm.queries import QUERIES, SQL
from tests.compare import connect, difference

FILE = P.path("byte_bpe_50k.json")
RANKS = P.path("byte_bpe_multi_50k.tiktoken")
LONG = " ".join(f"w{i % 700}x{i}" for i in range(6_000))
#: Nulls, empty and very long texts, ties, repeated rows and ids, odd white space, a column that clashes.
ODD = [
    (1, None, "a"), (2, "", "a"), (3, LONG, "b"), (4, LONG, "b"), (4, LONG, "b"), (5, "one two", None),
    (6, " \n  x  y 'll don't   " * 40, "a"), (7, "日本語 テキスト  Ünï " * 60, "c"), (None, "the text of no id " * 9, "c"),
    (8, "the same five words again and again " * 30, "b"), (8, "the same five words again and again " * 30, "b"),
    (9, "\t\x0b\f\r ", "a"),
]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string, source string")
    return df.withColumns({c: F.lit("clash") for c in ("lang", "n", "ids", "key", "bucket", "part", "name", "spans")})


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]


def by_id(rows, *columns):
    return sorted((str(r["doc_id"]), *(bytes(r[c]) if isinstance(r[c], bytearray) else r[c] for c in columns)) for r in rows)


# ----------------------------------------------------------------------------- tokens


@pytest.mark.parametrize("chunk,overlap", [(64, 16), (1_000, 20), (16_384, 256)])
def test_bpe_equals_the_library(odd, none, chunk, overlap):
    coder = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=tokens.read_ranks(RANKS), special_tokens={})
    coded = bpe.encode(odd, RANKS, P.PATTERN, chunk_chars=chunk, overlap=overlap)
    want = sorted((str(i), array("I", coder.encode_ordinary(t or "")).tobytes()) for i, t, _ in ODD)
    assert by_id(coded.collect(), "ids") == want
    back = bpe.decode(coded, RANKS).collect()
    assert by_id(back, "decoded") == sorted((str(i), (t or "").encode()) for i, t, _ in ODD)
    assert bpe.encode(none, RANKS, P.PATTERN).count() == 0


def test_file_coder_equals_the_library():
    library = Tokenizer.from_file(FILE)
    library.encode_special_tokens = True
    for text in [t or "" for _, t, _ in ODD] + ["<|endoftext|> a", "it's  we'll\n\n x", " a b\x1c c"]:
        ids = np.array(library.encode(text, add_special_tokens=False).ids, "<u2").tobytes()
        assert tokens.file_coder(FILE, P.PATTERN).encode_one(text) == ids == tokens.file_coder(FILE).encode_one(text)


def test_coders_by_rank_remember_no_words():
    for coder in (tokens.file_coder(FILE, P.PATTERN), tokens.rank_coder(RANKS, P.PATTERN)):
        text = " ".join(f"w{i:x}q" for i in range(30_000))
        coder.encode_one("a b")
        tracemalloc.start()
        coded = coder.encode_one(text)
        held = tracemalloc.get_traced_memory()[0]
        tracemalloc.stop()
        assert held < 2 * len(coded)


@pytest.mark.parametrize("n", [0, 1, 2_047, 2_048, 2_049, 9_000])
@pytest.mark.parametrize("bits", [4, 16, 24])
def test_range_coder_round_trip(n, bits):
    draw = np.random.default_rng(n)
    for ids in (draw.integers(0, 1 << bits, n), draw.integers(0, 3, n), np.minimum(draw.zipf(1.3, n), (1 << bits) - 1)):
        coded = mixcoder.encode(ids, bits)
        assert (mixcoder.decode(*coded, n, bits) == ids).all()
    if n:
        payload = bytearray(coded[0])
        payload[0] ^= 1
        with pytest.raises(ValueError):
            mixcoder.decode(bytes(payload), coded[1], coded[2], n, bits)


def test_range_coder_renews_its_parts_once_a_window(monkeypatch):
    renewed, plain = [], mixcoder._Model._intervals
    monkeypatch.setattr(mixcoder._Model, "_intervals", lambda model: renewed.append(1) or plain(model))
    ids = np.minimum(np.random.default_rng(5).zipf(1.2, 9_000), 49_999)
    ids[3_000:6_000] = np.resize(ids[:50], 3_000)
    coded = mixcoder.encode(ids, 16)
    assert (mixcoder.decode(*coded, len(ids), 16) == ids).all()
    assert len(renewed) <= 2 * (2 + 4 + mixcoder.BLOCK // 128)
    assert len(coded[0]) < len(ids)  # at 16 bits an id it would be twice as much


def test_rank_coder_knows_no_special_text():
    coder = tokens.rank_coder(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    table = tokens.rank_table(P.path("byte_bpe_multi_50k.tiktoken"))
    for text in ("<|none|>", "a <|none|> b<|no", "\u00e9<|none|>\u4e2d", ""):
        ids = tokens.as_ids(coder.encode_one(text), "I")
        assert b"".join(table[i] for i in ids) == text.encode()
    assert coder.encode_one("a\ud800") == coder.encode_one("a\ufffd")


def test_token_files(spark, odd, none, tmp_path):
    coder = tokens.file_coder(FILE)
    for df, rows in ((odd, ODD), (none, [])):
        path = str(tmp_path / str(len(rows)))
        tokenfiles.write(df, path, FILE, 2, segment_ids=500)
        got = sorted((r["start"], r["doc_id"], bytes(r["ids"])) for r in tokenfiles.read(spark, path).collect())
        at, want = 0, []
        for i, t, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
            ids = np.append(np.frombuffer(coder.encode_one(t or ""), "<u2").astype("<u4"), np.uint32(2)).astype("<u4")
            want.append((at, i, ids.tobytes()))
            at += len(ids)
        assert got == want


def test_packing_is_gapless_and_mixed(spark, odd, none):
    rows = packing.tokenised(odd, FILE, 1, P.PATTERN)
    got = packing.pack(spark, rows, 2, sequence=64, window=4).collect()
    used = collections.defaultdict(list)
    for r in got:
        used[r["sequence_id"]].append((r["offset"], r["length"], r["source"]))
        assert r["ids_crc32"] == zlib.crc32(bytes(r["ids"])) and len(r["ids"]) == 4 * r["length"]
    for k, pieces in used.items():
        at = 0
        for offset, length, _ in sorted(pieces, key=lambda p: p[:2]):
            assert offset == at
            at += length
        assert at == 64 or k == max(used)
    total = rows.agg(F.sum("n")).first()[0]
    assert sum(r["length"] for r in got) == total
    assert packing.pack(spark, packing.tokenised(none, FILE, 1), 2).count() == 0


def test_mixture_carries_deficits():
    m = packing.Mixture({"a": 1_000, "b": 10, "c": 3_000, "d": 0}, 64)
    for w in range(m.windows):
        x = min(w * 64, m.length)
        assert all(n * x // m.length == s for n, s in zip((1_000, 10, 3_000, 0), m.served(w)))
    wanted = packing.Mixture({"a": 100, "b": 500}, 30, {"a": 2, "b": 1})
    assert wanted.served(3) == [60, 30] and wanted.served(wanted.windows) == [100, 500]


# ------------------------------------------------------------------ quality and toxicity


def test_binomial_tail(spark):
    rows = [(k, n) for n in (5, 40, 2_000) for k in (0, 1, 3) if k <= n]
    got = spark.createDataFrame(rows, "k long, n long").select(quality.binomial_tail(F.col("k"), F.col("n"), 0.1).alias("p"), "k", "n")
    for r in got.collect():
        exact = sum(math.comb(r["n"], j) * 0.1**j * 0.9 ** (r["n"] - j) for j in range(r["k"] + 1))
        assert r["p"] == pytest.approx(1.0 if r["k"] > 0.1 * r["n"] else exact)


def test_cutoffs_hold_the_risk(spark):
    rows = [("x", 100, 500, 0, 5, 0, 0, 0, i % 50 != 0) for i in range(3_000)]
    rows = [r if r[-1] else (*r[:3], 400, *r[4:]) for r in rows] + [("few", 100, 500, 400, 5, 0, 0, 0, False)] * 9
    names = "stratum string, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long, n_marks long, good boolean"
    got = {r["stratum"]: r for r in quality.cutoffs(spark.createDataFrame(rows, names)).collect()}
    assert got["x"]["symbols"] == 0.3 and got["x"]["dup_lines"] is None
    assert "few" not in got  # no good label, no guarantee, no cutoff


def test_measures_on_odd_rows(spark, odd, none):
    def plain(t):
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        many = collections.Counter(grams)
        hit = {i + j for i, g in enumerate(grams) if many[g] > 1 for j in range(8)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)

    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert by_id(quality.measures(odd).collect(), *columns) == sorted((str(i), *plain(t)) for i, t, _ in ODD)
    labels = spark.createDataFrame([(3, 1), (3, 0), (None, 1), (77, None)], "doc_id long, quality int")
    assert quality.judge(odd, labels).count() == len(ODD) and quality.judge(none, labels).count() == 0


@pytest.fixture(scope="module")
def graded(spark):
    draw = random.Random(5)
    words = ["the", "and", "river", "house", "green", "walks", "slowly", "north"]
    rows, labels = [], []
    for i in range(600):
        kind = i % 3
        text = [draw.choice(words) + str(draw.randrange(30)) for _ in range(60)]
        if kind == 1:
            text[draw.randrange(60)] = draw.choice(["zorkish", "blargo"])
        if kind == 2:
            text = [w + "%%%" for w in text]
        rows.append((i, " ".join(text)))
        labels.append((i, int(kind == 1), {0: 2, 1: 1, 2: 0}[kind]))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int, grade int")


def test_toxicity_on_held_out_rows(graded, odd, none):
    docs, labels = graded
    model = toxicity.fit(docs, labels)
    rows = toxicity.score(docs, model).join(labels, "doc_id").filter("held_out").collect()
    assert len(rows) > 100 and np.mean([(r["predicted"] == 1) == (r["toxic"] == 1) for r in rows]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in toxicity.score(odd, model).collect())
    assert toxicity.score(none, toxicity.fit(none, labels.limit(0))).count() == 0


def test_toxicity_of_long_texts(graded):
    """Length is no evidence: long clean texts stay, one toxic word in them is found wherever it stands."""
    docs, labels = graded
    score = toxicity.fit(docs, labels).scorer()
    draw = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyz"
    vocabulary = ["".join(draw.choice(letters) for _ in range(draw.randrange(2, 10))) for _ in range(50_000)]
    for n in (10**4, 10**5, 10**6):
        assert score(" ".join(draw.choice(vocabulary) for _ in range(n))) < toxicity.THRESHOLD
    clean = ["the river walks slowly north"] * 2_000
    assert score(" ".join(clean)) < toxicity.THRESHOLD
    for at in (0, 777, 1_999):
        assert score(" ".join([*clean[:at], "zorkish", *clean[at:]])) >= toxicity.THRESHOLD


def test_windows_hold_every_gram():
    for n in (0, 1, 4_093, 4_094, 4_095, 6_142, 6_143, 20_000):
        text = "".join(random.Random(n).choice("abcdé ") for _ in range(n))
        parts = [w.tobytes() for w in toxicity.windows(text)]
        whole = toxicity.padded(text).tobytes()
        assert max(map(len, parts)) <= toxicity.WINDOW
        assert {p[i : i + 6] for p in parts for i in range(len(p) - 5)} == {whole[i : i + 6] for i in range(len(whole) - 5)}


def test_label_model_discounts_repeated_voters():
    draw = np.random.default_rng(3)
    y = draw.random(2_000) < 0.3
    independent = [np.where(y, draw.random(2_000) < 0.8, draw.random(2_000) < 0.1) for _ in range(3)]
    copies = [independent[0]] * 5
    p = toxicity.label_model(np.array([*independent, *copies]).T, y.astype(float))
    assert ((p > 0.5) == y).mean() > 0.95


def test_grades_are_ordered(graded, odd):
    docs, labels = graded
    model = grades.fit(docs, labels)
    assert (np.diff(model.thresholds) >= 0).all()
    rows = grades.rate(docs, model).join(labels, "doc_id").filter("held_out").collect()
    mean = [np.mean([r["expected_grade"] for r in rows if r["grade"] == g]) for g in range(3)]
    assert mean[0] < 0.5 < mean[1] < mean[2]
    assert all(r["kept"] == (r["grade"] > 0) for r in rows)
    assert grades.rate(odd, model).count() == len(ODD)


# ------------------------------------------------------------------ duplicates


def plain_components(docs):
    sets = {}
    for i, t in docs:
        w = [x.lower() for x in re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())]
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_near_duplicates(spark, docs, odd, none):
    draw = random.Random(2)
    base = [f"t{draw.randrange(10**6)}" for _ in range(150)]
    texts = []
    for k in range(60):  # a large group of near copies at all distances
        words = list(base)
        for _ in range(draw.randrange(9)):
            words[draw.randrange(150)] = f"e{draw.randrange(10**6)}"
        texts.append((10_000 + k, " ".join(words)))
    rows = docs + texts
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = plain_components(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    out = neardup.near_duplicates(odd).collect()
    assert len(out) == len(ODD)
    assert {r["doc_id"]: r["component_id"] for r in out if r["doc_id"] in (3, 4, 1, 9)} == {3: 3, 4: 3, 1: 1, 9: 9}
    assert neardup.near_duplicates(none).count() == 0


def test_signature_is_circulant():
    x = np.array([7 << 32], np.uint64)
    sigma = neardup._mix(np.array([7], np.uint32))
    assert (neardup.signature(x) == neardup._mix(sigma + neardup._STEPS)).all()


def plain_repeats(docs):
    seen = collections.Counter()
    for _, t in docs:
        b = (t or "").encode()
        seen.update(b[p : p + 200] for p in range(len(b) - 199))
    out = []
    for i, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 199):
            if seen[b[p : p + 200]] > 1:
                gone[p : p + 200] = b"\1" * 200
        runs = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((str(i), len(b), sum(gone), runs, bytes(x for x, y in zip(b, gone) if not y)))
    return sorted(out)


@pytest.mark.parametrize("batches", [1, 5])
def test_repeated_strings(spark, odd, none, batches):
    draw = random.Random(4)
    text = lambda n: "".join(draw.choice("abcde é") for _ in range(n))
    shared = [text(260), text(199), text(210)]
    rows = [(i, text(draw.randrange(400)) + draw.choice(shared) + text(draw.randrange(300)) + draw.choice(shared)) for i in range(40)]
    rows += [(i, t) for i, t, _ in ODD]
    got = suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), batches=batches).collect()
    assert by_id(got, "n_bytes", "n_removed", "n_spans", "kept") == plain_repeats(rows)
    assert suffixes.remove_repeats(none).count() == 0 and suffixes.remove_repeats(odd).count() == len(ODD)


def test_levels_double(spark):
    index = suffixes.SuffixIndex()
    for i in range(7):
        rows = [(0, 1, i % 3, i % 2, 0, 0)]
        index.add(spark.createDataFrame(rows, "name long, head long, lead long, class long, lo long, hi long"))
    assert [rank for rank, _ in index.levels] == [2, 1, 0]


# ------------------------------------------------------------------ search and language model


def test_top_k(spark):
    draw = np.random.default_rng(1)
    x = np.floor(draw.normal(size=(400, 8)) * draw.choice([1, 5, 40], 400)[:, None] * 4)
    x[50:120] = x[50]  # ties
    rows = [(int(i), [float(v) for v in r]) for i, r in enumerate(x)]
    odd = [(400, None), (401, [1.0, None] * 4), (402, [float("nan")] * 8), (403, []), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("block", F.lit("clash"))
    old = topk.BLOCK, topk.QUERIES, topk._PART
    topk.BLOCK, topk.QUERIES, topk._PART = 60, 9, 16
    try:
        got = topk.top_k(df, df.filter("vec_id % 20 = 0"), k=7).collect()
    finally:
        topk.BLOCK, topk.QUERIES, topk._PART = old
    want = []
    for q in range(0, 400, 20):
        order = sorted((-(x[q] @ x[p]), p) for p in range(400) if p != q)[:7]
        want += [(q, r + 1, p, int(-s)) for r, (s, p) in enumerate(order)]
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == want
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


def test_top_k_of_spiky_vectors(spark):
    """One-dimensional, one-hot and negative vectors, dominated by one coordinate."""
    draw = np.random.default_rng(7)
    spiky = draw.integers(-3, 4, (300, 4)) + np.eye(4)[draw.integers(0, 4, 300)] * draw.choice([-200, -40, 40, 200], 300)[:, None]
    hot = np.eye(3)[draw.integers(0, 3, 200)] * draw.choice([-30, -20, -10, 10, 20], 200)[:, None]
    line = draw.integers(-40, 41, (200, 1)).astype(float)
    flat = np.array([[-10.0, 1], [-20, 0], [-19, 3], [18, -1], [0, -20], [3, 19], [-1, 1], [-2, 0]] * 3)
    for x in (spiky, hot, line, flat):
        rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        old = topk._PART
        topk._PART = 4
        try:
            got = topk.top_k(df, df, k=3).collect()
        finally:
            topk._PART = old
        want = []
        for q in range(len(x)):
            order = sorted((-(x[q] @ x[p]), p) for p in range(len(x)) if p != q)[:3]
            want += [(q, r + 1, p, int(-s)) for r, (s, p) in enumerate(order)]
        assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == want


def test_top_k_of_real_and_negative_scores(spark):
    draw = np.random.default_rng(11)
    x = draw.random((300, 5)) * draw.choice([0.01, 1.0, 30.0], 300)[:, None]
    x[150:] *= -1
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    few = df.filter("vec_id < 150 and vec_id % 3 = 0")
    got = topk.top_k(few, df.filter("vec_id >= 150 and vec_id % 10 = 0"), k=4).collect()  # all scores are below zero
    assert len(got) == 15 * 4 and max(r["score"] for r in got) < 0
    for r in got:
        best = sorted((float(x[r["query_id"]] @ x[p]) for p in range(0, 150, 3)), reverse=True)
        assert r["score"] == pytest.approx(best[r["rank"] - 1], rel=1e-12)


def test_links_below_the_bands_are_refused(odd):
    with pytest.raises(ValueError, match="75/100"):
        neardup.near_duplicates(odd, similar=(50, 100))


def test_katz_counts_a_slice_in_little_memory():
    draw = np.random.default_rng(1)
    token = draw.integers(3, 60_000, 200_000).astype(np.uint64) * np.uint64(1 << 40)
    token[draw.integers(0, len(token), 900)] = katz.END
    token[[0, -1]] = katz.END
    word, place = np.unique(token, return_inverse=True)
    place = place.astype(np.uint32)
    tracemalloc.start()
    a, b, n = katz._distinct_pairs(place, word)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    before = [int(katz.BEGIN), *(int(t) if t != katz.END else int(katz.BEGIN) for t in token[:-1])]
    want = sorted(collections.Counter(zip(before, token.tolist())).items())
    assert list(zip(zip(a.tolist(), b.tolist()), n.tolist())) == want
    assert most < 8 * 6 * len(token)


def test_katz_words_without_a_dictionary():
    """Hashes of words come from their bytes at once, also across pieces of a long text; before, word by word."""
    draw = np.random.default_rng(3)
    alphabet = [b" ", b"\n", b"\t", b"\x0b", b"\x0c", b"\r", b"A", b"a", b"Z", b"[", b"\x08", b"\x0e", b"\x1f", b"\x00", b"`", b"\xc3\xa9", b"bcdefghijkl"]
    texts = [b"".join(alphabet[i] for i in draw.integers(0, len(alphabet), n)) for n in (0, 1, 2, 3, 8, 60, 2000, 0)]
    texts.append(b" ".join(b"Word%d" % i for i in range(250_000)))
    texts.append(texts[-1].lower())
    token, size = katz._sequence(pa.array(texts, pa.binary()))
    words = [t.lower().split() for t in texts]
    assert size == [len(w) + 1 for w in words]
    flat, known = [x for w in words for x in [*w, None]], {}
    assert len(flat) == len(token)
    assert all(known.setdefault(w, h) == h for w, h in zip(flat, token.tolist()))
    assert known[None] == katz.END and len(set(known.values())) == len(known) and int(katz.BEGIN) not in known.values()
    assert not hasattr(katz, "_WORDS")


def test_katz_asks_once_for_a_key_and_text():
    draw = np.random.default_rng(4)
    key, of = draw.integers(0, 40, 5000).astype(np.uint64) << np.uint64(58), draw.integers(0, 30, 5000).astype(np.uint16)
    want = collections.Counter(zip(key.tolist(), of.tolist()))
    a, b, n = katz._asked(key, of)
    assert list(zip(a.tolist(), b.tolist())) == sorted(want) and n.tolist() == [want[x] for x in sorted(want)]
    assert b.dtype == np.uint16 and n.dtype == np.uint32


def test_katz(spark, docs, odd, none):
    rows = docs[:120] + [(i, t) for i, t, _ in ODD if i is not None]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    old = katz.PART_BYTES, katz.PART_WORDS, katz.PART_TOKENS
    katz.PART_BYTES, katz.PART_WORDS, katz.PART_TOKENS = 20_000, 300, 400
    try:
        model = katz.fit(df, least=2)
        assert model.word_bits > 0 and max(model.word_turns.values()) > 1
        model.pair_turns = {part: 1 + part % 3 for part in range(1 << model.bits)}
        got = katz.score(df, model).collect()
    finally:
        katz.PART_BYTES, katz.PART_WORDS, katz.PART_TOKENS = old
    split = [(i, [w.lower() for w in re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())] + ["end"]) for i, t in rows]
    train = [w for i, w in split if zlib.crc32(str(i).encode()) % 7 != 2]
    uni = collections.Counter(x for w in train for x in w)
    pairs = collections.Counter(p for w in train for p in zip(["begin", *w[:-1]], w))
    after = collections.Counter()
    for (a, _), n in pairs.items():
        after[a] += n
    total = sum(uni.values())
    d1, d2 = katz._discounts(collections.Counter(uni.values()), 1), katz._discounts(collections.Counter(pairs.values()), 2)
    held = sum(d1.get(n, 1) * n for n in uni.values())
    unknown = max(1 - held / total, 1 / (total + 1))
    single = lambda w: (1 - unknown) / held * d1.get(uni[w], 1) * uni[w] if w in uni else unknown
    seen, low = collections.Counter(), collections.Counter()
    for (a, b), n in pairs.items():
        if n >= 2:
            seen[a] += d2.get(n, 1) * n / after[a]
            low[a] += single(b)

    def chance(a, b):
        f = after[a] / (after[a] + 1) if a in after and (1 - seen[a]) * after[a] < 1e-9 else 1
        if pairs.get((a, b), 0) >= 2:
            return f * d2.get(pairs[a, b], 1) * pairs[a, b] / after[a]
        return (1 - seen[a] * f) / max(1 - low[a], 1e-12) * single(b)

    want = []
    for i, w in split:
        s = sum(math.log10(chance(a, b)) for a, b in zip(["begin", *w[:-1]], w))
        base = sum(math.log10((uni[x] + 1) / (total + len(uni) + 1)) for x in w)
        want.append((str(i), len(w), sum(x in uni for x in w), total, pytest.approx(base), pytest.approx(s)))
    got = by_id(got, "n_tokens", "n_known", "train_tokens", "base_score", "score")
    assert [g[:4] for g in got] == [w[:4] for w in sorted(want, key=lambda w: w[:4])]
    for g, w in zip(got, sorted(want, key=lambda w: w[:4])):
        assert g[4] == w[4] and g[5] == w[5]
    for a in list(after)[:20]:  # exactly normalised
        assert sum(chance(a, b) for b in uni) + chance(a, "?") == pytest.approx(1)
    assert katz.score(odd, model).count() == len(ODD)
    assert katz.score(none, katz.fit(none)).count() == 0


def test_katz_query_keeps_pairs_seen_once(spark, sf, docs):
    split = [(i, [w.lower() for w in re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())] + ["end"]) for i, t in docs]
    train = [w for i, w in split if zlib.crc32(str(i).encode()) % 7 != 2]
    uni = collections.Counter(x for w in train for x in w)
    pairs = collections.Counter(p for w in train for p in zip(["begin", *w[:-1]], w))
    assert 2 * sum(n == 1 for n in pairs.values()) > len(pairs)  # most pairs
    total = sum(uni.values())
    d1, d2 = katz._discounts(collections.Counter(uni.values()), 1), katz._discounts(collections.Counter(pairs.values()), 1)
    held = sum(d1.get(n, 1) * n for n in uni.values())
    unknown = max(1 - held / total, 1 / (total + 1))
    single = lambda w: (1 - unknown) / held * d1.get(uni[w], 1) * uni[w] if w in uni else unknown
    after, seen, low = collections.Counter(), collections.Counter(), collections.Counter()
    for (a, _), n in pairs.items():
        after[a] += n
    for (a, b), n in pairs.items():
        seen[a] += d2.get(n, 1) * n / after[a]
        low[a] += single(b)

    def chance(a, b):
        if a not in after:
            return single(b)
        f = after[a] / (after[a] + 1) if (1 - seen[a]) * after[a] < 1e-9 else 1
        if (a, b) in pairs:
            return f * d2.get(pairs[a, b], 1) * pairs[a, b] / after[a]
        return (1 - seen[a] * f) / max(1 - low[a], 1e-12) * single(b)

    want = {i: sum(math.log10(chance(a, b)) for a, b in zip(["begin", *w[:-1]], w)) for i, w in split}
    got = {r["doc_id"]: r["score"] for r in QUERIES["op6_katz_backoff"](spark, sf).collect()}
    assert got == {i: pytest.approx(s) for i, s in want.items()}


# ------------------------------------------------------------------ queries and pipeline


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, name):
    assert difference(QUERIES[name](spark, sf).toPandas(), connect(sf).execute(SQL[name]).df()) is None


def test_pipeline(spark, sf, docs):
    source = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["near duplicates"](spark, source, sf)
    want = {i for i, (_, root) in plain_components(docs).items() if i == root}
    assert kept.columns == source.columns and {r["doc_id"] for r in kept.collect()} == want
    cut = stages["repeated passages"](spark, source, sf)
    texts = {str(i): k.decode("utf-8", "ignore") for i, _, _, _, k in plain_repeats(docs)}
    assert cut.columns == source.columns and {str(r["doc_id"]): r["text"] for r in cut.collect()} == texts
    judged = quality.judge(source, spark.read.parquet(f"{sf}/labels.parquet")).filter("kept").count()
    assert stages["quality rules"](spark, source, sf).count() == judged
    packed = corpus_pipeline.run(spark, sf)
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 2048").count() == 0
