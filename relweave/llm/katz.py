"""Katz back-off language model: Good-Turing discounts, exactly normalised back-off weights.

P(w2 | w1) = d(c) c(w1 w2) / c(w1) for pairs seen at least ``least`` times in training, else
alpha(w1) P(w2), with alpha(w1) = (1 - sum of the seen P(. | w1)) / (1 - sum of P over the same words), so
that every context sums to one. P(w) is the discounted share of a word; all unknown words together form
one word that holds the mass the discounts free. Discounts come from the counts of counts of the whole
training part. A text begins in a context of its own and ends with an end token.

The recursion is rewritten per token, so that single words and pairs can be looked up apart:

    log P(w2 | w1) = [log P(w2) + log alpha(w1)] + delta(w1, w2),

where delta is 0 for pairs that are not in the model. Counts, tables and look-ups are partitioned by
hash ranges of the word or pair; the number of partitions follows the size of the corpus, so that a
partition fits in a task. Words are 64-bit hashes, and rows carry sorted vectors of them.
"""

from __future__ import annotations

import collections
import math
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relweave.llm.common import bucket_of, documents, slices, type_of
from relweave.session import discard, materialize, release

FOLD = (7, 2)
#: Counts up to this are discounted.
DISCOUNTED = 5
#: Bytes of text per partition of the tables.
PART_BYTES = 8_000_000
#: Bytes of text that a task turns into vectors at once when it counts, and when it asks.
COUNT_BYTES, ASK_BYTES = 8_000_000, 8_000_000
#: Distinct words in a part of the table that words are looked up in, and tokens that ask one part at once.
PART_WORDS, PART_TOKENS = 100_000, 4_000_000
#: The texts are scored in so many shares, one after the other, so that only one share's questions are on disk.
ROUNDS = 3
_U = np.uint64
BEGIN, END = _U(1), _U(2)
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: Masks of the first bytes of eight, by their number.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], _U)
_SCHEMA = "kind string, bucket int, a binary, b binary, c binary, d binary"
_BLANK = {c: b"" for c in "abcd"}
#: Rows of these kinds hold many sorted keys, and hold them squeezed: they fill the disk between the steps.
_SQUEEZED = ("pair", "delta")


def _words(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of every word, in order; by pieces of a megabyte, so that a long text needs little at once."""
    hashes, starts, at = [np.zeros(0, _U)], [np.zeros(0, np.int64)], 0
    while at < len(raw):
        gap = _SPACE.search(raw, at + (1 << 20))
        end = gap.start() if gap else len(raw)
        piece = np.frombuffer(raw[at:end].lower() + bytes(8), np.uint8)  # ASCII only, as these are bytes
        inside = np.zeros(end - at + 2, np.int8)
        body = piece[:-8]
        inside[1:-1] = (body != 32) & (body - np.uint8(9) > 4)
        edges = np.flatnonzero(np.diff(inside))
        first, size = edges[::2], edges[1::2] - edges[::2]
        eight = np.ndarray(len(piece) - 7, "<u8", piece, strides=(1,))  # the eight bytes from every place on
        key = size.astype(_U) * _U(0x9E3779B97F4A7C15)
        rest = np.arange(len(first))
        for done in range(0, int(size.max(initial=0)), 8):
            rest = rest[size[rest] > done]
            x = key[rest] ^ (eight[first[rest] + done] & _FIRST[np.minimum(size[rest] - done, 8)])
            x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
            x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
            key[rest] = x ^ (x >> _U(32))
        hashes.append(np.maximum(key, _U(3)))
        starts.append(first + at)
        at = end
    return np.concatenate(hashes), np.concatenate(starts)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * _U(0x9E3779B97F4A7C15) ^ (b + _U(0x632BE59BD9B4E019)) * _U(0xC2B2AE3D27D4EB4F)
    return (x ^ (x >> _U(29))) * _U(0xD6E8FEB86659FD93)


def _sequence(texts) -> tuple[np.ndarray, list[int]]:
    """The tokens of a batch, an end token after each text, and the tokens of each text."""
    found = [t.as_py() for t in texts]
    word, start = _words(b"\n".join(found))
    n = np.diff(np.searchsorted(start, np.cumsum([0, *(len(t) + 1 for t in found)])))
    out = np.full(len(word) + len(found), END)
    out[np.arange(len(word)) + np.repeat(np.arange(len(found)), n)] = word
    return out, (n + 1).tolist()


def _tokens(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, token, text number) of every token of a batch, the end tokens included."""
    token, size = _sequence(texts)
    context = np.concatenate([[BEGIN], token[:-1]])
    context[context == END] = BEGIN  # after an end, the next text begins
    return context, token, np.repeat(np.arange(len(size)), size)


def _distinct_pairs(place: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, word, count) of the different pairs in a sequence, by context and word.

    ``place`` are the places of its tokens in ``word``, which is sorted and begins with the end token; it
    is used up. A pair is one number, sorted where it stands: two of its places and no list of positions.
    """
    size = _U(len(word))
    key = place.astype(_U)
    del place
    key[1:] += key[:-1].copy() * size  # an end, at place 0, stands for the begin that follows it
    key.sort()
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
    n = np.diff(start).astype(np.uint32)
    key = key[start[:-1]]
    del start
    first = word.copy()
    first[0] = BEGIN
    return first[key // size], word[key % size], n


def _asked(key: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, text, count) of the different pairs of keys and 16-bit text numbers, in order: two plain sorts."""
    order = np.argsort(key)
    key, of = key[order], of[order]
    new = np.concatenate([[False], key[1:] != key[:-1]])
    both = np.cumsum(new, dtype=_U) << _U(16) | of
    both.sort()
    key = key[np.flatnonzero(np.concatenate([[True], new[1:]]))]
    start = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
    both, times = both[start], np.diff(np.append(start, len(both))).astype("<u4")
    return key[both >> _U(16)], (both & _U(0xFFFF)).astype(np.uint16), times


def _runs(bucket: np.ndarray):
    """(value, start, end) of every run of equal values."""
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(bucket) else []
    for start, end in zip(cuts[:-1], cuts[1:]):
        yield int(bucket[start]), start, end


def _deal(kind: str, key: np.ndarray, bits: int, *columns: np.ndarray):
    """One row per hash range for vectors that are sorted by ``key``; the key itself is squeezed as ``a`` of pairs."""
    for own, start, end in _runs(key >> _U(64 - bits)):
        blobs = dict(zip("abcd", (c[start:end].tobytes() for c in columns)))
        if kind in _SQUEEZED:
            blobs["a"] = _squeeze(columns[0][start:end])
        yield {"kind": kind, "bucket": own, **_BLANK, **blobs}


def _squeeze(key: np.ndarray) -> bytes:
    """Sorted keys as their first one and the bytes, plane by plane, of the steps between them."""
    step = np.diff(key, prepend=key[:1]).astype("<u8")
    width = max(1, (int(step.max()).bit_length() + 7) // 8)
    return bytes([width]) + key[:1].astype("<u8").tobytes() + step.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _loosen(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8, offset=9).reshape(raw[0], -1)
    step = np.zeros((planes.shape[1], 8), np.uint8)
    step[:, : raw[0]] = planes.T
    return np.cumsum(step.view("<u8").ravel(), dtype=_U) + np.frombuffer(raw, "<u8", 1, 1)


def _rows(found: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(found, pa.schema([("kind", pa.string()), ("bucket", pa.int32()), *[(c, pa.binary()) for c in "abcd"]]))


def _of(table: pa.Table, kind: str, column: str, dtype) -> np.ndarray:
    parts = [v for k, v in zip(table["kind"].to_pylist(), table[column].to_pylist()) if k == kind]
    return np.frombuffer(b"".join(parts), dtype)


def _keys(table: pa.Table, kind: str) -> np.ndarray:
    """The squeezed keys of a kind, in the order of its rows."""
    found = [_loosen(v.as_py()) for k, v in zip(table["kind"].to_pylist(), table["a"]) if k == kind and len(v.as_py())]
    return np.concatenate(found) if found else np.zeros(0, _U)


def _sum_by(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    unique, where = np.unique(key, return_inverse=True)
    return unique, np.bincount(where, value, len(unique))


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of wanted keys in sorted keys, and whether they are there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _grouped(df: DataFrame, fn, schema: str = _SCHEMA, by: tuple[str, ...] = ("bucket",)) -> DataFrame:
    return df.groupBy(*by).applyInArrow(fn, schema)


def _out(found: list[dict]) -> pa.Table:
    return pa.Table.from_batches([_rows(found)])


class Model:
    """The written tables (kind, bucket, vectors) and the few numbers that hold for all of them.

    Words are asked by the first ``word_bits`` bits of their hashes, pairs by ``bits``. ``word_turns`` and
    ``pair_turns`` say for a part how many copies of it share the questions, so that a frequent word or
    pair does not bring all its occurrences to one task."""

    def __init__(self, tables: DataFrame, bits: int, tokens: int, types: int, unknown: float,
                 word_bits: int, word_turns: dict[int, int], pair_turns: dict[int, int]):
        self.tables, self.bits, self.tokens, self.types, self.unknown = tables, bits, tokens, types, unknown
        self.word_bits, self.word_turns, self.pair_turns = word_bits, word_turns, pair_turns


def _discounts(n: dict[int, int], start: int) -> dict[int, float]:
    """Katz's Good-Turing discounts for counts from ``start``; 1 where the counts of counts allow none."""
    k, out = DISCOUNTED, {}
    tail = (k + 1) * n.get(k + 1, 0) / n[1] if n.get(1) else 1.0
    for r in range(start, k + 1):
        d = 1.0
        if n.get(r) and tail < 1:
            d = ((r + 1) * n.get(r + 1, 0) / (r * n[r]) - tail) / (1 - tail)
        out[r] = d if 0 < d < 1 else 1.0
    return out


def fit(df: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 1) -> Model:
    """Count and build the tables from the documents outside the held-out fold.

    Pairs seen less than ``least`` times are left to the back-off; 1 keeps all.
    Null texts are empty and count their end token; a null id is a training document. A table without
    training rows gives a model in which every word is unknown.
    """
    docs = documents(df, doc_id, text)
    docs = docs.filter(F.coalesce(bucket_of("doc_id", FOLD[0]), F.lit(-1)) != FOLD[1]).select(F.col("text").cast("binary").alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(2, math.ceil(math.log2(max(1, size / PART_BYTES))))

    def tally(batch) -> pa.RecordBatch:
        """Counts of one slice; its vectors are gone before the next one is read."""
        word, place = np.unique(_sequence(batch["text"])[0], return_inverse=True)
        found = list(_deal("word", word, bits, word, np.bincount(place).astype(np.uint32)))
        a, b, n = _distinct_pairs(place.astype(np.uint32), word)
        # by the hash of the pair: all pairs of a frequent word would be too many for one task
        part = (_pair(a, b) >> _U(64 - bits)).astype(np.uint32)
        order = np.argsort(part, kind="stable")
        for own, i, j in _runs(part[order]):
            x = order[i:j]
            found.append({"kind": "pair", "bucket": own, **_BLANK, "a": _squeeze(a[x]), "b": b[x].tobytes(), "c": n[x].tobytes()})
        return _rows(found)

    def count(batches):
        for batch in (part for whole in batches for part in slices(whole, "text", COUNT_BYTES)):
            yield tally(batch)

    def merge(table: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _out([])
        bucket = table["bucket"][0].as_py()
        word, n = _sum_by(_of(table, "word", "a", "<u8"), _of(table, "word", "b", "<u4"))
        b, c = (_of(table, "pair", x, t) for x, t in (("b", "<u8"), ("c", "<u4")))
        a = _keys(table, "pair")
        order = np.lexsort((b, a))
        a, b, c = a[order], b[order], c[order]
        start = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, int)
        c = np.add.reduceat(c.astype(np.int64), start) if len(a) else np.zeros(0, np.int64)
        a, b = a[start], b[start]
        ranks = np.concatenate([np.bincount(np.minimum(x.astype(np.int64), DISCOUNTED + 2), minlength=DISCOUNTED + 3) for x in (n, c)])
        stats = np.concatenate([[int(n.sum()), len(word)], ranks]).astype("<i8")
        keep = c >= least
        kept = _squeeze(a[keep]) if keep.any() else b""
        return _out([
            {"kind": "word", "bucket": bucket, **_BLANK, "a": word.tobytes(), "b": n.astype("<i8").tobytes(), "d": stats.tobytes()},
            {"kind": "pair", "bucket": bucket, **_BLANK, "a": kept, "b": b[keep].tobytes(), "c": c[keep].astype("<i8").tobytes()},
        ])

    counted = materialize(_grouped(docs.mapInArrow(count, _SCHEMA), merge), "zstd")
    release(df.sparkSession)
    part_of = {r["bucket"]: np.frombuffer(r["d"], "<i8") for r in counted.filter("kind = 'word'").select("bucket", "d").collect()}  # 20 numbers a partition
    stats = list(part_of.values())
    total = np.sum(stats, 0) if stats else np.zeros(2 + 2 * (DISCOUNTED + 3), int)
    tokens, types = int(total[0]), int(total[1])
    of_words = dict(enumerate(total[2 : DISCOUNTED + 5].tolist()))
    of_pairs = dict(enumerate(total[DISCOUNTED + 5 :].tolist()))
    word_bits = min(bits, math.ceil(math.log2(max(1, types / PART_WORDS))))
    asked = collections.Counter()
    for bucket, x in part_of.items():
        asked[bucket >> (bits - word_bits)] += int(x[0])
    word_turns = {bucket: 1 + n // PART_TOKENS for bucket, n in asked.items()}
    often = max(PART_TOKENS // 4, tokens >> (bits + 2))
    word_d, pair_d = _discounts(of_words, 1), _discounts(of_pairs, least)
    held = sum(d * r * of_words.get(r, 0) for r, d in word_d.items()) + tokens - sum(r * of_words.get(r, 0) for r in word_d)
    unknown = max(1 - held / tokens, 1 / (tokens + 1)) if tokens else 1.0
    scale = (1 - unknown) / held if held else 0.0

    def share(n: np.ndarray) -> np.ndarray:
        d = np.ones(DISCOUNTED + 2)
        for r, v in word_d.items():
            d[r] = v
        return scale * n * d[np.minimum(n, DISCOUNTED + 1)]

    def by_second(batches):
        for batch in batches:
            for a, b, c in zip(*(batch[x].to_pylist() for x in "abc")):
                if not b:
                    continue
                a, b, c = _loosen(a), np.frombuffer(b, "<u8"), np.frombuffer(c, "<i8")
                order = np.argsort(b, kind="stable")
                yield _rows(list(_deal("pair", b[order], bits, b[order], a[order], c[order])))

    def with_count(table: pa.Table) -> pa.Table:
        """The words as they are, and the pairs by their first word with the count of the second."""
        word, n = _of(table, "word", "a", "<u8"), _of(table, "word", "b", "<i8")
        b, a, c = _keys(table, "pair"), _of(table, "pair", "b", "<u8"), _of(table, "pair", "c", "<i8")
        at, _ = _find(word, b)
        n_b = n[at] if len(b) else np.zeros(0, np.int64)
        order = np.argsort(a, kind="stable")
        found = list(_deal("word", word, bits, word, n))
        return _out(found + list(_deal("pair", a[order], bits, a[order], b[order], c[order], n_b[order])))

    pairs = counted.filter("kind = 'pair'").mapInArrow(by_second, _SCHEMA)
    words = counted.filter("kind = 'word'").withColumn("d", F.lit(b""))
    counts = materialize(_grouped(words.unionByName(pairs), with_count), "zstd")
    discard(counted)  # the next step shuffles the pairs again
    release(df.sparkSession)

    def weights(table: pa.Table) -> pa.Table:
        # every word is a context as often as it occurs, and a text's begin as often as its end
        ctx, total = _of(table, "word", "a", "<u8"), _of(table, "word", "b", "<i8")
        ctx = np.where(ctx == END, BEGIN, ctx)
        a = _keys(table, "pair")
        b, c, n_b = (_of(table, "pair", x, t) for x, t in (("b", "<u8"), ("c", "<i8"), ("d", "<i8")))
        p = share(n_b)
        d = np.ones(DISCOUNTED + 2)
        for r, v in pair_d.items():
            d[r] = v
        at, _ = _find(ctx, a)
        high = d[np.minimum(c, DISCOUNTED + 1)] * c / total[at] if len(a) else np.zeros(0)
        seen = np.bincount(at, high, len(ctx)) if len(a) else np.zeros(len(ctx))
        low = np.bincount(at, p, len(ctx)) if len(a) else np.zeros(len(ctx))
        # a context whose pairs hold all mass gives what is left of one count to the back-off
        short = (1 - seen) * total < 1e-9
        factor = np.where(short, total / (total + 1), 1.0)
        alpha = np.log10((1 - seen * factor) / np.maximum(1 - low, 1e-12))
        found = list(_deal("alpha", ctx, bits, ctx, alpha))
        if len(a):
            delta = np.log10(high * factor[at]) - alpha[at] - np.log10(p)
            key = _pair(a, b)
            order = np.argsort(key)
            found += _deal("delta", key[order], bits, key[order], delta[order])
            hot = order[c[order] > often]
            found += _deal("hot", key[hot], bits, c[hot].astype("<i8"))
        return _out(found)

    weighted = _grouped(counts, weights)

    def final_words(batches):
        for batch in batches:
            for bucket, a, b in zip(*(batch[x].to_pylist() for x in ("bucket", "a", "b"))):
                n = np.frombuffer(b, "<i8")
                base = np.log10((n + 1) / (tokens + types + 1))
                yield _rows([{"kind": "word", "bucket": bucket, **_BLANK, "a": a, "b": np.log10(share(n)).tobytes(), "c": base.tobytes()}])

    tables = materialize(weighted.unionByName(counts.filter("kind = 'word'").mapInArrow(final_words, _SCHEMA)), "zstd")
    discard(counts)
    release(df.sparkSession)
    pair_turns = collections.Counter()
    for r in tables.filter("kind = 'hot'").select("bucket", "a").collect():  # at most four times the partitions
        pair_turns[r["bucket"]] += int(np.frombuffer(r["a"], "<i8").sum())
    pair_turns = {bucket: 2 + n // PART_TOKENS for bucket, n in pair_turns.items()}
    return Model(tables.filter("kind <> 'hot'"), bits, tokens, types, unknown, word_bits, word_turns, pair_turns)


def score(df: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row.

    An empty text is its end token. Rows stay apart; a null id is not held out; other columns are not
    read. The scores are sums over partial sums, so their last digits depend on the order of addition.
    """
    docs = documents(df, doc_id, text).select("doc_id", F.col("text").cast("binary").alias("text"))
    own = F.pmod(F.xxhash64("doc_id", "text"), F.lit(ROUNDS))
    scored = None
    for turn in range(ROUNDS):
        part = materialize(_scored(docs.filter(own == turn), model))
        scored = part if scored is None else scored.unionByName(part)
        release(df.sparkSession)
    return scored


def _scored(docs: DataFrame, model: Model) -> DataFrame:
    kind, bits = type_of(docs, "doc_id"), model.bits
    no_word = math.log10(model.unknown)
    no_base = math.log10(1 / (model.tokens + model.types + 1))
    schema = f"kind string, side string, bucket int, turn int, batch long, a binary, b binary, c binary, doc_ids array<{kind}>"
    sides = {"words": ("word", model.word_bits, model.word_turns), "pairs": ("pair", bits, model.pair_turns)}

    def question(part, number: int) -> pa.RecordBatch:
        context, token, doc = _tokens(part["text"])
        doc = doc.astype(np.uint16)
        sizes = np.bincount(doc, minlength=part.num_rows).astype("<i8")
        rows = [("docs", "docs", number % (1 << bits), 0, number, sizes.tobytes(), b"", b"", part["doc_id"].to_pylist())]
        first = np.full(part.num_rows, BEGIN), np.arange(part.num_rows, dtype=np.uint16)
        for name, (side, wide, turns) in sides.items():
            if name == "words":
                key, of = np.concatenate([token, first[0]]), np.concatenate([doc, first[1]])
            else:
                key, of = _pair(context, token), doc
            key, of, times = _asked(key, of)
            bucket = (key >> _U(64 - wide)).astype(np.int64) if wide else np.zeros(len(key), np.int64)
            for own, i, j in _runs(bucket):
                turn = (number ^ (number >> 32)) % turns.get(own, 1)
                rows.append((name, side, own, turn, number, _squeeze(key[i:j]), of[i:j].tobytes(), times[i:j].tobytes(), None))
        kinds = pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 3, pa.list_(part["doc_id"].type)
        names = "kind", "side", "bucket", "turn", "batch", "a", "b", "c", "doc_ids"
        return pa.RecordBatch.from_pydict({n: pa.array(list(v), t) for n, v, t in zip(names, zip(*rows), kinds)})

    def ask(batches):
        number = TaskContext.get().partitionId() << 32
        for batch in (part for whole in batches for part in slices(whole, "text", ASK_BYTES)):
            for at in range(0, batch.num_rows, 50_000):  # text numbers fit in 16 bits
                part = batch.slice(at, 50_000)
                yield question(part, number)
                number += 1

    asked = docs.mapInArrow(ask, schema)

    def copies(turns: dict[int, int]):
        many = F.create_map(*[F.lit(x) for pair in ({-1: 1} | turns).items() for x in pair])
        return F.coalesce(F.try_element_at(many, F.col("bucket")), F.lit(1))

    of_words = F.col("kind").isin("word", "alpha")
    tables = model.tables.withColumn("bucket", F.when(of_words, F.shiftright("bucket", bits - model.word_bits)).otherwise(F.col("bucket")))
    turns = F.when(of_words, copies(model.word_turns)).otherwise(copies(model.pair_turns))
    tables = tables.select(
        "kind", F.when(of_words, F.lit("word")).otherwise(F.lit("pair")).alias("side"), "bucket",
        F.explode(F.sequence(F.lit(0), turns - 1)).alias("turn"), F.lit(None).cast("long").alias("batch"), "a", "b", "c",
        F.lit(None).cast(f"array<{kind}>").alias("doc_ids"),
    )

    def answer(table: pa.Table) -> pa.Table:
        """Sums per text of a batch: log P and log alpha, base, known words, delta."""
        lists, names = [], table["kind"].to_pylist()
        word, p, base = _of(table, "word", "a", "<u8"), _of(table, "word", "b", "<f8"), _of(table, "word", "c", "<f8")
        order = np.argsort(word)
        word, p, base = word[order], p[order], base[order]
        ctx, alpha = _of(table, "alpha", "a", "<u8"), _of(table, "alpha", "b", "<f8")
        order = np.argsort(ctx)
        ctx, alpha = ctx[order], alpha[order]
        pair, delta = _keys(table, "delta"), _of(table, "delta", "b", "<f8")
        order = np.argsort(pair)
        pair, delta = pair[order], delta[order]
        for i, name in enumerate(names):
            if name not in ("words", "pairs", "docs"):
                continue
            if name == "docs":
                lists.append((name, table["batch"][i].as_py(), table["a"][i].as_py(), b"", table["doc_ids"][i].as_py()))
                continue
            key, of = _loosen(table["a"][i].as_py()), np.frombuffer(table["b"][i].as_py(), "<u2")
            times = np.frombuffer(table["c"][i].as_py(), "<u4")
            if name == "words":
                at, here = _find(word, key)
                real = key != BEGIN
                p_all = np.where(here, p[at], no_word) if len(word) else np.full(len(key), no_word)
                b_all = np.where(here, base[at], no_base) if len(word) else np.full(len(key), no_base)
                at, led = _find(ctx, key)
                more = np.where(led & (key != END), alpha[at], 0.0) if len(ctx) else 0.0
                columns = times * (np.where(real, p_all, 0) + more), times * np.where(real, b_all, 0), times * (here & real)
            else:
                at, here = _find(pair, key)
                of = of[here]
                if not len(of):
                    continue
                columns = (times[here] * delta[at[here]],)
            texts, where = np.unique(of, return_inverse=True)
            sums = np.array([np.bincount(where, c, len(texts)) for c in columns])
            lists.append((name, table["batch"][i].as_py(), texts.astype("<u2").tobytes(), sums.tobytes(), None))
        columns = list(zip(*lists)) if lists else [[]] * 5
        types = pa.string(), pa.int64(), pa.binary(), pa.binary(), table.schema.field("doc_ids").type
        return pa.table({n: pa.array(list(c), t) for n, c, t in zip(("kind", "batch", "a", "b", "doc_ids"), columns, types)})

    answers = _grouped(asked.unionByName(tables), answer, f"kind string, batch long, a binary, b binary, doc_ids array<{kind}>", ("side", "bucket", "turn"))

    def total(table: pa.Table) -> pa.Table:
        place = table["kind"].to_pylist().index("docs")
        sizes = np.frombuffer(table["a"][place].as_py(), "<i8")
        sums = np.zeros((3, len(sizes)))
        for name, a, b in sorted(zip(table["kind"].to_pylist(), table["a"].to_pylist(), table["b"].to_pylist())):
            if name != "docs":
                texts = np.frombuffer(a, "<u2")
                part = np.frombuffer(b, "<f8").reshape(-1, len(texts))
                sums[: len(part), texts] += part
        ids = pa.array(table["doc_ids"][place].as_py(), table.schema.field("doc_ids").type.value_type)
        return pa.table({"doc_id": ids, "n_tokens": pa.array(sizes), "n_known": pa.array(sums[2].round().astype(np.int64)), "base_score": pa.array(sums[1]), "score": pa.array(sums[0])})

    result = _grouped(answers, total, f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double", ("batch",))
    held = F.coalesce(bucket_of("doc_id", FOLD[0]) == FOLD[1], F.lit(False)).alias("held_out")
    return result.select("doc_id", held, "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
