"""Toxicity by weak supervision: voters, a generative label model, and a linear classifier.

* Voters. Lexicon voters are byte n-grams (parts of words, so that inflections and other languages
  count) that stand out in toxic training documents; pattern voters look at how many of them a text
  holds. A voter fires or abstains.
* Label model. Every document has a hidden label; a voter fires with one chance on toxic and with
  another on clean documents. Expectation maximisation estimates both, the share of toxic documents,
  and how far voters agree beyond what the hidden label explains: a voter's evidence is divided by the
  number of voters it repeats, so correlated voters do not count several times. The given label is one
  more voter of fixed accuracy.
* Classifier. Logistic regression on the n-grams, fitted to the posterior labels.

All of this looks at windows of bounded length, so that a long text does not gather evidence by its length:
a training document is its window with the most lexicon n-grams, and a text has the score of its greatest
window. Buckets of n-grams only narrow the search; a hit is the n-gram itself.

Fitting looks at a bounded sample of labelled rows outside the held-out fold; scores need one pass.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relweave.llm.common import bucket_of, documents, map_batches, type_of, values
from relweave.llm.textmodel import MAX_TRAIN, buckets_of, grams, keys_in, padded, training_rows

FOLD = (3, 1)
BITS, SIZES = 20, (4, 5, 6)
FEATURES, VOTERS = 4_096, 96
THRESHOLD = 0.7
#: Bytes of a window, and from one window to the next.
WINDOW, STEP = 4_096, 2_048
_LABEL_ACCURACY = 0.95


@dataclass
class Model:
    """Weights of n-grams, in rising order, and the intercept."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float

    def scorer(self):
        hits = finder(self.keys)

        def score(text: str) -> float:
            z = self.bias + max(float(self.weights[at].sum()) for at in hits(text))
            return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

        return score


def finder(keys: np.ndarray):
    """A function from a text to the places among sorted ``keys`` of the n-grams of each window."""
    marked = np.zeros(1 << BITS, bool)
    marked[buckets_of(keys, BITS)] = True

    def hits(text: str):
        for window in windows(text):
            found = keys_in(window, marked, BITS, SIZES)
            at = np.searchsorted(keys, found)
            yield at[np.append(keys, -1)[at] == found]

    return hits


def windows(text: str):
    """Overlapping windows of the padded text, which together hold every n-gram."""
    b = padded(text)
    for start in range(0, max(0, len(b) - WINDOW) + STEP, STEP):
        yield b[start : start + WINDOW]


def fit(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", bound: int = MAX_TRAIN) -> Model:
    """Fit on labelled documents outside the held-out fold.

    Without labelled rows of both kinds every text scores the share of toxic rows (0 without rows).
    """
    rows = training_rows(df, labels, label, FOLD, doc_id, text, bound)
    both = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    n_pos, n_neg = both.get(1, 0), sum(both.values()) - both.get(1, 0)
    if not n_pos or not n_neg:
        share = min(max(n_pos / max(1, n_pos + n_neg), 1e-6), 1 - 1e-6)
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log(share / (1 - share))))

    def standing_out(pos, neg):
        """How much n-grams stand out in toxic documents, 0 where they do not."""
        lift = np.log((pos + 0.5) / (n_pos + 1)) - np.log((neg + 0.5) / (n_neg + 1))
        return np.where((pos >= max(3, 0.004 * n_pos)) & (lift > 1.5), pos * lift, 0.0)

    def count(batches):
        seen = np.zeros((2, 1 << BITS), np.uint32)
        for batch in batches:
            for y, t in zip(batch["label"].to_pylist(), values(batch["text"])):
                seen[int(y == 1)][grams(t, BITS, SIZES)] += 1  # once a document, however often it occurs
        yield pa.RecordBatch.from_pydict({"seen": [seen.tobytes()]})

    def add(batches):
        total = np.zeros((2, 1 << BITS), np.int64)
        for batch in batches:
            for raw in values(batch["seen"]):
                total += np.frombuffer(raw, np.uint32).reshape(2, -1)
        neg, pos = total
        value = standing_out(pos, neg)
        good = np.flatnonzero(value)
        best = good[np.argsort(-value[good], kind="stable")][:FEATURES]
        yield pa.RecordBatch.from_pydict({"bucket": np.sort(best)})

    # six vectors of fixed size are all that meets in one task
    vectors = rows.repartition(6, "doc_id").mapInArrow(count, "seen binary")
    buckets = np.array([r[0] for r in vectors.repartition(1).mapInArrow(add, "bucket long").collect()], np.int64)
    marked = np.zeros(1 << BITS, bool)
    marked[buckets] = True

    def narrowed(batch):
        """What the n-grams of these buckets are, and in how many documents of each label."""
        found = [keys_in(padded(t), marked, BITS, SIZES) for t in values(batch["text"])]
        toxic = np.repeat(batch["label"].to_numpy(zero_copy_only=False) == 1, [len(x) for x in found])
        key, where = np.unique(np.concatenate(found), return_inverse=True)
        pos = np.bincount(where, toxic, len(key)).astype(np.int64)
        return {"key": key, "pos": pos, "neg": np.bincount(where, minlength=len(key)) - pos}

    counted = map_batches(rows, narrowed, "key long, pos long, neg long").groupBy("key").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    # a key without ``least`` toxic documents is no feature, and few buckets hold more than one that has them
    least = max(3, 0.004 * n_pos)
    keys = counted.filter(F.col("pos") >= least).orderBy(F.desc("pos"), "neg", "key").limit(8 * FEATURES).collect()
    key, pos, neg = (np.array([r[c] for r in keys], np.int64) for c in ("key", "pos", "neg"))
    value = standing_out(pos, neg)
    good = np.flatnonzero(value)
    keys = np.sort(key[good[np.lexsort((key[good], -value[good]))][:FEATURES]])

    def held(batch):
        hits = finder(keys)
        found = [max(hits(t), key=len) for t in values(batch["text"])]
        return {"label": batch["label"], "doc_id": batch["doc_id"], "held": [x.astype(np.int32).tobytes() for x in found]}

    listed = map_batches(rows, held, f"label int, doc_id {type_of(rows, 'doc_id')}, held binary")
    listed = listed.orderBy("doc_id", "label").collect()  # a few numbers for each of a bounded number of rows
    y = np.array([r["label"] == 1 for r in listed], float)
    has = [np.frombuffer(r["held"], np.int32) for r in listed]
    row = np.repeat(np.arange(len(has)), [len(x) for x in has])
    col = np.concatenate(has) if len(row) else np.zeros(0, np.int64)
    posterior = label_model(votes(row, col, y, len(keys)), y)
    weights, bias = _logistic(row, col, posterior, len(keys))
    return Model(keys, weights, bias)


def votes(row: np.ndarray, col: np.ndarray, y: np.ndarray, n_features: int) -> np.ndarray:
    """The vote matrix: lexicon voters that each add toxic documents to those found, and patterns."""
    n = len(y)
    lexicon, open_ = [], y > 0
    for _ in range(VOTERS):
        won = np.bincount(col[open_[row]], minlength=n_features)
        if not n_features or won.max() < 2:
            break
        best = int(won.argmax())
        lexicon.append(best)
        open_[row[col == best]] = False
    fired = np.zeros((n, len(lexicon) + 4), bool)
    for j, f in enumerate(lexicon):
        fired[row[col == f], j] = True
    hits = np.bincount(row, minlength=n)
    for j, least in enumerate((1, 3, 8)):
        fired[:, len(lexicon) + j] = hits >= least
    fired[:, -1] = hits == 0
    return fired


def label_model(fired: np.ndarray, y: np.ndarray, rounds: int = 12) -> np.ndarray:
    """The chance that each document is toxic, given its votes and its label."""
    v = fired.astype(float)
    told = np.where(y > 0, _LABEL_ACCURACY, 1 - _LABEL_ACCURACY)
    p = told.copy()
    for _ in range(rounds):
        toxic, clean = p.sum() + 1, (1 - p).sum() + 1
        on1 = (p @ v + 0.5) / (toxic + 1)
        on0 = ((1 - p) @ v + 0.5) / (clean + 1)
        rest = v - (np.outer(p, on1) + np.outer(1 - p, on0))  # what the hidden label leaves unexplained
        spread = np.sqrt((rest**2).mean(0)) + 1e-9
        alike = np.clip((rest.T @ rest) / len(v) / np.outer(spread, spread), 0, 1)
        repeats = alike.sum(1)
        llr = v @ ((np.log(on1) - np.log(on0)) / repeats) + (1 - v) @ ((np.log(1 - on1) - np.log(1 - on0)) / repeats)
        z = llr + np.log(toxic / clean) + np.log(told / (1 - told))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    return p


def _logistic(row, col, target, n_features: int, rounds: int = 400, penalty: float = 2e-4) -> tuple[np.ndarray, float]:
    """Weights and intercept for soft labels, by accelerated gradient steps (Adam)."""
    w, b, n = np.zeros(n_features), 0.0, len(target)
    m, s = np.zeros(n_features + 1), np.zeros(n_features + 1)
    for t in range(1, rounds + 1):
        z = b + np.bincount(row, w[col], n)
        miss = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target
        g = np.append(np.bincount(col, miss[row], n_features) / n + penalty * w, miss.mean())
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def score(df: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row; a null or empty text has the score of no
    evidence; a null id is not held out. Rows stay apart; other columns are not read."""
    docs = documents(df, doc_id, text)

    def run(batch):
        one = model.scorer()
        return {"doc_id": batch["doc_id"], "score": [one(t) for t in values(batch["text"])]}

    scored = map_batches(docs, run, f"doc_id {type_of(docs, 'doc_id')}, score double")
    held = F.coalesce(bucket_of("doc_id", FOLD[0]) == FOLD[1], F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
