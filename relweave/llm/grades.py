"""Quality classifier: ordinal (cumulative-link) regression on graded ratings.

One weight per hashed text feature is shared by all grades, and rising thresholds cut the scale:
P(grade <= k) = sigmoid(threshold_k - w.x). The expected grade orders documents; the tail probability
P(grade >= k) selects them. Shards of a bounded labelled sample are fitted apart and averaged, weighted
by their rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relweave.llm.common import bucket_of, documents, map_batches, type_of, values
from relweave.llm.textmodel import MAX_TRAIN, grams, training_rows

FOLD = (3, 1)
BITS, SIZES = 12, (3,)
SHARDS = 6
_STYLE = 7


def features(text: str) -> np.ndarray:
    """Root counts of hashed byte 3-grams at length one, then a few shares that describe the style."""
    counts = np.sqrt(np.bincount(grams(text, BITS, SIZES), minlength=1 << BITS)).astype(np.float32)
    words, n = text.split(), max(1, len(text))
    lines = [x for x in text.split("\n") if x.strip()]
    style = [
        np.log1p(len(words)) / 5,
        len(set(words)) / max(1, len(words)),
        sum(map(len, words)) / max(1, len(words)) / 10,
        sum(text.count(c) for c in "#*$%&|<>!") / n * 5,
        len(set(lines)) / max(1, len(lines)),
        sum(1 for a, b in zip(words, words[1:]) if a == b) / max(1, len(words)) * 2,
        (sum(c.isupper() for c in text) / n) * 2,
    ]
    return np.concatenate([counts / max(1e-6, float(np.sqrt((counts**2).sum()))), np.array(style, np.float32)])


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray  # rising; one fewer than grades


def fit(
    df: DataFrame, ratings: DataFrame, grade: str = "grade", doc_id: str = "doc_id", text: str = "text",
    bound: int = MAX_TRAIN,
) -> Model:
    """Fit on rated documents outside the held-out fold; grades are integers from 0.

    Null grades are left out. Without rated rows all weights are 0 and there is one threshold, 0.
    """
    rows = training_rows(df, ratings, grade, FOLD, doc_id, text, bound)
    top = rows.agg(F.max("label")).first()[0]
    if not top:
        return Model(np.zeros((1 << BITS) + _STYLE), np.zeros(1))

    def shard(batches):
        x, y = [], []
        for batch in batches:
            y += batch["label"].to_pylist()
            x += [features(t) for t in values(batch["text"])]
        if x:
            w, cuts = _fit(np.array(x), np.array(y), top)
            yield pa.RecordBatch.from_pydict({"n": [len(y)], "model": [np.concatenate([w, cuts]).tobytes()]})

    # deal rows by number, so that every shard holds every grade in proportion
    dealt = rows.repartition(SHARDS, F.xxhash64("doc_id", F.lit(3)))
    parts = dealt.mapInArrow(shard, "n long, model binary").collect()  # one model per shard
    n = np.array([r["n"] for r in parts], float)
    mean = (n / n.sum()) @ np.array([np.frombuffer(r["model"], float) for r in parts])
    return Model(mean[:-top], np.sort(mean[-top:]))


def _fit(x: np.ndarray, y: np.ndarray, top: int, rounds: int = 200, penalty: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and rising thresholds of greatest penalised likelihood, by Adam steps."""
    n, d = x.shape
    at_most = np.array([(y <= k).mean() for k in range(top)]).clip(0.01, 0.99)
    w, cuts = np.zeros(d), np.maximum.accumulate(np.log(at_most / (1 - at_most))) + 1e-3 * np.arange(top)
    m, s = np.zeros(d + top), np.zeros(d + top)
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for t in range(1, rounds + 1):
        z = x @ w.astype(np.float32)
        ends = np.concatenate([np.full((n, 1), 0.0), sig(cuts[None, :] - z[:, None]), np.full((n, 1), 1.0)], 1)
        low, high = ends[np.arange(n), y], ends[np.arange(n), y + 1]
        p = np.maximum(high - low, 1e-9)
        dlow, dhigh = low * (1 - low) / p, high * (1 - high) / p  # the outer ends add nothing
        gz = (dhigh - dlow) / n
        gcut = np.array([(dlow[y == k + 1].sum() - dhigh[y == k].sum()) / n for k in range(top)])
        g = np.concatenate([x.T @ gz.astype(np.float32) + penalty * w, gcut])
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
        w, cuts = w - step[:d], np.maximum.accumulate(cuts - step[d:])
    return w, cuts


def rate(df: DataFrame, model: Model, tail: int = 1, doc_id: str = "doc_id", text: str = "text", least: float = 0.5) -> DataFrame:
    """(doc_id, held_out, expected_grade, tail_probability, kept): P(grade >= tail), kept from ``least``.

    Every row is rated, null texts as empty ones; a null id is not held out. Other columns are not read.
    """
    docs = documents(df, doc_id, text)

    def run(batch):
        z = np.array([features(t) @ model.weights for t in values(batch["text"])])
        above = 1 / (1 + np.exp(-np.clip(z[:, None] - model.thresholds[None, :], -30, 30)))
        return {"doc_id": batch["doc_id"], "expected_grade": above.sum(1), "tail_probability": above[:, tail - 1]}

    rated = map_batches(docs, run, f"doc_id {type_of(docs, 'doc_id')}, expected_grade double, tail_probability double")
    held = F.coalesce(bucket_of("doc_id", FOLD[0]) == FOLD[1], F.lit(False)).alias("held_out")
    return rated.select("doc_id", held, "expected_grade", "tail_probability", (F.col("tail_probability") >= least).alias("kept"))
