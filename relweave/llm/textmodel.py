"""Hashed byte n-grams and the bounded labelled samples that the text models are fitted on."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relweave.llm.common import bucket_of, documents
from relweave.session import materialize

#: Labelled rows a model is fitted on, about: above this, a hash of the id picks the share that fits.
MAX_TRAIN = 20_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


def grams(text: str, bits: int, sizes: tuple[int, ...]) -> np.ndarray:
    """Hash buckets below 2**bits of all byte n-grams (of 1 to 8 bytes) of the padded lower-case text."""
    out = [bucket for bucket, _ in _hashed(padded(text), bits, sizes)]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def padded(text: str) -> np.ndarray:
    """The bytes of the lower-case text between two spaces."""
    return np.frombuffer(b" " + text.encode("utf-8", "replace").lower() + b" ", np.uint8)


def keys_in(b: np.ndarray, marked: np.ndarray, bits: int, sizes: tuple[int, ...]) -> np.ndarray:
    """The distinct n-grams (of 1 to 7 bytes) of ``b`` in marked buckets: their bytes and length in one number."""
    out = [x[marked[bucket]] for bucket, x in _hashed(b, bits, sizes)]
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64)


def buckets_of(keys: np.ndarray, bits: int) -> np.ndarray:
    """The buckets of n-grams given by ``keys_in``."""
    x = keys.astype(np.uint64)
    n = x >> np.uint64(56)
    return _bucket(x ^ n << np.uint64(56), n, bits)


def _bucket(x: np.ndarray, n, bits: int) -> np.ndarray:
    return (((x + np.uint64(7_919) * n) * _ODD) >> np.uint64(64 - bits)).astype(np.int64)


def _hashed(b: np.ndarray, bits: int, sizes: tuple[int, ...]):
    """(buckets, n-grams) of every size."""
    b = b.astype(np.uint64)
    x = np.zeros(len(b), np.uint64)
    for n in range(1, max(sizes) + 1):
        if len(b) < n:
            break
        x = x[: len(b) - n + 1] | b[n - 1 :] << np.uint64(8 * (n - 1))
        if n in sizes:
            yield _bucket(x, np.uint64(n), bits), (x | np.uint64(n << 56)).astype(np.int64)


def training_rows(
    df: DataFrame, labels: DataFrame, label: str, fold: tuple[int, int], doc_id: str, text: str, bound: int = MAX_TRAIN
) -> DataFrame:
    """(doc_id, label, text), written: labelled documents outside the held-out fold.

    ``fold`` is (modulus, held-out remainder) of the id's crc32. Several labels of a document count as
    their largest. At most about ``bound`` documents, whatever the size of the tables; that bound is
    why the ids may be broadcast. Equal texts are kept once per label.
    """
    modulus, held = fold
    marks = labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull())
    marks = marks.groupBy(F.col(doc_id).alias("doc_id")).agg(F.max(label).cast("int").alias("label"))
    marks = marks.filter(bucket_of("doc_id", modulus) != held)
    share = min(1.0, bound / max(1, marks.count()))
    drawn = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(11)), F.lit(1_000_000))
    picked = marks.filter(drawn < round(share * 1_000_000))
    found = documents(df, doc_id, text).join(F.broadcast(picked), "doc_id")
    return materialize(found.dropDuplicates(["label", "text"]).select("doc_id", "label", "text"))
