"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, released, sliced

#: A word, or a run of other signs that aren't white space.
TOKEN = re.compile(r"\w+|[^\w\s]+")
_ids: dict[str, int] = {}


def features(text: str | None, bits: int, orders: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed n-grams (1 to ``orders`` tokens) of the whole text and their weights, of length 1 together. Place 0 is a constant."""
    tokens = TOKEN.findall(text or "")
    if len(_ids) > 100_000:
        _ids.clear()
    for t in set(tokens).difference(_ids):
        _ids[t] = zlib.crc32(t.encode("utf-8", "surrogatepass"))
    h = np.fromiter(map(_ids.__getitem__, tokens), np.uint64, len(tokens))
    grams, last = [h], h
    for n in range(1, orders):
        last = last[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[n:] + np.uint64(n)
        grams.append(last)
    mixed = np.concatenate(grams) * np.uint64(0xD6E8FEB86659FD93)
    places, counts = np.unique((mixed >> np.uint64(64 - bits)).astype(np.int64), return_counts=True)
    weights = np.sqrt(counts)
    return np.append(places, 1 << bits), np.append(weights / max(np.sqrt(weights @ weights), 1e-12), 0.3)


def _sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -35, 35))))


def follow_leader(rows: list[tuple[np.ndarray, np.ndarray, int]], bits: int, passes: int = 3, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.5) -> np.ndarray:
    """Weights after per-coordinate FTRL-proximal updates over the rows, in order, ``passes`` times."""
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)

    def at(i: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z[i]) <= l1, 0.0, -(z[i] - np.sign(z[i]) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2))

    for _ in range(passes):
        for i, x, y in rows:
            w = at(i)
            g = (_sigmoid(float(w @ x)) - y) * x
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha * w
            n[i] += g * g
    return at(np.arange(len(z)))


def train(labelled: DataFrame, key: str = "doc_id", text: str = "text", label: str = "label", bits: int = 18, most: int = 24_000, learners: int = 8, n: int | None = None) -> np.ndarray:
    """Weights learnt from a sample of about ``most`` labelled rows (a documented bound; all, if there are fewer), picked by their keys' hashes.

    The sample is dealt by key over ``learners`` tasks; each runs FTRL over its rows in the order of their keys, and
    the driver takes the mean of their weights (``learners`` vectors of 2^bits + 1 numbers, whatever the input).
    Rows whose label is null are left out; without any row, all weights are 0 and every score is one half."""
    rows = bounded_sample(labelled.filter(F.col(label).isNotNull()), key, most, n)
    rows = rows.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"), F.col(label).cast("int").alias("label"))
    rows = rows.withColumn("learner", F.pmod(F.xxhash64("key", F.lit("learner")), F.lit(learners)))

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["key", "text", "label"]).sample(frac=1, random_state=7)
        w = follow_leader([(*features(t, bits), y) for t, y in zip(pdf.text, pdf.label, strict=True)], bits)
        released()
        return pd.DataFrame({"n": [len(pdf)], "w": [w.astype("<f4").tobytes()]})

    parts = rows.groupBy("learner").applyInPandas(learn, "n long, w binary").collect()
    if not parts:
        return np.zeros((1 << bits) + 1, "f4")
    return sum(np.frombuffer(p["w"], "<f4") * p["n"] for p in parts) / sum(p["n"] for p in parts)


def scorer(spark, weights: np.ndarray, bits: int = 18):
    """A function from a text column to its score, from 0 to 1: the sigmoid of the sparse dot product. Null and empty texts have only the constant."""
    shared = spark.sparkContext.broadcast(weights)  # 2^bits + 1 numbers

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        w = shared.value
        for texts in sliced(batches):
            out = np.empty(len(texts))
            for k, t in enumerate(texts):
                i, x = features(t.as_py(), bits)
                out[k] = _sigmoid(float(w[i] @ x))
            yield pa.array(out)
        _ids.clear()
        texts = out = None
        released()

    return score


def predicted(score: str | Column, threshold: float = 0.7) -> Column:
    return (F.col(score) if isinstance(score, str) else score).__ge__(threshold).cast("int")
