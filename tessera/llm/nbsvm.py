"""Quality classifier: n-gram indicators scaled by naive Bayes log-count ratios under a linear hinge-loss model.

Tokens are runs of letters, runs of digits and single signs, with case kept; features are the indicators of a text's
unigrams and bigrams, hashed to 2**BITS dimensions. Ratios and weights come from a bounded sample of labelled rows
(SAMPLE); the weights are fitted by dual coordinate descent, the margins of a left-out fifth give the sigmoid that
makes a score. Every whole text is scored, in one pass without a shuffle.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Memo, cut, fresh, id_hash, sampled

BITS = 18
#: The most labelled rows a model is fitted on: those with the smallest hash of the id.
SAMPLE = 6000
SAMPLE_BYTES = 256 << 20  # of their features, which the driver holds
THRESHOLD = 0.3
_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|_")


def features(text: str | None, memo: Memo) -> np.ndarray:
    """Sorted distinct hashed unigrams and bigrams of the whole text."""
    tokens = _TOKEN.findall(text or "")
    h = np.fromiter(map(memo.__getitem__, tokens), dtype=np.uint64, count=len(tokens))
    two = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    one = h * np.uint64(0xD6E8FEB86659FD93)
    return np.unique(np.concatenate((one, two)) >> np.uint64(64 - BITS)).astype(np.int32)


def token_memo() -> Memo:
    return Memo(lambda t: zlib.crc32(t.encode("utf-8", "replace")) + 1)


@dataclass
class Model:
    """score = sigmoid(a * margin + b), margin = weights . (ratio * indicators) / |ratio * indicators| + bias."""

    folded: np.ndarray
    square: np.ndarray
    bias: float
    a: float
    b: float

    def margin(self, x: np.ndarray) -> float:
        norm = float(self.square[x].sum()) if len(x) else 0.0
        return (float(self.folded[x].sum()) / norm**0.5 if norm else 0.0) + self.bias

    def score(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a * margins + self.b, -500, 500)))


def descend(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, c: float = 1.0, epochs: int = 15, seed: int = 7) -> tuple[np.ndarray, float]:
    """L1-loss linear SVM by dual coordinate descent on rows scaled to unit length, with a bias feature."""
    w, bias = np.zeros(len(ratio)), 0.0
    alpha = np.zeros(len(rows))
    values = []
    for x in rows:
        v = ratio[x]
        norm = np.sqrt((v * v).sum())
        values.append(v / norm if norm else v)
    square = np.array([(v * v).sum() + 1.0 for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            x, v = rows[i], values[i]
            g = y[i] * (w[x] @ v + bias) - 1
            new = min(max(alpha[i] - g / square[i], 0.0), c)
            step = (new - alpha[i]) * y[i]
            if step:
                w[x] += step * v
                bias += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w, bias


def sigmoid_fit(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt's a and b by Newton steps, with smoothed targets."""
    pos, neg = (y > 0).sum(), (y <= 0).sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        d, s = p - t, np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(s * margins * margins).sum() + 1e-6, (s * margins).sum()], [(s * margins).sum(), s.sum() + 1e-6]])
        step = np.linalg.solve(h, np.array([(d * margins).sum() + 1e-6 * a, d.sum()]))
        step *= min(1.0, 2.0 / (np.abs(step).max() + 1e-12))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def fit(rows: list[np.ndarray], y: np.ndarray, smoothing: float = 1.0) -> Model:
    """Fit on rows of feature ids and labels 1 and 0; without both labels the model knows only their share."""
    dims = 1 << BITS
    if len(set(y.tolist())) < 2:
        share = (float((y == 1).sum()) + 1) / (len(y) + 2)
        return Model(np.zeros(dims, np.float32), np.ones(dims, np.float32), 0.0, 1.0, float(np.log(share / (1 - share))))
    sign = np.where(y == 1, 1.0, -1.0)

    def once(which: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        count = {}
        for s in (1.0, -1.0):
            own = [rows[i] for i in which if sign[i] == s]
            c = smoothing + np.bincount(np.concatenate(own) if own else np.zeros(0, np.int64), minlength=dims)
            count[s] = c / c.sum()
        ratio = np.log(count[1.0] / count[-1.0])
        return ratio, *descend([rows[i] for i in which], sign[which], ratio)

    def margins(which: np.ndarray, ratio: np.ndarray, w: np.ndarray, bias: float) -> np.ndarray:
        m = Model((w * ratio).astype(np.float32), (ratio * ratio).astype(np.float32), bias, 1, 0)
        return np.array([m.margin(rows[i]) for i in which])

    every = np.arange(len(rows))
    out = every % 5 == 4
    inner = once(every[~out]) if len(rows) >= 50 and len(set(sign[~out])) == 2 and len(set(sign[out])) == 2 else None
    last = once(every)
    a, b = sigmoid_fit(margins(every[out], *inner), sign[out]) if inner else sigmoid_fit(margins(every, *last), sign)
    ratio, w, bias = last
    return Model((w * ratio).astype(np.float32), (ratio * ratio).astype(np.float32), bias, a, b)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Model:
    """Fit on at most `sample` labelled documents. Null ids and labels are left out; of several labels for an id the least counts."""
    y, is_text = fresh(docs.select(id_col, text), "y", "is_text")
    known = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull()).groupBy(id_col).agg(F.min(label).alias(y))
    known = sampled(known, sample, known.count(), id_col)
    # At most `sample` rows go to every executor, and as many rows of features come back.
    picked = docs.select(id_col, F.col(text).alias(is_text)).join(F.broadcast(known), id_col).select(id_col, y, is_text)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = token_memo()
        for b in batches:
            x = [features(t, memo).tobytes() for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1).cast(pa.int32()), pa.array(x, pa.binary())], ["id", "y", "x"])

    kind = docs.schema[id_col].dataType.simpleString()
    found = cut(picked.mapInArrow(extract, f"id {kind}, y int, x binary"), "features")
    # In the order of the sample, as many rows as SAMPLE_BYTES hold; at most `sample` rows are ordered.
    so_far = Window.orderBy(id_hash(F.col("id")), "id", "x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    got = found.withColumn("so_far", F.sum(F.octet_length("x")).over(so_far)).where(F.col("so_far") <= SAMPLE_BYTES).drop("so_far").toArrow().to_pydict()
    order = sorted(range(len(got["id"])), key=lambda i: (zlib.crc32(str(got["id"][i]).encode()), got["id"][i], got["x"][i]))
    rows = [np.frombuffer(got["x"][i], dtype=np.int32) for i in order]
    model = fit(rows, np.array([got["y"][i] for i in order], dtype=np.int64))
    del got, rows
    pa.default_memory_pool().release_unused()  # the driver keeps the model, not the sample
    return model


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with score and predicted, which replace columns of these names.

    Null and empty texts get the score of a text without features; repeated rows are scored alike; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2 arrays of 2**BITS floats

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        memo = token_memo()
        m = sent.value
        for s in batches:
            yield pd.Series(m.score(np.array([m.margin(features(t, memo)) for t in s], dtype=np.float64)))

    return docs.withColumn("score", of(F.col(text))).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def classify_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document; only labels of rows that are not held out are learned.

    Null doc_ids count as the empty text for the fold; repeated rows are scored alike; an empty table gives no rows and
    without labels every score is a half. Extra columns are ignored.
    """
    known = labels.where(id_hash(F.col("doc_id")) % 5 != 0)
    model = train(docs, known)
    out = score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (id_hash(F.col("doc_id")) % 5 == 0).alias("held_out"), "score", "predicted")


def op4(spark: SparkSession, sf: str) -> DataFrame:
    return classify_quality(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
