"""Toxicity: cumulative-link ordinal regression on sparse word features."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .util import Memo, append_columns, documents, sample_rows, table

WORD = re.compile(r"[^\W\d_]+")
BUCKETS = 1 << 20
#: Lengths of the beginnings of words that are features too.
STEMS = (4, 5)


def bucket(word: str) -> int:
    return zlib.crc32(word.encode()) % BUCKETS


def buckets(word: str) -> list[int]:
    """Features of a word: itself, and its beginnings, which stand for a stem whatever its ending."""
    return [bucket(word), *(bucket(f"^{word[:n]}") for n in STEMS if len(word) > n)]


class Severity:
    """P(grade > k) = sigmoid(w.x - threshold_k): one weight vector, ordered thresholds."""

    def __init__(self, weights: dict[int, float], thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def above(self, eta: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(eta[:, None] - self.thresholds, -40, 40)))


def features(df: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """``keep`` with two arrays: hashed words and stems of the whole text and their counts."""

    def factory():
        memo = Memo(buckets)

        def run(texts: list) -> list:
            counts = [Counter(b for w in WORD.findall((t or "").lower()) for b in memo[w]) for t in texts]
            return [[list(c) for c in counts], [list(c.values()) for c in counts]]

        return run

    fields = [T.StructField("bucket", T.ArrayType(T.IntegerType())), T.StructField("n", T.ArrayType(T.IntegerType()))]
    return append_columns(df, text_col, factory, fields, keep)


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_rows: int = 6_000,
    grades: int = 3,
    min_docs: int = 3,
    penalty: float = 5e-3,
    steps: int = 250,
) -> Severity:
    """Fit on about ``max_rows`` labelled documents (all, if there are fewer).

    The labels only tell toxic from clean.  The grades of toxic documents are made
    from the training rows: words at least eight times as common in toxic documents
    or stems are markers, and the toxic documents' marker counts are cut into ``grades``
    parts.  Rows without a label are left out; an id with both labels is toxic; a
    document that is repeated counts once, by the text that sorts first.  Without
    any toxic row all weights are 0 and the severity is that of the clean class.
    """
    labels = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y is not null")
    labels = labels.groupBy("id").agg(F.max(F.when(F.col("y") > 0, 1).otherwise(0)).alias("y"))
    labels = sample_rows(labels, "id", max_rows)  # bounded, so it may be broadcast
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(labels), "id")
    rows = rows.groupBy("id").agg(F.max("y").alias("y"), F.min("text").alias("text"))
    got = features(rows, "text", ["y"]).toPandas()
    y = (got.y.to_numpy() > 0).astype(int)
    if not len(got) or y.min() == y.max():
        return Severity({}, np.full(grades, 40.0))
    size = np.array([len(x) for x in got.bucket])
    cols, vals, row = np.concatenate(got.bucket.to_list()).astype(int), np.concatenate(got.n.to_list()).astype(float), np.repeat(np.arange(len(y)), size)
    inside = np.bincount(cols, minlength=BUCKETS)
    toxic = np.bincount(cols, weights=y[row], minlength=BUCKETS)
    rate, clean = (toxic + 0.5) / (y.sum() + 1), (inside - toxic + 0.5) / (len(y) - y.sum() + 1)
    marker = (rate > 8 * clean) & (toxic >= min_docs)
    marks = np.bincount(row, weights=vals * marker[cols], minlength=len(y))
    cuts = np.quantile(marks[y == 1], np.arange(1, grades) / grades)
    grade = y * (1 + (marks[:, None] > cuts).sum(1))
    # Features: log counts, scaled by how rare a word is; rare ones go.
    used = np.flatnonzero(inside >= min_docs)
    at = np.full(BUCKETS, -1)
    at[used] = np.arange(len(used))
    idf = np.log(len(y) / inside[used]) / np.log(len(y) + 1)
    ok = at[cols] >= 0
    row, col, x = row[ok], at[cols[ok]], np.log1p(vals[ok]) * idf[at[cols[ok]]]
    over = np.array([(grade > k).sum() for k in range(grades)])
    w, b = np.zeros(len(used)), np.log((len(y) - over) / np.maximum(1, over))
    b = np.maximum.accumulate(b + 1e-3 * np.arange(grades))
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)  # both classes count alike
    targets = grade[:, None] > np.arange(grades)
    # Proximal steps with momentum (an L1 penalty keeps few words); step sizes by feature.
    scale = 1 / np.maximum(np.bincount(col, weights=x * x * weight[row], minlength=len(used)) * grades * 2, 1e-3)
    v, prev = w.copy(), w.copy()
    for k in range(steps):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, weights=x * v[col], minlength=len(y))[:, None] - b, -40, 40)))
        r = (p - targets) * weight[:, None]
        rate_k = 0.3 / (1 + k / 100)
        grad = np.bincount(col, weights=x * r.sum(1)[row], minlength=len(used))
        w = v - rate_k * scale * grad
        w = np.sign(w) * np.maximum(np.abs(w) - rate_k * scale * penalty, 0)
        b = np.maximum.accumulate(b + 4 * rate_k * r.sum(0))
        v, prev = w + 0.5 * (w - prev), w
    return Severity({int(used[j]): float(w[j] * idf[j]) for j in np.flatnonzero(w)}, b)


def score(df: DataFrame, model: Severity, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``df`` with severity (the expected grade), p_toxic = P(grade > 0), grade (most likely) and toxic (p_toxic >= 1/2).

    A null text counts as empty.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def factory():
        m = shared.value
        memo = Memo(lambda w: [b for b in buckets(w) if b in m.weights])

        def run(texts: list) -> list:
            eta = np.zeros(len(texts))
            for i, t in enumerate(texts):
                if t:
                    n = Counter(b for w in WORD.findall(t.lower()) for b in memo[w])
                    eta[i] = sum(m.weights[b] * np.log1p(k) for b, k in n.items())
            p = m.above(eta)
            edges = np.hstack([np.ones((len(texts), 1)), p, np.zeros((len(texts), 1))])
            return [p.sum(1).tolist(), p[:, 0].tolist(), (edges[:, :-1] - edges[:, 1:]).argmax(1).tolist(), (p[:, 0] >= 0.5).tolist()]

        return run

    fields = [T.StructField("severity", T.DoubleType()), T.StructField("p_toxic", T.DoubleType()), T.StructField("grade", T.IntegerType()), T.StructField("toxic", T.BooleanType())]
    return append_columns(df, text_col, factory, fields, keep)


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score(docs, train(docs, table(spark, sf_dir, "labels")), keep=["doc_id"])
