"""Toxicity by cumulative-link ordinal regression.

A text becomes a sparse set of hashed features: its distinct words and their
beginnings. Only features that toxic training texts hold much more often than
others get a weight. Severity grades are ordered;
one weight vector is shared by all thresholds: P(grade <= k) = s(t_k - w x), with
s the logistic function and t_1 < t_2 < ... The output is the expected grade.

The labels say only toxic or not. A toxic text's grade above 0 follows how many
distinct telling features it holds, in thirds: 1 mild, 2 strong, 3 severe; ties are in the
milder one, so a text without any is mild. Which ones
are telling is learnt for this from the other half of the training rows, so a text's
own label has no part in its grade.

The model is fitted on at most TRAIN_ROWS labelled rows of each class, chosen by
a hash of doc_id; scoring covers every whole text in one pass without a shuffle.

Defined cases: a null or empty text has no features and grade 0 is then the most
likely; of the rows of one doc_id the least text is trained on; without labels of both
classes, or without any, no feature gets a weight and every text has the grade that the
labels show (0 if none is toxic, else 1); an empty table gives an empty result; repeated rows give
equal rows; other columns are left out.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import documents, small_batches

TRAIN_ROWS = 3000  # labelled rows of each class that the model is fitted on, at most
BITS = 18
GRADES = 4
PREFIXES = (3, 4, 5, 6, 7, 8)
WORD = re.compile(r"[^\W\d_]+")
EPOCHS = 20
LEAST_DOCS, LEAST_LIFT = 3, 3.0  # toxic training texts that hold a feature, and how much larger a share than of the others
TOXIC_FROM = 0.5  # expected severity


def features(text: str | None) -> np.ndarray:
    """Hashed features of the distinct words of a text and of their first characters."""
    words = set(WORD.findall((text or "").lower()))
    found = words | {f"{w[:n]}*" for w in words for n in PREFIXES if len(w) > n}
    mask = (1 << BITS) - 1
    return np.unique(np.fromiter((xxhash.xxh32_intdigest(f) & mask for f in found), np.int32, len(found)))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def features_column(texts: pd.Series) -> pd.Series:
    return pd.Series([features(t) for t in texts])


@dataclass
class Ordinal:
    weights: np.ndarray
    cuts: np.ndarray

    def probabilities(self, rows: list[np.ndarray]) -> np.ndarray:
        score = np.array([self.weights[r].sum() for r in rows])
        upto = 1 / (1 + np.exp(-np.clip(self.cuts[None, :] - score[:, None], -60, 60)))
        edges = np.hstack([np.zeros((len(rows), 1)), upto, np.ones((len(rows), 1))])
        return np.diff(edges, axis=1)

    def expected(self, rows: list[np.ndarray]) -> np.ndarray:
        return self.probabilities(rows) @ np.arange(len(self.cuts) + 1)


def telling(rows: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """Which features speak for toxic texts."""
    size = 1 << BITS
    bad, good = (np.bincount(np.concatenate([r for r, t in zip(rows, toxic) if bool(t) == k] or [np.zeros(0, np.int64)]), minlength=size) for k in (True, False))
    n_bad = max(int((toxic > 0).sum()), 1)
    lift = (bad / n_bad) / ((good + 0.5) / (len(rows) - n_bad + 1))
    return (bad >= LEAST_DOCS) & (lift >= LEAST_LIFT)


def graded(rows: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """Grades from toxic or not and from the number of features that the other half of the rows finds telling."""
    amount, half = np.zeros(len(rows)), np.arange(len(rows)) % 2
    for k in (0, 1):
        known = telling([r for r, h in zip(rows, half) if h != k], toxic[half != k])
        for i in np.flatnonzero(half == k):
            amount[i] = known[rows[i]].sum()
    edges = np.quantile(amount[toxic == 1], [1 / 3, 2 / 3])
    return np.where(toxic == 1, 1 + np.searchsorted(edges, amount, side="left"), 0)


def fit(rows: list[np.ndarray], grades: np.ndarray, grades_n: int = GRADES, epochs: int = EPOCHS, rate: float = 0.5, decay: float = 1e-4, seed: int = 7) -> Ordinal:
    """Maximum likelihood with a ridge, by AdaGrad over small batches."""
    size = 1 << BITS
    known = telling(rows, grades)
    rows = [r[known[r]] for r in rows]
    weights, gathered = np.zeros(size), np.full(size, 1e-8)
    share = np.cumsum(np.bincount(grades, minlength=grades_n)[:-1]) / len(grades)
    share = np.clip(share, 0.01, 0.99)
    cuts = np.log(share / (1 - share)) + np.arange(grades_n - 1) * 1e-3
    cut_gathered = np.full(grades_n - 1, 1e-8)
    random = np.random.default_rng(seed)
    for _ in range(epochs):
        order = random.permutation(len(rows))
        for at in range(0, len(order), 64):
            batch = order[at : at + 64]
            own = [rows[i] for i in batch]
            score = np.array([weights[r].sum() for r in own])
            upto = 1 / (1 + np.exp(-np.clip(cuts[None, :] - score[:, None], -60, 60)))
            slope = upto * (1 - upto)
            n = np.arange(len(batch))
            ends, slopes = np.hstack([np.zeros((len(n), 1)), upto, np.ones((len(n), 1))]), np.hstack([np.zeros((len(n), 1)), slope, np.zeros((len(n), 1))])
            y = grades[batch]
            p = np.maximum(ends[n, y + 1] - ends[n, y], 1e-12)
            upper, lower = slopes[n, y + 1] / p, slopes[n, y] / p
            to_score = upper - lower  # of the negative log-likelihood
            g = np.zeros(grades_n + 1)
            np.add.at(g, y + 1, -upper)
            np.add.at(g, y, lower)
            cut_g = g[1:-1] / len(n)
            flat = np.concatenate(own)
            part = np.repeat(to_score, [len(r) for r in own]) / len(n)
            touched, where = np.unique(flat, return_inverse=True)
            w_g = np.bincount(where, part) + decay * weights[touched]
            gathered[touched] += w_g**2
            weights[touched] -= rate * w_g / np.sqrt(gathered[touched])
            cut_gathered += cut_g**2
            cuts = np.sort(cuts - rate * cut_g / np.sqrt(cut_gathered))
    return Ordinal(weights, cuts)


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = TRAIN_ROWS) -> Ordinal:
    """Fits the model; at most `rows` documents of each class come to the driver, as features."""
    small_batches(df.sparkSession)
    chosen = None
    for value in (0, 1):
        own = labels.where(F.col(label_col) == value).select(F.col(id_col).alias("label_id"), F.lit(value).alias("label_value")).distinct()
        own = own.orderBy(F.xxhash64("label_id"), "label_id").limit(rows)
        chosen = own if chosen is None else chosen.unionByName(own)
    texts = df.select(F.col(id_col).alias("label_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("label_text"))
    texts = texts.join(F.broadcast(chosen), "label_id").groupBy("label_id", "label_value").agg(F.min("label_text").alias("label_text"))  # chosen has 2 * rows rows at most
    got = texts.select("label_id", "label_value", features_column("label_text").alias("f")).toPandas().sort_values(["label_id", "label_value"])
    toxic = got["label_value"].to_numpy(np.int64)
    if len(set(toxic.tolist())) < 2:
        share = np.clip([1 - toxic.max(initial=0), *[1] * (GRADES - 2)], 0.01, 0.99)
        return Ordinal(np.zeros(1 << BITS), np.log(share / (1 - share)) + np.arange(GRADES - 1) * 1e-3)
    sparse = [np.asarray(f, np.int64) for f in got["f"]]
    return fit(sparse, graded(sparse, toxic))


def score(df: DataFrame, model: Ordinal, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, expected_severity, grade (the most likely) and toxic of every row."""
    small_batches(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(model)  # 2 MB whatever the corpus

    @F.pandas_udf("struct<expected_severity:double,grade:long>")
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = [features(t) for t in texts]
        p = sent.value.probabilities(rows)
        return pd.DataFrame({"expected_severity": p @ np.arange(p.shape[1]), "grade": p.argmax(axis=1).astype(np.int64)})

    out = df.select(F.col(id_col), run(F.col(text_col).cast("string")).alias("t"))
    return out.select(id_col, "t.expected_severity", "t.grade", (F.col("t.expected_severity") >= TOXIC_FROM).alias("toxic"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


QUERIES = {"op4_toxicity": op4_toxicity}
ORACLE_SQL: dict[str, str] = {}
