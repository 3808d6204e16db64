"""Quality scores by Bradley-Terry ranking of preference pairs.

A document's strength is linear in features of its text; a pair of a good and a bad document is won
by the good one with probability sigmoid(strength difference). Weights minimise that logistic loss
over pairs, with a ridge, by Newton steps. The cut is a quantile of the strengths of the fitting
rows, by default the share of bad ones; scores are squeezed so that the cut lies at `cut_score`.

Fitting rows are a bounded sample of labelled rows (`fit_rows`, chosen by a hash of the id), which
is all that reaches the driver. Scoring reads every whole text once, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .common import batch_of, text_bytes

#: Labelled rows to fit on at most, pairs made of them, and rows left out of the fit: crc32(id) mod 5 = 0.
FIT_ROWS, FIT_PAIRS, FOLDS = 8_000, 60_000, 5
_BYTES = np.zeros((256, 8))
for _i, _set in enumerate([b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:'\"?-", b"!", b"<>{}[]|\\/=_", b"#$%&*@^~+"]):
    _BYTES[list(_set), _i] = 1
_BYTES[128:, 7] = 1
N_FEATURES = 18


def features(content: bytes) -> list[float]:
    """Numbers of a whole text: shares of kinds of bytes, words and their repetition, lines."""
    n = len(content)
    words = content.split()
    m, lines = len(words), content.split(b"\n")
    if not m:
        return [0.0] * (N_FEATURES - 1) + [1.0]
    kinds = np.bincount(np.frombuffer(content, np.uint8), minlength=256) @ _BYTES / n
    distinct = len(set(words))
    filled = [x for x in lines if x]
    repeated = 1 - len(set(filled)) / len(filled)
    pairs = len(set(zip(words, words[1:], strict=False))) / max(1, m - 1)
    length = (n - content.count(b" ")) / m
    letters = float(kinds[0] + kinds[1] + kinds[7])
    return [*kinds.tolist(), letters, length, max(0.0, min(40.0, max(map(len, words)))) / 10, distinct / m, distinct / m**0.85, pairs, repeated, np.log1p(m), len(filled) / m, 0.0]


@dataclass(frozen=True)
class Ranking:
    """Strength = weights . (z, z^2, 1-free), z = clipped standardised features; cut and scale of scores."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    cut: float
    scale: float
    cut_score: float

    def _inputs(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -4, 4)
        return np.concatenate([z, z * z], 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        s = (self._inputs(x) @ self.weights - self.cut) / self.scale + np.log(self.cut_score / (1 - self.cut_score))
        return 1 / (1 + np.exp(-np.clip(s, -30, 30)))


def fit(x: np.ndarray, good: np.ndarray, cut_score: float = 0.3, quantile: float | None = None, pairs: int = FIT_PAIRS, ridge: float = 1e-3, steps: int = 20, seed: int = 5) -> Ranking:
    """Learn strengths from rows of features and their labels; with one label only, all score alike."""
    flat = Ranking(np.zeros(x.shape[1]), np.ones(x.shape[1]), np.zeros(2 * x.shape[1]), 0.0, 1.0, cut_score)
    if not good.any() or good.all():
        return flat
    # the spread is that of good texts where they vary, so that odd texts lie far out
    mean, spread = x[good].mean(0), x[good].std(0) + 0.1 * x.std(0) + 1e-9
    shaped = Ranking(mean, spread, flat.weights, 0.0, 1.0, cut_score)
    z = shaped._inputs(x)
    rng = np.random.default_rng(seed)
    d = z[rng.choice(np.flatnonzero(good), pairs)] - z[rng.choice(np.flatnonzero(~good), pairs)]
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))  # the chance that the wrong one wins
        gradient = -(d.T @ p) / pairs + ridge * w
        hessian = (d.T * (p * (1 - p))) @ d / pairs + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    strength = z @ w
    cut = float(np.quantile(strength, (~good).mean() if quantile is None else quantile))
    return Ranking(mean, spread, w, cut, float(strength.std()) / 3 + 1e-9, cut_score)


_X = pa.schema([("good", pa.bool_()), ("x", pa.list_(pa.float64()))])


def fit_on(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, cut_score: float = 0.3) -> Ranking:
    """Fit on at most `fit_rows` labelled documents whose crc32(id) mod 5 is not 0.

    A document labelled more than once counts by its best label; null labels don't count.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("__id"), F.col("quality").cast("int").alias("__q")).filter("__id is not null and __q is not null").filter(F.crc32(F.col("__id").cast("string")) % FOLDS != 0)
    known = known.groupBy("__id").agg(F.max("__q").alias("__q"))
    n = known.count()
    if n > fit_rows:  # an even share by hash, then the bound itself
        known = known.filter(F.pmod(F.xxhash64("__id", F.lit(11)), F.lit(1 << 30)) < int((1 << 30) * 0.95 * fit_rows / n)).limit(fit_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield batch_of(_X, {"good": [q == 1 for q in b.column(0).to_pylist()], "x": [features(c) for c in b.column(1).to_pylist()]})

    # `known` has at most fit_rows rows of two numbers: small enough to send to every executor
    rows = docs.join(F.broadcast(known), F.col("doc_id").cast("long") == F.col("__id")).select("__q", text_bytes("text").alias("content"))
    got = rows.mapInArrow(run, "good boolean, x array<double>").limit(2 * fit_rows).collect()
    if not got:
        return fit(np.zeros((0, N_FEATURES)), np.zeros(0, bool), cut_score)
    # rows in an order of their own, whatever order they came in
    got.sort(key=lambda r: (r["good"], r["x"]))
    return fit(np.array([r["x"] for r in got]), np.array([r["good"] for r in got]), cut_score)


_SCORES = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def score_documents(docs: DataFrame, ranking: Ranking, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row; a null text scores as an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield batch_of(_SCORES, {"doc_id": b.column(0), "score": ranking.score(np.array([features(c) for c in b.column(1).to_pylist()]))})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("content")).mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, cut_score: float = 0.3, fit_rows: int = FIT_ROWS) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    Repeated rows are scored each; a null id is not held out; an empty table gives an empty one; without
    labels of both kinds every score is `cut_score`. Other columns are not read.
    """
    scored = score_documents(docs, fit_on(docs, labels, fit_rows, cut_score))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= cut_score).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, cut_score: float = 0.3, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The rows of `docs`, all columns, that the classifier accepts; the text alone goes to Python.

    Repeated rows are judged each, a null text as an empty one; without labels of both kinds all stay. Empty in, empty out.
    """
    ranking = fit_on(docs, labels, fit_rows, cut_score)

    @F.pandas_udf(DoubleType())
    def score(content: pd.Series) -> pd.Series:
        return pd.Series(ranking.score(np.array([features(c) for c in content])) if len(content) else [], dtype=float)

    return docs.filter(score(text_bytes("text")) >= cut_score)
