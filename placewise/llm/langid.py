"""Language of a text: sparse multinomial logistic regression on TF-IDF of character n-grams.

Document frequencies are counted over every training document.  The regression
is fitted on a bounded sample, ``SAMPLE`` documents by the order of a hash, with
follow-the-regularised-leader steps under elastic-net penalties, so most
weights are exactly 0; a part of the sample it does not see sets the
temperature of the scores.  Prediction reads whole texts in one pass.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placewise.llm.common import least_hashes, ship

BITS = 15
GRAMS = 3
#: Documents the regression is fitted on; a fifth of them only set the temperature.
SAMPLE = 6000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.5
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
_FEATURES = 1 << BITS


# -- features -----------------------------------------------------------------------


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of the 1- to 3-character sequences of a whole text, and their counts."""
    signs = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype="<u4")
    total = np.zeros(_FEATURES, dtype=np.int64)
    mixed = np.zeros(len(signs), dtype=np.uint32)
    for n in range(1, GRAMS + 1):
        mixed = (mixed[: len(signs) - n + 1] + signs[n - 1 :]) * np.uint32(0x9E3779B1)
        spread = mixed ^ (mixed >> np.uint32(15))
        total += np.bincount((spread * np.uint32(0x85EBCA77)) >> np.uint32(32 - BITS), minlength=_FEATURES)
    used = np.flatnonzero(total)
    return used, total[used]


def _weighted(used: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    values = (1 + np.log(counts)) * idf[used]
    return values / np.sqrt((values**2).sum())


# -- the model ----------------------------------------------------------------------


@dataclass
class Model:
    classes: list[str]
    idf: np.ndarray
    weights: np.ndarray  # features and one bias row, by class
    temperature: float

    def logits(self, text: str) -> np.ndarray:
        used, counts = gram_counts(text)
        return _weighted(used, counts, self.idf) @ self.weights[used] + self.weights[-1]

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and its probability; ``und`` and 0 without a letter or without a model."""
        if not text or not self.classes or not _LETTER.search(text):
            return UNKNOWN, 0.0
        p = _softmax(self.logits(text) / self.temperature)
        best = int(p.argmax())
        return self.classes[best], float(p[best])


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _leader(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Weights that the sums ``z`` and ``n`` of the steps so far lead to."""
    shrunk = np.sign(z) * np.maximum(np.abs(z) - L1, 0)
    return -shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2)


def fit(texts: list[str], labels: list[str], idf: np.ndarray) -> Model:
    classes = sorted(set(labels))
    rows = [(used, _weighted(used, counts, idf), classes.index(label)) for (used, counts), label in zip(map(gram_counts, texts), labels, strict=True)]
    apart = rows[::5] if len(rows) >= 50 else rows
    seen = [r for i, r in enumerate(rows) if i % 5] if len(rows) >= 50 else rows
    shape = (_FEATURES + 1, len(classes))
    z, n = np.zeros(shape), np.zeros(shape)
    order = np.random.default_rng(1)
    for _ in range(EPOCHS):
        for i in order.permutation(len(seen)):
            used, values, label = seen[i]
            at, x = np.append(used, _FEATURES), np.append(values, 1.0)
            w = _leader(z[at], n[at])
            error = _softmax(x @ w)
            error[label] -= 1
            g = x[:, None] * error
            grown = n[at] + g * g
            z[at] += g - (np.sqrt(grown) - np.sqrt(n[at])) / ALPHA * w
            n[at] = grown
    weights = _leader(z, n)
    logits = np.array([v @ weights[u] + weights[-1] for u, v, _ in apart])
    truth = np.array([y for _, _, y in apart])
    grid = np.exp(np.linspace(-4, 2, 121))
    loss = [-np.log(_softmax(logits / t)[np.arange(len(truth)), truth] + 1e-300).mean() for t in grid]
    return Model(classes, idf, weights, float(grid[int(np.argmin(loss))]))


# -- tables -------------------------------------------------------------------------


def _frequencies(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, docs = np.zeros(_FEATURES, dtype=np.int64), 0
    for batch in batches:
        for text in batch.column(0):
            total[gram_counts(text.as_py())[0]] += 1
            docs += 1
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.append(used, -1)), pa.array(np.append(total[used], docs))], names=["feature", "n"]
    )


def _fit_sample(idf: np.ndarray):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, labels = [], []
        for batch in batches:
            texts += batch.column(0).to_pylist()
            labels += batch.column(1).to_pylist()
        if not texts:
            return
        model = fit(texts, labels, idf)
        used = np.flatnonzero(model.weights.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(used), pa.array([r.tolist() for r in model.weights[used]], pa.list_(pa.float64())),
             pa.array([model.classes] * len(used), pa.list_(pa.string())), pa.array([model.temperature] * len(used))],
            names=["feature", "weights", "classes", "temperature"],
        )

    return run


def train(docs: DataFrame, learn: Column, sample: int = SAMPLE) -> Model:
    """Fits on text and lang of the rows for which ``learn`` holds and that have both."""
    rows = ship(docs).where(learn & F.col("text").isNotNull() & F.col("lang").isNotNull())
    # At most one row per hash bucket.
    counted = rows.select("text").mapInArrow(_frequencies, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    frequency, n_docs = np.zeros(_FEATURES), 0
    for row in counted:
        if row["feature"] < 0:
            n_docs = row["n"]
        else:
            frequency[row["feature"]] = row["n"]
    idf = np.log((1 + n_docs) / (1 + frequency)) + 1
    some = least_hashes(rows.select("doc_id", "text", "lang"), F.xxhash64("doc_id", "text"), n_docs, sample)
    fitted = (
        some.select("text", "lang")
        .coalesce(1)
        .mapInArrow(_fit_sample(idf), "feature long, weights array<double>, classes array<string>, temperature double")
        .collect()  # at most one row per hash bucket
    )
    if not fitted:
        return Model([], idf, np.zeros((_FEATURES + 1, 0)), 1.0)
    weights = np.zeros((_FEATURES + 1, len(fitted[0]["classes"])))
    for row in fitted:
        weights[row["feature"]] = row["weights"]
    return Model(list(fitted[0]["classes"]), idf, weights, fitted[0]["temperature"])


def predict(rows: DataFrame, model: Model) -> DataFrame:
    """The columns of ``rows`` but its text, with ``lang_pred`` and ``score``."""
    others = [c for c in rows.columns if c != "text"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in others], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                names=[*others, "lang_pred", "score"],
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    return ship(rows).mapInArrow(run, f"{schema}, lang_pred string, score double")
