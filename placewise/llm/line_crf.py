"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad; its features are those of the line and of both its
neighbours, and a transition weight ties it to the line before.  The field is
fitted by gradient on a bounded sample of labelled documents, all of whose
lines carry the document's label.  A document's quality is the mean of its
lines' marginals from the forward-backward pass, weighted by length, mapped to
a probability on sampled documents that the field did not see.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placewise.llm.common import least_hashes, ship

#: Labelled documents the field is fitted on; a fifth of them only map its output.
SAMPLE = 4000
STEPS = 200
PENALTY = 1e-3
#: Documents whose lines go through the passes together.
TOGETHER = 256

# -- features of lines ----------------------------------------------------------------

_CLASSES = 8  # lower, upper, other letters, digits, spaces, symbols, exclamation marks, other signs
_KNOWN = 0x3000


def _sign_classes() -> np.ndarray:
    out = np.full(_KNOWN + 1, 7, dtype=np.int64)
    out[_KNOWN] = 2  # all signs from there on
    for sign in range(_KNOWN):
        kind = unicodedata.category(chr(sign))
        if kind in ("Ll", "Lu"):
            out[sign] = 0 if kind == "Ll" else 1
        elif kind[0] == "L":
            out[sign] = 2
        elif kind[0] == "N":
            out[sign] = 3
        elif chr(sign).isspace():
            out[sign] = 4
    out[[ord(c) for c in "#*$%&|<>"]] = 5
    out[ord("!")] = 6
    return out


_SIGNS = _sign_classes()


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features and characters of all lines of the texts, and lines per text."""
    split = [t.split("\n") for t in texts]
    lines = [line for t in split for line in t]
    n = len(lines)
    per_text = np.array([len(t) for t in split])
    signs = np.frombuffer("\n".join(lines).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    chars = np.array([len(line) for line in lines])
    of_line = np.repeat(np.arange(n), chars + 1)[: len(signs)]
    counts = np.bincount(of_line * _CLASSES + _SIGNS[np.minimum(signs, _KNOWN)], minlength=n * _CLASSES).reshape(n, _CLASSES)
    words = [line.split() for line in lines]
    n_words = np.array([len(w) for w in words])
    distinct = np.array([len(set(w)) for w in words])
    seen_before = np.zeros(n)
    at = 0
    for t in split:
        seen: set[str] = set()
        for line in t:
            if line and line in seen:
                seen_before[at] = 1
            seen.add(line)
            at += 1
    long = np.maximum(chars, 1)
    letters = counts[:, :3].sum(axis=1)
    own = np.column_stack(
        [
            np.log1p(chars) / 6,
            np.log1p(n_words) / 5,
            letters / np.maximum(n_words, 1) / 8,
            letters / long,
            counts[:, 1] / np.maximum(letters, 1),
            counts[:, 3] / long,
            np.minimum(8 * counts[:, 5] / long, 2),
            np.minimum(8 * counts[:, 6] / long, 2),
            counts[:, 7] / long,
            counts[:, 5] > 0,
            counts[:, 6] > 0,
            1 - distinct / np.maximum(n_words, 1),
            seen_before,
            n_words == 0,
            n_words < 5,
            [line.rstrip()[-1:] in (".", "?", "!", "…") for line in lines],
        ]
    ).astype(np.float64)
    first = np.zeros(n, dtype=bool)
    starts = np.cumsum(per_text) - per_text
    first[starts] = True
    last = np.zeros(n, dtype=bool)
    last[starts + per_text - 1] = True
    before = np.where(first[:, None], 0, np.roll(own, 1, axis=0))
    after = np.where(last[:, None], 0, np.roll(own, -1, axis=0))
    # A repeated document of one line says the same as its line.
    shape = np.log1p(np.repeat(per_text, per_text))[:, None] / 4
    return np.hstack([own, before, after, first[:, None], last[:, None], shape, np.ones((n, 1))]), chars, per_text


# -- the field ------------------------------------------------------------------------


def _steps(per_text: np.ndarray) -> list[np.ndarray]:
    """Line numbers by place in the text: the k-th entry has the k-th lines of all texts that long, longest first."""
    order = np.argsort(-per_text, kind="stable")
    starts = (np.cumsum(per_text) - per_text)[order]
    sizes = per_text[order]
    return [starts[: int(np.searchsorted(-sizes, -k))] + k for k in range(int(sizes[0]) if len(sizes) else 0)]


def _sum_exp(x: np.ndarray) -> np.ndarray:
    top = x.max(axis=1)
    return top + np.log(np.exp(x - top[:, None]).sum(axis=1))


def forward_backward(good: np.ndarray, ties: np.ndarray, steps: list[np.ndarray]):
    """Marginals of good, and the expected uses of every transition, from the lines' scores for good."""
    score = np.column_stack([np.zeros(len(good)), good])
    ahead, behind = np.zeros_like(score), np.zeros_like(score)
    for k, now in enumerate(steps):
        if k:
            prior = ahead[steps[k - 1][: len(now)]]
            ahead[now] = np.column_stack([_sum_exp(prior + ties[:, j]) for j in (0, 1)])
        ahead[now] += score[now]
    for k in range(len(steps) - 2, -1, -1):
        later = steps[k + 1]
        follow = score[later] + behind[later]
        behind[steps[k][: len(later)]] = np.column_stack([_sum_exp(follow + ties[i]) for i in (0, 1)])
    both = ahead + behind
    total = _sum_exp(both)
    marginal = np.exp(both[:, 1] - total)
    used = np.zeros((2, 2))
    for k in range(1, len(steps)):
        now = steps[k]
        prior = steps[k - 1][: len(now)]
        for i in (0, 1):
            for j in (0, 1):
                used[i, j] += np.exp(ahead[prior, i] + ties[i, j] + score[now, j] + behind[now, j] - total[now]).sum()
    return marginal, used


@dataclass
class Field:
    weights: np.ndarray
    ties: np.ndarray
    slope: float
    shift: float

    def quality(self, texts: list[str]) -> np.ndarray:
        """Length-weighted mean of the lines' marginals."""
        x, chars, per_text = line_features(texts)
        marginal, _ = forward_backward(x @ self.weights, self.ties, _steps(per_text))
        starts = np.cumsum(per_text) - per_text
        weight = chars + 1.0
        return np.add.reduceat(marginal * weight, starts) / np.add.reduceat(weight, starts)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        out = [self.quality([t or "" for t in texts[i : i + TOGETHER]]) for i in range(0, len(texts), TOGETHER)]
        return self.mapped(np.concatenate(out)) if out else np.zeros(0)

    def mapped(self, quality: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * _logit(quality) + self.shift)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def _climb(gradient, start: np.ndarray, steps: int, rate: float) -> np.ndarray:
    """Adaptive-moment ascent."""
    at, first, second = start.copy(), np.zeros_like(start), np.zeros_like(start)
    for step in range(1, steps + 1):
        g = gradient(at)
        first = 0.9 * first + 0.1 * g
        second = 0.999 * second + 0.001 * g * g
        at += rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return at


def fit(texts: list[str], labels: list[int]) -> Field:
    truth = np.array(labels, dtype=np.float64)
    apart = np.arange(len(texts)) % 5 == 0 if len(texts) >= 50 else np.ones(len(texts), dtype=bool)
    seen = ~apart if len(texts) >= 50 else apart
    x, _, per_text = line_features([t for t, s in zip(texts, seen) if s])
    y = np.repeat(truth[seen], per_text)
    steps = _steps(per_text)
    # Both labels and all texts weigh the same, whatever their number and length.
    share = np.repeat(1 / per_text, per_text)
    for label in (0.0, 1.0):
        share[y == label] /= max(share[y == label].sum(), 1e-9)
    kept = np.zeros((2, 2))
    for k in range(1, len(steps)):
        now = y[steps[k]].astype(int)
        kept[0, 0] += (now == 0).sum()
        kept[1, 1] += (now == 1).sum()
    pairs = max(kept.sum(), 1)

    def gradient(at: np.ndarray) -> np.ndarray:
        weights, ties = at[:-4], at[-4:].reshape(2, 2)
        marginal, used = forward_backward(x @ weights, ties, steps)
        return np.append(x.T @ ((y - marginal) * share), ((kept - used) / pairs).reshape(-1)) - PENALTY * at

    at = _climb(gradient, np.zeros(x.shape[1] + 4), STEPS, 0.1)
    field = Field(at[:-4], at[-4:].reshape(2, 2), 1.0, 0.0)
    rest = [t for t, a in zip(texts, apart) if a]
    quality = _logit(np.concatenate([field.quality(rest[i : i + TOGETHER]) for i in range(0, len(rest), TOGETHER)]))
    goal = truth[apart]

    def mapping(at: np.ndarray) -> np.ndarray:
        error = goal - 1 / (1 + np.exp(-(at[0] * quality + at[1])))
        return np.array([(error * quality).mean(), error.mean()]) - 1e-4 * at

    field.slope, field.shift = _climb(mapping, np.array([0.5, 0.0]), 500, 0.05).tolist()
    return field


# -- tables ---------------------------------------------------------------------------


def _fit_sample(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    texts, labels = [], []
    for batch in batches:
        texts += [t or "" for t in batch.column(0).to_pylist()]
        labels += batch.column(1).to_pylist()
    if texts:
        field = fit(texts, labels)
        every = [*field.weights.tolist(), *field.ties.reshape(-1).tolist(), field.slope, field.shift]
        yield pa.RecordBatch.from_arrays([pa.array([every], pa.list_(pa.float64()))], names=["values"])


def train(docs: DataFrame, labels: DataFrame, learn: Column, sample: int = SAMPLE) -> Field | None:
    """Fits on text and quality of ``sample`` rows, by hash order, for which ``learn`` (of doc_id) holds; None without any."""
    known = labels.where(learn & F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    known = known.groupBy(F.col("doc_id").alias("_id")).agg(F.max("quality").cast("int").alias("quality"))
    some = least_hashes(known, F.xxhash64("_id"), known.count(), sample)
    # At most ``sample`` ids, so the texts need no shuffle; rows that share an id are cut off again after it.
    rows = ship(docs).select("doc_id", "text").join(F.broadcast(some), F.col("doc_id") == F.col("_id"))
    rows = rows.orderBy(F.xxhash64("doc_id", "text")).limit(sample).select("text", "quality")
    found = rows.coalesce(1).mapInArrow(_fit_sample, "values array<double>").collect()  # one row
    if not found:
        return None
    values = np.array(found[0]["values"])
    return Field(values[:-6], values[-6:-2].reshape(2, 2), float(values[-2]), float(values[-1]))


def score(rows: DataFrame, field: Field | None) -> DataFrame:
    """The columns of ``rows`` but its text, with ``score``; 0.5 without a field."""
    others = [c for c in rows.columns if c != "text"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(low, TOGETHER)
                texts = part.column("text").to_pylist()
                found = field.scores(texts) if field else np.full(len(texts), 0.5)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in others], pa.array(found)], names=[*others, "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    return ship(rows).mapInArrow(run, f"{schema}, score double")
