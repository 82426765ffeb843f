"""Quality classifier: naive-Bayes support vectors on n-gram indicators.

A text becomes its shape: letters fall to one sign for each case, digits to
one, runs of a sign are cut to two, and a word equal to the one before it gets a
sign of its own. Its n-grams of one to four signs give indicators, several for each
n-gram: whether it occurs, and whether it does so at least once in 400, 60 or 12
signs. Words' own 1- and 2-grams are indicators too. Indicators are scaled by the
log ratio of their counts in the two classes, over all labelled rows, and a hinge-loss
model is fitted by dual coordinate descent on a sample of at most ``per_class`` of them of
each class, of whole texts. A logistic curve over margins of rows that neither weights
nor counts have seen turns margins into probabilities, at the classes' shares of all
labelled rows.

Every text gets a score; null and empty ones that of a text without indicators.
Without labelled rows of both classes every score is the share of label 1 (or 1).
Input columns named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorecraft.llm.chargrams import code_points, grams, groups
from lorecraft.llm.samples import binary_labels, labelled_sample
from lorecraft.session import ship_package

SHAPE_BITS, WORD_BITS = 14, 16
ORDERS = (1, 2, 3, 4)
#: An n-gram is frequent at a level if it occurs once in so many signs.
LEVELS = (400, 60, 12)
SIZE = (1 + len(LEVELS)) << SHAPE_BITS | 0
TOTAL = SIZE + (1 << WORD_BITS)
SPACE, UPPER, LOWER, DIGIT, AGAIN = 1, 2, 3, 4, 5


@lru_cache(1)
def _signs() -> np.ndarray:
    table = np.arange(0x110000, dtype=np.uint32) + 16
    for c in range(0x110000):
        t = chr(c)
        if t.isspace():
            table[c] = SPACE
        elif t.isalpha():
            table[c] = UPPER if t.isupper() else LOWER
        elif t.isdigit():
            table[c] = DIGIT
    return table


def indicators(texts: list[str]) -> Iterator[np.ndarray]:
    """The features of each text, ascending."""
    flat, marks = code_points(texts)
    sign = _signs()[flat]
    gap = sign == SPACE
    # words: a rolling hash of code points from each gap to the next
    begins = np.flatnonzero(~gap & np.r_[True, gap[:-1]])
    value = flat.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    value ^= value >> np.uint64(31)
    length = np.cumsum(~gap)
    words = np.zeros(0, np.uint64)
    if len(begins):
        offset = np.arange(len(flat), dtype=np.uint64) - np.repeat(begins, np.diff(np.r_[begins, len(flat)])).astype(np.uint64) if begins[0] == 0 else None
        if offset is None:
            spread = np.zeros(len(flat), np.int64)
            spread[begins] = np.diff(np.r_[0, begins])
            offset = (np.arange(len(flat)) - np.cumsum(spread)).astype(np.uint64)
        value = np.where(gap, np.uint64(0), value * (offset * np.uint64(2) + np.uint64(1)))
        words = np.add.reduceat(value, begins)
    # the word that equals the one before it within its text
    home = np.searchsorted(marks, begins, side="right")
    again = np.zeros(len(begins), bool)
    if len(begins) > 1:
        again[1:] = (words[1:] == words[:-1]) & (home[1:] == home[:-1])
    shape = sign.copy()
    shape[begins[again]] = AGAIN
    same1 = np.r_[False, shape[1:] == shape[:-1]]
    same2 = np.r_[False, False, shape[2:] == shape[:-2]]
    drop = (same1 & same2) | (gap & np.r_[False, gap[:-1]])
    stay = ~drop
    stay[marks] = True
    place = (np.cumsum(stay) - 1)[marks]
    shape = shape[stay]
    each = [grams(shape, n, SHAPE_BITS) for n in ORDERS]
    hashed = (words * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - WORD_BITS)
    pairs = ((words * np.uint64(3) + np.r_[words[1:], words[:1]]) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - WORD_BITS) if len(words) else words
    bounds = np.searchsorted(begins, marks)
    for i, (a, b) in enumerate(zip(place[:-1], place[1:])):
        if b - a < 2:
            yield np.zeros(0, np.int64)
            continue
        n = np.bincount(np.concatenate([g[a : b + 2 - k] for g, k in zip(each, ORDERS)]), minlength=1 << SHAPE_BITS)
        at = np.flatnonzero(n)
        parts = [at]
        for level, once in enumerate(LEVELS, 1):
            parts.append(at[n[at] * once >= b - a] + (level << SHAPE_BITS))
        u, v = bounds[i], bounds[i + 1]
        both = np.concatenate([hashed[u:v], pairs[u : max(u, v - 1)]]).astype(np.int64)
        parts.append(np.unique(both) + SIZE)
        yield np.concatenate(parts)


@dataclass
class QualityModel:
    weights: np.ndarray  # already times the log-count ratio
    bias: float
    norm: np.ndarray  # squared scale of each feature
    slope: float
    offset: float

    def margin(self, at: np.ndarray) -> float:
        return float(self.weights[at].sum() / max(np.sqrt(self.norm[at].sum()), 1e-9) + self.bias)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        margins = [self.margin(at) for group in groups(texts) for at in indicators(group)]
        return 1 / (1 + np.exp(-np.clip(self.slope * np.array(margins, float) + self.offset, -40, 40)))


def dual_descent(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, cost: np.ndarray, size: int, epochs: int, seed: int) -> tuple[np.ndarray, float]:
    """Weights and bias of the hinge loss: one dual variable at a time, within [0, cost]."""
    rng = np.random.default_rng(seed)
    w, b, alpha = np.zeros(size), 0.0, np.zeros(len(rows))
    square = np.array([(x * x).sum() + 1 for _, x in rows])
    for _ in range(epochs):
        most = 0.0
        for i in rng.permutation(len(rows)):
            at, x = rows[i]
            gradient = y[i] * (w[at] @ x + b) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), cost[i])
            if (step := (new - alpha[i]) * y[i]) != 0:
                w[at] += step * x
                b += step
                alpha[i] = new
                most = max(most, abs(step))
        if most < 1e-3:
            break
    return w, b


def fit(texts: list[str], labels: list[int], seen: np.ndarray, prior: float, *, cost: float = 1.0, smooth: float = 1.0, epochs: int = 20, seed: int = 6) -> QualityModel:
    """Learn from a sample.

    ``seen`` counts the rows of each class (0, 1) with each indicator and ``prior`` is the share of
    label 1, both over all labelled rows, those of the sample among them.
    """
    y = np.array(labels, int)
    if len(set(labels)) < 2:
        share = min(max(prior, 1e-6), 1 - 1e-6)
        return QualityModel(np.zeros(TOTAL), 0.0, np.ones(TOTAL), 1.0, float(np.log(share / (1 - share))))
    found = [at.astype(np.int32) for group in groups(texts) for at in indicators(group)]
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    fold = np.zeros(len(y), int)
    fold[order] = np.arange(len(y)) % 4
    sign = np.where(y == 1, 1.0, -1.0)
    weight = np.where(y == 1, 0.5 / max((y == 1).mean(), 1e-9), 0.5 / max((y == 0).mean(), 1e-9)) * cost

    def ratio_without(rows: np.ndarray) -> np.ndarray:
        """Log ratio of the classes' counts over all rows but these."""
        n = seen + smooth
        for i in rows:
            n[y[i], found[i]] -= 1
        n = np.maximum(n, smooth)
        return np.log(n[1] / n[1].sum()) - np.log(n[0] / n[0].sum())

    def learned(ratio: np.ndarray, used: np.ndarray) -> tuple[np.ndarray, float]:
        scaled = [(found[i], (ratio[found[i]] / max(np.sqrt((ratio[found[i]] ** 2).sum()), 1e-9)).astype(np.float32)) for i in used]
        return dual_descent(scaled, sign[used], weight[used], TOTAL, epochs, seed)

    margins = np.zeros(len(y))
    for k in range(4):
        out = np.flatnonzero(fold == k)
        ratio = ratio_without(out)
        w, b = learned(ratio, np.flatnonzero(fold != k))
        part = QualityModel(w * ratio, b, ratio**2, 1.0, 0.0)
        margins[out] = [part.margin(found[i]) for i in out]
    ratio = ratio_without(np.zeros(0, int))
    w, b = learned(ratio, np.arange(len(y)))
    slope, offset = _logistic(margins, y, np.where(y == 1, prior / (y == 1).mean(), (1 - prior) / (y == 0).mean()))
    return QualityModel(w * ratio, b, ratio**2, slope, offset)


def _logistic(m: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Newton steps for p = 1 / (1 + exp(-(a m + b))), with a little weight towards a = 1, b = 0."""
    a, b = 1.0, 0.0
    x = np.stack([m, np.ones_like(m)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -40, 40)))
        g = x.T @ (weight * (p - y)) + 0.1 * np.array([a - 1, b])
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2)
        step = np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
    return float(max(a, 1e-3)), float(b)


def train(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality", per_class: int = 1500) -> QualityModel:
    """A model from rows of ``docs`` that have a 0/1 label in ``labels``."""
    ship_package(docs.sparkSession)
    texts, marks, rows = labelled_sample(docs.select(key, text), binary_labels(docs, labels, key, label), key=key, text=text, label=label, per_class=per_class)
    seen = np.zeros((2, TOTAL))
    if len(set(marks)) == 2:

        def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n = np.zeros((2, TOTAL), np.int64)
            for batch in batches:
                truth, at = batch.column(1).to_pylist(), 0
                for group in groups(batch.column(0).to_pylist()):
                    for found in indicators(group):
                        n[truth[at], found] += 1
                        at += 1
            some = np.flatnonzero(n.any(0))
            yield pa.record_batch({"feature": some, "n0": n[0, some], "n1": n[1, some]})

        marked = docs.select(key, F.col(text).cast("string").alias("__text")).join(binary_labels(docs, labels, key, label).distinct(), key).select("__text", label)
        table = marked.mapInArrow(counted, "feature bigint, n0 bigint, n1 bigint").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()
        seen[:, table.column("feature").to_numpy()] = np.stack([table.column("n0").to_numpy(), table.column("n1").to_numpy()])
    return fit(texts, marks, seen, rows.get(1, 0) / max(sum(rows.values()), 1) if rows else 1.0)


def score(df: DataFrame, model: QualityModel, *, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """``df`` with ``score`` and ``predicted`` (1 if score >= threshold); the model is broadcast."""
    ship_package(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(shared.value.scores(batch.to_pylist()), pa.float64())

    rest = [c for c in df.columns if c not in {"score", "predicted"}]
    return df.select(*rest, scored(F.col(text).cast("string")).alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
