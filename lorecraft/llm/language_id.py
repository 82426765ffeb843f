"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased and reduced to letters with single gaps; n-grams of one to
three characters are hashed into ``2**BITS`` features. Document frequencies cover
all labelled rows. The weights are learned by follow-the-regularised-leader
with elastic-net penalties on a sample of at most ``per_language`` documents of each
language, and a temperature is fitted on the part of the sample left out. Every language
that a labelled row has is learned. Scoring reads every text whole.

A null text, or one without a letter, is ``und`` with score 0. Texts of one or
two letters get whatever is likeliest, with a low score. Without labelled rows
every text is ``und``. Input columns named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorecraft.llm.chargrams import code_points, grams, groups, squeeze
from lorecraft.llm.samples import labelled_sample
from lorecraft.session import ship_package

BITS = 16
ORDERS = (1, 2, 3)
UNKNOWN = "und"


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def counts(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Features of each text and their frequencies; empty for a text without letters."""
    flat, marks = code_points([t.lower() for t in texts])
    symbols = np.where(_letters()[flat], flat, 0)
    gap = symbols == 0
    symbols, marks = squeeze(symbols, marks, gap & np.r_[False, gap[:-1]])
    each = [grams(symbols, n, BITS) for n in ORDERS]
    for a, b in zip(marks[:-1], marks[1:]):
        if not symbols[a:b].any():
            yield np.zeros(0, np.int64), np.zeros(0, np.int64)
            continue
        n = np.bincount(np.concatenate([g[a : b + 2 - order] for g, order in zip(each, ORDERS)]), minlength=1 << BITS)
        at = np.flatnonzero(n)
        yield at, n[at]


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # feature x language
    bias: np.ndarray
    temperature: float

    def features(self, text_counts: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        at, n = text_counts
        x = (1 + np.log(n)) * self.idf[at]
        return at, x / max(np.sqrt((x * x).sum()), 1e-12)

    def logits(self, at: np.ndarray, x: np.ndarray) -> np.ndarray:
        return x @ self.weights[at] + self.bias

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [], []
        for group in groups(texts):
            for found in counts(group):
                if not len(found[0]) or not self.languages:
                    names.append(UNKNOWN), scores.append(0.0)
                    continue
                z = self.logits(*self.features(found)) / self.temperature
                p = np.exp(z - z.max())
                best = int(p.argmax())
                names.append(self.languages[best]), scores.append(float(p[best] / p.sum()))
        return names, scores


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(
    texts: list[str],
    labels: list[str],
    frequencies: np.ndarray,
    rows: int,
    *,
    alpha: float = 1.0,
    beta: float = 1.0,
    l1: float = 0.002,
    l2: float = 0.02,
    epochs: int = 3,
    seed: int = 5,
) -> LanguageModel:
    """Learn from a sample; ``frequencies`` and ``rows`` come from all labelled rows."""
    names = sorted(set(labels))
    model = LanguageModel(names, np.log((1 + rows) / (1 + frequencies)) + 1, np.zeros((1 << BITS, len(names))), np.zeros(len(names)), 1.0)
    rng = np.random.default_rng(seed)
    data = []
    for group, ys in _together(texts, labels):
        for c, y in zip(counts(group), ys):
            if len(c[0]):
                at, x = model.features(c)
                data.append((at.astype(np.int32), x.astype(np.float32), names.index(y)))
    data = [data[i] for i in rng.permutation(len(data))]
    held = data[: len(data) // 6]
    train = data[len(held) :]
    if not train:
        return LanguageModel([], model.idf, model.weights, model.bias, 1.0)
    z, n = np.zeros_like(model.weights), np.zeros_like(model.weights)
    zb, nb = np.zeros(len(names)), np.zeros(len(names))
    for _ in range(epochs):
        for i in rng.permutation(len(train)):
            at, x, y = train[i]
            za, na = z[at], n[at]
            w = np.where(np.abs(za) <= l1, 0.0, (np.sign(za) * l1 - za) / ((beta + np.sqrt(na)) / alpha + l2))
            b = -zb / ((beta + np.sqrt(nb)) / alpha + l2)
            g = _softmax(x @ w + b)
            g[y] -= 1
            step = x[:, None] * g
            sigma = (np.sqrt(na + step * step) - np.sqrt(na)) / alpha
            z[at], n[at] = za + step - sigma * w, na + step * step
            zb += g - (np.sqrt(nb + g * g) - np.sqrt(nb)) / alpha * b
            nb += g * g
    model.weights = np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2))
    model.bias = -zb / ((beta + np.sqrt(nb)) / alpha + l2)
    if held:
        logits, y = np.array([model.logits(at, x) for at, x, _ in held]), np.array([y for _, _, y in held])
        loss = lambda t: -np.log(_softmax(logits / t)[np.arange(len(y)), y] + 1e-12).mean()
        model.temperature = float(min(np.geomspace(0.05, 5, 200), key=loss))
    return model


def _together(texts: list[str], labels: list[str]) -> Iterator[tuple[list[str], list[str]]]:
    at = 0
    for group in groups(texts):
        yield group, labels[at : at + len(group)]
        at += len(group)


def train(labelled: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = 800) -> LanguageModel:
    """A model from the rows of ``labelled`` whose text and language are not null."""
    ship_package(labelled.sparkSession)
    known = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), F.col(lang).alias("lang"))

    def documents_with(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows = np.zeros(1 << BITS, np.int64), 0
        for batch in batches:
            for group in groups(batch.column(0).to_pylist()):
                for at, _ in counts(group):
                    seen[at] += 1
                    rows += 1
        at = np.flatnonzero(seen)
        yield pa.record_batch({"feature": np.r_[at, -1], "n": np.r_[seen[at], rows]})

    table = known.select("text").mapInArrow(documents_with, "feature bigint, n bigint").groupBy("feature").agg(F.sum("n").alias("n")).toPandas()
    frequencies = np.zeros(1 << BITS)
    inside = table[table.feature >= 0]
    frequencies[inside.feature.to_numpy()] = inside.n.to_numpy()
    rows = int(table[table.feature < 0].n.sum())
    texts, names, _ = labelled_sample(known, known.select("key", "lang"), key="key", text="text", label="lang", per_class=per_language)
    return fit(texts, names, frequencies, rows)


def identify(df: DataFrame, model: LanguageModel, *, text: str = "text") -> DataFrame:
    """``df`` with ``lang_pred`` and ``score``; the model (of fixed size) is broadcast."""
    ship_package(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def predicted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            names, scores = shared.value.predict(batch.to_pylist())
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["lang_pred", "score"])

    rest = [c for c in df.columns if c not in {"lang_pred", "score"}]
    return df.select(*rest, predicted(F.col(text).cast("string")).alias("__p")).select(*rest, "__p.lang_pred", "__p.score")


def split_of(key: Column | str, parts: int) -> Column:
    """crc32 of ``key`` as text, modulo ``parts``; null keys count as empty."""
    column = F.col(key) if isinstance(key, str) else key
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % parts
