"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly.

Words are lower-cased runs between spaces; a word is the mean of the vectors of its
character n-grams (three to five, word borders included, and those of five with any
letter in the middle), hashed into ``2**BITS`` rows, so an unseen misspelling shares
vectors with the word it stands for. A linear softmax over averages of words gives
log-odds. Embeddings and softmax are trained jointly, first on the averages of whole
texts, then on their strongest bags of ``WINDOW`` words, chosen anew in each epoch: those
that speak most for a toxic text, and against a clean one. There, half of the words
lose the n-grams that a changed letter would take away, so all parts of a word learn to
tell. A logistic curve over the ``TOP`` strongest bags of rows left out makes the
document's probability; rows whose label these speak against are left out of its fit.

A document is toxic for a few words of many. A softmax over the average of the whole text
alone finds few of these documents without false ones (README), which is why the
second step and the curve are there.

The fit uses about ``per_class`` labelled rows of each class, of whole texts. Once
fitted, each n-gram adds a single number to a word, which is all that is broadcast;
n-grams that no training text has don't count. Null texts, empty ones and those of
spaces have no word and get the score of the weakest evidence. Without labelled rows of both
classes the score is the share of label 1 (or 0). Input columns named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorecraft.llm.chargrams import code_points, grams, groups
from lorecraft.llm.samples import binary_labels, labelled_sample
from lorecraft.session import ship_package

BITS = 20
ORDERS = (3, 4, 5)
WINDOW = 1
TOP = 3
#: Bags of a text that training takes in an epoch, at most.
STRONGEST = 8
DIMENSIONS = 8
#: Kinds of n-grams: those of each order, and those of five with any letter in the middle.
KINDS = len(ORDERS) + 1
#: What averages are multiplied by before the softmax.
GAIN = 10.0

_space: list[np.ndarray] = []


def words_and_grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each n-gram its hashed number, its word and its place; for each word its hash; words begin by text.

    Words are numbered through all texts; n-grams come ordered by kind, then place. A place
    is the letter of the word (1 is the first) with which the n-gram begins, times
    ``KINDS``, plus its kind: an index of ``ORDERS``, or the last for n-grams of five
    whose middle letter may be any.
    """
    if not _space:
        _space.append(np.fromiter((chr(c).isspace() or chr(c) in "\"'.,;:!?()[]{}" for c in range(0x110000)), bool, 0x110000))
    flat, marks = code_points([t.lower() for t in texts])
    gap = _space[0][flat]
    stay = ~(gap & np.r_[False, gap[:-1]])
    symbols = np.where(gap, np.uint32(0), flat)[stay]
    kept = np.cumsum(stay) - 1
    zero = symbols == 0
    before = np.cumsum(zero)
    word = before - 1  # of the letters after a gap; the gap itself counts to the word it opens
    n_words = int(before[-1]) - 1 if len(symbols) > 1 else 0
    offset = np.arange(len(symbols)) - np.maximum.accumulate(np.where(zero, np.arange(len(symbols)), 0))
    numbers, owners, places = [], [], []
    for kind, n in enumerate((*ORDERS, 5)):
        last = len(symbols) - n + 1
        if last <= 0:
            continue
        inner = before[n - 2 : n - 2 + last] - before[:last]  # gaps strictly inside
        ok = np.flatnonzero((inner == 0) & ~(zero[:last] & zero[1 : last + 1]))
        if kind < len(ORDERS):
            found = grams(symbols, n, BITS)
        else:
            a, b, c, d = (np.roll(symbols, -k).astype(np.int64) for k in (0, 1, 3, 4))
            x = ((a << 42) ^ (b << 21) ^ c ^ (d << 33)).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            found = ((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - BITS)).astype(np.int32)
        numbers.append(found[ok]), owners.append(word[ok]), places.append(offset[ok] * KINDS + kind)
    bounds = word[kept[marks]] if len(marks) else np.zeros(1, np.int64)
    begins = np.flatnonzero(zero)[:n_words]
    value = (symbols.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    value ^= value >> np.uint64(29)
    hashes = np.add.reduceat(value * (offset.astype(np.uint64) * np.uint64(2) + np.uint64(1)), begins) if n_words else np.zeros(0, np.uint64)
    empty = np.zeros(0, np.int64)
    return np.concatenate([*numbers, empty]), np.concatenate([*owners, empty]), np.concatenate([*places, empty]), hashes, bounds


def first_of_run(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """False for a word that repeats the one before it in its text: it says nothing new."""
    new = np.ones(len(hashes), bool)
    new[1:] = hashes[1:] != hashes[:-1]
    new[bounds[:-1][bounds[:-1] < len(hashes)]] = True
    return new


def window_means(value: np.ndarray) -> np.ndarray:
    """The mean of every run of ``WINDOW`` words; a text of fewer words is one run."""
    total = np.r_[0.0, np.cumsum(value)]
    return (total[WINDOW:] - total[:-WINDOW]) / WINDOW if len(value) >= WINDOW else total[-1:] / WINDOW


def strongest(mean: np.ndarray, most: int) -> list[int]:
    """Where the windows begin that have the greatest means, none across another."""
    left, out = mean.copy(), []
    for _ in range(min(most, -(-len(mean) // WINDOW))):
        k = int(left.argmax())
        if left[k] == -np.inf:
            break
        out.append(k)
        left[max(0, k - WINDOW + 1) : k + WINDOW] = -np.inf
    return out


def top_windows(value: np.ndarray, bounds: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Of each text the ``TOP`` greatest window means, descending (missing: the least there is, or -1).

    Words that repeat the one before them (not ``new``) are left out.
    """
    out = np.full((len(bounds) - 1, TOP), -1.0)
    for i, (u, v) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
        if v > u:
            mean = window_means(value[u:v][new[u:v]])
            best = mean[strongest(mean, TOP)]
            out[i, : len(best)] = best
            out[i, len(best) :] = min(best[-1], 0.0)
    return out


@dataclass
class ToxicityModel:
    value: np.ndarray  # what each n-gram adds; not a number: no training text has it
    curve: np.ndarray  # weights of the strongest windows, and the constant
    scale: float

    def word_values(self, numbers: np.ndarray, owners: np.ndarray, words: int) -> np.ndarray:
        """The mean over a word's n-grams, as far as training texts have them."""
        value = self.value[numbers]
        known = ~np.isnan(value)
        n = np.bincount(owners[known], minlength=words)[:words]
        return np.bincount(owners[known], weights=value[known], minlength=words)[:words] / np.maximum(n, 1)

    def windows(self, texts: list[str]) -> np.ndarray:
        numbers, owners, _, hashes, bounds = words_and_grams(texts)
        return top_windows(self.word_values(numbers, owners, len(hashes)), bounds, first_of_run(hashes, bounds))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        parts = [curve_of(self.curve, self.windows(group) / self.scale) for group in groups(texts, 500_000)]
        return np.concatenate([np.zeros(0), *parts])


def curve_of(curve: np.ndarray, windows: np.ndarray) -> np.ndarray:
    z = np.clip(windows, -3, 30) @ curve[:-1] + curve[-1]
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Newton steps; all weights but the constant stay at zero or above."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    free = np.ones(len(w), bool)
    for _ in range(4):
        w[~free] = 0
        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
            g = x.T @ (weight * (p - y)) + ridge * w
            h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
            w[free] -= np.clip(np.linalg.solve(h[np.ix_(free, free)], g[free]), -2, 2)
        negative = np.r_[w[:-1] < 0, False]
        if not negative.any():
            break
        free &= ~negative
    return w


def fit(texts: list[str], labels: list[int], prior: float, *, epochs: tuple[int, int] = (12, 20), rate: float = 0.5, decay: float = 1e-4, seed: int = 2) -> ToxicityModel:
    """Embeddings and softmax, trained jointly on a sample; ``prior`` is the share of label 1 in all labelled rows.

    ``epochs``: over the averages of whole texts, then over those of their strongest windows.
    """
    y = np.array(labels, int)
    if len(set(labels)) < 2:
        share = min(max(prior, 1e-6), 1 - 1e-6)
        return ToxicityModel(np.zeros(1 << BITS, np.float32), np.r_[np.zeros(TOP), np.log(share / (1 - share))], 1.0)
    rng = np.random.default_rng(seed)
    # distinct words of the sample with their n-grams, and each text as numbers of words
    known: dict[int, int] = {}
    gram_parts, place_parts, size_parts, text_words = [], [], [], []
    for group in groups(texts, 500_000):
        numbers, owners, places, hashes, bounds = words_and_grams(group)
        values, first, code = np.unique(hashes, return_index=True, return_inverse=True)
        new = np.array([int(v) not in known for v in values], bool) if len(values) else np.zeros(0, bool)
        place = np.array([known.setdefault(int(v), len(known)) for v in values], np.int32)
        order = np.argsort(owners, kind="stable")
        start = np.searchsorted(owners[order], np.arange(len(hashes) + 1))
        chosen = first[new][np.argsort(place[new])]
        times = start[chosen + 1] - start[chosen]
        own = order[np.repeat(start[chosen], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)]
        gram_parts.append(numbers[own].astype(np.int32)), place_parts.append(places[own].astype(np.int32)), size_parts.append(times)
        new_word = first_of_run(hashes, bounds)
        text_words += [place[code[u:v][new_word[u:v]]] for u, v in zip(bounds[:-1], bounds[1:])]
    gram, where, size = np.concatenate(gram_parts), np.concatenate(place_parts), np.concatenate(size_parts)
    start = np.r_[0, np.cumsum(size)]
    at_letter, kind = where // KINDS, (where % KINDS).astype(np.int8)
    length = np.array([*ORDERS, 5], np.int8)[kind]
    del where, gram_parts, place_parts
    letters = np.maximum.reduceat(np.r_[at_letter + length, 0], start[:-1]) - 2  # of each word; its last n-gram ends in its border
    embed = rng.normal(0, 0.01, (1 << BITS, DIMENSIONS)).astype(np.float32)
    soft = rng.normal(0, 0.3, (DIMENSIONS, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    energy_e, energy_s, energy_b = np.full(1 << BITS, 1e-6), np.full(soft.shape, 1e-6), np.full(2, 1e-6)
    held = rng.permutation(len(y)) % 4 == 0 if (y == 1).sum() >= 24 else np.zeros(len(y), bool)
    train = np.flatnonzero(~held & np.array([len(w) > 0 for w in text_words]))

    def step(bags: list[np.ndarray], label: np.ndarray, divisor: np.ndarray, misspell: bool) -> None:
        """One step of the softmax over the averages of ``bags`` of words."""
        nonlocal soft, bias
        flat, home = np.concatenate(bags), np.repeat(np.arange(len(bags)), [len(b) for b in bags])
        words, back = (np.arange(len(flat)), np.arange(len(flat))) if misspell else np.unique(flat, return_inverse=True)
        which = flat if misspell else words
        times = size[which]
        at = np.repeat(start[which], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        owner = np.repeat(np.arange(len(which)), times)
        if misspell:  # half of the words lose the n-grams that a letter changed at random would take away
            letter = np.where(rng.random(len(which)) < 0.5, rng.integers(1, np.maximum(letters[which], 1) + 1), -99)[owner]
            stay = (letter < at_letter[at]) | (letter >= at_letter[at] + length[at]) | ((kind[at] == KINDS - 1) & (letter == at_letter[at] + 2))
            at, owner = at[stay], owner[stay]
        sub = gram[at]
        n = np.maximum(np.bincount(owner, minlength=len(which)), 1)
        vectors = np.stack([np.bincount(owner, weights=embed[sub, d], minlength=len(which)) / n for d in range(DIMENSIONS)], 1)
        means = np.stack([np.bincount(home, weights=vectors[back, d], minlength=len(bags)) for d in range(DIMENSIONS)], 1) / divisor[:, None]
        z = means * GAIN @ soft + bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(label)), label] -= 1
        p *= np.where(label == 1, 0.5 / max((label == 1).sum(), 1), 0.5 / max((label == 0).sum(), 1))[:, None]
        grad_s, grad_b = (means * GAIN).T @ p, p.sum(0)
        per_bag = p @ soft.T * (GAIN / divisor)[:, None]
        per_word = np.stack([np.bincount(back, weights=per_bag[home, d], minlength=len(which)) for d in range(DIMENSIONS)], 1) / n[:, None]
        rows, place = np.unique(sub, return_inverse=True)
        grad = np.stack([np.bincount(place, weights=per_word[owner, d], minlength=len(rows)) for d in range(DIMENSIONS)], 1) + decay * embed[rows]
        energy_e[rows] += (grad * grad).mean(1)
        embed[rows] -= (rate * 0.2 * grad / np.sqrt(energy_e[rows])[:, None]).astype(np.float32)
        np.add(energy_s, grad_s * grad_s, out=energy_s), np.add(energy_b, grad_b * grad_b, out=energy_b)
        soft -= (0.1 * rate * grad_s / np.sqrt(energy_s)).astype(np.float32)
        bias -= (0.1 * rate * grad_b / np.sqrt(energy_b)).astype(np.float32)

    for epoch in range(sum(epochs)):
        whole = epoch < epochs[0]
        if not whole:
            value = embed @ (soft[:, 1] - soft[:, 0])
            value = np.add.reduceat(np.r_[value[gram], 0], start[:-1]) * (size > 0) / np.maximum(size, 1)
        for part in np.array_split(rng.permutation(train), max(1, len(train) // 256)):
            if whole:
                step([text_words[i] for i in part], y[part], np.array([len(text_words[i]) for i in part], float), False)
                continue
            bags, target = [], []
            for i in part:
                words = text_words[i]
                mean = window_means(value[words])
                best = strongest(mean, STRONGEST)
                if y[i]:
                    best = [k for k in best if mean[k] >= 0.25 * mean[best[0]] or k == best[0]]
                bags += [words[k : k + WINDOW] for k in best]
                target += [y[i]] * len(best)
            if bags:
                step(bags, np.array(target), np.full(len(bags), float(WINDOW)), True)
    value = (embed @ (soft[:, 1] - soft[:, 0])) * GAIN
    value[np.bincount(gram, minlength=1 << BITS) == 0] = np.nan
    model = ToxicityModel(value.astype(np.float32), np.zeros(TOP + 1), 1.0)
    judge = np.flatnonzero(held) if held.any() else np.arange(len(y))
    windows = np.concatenate([model.windows(group) for group in groups([texts[i] for i in judge], 500_000)])
    truth = y[judge]
    model.scale = float(max(np.std(windows[:, 0]), 1e-6))
    weight = np.where(truth == 1, prior / max((truth == 1).mean(), 1e-9), (1 - prior) / max((truth == 0).mean(), 1e-9))
    evidence, right = np.clip(windows / model.scale, -3, 30), np.ones(len(truth), bool)
    for _ in range(3):
        model.curve = _logistic(evidence[right], truth[right], weight[right])
        p = curve_of(model.curve, evidence)
        right = np.where(truth == 1, p, 1 - p) >= 0.05
        if len(set(truth[right])) < 2:
            break
    return model


def train(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic", per_class: int = 2500) -> ToxicityModel:
    """A model from rows of ``docs`` that have a 0/1 label in ``labels``."""
    ship_package(docs.sparkSession)
    texts, marks, rows = labelled_sample(docs.select(key, text), binary_labels(docs, labels, key, label), key=key, text=text, label=label, per_class=per_class)
    return fit(texts, marks, rows.get(1, 0) / max(sum(rows.values()), 1))


def score(df: DataFrame, model: ToxicityModel, *, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """``df`` with ``score`` and ``predicted`` (1 if score >= threshold); the model is broadcast."""
    ship_package(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(shared.value.scores(batch.to_pylist()), pa.float64())

    rest = [c for c in df.columns if c not in {"score", "predicted"}]
    return df.select(*rest, scored(F.col(text).cast("string")).alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
