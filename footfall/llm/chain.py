"""Toxicity by a classifier chain: sparse linear models, each fed what the earlier ones say of the same text."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm import words
from footfall.llm.tables import by_text, least_hashed, row_hash, told

_BITS = 18
_STEMS = (4, 5, 6)
_FOLD = bytes(x + 32 if 65 <= x <= 90 else x if 97 <= x <= 122 or x >= 128 else 32 for x in range(256))


def features(text: str | None) -> np.ndarray:
    """The distinct features of the whole text: each word and its first 4, 5 and 6 bytes, hashed to 18 bits."""
    found = [np.zeros(0, np.uint64)]
    for data in words.pieces((text or "").encode().translate(_FOLD)):
        found.append(words.hashes(data))
        found += [words.prefixes(data, n) for n in _STEMS]
    return np.unique((np.concatenate(found) >> np.uint64(64 - _BITS)).astype(np.uint32))


def telling(rows: list[np.ndarray], labels: np.ndarray, apart: float = 3.0, least: int = 3) -> np.ndarray:
    """Which features lie more than ``apart`` standard errors off their usual share of label 1."""
    n, part = len(rows), labels.mean() if len(rows) else 0.0
    empty = np.zeros(0, np.uint32)
    among = np.bincount(np.concatenate([empty, *rows]), minlength=1 << _BITS)
    hits = np.bincount(np.concatenate([empty, *(x for x, y in zip(rows, labels) if y)]), minlength=1 << _BITS)
    error = np.sqrt(among * part * (1 - part) * (1 - among / max(n, 1)))
    return (among >= least) & (np.abs(hits - among * part) > apart * error)


class Linear:
    """Logistic regression by FTRL-proximal: a rate for each weight, and exact zeros for what tells nothing.

    Only features that tell something on their own (``telling``) take part, else every text's rare words would be
    learned by heart.

    The inputs are the features of a text, all 1, and the earlier categories' probabilities, which have weights of
    their own behind those of the features; the last weight is the constant.
    """

    def __init__(self, earlier: int, rate: float = 0.5, sparse: float = 2.0, decay: float = 0.05):
        self._z, self._n = np.zeros((1 << _BITS) + earlier + 1), np.zeros((1 << _BITS) + earlier + 1)
        self._earlier, self._rate, self._sparse, self._decay = earlier, rate, sparse, decay
        self.shift = 0.0

    def _weights(self, at) -> np.ndarray:
        z = self._z[at]
        full = -(z - np.sign(z) * self._sparse) / ((1 + np.sqrt(self._n[at])) / self._rate + self._decay)
        return np.where(np.abs(z) <= self._sparse, 0, full)

    def fit(self, rows: list[np.ndarray], earlier: np.ndarray, labels: np.ndarray, rounds: int, seed: int) -> Linear:
        keep = telling(rows, labels)
        rows = [x[keep[x]] for x in rows]
        draw, last = np.random.default_rng(seed), np.arange(self._earlier + 1) + (1 << _BITS)
        for _ in range(rounds):
            for i in draw.permutation(len(rows)):
                at = np.concatenate([rows[i], last])
                value = np.ones(len(at))
                value[len(rows[i]) : -1] = earlier[i]
                w = self._weights(at)
                slope = (1 / (1 + np.exp(-np.clip(w @ value, -30, 30))) - labels[i]) * value
                square = slope * slope
                self._z[at] += slope - (np.sqrt(self._n[at] + square) - np.sqrt(self._n[at])) / self._rate * w
                self._n[at] += square
        self.weights = self._weights(slice(None)).astype(np.float32)
        del self._z, self._n
        return self

    def chance(self, rows: list[np.ndarray], earlier: np.ndarray) -> np.ndarray:
        value = np.array([float(self.weights[x].sum()) for x in rows]) + self.weights[-1] + self.shift
        value += earlier @ self.weights[1 << _BITS : -1]
        return 1 / (1 + np.exp(-np.clip(value, -30, 30)))


@dataclass
class Chain:
    categories: list[str]
    models: list[Linear]
    threshold: float

    def chances(self, rows: list[np.ndarray]) -> np.ndarray:
        """A column of probabilities for each category, in the order of the chain."""
        found = np.zeros((len(rows), 0))
        for model in self.models:
            found = np.column_stack([found, model.chance(rows, found)])
        return found


def _best_threshold(score: np.ndarray, label: np.ndarray, share: np.ndarray) -> float:
    """The score from which calling it toxic gives the highest F1; ``share`` weighs the sample as the corpus is."""
    order = np.argsort(-score, kind="stable")
    hits, called = np.cumsum((label * share)[order]), np.cumsum(share[order])
    f1 = 2 * hits / (called + (label * share).sum())
    last = np.append(np.diff(score[order]) != 0, True)
    best = int(np.where(last, f1, -1).argmax())
    below = score[order][best + 1] if best + 1 < len(score) else 0.0
    return float((score[order][best] + below) / 2)


def train(docs: DataFrame, labels: DataFrame, categories: list[str], id_col: str = "doc_id", text_col: str = "text", sample: int = 8000, sample_bytes: int = 65536, folds: int = 3, rounds: int = 4, seed: int = 20240229) -> Chain:
    """A chain over the 0/1 columns ``categories`` of ``labels``; the last one is what is to be told in the end.

    Learned from at most ``sample`` labelled documents of up to ``sample_bytes`` bytes, half of them with the last
    category as far as there are any, those least by a hash of id and text, one of equal rows. Their features are made where they lie. Each
    later model learns from out-of-fold probabilities of the earlier ones, so it sees them as wrong as they are on new
    texts; probabilities are shifted to how often the last category is among all labelled documents. A category
    that is null or unknown for a document counts as 0. Without any label every probability is one half.
    """
    target = categories[-1]
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL")
    texts = texts.where(F.octet_length("text").between(1, sample_bytes)).withColumn("row", row_hash("id", "text"))
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(*(F.coalesce(F.max(c), F.lit(0)).cast("int").alias(c) for c in categories))
    marks = marks.join(texts.select("id", "row").distinct(), "id").drop("id").withColumnRenamed("row", "id")
    counts = {r[target]: r["n"] for r in marks.groupBy(target).agg(F.count("*").alias("n")).collect()}
    chosen = least_hashed(marks, target, sample // 2)

    texts = texts.select("text", F.col("row").alias("id")).join(F.broadcast(chosen), "id").dropDuplicates(["id"])
    found = by_text(texts, "x binary", lambda: lambda text: (features(text).tobytes(),)).toPandas()
    found = found.sort_values("id", kind="stable").reset_index(drop=True)
    rows = [np.frombuffer(x, np.uint32) for x in found["x"]]
    known, fold = np.zeros((len(rows), 0)), np.arange(len(rows)) % folds
    models, y = [], found[target].to_numpy()
    for category in categories:
        label, width = found[category].to_numpy(), known.shape[1]
        apart = np.zeros(len(rows))
        for k in range(folds):
            own, rest = np.flatnonzero(fold == k), np.flatnonzero(fold != k)
            if len(own):
                apart[own] = Linear(width).fit([rows[i] for i in rest], known[rest], label[rest], rounds, seed).chance([rows[i] for i in own], known[own])
        models.append(Linear(width).fit(rows, known, label, rounds, seed))
        known = np.column_stack([known, apart])
    threshold = 0.5
    if 0 < y.sum() < len(y):
        share = np.where(y == 1, counts[1] / y.sum(), counts[0] / (1 - y).sum())
        models[-1].shift = float(np.log(share[y == 1][0] / share[y == 0][0]))
        score = np.clip(known[:, -1], 1e-12, 1 - 1e-12)
        threshold = _best_threshold(1 / (1 + np.exp(-np.log(score / (1 - score)) - models[-1].shift)), y, share)
    return Chain(categories, models, threshold)


def judged(docs: DataFrame, chain: Chain, text_col: str = "text") -> DataFrame:
    """The rows with ``p_<category>`` for each category and ``toxic``, whether the last one reaches the threshold.

    Columns of these names give way. A null or empty text has no features and gets what the constants say.
    """
    names = [f"p_{c}" for c in chain.categories]

    def reader():
        return lambda texts: [tuple(x) for x in chain.chances([features(x) for x in texts]).tolist()]

    place = [f"c{n}" for n in range(len(docs.columns))]
    kind = ", ".join(f"p{n} double" for n in range(len(names)))
    rows = docs.toDF(*place).withColumn("judged", told(kind, reader)(dict(zip(docs.columns, place))[text_col]))
    kept = [F.col(c).alias(x) for x, c in zip(docs.columns, place) if x not in (*names, "toxic")]
    rows = rows.select(*kept, *(F.col(f"judged.p{n}").alias(x) for n, x in enumerate(names)))
    return rows.withColumn("toxic", F.col(names[-1]) >= chain.threshold)
