"""A document's quality by a convolutional network over its bytes, trained and run in numpy."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm.tables import least_hashed, row_hash, told

CHUNK = 1024
HOP = 896
WIDTH = 16
STRIDE = 4
_PLACES = (CHUNK - WIDTH) // STRIDE + 1
_PAD = 256
_AT_ONCE = 128


def chunks(text: str | None) -> np.ndarray:
    """The whole text's bytes as overlapping chunks, the last filled up with padding; at least one chunk."""
    data = np.frombuffer((text or "").encode(), np.uint8)
    count = 1 if len(data) <= CHUNK else 1 + -(-(len(data) - CHUNK) // HOP)
    padded = np.full((count - 1) * HOP + CHUNK, _PAD, np.int16)
    padded[: len(data)] = data
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::HOP]


def _patches(rows: np.ndarray, embedding: np.ndarray) -> np.ndarray:
    """(chunk, place, WIDTH * size): what each filter sees at each place of each chunk."""
    size = embedding.shape[1]
    x = embedding[rows].reshape(len(rows), CHUNK * size)
    return np.lib.stride_tricks.sliding_window_view(x, WIDTH * size, axis=1)[:, :: STRIDE * size]


@dataclass
class Network:
    """Bytes are embedded, ``filters`` look at sixteen of them at every fourth place, and the maximum of each filter over
    a chunk goes through a dense layer. The means and maxima of that layer over all chunks give one probability."""

    seed: int = 20240229
    size: int = 8
    filters: int = 24
    hidden: int = 16
    parts: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self):
        draw = np.random.default_rng(self.seed)

        def normal(*shape, by):
            return (draw.standard_normal(shape) * by).astype(np.float32)

        self.parts = {
            "embedding": normal(257, self.size, by=0.5),
            "filter": normal(WIDTH * self.size, self.filters, by=(2 / (WIDTH * self.size)) ** 0.5),
            "filter_bias": np.zeros(self.filters, np.float32),
            "dense": normal(self.filters, self.hidden, by=(2 / self.filters) ** 0.5),
            "dense_bias": np.full(self.hidden, 0.1, np.float32),
            "last": normal(2 * self.hidden, by=0.1),
            "last_bias": np.zeros(1, np.float32),
        }
        self.parts["embedding"][_PAD] = 0

    def pooled(self, rows: np.ndarray, where: bool = False):
        """The maximum of each filter over each chunk, and with ``where`` its place."""
        p, high, at = self.parts, [], []
        for start in range(0, len(rows), _AT_ONCE):
            seen = _patches(rows[start : start + _AT_ONCE], p["embedding"])
            value = (seen.reshape(-1, seen.shape[2]) @ p["filter"]).reshape(len(seen), _PLACES, self.filters)
            if where:
                place = value.argmax(axis=1)
                at.append(place)
                high.append(np.take_along_axis(value, place[:, None], axis=1)[:, 0])
            else:
                high.append(value.max(axis=1))
        high = np.concatenate(high) + p["filter_bias"]
        return (high, np.concatenate(at)) if where else high

    def score(self, texts: list[str | None]) -> np.ndarray:
        """The probability of label 1 of each text, all its chunks read; a long text is read a part at a time."""
        p, out, waiting, owners = self.parts, [], [], []
        total, top, counts = np.zeros((len(texts), self.hidden), np.float64), np.zeros((len(texts), self.hidden), np.float32), np.zeros(len(texts))

        def flush():
            layer = np.maximum(np.maximum(self.pooled(np.concatenate(waiting)), 0) @ p["dense"] + p["dense_bias"], 0)
            who = np.concatenate(owners)
            np.add.at(total, who, layer)
            np.maximum.at(top, who, layer)
            np.add.at(counts, who, 1)
            waiting.clear()
            owners.clear()

        held = 0
        for n, text in enumerate(texts):
            rows = chunks(text)
            for start in range(0, len(rows), _AT_ONCE):
                part = rows[start : start + _AT_ONCE]
                waiting.append(part)
                owners.append(np.full(len(part), n))
                held += len(part)
                if held >= _AT_ONCE:
                    flush()
                    held = 0
        if held:
            flush()
        out = np.concatenate([total / np.maximum(counts, 1)[:, None], top], axis=1) @ p["last"] + p["last_bias"]
        return 1 / (1 + np.exp(-out.astype(np.float64)))

    def slopes(self, rows: np.ndarray, starts: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the log loss over documents, whose chunks are rows starts[n] to starts[n + 1]."""
        p = self.parts
        high, place = self.pooled(rows, where=True)
        open_ = np.maximum(high, 0)
        layer = np.maximum(open_ @ p["dense"] + p["dense_bias"], 0)
        counts = np.diff(np.append(starts, len(rows)))
        who = np.repeat(np.arange(len(starts)), counts)
        mean, top = np.add.reduceat(layer, starts) / counts[:, None], np.maximum.reduceat(layer, starts)
        both = np.concatenate([mean, top], axis=1)
        error = ((1 / (1 + np.exp(-(both @ p["last"] + p["last_bias"]))) - labels) / len(labels)).astype(np.float32)
        g = {"last": both.T @ error, "last_bias": error.sum(keepdims=True)}
        back = error[:, None] * p["last"]
        best = (layer == top[who]) & (layer > 0)
        to_layer = (back[:, : self.hidden] / counts[:, None])[who] + best * back[:, self.hidden :][who]
        to_layer *= layer > 0
        g["dense"], g["dense_bias"] = open_.T @ to_layer, to_layer.sum(axis=0)
        to_high = (to_layer @ p["dense"].T) * (high > 0)
        g["filter_bias"] = to_high.sum(axis=0)
        bytes_at = rows[np.arange(len(rows))[:, None, None], place[:, :, None] * STRIDE + np.arange(WIDTH)]
        seen = p["embedding"][bytes_at].reshape(len(rows), self.filters, -1)
        g["filter"] = np.einsum("cfs,cf->sf", seen, to_high)
        to_bytes = (to_high[:, :, None] * p["filter"].T[None]).reshape(-1, self.size)
        g["embedding"] = np.stack([np.bincount(bytes_at.ravel(), to_bytes[:, k], 257) for k in range(self.size)], axis=1)
        g["embedding"][_PAD] = 0
        return g

    def fit(self, texts: list[str], labels: np.ndarray, epochs: int, batch: int = 32, rate: float = 0.005) -> None:
        """Adam over the texts in a fixed random order, with the rate falling to nothing."""
        draw, steps, n = np.random.default_rng(self.seed), epochs * -(-len(texts) // batch), 0
        first = {k: np.zeros_like(v) for k, v in self.parts.items()}
        second = {k: np.zeros_like(v) for k, v in self.parts.items()}
        for _ in range(epochs):
            for some in np.array_split(draw.permutation(len(texts)), -(-len(texts) // batch)):
                each = [chunks(texts[i]) for i in some]
                starts = np.cumsum([0, *map(len, each)])[:-1]
                n += 1
                speed = rate * (1 - (n - 1) / steps) * (1 - 0.999**n) ** 0.5 / (1 - 0.9**n)
                for k, g in self.slopes(np.concatenate(each), starts, labels[some].astype(np.float32)).items():
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.001 * (g * g - second[k])
                    self.parts[k] -= (speed * first[k] / (np.sqrt(second[k]) + 1e-8)).astype(np.float32)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = 3000, sample_bytes: int = 16384, epochs: int = 10) -> Network | float:
    """A network fitted to labelled documents; where only one label is known, that label as a constant score.

    Learned from at most ``sample`` documents of up to ``sample_bytes`` bytes, half of them of either label as far as
    there are any, those least by a hash of id and text, one of equal rows. Without any label the score is 0.5.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL")
    texts = texts.where(F.octet_length("text").between(1, sample_bytes)).withColumn("row", row_hash("id", "text"))
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).where("id IS NOT NULL AND label IN (0, 1)")
    marks = marks.groupBy("id").agg(F.max("label").alias("label"))
    marks = marks.join(texts.select("id", "row").distinct(), "id").select("label", F.col("row").alias("id"))
    chosen = least_hashed(marks, "label", sample // 2)
    found = texts.select("text", F.col("row").alias("id")).join(F.broadcast(chosen), "id").dropDuplicates(["id"]).toPandas()
    if found["label"].nunique() < 2:
        return float(found["label"].iloc[0]) if len(found) else 0.5
    found = found.sort_values("id", kind="stable")
    network = Network()
    network.fit(found["text"].tolist(), found["label"].to_numpy(), epochs)
    return network


def graded(docs: DataFrame, model: Network | float, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """The rows with ``score`` added, the probability of label 1 by the whole text; a column of this name gives way.

    A null or empty text is one chunk of padding and gets the network's score for it.
    """

    def reader():
        if isinstance(model, float):
            return lambda texts: [(model,)] * len(texts)
        return lambda texts: [(x,) for x in model.score(texts).tolist()]

    place = [f"c{n}" for n in range(len(docs.columns))]
    rows = docs.toDF(*place).withColumn("graded", told("score double", reader)(dict(zip(docs.columns, place))[text_col]))
    kept = [F.col(c).alias(x) for x, c in zip(docs.columns, place) if x != score_col]
    return rows.select(*kept, F.col("graded.score").alias(score_col))
