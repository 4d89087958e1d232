"""Language identification by error-correcting output codes over hashed byte n-grams."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm.tables import by_text, least_hashed, row_hash, told

_BUCKETS = 1 << 12
_PIECE = 1 << 20
_FOLD = bytes(x + 32 if 65 <= x <= 90 else x if 97 <= x <= 122 or x >= 128 else 32 for x in range(256))
_ODD = np.uint32(2654435761)


def counted(text: str) -> np.ndarray:
    """How often each bucket of three neighbouring bytes comes in the whole text; what is no letter is a space."""
    data = b" " + text.encode().translate(_FOLD) + b" "
    found = np.zeros(_BUCKETS, np.int64)
    for at in range(0, len(data) - 2, _PIECE):
        x = np.frombuffer(data[at : at + _PIECE + 2], np.uint8).astype(np.uint32)
        three = (x[:-2] << 16) | (x[1:-1] << 8) | x[2:]
        three = three[three != 0x202020]
        found += np.bincount((three * _ODD) >> np.uint32(20), minlength=_BUCKETS)
    return found


def profile(text: str | None) -> np.ndarray | None:
    """The square roots of the counts, as a vector of length 1; None for a text without a letter."""
    if not text or not any(x.isalpha() for x in text):
        return None
    found = np.sqrt(counted(text).astype(np.float32))
    return found / max(1e-9, float(np.sqrt((found * found).sum())))


def codebook(classes: int, seed: int = 7) -> np.ndarray:
    """A codeword of +1 and -1 for each class.

    Up to five classes have every two-way split of them as a bit. For more, random words are drawn, ten bits for each
    doubling of the classes, and the draw with the largest least distance between two words is taken.
    """
    if classes <= 5:
        bits = max(1, 2 ** (classes - 1) - 1)
        number = np.arange(1, bits + 1)
        return np.array([np.where(number >> c & 1, 1, -1) for c in range(classes)], np.float32)
    bits, draw = int(np.ceil(10 * np.log2(classes))), np.random.default_rng(seed)
    best, apart = None, -1
    for _ in range(50):
        words = draw.choice(np.array([-1, 1], np.float32), (classes, bits))
        products = words @ words.T - 2 * bits * np.eye(classes)
        if (least := float((bits - products.max()) / 2)) > apart and (np.abs(words.sum(axis=0)) < classes).all():
            best, apart = words, least
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def decide(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(class, score) of each row: the codeword with the least loss, each bit weighed by how far it is trusted."""
        margins = (x @ self.weights + self.bias)[:, None, :] * self.code[None]
        loss = (self.trust[None] * np.logaddexp(0, -margins)).sum(axis=2)
        chance = np.exp(loss.min(axis=1, keepdims=True) - loss)
        return loss.argmin(axis=1), 1 / chance.sum(axis=1)


def _fit(x: np.ndarray, y: np.ndarray, share: np.ndarray, rounds: int = 150) -> tuple[np.ndarray, np.ndarray]:
    """Logistic regressions for all bits at once, by Adam over the whole sample. y: +1 or -1 for each row and bit."""
    weights, bias = np.zeros((x.shape[1], y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    for n in range(1, rounds + 1):
        slope = -y / (1 + np.exp(y * (x @ weights + bias))) * share[:, None]
        step = x.T @ slope + 1e-5 * weights
        first, second = 0.9 * first + 0.1 * step, 0.999 * second + 0.001 * step * step
        weights -= 0.3 * (first / (1 - 0.9**n)) / (np.sqrt(second / (1 - 0.999**n)) + 1e-8)
        bias -= 2.0 * slope.sum(axis=0)
    return weights, bias


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = 4000) -> Model:
    """A model of all languages that the rows name, from at most ``sample`` rows with letters.

    The rows are those least by a hash of id and text, one of equal rows, equally many of each language (at least five,
    so that a corpus of very many languages may exceed the bound). Whole texts are counted where they lie; the driver gets one vector of
    4,096 numbers per sampled row. A fifth of them tells how far each bit is to be trusted for each language.
    """
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = named.where("lang IS NOT NULL AND text RLIKE '\\\\p{L}'").select("lang", "text", row_hash("id", "text").alias("id"))
    languages = [r["lang"] for r in rows.select("lang").distinct().orderBy("lang").collect()]
    if not languages:
        return Model([], np.zeros((0, 1), np.float32), np.zeros((_BUCKETS, 1), np.float32), np.zeros(1, np.float32), np.zeros((0, 1), np.float32))
    each = max(5, sample // len(languages))
    chosen = least_hashed(rows.select("lang", "id").distinct(), "lang", each).distinct()

    def reader():
        empty = np.zeros(_BUCKETS, np.float16)
        return lambda text: ((empty if (x := profile(text)) is None else x.astype(np.float16)).tobytes(),)

    found = rows.join(F.broadcast(chosen), ["lang", "id"]).dropDuplicates(["lang", "id"])
    found = by_text(found, "x binary", reader).toPandas().sort_values(["lang", "id"], kind="stable")
    x = np.stack([np.frombuffer(v, np.float16) for v in found["x"]]).astype(np.float32)
    at = np.searchsorted(languages, found["lang"].to_numpy())
    code = codebook(len(languages))
    check = np.arange(len(x)) % 5 == 4
    sizes = np.bincount(at, minlength=len(languages)).astype(np.float32)
    share = 1 / (sizes[at] * len(languages))
    weights, bias = _fit(x[~check], code[at[~check]], share[~check] / share[~check].sum())
    right = (np.sign(x[check] @ weights + bias) == code[at[check]]).astype(np.float32)
    hits = np.stack([(right[at[check] == c].sum(axis=0) + 1) / ((at[check] == c).sum() + 2) for c in range(len(languages))])
    trust = hits / hits.mean(axis=1, keepdims=True)
    return Model(languages, code, weights, bias, trust.astype(np.float32))


def identify(docs: DataFrame, model: Model, text_col: str = "text", ambiguous_below: float = 0.5, columns: tuple[str, str, str] = ("lang_pred", "score", "ambiguous")) -> DataFrame:
    """The rows with ``lang_pred``, ``score`` and ``ambiguous`` added; columns of these names give way.

    The score is the nearest codeword's share of all codewords' likelihoods, from 0 to 1. Below ``ambiguous_below``
    the text lies between languages and is flagged. A null text, one without a letter, and any text if no language was
    learned, is ``und`` with score 0, and not flagged.
    """

    def reader():
        def of(texts: list[str | None]) -> list[tuple]:
            told_ = [("und", 0.0, False)] * len(texts)
            found = [(n, x) for n, t in enumerate(texts) if model.languages and (x := profile(t)) is not None]
            for at in range(0, len(found), 256):
                some = found[at : at + 256]
                best, score = model.decide(np.stack([x for _, x in some]))
                for (n, _), c, s in zip(some, best.tolist(), score.tolist()):
                    told_[n] = (model.languages[c], s, s < ambiguous_below)
            return told_

        return of

    names = [f"c{n}" for n in range(len(docs.columns))]
    place = dict(zip(docs.columns, names))
    rest = [x for x in docs.columns if x not in columns]
    rows = docs.toDF(*names).withColumn("told", told("lang_pred string, score double, ambiguous boolean", reader)(place[text_col]))
    return rows.select(*(F.col(place[x]).alias(x) for x in rest), *(F.col(f"told.{x}").alias(y) for x, y in zip(("lang_pred", "score", "ambiguous"), columns)))
