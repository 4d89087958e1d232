"""Token ids of texts by a byte-level BPE vocabulary file.

Texts go to ``tiktoken`` one at a time and nothing is kept between them, so a Python worker holds the vocabulary and one
text's ids, whatever came before. Only runs of white space of over ``_LONG_RUN`` characters, at which its pattern gives
up, are cut out and merged by themselves.
"""

from __future__ import annotations

import json
import re
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm.tables import by_text

_LONG_RUN = 50_000
# What the vocabulary's pattern takes for white space.
_SPACE = "\t\n\v\f\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_RUN = re.compile(f"[{_SPACE}]{{{_LONG_RUN},}}")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _bytes_of_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, the rest from 256 on."""
    # Fixed values of the vocabulary file.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(x): x for x in plain}
    for n, x in enumerate(x for x in range(256) if x not in set(plain)):
        letters[chr(256 + n)] = x
    return letters


class Encoder:
    """Ids as arrays of ``dtype``; the same ids as the ``tokenizers`` library gives for the file."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        added = {x["content"]: x["id"] for x in model["added_tokens"]}
        if any(x[k] for x in model["added_tokens"] for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError(f"{path}: added tokens that take in or ask for what stands beside them")
        letters = _bytes_of_letters()
        ranks = {bytes(letters[c] for c in word): n for word, n in model["model"]["vocab"].items() if word not in added}
        self._bpe = tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.dtype = np.dtype("<u2" if max([*ranks.values(), *added.values()]) < 1 << 16 else "<u4")
        self._added = {word: np.array([n], self.dtype) for word, n in added.items()}
        self._at_added = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")")
        self.pieces = {n: word for word, n in ranks.items()}

    def _text(self, text: str) -> list[int]:
        if len(text) < _LONG_RUN or not (run := _RUN.search(text)):
            return self._bpe.encode_ordinary(text)
        # The last character of a run goes with what follows, the others are one piece for the merges.
        start, end = run.start(), run.end() - (run.end() < len(text))
        return self._bpe.encode_ordinary(text[:start]) + self._bpe._encode_single_piece(text[start:end]) + self._text(text[end:])

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of a text in which the added tokens are text like any other."""
        return np.array(self._text(text or ""), self.dtype)

    def encode_added(self, text: str | None) -> np.ndarray:
        """As the library does by default: an added token has its own id, and what stands between is encoded by itself."""
        if not text or not any(x in text for x in self._added):
            return self.encode(text)
        parts = self._at_added.split(text)
        return np.concatenate([self._added[x] if n % 2 else self.encode(x) for n, x in enumerate(parts)])


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def tokenized(docs: DataFrame, id_col: str, text_col: str, path: str | None = None, end: int = 0) -> DataFrame:
    """(id, ids, n): each text's ids as bytes of the encoder's width, with the id ``end`` last. A null text is empty."""

    def reader():
        bpe = encoder(path or default_path())
        last, size = np.array([end], bpe.dtype).tobytes(), bpe.dtype.itemsize

        def ids(text: str | None) -> tuple[bytes, int, int]:
            found = bpe.encode_added(text)
            return found.tobytes() + last, len(found) + 1, size

        return ids

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return by_text(rows, "ids binary, n long, size int", reader)
