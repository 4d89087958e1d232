"""Two tokenizers side by side: groups of tokens that cover the same bytes, and how often their ids meet in a corpus."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from footfall.llm.tables import by_text, parts_of, saved
from footfall.llm.tokens import Encoder, default_path, encoder

_LONG = 1 << 20
# Both tokenizers begin a new token at a space between two of these letters, whatever else the text holds.
_BETWEEN = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")
_FIRST_STEP = 4
_LARGE_GROUP = 1 << 16
_BUFFER = 1 << 22
#: At most as many id pairs are sent to all tasks, thirteen bytes each.
FREQUENT = 1 << 19


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """Ids of a sentencepiece model and the bytes of each."""

    def __init__(self, path: str):
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.dtype = np.dtype("<u2" if self._model.vocab_size() <= 1 << 16 else "<u4")
        self.pieces = {n: self._bytes(n) for n in range(self._model.vocab_size())}

    def _bytes(self, n: int) -> bytes:
        piece = self._model.id_to_piece(n)
        return bytes([int(piece[3:5], 16)]) if self._model.is_byte(n) else piece.replace("▁", " ").encode()

    def encode(self, text: str) -> list[int]:
        return self._model.encode(text)


@cache
def pieces(path: str) -> Pieces:
    return Pieces(path)


def _lengths(tokens: dict[int, bytes]) -> np.ndarray:
    out = np.zeros(max(tokens) + 1, np.int64)
    for n, piece in tokens.items():
        out[n] = len(piece)
    return out


def common_ends(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each group how many tokens it has on each side, given the rising byte ends of all tokens; the last are equal.

    While both sides' ends agree at the present shift between their indexes, tokens stand one to one: runs of them are
    jumped by comparing slices that double in length, then halve at the first that differs. At a difference the side that
    is behind moves on until both ends meet; that group is irregular, and the shift changes by what it holds.
    """
    left, right = a.tolist(), b.tolist()
    count, groups, i, shift = len(left), 0, 0, 0
    irregular, sizes = [], []
    while i < count:
        at, step = i, _FIRST_STEP
        while i < count and left[i : i + step] == right[i + shift : i + step + shift]:
            i, step = i + step, step * 2
        while step > 1 and i < count:
            step >>= 1
            if left[i : i + step] == right[i + shift : i + step + shift]:
                i += step
        i = min(i, count)
        groups += i - at
        if i < count:
            k, m = i, i + shift
            x, y = left[k], right[m]
            while x != y:
                if x < y:
                    k += 1
                    x = left[k]
                else:
                    m += 1
                    y = right[m]
            irregular.append(groups)
            sizes.append((k + 1 - i, m + 1 - i - shift))
            groups, i, shift = groups + 1, k + 1, m - k
    out = np.ones((2, groups), np.int64)
    out[:, irregular] = np.array(sizes, np.int64).reshape(-1, 2).T
    return out[0], out[1]


def _segments(text: str) -> Iterator[str]:
    """The text in parts of about a million characters, cut at spaces where both tokenizers begin anew."""
    at = 0
    while len(text) - at > _LONG and (cut := _BETWEEN.search(text, at + _LONG)):
        yield text[at : cut.start()]
        at = cut.end()
    yield text[at:]


class Aligner:
    def __init__(self, a: Encoder, b: Pieces):
        self.a, self.b = a, b
        self._length_a, self._length_b = _lengths(a.pieces), _lengths(b.pieces)

    def _groups(self, part: str, a: np.ndarray, b: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        data = f" {part}".encode()
        if b"".join(map(self.b.pieces.__getitem__, b)) != data:
            return None
        b = np.array(b, self.b.dtype)
        ends = self._length_a[a].cumsum()
        if ends[-1] != len(data):  # a byte-level vocabulary that has every byte restores the text
            return None
        return a, b, *common_ends(ends, self._length_b[b].cumsum())

    def align(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """(ids of A, ids of B, tokens of A in each group, of B); None without tokens or where bytes differ."""
        if not text:
            return None
        found = []
        for part in _segments(text):
            groups = self._groups(part, self.a.encode(f" {part}"), self.b.encode(part))
            if groups is None:
                return None
            found.append(groups)
        return found[0] if len(found) == 1 else tuple(map(np.concatenate, zip(*found)))

    def align_all(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None]:
        """``align`` of each text. Short ones are read by one vocabulary after the other: by turns, the tables of each
        push those of the other out of the processor's caches."""
        short = [x for x in texts if x and len(x) <= _LONG]
        a = [self.a.encode(f" {x}") for x in short]
        read = zip(short, a, [self.b.encode(x) for x in short])
        for text in texts:
            yield self._groups(*next(read)) if text and len(text) <= _LONG else self.align(text)


def _packed(sizes: np.ndarray) -> bytes:
    return sizes.astype("<u2" if sizes.max() < 1 << 16 else "<u4").tobytes()


def _unpacked(data: bytes, count: int) -> np.ndarray:
    return np.frombuffer(data, f"<u{len(data) // count}").astype(np.int64) if count else np.zeros(0, np.int64)


def alignments(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """(id, n_a, n_b, n_groups, a, b, a_sizes, b_sizes): each text's tokens by both vocabularies and their groups.

    A encodes a space and the text, in which added tokens are text like any other; B, a sentencepiece model, adds the
    space itself. ``a`` and ``b`` are the ids as little-endian numbers of 16 bits (32 for a larger vocabulary);
    a token's bytes are those of its piece. The byte offsets at which tokens of both end cut them into groups, and the
    sizes say how many tokens of A and B each group has, 16 bits each, or 32 where one has over 65,535.

    A null or empty text, or one that the tokens' bytes do not restore, has no tokens. Texts of over a million
    characters are read in parts, cut where both vocabularies begin a token anyway. Rows that repeat an id, or have
    none, are read each on their own.
    """

    def reader():
        aligner = Aligner(encoder(path_a or default_path()), pieces(path_b or default_pieces()))

        def row(found: tuple | None) -> tuple:
            if found is None:
                return 0, 0, 0, b"", b"", b"", b""
            a, b, x, y = found
            return len(a), len(b), len(x), a.tobytes(), b.tobytes(), _packed(x), _packed(y)

        return lambda texts: [row(x) for x in aligner.align_all(texts)]

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return by_text(rows, "n_a long, n_b long, n_groups long, a binary, b binary, a_sizes binary, b_sizes binary", reader, together=True)


class Aligned:
    """One document's groups, as ``alignments`` writes them."""

    def __init__(self, n_a: int, n_b: int, n_groups: int, a: bytes, b: bytes, a_sizes: bytes, b_sizes: bytes):
        self.a, self.b = _unpacked(a, n_a), _unpacked(b, n_b)
        self.a_sizes, self.b_sizes = _unpacked(a_sizes, n_groups), _unpacked(b_sizes, n_groups)

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """(pairs, times): the distinct linked id pairs as a << 32 | b, in order, and how many links each has."""
        p, q = self.a_sizes, self.b_sizes
        at_a, at_b, n = p.cumsum() - p, q.cumsum() - q, p * q
        one, more = np.flatnonzero(n == 1), np.flatnonzero((n > 1) & (n <= _LARGE_GROUP))
        found = [self.a[at_a[one]] << 32 | self.b[at_b[one]]]
        if len(more):
            n, q = n[more], q[more]
            within = np.arange(n.sum()) - np.repeat(n.cumsum() - n, n)
            first, second = np.divmod(within, np.repeat(q, n))
            found.append(self.a[np.repeat(at_a[more], n) + first] << 32 | self.b[np.repeat(at_b[more], n) + second])
        pairs, times = np.unique(np.concatenate(found), return_counts=True)
        # A group of very many tokens is counted by its distinct ids.
        large = np.flatnonzero(self.a_sizes * self.b_sizes > _LARGE_GROUP)
        for g in large.tolist():
            x, m = np.unique(self.a[at_a[g] : at_a[g] + self.a_sizes[g]], return_counts=True)
            y, k = np.unique(self.b[at_b[g] : at_b[g] + self.b_sizes[g]], return_counts=True)
            pairs, times = _summed([pairs, (x[:, None] << 32 | y).reshape(-1)], [times, np.outer(m, k).reshape(-1)])
        return pairs, times

    def text(self) -> bytes:
        """The ids of each group, ``a1,a2|b1;a3|b2,b3``, written by columns: five digits at most and what stands after."""
        if not len(self.a):
            return b""
        groups = np.arange(len(self.a_sizes))
        group_a, group_b = np.repeat(groups, self.a_sizes), np.repeat(groups, self.b_sizes)
        ends_a, ends_b = self.a_sizes.cumsum(), self.b_sizes.cumsum()
        after_a, after_b = np.full(len(self.a), ord(","), np.uint8), np.full(len(self.b), ord(","), np.uint8)
        after_a[ends_a - 1], after_b[ends_b - 1] = ord("|"), ord(";")
        after_b[-1] = 0
        at_a = np.arange(len(self.a)) + (ends_b - self.b_sizes)[group_a]
        at_b = np.arange(len(self.b)) + ends_a[group_b]
        digits = _digits(int(max(self.a.max(), self.b.max())))
        out = np.empty((len(self.a) + len(self.b), digits.shape[1] + 1), np.uint8)
        out[at_a, :-1], out[at_a, -1] = digits[self.a], after_a
        out[at_b, :-1], out[at_b, -1] = digits[self.b], after_b
        out = out.reshape(-1)
        return out[out != 0].tobytes()


@cache
def _written(places: int) -> np.ndarray:
    numbers = np.array([str(n) for n in range(10**places)], f"S{places}")
    return numbers.view(np.uint8).reshape(-1, places)


def _digits(highest: int) -> np.ndarray:
    """A row of decimal digits for each number up to the highest, filled with zero bytes."""
    return _written(len(str(highest)))


_COLUMNS = ["n_a", "n_b", "n_groups", "a", "b", "a_sizes", "b_sizes"]


def _summed(pairs: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    pairs, times = np.concatenate(pairs), np.concatenate(times)
    order = np.argsort(pairs, kind="stable")
    pairs, times = pairs[order], times[order]
    first = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]])) if len(pairs) else np.zeros(0, np.int64)
    return pairs[first], np.add.reduceat(times, first) if len(first) else times


def _documents(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[Aligned]]]:
    """Ranges of a batch's rows of about a MB, with their groups."""
    columns = [batch.column(c) for c in _COLUMNS]
    sizes = sum(pc.binary_length(c).to_numpy(zero_copy_only=False) for c in columns[3:]) + 64
    for at, end in parts_of(sizes):
        yield at, end, [Aligned(*(c[n].as_py() for c in columns)) for n in range(at, end)]


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n, best) for each linked id pair: in how many documents, and whether no pair of its A id is in more.

    Tasks count about four million pairs at a time before they hand them on, so a pair that every document has travels
    a few times for each task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def counted() -> pa.RecordBatch:
            pairs, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(pairs, pa.int64()), pa.array(n, pa.int64())], ["pair", "n"])

        for batch in batches:
            for _, _, found in _documents(batch):
                for x in found:
                    pairs, _ = x.links()
                    held.append(pairs)
                    size += len(pairs)
                if size > _BUFFER:
                    yield counted()
                    held, size = [], 0
        if size:
            yield counted()

    counts = aligned.select(*_COLUMNS).mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = saved(counts.withColumn("a", F.shiftright("pair", 32)), "pairs")
    best = saved(counts.groupBy("a").agg(F.max("n").alias("most")), "best")  # one row for each id of the vocabulary
    return saved(counts.join(best, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "counts")


def _least_frequent(counts: DataFrame, most: int) -> int:
    """The smallest power of two such that at most ``most`` pairs are in as many documents."""
    sizes = {r["k"]: r["pairs"] for r in counts.groupBy(F.floor(F.log2("n")).alias("k")).agg(F.count("*").alias("pairs")).collect()}
    total, least = 0, max(sizes, default=0) + 1
    for k in sorted(sizes, reverse=True):
        total += sizes[k]
        if total > most:
            break
        least = k
    return 0 if least == min(sizes, default=0) else 1 << least


def scored(aligned: DataFrame, counts: DataFrame, digest: Callable[[Aligned], str], frequent: int = FREQUENT) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, digest) for each document.

    A link counts in as many documents as its pair does; ``count_sum`` adds this up and ``n_best`` counts the links whose
    pair is among the most counted of their A id. At most ``frequent`` pairs, those in most documents, are sent to all
    tasks and looked up where the documents are; only what is left meets its count in a join, where no pair has many rows.
    """
    least = _least_frequent(counts, frequent)
    table = counts.where(F.col("n") >= least).toArrow()
    known = [table.column(c).to_numpy() for c in ("pair", "n", "best")]
    order = np.argsort(known[0])
    known = [x[order] for x in known]
    kind = "uid long, id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, digest string, pair array<long>, times array<long>"
    fields = to_arrow_schema(StructType.fromDDL(kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = known
        for batch in batches:
            for at, end, found in _documents(batch):
                out = []
                for row, x in zip(range(at, end), found):
                    pairs, times = x.links()
                    place = np.minimum(np.searchsorted(pair, pairs), max(0, len(pair) - 1))
                    met = pair[place] == pairs if len(pair) else np.zeros(len(pairs), bool)
                    place, many, rest = place[met], times[met], ~met
                    score = int((n[place] * many).sum()) if len(pair) else 0, int(many[best[place]].sum()) if len(pair) else 0
                    out.append((len(x.a), len(x.b), len(x.a_sizes), int(times.sum()), score[1], score[0], digest(x), pairs[rest], times[rest]))
                new = [pa.array(list(c), f.type) for c, f in zip(zip(*out), list(fields)[2:])]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(at, end - at) for c in ("uid", "id")), *new], schema=fields)

    rows = aligned.select("uid", "id", *_COLUMNS).mapInArrow(run, kind)
    named = ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "digest"]
    if not least:
        return rows.select(named)
    rows = saved(rows, "known")
    rest = rows.select("uid", F.explode(F.arrays_zip("pair", "times")).alias("x")).select("uid", "x.pair", "x.times")
    rare = rest.join(counts.where(F.col("n") < least), "pair")
    more = rare.groupBy("uid").agg(F.sum(F.col("n") * F.col("times")).alias("more"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"))
    total = rows.drop("pair", "times").join(saved(more, "rare"), "uid", "left")
    sums = {"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more", F.lit(0))}
    return total.withColumns(sums).select(named)


def _sha256(x: Aligned) -> str:
    return hashlib.sha256(x.text()).hexdigest() if len(x.a) else ""


def token_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_a: str | None = None, path_b: str | None = None, frequent: int = FREQUENT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three tables: the groups of each text (``alignments``), the pairs' counts (``pair_counts``), and the scores of each
    row (``scored``), whose ``digest`` is the SHA-256 of all groups' ids, empty where there are none.

    All tokens of a group are linked with each other across the two vocabularies. Rows that repeat an id are documents of
    their own. Of an empty table all three are empty.
    """
    aligned = alignments(docs, id_col, text_col, path_a, path_b)
    aligned = saved(aligned.withColumn("uid", F.monotonically_increasing_id()), "aligned", "zstd")
    counts = pair_counts(aligned)
    return aligned, counts, scored(aligned, counts, _sha256, frequent)
