"""Vector codes, token links and fingerprints against plain versions, with odd rows."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from footfall.llm import scaled_sketch, token_alignment, tokens, vector_codes
from tests.llm.test_small import BASE, TEXTS, docs, none, prose  # noqa: F401

# Vector codes ----------------------------------------------------------------------------------------------


def test_trie_finds_the_nearest_entry():
    draw = np.random.default_rng(3)
    for low, high, width in ((-3, 3, 4), (-4096, 4096, 8), (0, 1, 3), (-(1 << 25), 1 << 25, 2)):
        parts = np.unique(draw.integers(low, high + 1, (500, width)), axis=0)
        entries = draw.integers(low, high + 1, (16, width))
        entries[5] = entries[2]
        every = ((parts[:, None] - entries) ** 2).sum(axis=2)
        chosen, least = vector_codes.nearest(parts, entries)
        assert (chosen == every.argmin(axis=1)).all() and (least == every.min(axis=1)).all()


def plain_codes(rows, parts=8, entries=16, rounds=6):
    """{id: (code, error, label_error, digest)} of (id, label, whole numbers) rows with unique ids."""
    rows = sorted(rows)
    x = np.array([v for _, _, v in rows], object).reshape(len(rows), parts, -1)
    books = [[list(v) for v in x[:entries, p]] for p in range(parts)]

    def near(p):
        return [min((sum((a - b) ** 2 for a, b in zip(v, e)), k) for k, e in enumerate(books[p])) for v in x[:, p]]

    for _ in range(rounds):
        for p in range(parts):
            of = defaultdict(list)
            for v, (_, k) in zip(x[:, p], near(p)):
                of[k].append(v)
            for k, found in of.items():
                books[p][k] = [sum(column) // len(found) for column in zip(*found)]
    found = [near(p) for p in range(parts)]
    digest = hashlib.sha256(",".join(str(int(v)) for b in books for e in b for v in e).encode()).hexdigest()
    out, by_label = {}, defaultdict(int)
    for n, (i, label, _) in enumerate(rows):
        error = sum(found[p][n][0] for p in range(parts))
        out[i] = ["".join(f"{found[p][n][1]:02x}" for p in range(parts)), error, label, digest]
        by_label[label] += error
    return {i: (code, error, by_label[label], digest) for i, (code, error, label, digest) in out.items()}


def coded(spark, rows, **how):
    docs = spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], "vec_id long, label string, embedding array<float>, id string, x long, code long")
    return vector_codes.vector_codes(docs, **how).collect()


def test_vector_codes(spark):
    draw = np.random.default_rng(4)
    rows = [(int(i), [None, "a", "b"][i % 3], [float(np.float32(v)) for v in draw.standard_normal(16)]) for i in range(60)]
    rows += [(100 + i, "a", rows[3][2]) for i in range(20)]  # copies
    odd = [(200, "a", None), (201, "a", [1.0] * 15 + [None]), (202, "b", [float("nan")] * 16), (203, "b", [float("inf")] * 16)]
    found = coded(spark, [*rows, *odd])
    want = plain_codes([(i, label or "", [int(np.floor(4096 * v)) for v in x]) for i, label, x in rows])
    assert {r["id"]: tuple(r)[1:] for r in found} == want and len(found) == len(rows)


def test_vector_codes_of_odd_tables(spark):
    assert coded(spark, []) == []
    assert coded(spark, [(1, "a", None)]) == []
    found = {r["id"]: r for r in coded(spark, [(1, "a", [0.5]), (2, None, [0.5, 1.0] * 5), (None, "a", [2.0] * 8), (2, "a", [3e38] * 3), (3, None, [])])}
    assert set(found) == {1, 2, 3, None} and all(r["error"] >= 0 for r in found.values())
    assert found[1]["error"] == found[3]["error"] == 0
    two = coded(spark, [(1, "a", [1.0] * 8), (1, "a", [0.0] * 8)], entries=1, rounds=0)
    assert sorted(r["error"] for r in two) == [0, 8 * 4096**2]
    assert [r["error"] for r in coded(spark, [(1, "a", []), (2, "b", [])])] == [0, 0]


# Token links -----------------------------------------------------------------------------------------------


def plain_links(rows):
    """[(id, n_a, n_b, n_groups, n_links, n_best, count_sum, digest)] by common byte offsets."""
    a_model = Tokenizer.from_file(tokens.default_path())
    a_model.encode_special_tokens = True
    b_model = sentencepiece.SentencePieceProcessor(model_file=token_alignment.default_pieces())
    letters = tokens._bytes_of_letters()
    held, df = [], Counter()
    for i, text in rows:
        a, b = a_model.encode(f" {text or ''}", add_special_tokens=False).ids, b_model.encode(text or "")
        a_bytes = [bytes(letters[c] for c in a_model.id_to_token(x)) for x in a]
        b_bytes = [bytes([int(p[3:5], 16)]) if b_model.is_byte(x) else p.replace("▁", " ").encode() for x, p in zip(b, map(b_model.id_to_piece, b))]
        if not text or not b"".join(a_bytes) == b"".join(b_bytes) == f" {text}".encode():
            held.append((i, None))
            continue
        a_ends, b_ends = (np.cumsum([len(x) for x in side]).tolist() for side in (a_bytes, b_bytes))
        groups, p, q = [], 0, 0
        for end in sorted({*a_ends} & {*b_ends}):
            p2, q2 = a_ends.index(end, p) + 1, b_ends.index(end, q) + 1
            groups.append((a[p:p2], b[q:q2]))
            p, q = p2, q2
        links = Counter((x, y) for g, h in groups for x in g for y in h)
        df.update(links.keys())
        held.append((i, (len(a), len(b), groups, links)))
    best = defaultdict(int)
    for (x, _), n in df.items():
        best[x] = max(best[x], n)
    out = []
    for i, found in held:
        if found is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = found
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        scores = sum(n for k, n in links.items() if df[k] == best[k[0]]), sum(n * df[k] for k, n in links.items())
        out.append((i, n_a, n_b, len(groups), sum(links.values()), *scores, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def test_common_ends():
    draw = np.random.default_rng(6)
    for density in (0.05, 0.5, 0.95, 1.0):
        for _ in range(30):
            a, b = (np.append(np.flatnonzero(draw.random(300) < density), 300) + 1 for _ in range(2))
            x, y = token_alignment.common_ends(a, b)
            ends = np.intersect1d(a, b)
            assert (a[x.cumsum() - 1] == ends).all() and (b[y.cumsum() - 1] == ends).all()
            assert x.sum() == len(a) and y.sum() == len(b)


ODD_TEXTS = ["▁ is a space there", "<s> </s> <unk> <|endoftext|> <0x41>", "a\u0000b", "漢字かな 한글 \U0001f600", "x" * 400 + "=" * 300, "\n\n\t  a  　 ", "1234567 89.5", " leading and trailing ", "\xa0\x85"]


@pytest.mark.parametrize("frequent", [token_alignment.FREQUENT, 40, 0])
def test_token_links(spark, docs, none, frequent):  # noqa: F811
    odd = spark.createDataFrame([(1000 + n, t, None, None, "clash", n) for n, t in enumerate(ODD_TEXTS)], docs.schema)
    every = docs.unionByName(odd)
    aligned, _, found = token_alignment.token_links(every, frequent=frequent)
    assert sorted(map(tuple, found.collect()), key=str) == plain_links([(r["doc_id"], r["text"]) for r in every.collect()])
    assert aligned.count() == every.count()
    assert token_alignment.token_links(none, frequent=frequent)[2].count() == 0


def test_long_texts_are_read_in_parts(monkeypatch):
    aligner = token_alignment.Aligner(tokens.encoder(tokens.default_path()), token_alignment.pieces(token_alignment.default_pieces()))
    texts = [prose(3000, 1), "  two  " * 500, "漢字" * 900, "a b" * 700 + "\n" + prose(300, 5)]
    whole = [aligner.align(x) for x in texts]
    monkeypatch.setattr(token_alignment, "_LONG", 50)
    for x, (want) in zip(texts, whole):
        assert all((p == q).all() for p, q in zip(aligner.align(x), want))


def test_texts_are_read_by_one_vocabulary_after_the_other(monkeypatch):
    aligner = token_alignment.Aligner(tokens.encoder(tokens.default_path()), token_alignment.pieces(token_alignment.default_pieces()))
    texts = ["One text, then another.", None, "", "a  b\tc", "word " * 30 + "end", "Straße 12 \u4e2d", "x"]
    calls = []
    monkeypatch.setattr(token_alignment, "_LONG", 60)
    want = [aligner.align(x) for x in texts]
    for name, each in (("a", aligner.a), ("b", aligner.b)):
        monkeypatch.setattr(each, "encode", lambda x, name=name, of=each.encode: calls.append(name) or of(x))
    found = list(aligner.align_all(texts))
    assert "".join(calls).startswith("aaaabbbb") and len(found) == len(want)
    for x, y in zip(found, want):
        assert (x is None) == (y is None) and (x is None or all(np.array_equal(p, q) for p, q in zip(x, y)))


def test_a_large_group_is_counted_by_its_ids(monkeypatch):
    a, b = np.array([5, 5, 6, 7], "<u2"), np.array([1, 2, 2], "<u2")
    x = token_alignment.Aligned(4, 3, 2, a.tobytes(), b.tobytes(), np.array([3, 1], "<u2").tobytes(), np.array([2, 1], "<u2").tobytes())
    want = x.links()
    monkeypatch.setattr(token_alignment, "_LARGE_GROUP", 2)
    assert all((p == q).all() for p, q in zip(x.links(), want))
    assert dict(zip(want[0].tolist(), want[1].tolist())) == {5 << 32 | 1: 2, 5 << 32 | 2: 2, 6 << 32 | 1: 1, 6 << 32 | 2: 1, 7 << 32 | 2: 1}


# Fingerprints ----------------------------------------------------------------------------------------------


def sketched(text, **how):
    return scaled_sketch.sketch_of(text, scaled_sketch.WIDTH, **how)


def test_sketches_merge_and_compare(monkeypatch):
    a, b = prose(4000, 1), prose(1500, 2)
    both = a + b[: scaled_sketch.WIDTH - 1]  # all shingles of a and some
    assert (scaled_sketch.merged(sketched(a), sketched(b)) == scaled_sketch.sketch(np.concatenate([scaled_sketch.hashes(x.encode(), scaled_sketch.WIDTH) for x in (a, b)]))).all()
    long = both + b
    assert scaled_sketch.containment(sketched(b), sketched(long)) == 1 and scaled_sketch.containment(sketched(a), sketched(long)) == 1
    exact = {x[k : k + scaled_sketch.WIDTH] for x in (a,) for k in range(len(x) - scaled_sketch.WIDTH + 1)}, {long[k : k + scaled_sketch.WIDTH] for k in range(len(long) - scaled_sketch.WIDTH + 1)}
    assert abs(scaled_sketch.likeness(sketched(a), sketched(long)) - len(exact[0] & exact[1]) / len(exact[0] | exact[1])) < 0.1
    assert abs(scaled_sketch.containment(sketched(long), sketched(a)) - len(exact[0] & exact[1]) / len(exact[1])) < 0.1
    assert scaled_sketch.likeness(sketched(""), sketched("")) == 1 and scaled_sketch.likeness(sketched(""), sketched("a")) == 0
    short = "one two three", "one two three four"
    grams = [{x[k : k + scaled_sketch.WIDTH] for k in range(len(x) - scaled_sketch.WIDTH + 1)} for x in short]
    assert scaled_sketch.likeness(*map(sketched, short)) == len(grams[0] & grams[1]) / len(grams[0] | grams[1])
    assert (scaled_sketch.read(scaled_sketch.written(sketched(a))) == sketched(a)).all()
    whole = sketched(long)
    monkeypatch.setattr(scaled_sketch, "_PIECE", 100)
    assert (sketched(long) == whole).all()


def test_fingerprints_merge_by_group(spark, docs, none):  # noqa: F811
    found = scaled_sketch.fingerprints(docs).withColumn("group", scaled_sketch.F.expr("nullif(id % 3, 0)"))
    got = {r["group"]: r["fingerprint"] for r in scaled_sketch.merged_by(found, "group").collect()}
    want = defaultdict(lambda: np.zeros(0, np.uint64))
    for r in docs.collect():
        group = r["doc_id"] % 3 or None if r["doc_id"] is not None else None
        want[group] = scaled_sketch.merged(want[group], sketched(r["text"] or ""))
    assert got == {g: scaled_sketch.written(x) for g, x in want.items()}
    assert scaled_sketch.merged_by(scaled_sketch.fingerprints(none), "id").count() == 0


def beside(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), scaled_sketch._digest((r[1] or "").encode())))
    out = []
    for n, (i, text) in enumerate(rows):
        text, after = text or "", rows[(n + 1) % len(rows)][1] or ""
        half = len(text) // 2
        changed = text[: len(text) - half] + after[:half]
        own, other, theirs = map(sketched, (text, changed, after))
        near = scaled_sketch.likeness(own, other), scaled_sketch.likeness(own, theirs), scaled_sketch.containment(own, theirs)
        out.append((i, len(text), hashlib.sha256(changed.encode()).hexdigest(), scaled_sketch.written(own), scaled_sketch.written(other), *near))
    return sorted(out, key=str)


@pytest.mark.parametrize("ranges", ["1", "2", "8"])
def test_beside_next(spark, docs, none, ranges):  # noqa: F811
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    try:
        rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
        assert sorted(map(tuple, scaled_sketch.beside_next(docs).collect()), key=str) == beside(rows)
        assert scaled_sketch.beside_next(none).collect() == []
        for some in ([(7, "alone")], [(None, None)], [(-(1 << 63), "a"), ((1 << 63) - 1, "b"), (None, "c")], [(5, f"text {n % 7}") for n in range(40)]):
            few = spark.createDataFrame(some, "doc_id long, text string")
            assert sorted(map(tuple, scaled_sketch.beside_next(few).collect()), key=str) == beside(some), some
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
