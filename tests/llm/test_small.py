"""Each operator on small tables with the odd cases: nulls, empty and long texts, ties, repeated rows, no rows."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm import brute
from tokenizers import Tokenizer

from footfall.llm import best_fit, byte_network, chain, circulant, ecoc, exact, mixing, near_duplicates, packing, repeats, slack_packing, tables, tiles, tokens, words
from footfall.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, kept string, id long"
DRAW = np.random.default_rng(5)
VOCABULARY = ["".join(DRAW.choice(list("abcdefghij"), 4)) for _ in range(300)]


def prose(n, seed):
    return " ".join(np.random.default_rng(seed).choice(VOCABULARY, n))


BASE = prose(200, 1)
TEXTS = {
    1: BASE,
    2: BASE.upper(),
    3: BASE.replace(BASE.split()[50], "other"),
    4: None,
    5: "",
    6: " \t\n ",
    7: "one two",
    8: "ONE\ttwo",
    9: "one",
    10: prose(20_000, 2),
    11: prose(60, 3) + "\n" + " ".join(BASE.split()[20:80]) + "  " + prose(60, 4),
    12: prose(60, 3) + " x " + " ".join(BASE.split()[20:60]),
    13: "é È ßtraße 漢字   x" + "  y   z \n\n  w\t q ",
    14: "a " * 40,
}


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "xx" if i % 2 else "yy", f"s{i % 3}" if i != 5 else None, "clash", -i) for i, t in TEXTS.items()]
    rows += [rows[0], rows[6], (None, BASE, None, None, None, None), (None, None, None, "s0", None, None)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def by_id(rows):
    return {r[0]: r for r in rows if r[0] is not None}


def test_words_match_the_pattern():
    for text in TEXTS.values():
        data = (text or "").encode()
        starts, ends = words.spans(data)
        assert [data[a:b].decode() for a, b in zip(starts, ends)] == brute.words(text)
    long = prose(3000, 9).encode()
    whole = words.hashes(long)
    old, words._PIECE = words._PIECE, 700
    assert (words.hashes(long) == whole).all()
    words._PIECE = old
    assert len(set(whole.tolist())) == len(set(long.split()))


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (103, 101), (7, 7), (3, 2)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**{i: 1 for i in range(2, 41)}, 101: 100, 103: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_signature_estimates_similarity():
    a, b = (circulant.shingles(prose(900, 1) + " " + prose(100, k), 1) for k in (2, 3))
    exact_ = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    same = (circulant.signature(a, 4096, 1) == circulant.signature(b, 4096, 1)).mean()
    assert abs(same - exact_) < 0.05


@pytest.mark.parametrize("width,percent,bands", [(3, 85, 48), (5, 80, 64)])
def test_near_duplicates(docs, none, width, percent, bands):
    found = near_duplicates.near_duplicates(docs, width=width, percent=percent, bands=bands).collect()
    want = brute.near(TEXTS.items(), width, percent)
    assert len(found) == docs.count()
    for i, n, root, kept in found:
        assert (n, root, kept) == ((*want[i], want[i][1] == i) if i is not None else (n, None, True))
    assert near_duplicates.near_duplicates(none).count() == 0


def test_near_duplicates_of_a_loose_group(spark):
    """Copies of one text with many edits: not all link with the first, so the rest must be compared in blocks."""
    base, rows = prose(120, 7).split(), []
    for i in range(60):
        draw, text = np.random.default_rng(i), list(base)
        for at in draw.choice(len(base), i % 7, replace=False):
            text[at] = f"w{i % 11}x{at}"
        rows.append((i, " ".join(text)))
    found = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=3, percent=85, block=8)
    want = brute.near(rows, 3, 85)
    assert {r[0]: r[2] for r in found.collect()} == {i: x[1] for i, x in want.items()}


def test_near_duplicates_of_a_repeated_id(spark):
    """The texts of one id are sets of their own, whether or not the id is the smallest of their components."""
    a, b, c, d = (prose(100, n) for n in (21, 22, 23, 24))
    rows = [(2, a), (2, b), (9, a + " x"), (10, b + " x"), (30, c), (30, d), (20, c + " x"), (21, d + " x"), (30, c)]
    found = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=3, percent=85).collect()
    want = [(2, 98, 2, True), (2, 98, 2, True), (9, 99, 2, False), (10, 99, 2, False)]
    want += [(20, 99, 20, True), (21, 99, 21, True), (30, 98, 20, False), (30, 98, 20, False), (30, 98, 21, False)]
    assert sorted(map(tuple, found)) == want


def test_repeats(docs, none):
    found, spans = repeats.remove_repeats(docs, length=13)
    want = brute.repeats(TEXTS.items(), 13)
    rows = found.collect()
    assert len(rows) == docs.count()
    for r in rows:
        if r["id"] is None:
            assert r["n_removed"] == 0
        else:
            n, gone, left = want[r["id"]]
            assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == (n, gone, hashlib.sha256(left.encode()).hexdigest())
    assert {r["id"]: r["kept"] for r in spans.collect()} == {i: want[i][2] for i in want if 0 < want[i][1] < want[i][0]}
    assert repeats.remove_repeats(none)[0].count() == 0


def test_repeats_inside_one_document_stay(spark):
    rows = [(5, "a " * 60), (6, prose(30, 1) + " " + prose(30, 1)), (9, prose(30, 1))]
    found = by_id(repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), length=13)[0].select("id", "n_removed").collect())
    assert {i: r[1] for i, r in found.items()} == {5: 0, 6: 0, 9: 30}


def test_near_vectors(spark):
    draw = np.random.default_rng(1)
    vectors = [draw.standard_normal(16).tolist() for _ in range(40)]
    vectors += [(np.array(vectors[i % 5]) + 0.1 * draw.standard_normal(16)).tolist() for i in range(30)]
    vectors += [vectors[0], (np.array(vectors[0]) * 1e30).tolist(), [0.0] * 16, None, [], [1.0] * 8, [2.0] * 8, [None] + [1.0] * 15, [float("nan")] * 16, [float("inf")] + [1.0] * 15]
    rows = [(i, v, "x") for i, v in enumerate(vectors)] + [(None, vectors[0], "x")]
    found = by_id(tiles.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, n_links string"), block=16).collect())
    good = {i: np.array(v, float) for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    links = [(i, j) for i in good for j in good if i != j and len(good[i]) == len(good[j]) and good[i] @ good[j] / np.linalg.norm(good[i]) / np.linalg.norm(good[j]) >= 0.9]
    roots = brute.components(range(len(vectors)), links)
    for i in range(len(vectors)):
        assert tuple(found[i])[1:] == (sum(a == i for a, _ in links), roots[i], roots[i] == i)
    assert tiles.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_exact_duplicates(spark, docs, none):
    for key in (exact.first_half, lambda sha: sha.substr(1, 1)):
        rows = exact.exact_duplicates(docs, key=key).collect()
        assert len(rows) == docs.count()
        groups = {}
        for i, t in list(TEXTS.items()) + [(1, TEXTS[1]), (7, TEXTS[7]), (None, BASE), (None, None)]:
            groups.setdefault((t or "").translate(brute.LOWER), []).append(i)
        sizes = {hashlib.sha256(t.encode()).hexdigest(): (max(x for x in g if x is not None), len(g)) for t, g in groups.items()}
        assert {r["text_sha256"]: (r["keep_id"], r["group_size"]) for r in rows} == sizes
        assert sorted(r["text_sha256"] for r in rows if r["kept"]) == sorted(sizes)
        assert all(r["id"] == r["keep_id"] for r in rows if r["kept"])
    left = exact.without_duplicates(docs)
    assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == sorted(x[0] for x in sizes.values())
    assert exact.without_duplicates(none).count() == exact.exact_duplicates(none).count() == 0


def test_mixing(spark, docs, none):
    weights = mixing.turns(docs)
    assert [tuple(r) for r in weights.orderBy("weight", "source").collect()] == [(None, 1), ("s0", 1), ("s1", 2), ("s2", 3)]
    rows = mixing.mix_report(docs, weights).collect()
    assert len(rows) == docs.count() and all(r["taken"] <= 3 * r["size"] for r in rows)
    assert {(r["id"], r["size"]) for r in rows if r["id"]} == {(i, len(brute.words(t))) for i, t in TEXTS.items()}
    targets = {r["source"]: (r["target"], r["source_size"]) for r in rows}
    total = sum(size for _, size in targets.values())
    assert abs(sum(t for t, _ in targets.values()) - total) < 1e-6 * total and all(t <= 3 * n for t, n in targets.values())
    taken = mixing.mix(docs, weights)
    assert taken.columns == docs.columns and taken.count() == sum(r["copies"] for r in rows)
    assert mixing.mix_report(none, mixing.turns(none)).count() == mixing.mix(none, mixing.turns(none)).count() == 0


def test_mixing_comes_near_its_targets(spark):
    docs = spark.range(30_000).selectExpr("id AS doc_id", "repeat('w ', CAST(1 + id % 50 AS INT)) AS text", "IF(id % 3 = 0, 'hot', CONCAT('s', id % 7)) AS source")
    rows = mixing.mix_report(docs, mixing.turns(docs)).groupBy("source").sum("taken", "target", "size").collect()
    sizes = {r["source"]: r["sum(taken)"] for r in rows}
    targets = {r["source"]: r["target"] for r in mixing.mix_report(docs, mixing.turns(docs)).select("source", "target").distinct().collect()}
    assert all(abs(sizes[s] - targets[s]) < 0.05 * targets[s] for s in sizes)


def test_rows_without_or_with_one_id_are_drawn_apart(spark):
    docs = spark.range(4500).selectExpr("CASE WHEN id % 3 = 0 THEN 7 WHEN id % 3 = 1 THEN id END AS doc_id", "CONCAT('w', id, ' x y z') AS text", "CONCAT('s', id % 3) AS source")
    found = mixing.mix_report(docs, mixing.turns(docs)).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect()
    assert len(found) == 3 and all(abs(r["taken"] - r["target"]) < 0.1 * r["target"] for r in found)


def clashing(docs):
    """Columns whose names operators might use themselves."""
    names = ("_told", "_judged", "_row", "_n", "_place", "told", "judged", "graded", "row", "x", "c0", "draw", "copies")
    return docs.withColumns({x: F.lit(f"own {x}") for x in names}), names


def test_clashing_columns_keep_their_values(spark, docs):
    own, names = clashing(docs.select("doc_id", "text", "lang", "source"))
    network = byte_network.Network()
    made = [
        ecoc.identify(own, ecoc.train(docs)),
        byte_network.graded(own, network),
        chain.judged(own, chain.Chain(["toxic"], [chain.Linear(0).fit([np.zeros(1, np.uint32)] * 2, np.zeros((2, 0)), np.array([0, 1]), 1, 1)], 0.5)),
        mixing.mix(own, mixing.turns(own)),
        exact.without_duplicates(own),
    ]
    for rows in made:
        assert all(r[x] == f"own {x}" for r in rows.select(*names).collect() for x in names)


def test_a_sample_holds_rows_not_ids(spark):
    """One id over and over, and none at all, bring no more rows to the driver than the sample has."""
    rows = spark.range(20_000).selectExpr("5L AS doc_id", "CONCAT('some text ', id % 40) AS text", "'aa' AS lang")
    rows = rows.unionByName(spark.range(300).selectExpr("CAST(NULL AS LONG) AS doc_id", "CONCAT('other words ', id) AS text", "'bb' AS lang"))
    assert ecoc.train(rows, sample=100).languages == ["aa", "bb"]
    assert ecoc.train(rows.where("doc_id IS NULL"), sample=100).languages == ["bb"]
    labels = spark.createDataFrame([(5, 1, 0), (6, 0, 1)], "doc_id long, quality int, toxic int")
    assert byte_network.train(rows, labels, sample=100) == 1.0
    model = chain.train(rows, labels, ["toxic"], sample=100)
    assert chain.judged(rows.limit(3), model).count() == 3


def test_network_scores_odd_texts_alike(spark, docs, none):
    """A loop over chunks, filters and places gives the same scores, whatever else is in the batch; slopes are slopes."""
    network = byte_network.Network()
    p = {k: v.astype(np.float64) for k, v in network.parts.items()}

    def slow(text):
        layers = []
        for chunk in byte_network.chunks(text):
            seen = p["embedding"][chunk]
            places = range(0, byte_network.CHUNK - byte_network.WIDTH + 1, byte_network.STRIDE)
            high = np.max([seen[k : k + byte_network.WIDTH].reshape(-1) @ p["filter"] + p["filter_bias"] for k in places], axis=0)
            layers.append(np.maximum(np.maximum(high, 0) @ p["dense"] + p["dense_bias"], 0))
        both = np.concatenate([np.mean(layers, axis=0), np.max(layers, axis=0)])
        return 1 / (1 + np.exp(-(both @ p["last"] + p["last_bias"])))

    scores = {r["doc_id"]: r["score"] for r in byte_network.graded(docs, network).collect() if r["doc_id"]}
    for i, text in TEXTS.items():
        assert abs(scores[i] - slow(text).item()) < 1e-5, i
    assert byte_network.graded(none, network).count() == 0
    assert {r["score"] for r in byte_network.graded(docs, 0.5).collect()} == {0.5}


def test_chain_probabilities_the_slow_way(spark, docs):
    rows = [(i, prose(30, 500 + i) + (" vileword" if i % 4 == 0 else "")) for i in range(200)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0), int(i % 4 == 0)) for i, _ in rows], "doc_id long, spam int, toxic int")
    model = chain.train(spark.createDataFrame(rows, "doc_id long, text string"), labels, ["spam", "toxic"])
    texts = [*TEXTS.values()]
    one_by_one = np.concatenate([model.chances([chain.features(t)]) for t in texts])
    together = model.chances([chain.features(t) for t in texts])
    assert np.abs(one_by_one - together).max() < 1e-9
    told = {r["doc_id"]: (r["p_spam"], r["p_toxic"]) for r in chain.judged(docs, model).collect() if r["doc_id"]}
    assert all(np.abs(np.array(told[i]) - one_by_one[n]).max() < 1e-9 for n, i in enumerate(TEXTS))


def test_decoding_the_slow_way():
    draw = np.random.default_rng(8)
    code = ecoc.codebook(4)
    model = ecoc.Model(list("abcd"), code, draw.normal(size=(6, code.shape[1])), draw.normal(size=code.shape[1]), draw.uniform(0.5, 1.5, code.shape))
    x = draw.normal(size=(20, 6))
    best, score = model.decide(x)
    for row, b, s in zip(x, best, score):
        losses = []
        for c in range(4):
            loss = 0.0
            for bit in range(code.shape[1]):
                margin = code[c, bit] * (sum(v * w for v, w in zip(row, model.weights[:, bit])) + model.bias[bit])
                loss += model.trust[c, bit] * np.log1p(np.exp(-margin))
            losses.append(loss)
        assert b == int(np.argmin(losses)) and abs(s - np.exp(-min(losses)) / sum(np.exp(-v) for v in losses)) < 1e-6


@pytest.mark.parametrize("seed", range(40))
def test_plans_place_every_token_once(seed):
    draw = np.random.default_rng(seed)
    counts = {int(n): int(draw.integers(1, 12)) for n in draw.integers(1, 32, draw.integers(0, 12))}
    for plan in (slack_packing.plan, best_fit.plan):
        places, sequences = plan(counts, 32)
        held, taken = {}, {}
        for p in places:
            for rank in range(p.low, p.high):
                k = p.before + rank - p.low
                held.setdefault(p.first + k // p.each, []).append((p.offset + k % p.each * p.length, p.length))
                taken.setdefault((p.left, rank), []).append((p.cut, p.length))
        for parts, size in [*((sorted(x), None) for x in held.values()), *((sorted(x), key[0]) for key, x in taken.items())]:
            assert [a for a, _ in parts] == np.cumsum([0, *(n for _, n in parts[:-1])]).tolist()
            assert sum(n for _, n in parts) <= 32 and size in (None, sum(n for _, n in parts))
        assert sorted(held) == list(range(sequences)) and len(taken) == sum(counts.values())
        loads = sorted(sum(n for _, n in x) for x in held.values())
        if plan is slack_packing.plan:
            assert all(n == 32 or n & (n - 1) == 0 for n in loads)
        else:
            bins = []
            for n in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
                fit = [b for b in bins if b + n <= 32]
                if fit:
                    bins.remove(max(fit))
                bins.append(max(fit, default=0) + n)
            assert loads == sorted(bins)


def test_fullest_is_the_best_subset():
    draw = np.random.default_rng(3)
    for _ in range(50):
        counts = {int(n): int(draw.integers(1, 4)) for n in draw.integers(1, 40, 5)}
        sums = {0}
        for n, c in counts.items():
            sums = {s + k * n for s in sums for k in range(c + 1)}
        for room in (1, 17, 64):
            chosen = slack_packing.fullest(counts, room)
            assert sum(n * c for n, c in chosen.items()) == max(s for s in sums if s <= room)
            assert all(c <= counts[n] for n, c in chosen.items())


def test_ids_are_those_of_the_tokenizer():
    library = Tokenizer.from_file(tokens.default_path())
    library.encode_special_tokens = True
    texts = [*TEXTS.values(), "a\n \nb", " a", "a ", "a\n b  \n", "it's we'll 12 345...  !!\t", "x  y  z", "<|endoftext|> a", "\x1c \x85 q"]
    encoder = tokens.Encoder(tokens.default_path())
    for _ in range(2):
        for text in texts:
            assert encoder.encode(text).tolist() == library.encode(text or "", add_special_tokens=False).ids, repr(text)


def ids_of(rows):
    library = Tokenizer.from_file(tokens.default_path())
    return [(i, [*library.encode(t or "", add_special_tokens=False).ids, 0]) for i, t in rows]


def test_added_tokens_have_their_ids(spark):
    texts = ["x <|endoftext|> a", "<|endoftext|>", "<|endoftext|><|endoftext|> a  ", "a  \n <|endoftext|>  b", "<|endoftext|", "a <|endoftext|>b c <|endoftext|>\n \n", None]
    rows = list(enumerate(texts))
    assert ids_of(rows)[0][1] == [87, 220, 50256, 257, 0]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = tokens.tokenized(docs, "doc_id", "text").collect()
    assert {r["id"]: np.frombuffer(r["ids"], f"<u{r['size']}").tolist() for r in found} == dict(ids_of(rows))
    parts = slack_packing.pack(docs, capacity=8).select("id", "start", packing.wide("ids", "size").alias("wide")).collect()
    packed = {i: sum((np.frombuffer(r["wide"], "<u4").tolist() for r in sorted(parts, key=lambda r: r["start"]) if r["id"] == i), []) for i, _ in rows}
    assert packed == dict(ids_of(rows))


def test_slack_packing(docs, none, monkeypatch):
    monkeypatch.setattr(packing, "_BUCKET", 4)
    rows = slack_packing.pack(docs, capacity=64).withColumn("wide", packing.wide("ids", "size")).collect()
    found, sequences = {}, {}
    for r in rows:
        assert zlib.crc32(r["wide"]) and len(r["wide"]) == 4 * r["length"]
        found.setdefault(r["id"], []).append((r["start"], np.frombuffer(r["wide"], "<u4").tolist()))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    want = {}
    for i, ids in ids_of([(r["doc_id"], r["text"]) for r in docs.collect()]):
        want.setdefault(i, []).append(ids)
    for i, texts in want.items():
        assert sum(len(x) for _, x in found[i]) == sum(map(len, texts))
        if len(texts) == 1:
            assert sum((x for _, x in sorted(found[i])), []) == texts[0]
    for parts in sequences.values():
        parts.sort()
        n = sum(x for _, x in parts)
        assert [a for a, _ in parts] == np.cumsum([0, *(x for _, x in parts[:-1])]).tolist() and (n == 64 or n & (n - 1) == 0)
    assert slack_packing.pack(none).count() == 0


def test_matrices_restore_every_text(docs, none, tmp_path):
    matrices = best_fit.token_matrices(docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]), capacity=64)
    best_fit.write_matrices(matrices, str(tmp_path / "out"))
    found = {}
    for r in matrices.sparkSession.read.parquet(str(tmp_path / "out")).collect():
        ids, places = np.frombuffer(r["input_ids"], "<u2"), np.frombuffer(r["position_ids"], "<u2")
        assert len(ids) == 64 and r["cu_seqlens"][-1] == r["n_tokens"] and not ids[r["n_tokens"] :].any()
        for k, (i, start) in enumerate(zip(r["doc_ids"], r["starts"])):
            a, b = r["cu_seqlens"][k : k + 2]
            assert places[a:b].tolist() == list(range(b - a))
            found.setdefault(i, []).append((start, ids[a:b].tolist()))
    for i, ids in ids_of(TEXTS.items()):
        assert sum((x for _, x in sorted(found[i])), []) == ids
    assert best_fit.token_matrices(none).count() == 0


def test_samples_of_large_groups(spark):
    """Above 2^23 rows in a group the product of a hash and the group's size passes 2^63."""
    rows = spark.range(9_000_000).selectExpr("id", "IF(id < 20, 'few', 'many') AS lang")
    found = tables.least_hashed(rows, "lang", 50).groupBy("lang").agg({"id": "count"}).collect()
    assert sorted(map(tuple, found)) == [("few", 20), ("many", 50)]
    least = rows.where("lang = 'many'").orderBy(F.expr("pmod(xxhash64(id), 1099511627776)"), "id").limit(50)
    assert tables.least_hashed(rows, "lang", 50).where("lang = 'many'").select("id").exceptAll(least.select("id")).count() == 0


def test_codewords_are_apart():
    for classes in (2, 3, 5, 12):
        code = ecoc.codebook(classes)
        assert len({tuple(x) for x in code.tolist()}) == classes
    assert min((a != b).sum() for n, a in enumerate(code) for b in code[:n]) >= 5


def test_language(spark, docs, none):
    rows = [(i, " ".join("".join(x) for x in np.random.default_rng(i).choice(list(letters), (30, 3))), lang) for i, (letters, lang) in enumerate([("abcde", "aa"), ("vwxyz", "zz"), ("klmno", "mm")] * 40)]
    model = ecoc.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    told = {r["doc_id"]: r for r in ecoc.identify(spark.createDataFrame([(1, "abe cda bad", "x"), (2, "zyx wvy", "x"), (3, None, "x"), (4, "12 !", "x"), (5, "", "x")], "doc_id long, text string, score string"), model).collect()}
    assert [told[i]["lang_pred"] for i in range(1, 6)] == ["aa", "zz", "und", "und", "und"]
    assert told[1]["score"] > 0.9 and told[3]["score"] == 0 and not told[3]["ambiguous"]
    assert ecoc.identify(docs, ecoc.train(docs)).count() == docs.count()
    nothing = ecoc.train(none)
    assert {r["lang_pred"] for r in ecoc.identify(docs, nothing).collect()} == {"und"} and ecoc.identify(none, model).count() == 0


def test_toxicity_chain(spark, docs, none):
    rows = [(i, prose(40, 100 + i) + (" vileword" if i % 4 == 0 else "") + (" spam" if i % 3 == 0 else "")) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0), int(i % 4 == 0)) for i, _ in rows], "doc_id long, spam int, toxic int")
    model = chain.train(spark.createDataFrame(rows, "doc_id long, text string"), labels, ["spam", "toxic"])
    fresh = spark.createDataFrame([(1, prose(50, 7777) + " vileword", "c"), (2, prose(50, 8888), "c"), (3, None, "c"), (4, "", "c")], "doc_id long, text string, p_toxic string")
    assert [r["toxic"] for r in chain.judged(fresh, model).orderBy("doc_id").collect()] == [True, False, False, False]
    assert len(model.models[1].weights) == len(model.models[0].weights) + 1
    empty = chain.train(none, labels.limit(0), ["spam", "toxic"])
    assert chain.judged(docs, empty).count() == docs.count() and chain.judged(none, model).count() == 0


def test_ids_are_widened_without_python(spark):
    ids = [[], [0], [1, 255, 256, 65535], list(range(4000, 4300))]
    rows = [(n, np.array(x, f"<u{size}").tobytes(), size) for size in (2, 4) for n, x in enumerate(ids)]
    found = spark.createDataFrame(rows, "n int, ids binary, size int").select("n", packing.wide("ids", "size").alias("wide"))
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
    assert all(bytes(r["wide"]) == np.array(ids[r["n"]], "<u4").tobytes() for r in found.collect())
