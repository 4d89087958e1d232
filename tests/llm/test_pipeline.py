"""The whole pipeline beside its steps done the plain way, and classifiers on documents they have not seen."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm import brute
from tokenizers import Tokenizer

import corpus_pipeline
from footfall.llm import ecoc, queries, tables, tokens

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def test_stages_decide_as_the_plain_way_does(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    told = corpus_pipeline.language(spark, docs, SMALL)
    assert told.columns == docs.columns
    rows = {r["doc_id"]: r["text"] for r in told.collect()}
    assert len(rows) >= 0.98 * docs.count()
    last = {}
    for i in sorted(rows):
        last[rows[i].translate(brute.LOWER)] = i
    unique = corpus_pipeline.exact(spark, told, SMALL)
    assert sorted(r["doc_id"] for r in unique.collect()) == sorted(last.values())
    left = {i: rows[i] for i in last.values()}
    near = corpus_pipeline.near(spark, unique, SMALL)
    assert sorted(r["doc_id"] for r in near.collect()) == sorted(i for i, (_, root) in brute.near(left.items(), 5, 80).items() if i == root)
    mixed = corpus_pipeline.mixed(spark, near, SMALL)
    assert mixed.columns == docs.columns
    words, taken = (sum(len(brute.words(r["text"])) for r in x.collect()) for x in (near, mixed))
    assert 0.5 * words < taken < 2 * words


def test_letters_stay_where_no_language_is_named(spark):
    rows = [(1, "some words", None), (2, "12 !", None), (3, None, None), (4, "", None), (5, "été", None), (None, "more", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    left = corpus_pipeline.language(spark, docs, SMALL)
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} == {1, 5, None}


def test_near_copies_go_by_row(spark):
    """Of a repeated id the clean text stays, of its own near copies one."""
    words = [f"w{n}" for n in range(400)]
    a, b, c = (" ".join(words[n : n + 100]) for n in (0, 100, 200))
    rows = [(1, a), (7, a + " x"), (7, b), (8, c), (8, c + " y"), (8, c + "  y"), (9, None), (None, a), (None, a + " z")]
    left = corpus_pipeline.near(spark, spark.createDataFrame(rows, "doc_id long, text string"), SMALL)
    found = [tuple(r) for r in left.collect()]
    assert left.columns == ["doc_id", "text"] and len(found) == 6
    assert {(1, a), (7, b), (9, None), (None, a), (None, a + " z")} < set(found) and {i for i, _ in found} == {1, 7, 8, 9, None}


def test_run_packs_what_the_mix_takes(spark):
    parts = corpus_pipeline.run(spark, SMALL).toPandas()
    used = parts.groupby("sequence_id")["length"].sum()
    assert all(n == 1024 or n & (n - 1) == 0 for n in used)
    whole = parts.groupby("doc_id").agg(length=("length", "sum"), tokens=("doc_tokens", "first"))
    assert (whole["length"] % whole["tokens"] == 0).all() and (whole["length"] // whole["tokens"] <= 3).all()


def test_run_is_what_the_plain_way_gives(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    model = ecoc.train(docs.where(~tables.held_out(F.col("doc_id"))))
    dropped = {}
    for i, r in rows.items():
        if (x := ecoc.profile(r["text"])) is None:
            dropped[i] = "no letter"
        elif model.decide(x[None])[1][0] < 0.5:
            dropped[i] = "between languages"
    told = {r["doc_id"] for r in corpus_pipeline.language(spark, docs, SMALL).collect()}
    assert rows.keys() - told == dropped.keys() and len(told) + len(dropped) == docs.count()
    last = {(rows[i]["text"] or "").translate(brute.LOWER): i for i in sorted(told)}
    near = brute.near([(i, rows[i]["text"]) for i in last.values()], 5, 80)
    left = [(i, rows[i]["text"], rows[i]["source"]) for i, (_, root) in near.items() if i == root]
    library = Tokenizer.from_file(tokens.default_path())
    want = {i: n for i, n in brute.copies(left).items() if n}
    ids = {i: np.array([*library.encode(rows[i]["text"] or "", add_special_tokens=False).ids, 0], "<u4") for i in want}
    held = {i: np.zeros(len(x), int) for i, x in ids.items()}
    for r in corpus_pipeline.run(spark, SMALL).collect():
        a, b = r["start"], r["start"] + r["length"]
        assert r["doc_tokens"] == len(ids[r["doc_id"]]) and r["ids_crc32"] == zlib.crc32(ids[r["doc_id"]][a:b].tobytes())
        held[r["doc_id"]][a:b] += 1
    assert {i: set(x.tolist()) for i, x in held.items()} == {i: {n} for i, n in want.items()}


@pytest.mark.parametrize("name,table,label,told,least", [("op1_output_codes", "documents", "lang", "lang_pred", 0.97), ("op3_byte_network", "labels", "quality", "predicted", 0.9), ("op6_toxicity_chain", "labels", "toxic", "predicted", 0.93)])
def test_held_out_accuracy(spark, name, table, label, told, least):
    found = queries.ALL[name](spark, MIDDLE)
    assert found.count() == 1000
    truth = spark.read.parquet(f"{MIDDLE}/{table}.parquet").select("doc_id", label)
    found = found.join(truth, "doc_id").where("held_out").toPandas()
    assert (found[label] == found[told]).mean() >= least and found["score"].between(0, 1).all()


def test_queries_give_their_columns(spark):
    repeats = {r["doc_id"]: r for r in queries.ALL["op9_seed_and_extend"](spark, SMALL).collect()}
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    for i, (n, gone, kept) in brute.repeats(texts, 13).items():
        assert tuple(repeats[i])[1:] == (n, gone, hashlib.sha256(kept.encode()).hexdigest())
    near = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.ALL["op7_circulant_minhash"](spark, SMALL).collect()}
    assert near == brute.near(texts, 3, 85)
