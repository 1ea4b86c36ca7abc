"""NULLs, empty and very long texts, ties, repeated rows, empty tables and clashing column names for every operator."""

import os

import pytest
from pyspark.sql import functions as F

from ridership.llm import chat, embedding_dedup, fingerprints, mixing, ngram_join, packing, quality, sharding, suffix_dedup, tokens
from ridership.llm.queries import WEIGHTS, domain, tokenizer_file

LONG = "many words of a long text " * 8000 + "ü" * 30000
ROWS = [
    (1, "a plain text of some words, long enough to hold a string of fifty bytes", "en", "src1", 70),
    (2, "a plain text of some words, long enough to hold a string of fifty bytes", "en", "src1", 70),
    (2, "a plain text of some words, long enough to hold a string of fifty bytes", "en", "src1", 70),
    (3, None, "en", None, None),
    (4, "", None, "src2", 0),
    (None, "no id here", "de", "src3", 10),
    (None, None, None, None, None),
    (5, LONG, "de", "src3", len(LONG)),
    (6, LONG, "de", "nosource", len(LONG)),
    (7, " \n\t ", "fr", "src4", 4),
    (7, "same id, other text", "fr", "src4", 19),
]
CLASH = ["at", "part", "key", "row", "blob", "tree", "size", "home", "label", "n", "p", "host", "path", "_tokens", "_bucket", "_slot", "text_key", "set_key", "start", "length", "domain", "_domain"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit(f"clash {c}") for c in CLASH if c not in ("_tokens", "_domain")})


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 0, 0), (3, None, 0), (5, 1, 0), (7, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")


def operators(labels):
    bpe = tokenizer_file("byte_bpe_50k.json")
    return {
        "pack": (lambda d: packing.pack_documents(d, bpe), None),
        "prints": (fingerprints.compare_neighbours, len(ROWS)),
        "prints alone": (fingerprints.fingerprints, len(ROWS)),
        "tokens": (lambda d: tokens.token_counts(d, tokenizer_file("byte_bpe_50k.tiktoken")), len(ROWS)),
        "mix": (lambda d: mixing.mix(d, domain(), WEIGHTS, F.col("_all"), 1), None),
        "join": (ngram_join.jaccard_components, len(ROWS)),
        "shards": (sharding.shard_documents, len(ROWS)),
        "quality": (lambda d: quality.classify(d, labels, F.col("source"), F.col("lang")), len(ROWS)),
        "repeats": (lambda d: suffix_dedup.remove_repeats(d)[0], len(ROWS)),
    }


@pytest.mark.parametrize("name", sorted(operators(None)))
def test_odd_rows_and_empty_table(spark, docs, labels, name):
    run, count = operators(labels)[name]
    got = run(docs).collect()
    assert got if count is None else len(got) == count
    assert run(docs.limit(0)).collect() == []


def test_odd_rows_by_value(docs):
    join = {(r.doc_id, r.n_shingles): r.component_id for r in ngram_join.jaccard_components(docs).collect()}
    assert join[1, 11] == join[2, 11] == 1 and join[6, 7] == 5
    assert join[3, 0] == 3 and join[None, 0] is None and join[7, 0] == 7
    lost = sorted(((r.doc_id or 0), r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.remove_repeats(docs)[0].collect())
    raw = len(LONG.encode())
    assert (2, 71, 71, 1) in lost and (1, 71, 0, 0) in lost and (6, raw, raw, 1) in lost and (5, raw, 0, 0) in lost
    chosen = mixing.mix(docs, domain(), WEIGHTS, F.col("_all"), 1).collect()
    # all tokens wanted, one epoch: every row that has a leaf with tokens
    assert len(chosen) == 8
    prints = {(r.doc_id, r.n_chars): r for r in fingerprints.compare_neighbours(docs).collect()}
    assert prints[2, 71].fingerprint == prints[1, 71].fingerprint and prints[4, 0].fingerprint == "0::"
    assert prints[6, len(LONG)].near_next == 1


def test_odd_conversations(spark):
    rows = [(1, 0, "user", "x"), (1, 0, "user", "x"), (1, None, None, None), (None, 1, "assistant", "y"), (2, 1, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("clash") for c in ("tree", "msg", "score", "path")})
    got = {r.tree: ([tuple(t) for t in r.turns], r.learned) for r in chat.read_back(chat.format_trees(chat.turns_as_messages(df))).collect()}
    assert got == {1: ([("", ""), ("user", "x"), ("user", "x")], ""), chat.NO_ID: ([("assistant", "y")], "y"), 2: ([("assistant", "")], "")}
    assert chat.format_trees(chat.turns_as_messages(df.limit(0))).collect() == []


def test_odd_embeddings(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, None)], "vec_id long, embedding array<float>").withColumn("class_id", F.lit("clash"))
    got = sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(df).collect())
    assert got == [(0, 0, None, True), (1, 1, 1, True), (1, 1, 1, True)]
    assert embedding_dedup.near_duplicates(df.limit(0)).collect() == []


def test_written_shards_hold_the_texts(docs, tmp_path):
    path = f"file://{tmp_path}/out"
    out = sharding.shard_documents(docs, shards=3, path=path, carry=["lang"])
    assert sorted((r.doc_id or 0, r.text or "", r.lang or "") for r in out.collect()) == sorted((r[0] or 0, r[1] or "", r[2] or "") for r in ROWS)
    assert sorted(x for x in os.listdir(f"{tmp_path}/out") if x.startswith("shard")) == ["shard=0", "shard=1", "shard=2"]
