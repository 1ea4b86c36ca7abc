"""Lexical search, SentencePiece coding and hard negatives against plain versions and the library."""

import hashlib
import math
import random
import re
from array import array
from collections import Counter

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F
from test_llm_edges import CLASH, LONG, ROWS

from ridership.llm import hard_negatives, lexical_search, pieces
from ridership.llm.queries import QUERIES, tokenizer_file

MODEL = tokenizer_file("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def coder():
    return pieces.Pieces(MODEL)


@pytest.fixture(scope="module")
def odd_docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit(f"clash {c}") for c in [*CLASH, "ids", "decoded", "item", "score", "rank", "term"] if c not in ("_tokens", "_domain")})


# --- SentencePiece ---


def test_pieces_equal_the_library(coder, library):
    rng = random.Random(3)
    signs = [" ", "  ", "     ", "a", "e", "th", "in", "▁", "\n", "\t", "\r", "é", "你", "\0", "😀", "the", "er", "12", "<s>", "<0x41>", "﻿", "zz", "qu"]
    normal = [n for n, k in zip(coder.names, coder.kinds) if k == pieces.NORMAL]
    for words, size in ((signs, 25), (normal, 8)):
        for _ in range(4000):
            text = "".join(rng.choice(words) for _ in range(rng.randint(0, size)))
            ids = library.encode(text, add_bos=True, add_eos=True)
            assert coder.encode(text, True, True) == ids, repr(text)
            assert coder.decode(ids) == library.decode(ids), repr(text)


def test_decoding_of_any_ids_equals_the_library(coder, library):
    rng = random.Random(4)
    for _ in range(5000):
        ids = [rng.choice([0, 1, 2, 259, 264, 3 + 0xE4, 3 + 0xBD, 3 + 0xA0, rng.randrange(3, 259), rng.randrange(len(coder.names))]) for _ in range(rng.randint(0, 8))]
        assert coder.decode(ids) == library.decode(ids), ids


@pytest.mark.parametrize("text", ["a" * 20_000, " " * 20_001, "ab" * 9_000 + "c", "".join(random.Random(5).choice("etaoinsh") for _ in range(40_000))])
def test_long_segments(coder, library, text):
    assert coder.encode(text) == library.encode(text)


def test_marked_positions_are_left_for_good(coder):
    """A piece that is the longest match but does not stand apart gives way, and the result merges to itself."""
    rng = random.Random(6)
    for _ in range(2000):
        word = "".join(rng.choice(["er", "es", "t", "he", "in", "g", "ing", "s"]) for _ in range(12))
        cut = coder.cut(word)
        assert "".join(cut) == word and all(coder.apart(a, b) for a, b in zip(cut, cut[1:]))


def test_op12_equals_the_library(spark, library):
    rows = {r.doc_id: r for r in QUERIES["op12_sentencepiece"](spark, SMALL).collect()}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        ids = library.encode(d.text or "", add_bos=True, add_eos=True)
        want = (len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
        assert (rows[d.doc_id].n_tokens, rows[d.doc_id].ids_sha256, rows[d.doc_id].decoded_sha256) == want


def test_odd_rows_of_pieces(spark, odd_docs, library):
    got = sorted(((r.doc_id or 0), bytes(r.ids), r.decoded) for r in pieces.encode_documents(odd_docs, MODEL).collect())
    want = sorted((r[0] or 0, array("I", library.encode(r[1] or "", add_bos=True, add_eos=True)).tobytes(), r[1] or "") for r in ROWS)
    assert got == want
    assert pieces.encode_documents(odd_docs.limit(0), MODEL).collect() == []
    bare = pieces.encode_documents(spark.createDataFrame([(1, None)], "doc_id long, text string"), MODEL, begin=False, end=False).first()
    assert (bytes(bare.ids), bare.decoded) == (b"", "")


def test_other_models_are_refused(tmp_path):
    path = tmp_path / "unigram.model"
    path.write_bytes(b"\x12\x02\x18\x01")  # a trainer part with model type 1
    with pytest.raises(ValueError):
        pieces.Pieces(str(path))


# --- lexical search ---

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def plain_search(docs, items, k=10):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    cut = lambda t: TERM.findall((t or "").translate(lower))
    held = [(d, Counter(cut(t))) for d, t in docs]
    held = [(d, c, sum(c.values())) for d, c in held if c]
    n_docs, n_terms = len(held), sum(n for _, _, n in held)
    df = Counter(w for _, c, _ in held for w in c)
    out = []
    for item, text in set(items):
        scores = []
        for d, c, n in held:
            m = 25 + 75 * n * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (1_000_000_000 * c[w] // (1000 * c[w] + 8 * m)) for w in cut(text) if w in c)
            if score > 0:
                scores.append((-score, d is None, d))
        out += [(item, rank, d, -s) for rank, (s, _, d) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=repr)


def rows_of(df):
    return sorted([(r.item_id, r.rank, r.doc_id, r.score) for r in df.collect()], key=repr)


@pytest.mark.parametrize("block_bytes, shard_postings", [(1 << 20, 1 << 20), (40, 50), (1 << 20, 1)])
def test_search_equals_plain_scores(spark, block_bytes, shard_postings):
    rng = random.Random(7)
    words = ["the", "of", "The", "a1", "é", "É", "zebra", "rare", "x-y", "..", "naïve"]
    text = lambda n: " ".join(rng.choices(words, [30, 20, 5, 4, 3, 1, 1, 0.3, 1, 1, 1], k=n))
    docs = [(i, text(rng.randint(1, 40))) for i in range(150)] + [(500 + i, "the same text of ties") for i in range(30)] + [(7, "zebra zebra"), (7, "zebra zebra")]
    items = [(i, text(rng.randint(1, 8))) for i in range(12)] + [(20, "zebra"), (21, "the same"), (22, "no such word"), (20, "zebra"), (23, "the the the of")]
    got = lexical_search.search(
        spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), block_bytes=block_bytes, shard_postings=shard_postings
    )
    assert rows_of(got) == plain_search(docs, items)


def test_reading_stops_before_the_lists_end():
    """Few documents far ahead: settled from the heads of the lists, with the scores of reading everything."""
    rng = np.random.default_rng(8)
    n = 50_000
    impact = rng.integers(1, 1000, (3, n))
    impact[:, :20] += 1_000_000
    shard = lexical_search.Shard(np.full(n, 3), np.tile(np.arange(3), n), impact.T.ravel())
    read = []

    class Watched(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, slice):
                read.append(key.stop - key.start)
            return super().__getitem__(key)

    shard.doc = shard.doc.view(Watched)
    docs, scores = shard.best(np.arange(3), np.array([3, 2, 1]), 10)
    want = impact.T @ np.array([3, 2, 1])
    first = np.lexsort((np.arange(n), -want))[:10]
    assert docs.tolist() == first.tolist() and scores.tolist() == want[first].tolist()
    assert sum(read) < 0.1 * 3 * n


@pytest.mark.parametrize("seed", range(6))
def test_shard_ties(seed):
    rng = np.random.default_rng(seed)
    held = rng.random((300, 6)) < 0.3
    impact = rng.integers(1, 4, (300, 6))
    doc, term = np.nonzero(held)
    shard = lexical_search.Shard(held.sum(axis=1), term, impact[doc, term])
    asked, weights = np.array([0, 2, 3, 5, 9]), np.array([2, 1, 1, 3, 5])
    total = (impact * held)[:, [0, 2, 3, 5]] @ weights[:4]
    want = [d for d in np.lexsort((np.arange(300), -total)) if total[d] > 0][:10]
    docs, scores = shard.best(asked, weights, 10)
    assert docs.tolist() == want and scores.tolist() == total[want].tolist()


def test_odd_rows_of_search(spark, odd_docs):
    items = [(1, "plain TEXT"), (2, None), (3, ""), (None, "id"), (4, "ü" * 30000), (5, LONG), (6, "same"), (6, "text")]
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    docs = [(r[0], r[1]) for r in ROWS]
    assert rows_of(lexical_search.search(odd_docs, asked)) == plain_search(docs, items)
    assert lexical_search.search(odd_docs.limit(0), asked).collect() == []
    assert lexical_search.search(odd_docs, asked.limit(0)).collect() == []


# --- hard negatives ---


@pytest.mark.parametrize("size, most", [(64, 300), (3, 2**24), (2000, 2000), (1, 2**26), (5000, 1)])
def test_scores_by_residues_are_exact(size, most):
    rng = np.random.default_rng(size)
    a, b = rng.integers(-most, most + 1, (7, size)), rng.integers(-most, most + 1, (9, size))
    a[0], b[0] = most, -most
    want = [[sum(int(x) * int(y) for x, y in zip(u, v)) for v in b] for u in a]
    assert hard_negatives.exact_scores(a, b).tolist() == want


def test_primes_are_enough():
    for bound in (0, 1, 70_000, 2**40, 2**53):
        found = hard_negatives.primes(bound)
        assert len(set(found)) == len(found) and math.prod(found) > 2 * bound + 1 and math.prod(found) < 2**63


def plain_negatives(rows):
    sound = [(i, label, [math.floor(256 * x) for x in v]) for i, label, v in rows if None not in (i, label, v) and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, label, v in {(i, label, tuple(v)) for i, label, v in sound if i % 5 == 0}:
        met = sorted((-dot(v, w), j, other) for j, other, w in sound if j != i and len(w) == len(v))
        for s, j, _ in [m for m in met if m[2] == label][:5]:
            hard = [m for m in met if m[2] != label and 50 * -s <= 100 * -m[0] <= 95 * -s][:3]
            out += [(i, j, rank, n, -s, -t) for rank, (t, n, _) in enumerate(hard, 1)]
    return sorted(out)


@pytest.mark.parametrize("chunk_bytes", [1 << 24, 2_000])
def test_hard_negatives_equal_plain_ones(spark, chunk_bytes):
    rng = random.Random(9)
    rows = [(i, rng.randrange(3), [rng.choice([-1.0, -0.3, 0.0, 0.25, 0.5, 1.0]) for _ in range(rng.choice([4, 4, 4, 2]))]) for i in range(160)]
    rows += [(200, 1, [1.0, 1.0, 0.5, 0.5]), (201, 1, [1.0, 1.0, 0.5, 0.5]), (202, 2, [0.5, 1.0, 0.5, 0.5]), (202, 2, [0.5, 1.0, 0.5, 0.5]), (200, 1, [1.0, 1.0, 0.5, 0.5])]
    rows += [(300, None, [1.0] * 4), (305, 1, None), (310, 1, [None, 1.0, 1.0, 1.0]), (315, 2, [math.nan, 1.0, 1.0, 1.0]), (320, 2, [math.inf, 0.0, 0.0, 0.0]), (None, 1, [1.0] * 4)]
    rows += [(325, 1, []), (326, 2, []), (327, 1, []), (330, 1, [0.0] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").withColumns({c: F.lit("clash") for c in ("cell", "part", "ints", "anchor", "place", "low")})
    got = hard_negatives.mine(df, F.col("vec_id") % 5 == 0, chunk_bytes=chunk_bytes)
    assert sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in got.collect()) == plain_negatives([(i, label, v) for i, label, v in rows])
    assert hard_negatives.mine(df.limit(0), F.col("vec_id") % 5 == 0).collect() == []


def test_components_out_of_reach_take_no_part(spark):
    df = spark.createDataFrame([(0, 1, [3e38]), (5, 1, [1.0]), (6, 1, [1.0]), (7, 2, [0.75]), (8, 2, [-3e38])], "vec_id long, label int, embedding array<float>")
    got = hard_negatives.mine(df, F.col("vec_id") % 5 == 0).collect()
    assert [tuple(r) for r in got] == [(5, 6, 1, 7, 65536, 49152)]
