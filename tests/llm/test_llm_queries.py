"""The registered queries: rows against DuckDB where SQL says the same, shape and laws elsewhere."""

import zlib
from collections import Counter

import pytest
from conftest import SMALL
from oracle import compare, connect

from ridership.llm.queries import ORACLES, QUERIES, tokenizer_file


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_rows_equal(spark, duck, name):
    assert compare(spark, duck, SMALL, QUERIES[name], ORACLES[name]) is None


def test_op1_contract(spark, duck):
    """Ids of the whole texts, cut and placed without gaps, in no more sequences than piece-by-piece best fit."""
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    want, lengths = {}, []
    for doc, text in duck.execute("SELECT doc_id, text FROM documents").fetchall():
        ids = coder.encode(text or "", add_special_tokens=False).ids + [0]
        for piece, at in enumerate(range(0, len(ids), 2048)):
            own = ids[at : at + 2048]
            want[doc, piece] = (at, len(own), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in own)))
            lengths.append(len(own))
    rows = QUERIES["op1_best_fit_packing"](spark, SMALL).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want
    place = Counter()
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == place[r.sequence_id]
        place[r.sequence_id] += r.length
    assert max(place.values()) <= 2048
    bins = []
    for n in sorted(lengths, reverse=True):
        fit = [b for b in bins if b[0] >= n]
        if fit:
            min(fit, key=lambda b: b[0])[0] -= n
        else:
            bins.append([2048 - n])
    assert len(place) == len(bins)


def test_op2_contract(spark, duck):
    import hashlib

    docs = [(d, t or "") for d, t in duck.execute("SELECT doc_id, text FROM documents ORDER BY doc_id DESC").fetchall()]
    rows = {r.doc_id: r for r in QUERIES["op2_document_fingerprints"](spark, SMALL).collect()}
    assert len(rows) == len(docs)
    prints = {}
    near = 0
    for i, (doc, text) in enumerate(docs):
        after = docs[(i + 1) % len(docs)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = rows[doc]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint
        assert r.near_next == 1 or text != after
        near += r.near_edited > r.near_next or text == after
    assert near >= 0.9 * len(docs)


def test_op7_contract(spark, duck):
    rows = QUERIES["op7_sharding"](spark, SMALL).collect()
    texts = dict(duck.execute("SELECT doc_id, text FROM documents").fetchall())
    assert Counter(r.doc_id for r in rows) == Counter(list(texts))
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
    counts = Counter(r.shard for r in rows)
    assert set(counts) == set(range(16)) and max(counts.values()) - min(counts.values()) <= 1
    assert sorted((r.shard, r.slot) for r in rows) == sorted((s, i) for s, n in counts.items() for i in range(n))
    assert [r.doc_id for r in sorted(rows, key=lambda r: (r.shard, r.slot))] != sorted(texts)


def test_op4_brute_force(spark, duck):
    from ridership.llm.tokens import pieces_of

    initial, inner = map(set, pieces_of(tokenizer_file("byte_bpe_50k.tiktoken")))

    def greedy(word):
        n = at = 0
        while at < len(word):
            end = next(e for e in range(len(word), at, -1) if word[at:e] in (inner if at else initial))
            at, n = end, n + 1
        return n

    known = {}
    rows = {r.doc_id: r for r in QUERIES["op4_token_counts"](spark, SMALL).collect()}
    for doc, text in duck.execute("SELECT doc_id, text FROM documents").fetchall():
        words = text.encode().split()
        for w in words:
            known.setdefault(w, greedy(b" " + w))
        assert (rows[doc].n_words, rows[doc].n_tokens, rows[doc].n_unknown) == (len(words), sum(known[w] for w in words), 0)
