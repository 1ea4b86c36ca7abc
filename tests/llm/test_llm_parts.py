"""The cores of the operators against plain versions, on small made-up cases."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ridership.llm import chat, embedding_dedup, fingerprints, mixing, ngram_join, packing, quality, suffix_dedup, text, tokens
from ridership.llm.common import components, maybe_in


def sets_of(rows):
    return {k: frozenset(v) for k, v in rows.items()}


def roots(nodes, links):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(110)]
    edges += [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2100)] + [(5, 5)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [e for e in edges if e[0] != e[1]]
    want = roots({n for e in real for n in e}, real)
    assert got.keys() == want.keys()
    assert len({(got[n], want[n]) for n in got}) == len(set(want.values())) == len(set(got.values()))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_bitmap_keeps_all_members(spark):
    df = spark.range(5000).withColumn("x", F.col("id") * 7)
    keys = spark.range(0, 5000, 13).select((F.col("id") * 7).alias("key"))
    got = {r.id for r in maybe_in(df, keys, F.col("x"), 1 << 16).collect()}
    assert set(range(0, 5000, 13)) <= got and len(got) < 1000


@pytest.mark.parametrize("seed", range(5))
def test_best_fit_runs_equal_piece_by_piece(seed):
    rng = random.Random(seed)
    lengths = sorted((rng.choice([1, 3, 7, 30, rng.randint(1, 100)]) for _ in range(400)), reverse=True)
    counts = {n: lengths.count(n) for n in set(lengths)}
    runs = packing.best_fit_runs(counts, 100)
    placed = {}
    for length, rank, per, first, at in runs:
        more = [r for r in runs if r[0] == length and r[1] > rank]
        end = min((r[1] for r in more), default=counts[length])
        for i in range(end - rank):
            placed.setdefault(first + i // per, []).append((at + i % per * length, length))
    bins = []
    for n in lengths:
        fit = [b for b in bins if b[0] >= n]
        if fit:
            b = min(fit, key=lambda b: b[0])
        else:
            b = [100, []]
            bins.append(b)
        b[0] -= n
        b[1].append(n)
    for parts in placed.values():
        place = 0
        for at, n in sorted(parts):
            assert at == place
            place += n
        assert place <= 100
    # which of several equally full sequences takes a piece is open
    assert sorted(sum(n for _, n in p) for p in placed.values()) == sorted(sum(b[1]) for b in bins)
    assert sorted(n for p in placed.values() for _, n in p) == sorted(lengths)


def test_packed_sequences(spark):
    docs = spark.createDataFrame([(i, "word " * (i % 9) + "ø" * (i % 5)) for i in range(60)], "doc_id long, text string")
    path = __import__("public_tokenizers").path("byte_bpe_50k.json")
    packed = packing.pack_documents(docs, path, max_tokens=16, with_ids=True).cache()
    rows = {r.sequence_id: r.ids for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        assert rows[r.sequence_id][r.offset : r.offset + r.length] == list(r.ids)
    assert sum(map(len, rows.values())) == sum(r.length for r in packed.collect())


def test_only_the_first_piece_is_short(spark, tmp_path):
    """op1 on documents just below, at and above one and two sequences; the ids are those of the library."""
    import zlib

    from tokenizers import Tokenizer

    from ridership.llm.queries import QUERIES

    path = __import__("public_tokenizers").path("byte_bpe_50k.json")
    rows = [(i, "a" + " a" * (n - 1)) for i, n in enumerate((1, 2046, 2047, 2048, 4095, 4096, 5000))] + [(7, None), (8, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for doc, t in rows:
        ids = Tokenizer.from_file(path).encode(t or "", add_special_tokens=False).ids + [0]
        first = (len(ids) - 1) % 2048 + 1
        for piece, end in enumerate(range(first, len(ids) + 1, 2048)):
            at = 0 if piece == 0 else end - 2048
            want[doc, piece] = (at, end - at, zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[at:end])))
    got = QUERIES["op1_best_fit_packing"](spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want
    assert all(r.length == 2048 for r in got if r.piece)


def plain_shingles(t, size=5):
    t = (t or "").translate({i: i + 32 for i in range(65, 91)}).encode()
    w = t.split()
    return {b" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def test_shingles_and_words():
    texts = ["", "a", "One two\tTHREE\nfour five six", "x x x x x x x x", None, "é à\x0bü ö ß", " lead and trail ", "a b c d e\x0cA B C D E a b c d e"]
    for limit in (1, 1 << 20):
        count = []
        for _, data, off in text.slices(pa.array(texts, pa.string()), limit):
            _, at = text.shingles(data, off)
            count += np.diff(at).tolist()
        assert count == [len(plain_shingles(t)) for t in texts]


def near_copies(rng, base, n, edits):
    out = []
    for _ in range(n):
        w = base.split()
        for _ in range(edits):
            w[rng.randrange(len(w))] = f"w{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_jaccard_join_brute_force(spark):
    rng = random.Random(3)
    words = [f"t{i}" for i in range(300)]
    passage = " ".join(rng.choice(words) for _ in range(60))
    base = " ".join(rng.choice(words) for _ in range(90))
    texts = near_copies(rng, base, 60, 2) + near_copies(rng, base, 30, 4) + [base] * 20
    texts += [" ".join(rng.choice(words) for _ in range(rng.randint(1, 80))) + " " + passage for _ in range(60)]
    # a chain in which only neighbours link
    chain = [f"c{i}" for i in range(120)]
    texts += [" ".join(chain[i : i + 60]) for i in range(0, 60, 6)]
    texts += ["", None, "a b", "A  b", "a b c d", "a b c d e", " \n "]
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    got = {r.doc_id: r for r in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), list_rows=500).collect()}
    sets = {i: plain_shingles(t) for i, t in rows}
    links = [
        (a, b) for a in sets for b in sets
        if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    ]
    want = roots(sets, links)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == {i: (len(sets[i]), want[i]) for i in sets}


def plain_repeats(rows, span=50):
    raw = {i: (t or "").encode() for i, t in rows}
    first = {}
    for i in sorted(raw):
        for k in range(len(raw[i]) - span + 1):
            first.setdefault(raw[i][k : k + span], i)
    out = {}
    for i, t in raw.items():
        gone = bytearray(len(t))
        for k in range(len(t) - span + 1):
            if first[t[k : k + span]] < i:
                gone[k : k + span] = b"\1" * span
        spans = len([x for x in bytes(gone).split(b"\0") if x])
        out[i] = (len(t), sum(gone), spans, bytes(c for c, g in zip(t, gone) if not g))
    return out


def test_repeats_brute_force(spark):
    import hashlib

    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6)))
    line = lambda n: " ".join(word() for _ in range(n))
    shared = [line(n) for n in (8, 14, 30, 60)]
    texts = []
    for _ in range(80):
        parts = [line(rng.randint(0, 40))]
        for s in rng.sample(shared, rng.randint(0, 3)):
            at = rng.randrange(len(s) // 3)
            parts += [s[at : len(s) - rng.randrange(len(s) // 3)], line(rng.randint(0, 9))]
        texts.append(" ".join(parts))
    texts += texts[:10] + ["ab" * 200, "ab" * 90, "b" * 50, "b" * 49, "x" * 51, "", None, shared[3], "tiny"]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    lost, cut = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), part_rows=300)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in lost.collect()}
    want = {i: (*v[:3], hashlib.sha256(v[3]).hexdigest()) for i, v in plain_repeats(rows).items()}
    assert got == want
    assert cut.count() > 0


def test_suffix_array_and_merging():
    rng = np.random.default_rng(5)
    data = rng.integers(97, 99, 400).astype(np.uint8)
    order, rank = suffix_dedup.suffix_array(data, 400)
    raw = data.tobytes()
    assert order.tolist() == sorted(range(400), key=lambda i: raw[i:])
    base = rng.integers(97, 123, (6, suffix_dedup.WIDTH)).astype(np.uint8)
    contexts = base[rng.integers(0, 6, 60)].copy()
    contexts[np.arange(60), rng.integers(0, suffix_dedup.WIDTH, 60)] = 48
    at = rng.integers(0, 30, 60)
    valid = np.ones((60, suffix_dedup.LEFT + 1), bool)
    first = {}
    for c in range(60):
        for o in range(suffix_dedup.LEFT + 1):
            key = contexts[c, o : o + 50].tobytes()
            first[key] = min(first.get(key, 99), at[c])
    want = {(c, o) for c in range(60) for o in range(suffix_dedup.LEFT + 1) if first[contexts[c, o : o + 50].tobytes()] < at[c]}
    for block in (1 << 20, 500, 82):
        c, o = suffix_dedup.repeated_strings(contexts, at, valid, block)
        assert set(zip(c.tolist(), o.tolist())) == want


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def test_edit_distance():
    rng = np.random.default_rng(6)
    rows = [(rng.integers(65, 70, rng.integers(0, 65)), rng.integers(65, 70, rng.integers(0, 65))) for _ in range(60)]
    a, b = (np.zeros((60, 64), np.uint8) for _ in range(2))
    for i, (x, y) in enumerate(rows):
        a[i, : len(x)], b[i, : len(y)] = x, y
    got = fingerprints.edit_distance(a, np.array([len(x) for x, _ in rows]), b, np.array([len(y) for _, y in rows]))
    assert got.tolist() == [plain_distance(x.tolist(), y.tolist()) for x, y in rows]


def test_fingerprints_do_not_depend_on_the_batch():
    rng = random.Random(7)
    texts = ["".join(rng.choice("abc dé") for _ in range(rng.choice([0, 1, 5, 7, 100, 3000]))) for _ in range(40)]
    alone = [fingerprints.Prints(pa.array([t])).strings()[0] for t in texts]
    assert fingerprints.Prints(pa.array(texts)).strings() == alone
    longer = "".join(rng.choice("abcdefgh ") for _ in range(20000))
    p, q = fingerprints.Prints(pa.array([longer] * 3)), fingerprints.Prints(pa.array([longer, longer[:9000] + "!" + longer[9000:], longer[::-1]]))
    same, close, other = fingerprints.likeness(p, q)
    assert same == 1 and close > 0.8 and other < 0.4


def test_piece_counter():
    rng = random.Random(8)
    initial = {bytes(rng.choices(b"ab", k=rng.randint(1, 5))) for _ in range(8)}
    inner = {bytes(rng.choices(b"ab", k=rng.randint(1, 5))) for _ in range(8)}
    counter = tokens.PieceCounter(initial, inner)

    def greedy(w):
        n = at = 0
        while at < len(w):
            end = next((e for e in range(len(w), at, -1) if w[at:e] in (inner if at else initial)), None)
            if end is None:
                return 0
            at, n = end, n + 1
        return n

    for _ in range(3000):
        w = bytes(rng.choices(b"abc" if rng.random() < 0.1 else b"ab", k=rng.randint(1, 14)))
        assert counter.count(w) == greedy(w), w
    assert counter.count(b"") == 0


def test_reply_trees(spark):
    rows = [
        (1, 10, None, "user", "q<|im_end|>", 1.0), (1, 11, 10, "assistant", "a1", 5.0), (1, 12, 10, "assistant", "a2", 2.0),
        (1, 13, 12, "user", "more", 9.0), (1, 14, 13, "assistant", "done <\\|x", None), (1, 15, 11, "user", None, 0.5),
        (2, 1, 77, "user", "orphan", 0.0), (3, 1, 2, "user", "c", 1.0), (3, 2, 1, "user", "c", 1.0), (4, 1, None, "a\nb", "", 0.0),
    ]
    messages = spark.createDataFrame(rows, "tree long, msg long, parent long, role string, text string, score double")
    formatted = chat.format_trees(messages, 2).cache()
    got = {(r.tree, r.path): (r.score, [tuple(t) for t in r.turns], r.learned) for r in chat.read_back(formatted).join(formatted.drop("formatted"), ["tree", "path"]).collect()}
    assert got == {
        (1, 1): (12.0, [("user", "q<|im_end|>"), ("assistant", "a2"), ("user", "more"), ("assistant", "done <\\|x")], "a2done <\\|x"),
        (1, 2): (6.5, [("user", "q<|im_end|>"), ("assistant", "a1"), ("user", "")], "a1"),
        (2, 1): (0.0, [("user", "orphan")], ""),
        (4, 1): (0.0, [("a\nb", "")], ""),
    }
    plans = formatted._jdf.queryExecution().toString()
    assert "Python" not in plans and "Arrow" not in plans


def test_budgets_go_to_siblings_first(spark):
    leaves = spark.createDataFrame(
        [("a", "x", "1", 10), ("a", "x", "2", 1000), ("a", "y", "3", 20), ("b", "x", "4", 1000), ("c", "z", "5", 0)],
        "domain string, lang string, source string, tokens long",
    )
    out = {r.source: round(r.budget, 6) for r in mixing.budgets(leaves, {"domain": {"a": 3.0}}, F.lit(400), 1).collect()}
    # c can take nothing; a has 3 of 4 parts: 300; y takes 20 of 150, its sibling x the rest; source 1 is full at 10
    assert out == {"1": 10.0, "2": 270.0, "3": 20.0, "4": 100.0, "5": 0.0}


@pytest.mark.parametrize("chunk", [2048, 40])
def test_embeddings_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(embedding_dedup, "CHUNK", chunk)
    monkeypatch.setattr(embedding_dedup, "MET", 50)
    rng = np.random.default_rng(9)
    base = rng.normal(size=(900, 32))
    base /= np.linalg.norm(base, axis=1, keepdims=True)

    def at_cosine(v, c):
        n = rng.normal(size=v.shape)
        n -= (n * v).sum(axis=1, keepdims=True) * v
        return c * v + np.sqrt(1 - c * c) * n / np.linalg.norm(n, axis=1, keepdims=True)

    close = at_cosine(base[:200], rng.uniform(0.951, 0.999, 200)[:, None])
    crowd = at_cosine(np.repeat(base[300:301], 100, axis=0), np.full((100, 1), 0.99))
    v = np.concatenate([base, close, crowd, base[300:301].repeat(30, axis=0), 3 * base[:5]]).astype(np.float32)
    rows = [(i, r.tolist()) for i, r in enumerate(v)]
    bad = [[0.0] * 32, [], None, [float("nan")] * 32, [None] + [1.0] * 31, [float("inf")] * 32]
    rows += [(5000 + i, r) for i, r in enumerate(bad)] + [(6000, [1.0] * 31), (None, v[0].tolist())]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert len(got) == len(rows)
    by = {r.vec_id: r for r in got}
    for i in [*range(5000, 5006), 6000]:
        assert (by[i].n_links, by[i].component_id, by[i].kept) == (0, i, True)
    w = np.concatenate([v, v[:1]]).astype(float)
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    want = ((w @ w.T) >= 0.95).sum(axis=1) - 1
    n = np.array([by[i].n_links for i in range(len(v))] + [by[None].n_links])
    assert (n <= want).all() and n.sum() >= 0.95 * want.sum()
    assert not by[None].kept and by[None].component_id == 0
    assert len({by[i].component_id for i in range(1000 + 100, 1230)}) == 1


def test_quality_on_held_out_labels(spark):
    from conftest import SMALL

    sf = SMALL.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    fit = labels.filter("doc_id % 2 = 0")
    out = quality.classify(docs, fit, F.col("source"), F.col("lang"))
    held = out.join(labels.filter("doc_id % 2 = 1"), "doc_id").collect()
    good = [r.keep == (r.quality == 1 and r.toxic == 0) for r in held]
    assert np.mean(good) > 0.93
    clean = [r.keep for r in held if r.quality == 1 and r.toxic == 0]
    assert np.mean(clean) > 0.95


def test_shrinkage_by_hand(spark):
    from conftest import SMALL

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = quality.classify(docs, spark.read.parquet(f"{SMALL}/labels.parquet"), F.col("source"), F.col("lang")).collect()
    p = np.array([r.p for r in rows])
    rate = p.mean()

    def shrunk(groups, prior):
        n, s = (np.array([f(groups[g]) for g in groups], float) for f in (len, sum))
        r = np.array([prior[g] for g in groups])
        tau = max(((n * (s / n - r) ** 2).sum() - (r * (1 - r)).sum()) / n.sum(), 1e-9)
        strength = max((n * r * (1 - r)).sum() / n.sum() / tau - 1, 1.0)
        return dict(zip(groups, (strength * r + s) / (strength + n)))

    hosts, paths = {}, {}
    for r in rows:
        hosts.setdefault(r.host, []).append(r.p)
        paths.setdefault((r.host, r.path), []).append(r.p)
    host = shrunk(hosts, dict.fromkeys(hosts, rate))
    path = shrunk(paths, {k: host[k[0]] for k in paths})
    odds = lambda x: np.log(x / (1 - x))
    for r in rows:
        assert np.isclose(r.host_rate, host[r.host]) and np.isclose(r.path_rate, path[r.host, r.path])
        assert np.isclose(odds(r.posterior), odds(path[r.host, r.path]) + odds(r.p) - odds(rate))


def test_the_fit_holds_its_words_once():
    rng = np.random.default_rng(5)
    n, words = 2_000, 10_000_000
    row, dim = np.sort(rng.integers(0, n, words)).astype(np.int32), rng.integers(0, 50_000, words).astype(np.int32)
    y, style = (np.arange(n) % 2).astype(float), rng.random((n, quality.STYLE))
    dim[(y[row] == 1) & (dim < 40)] = 50_000  # a word of one class
    seen = np.bincount(dim, minlength=quality.DIMS)
    tracemalloc.start()
    model = quality.fit(row, dim, style, y, steps=1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * words, "a number for each word of the sample"
    assert model.word[50_000] > 0 > model.word[7] and seen[7] > 0


def test_counts_keep_their_order_in_few_bytes(spark):
    counts = np.array([0, 1, 2, 3, 254, 255, 256, 2000, 2001, 65_535, 65_600, 1 << 20, 0xFFFFFFFF], np.uint32)
    assert (np.diff(ngram_join._levels(counts).astype(int)) > 0).all()
    docs = spark.createDataFrame([(1, "one two three four five six"), (2, "one two three four five")], "doc_id long, text string")
    table = ngram_join.profiles(docs)[1]
    assert table.nbytes == 2 * ngram_join.COUNTERS and np.count_nonzero(table) == 2 and len(np.unique(table)) == 3


def test_further_links_join_components(spark):
    rng = random.Random(8)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)]
    more = [(rng.randrange(400), rng.randrange(400)) for _ in range(60)]
    frame = lambda rows: spark.createDataFrame([e for e in rows if e[0] != e[1]], "a long, b long")
    for further in (more, []):
        rows = ngram_join._merged(components(frame(links)), frame(further), "more").collect()
        got = {r.node: r.label for r in rows}
        real = [e for e in links + further if e[0] != e[1]]
        want = roots({n for e in real for n in e}, real)
        assert got.keys() == want.keys() and len(rows) == len(got)
        assert len({(got[n], want[n]) for n in got}) == len(set(want.values())) == len(set(got.values()))
        assert all(got[label] == label for label in got.values())


def test_links_of_later_rounds_are_few(monkeypatch, spark):
    """Only the first round works on all links; the later ones on those between its components."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for i in range(40):
        base = [rng.choice(words) for _ in range(60)]
        rows += [(8 * i + k, " ".join(base[:55] + [f"{w}x{k}" for w in base[55:55 + k % 4]])) for k in range(8)]
    given = []
    monkeypatch.setattr(ngram_join, "components", lambda e, name: given.append((name, e.distinct().count())) or components(e, name))
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: d // 8 * 8 for d in range(320)}
    assert given[0][0] == "star_components" and len(given) >= 2
    assert all(n < given[0][1] / 2 for _, n in given[1:]), given
