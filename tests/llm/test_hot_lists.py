"""Long posting lists of the n-gram join."""

import random

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from ridership.llm import ngram_join
from test_llm_parts import plain_shingles, roots


def meeting(spark, groups, chunk):
    """Pairs that leave the cells of one list of (group, place, n), each its own component, and the number of cells."""
    early = int(ngram_join._early(np.array([n for *_, n in groups]), np.array([p for _, p, _ in groups])).sum())
    rows = [(1, g, p, n, len(groups), early, g, g) for g, p, n in groups]
    df = spark.createDataFrame(rows, "shingle long, group_key long, place long, n long, postings long, early long, low long, high long")
    # marks that say nothing: all groups may share all of their shingles
    df = df.withColumns({"met": F.col("n"), **{m: F.lit(-1).cast("long") for m in ngram_join.MARKS}})
    dealt = df.filter("early > 0").selectExpr("*", f"explode({ngram_join._dealt(chunk)}) AS c").select("*", "c.*").drop("c").toPandas()
    out, cells = [], dealt.groupby(["i", "j"])
    for _, cell in cells:
        t = ngram_join._across(pa.Table.from_pandas(cell, preserve_index=False)).to_pydict()
        out += list(zip(t["a"], t["b"]))
    return out, len(cells)


def test_a_late_template_pairs_nothing(spark):
    # 80 % template: 20 shingles of a page's own stand before it in a prefix of 26, and no two pages link
    assert meeting(spark, [(g, 20, 100) for g in range(1, 301)], 1000) == ([], 0)


def test_cells_give_each_pair_once(spark):
    rng = random.Random(5)
    groups = [(g, rng.randrange(26), rng.randrange(80, 120)) for g in range(1, 301)]
    spare = ngram_join.SPARE
    want = {
        (a, b) for a, pa_, na in groups for b, pb, nb in groups
        if (na, a) < (nb, b) and 4 * na >= 3 * nb and 7 * (min(na - pa_, nb - pb) + spare) >= 3 * (na + nb)
    }
    whole, one = meeting(spark, groups, 1000)
    cut, many = meeting(spark, groups, 25)
    assert (one, many > 50) == (1, True)
    assert sorted(whole) == sorted(cut) == sorted(want) and want


def test_template_pages_against_plain_sets(spark):
    rng = random.Random(8)
    template = [f"t{i}" for i in range(100)]
    texts = []
    for i in range(90):
        own = rng.choice([8, 10, 12, 14, 16, 18, 22, 28])
        texts.append(" ".join(template + [f"x{i}y{k}" for k in range(own)] if i % 2 else [f"x{i}y{k}" for k in range(own)] + template))
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(docs, list_rows=200).collect()}
    sets = {i: plain_shingles(t) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    assert got == roots(sets, links) and len(set(got.values())) > 1


def edited_copies(n, seed=2):
    """Copies of one text with one to three words changed in places of their own, so that many do not link directly."""
    rng = random.Random(seed)
    words = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    out = []
    for i in range(n):
        own = list(words)
        for _ in range(rng.choice([0, 1, 1, 2, 2, 3])):
            own[rng.randrange(150)] = f"x{rng.randrange(10**9)}"
        out.append((i, " ".join(own)))
    return out


@pytest.fixture
def stored(monkeypatch):
    tables = {}
    real = ngram_join.stage

    def keep(df, name):
        tables[name] = real(df, name)
        return tables[name]

    monkeypatch.setattr(ngram_join, "stage", keep)
    return tables


def test_pairs_of_near_copies_grow_with_their_number(spark, stored):
    """Copies become one component over leaders, before any pair is taken across the lists."""
    pairs = {}
    for n in (400, 1600):
        docs = edited_copies(n)
        rows = ngram_join.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()
        pairs[n] = sum(stored[name].count() for name in stored if name == "near" or name.endswith("_pairs"))
        if n == 400:
            sets = [frozenset(" ".join(t.split()[i : i + 5]) for i in range(146)) for _, t in docs]
            root = list(range(n))
            for i in range(n):
                for j in range(i):
                    common = len(sets[i] & sets[j])
                    if 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common):
                        a, b = sorted((root[i], root[j]))
                        root = [a if r == b else r for r in root]
            assert {r.doc_id: r.component_id for r in rows} == dict(enumerate(root))
        stored.clear()
    assert all(count < 4 * n for n, count in pairs.items()), pairs
