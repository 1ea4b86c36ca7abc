"""What the operators move and keep on disk: rows of a round, shuffle files of a stored step."""

import time

import numpy as np
from pyspark.sql import functions as F

from ridership.llm import embedding_dedup, suffix_dedup
from ridership.session import stage


def test_stored_steps_leave_no_shuffle_files(spark):
    blocks = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ").count("shuffle_")
    before = blocks()
    stored = stage(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    for _ in range(50):
        if blocks() <= before:
            break
        time.sleep(0.2)
    assert blocks() <= before
    assert stored.count() == 7


def test_embeddings_move_in_bounded_rounds(spark, monkeypatch):
    """A dense cell meets in rounds of about as many rows as there are classes, and each link is counted once."""
    monkeypatch.setattr(embedding_dedup, "CHUNK", 30)
    monkeypatch.setattr(embedding_dedup, "ROUND", 100)
    monkeypatch.setattr(embedding_dedup, "BUCKET", 60)
    moved = []
    placed = embedding_dedup._placed

    def counted(*args):
        out = placed(*args)
        moved.append(out.count())
        return out

    monkeypatch.setattr(embedding_dedup, "_placed", counted)
    rng = np.random.default_rng(3)
    v = np.concatenate([rng.normal(size=(1, 16)) + 0.01 * rng.normal(size=(300, 16)), rng.normal(size=(200, 16))]).astype(np.float32)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "vec_id long, embedding array<float>")
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(df).collect()}
    assert sum(moved) > 5 * len(v) and max(moved) <= 2 * len(v)
    assert all(got[i].n_links == 299 and got[i].component_id == 0 for i in range(300))
    assert all(got[i].n_links == 0 for i in range(300, 500))


def test_arrays_look_up_one_merged_list(monkeypatch):
    """Each array searches once, however many arrays a shard has; the strings are those of one array."""
    rng = np.random.default_rng(6)
    base = rng.integers(97, 123, (40, suffix_dedup.WIDTH)).astype(np.uint8)
    contexts = base[rng.integers(0, 40, 900)].copy()
    contexts[np.arange(900), rng.integers(0, suffix_dedup.WIDTH, 900)] = 48
    at, valid = rng.integers(0, 300, 900), rng.random((900, suffix_dedup.LEFT + 1)) < 0.9
    pairs = lambda block: set(zip(*[x.tolist() for x in suffix_dedup.repeated_strings(contexts, at, valid, block)]))
    whole, calls, find = pairs(1 << 20), [], suffix_dedup._find
    monkeypatch.setattr(suffix_dedup, "_find", lambda keys, queries: calls.append(len(queries)) or find(keys, queries))
    assert pairs(20 * (suffix_dedup.WIDTH + 1)) == whole and len(whole) > 1000
    assert 0 < len(calls) <= 45


def test_contexts_without_a_common_string_build_no_arrays():
    """Contexts of one anchor are kept exactly where a string of 50 bytes may come twice."""
    rng = np.random.default_rng(7)
    left, span, width = suffix_dedup.LEFT, suffix_dedup.SPAN, suffix_dedup.WIDTH
    gram = rng.integers(97, 123, suffix_dedup.GRAM).astype(np.uint8)
    rows = rng.integers(97, 123, (400, width)).astype(np.uint8)
    for i in range(0, 60, 2):  # pairs that agree in l bytes to the left and 30 - l to the right
        reach = slice(left - i // 2, left - i // 2 + span)
        rows[i + 1, reach] = rows[i, reach]
    rows[:, left : left + suffix_dedup.GRAM] = gram
    seen = {}
    for c in range(400):
        for o in range(left + 1):
            seen.setdefault((o, rows[c, o : o + span].tobytes()), []).append(c)
    needed = {c for x in seen.values() if len(x) > 1 for c in x}
    kept = set(np.flatnonzero(suffix_dedup._may_repeat(rows)).tolist())
    assert needed <= kept and len(kept) < 100 and len(needed) >= 50
