"""Ranked lexical search (operator 11): the best documents of each item by NRA over impact-sorted lists.

Terms are maximal runs of letters, digits and non-ASCII characters of the whole text, A-Z as a-z. The score of a document
is a sum over an item's terms of the term's weight times the document's impact for it, in whole numbers, so that ties are
exact.

1. One pass over the texts keeps, per document, its length and its counts of the terms that any item asks for; document
   counts of the terms, the number of documents and the sum of their lengths come from all documents.
2. Each task cuts its stored documents into shards of bounded size. A shard has a list per term, sorted by impact, and for
   every item its lists are read from the top, step by step. A document met has a lower score, what it has been seen with,
   and an upper score, with what the heads of the lists that have not shown it may still add. Reading goes on until the
   shard's best documents, their ties and their scores are settled: no other document, seen or not, can reach the last of
   them, and those that can reach it have equal lower and upper scores.
3. A ranking over the shards' answers, a few rows an item and shard, gives the result.

A document belongs to one shard, so a common term's list is cut as documents are; nothing is shuffled but the answers. The
asked terms travel to the tasks in blocks of items of bounded size; a block is one pass. Tasks read stored rows, and a
lost one is run again.

Defined cases: NULL and empty texts have no terms and count nowhere; items without terms, or whose terms no document holds,
have no rows; equal (item_id, text) rows are one item, different texts with one ``item_id`` are ranked each for itself;
repeated documents are ranked each, equal scores by ascending ``doc_id``, NULL last; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridership.llm.common import small_batches
from ridership.session import stage

BEST = 10
BLOCK_BYTES = 8 << 20  # of the texts of the items of a pass
SHARD_POSTINGS = 4_000_000
SHARD_SEEN = 64_000_000  # documents of a shard times terms of the longest item
FIRST_STEP = 256

# every byte that is no part of a term becomes a space, A-Z become a-z; bytes from 128 on belong to non-ASCII characters
_PARTS = bytes(c + 32 if 65 <= c <= 90 else c if chr(c).isdigit() or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_PARTS).split()


def _counts(docs: DataFrame, number: dict[bytes, int]) -> DataFrame:
    """doc_id, n and the asked terms with their counts, of every document with a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = number.keys()
        for b in batches:
            keep, n, ids, times, at = [], [], [], [], [0]
            for row, text in enumerate(b.column("text").cast(pa.binary()).to_pylist()):
                words = (text or b"").translate(_PARTS).split()
                if not words:
                    continue
                found = Counter(filter(asked.__contains__, words))
                keep.append(row)
                n.append(len(words))
                ids += [number[w] for w in found]
                times += found.values()
                at.append(len(ids))
            offsets = pa.array(at, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (ids, times)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(keep, pa.int64())), pa.array(n, pa.int64()), *lists], names=["doc_id", "n", "terms", "times"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n long, terms array<int>, times array<int>")


class Shard:
    """Documents with their impacts for the asked terms, as a list per term from the greatest impact down."""

    def __init__(self, sizes: np.ndarray, terms: np.ndarray, impacts: np.ndarray):
        doc = np.repeat(np.arange(len(sizes)), sizes)
        by = np.lexsort((-impacts, terms))
        self.doc, self.impact, terms = doc[by], impacts[by], terms[by]
        self.documents = len(sizes)
        self.terms, self.begin = np.unique(terms, return_index=True)
        self.end = np.append(self.begin[1:], len(terms))

    def best(self, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and exact scores of the ``k`` best with a score above 0, ties by the smaller number."""
        at = np.searchsorted(self.terms, terms)
        held = at < len(self.terms)
        held[held] = self.terms[at[held]] == terms[held]
        weights = weights[held]
        here, end = self.begin[at[held]].copy(), self.end[at[held]]
        lower = np.zeros(self.documents, np.int64)
        seen = np.zeros((len(weights), self.documents), bool)
        step = FIRST_STEP
        while True:
            for t in range(len(weights)):
                to = min(here[t] + step, end[t])
                docs = self.doc[here[t] : to]
                lower[docs] += weights[t] * self.impact[here[t] : to]
                seen[t, docs] = True
                here[t] = to
            step *= 2
            # what a list may still add at most
            left = np.flatnonzero(here < end)
            head = weights[left] * self.impact[here[left]]
            rest = int(head.sum())
            least = 0
            if self.documents > k:
                least = int(np.partition(lower, self.documents - k)[self.documents - k])
            near = np.flatnonzero(lower + rest >= max(least, 1))
            if rest:
                # only documents that can still reach the last of the best are looked at more closely
                near = near[lower[near] > 0]
                upper = lower[near].copy()
                for t, h in zip(left, head):
                    upper[~seen[t, near]] += h
                able = upper >= least
                settled = least > rest and bool((upper[able] == lower[near[able]]).all())
                if not settled:
                    continue
                near = near[able]
            near = near[lower[near] > 0]
            first = near[np.lexsort((near, -lower[near]))[:k]]
            return first, lower[first]


def search(docs: DataFrame, items: DataFrame, k: int = BEST, block_bytes: int = BLOCK_BYTES, shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """The ``k`` best documents of each item: item_id, rank, doc_id, score.

    ``docs`` has doc_id and text, ``items`` item_id and text.
    """
    small_batches(docs)
    items = stage(items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct(), "items")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = total // block_bytes + 1
    found = None
    for block in range(blocks):
        own = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block) if blocks > 1 else items
        part = _search_block(docs, [(r.item_id, Counter(terms_of(r.text))) for r in own.toLocalIterator()], k, shard_postings).withColumn("block", F.lit(block))
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("item_id", "item", "block").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _search_block(docs: DataFrame, asked: list[tuple[int | None, Counter]], k: int, shard_postings: int) -> DataFrame:
    asked = sorted(((i, c) for i, c in asked if c), key=lambda x: (x[0] is None, x[0] or 0, sorted(x[1].items())))
    number = {w: i for i, w in enumerate(sorted({w for _, c in asked for w in c}))}
    counts = stage(_counts(docs, number), "term_counts")
    total = counts.agg(F.count("*").alias("n"), F.sum("n").alias("terms")).first()
    holding = dict(counts.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator())
    n_docs, n_terms = total["n"], total["terms"] or 0
    weight = {w: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holding.get(i, 0) + 1))) for w, i in number.items()}
    # a term without weight adds nothing
    lists = [
        (i, np.array([number[w] for w in c if weight[w]], np.int32), np.array([weight[w] * m for w, m in c.items() if weight[w]], np.int64)) for i, c in asked
    ]
    longest = max([len(t) for _, t, _ in lists], default=1)
    most_docs = max(1, SHARD_SEEN // max(longest, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[pa.Array] = []
        parts: list[tuple[np.ndarray, ...]] = []
        docs = postings = 0

        def answer() -> pa.RecordBatch:
            doc_id = pa.concat_arrays(ids)
            # ties by number are ties by doc_id, NULL last
            order = np.asarray(pc.sort_indices(doc_id, null_placement="at_end"))
            n, size, terms, times = (np.concatenate(x) for x in zip(*parts))
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            m = 25 + 75 * n * n_docs // n_terms
            of = np.repeat(np.arange(len(n)), size)
            impact = 1_000_000_000 * times // (1000 * times + 8 * m[of])
            by = np.argsort(place[of], kind="stable")
            shard = Shard(size[order], terms[by], impact[by])
            rows = []
            for item, (item_id, own, weights) in enumerate(lists):
                first, score = shard.best(own, weights, k)
                rows.append((np.full(len(first), item), [item_id] * len(first), order[first], score))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([r[0] for r in rows]), pa.int32()), pa.array([i for r in rows for i in r[1]], pa.int64()),
                    doc_id.take(pa.array(np.concatenate([r[2] for r in rows]))), pa.array(np.concatenate([r[3] for r in rows]), pa.int64()),
                ],
                names=["item", "item_id", "doc_id", "score"],
            )

        if not lists:
            return
        for b in batches:
            lo = 0
            sizes = np.diff(b.column("terms").offsets.to_numpy())
            while lo < len(sizes):
                # as many rows as the shard still takes
                room = int(np.searchsorted(np.cumsum(sizes[lo:]), shard_postings - postings, "right"))
                hi = min(len(sizes), lo + max(min(room, most_docs - docs), 0))
                if hi > lo or not docs:
                    hi = max(hi, lo + 1)
                    part = b.slice(lo, hi - lo)
                    ids.append(part.column("doc_id"))
                    own = [part.column(c).flatten().to_numpy().astype(np.int64) for c in ("terms", "times")]
                    parts.append((part.column("n").to_numpy(), sizes[lo:hi], *own))
                    docs, postings, lo = docs + hi - lo, postings + len(own[0]), hi
                if lo < len(sizes):
                    yield answer()
                    ids, parts = [], []
                    docs = postings = 0
        if docs:
            yield answer()

    return counts.mapInArrow(run, "item int, item_id long, doc_id long, score long")
