"""Token counts (operator 4): greedy longest-match word pieces counted by a linear automaton.

The vocabulary is a trie with failure links. A node's link leads to where matching goes on once the longest piece found
so far is cut off, and its count says how many pieces that cuts off; so a word costs one step per byte, and pieces are
never built. Words are runs of bytes other than space, \\t, \\n, \\v, \\f, \\r. A word that cannot be split into pieces
counts as one unknown token. Each task keeps the counts of words it has met in a table of bounded size.

Defined cases: a NULL or empty text has 0 words and tokens; repeated rows are counted each; a NULL ``doc_id`` is kept;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CACHED_WORDS = 1_000_000


class PieceCounter:
    """Number of greedy longest-match pieces of a word, 0 where there is no split.

    ``initial`` pieces begin a word, ``inner`` pieces continue it.
    """

    def __init__(self, initial: Iterable[bytes], inner: Iterable[bytes]):
        self.child: list[dict[int, int]] = [{}, {}]
        ends = [False, False]
        for root, pieces in ((0, initial), (1, inner)):
            for piece in pieces:
                node = root
                for c in piece:
                    if c not in self.child[node]:
                        self.child[node][c] = len(self.child)
                        self.child.append({})
                        ends.append(False)
                    node = self.child[node][c]
                if node > 1:
                    ends[node] = True
        self.fail: list[int] = [-1] * len(self.child)
        self.popped = [0] * len(self.child)
        queue = deque([0, 1])
        while queue:
            parent = queue.popleft()
            for c, node in self.child[parent].items():
                if ends[node]:
                    self.fail[node], self.popped[node] = 1, 1
                else:
                    z, n = self.fail[parent], self.popped[parent]
                    while z >= 0 and c not in self.child[z]:
                        n += self.popped[z]
                        z = self.fail[z]
                    if z >= 0:
                        self.fail[node], self.popped[node] = self.child[z][c], n
                queue.append(node)

    def count(self, word: bytes) -> int:
        child, fail, popped = self.child, self.fail, self.popped
        node = n = 0
        for c in word:
            while c not in child[node]:
                if fail[node] < 0:
                    return 0
                n += popped[node]
                node = fail[node]
            node = child[node][c]
        while node > 1:
            if fail[node] < 0:
                return 0
            n += popped[node]
            node = fail[node]
        return n


def pieces_of(path: str) -> tuple[list[bytes], list[bytes]]:
    """Word pieces from a file of base64 tokens: those that begin with a space begin a word, the others continue it."""
    with open(path, "rb") as f:
        tokens = [base64.b64decode(line.split()[0]) for line in f if line.strip()]
    return [t for t in tokens if t[:1] == b" "], [t for t in tokens if t[:1] != b" "]


def token_counts(docs: DataFrame, path: str, lead: bytes = b" ") -> DataFrame:
    """doc_id, n_words, n_tokens, n_unknown of each whole text; ``lead`` goes before each word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceCounter(*pieces_of(path))
        known: dict[bytes, int] = {}
        for b in batches:
            out: list[list[int]] = [[], [], []]
            for text in b.column("text").cast(pa.binary()).to_pylist():
                words = (text or b"").split()
                if len(known) > CACHED_WORDS:
                    known.clear()
                for w in words:
                    if w not in known:
                        known[w] = counter.count(lead + w)
                counts = [known[w] for w in words]
                unknown = counts.count(0)
                for col, v in zip(out, (len(words), sum(counts) + unknown, unknown)):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(c, pa.int64()) for c in out]], names=["doc_id", "n_words", "n_tokens", "n_unknown"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_words long, n_tokens long, n_unknown long")
