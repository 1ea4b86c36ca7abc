"""Best-fit packing (operator 1): documents as pieces of tokens, pieces into sequences of bounded length.

Best-fit decreasing places pieces from long to short, each into the open sequence with the least room that still takes
it. Only lengths decide, and there are at most ``max_tokens`` of them, so the placement runs on the counts by length: a
segment tree over the remaining capacities finds the tightest open capacity in logarithmic time, and pieces of one
length that meet equal sequences are placed as a run. The result is that of placing piece by piece. What the driver
holds is bounded by ``max_tokens`` whatever the number of documents. Each piece then learns its sequence from its rank
among the pieces of its length; ranks are counted in hashed buckets, so a length that most pieces share is spread.

Defined cases: a document of at most ``max_tokens`` is one piece; of the pieces of a longer one only the last, or with
``short_first`` the first, may be shorter; a NULL text is empty; an empty text is the separator alone; repeated rows are packed each; a NULL
``doc_id`` is kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import os
import string
import zlib
from array import array
from collections import deque
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridership.session import stage

MAX_TOKENS = 2048
SEPARATOR = 0
# white space other than the space and the line break
_OTHER_SPACES = [chr(c) for c in (9, 11, 12, 13, *range(28, 32), 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288)]
_DOUBLES = ("  ", " \n", "\n ", "\n\n")
CACHED_WORDS = 800_000


def _odd(text: str) -> bool:
    """Whether white space is more than single spaces and line breaks between solid characters."""
    return text[0] in " \n" or text[-1] in " \n" or any(d in text for d in _DOUBLES) or any(c in text for c in _OTHER_SPACES)


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: printable bytes as they are, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class WordIds:
    """Token ids of texts as little-endian unsigned 32-bit bytes, by a byte-level tokenizer and a bounded cache of words.

    A byte-level tokenizer begins a new word at a space between two solid characters, and a line break between two is a
    word of its own. So the ids of a text are those of its words, which are kept; texts with other white space go through
    the tokenizer whole. A word of letters is given to the tokenizer's model at once, as it is not cut further, and so
    are signs that follow it.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        # words at the beginning of a line, and after a space; each in two generations of bounded size
        self.caches: dict[str, tuple[dict[str, bytes], dict[str, bytes]]] = {"": ({}, {}), " ": ({}, {})}
        self.signs: dict[str, bytes] = {}
        self.line = self._whole(["\n"])[0]

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _uncut(self, word: str, lead: str = "") -> bytes:
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(self.letters[32] + word if lead else word)]).tobytes()

    def _learn(self, cache: dict[str, bytes], words: set[str], lead: str) -> None:
        other = []
        for w in words:
            stem = w.rstrip(string.punctuation)
            if not stem.isalpha():
                other.append(w)
                continue
            ids = cache.get(stem)
            if ids is None:
                ids = cache[stem] = self._uncut(stem, lead)
            if len(stem) < len(w):
                signs = w[len(stem) :]
                if signs not in self.signs:
                    if len(self.signs) > CACHED_WORDS:
                        self.signs.clear()
                    self.signs[signs] = self._uncut(signs)
                cache[w] = ids + self.signs[signs]
        for w, ids in zip(other, self._whole([lead + w for w in other])):
            cache[w] = ids

    def _words(self, words: list[str], lead: str) -> list[bytes]:
        young, old = self.caches[lead]
        if len(young) > CACHED_WORDS:
            young, old = self.caches[lead] = ({}, young)
        got = list(map(young.get, words))
        if None in got:
            missed = [i for i, ids in enumerate(got) if ids is None]
            new = set()
            for w in {words[i] for i in missed}:
                ids = old.get(w)
                if ids is None:
                    new.add(w)
                else:
                    young[w] = ids
            self._learn(young, new, lead)
            for i in missed:
                got[i] = young[words[i]]
        return got

    def encode(self, texts: list[str]) -> list[bytes]:
        odd = [bool(t) and _odd(t) for t in texts]
        lines = [[line.split(" ") for line in t.split("\n")] for t, o in zip(texts, odd) if t and not o]
        first = iter(self._words([w[0] for t in lines for w in t], ""))
        later = self._words([x for t in lines for w in t for x in w[1:]], " ")
        done, at = [], 0
        for t in lines:
            parts = []
            for w in t:
                end = at + len(w) - 1
                parts.append(next(first) + b"".join(later[at:end]))
                at = end
            done.append(self.line.join(parts))
        plain, whole = iter(done), iter(self._whole([t for t, o in zip(texts, odd) if o]))
        return [(next(whole) if o else next(plain)) if t else b"" for t, o in zip(texts, odd)]


def cuts(n: int, max_tokens: int, short_first: bool) -> list[int]:
    """Where the pieces of ``n`` ids start, and ``n``; only the last piece, or with ``short_first`` the first, may be short."""
    first = n % max_tokens if short_first else 0
    return [*([0] if first else []), *range(first, n, max_tokens), n]


def token_pieces(
    docs: DataFrame, tokenizer: str, max_tokens: int = MAX_TOKENS, separator: int = SEPARATOR, with_ids: bool = False, short_first: bool = False
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 and, if wanted, the ids."""
    end = np.array([separator], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                out: list[list] = [[], [], [], [], [], []]
                coded = words.encode([t or "" for t in part.column("text").to_pylist()])
                for doc, ids in zip(part.column("doc_id").to_pylist(), coded):
                    ids = ids + end
                    for piece, (begin, stop) in enumerate(pairwise(cuts(len(ids) // 4, max_tokens, short_first))):
                        own = ids[4 * begin : 4 * stop]
                        for col, v in zip(out, (doc, piece, begin, stop - begin, zlib.crc32(own), own)):
                            col.append(v)
                cols = [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), *[pa.array(c, pa.int64()) for c in out[2:5]]]
                if with_ids:
                    flat = np.frombuffer(b"".join(out[5]), "<u4").astype(np.int32)
                    off = np.concatenate([[0], np.cumsum(out[3])]).astype(np.int32)
                    cols.append(pa.ListArray.from_arrays(pa.array(off), pa.array(flat)))
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(cols)])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


class Capacities:
    """Segment tree over remaining capacities 0..size: the least capacity >= x that some open sequence has."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.open = [0] * (2 * self.leaves)
        self.runs: dict[int, deque[tuple[int, int]]] = {}

    def add(self, capacity: int, first: int, count: int) -> None:
        if capacity <= 0 or not count:
            return
        self.runs.setdefault(capacity, deque()).append((first, count))
        self._count(capacity, count)

    def take(self, capacity: int, most: int) -> tuple[int, int]:
        """Up to ``most`` sequences of a capacity: first id and count."""
        first, count = self.runs[capacity].popleft()
        if count > most:
            self.runs[capacity].appendleft((first + most, count - most))
            count = most
        self._count(capacity, -count)
        return first, count

    def _count(self, capacity: int, by: int) -> None:
        node = self.leaves + capacity
        while node:
            self.open[node] += by
            node >>= 1

    def tightest(self, least: int) -> int | None:
        node = self.leaves + least
        if self.open[node]:
            return least
        while node > 1:
            if not node & 1 and self.open[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.open[2 * node] else 2 * node + 1
                return node - self.leaves
            node >>= 1
        return None


def best_fit_runs(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing on counts by length: runs (length, first rank, pieces per sequence, first sequence, offset).

    The pieces of a run go to sequences of one capacity, as many to each as it takes.
    """
    state, runs, opened = Capacities(size), [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = state.tightest(length)
            if room is None:
                room, per = size, size // length
                need = -(-left // per)
                first, got = opened, need
                opened += need
            else:
                per = room // length
                first, got = state.take(room, -(-left // per))
            placed = min(left, got * per)
            full, rest = divmod(placed, per)
            runs.append((length, rank, per, first, size - room))
            state.add(room - per * length, first, full)
            if rest:
                state.add(room - rest * length, first + full, 1)
            left -= placed
            rank += placed
    return runs


def pack_pieces(pieces: DataFrame, max_tokens: int = MAX_TOKENS, bucket_rows: int = 200_000) -> DataFrame:
    """Add sequence_id and offset to stored pieces (doc_id, piece, start, length, ids_crc32)."""
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most max_tokens rows
    runs = best_fit_runs(counts, max_tokens)
    table = np.array(runs or [(0, 0, 1, 0, 0)], np.int64)
    keys = table[:, 0] << 48 | table[:, 1]
    order = np.argsort(keys)
    keys, table = keys[order], table[order]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("_rank").to_numpy()
            run = np.searchsorted(keys, length << 48 | rank, "right") - 1
            _, first, per, seq, at = table[run].T
            i = rank - first
            b = b.drop_columns(["_rank"])
            b = b.append_column("sequence_id", pa.array(seq + i // per))
            yield b.append_column("offset", pa.array(at + i % per * length))

    buckets = max(64, sum(counts.values()) // bucket_rows)
    rows = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("length", "_bucket").count().select("length", "_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("length", "_bucket").orderBy("doc_id", "start", "ids_crc32")
    ranked = (
        rows.withColumn("_n", F.row_number().over(within))
        .join(starts, ["length", "_bucket"])
        .select(*pieces.columns, (F.col("_before") + F.col("_n") - 1).cast("long").alias("_rank"))
    )
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return ranked.mapInArrow(place, f"{schema}, sequence_id long, offset long")


def pack_documents(
    docs: DataFrame, tokenizer: str, max_tokens: int = MAX_TOKENS, separator: int = SEPARATOR, with_ids: bool = False, short_first: bool = False
) -> DataFrame:
    """Cut documents (doc_id, text) into pieces and pack them: one row per piece with its sequence and offset."""
    return pack_pieces(stage(token_pieces(docs, tokenizer, max_tokens, separator, with_ids, short_first), "pieces"), max_tokens)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves, from pieces packed ``with_ids``: sequence_id, ids (at most max_tokens)."""
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return parts.select("sequence_id", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"))
