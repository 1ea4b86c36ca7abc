"""Document fingerprints (operator 2): context-triggered piecewise hashes, compared by edit distance.

A rolling hash of 7 bytes marks the ends of chunks: at block size 3 * 2^k a position ends a chunk when the hash leaves
the remainder -1. A document takes the least k that gives at most 64 chunks; each chunk, by a hash of its bytes, becomes
one of 64 signs. The fingerprint is ``k:signs:signs at k+1``. Two fingerprints are compared where their block sizes
meet, or are one step apart; the likeness is 1 - edit distance / length of the longer signs, and 0 where no block size
is shared. Whole texts are read; equal texts have equal fingerprints.

Neighbours: documents run by descending ``doc_id`` (NULL last, ties by a hash of the text), cut into slots at
approximate quantiles; the first row of each slot is also sent to the slot before it, so one shuffle brings every
document together with the next. Within a slot rows stream in order, so memory does not grow with it.

Defined cases: NULL text is empty; an empty text has fingerprint ``0::`` and likeness 1 with another empty one, 0 with
others; a single document follows itself; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridership.llm.common import small_batches
from ridership.llm.text import slices, spans_hash

WINDOW = 7
MOST = 64
SIGNS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
_TAPS = [pow(0x01000193, i, 1 << 32) for i in range(WINDOW)]
SLOT_BYTES = 32 << 20
MOST_SLOTS = 10_000  # parallelism only: a slot streams


def _triggers(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions that end a chunk at the smallest block size, and the largest k at which they still do."""
    x = (data.astype(np.uint32) + np.uint32(1)) * np.uint32(0x9E3779B1)
    r = x.copy()
    for i in range(1, WINDOW):
        r[i:] += x[:-i] * np.uint32(_TAPS[i])
    begin, size = off[:-1], np.diff(off)
    for t in range(WINDOW - 1):  # the first bytes of a row see only their own row
        at = begin[size > t] + t
        own = np.zeros(len(at), np.uint32)
        for i in range(t + 1):
            own += x[at - i] * np.uint32(_TAPS[i])
        r[at] = own
    r ^= r >> np.uint32(15)
    r *= np.uint32(0x2C1B3C6D)
    r ^= r >> np.uint32(12)
    r += np.uint32(1)
    at = np.flatnonzero(r % np.uint32(3) == 0)
    low = r[at] & (~r[at] + np.uint32(1))
    level = np.where(low == 0, 31, np.log2(np.maximum(low, 1))).astype(np.int64)
    return at, level


def _signs(data: np.ndarray, off: np.ndarray, at: np.ndarray, row: np.ndarray, level: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signs of each row at its block size: a matrix padded with 0, and the lengths."""
    rows = len(off) - 1
    keep = level >= k[row]
    cut, owner = at[keep] + 1, row[keep]
    ends, owners = np.concatenate([cut, off[1:][np.diff(off) > 0]]), np.concatenate([owner, np.flatnonzero(np.diff(off) > 0)])
    order = np.lexsort((ends, owners))
    ends, owners = ends[order], owners[order]
    new = np.ones(len(ends), bool)  # a cut at the very end is the end
    new[1:] = (ends[1:] != ends[:-1]) | (owners[1:] != owners[:-1])
    ends, owners = ends[new], owners[new]
    count = np.bincount(owners, minlength=rows)
    starts = np.empty_like(ends)
    starts[1:] = ends[:-1]
    first = np.cumsum(count) - count
    starts[first[count > 0]] = off[:-1][count > 0]
    sign = (spans_hash(data, starts, ends) >> np.uint64(58)).astype(np.int64)
    out = np.zeros((rows, MOST), np.uint8)
    out[owners, np.arange(len(owners)) - first[owners]] = SIGNS[sign]
    return out, count


class Prints:
    """Fingerprints of a batch of texts, also in the form the comparison needs."""

    def __init__(self, texts: pa.Array):
        parts = [self._slice(data, off) for _, data, off in slices(texts)]
        empty = (np.zeros(0, np.int64), np.zeros((0, MOST), np.uint8), np.zeros(0, np.int64))
        self.k = np.concatenate([p[0] for p in parts] or [empty[0]])
        self.signs = [np.concatenate([p[i] for p in parts] or [empty[1]]) for i in (1, 3)]
        self.sizes = [np.concatenate([p[i] for p in parts] or [empty[2]]) for i in (2, 4)]

    @staticmethod
    def _slice(data: np.ndarray, off: np.ndarray) -> tuple:
        rows = len(off) - 1
        at, level = _triggers(data, off)
        row = np.searchsorted(off, at, "right") - 1
        above = np.bincount(row * 32 + level, minlength=rows * 32).reshape(rows, 32)[:, ::-1].cumsum(1)[:, ::-1]
        k = np.argmax(above < MOST, axis=1)
        return k, *_signs(data, off, at, row, level, k), *_signs(data, off, at, row, level, k + 1)

    def strings(self) -> list[str]:
        text = [[bytes(m[i, :n]).decode() for i, n in enumerate(s)] for m, s in zip(self.signs, self.sizes)]
        return [f"{k}:{a}:{b}" for k, a, b in zip(self.k.tolist(), *text)]

    def take(self, rows: np.ndarray) -> Prints:
        out = object.__new__(Prints)
        out.k, out.signs, out.sizes = self.k[rows], [m[rows] for m in self.signs], [s[rows] for s in self.sizes]
        return out


def edit_distance(a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Levenshtein distance of each pair of padded rows, all pairs of a block at once."""
    rows, width = a.shape
    out = np.where(n == 0, m, 0).astype(np.int64)
    ramp = np.arange(width + 1, dtype=np.int16)
    prev = np.broadcast_to(ramp, (rows, width + 1)).copy()
    for i in range(1, int(n.max(initial=0)) + 1):
        cur = np.empty_like(prev)
        cur[:, 0] = i
        np.minimum(prev[:, 1:] + 1, prev[:, :-1] + (b != a[:, i - 1 : i]), out=cur[:, 1:])
        prev = np.minimum.accumulate(cur - ramp, axis=1) + ramp
        done = np.flatnonzero(n == i)
        out[done] = prev[done, m[done]]
    return out


def likeness(p: Prints, q: Prints, block: int = 2000) -> np.ndarray:
    """Likeness 0..1 of the fingerprints row by row."""
    out = np.zeros(len(p.k))
    for begin in range(0, len(p.k), block):
        rows = np.arange(begin, min(begin + block, len(p.k)))
        step = q.k[rows] - p.k[rows]
        use = np.abs(step) <= 1
        rows, step = rows[use], step[use]
        # the one with the smaller block size shows its second signs
        a = np.where((step == 1)[:, None], p.signs[1][rows], p.signs[0][rows])
        n = np.where(step == 1, p.sizes[1][rows], p.sizes[0][rows])
        b = np.where((step == -1)[:, None], q.signs[1][rows], q.signs[0][rows])
        m = np.where(step == -1, q.sizes[1][rows], q.sizes[0][rows])
        most = np.maximum(n, m)
        out[rows] = np.where(most > 0, 1 - edit_distance(a, n, b, m) / np.maximum(most, 1), 1.0)
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of each document, without any shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(Prints(b.column("text")).strings(), pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


def _next_to_each(docs: DataFrame, slot_bytes: int) -> DataFrame:
    """(slot, copy, doc_id, text) in order within each slot; the last row of a slot is followed by copies of the next."""
    small_batches(docs)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).withColumn("_at", F.coalesce("doc_id", F.lit(-(2**63))))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slots = min(MOST_SLOTS, size // slot_bytes + 1)
    shares = [i / slots for i in range(1, slots)]
    cuts = sorted(set(rows.agg(F.percentile_approx("_at", shares, 10 * slots)).first()[0] or [])) if shares else []
    # slot 0 has the highest ids
    above = F.lit(0)
    if cuts:
        edges = F.array(*[F.lit(c) for c in cuts])
        above = F.size(F.filter(edges, lambda c: c > F.col("_at")))
    rows = rows.withColumn("_slot", above.cast("int")).withColumn("_tie", F.xxhash64("text"))
    heads = rows.groupBy("_slot").agg(F.max(F.struct("_at", "_tie")).alias("_head")).collect()  # one per slot
    order = sorted(heads, key=lambda r: r["_slot"])
    spark = docs.sparkSession
    if order:
        to = [(order[i - 1]["_slot"], *order[i]["_head"]) for i in range(len(order))]
        text = ", ".join(f"({s}, {a if a > -(2**63) else '-9223372036854775807 - 1'}L, {t if t > -(2**63) else '-9223372036854775807 - 1'}L)" for s, a, t in to)
        heads = spark.sql(f"SELECT * FROM VALUES {text.replace(' - 1L', 'L - 1L')} AS t(_to, _ha, _ht)")
        rows = rows.join(F.broadcast(heads), (F.col("_at") == F.col("_ha")) & (F.col("_tie") == F.col("_ht")), "left")
        rows = rows.select("doc_id", "text", "_at", "_tie", F.explode(F.expr("IF(_to IS NULL, array(struct(_slot AS s, 0 AS c)), array(struct(_slot AS s, 0 AS c), struct(_to AS s, 1 AS c)))")).alias("_d"))
        rows = rows.select("doc_id", "text", "_at", "_tie", F.col("_d.s").alias("_slot"), F.col("_d.c").alias("_copy"))
    else:
        rows = rows.withColumn("_copy", F.lit(0))
    return rows.repartition(slots, "_slot").sortWithinPartitions("_slot", "_copy", F.desc("_at"), F.desc("_tie"))


def compare_neighbours(docs: DataFrame, slot_bytes: int = SLOT_BYTES) -> DataFrame:
    """Each document with its edited text (its second half replaced by the beginning of the next document).

    Columns: doc_id, n_chars, edited (the text), fingerprint, edited_fingerprint, near_edited, near_next.
    """

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list, list]]:
        """Runs of rows of one slot: ids, texts, and 1 where the row is only the next of the one before."""
        ids: list = []
        texts: list[str] = []
        only: list[bool] = []
        slot = None
        size = 0
        for b in batches:
            for s, c, i, t in zip(*[b.column(n).to_pylist() for n in ("_slot", "_copy", "doc_id", "text")]):
                if s != slot and ids:
                    yield ids, texts, only
                    ids, texts, only, size = [], [], [], 0
                elif size > 1_000_000:
                    ids.append(i), texts.append(t), only.append(True)
                    yield ids, texts, only
                    ids, texts, only, size = [], [], [], 0
                slot = s
                ids.append(i), texts.append(t), only.append(bool(c))
                size += len(t)
        if ids:
            yield ids, texts, only

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, only in pairs(batches):
            own = np.flatnonzero(~np.array(only))
            if not len(own):
                continue
            edited = []
            for i in own.tolist():
                half = len(texts[i]) // 2
                edited.append(texts[i][: len(texts[i]) - half] + texts[i + 1][:half])
            p, e = Prints(pa.array(texts, pa.string())), Prints(pa.array(edited, pa.string()))
            mine = p.take(own)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([ids[i] for i in own.tolist()], pa.int64()),
                    pa.array([len(texts[i]) for i in own.tolist()], pa.int64()),
                    pa.array(edited, pa.string()),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited]),
                    pa.array(mine.strings(), pa.string()),
                    pa.array(e.strings(), pa.string()),
                    pa.array(likeness(mine, e)),
                    pa.array(likeness(mine, p.take(own + 1))),
                ],
                names=["doc_id", "n_chars", "edited", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    schema = "doc_id long, n_chars long, edited string, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return _next_to_each(docs, slot_bytes).select("_slot", "_copy", "doc_id", "text").mapInArrow(run, schema)
