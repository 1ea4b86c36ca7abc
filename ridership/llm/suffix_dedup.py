"""Suffix-array dedup (operator 10): remove bytes covered by a string of 50 bytes that starts in an earlier document.

Every string of ``span`` bytes holds an anchor: a run of ``GRAM`` bytes whose hash is the least of the string. The rule
sees the string alone, so equal strings have equal anchors, and text without an anchor that another text shares cannot
hold a repeated string.

1. Anchors of all texts travel packed by hash; those met in two different texts come back as positions of their texts.
2. The bytes around each shared anchor that strings with it can reach are its context. Equal contexts within a task
   leave the earliest document; the others' bytes are removed at once, which also keeps a passage that very many
   documents share small. The rest goes to shards by the anchor's bytes.
3. A shard drops equal contexts again, in the same way, and those that agree with no other one in enough bytes around
   the anchor to have a string in common. It builds suffix arrays of the remaining ones by Larsson-Sadakane refinement (8, 16, 32, 64 bytes; only unresolved groups are sorted again). Common prefixes with the
   predecessor follow Kasai, a position of all contexts at a time. Runs of common prefixes of ``span`` bytes or more are
   equal strings; all but the earliest document's are removed. A shard above ``SHARD_BYTES`` becomes several arrays;
   their strings whose hash two of them have are merged into one sorted list, in which each array looks up its own by binary
   search, so the work grows with the strings and not with the square of the arrays.

Equal texts are one text: its earliest document is treated as above, the others lose everything. Whole texts are only
moved where they have a shared anchor; a bitmap of fixed size keeps others out of that shuffle.

Defined cases: NULL text is empty; texts under ``span`` bytes lose nothing; a NULL ``doc_id`` comes after all others,
and documents of equal id or NULL id do not remove each other's bytes; repeated rows get the same result; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridership.llm.common import maybe_in, small_batches
from ridership.llm.text import U64, mix, powers, ranges, slices
from ridership.session import stage

SPAN = 50
GRAM = 20
LEFT = SPAN - GRAM
WIDTH = LEFT + SPAN
PART_ROWS = 1_000_000
SHARD_BYTES = 2 << 20
STEP = 5  # bytes between the lengths at which contexts are compared
LAST = 2**63 - 1
_BITS = U64(48)


def _row_hash(rows: np.ndarray) -> np.ndarray:
    """64-bit hash of each row of bytes."""
    padded = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    padded[:, : rows.shape[1]] = rows
    out = np.zeros(len(rows), U64)
    for word in padded.view("<u8").T:
        out = mix(out * U64(0x9E3779B97F4A7C15) + word)
    return out


def _planes(*columns: np.ndarray) -> bytes:
    """Columns side by side, byte plane by byte plane, compressed."""
    raw = [np.frombuffer(c.tobytes(), np.uint8).reshape(len(c), -1).T.tobytes() for c in columns]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(raw))


def _read(blob: bytes, shapes: list[tuple[int, str]]) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    for rows, kind in shapes:
        size = rows * np.dtype(kind).itemsize
        plane = np.frombuffer(raw, np.uint8, size, at).reshape(-1, rows) if rows else np.zeros((0, 0), np.uint8)
        out.append(np.frombuffer(plane.T.tobytes(), kind))
        at += size
    return out


def _slide(x: np.ndarray, n: int, best: np.ufunc) -> np.ndarray:
    """best of x[i : i + n] for each i that has n values."""
    width = 1
    while 2 * width <= n:
        x = best(x[:-width], x[width:])
        width *= 2
    return best(x[: len(x) - (n - width)], x[n - width :]) if n > width else x


def anchors(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash (48 bits), row and place in the row of the anchors of each row."""
    none = np.zeros(0, np.int64)
    if len(data) < SPAN:
        return none.astype(U64), none, none
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * up[: len(data)], out=sums[1:])
    h = mix((sums[GRAM:] - sums[:-GRAM]) * down[: len(sums) - GRAM]) >> (U64(64) - _BITS)
    # strings that cross rows do not count
    least = _slide(h, LEFT + 1, np.minimum)
    crosses = np.zeros(len(least) + 1, np.int32)
    edges = off[1:-1]
    lo, hi = np.clip(edges - SPAN + 1, 0, len(least)), np.clip(edges, 0, len(least))
    np.add.at(crosses, lo, 1)
    np.add.at(crosses, hi, -1)
    inside = np.cumsum(crosses[:-1]) == 0
    least = np.where(inside, least + U64(1), U64(0))  # 0: no string here
    pad = np.zeros(LEFT, U64)
    most = _slide(np.concatenate([pad, least, pad]), LEFT + 1, np.maximum)
    at = np.flatnonzero(h + U64(1) == most)
    row = np.searchsorted(off, at, "right") - 1
    # the least of many hashes are small numbers; mixed again they spread over the parts
    return mix(h[at]) >> (U64(64) - _BITS), row, at - off[row]


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("at"),
        F.xxhash64(text).alias("text_key"),
        F.octet_length(text).cast("long").alias("n_bytes"),
        text.alias("text"),
    )


POSTING = ("<u8", "<u4", "<u4")  # hash, row of the text table, place


def _posted(rows: DataFrame, parts: int, flush: int = 1_000_000) -> DataFrame:
    """Packed anchors of the distinct texts of each task: part, rows, texts, blob."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[tuple] = []
        base = waiting = 0

        def emit() -> Iterator[pa.RecordBatch]:
            h, row, place = (np.concatenate([x[i] for x in held]) for i in range(3))
            keys = np.concatenate([x[3] for x in held])
            by = np.argsort(h)
            h, row, place = h[by], row[by], place[by]
            part = ((h >> U64(24)) * U64(parts) >> U64(24)).astype(np.int32)
            cut = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
            out: list[list] = [[], [], [], []]
            for lo, hi in zip(cut[:-1], cut[1:]):
                own, local = np.unique(row[lo:hi], return_inverse=True)
                blob = _planes(h[lo:hi], local.astype("<u4"), place[lo:hi].astype("<u4"), keys[own])
                for c, v in zip(out, (int(part[lo]), hi - lo, len(own), blob)):
                    c.append(v)
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(c, pa.int32()) for c in out[:3]], pa.array(out[3], pa.binary())], names=["part", "rows", "texts", "blob"]
            )

        for b in batches:
            all_keys = b.column("text_key").to_numpy()
            for first, data, off in slices(b.column("text")):
                keys = all_keys[first : first + len(off) - 1]
                h, row, place = anchors(data, off)
                fresh = np.array([k not in seen and not seen.add(k) for k in keys.tolist()], bool)
                use = fresh[row]
                held.append((h[use], row[use] + base, place[use], keys))
                base += len(keys)
                waiting += int(use.sum())
                if waiting >= flush:
                    yield from emit()
                    held, base, waiting = [], 0, 0
        if waiting:
            yield from emit()

    return rows.mapInArrow(run, "part int, rows int, texts int, blob binary")


def _dealt(keys: list, blobs: list[bytes], parts: int) -> pa.Table:
    """Blobs of texts packed by part of the texts, so that a part of anchors sends a row to each of them at most."""
    keys = np.array(keys, np.int64)
    part = keys % parts
    by = np.argsort(part, kind="stable")
    cut = np.flatnonzero(np.concatenate([[True], part[by[1:]] != part[by[:-1]], [True]])) if len(keys) else np.zeros(1, np.int64)
    out: list[list] = [[], [], []]
    for lo, hi in zip(cut[:-1], cut[1:]):
        own = [blobs[i] for i in by[lo:hi]]
        sizes = np.array([len(x) for x in own], "<i8")
        packed = keys[by[lo:hi]].astype("<i8").tobytes() + sizes.tobytes() + b"".join(own)
        for c, v in zip(out, (int(part[by[lo]]), hi - lo, zstandard.compress(packed, 1))):
            c.append(v)
    return pa.table({"part": pa.array(out[0], pa.int32()), "texts": pa.array(out[1], pa.int32()), "blob": pa.array(out[2], pa.binary())})


def _gathered(table: pa.Table) -> pa.Table:
    """The blobs of each text of a part, one after the other: text_key, blob."""
    found: dict[int, list[bytes]] = {}
    for texts, blob in zip(*[table.column(c).to_pylist() for c in ("texts", "blob")]):
        raw = zstandard.decompress(blob)
        keys, sizes = np.frombuffer(raw, "<i8", 2 * texts).reshape(2, texts)
        at = 16 * texts
        for key, size in zip(keys.tolist(), sizes.tolist()):
            found.setdefault(key, []).append(raw[at : at + size])
            at += size
    return pa.table({"text_key": pa.array(list(found), pa.int64()), "blob": pa.array([b"".join(x) for x in found.values()], pa.binary())})


def _gather(dealt: DataFrame) -> DataFrame:
    return dealt.groupBy("part").applyInArrow(_gathered, "text_key long, blob binary")


DEALT = "part int, texts int, blob binary"


def _shared(parts: int, table: pa.Table) -> pa.Table:
    """Positions, text by text, of the anchors of a part that are in two or more texts."""
    got = []
    for rows, texts, blob in zip(*[table.column(c).to_pylist() for c in ("rows", "texts", "blob")]):
        h, local, place, keys = _read(blob, [*[(rows, k) for k in POSTING], (texts, "<i8")])
        got.append((h, keys[local], place))
    h, key, place = (np.concatenate([g[i] for g in got]) for i in range(3))
    by = np.argsort(h)
    h, key, place = h[by], key[by], place[by]
    begin = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    count = np.diff(np.append(begin, len(h)))
    differ = np.minimum.reduceat(key, begin) != np.maximum.reduceat(key, begin)
    use = np.repeat(differ, count)
    key, place = key[use], place[use]
    by = np.argsort(key, kind="stable")
    key, place = key[by], place[by].astype("<u4")
    cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]])) if len(key) else np.zeros(1, np.int64)
    blobs = [place[lo:hi].tobytes() for lo, hi in zip(cut[:-1], cut[1:])]
    return _dealt(key[cut[:-1]].tolist() if len(key) else [], blobs, parts)


def _merge(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of intervals, touching ones joined."""
    by = np.argsort(start, kind="stable")
    start, reach = start[by], np.maximum.accumulate(end[by])
    new = np.concatenate([[True], start[1:] > reach[:-1]])
    first = np.flatnonzero(new)
    return start[first], reach[np.append(first[1:], len(start)) - 1]


def _removals(key: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[list, list]:
    """Merged intervals text by text: keys and blobs of (start, end)."""
    by = np.argsort(key, kind="stable")
    key, start, end = key[by], start[by], end[by]
    cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]])) if len(key) else np.zeros(1, np.int64)
    keys, blobs = [], []
    for lo, hi in zip(cut[:-1], cut[1:]):
        keys.append(int(key[lo]))
        blobs.append(np.stack(_merge(start[lo:hi], end[lo:hi]), axis=1).astype("<u4").tobytes())
    return keys, blobs


def _earliest(rows: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For equal rows of bytes: a number of the set of equal rows, and the least ``at`` in it."""
    h = _row_hash(rows)
    by = np.lexsort((at, h))
    new = np.ones(len(h), bool)
    # compared by hash first, then byte by byte, so a clash of hashes only splits a set
    new[1:] = (h[by[1:]] != h[by[:-1]]) | (rows[by[1:]] != rows[by[:-1]]).any(axis=1)
    begin = np.flatnonzero(new)
    group = np.empty(len(h), np.int64)
    group[by] = np.cumsum(new) - 1
    return group, at[by[begin]][group]


def suffix_array(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of a byte array sorted by their first ``length`` bytes or more, and the rank of the group of each.

    Larsson-Sadakane: groups of suffixes equal in h bytes are sorted by the rank h places on, for h = 8, 16, 32...;
    groups of one are left alone.
    """
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(U64)
    key = np.zeros(n, U64)
    for i in range(8):
        key = key << U64(8) | padded[i : i + n]
    order = np.argsort(key, kind="stable")
    new = np.concatenate([[True], key[order[1:]] != key[order[:-1]]]) if n else np.zeros(0, bool)
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    begin = np.flatnonzero(new)
    rank[order] = np.repeat(begin, np.diff(np.append(begin, n)))
    h = 8
    while h < length and len(begin) < n:
        size = np.diff(np.append(begin, n))
        slot = np.flatnonzero(np.repeat(size > 1, size))  # places in the array that are not settled
        pos = order[slot]
        own, then = rank[pos], rank[np.minimum(pos + h, n)]
        by = np.argsort(own * (n + 1) + then + 1, kind="stable")
        pos, own, then = pos[by], own[by], then[by]
        order[slot] = pos
        first = np.concatenate([[True], (own[1:] != own[:-1]) | (then[1:] != then[:-1])])
        new[slot] = first
        begin = np.flatnonzero(new)
        at = slot[np.flatnonzero(first)]
        rank[pos] = np.repeat(at, np.diff(np.append(np.flatnonzero(first), len(pos))))
        h *= 2
    return order, rank[:n]


def common_prefixes(text: np.ndarray, order: np.ndarray, rows: int, width: int, starts: int, most: int) -> np.ndarray:
    """For the first ``starts`` suffixes of each row: bytes shared with the suffix before it in the array, up to ``most``.

    Kasai: the suffix one place on shares at least one byte less, if the former neighbour's next suffix also comes
    before it (suffixes equal in all the bytes that were sorted have no order). The rows go side by side.
    """
    before = np.full(len(text), -1, np.int64)
    before[order[1:]] = order[:-1]
    place = np.empty(len(text) + 1, np.int64)
    place[order] = np.arange(len(text))
    place[len(text)] = len(text)
    base = np.arange(rows) * width
    out = np.zeros((rows, starts), np.int64)
    shared = np.zeros(rows, np.int64)
    padded = np.concatenate([text, np.zeros(most + 1, np.uint8)])
    for o in range(starts):
        i, j = base + o, before[base + o]
        known = (j >= 0) & (place[last + 1] < place[i]) if o else np.zeros(rows, bool)
        shared = np.where(known, np.maximum(shared - 1, 0), 0)
        last = j
        open_ = np.flatnonzero((j >= 0) & (shared < most))
        while len(open_):
            s = shared[open_]
            same = padded[i[open_] + s] == padded[np.minimum(j[open_] + s, len(text))]
            same &= j[open_] + s < len(text)
            shared[open_[same]] += 1
            open_ = open_[same]
            open_ = open_[shared[open_] < most]
        out[:, o] = shared
    return out


def _strings(contexts: np.ndarray, at: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Strings of SPAN bytes of a block of contexts, in the order of its suffix array.

    Gives context, offset, a number of the set of equal strings (rising in sorted order), and the least ``at`` per set.
    """
    rows = len(contexts)
    width = WIDTH + 1
    text = np.zeros((rows, width), np.uint8)  # a row ends with 0
    text[:, :WIDTH] = contexts
    text = text.ravel()
    order, _ = suffix_array(text, SPAN)
    shared = common_prefixes(text, order, rows, width, LEFT + 1, SPAN)
    context, offset = order // width, order % width
    start = offset <= LEFT
    # a run of equal strings has no other suffix in between: those share less
    context, offset = context[start], offset[start]
    new = shared[context, offset] < SPAN
    ok = valid[context, offset]
    group = np.cumsum(new)
    context, offset, group = context[ok], offset[ok], group[ok]
    if not len(group):
        return context, offset, group, np.zeros(0, np.int64)
    begin = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    return context, offset, np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(group)))), np.minimum.reduceat(at[context], begin)


def _words(strings: np.ndarray) -> np.ndarray:
    """Rows of SPAN bytes as rows of big-endian 64-bit numbers, which sort alike."""
    padded = np.zeros((len(strings), -(-SPAN // 8) * 8), np.uint8)
    padded[:, :SPAN] = strings
    return padded.view(">u8").astype(U64)


def _find(keys: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Binary search of rows in sorted rows: the place of an equal row, or -1."""
    lo, hi = np.zeros(len(queries), np.int64), np.full(len(queries), len(keys))
    for _ in range(int(len(keys)).bit_length()):
        mid = np.minimum((lo + hi) // 2, len(keys) - 1)
        less = np.zeros(len(queries), bool)
        equal = np.ones(len(queries), bool)
        for c in range(keys.shape[1]):
            less |= equal & (keys[mid, c] < queries[:, c])
            equal &= keys[mid, c] == queries[:, c]
        move = lo < hi
        lo = np.where(move & less, mid + 1, lo)
        hi = np.where(move & ~less, mid, hi)
    place = np.minimum(lo, len(keys) - 1)
    return np.where((lo < len(keys)) & (keys[place] == queries).all(axis=1), place, -1)


def _spans(contexts: np.ndarray, context: np.ndarray, offset: np.ndarray) -> np.ndarray:
    return contexts[context[:, None], offset[:, None] + np.arange(SPAN)]


def _hashes(contexts: np.ndarray, context: np.ndarray, offset: np.ndarray, step: int = 1 << 16) -> np.ndarray:
    """64-bit hash of each string of SPAN bytes."""
    parts = [_row_hash(_spans(contexts, context[lo : lo + step], offset[lo : lo + step])) for lo in range(0, len(context), step)]
    return np.concatenate([np.zeros(0, U64), *parts])


def _held(keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Whether each value is one of the sorted keys."""
    if not len(keys):
        return np.zeros(len(x), bool)
    return keys[np.minimum(np.searchsorted(keys, x), len(keys) - 1)] == x


def _merged(words: list[np.ndarray], least: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct strings of all blocks in order, and the least document of each."""
    rows, at = np.concatenate(words), np.concatenate(least)
    by = np.lexsort(rows.T[::-1])
    rows, at = rows[by], at[by]
    begin = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)])[: len(rows)])
    return rows[begin], np.minimum.reduceat(at, begin) if len(begin) else at


def _may_repeat(contexts: np.ndarray) -> np.ndarray:
    """Whether another of these contexts, all different, can hold one of the strings of a context.

    Contexts with one string in common agree around the anchor in l bytes to the left and r to the right with l + r >= LEFT.
    So for some multiple of STEP up to l they agree in it to the left and in the least r that goes with it to the right.
    """
    out = np.zeros(len(contexts), bool)
    for left in range(0, LEFT + 1, STEP):
        right = max(0, LEFT - left - STEP + 1)
        h = _row_hash(contexts[:, LEFT - left : LEFT + GRAM + right])
        by = np.argsort(h, kind="stable")
        same = h[by[1:]] == h[by[:-1]]
        out[by[1:][same]] = True
        out[by[:-1][same]] = True
    return out


def repeated_strings(contexts: np.ndarray, at: np.ndarray, valid: np.ndarray, block_bytes: int = SHARD_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """(context, offset) of the strings that an earlier document has as well."""
    size = max(1, block_bytes // (WIDTH + 1))
    blocks = [(lo, *_strings(contexts[lo : lo + size], at[lo : lo + size], valid[lo : lo + size])) for lo in range(0, len(contexts), size)]
    if len(blocks) > 1:
        firsts, hashes = [], []
        for lo, context, offset, group, _ in blocks:
            first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
            firsts.append(first)
            hashes.append(_hashes(contexts, lo + context[first], offset[first]))
        # only strings whose hash another block has as well are merged
        every = np.sort(np.concatenate(hashes))
        twice = np.unique(every[1:][every[1:] == every[:-1]])
        shared = [np.flatnonzero(_held(twice, h)) for h in hashes]
        words = [_words(_spans(contexts, b[0] + b[1][f[u]], b[2][f[u]])) for b, f, u in zip(blocks, firsts, shared)]
        keys, least = _merged(words, [b[4][u] for b, u in zip(blocks, shared)])
        best = [b[4].copy() for b in blocks]
        for mine, use, m in zip(words, shared, best):
            if len(mine):
                m[use] = least[_find(keys, mine)]
        blocks = [(*b[:4], m) for b, m in zip(blocks, best)]
    found_c, found_o = [], []
    for lo, context, offset, group, least in blocks:
        hit = at[lo + context] > least[group] if len(group) else np.zeros(0, bool)
        found_c.append(lo + context[hit])
        found_o.append(offset[hit])
    empty = [np.zeros(0, np.int64)]
    return np.concatenate(found_c or empty), np.concatenate(found_o or empty)


CONTEXT = ("<i8", "<u4", "u1", "u1")  # row of the text table, place, bytes to the left, to the right


def _contexts(found: DataFrame, parts: int, flush: int = 200_000) -> DataFrame:
    """Contexts of the shared anchors (text_key, at, text, places), packed by shard: part, rows, texts, blob. What a task
    can remove itself (text_key, spans) is dealt over the shards as well.
    """
    names = ["part", "rows", "texts", "blob", "text_key", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        keys_held: list[np.ndarray] = []
        base = waiting = 0

        def emit() -> Iterator[pa.RecordBatch]:
            rows, row, place, left, right = (np.concatenate([x[i] for x in held]) for i in range(5))
            table = np.concatenate(keys_held)  # text_key, at
            key, at = table[row, 0], table[row, 1]
            _, least = _earliest(rows, at)
            gone = at > least
            keys, spans = _removals(key[gone], place[gone] - left[gone], place[gone] + right[gone])
            if keys:
                n, own = len(keys), np.array(keys, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array((own % parts).astype(np.int32)), *[pa.nulls(n, pa.int32())] * 2, pa.nulls(n, pa.binary()), pa.array(own), pa.array(spans, pa.binary())],
                    names=names,
                )
            use = ~gone
            rows, row, place, left, right = rows[use], row[use], place[use], left[use], right[use]
            gram = _row_hash(rows[:, LEFT : LEFT + GRAM])
            by = np.argsort(gram)
            part = ((gram[by] >> U64(32)) * U64(parts) >> U64(32)).astype(np.int32)
            cut = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])) if len(by) else np.zeros(1, np.int64)
            out: list[list] = [[], [], [], []]
            for lo, hi in zip(cut[:-1], cut[1:]):
                own = by[lo:hi]
                texts, local = np.unique(row[own], return_inverse=True)
                blob = rows[own].tobytes() + b"".join(
                    x.tobytes() for x in (local.astype("<i8"), place[own].astype("<u4"), left[own].astype("u1"), right[own].astype("u1"), table[texts].astype("<i8"))
                )
                for c, v in zip(out, (int(part[lo]), hi - lo, len(texts), zstandard.compress(blob, 1))):
                    c.append(v)
            n = len(out[0])
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(c, pa.int32()) for c in out[:3]], pa.array(out[3], pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], names=names
            )

        for b in batches:
            places = [np.frombuffer(x, "<u4").astype(np.int64) for x in b.column("places").to_pylist()]
            all_keys = np.stack([b.column("text_key").to_numpy(), b.column("at").to_numpy()], axis=1)
            for first, data, off in slices(b.column("text")):
                m = len(off) - 1
                mine = places[first : first + m]
                row = np.repeat(np.arange(m), [len(p) for p in mine])
                place = np.concatenate(mine)
                size = np.diff(off)[row]
                left, right = np.minimum(place, LEFT), np.minimum(size - place, SPAN)
                padded = np.concatenate([np.full(LEFT, 255, np.uint8), data, np.full(SPAN, 255, np.uint8)])
                around = np.lib.stride_tricks.sliding_window_view(padded, WIDTH)
                for lo in range(0, len(row), flush):
                    part = slice(lo, lo + flush)
                    rows = around[off[row[part]] + place[part]]
                    step = (np.arange(WIDTH) - LEFT).astype(np.int8)
                    low, high = -left[part].astype(np.int8)[:, None], right[part].astype(np.int8)[:, None]
                    rows[(step < low) | (step >= high)] = 255  # not of this text
                    held.append((rows, row[part] + base, place[part], left[part], right[part]))
                    waiting += len(rows)
                keys_held.append(all_keys[first : first + m])
                base += m
                if waiting >= flush:
                    yield from emit()
                    held, keys_held, base, waiting = [], [], 0, 0
        if waiting:
            yield from emit()

    return found.mapInArrow(run, "part int, rows int, texts int, blob binary, text_key long, spans binary")


def _shard(parts: int, table: pa.Table) -> pa.Table:
    """What a shard finds to remove, and what came to it found: text_key, spans."""
    known = table.filter(pc.is_valid(table.column("spans")))
    known_keys = known.column("text_key").to_numpy()
    known_spans = [np.frombuffer(x, "<u4").reshape(-1, 2).astype(np.int64) for x in known.column("spans").to_pylist()]
    known_rows = np.concatenate([*known_spans, np.zeros((0, 2), np.int64)])
    known_keys = np.repeat(known_keys, np.array([len(x) for x in known_spans], np.int64)).astype(np.int64)
    table = table.filter(pc.is_valid(table.column("blob")))
    if not len(table):
        return _dealt(*_removals(known_keys, known_rows[:, 0], known_rows[:, 1]), parts)
    got: list[list] = [[], [], [], [], [], []]
    for rows, texts, blob in zip(*[table.column(c).to_pylist() for c in ("rows", "texts", "blob")]):
        raw = zstandard.ZstdDecompressor().decompress(blob)
        got[0].append(np.frombuffer(raw, np.uint8, rows * WIDTH).reshape(rows, WIDTH))
        at = rows * WIDTH
        cols = []
        for kind in CONTEXT:
            cols.append(np.frombuffer(raw, kind, rows, at))
            at += rows * np.dtype(kind).itemsize
        ids = np.frombuffer(raw, "<i8", 2 * texts, at).reshape(texts, 2)[cols[0]]
        for c, v in zip(got[1:], (ids[:, 0], ids[:, 1], *[x.astype(np.int64) for x in cols[1:]])):
            c.append(v)
    rows, key, at, place, left, right = (np.concatenate(x) for x in got)
    same, least = _earliest(rows, at)
    gone = at > least
    # one context of each set of equal ones goes on, where its anchor has several
    gram, _ = _earliest(np.ascontiguousarray(rows[:, LEFT : LEFT + GRAM]), at)
    _, one = np.unique(same, return_index=True)
    several = np.bincount(gram[one], minlength=gram.max() + 1) > 1
    keep = np.flatnonzero(~gone & several[gram])
    _, unique = np.unique(same[keep] * 1, return_index=True)
    go = keep[unique]
    go = go[_may_repeat(rows[go])]
    valid = (np.arange(LEFT + 1)[None, :] >= LEFT - left[go][:, None]) & (np.arange(LEFT + 1)[None, :] + SPAN <= LEFT + right[go][:, None])
    context, offset = repeated_strings(rows[go], at[go], valid)
    # the other places of the same document with an equal context lose the same strings
    by = np.argsort(same[keep], kind="stable")
    sorted_same = same[keep][by]
    wanted = same[go][context]
    lo, hi = np.searchsorted(sorted_same, wanted, "left"), np.searchsorted(sorted_same, wanted, "right")
    where = keep[by][np.repeat(lo, hi - lo) + ranges(hi - lo)]
    begin = place[where] - LEFT + np.repeat(offset, hi - lo)
    keys, spans = _removals(
        np.concatenate([known_keys, key[gone], key[where]]),
        np.concatenate([known_rows[:, 0], place[gone] - left[gone], begin]),
        np.concatenate([known_rows[:, 1], place[gone] + right[gone], begin + SPAN]),
    )
    return _dealt(keys, spans, parts)


def _cut(found: DataFrame, spans: DataFrame) -> DataFrame:
    """The texts with something to remove, after it: text_key, n_bytes, n_removed, n_spans, kept, kept_sha256, starts, ends.

    ``kept`` is the rest as text, without characters that a cut splits; the digest is that of the bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], [], [], []]
            for text, blobs in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("spans").to_pylist()):
                pairs = np.frombuffer(blobs, "<u4").reshape(-1, 2).astype(np.int64)
                start, end = _merge(pairs[:, 0], pairs[:, 1])
                edges = [0, *np.stack([start, end], axis=1).ravel().tolist(), len(text)]
                kept = b"".join(text[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2))
                for c, v in zip(out, (int((end - start).sum()), len(start), kept.decode(errors="ignore"), hashlib.sha256(kept).hexdigest(), start.tolist(), end.tolist())):
                    c.append(v)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            cols = [pa.array(c, k) for c, k in zip(out, kinds)]
            yield pa.RecordBatch.from_arrays(
                [b.column("text_key"), b.column("n_bytes"), *cols], names=["text_key", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256", "starts", "ends"]
            )

    per_text = spans.withColumnRenamed("blob", "spans")
    schema = "text_key long, n_bytes long, n_removed long, n_spans long, kept string, kept_sha256 string, starts array<long>, ends array<long>"
    return found.select("text_key", "n_bytes", "text").join(per_text, "text_key").mapInArrow(run, schema)


def remove_repeats(docs: DataFrame, part_rows: int = PART_ROWS) -> tuple[DataFrame, DataFrame]:
    """What each document loses, and the remaining bytes of texts that lose some but not all.

    The first has one row per document: doc_id, text_key, n_bytes, n_removed, n_spans, kept_sha256, emptied (lost as an
    exact copy). The second has text_key, n_bytes, kept, starts, ends.
    """
    small_batches(docs)
    rows = _keyed(docs)
    whole = rows.select("doc_id", "at", "text_key", "n_bytes", F.sha2("text", 256).alias("sha"))
    ident = stage(whole, "ident")
    texts = stage(ident.groupBy("text_key", "n_bytes").agg(F.min("at").alias("first_at"), F.count("*").alias("copies")), "texts")
    total = texts.agg(F.sum("n_bytes")).first()[0] or 0
    # one byte in 16 is an anchor
    parts = int(total // (16 * part_rows)) + 1
    long_enough = rows.filter(F.col("n_bytes") >= SPAN)
    posted = _posted(long_enough.select("text_key", "text"), parts)
    met = posted.groupBy("part").applyInArrow(lambda t: _shared(parts, t), DEALT)
    shared = stage(_gather(met), "shared")
    places = shared.withColumnRenamed("blob", "places")
    keys = shared.select(F.col("text_key").alias("key"))
    first = texts.select("text_key", "n_bytes", F.col("first_at").alias("at")).join(places, "text_key")
    chosen = maybe_in(long_enough.drop("doc_id"), keys, F.col("text_key"))
    one = ["text_key", "n_bytes", "at"]
    found = stage(chosen.join(first, one).dropDuplicates(one).select(*one, "text", "places"), "found")
    met = _contexts(found, 4 * parts).groupBy("part")
    spans = stage(_gather(met.applyInArrow(lambda t: _shard(parts, t), DEALT)), "spans")
    cut = stage(_cut(found, spans), "cut")
    lost = ident.join(texts.drop("copies"), ["text_key", "n_bytes"]).join(cut.select("text_key", "n_bytes", "n_removed", "n_spans", "kept_sha256"), ["text_key", "n_bytes"], "left")
    copy = (F.col("at") > F.col("first_at")) & (F.col("n_bytes") >= SPAN)
    out = lost.select(
        "doc_id", "text_key", "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        copy.alias("emptied"),
    )
    return out, cut
