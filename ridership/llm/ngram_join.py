"""N-gram Jaccard join (operator 6): a grouped prefix join on the sets of 5-word shingles, exact at 3/4.

A document's set holds the 64-bit hashes of its distinct shingles. Equal sets are one. Sets that link share a shingle
among the first n - ceil(3n/4) + 1 of each in any common order; the order here is by how often shingles occur (a count
table of fixed size, filled from all documents), then by hash, so that passages shared by many documents come last. Sets
with equal prefixes and sizes form a group, and only groups are posted under the prefix shingles.

1. Postings travel packed, by hash of the shingle. Each list proposes pairs (first group, other group) that pass the
   size and position filters; each group keeps the partner met most often; the members are verified on whole sets.
   Verified links give components, so a large group of near copies is one component after a link for each member.
2. Lists and groups that hold several components choose new leaders, some by the shingle's hash, and every component meets
   a few of those it shares most lists with. Their links make fewer components, for as long as that goes on; so copies
   that differ in different places become one component in rounds of as many pairs as there are components.
3. The lists of two and more groups meet again with the components, long ones cut into cells of chunks over many tasks.
   Pairs of groups whose members are all in one component need no look. Of the others a pair is taken only at its first
   few shared shingles, where the rest of both sets after the shingle must reach the overlap; the smaller set must then
   hold the shingle early, so a passage that stands late in every prefix pairs nothing; and bits of the shingles that each
   prefix has in lists bound from above how many both share. What is left and shares as many
   prefix shingles as linked sets must is expanded to its members and verified. So no link between different components
   is missed, and near copies are never paired all with all.

Verification brings the texts of the partners of a set to that set's task, a hub with many partners in several parts;
whole sets are made again from the texts there. A bitmap of fixed size keeps texts without a pair out of that shuffle.

Defined cases: A-Z count as a-z; NULL text, empty text or text without words has the empty set, linked with nothing;
fewer than five words are one shingle; repeated rows and equal sets are one component; a NULL ``doc_id`` is never the
component's id unless all are NULL; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridership.llm.common import components, maybe_in, small_batches
from ridership.llm.text import U64, mix, ranges, shingles, slices
from ridership.session import discard, stage

SIZE = 5
COUNTERS = 1 << 22
BLOCKS = 16
LIST_ROWS = 1_000_000
PAIR_BLOCK = 1_000_000
HUB_ROWS = 200
# Shared shingles that may stand before the one at which a pair is taken. A linked pair is taken at this many and one more
# (or at all it must share in the prefixes, if fewer), as its j-th shared shingle has at most j shared ones before it.
SPARE = 2
# Rounds of leaders on contracted lists: leaders of a list in each.
ROUNDS = (1, 2)
ORDERS = 4  # orders among which a list's shingle chooses; partners of a component for each leader of a list
# Shingles that the prefixes of two linked sets share at least: the least overlap, less what stands after a prefix. The
# first so many common shingles stand in both prefixes.
SHARED = "(3 * (na + nb) + 6) div 7 - greatest((3 * na + 3) div 4, (3 * nb + 3) div 4) + 1"


MARKS = ("mark0", "mark1", "mark2", "mark3")  # bits of a group's prefix shingles, by their hash


def _shared(na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    return (3 * (na + nb) + 6) // 7 - np.maximum((3 * na + 3) // 4, (3 * nb + 3) // 4) + 1


def _sets(texts: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for first, data, off in slices(texts):
        yield first, *shingles(data, off, size)


def _row_sum(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, U64)
    np.cumsum(values, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def _set_keys(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """64-bit key of each row's set, never 0."""
    return mix(_row_sum(mix(h), at) * U64(3) + _row_sum(mix(h ^ U64(0x5555555555555555)), at)) | U64(1)


def _pack(*columns: np.ndarray) -> bytes:
    """Columns side by side, each byte plane on its own, compressed."""
    planes = [np.frombuffer(c.tobytes(), np.uint8).reshape(len(c), -1).T.tobytes() for c in columns]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def _levels(counts: np.ndarray) -> np.ndarray:
    """Counts of 32 bits in 16, in the same order."""
    return np.round(np.log2(counts + 1.0) * 2047).astype(np.uint16)


def profiles(docs: DataFrame, size: int = SIZE) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, text_key, n, set_key) of every document, stored, and how often shingles occur by hash modulo COUNTERS.

    The key is NULL for the empty set. The counts cover all documents; their table has a fixed size and holds logarithms,
    which tell all counts to 2,000 apart and larger ones to a part in 2,000.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, np.uint32)

        def rows(*columns):
            return pa.RecordBatch.from_arrays(list(columns), names=["block", "doc_id", "text_key", "n", "set_key", "blob"])

        for b in batches:
            for first, h, at in _sets(b.column("text"), size):
                slot, times = np.unique((h % U64(COUNTERS)).astype(np.int64), return_counts=True)
                counts[slot] += times.astype(np.uint32)
                n, m = np.diff(at), len(at) - 1
                key = pa.array(_set_keys(h, at).view(np.int64), mask=n == 0)
                own = [b.column(c).slice(first, m) for c in ("doc_id", "text_key")]
                yield rows(pa.nulls(m, pa.int32()), *own, pa.array(n), key, pa.nulls(m, pa.binary()))
        if counts.any():
            blobs = pa.array([zstandard.compress(x.tobytes(), 1) for x in np.split(counts, BLOCKS)], pa.binary())
            yield rows(pa.array(np.arange(BLOCKS, dtype=np.int32)), *[pa.nulls(BLOCKS, pa.int64())] * 4, blobs)

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(COUNTERS // BLOCKS, np.uint32)
        for x in table.column("blob").to_pylist():
            # counts stop at the highest number
            total += np.minimum(np.frombuffer(zstandard.decompress(x), np.uint32), np.uint32(0xFFFFFFFF) - total)
        return pa.table({"block": table.column("block")[:1], "blob": pa.array([zstandard.compress(total.tobytes(), 1)], pa.binary())})

    out = stage(_texts(docs).mapInArrow(run, "block int, doc_id long, text_key long, n long, set_key long, blob binary"), "profiles")
    merged = out.filter("block IS NOT NULL").select("block", "blob").groupBy("block").applyInArrow(add, "block int, blob binary").collect()
    counts = np.zeros((BLOCKS, COUNTERS // BLOCKS), np.uint16)
    for r in merged:
        counts[r["block"]] = _levels(np.frombuffer(zstandard.decompress(bytes(r["blob"])), np.uint32))
    return out.filter("block IS NULL").select("doc_id", "text_key", "n", "set_key"), counts.ravel()


def _texts(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    key = F.xxhash64(F.coalesce(text, F.lit("")))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("text_key"), text.alias("text"))


def _part(h: np.ndarray, parts: int) -> np.ndarray:
    """Part of each hash; parts follow the order of the hashes."""
    return ((h >> U64(32)) * U64(parts) >> U64(32)).astype(np.int32)


POSTING = ("<u8", "<u4", "<u4")  # shingle, row of the group table, place in the prefix
GROUP = ("<u8", "<u4")  # group key, set size


def postings(docs: DataFrame, counts: np.ndarray, parts: int, size: int = SIZE, flush: int = 1_000_000) -> DataFrame:
    """Packed postings of the groups, by part, and their members (group_key, set_key), dealt over the parts as well."""
    names = ["part", "rows", "groups", "blob", "group_key", "set_key"]

    def prefixes(h: np.ndarray, at: np.ndarray):
        """Prefix shingles in order, with row and place; group keys."""
        n = np.diff(at)
        row = np.repeat(np.arange(len(n)), n)
        by = np.lexsort((h, counts[(h % U64(COUNTERS)).astype(np.int64)], row))
        h = h[by]
        place = ranges(n)
        keep = place < (n - -(-3 * n // 4) + 1)[row]
        h, row, place = h[keep], row[keep], place[keep]
        ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(n)))])
        group = mix(_row_sum(mix(h * U64(2 * 7 + 1)), ends) + n.astype(U64) * U64(0x9E3779B97F4A7C15)) | U64(1)
        # equally frequent shingles are taken from the smallest hash on; mixed again they spread over the parts
        return mix(h), row, place, group, n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        posted: set[int] = set()
        held: list[tuple] = []
        base = waiting = 0

        def emit() -> Iterator[pa.RecordBatch]:
            h, g, place = (np.concatenate(x) for x in zip(*[x[:3] for x in held]))
            key, n = (np.concatenate(x) for x in zip(*[x[3:] for x in held]))
            by = np.argsort(h)
            h, g, place = h[by], g[by], place[by]
            part = _part(h, parts)
            cut = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
            blobs, rows, groups = [], [], []
            for lo, hi in zip(cut[:-1], cut[1:]):
                own, local = np.unique(g[lo:hi], return_inverse=True)
                blobs.append(_pack(h[lo:hi], local.astype("<u4"), place[lo:hi].astype("<u4"), key[own], n[own].astype("<u4")))
                rows.append(hi - lo)
                groups.append(len(own))
            k = len(blobs)
            cols = [pa.array(part[cut[:-1]]), pa.array(rows, pa.int32()), pa.array(groups, pa.int32()), pa.array(blobs, pa.binary()), *[pa.nulls(k, pa.int64())] * 2]
            yield pa.RecordBatch.from_arrays(cols, names=names)

        for b in batches:
            for _, h, at in _sets(b.column("text"), size):
                sets = _set_keys(h, at)
                fresh = np.array([n > 0 and s not in seen and not seen.add(s) for s, n in zip(sets.tolist(), np.diff(at).tolist())], bool)
                if not fresh.any():
                    continue
                keep = np.repeat(fresh, np.diff(at))
                at = np.concatenate([[0], np.cumsum(np.diff(at)[fresh])])
                sets = sets[fresh]
                h, row, place, group, n = prefixes(h[keep], at)
                m = len(group)
                own = [pa.array(x.view(np.int64)) for x in (group, sets)]
                cols = [pa.array(_part(group, parts)), *[pa.nulls(m, pa.int32())] * 2, pa.nulls(m, pa.binary()), *own]
                yield pa.RecordBatch.from_arrays(cols, names=names)
                new = np.array([g not in posted and not posted.add(g) for g in group.tolist()], bool)
                use = new[row]
                held.append((h[use], row[use] + base, place[use], group, n))
                base += m
                waiting += int(use.sum())
                if waiting >= flush:
                    yield from emit()
                    held, base, waiting = [], 0, 0
        if waiting:
            yield from emit()

    return _texts(docs).mapInArrow(run, "part int, rows int, groups int, blob binary, group_key long, set_key long")


def _lists(table: pa.Table) -> tuple[np.ndarray, ...]:
    """Postings of a part without repeats, sorted by shingle and group: shingle, group, place, n."""
    h, g, place, n = ([np.zeros(0, k)] for k in ("<u8", "<u8", "<u4", "<u4"))
    for rows, groups, blob in zip(*[table.column(c).to_pylist() for c in ("rows", "groups", "blob")]):
        raw = zstandard.ZstdDecompressor().decompress(blob)
        cut = rows * sum(np.dtype(k).itemsize for k in POSTING)
        a, i, p = _planes(raw[:cut], rows, POSTING)
        key, size = _planes(raw[cut:], groups, GROUP)
        h.append(a), g.append(key[i]), place.append(p), n.append(size[i])
    h, g, place, n = (np.concatenate(x) for x in (h, g, place, n))
    by = np.lexsort((g, h))
    h, g, place, n = h[by], g[by], place[by], n[by]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
    return h[new], g[new], place[new], n[new]


def _planes(raw: bytes, rows: int, kinds: tuple[str, ...]) -> list[np.ndarray]:
    out, at = [], 0
    for kind in kinds:
        width = np.dtype(kind).itemsize
        out.append(np.frombuffer(np.frombuffer(raw, np.uint8, rows * width, at).reshape(width, rows).T.tobytes(), kind))
        at += rows * width
    return out


def _may_link(n: np.ndarray, place: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Size and position filter: the overlap that 3/4 asks for can still be reached from a shared shingle."""
    a, b = n[i].astype(np.int64), n[j].astype(np.int64)
    least = -(-3 * (a + b) // 7)
    left = np.minimum(a - place[i], b - place[j])  # this shingle and those after it
    # at most the places before it are shared as well
    before = np.minimum(place[i], place[j]).astype(np.int64)
    return (4 * np.minimum(a, b) >= 3 * np.maximum(a, b)) & (left + before >= least)


def _leaders(table: pa.Table) -> pa.Table:
    """Pairs (first group, other group) of each list with the number of lists; the postings of lists with two or more; the
    distinct members."""
    members = table.filter(pc.is_valid(table.column("set_key"))).group_by(["group_key", "set_key"]).aggregate([])
    h, g, place, n = _lists(table.filter(pc.is_valid(table.column("blob"))))
    begin = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    count = np.diff(np.append(begin, len(h)))
    many = np.repeat(count > 1, count)
    postings = np.repeat(count, count)
    early = np.repeat(np.add.reduceat(_early(n, place).astype(np.int64), begin) if len(h) else count, count)
    first = np.repeat(begin, count)
    other = np.flatnonzero(many & (first != np.arange(len(h))))
    ok = _may_link(n, place, first[other], other)
    a, b, na, nb = g[first[other[ok]]], g[other[ok]], n[first[other[ok]]], n[other[ok]]
    by = np.lexsort((a, b))
    a, b, na, nb = a[by], b[by], na[by], nb[by]
    new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, np.int64)
    times = np.diff(np.append(new, len(a)))
    k, m, c = len(new), int(many.sum()), len(members)
    signed = lambda x: pa.array(x.astype(U64).view(np.int64))
    none = lambda rows: pa.nulls(rows, pa.int64())
    column = lambda x: members.column(x).combine_chunks().cast(pa.int64())
    return pa.table(
        {
            "a": pa.concat_arrays([signed(a[new]), none(m + c)]),
            "b": pa.concat_arrays([signed(b[new]), none(m + c)]),
            "times": pa.concat_arrays([pa.array(times, pa.int64()), none(m + c)]),
            "na": pa.concat_arrays([signed(na[new]), none(m + c)]),
            "nb": pa.concat_arrays([signed(nb[new]), none(m + c)]),
            "shingle": pa.concat_arrays([none(k), signed(h[many]), none(c)]),
            "place": pa.concat_arrays([none(k), signed(place[many]), none(c)]),
            "n": pa.concat_arrays([none(k), signed(n[many]), none(c)]),
            "postings": pa.concat_arrays([none(k), signed(postings[many]), none(c)]),
            "early": pa.concat_arrays([none(k), signed(early[many]), none(c)]),
            "group_key": pa.concat_arrays([none(k), signed(g[many]), column("group_key")]),
            "set_key": pa.concat_arrays([none(k + m), column("set_key")]),
        }
    )


def _early(n: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Whether a set of the same size or a larger one can be taken at this place."""
    return 7 * (n.astype(np.int64) - place.astype(np.int64) + SPARE) >= 6 * n.astype(np.int64)


def _dealt(chunk: int) -> str:
    """Cells (i, j, role) of a posting: a list has a row of cells for each chunk of its early postings, which are the smaller
    sets of pairs (role 1), and a column for each chunk of all postings, the larger sets (role 2). Any pair has one cell."""
    own = "n + 7 * {0} >= 7 * place".format(SPARE)
    rows, cols = (f"cast(({c} + {chunk} - 1) div {chunk} as int)" for c in ("early", "postings"))
    i, j = (f"cast(pmod(xxhash64(group_key), {x}) as int)" for x in (rows, cols))
    larger = f"transform(sequence(0, {rows} - 1), r -> struct(r as i, {j} as j, if({own} and r = {i}, 3, 2) as role))"
    smaller = f"transform(filter(sequence(0, {cols} - 1), c -> c <> {j} and {own}), c -> struct({i} as i, c as j, 1 as role))"
    return f"concat({larger}, {smaller})"


def _across(table: pa.Table) -> pa.Table:
    """The pairs of groups that meet in a cell of a list early enough to link and are not within one component, with the
    number of lists and sizes; the smaller set is the first."""
    names = ("shingle", "i", "j", "group_key", "place", "n", "low", "high", "role", "met", *MARKS)
    h, row, col, g, place, n, low, high, role, met, *marks = (table.column(c).to_numpy() for c in names)
    by = np.lexsort((g, n, col, row, h))
    new = (h[by[1:]] != h[by[:-1]]) | (row[by[1:]] != row[by[:-1]]) | (col[by[1:]] != col[by[:-1]])
    begin = np.flatnonzero(np.concatenate([[True], new]))
    size = np.diff(np.append(begin, len(h)))
    # cells within one component go at once
    apart = np.minimum.reduceat(low[by], begin) != np.maximum.reduceat(high[by], begin)
    by, size = by[np.repeat(apart, size)], size[apart]
    g, place, n, low, high, role, met, *marks = (x[by] for x in (g, place, n, low, high, role, met, *marks))
    cell = np.repeat(np.arange(len(size)), size)
    found: list[tuple[np.ndarray, ...]] = [tuple(np.zeros(0, np.int64) for _ in range(5))]
    held = 0

    def unique() -> None:
        a, b, times, na, nb = (np.concatenate([f[i] for f in found]) for i in range(5))
        by = np.lexsort((b, a))
        a, b, times, na, nb = a[by], b[by], times[by], na[by], nb[by]
        new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, np.int64)
        found[:] = [(a[new], b[new], np.add.reduceat(times, new) if len(new) else times, na[new], nb[new])]

    # an early posting meets those after it in its cell that are not too large for its place, a block of postings at a time
    most = np.minimum(4 * n - 7 * place + 7 * SPARE, 4 * n) // 3
    end = np.searchsorted((cell << 32) + n, (cell << 32) + np.maximum(most, 0), "right")
    after = np.where(role & 1, np.maximum(end - np.arange(len(n)) - 1, 0), 0)
    total = np.cumsum(after)
    lo = 0
    while lo < len(n):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + PAIR_BLOCK, "right")))
        i = np.repeat(np.arange(lo, hi), after[lo:hi])
        j = i + 1 + ranges(after[lo:hi])
        ok = (role[j] & 2 > 0) & (7 * (n[j] - place[j] + SPARE) >= 3 * (n[i] + n[j]))
        i, j = i[ok], j[ok]
        apart = ~((low[i] == high[i]) & (low[j] == high[j]) & (low[i] == low[j]))
        i, j = i[apart], j[apart]
        # a mark that one has and the other lacks is a shingle of one alone, so this many are shared at most
        alone = sum(np.bitwise_count(m[i] ^ m[j]) for m in marks).astype(np.int64)
        able = (met[i] + met[j] - alone) // 2 >= _shared(n[i].astype(np.int64), n[j].astype(np.int64))
        i, j = i[able], j[able]
        found.append((g[i], g[j], np.ones(len(i), np.int64), n[i].astype(np.int64), n[j].astype(np.int64)))
        held += len(i)
        if held > PAIR_BLOCK:
            unique()
            held = 0
        lo = hi
    unique()
    return pa.table({c: pa.array(v, pa.int64()) for c, v in zip(("a", "b", "times", "na", "nb"), found[0])})


def _verified(docs: DataFrame, homes: DataFrame, pairs: DataFrame, size: int, name: str) -> DataFrame:
    """The pairs (a, b) of set keys whose sets have a Jaccard similarity of 3/4 or more.

    ``homes`` names one document per set: set_key, home (doc_id, text_key).
    """
    pairs = stage(pairs, f"{name}_pairs")
    hubs = pairs.groupBy("a").agg(F.ceil(F.count("*") / HUB_ROWS).cast("int").alias("_parts"))
    heads = hubs.select("a", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("part"), F.col("a").alias("set_key"), F.lit(False).alias("partner"))
    partners = pairs.join(hubs, "a").select("a", F.pmod(F.hash("b"), F.col("_parts")).alias("part"), F.col("b").alias("set_key"), F.lit(True).alias("partner"))
    at_home = homes.select("set_key", F.col("home.doc_id").alias("_doc"), F.col("home.text_key").alias("_key"))
    roles = stage(heads.unionByName(partners).join(at_home, "set_key"), f"{name}_roles")
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_key") == F.col("_key"))
    texts = maybe_in(_texts(docs), roles.select(F.col("_key").alias("key")), F.col("text_key")).join(roles, same)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, whole = None, None
        for b in batches:
            hubs, keys, partner = (b.column(c).to_pylist() for c in ("a", "set_key", "partner"))
            found = []
            for first, h, at in _sets(b.column("text"), size):
                for i in range(len(at) - 1):
                    own, r = h[at[i] : at[i + 1]], first + i
                    if not partner[r]:
                        hub, whole = hubs[r], own.copy()
                    elif hub == hubs[r]:
                        common = len(np.intersect1d(whole, own, assume_unique=True))
                        if 100 * common >= 75 * (len(whole) + len(own) - common):
                            found.append((hub, keys[r]))
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(2)], names=["a", "b"])

    met = texts.select("a", "part", "partner", "set_key", "text").repartition("a", "part").sortWithinPartitions("a", "part", "partner")
    links = stage(met.mapInArrow(check, "a long, b long").distinct(), f"{name}_links")
    discard(roles)
    return links


def _contracted(open_lists: DataFrame, members: DataFrame, label: DataFrame, leaders: int) -> DataFrame:
    """Pairs (a, b) of set keys: for each component that is not alone in a list the sets it meets most often among leaders.

    A list has a row per group and component in it. Its leaders hold the shingle earliest, up to a seeded number of places,
    the seeds chosen by the shingle; only rows of other components meet a leader. Leaders are minima with partial results
    per task.
    """
    named = members.join(label.withColumnRenamed("node", "set_key"), "set_key", "left")
    named = named.select("group_key", "set_key", F.coalesce("label", "set_key").alias("label"))
    some = F.min_by("set_key", F.xxhash64(F.lit(leaders), "set_key"))
    own = stage(named.groupBy("group_key", "label").agg(some.alias("set_key")), "contracted")
    # stored, as both the leaders and those that meet them are taken from these rows
    rows = stage(open_lists.join(own, "group_key").select("shingle", "label", "set_key", "place", "n"), "contracted_lists")
    # a set that holds the shingle early has the fewest shingles of its own before it and the most in common with others
    order = lambda i: F.xxhash64(F.lit(leaders), F.lit(i), F.pmod("shingle", F.lit(ORDERS)), "set_key")
    first = lambda i: F.min(F.struct(F.col("place") + F.pmod(order(i), F.lit(2 * i + 1)), order(i), "set_key", "label", "place", "n"))
    heads = rows.groupBy("shingle").agg(F.array(*map(first, range(leaders))).alias("first"), F.min("label").alias("_low"), F.max("label").alias("_high"))
    heads = heads.filter("_low <> _high").select("shingle", F.explode("first").alias("f")).select("shingle", F.col("f.set_key").alias("a"), F.col("f.label").alias("la"), F.col("f.place").alias("pa"), F.col("f.n").alias("na")).distinct()
    met = rows.join(heads, "shingle").filter("label <> la AND 4 * least(n, na) >= 3 * greatest(n, na)")
    # what is left after this shingle, and at most the places before it, must reach the overlap
    met = met.filter("least(n - place, na - pa) + least(place, pa) >= (3 * (n + na) + 6) div 7").withColumnRenamed("n", "nb")
    met = met.groupBy("label", "set_key", "a").agg(F.count("*").alias("times"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    met = met.filter(f"{2 * ORDERS} * times >= {SHARED}")
    place = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("times"), "a", "set_key"))
    best = met.withColumn("_place", place).filter(F.col("_place") <= ORDERS * leaders)
    asked = stage(best.select(F.least("a", "set_key").alias("a"), F.greatest("a", "set_key").alias("b")).distinct(), "asked")
    discard(own, rows)
    return asked


def _merged(label: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """The components (node, label) after further links (a, b): only the components that these join are worked out anew."""
    own = lambda x: label.select(F.col("node").alias(x), F.col("label").alias(f"l{x}"))
    edges = links.join(own("a"), "a", "left").join(own("b"), "b", "left")
    top = components(edges.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")), name)
    moved = label.join(top.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left")
    # a label is a node of its component, so what is in no component yet is what the links bring in
    fresh = top.join(label.select("node"), "node", "left_anti").select("node", "label")
    out = stage(moved.select("node", F.coalesce("to", "label").alias("label")).union(fresh), f"{name}_all")
    discard(top)
    return out


def jaccard_components(docs: DataFrame, size: int = SIZE, list_rows: int = LIST_ROWS) -> DataFrame:
    """One row per document (doc_id, text): doc_id, text_key, n_shingles, component_id, component.

    ``component`` names the component by the key of one of its sets, also where ids are NULL or repeat; NULL for the empty
    set.
    """
    small_batches(docs)
    ident, counts = profiles(docs, size)
    home = F.min(F.struct("doc_id", "text_key")).alias("home")
    homes = stage(ident.filter("n > 0").groupBy("set_key").agg(home, F.min("doc_id").alias("doc_id"), F.first("n").alias("n")), "homes")
    total = homes.agg(F.sum(F.expr("n - ceil(0.75 * n) + 1"))).first()[0] or 0
    parts = int(total // list_rows) + 1
    met = postings(docs, counts, parts, size).groupBy("part")
    found = stage(met.applyInArrow(_leaders, "a long, b long, times long, na long, nb long, shingle long, place long, n long, postings long, early long, group_key long, set_key long"), "lists")
    del counts, met  # a table of some MB, which the driver holds twice
    members = found.filter("set_key IS NOT NULL").select("group_key", "set_key")
    heads = stage(members.groupBy("group_key").agg(F.min("set_key").alias("head")), "heads")
    proposed = found.filter("a IS NOT NULL").groupBy("a", "b")
    proposed = proposed.agg(F.sum("times").alias("times"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    # a list proposes its first group only, so half of the shared shingles are enough for this round
    proposed = proposed.filter(f"2 * times >= {SHARED}")
    best = proposed.groupBy("b").agg(F.max(F.struct("times", "a")).alias("_a")).select(F.col("_a.a").alias("a"), "b")
    star = (
        best.join(heads.select(F.col("group_key").alias("a"), F.col("head").alias("ha")), "a")
        .join(heads.select(F.col("group_key").alias("b"), F.col("head").alias("hb")), "b")
        .select(F.col("ha").alias("a"), F.col("hb").alias("b"))
        .union(members.join(heads, "group_key").filter("set_key <> head").select("head", "set_key"))
        .filter("a <> b")
        .distinct()
    )
    first = _verified(docs, homes, star, size, "star")
    label = components(first, "star_components")
    discard(first)
    lists = found.filter("shingle IS NOT NULL").select("shingle", "group_key", "place", "n", "postings", "early")
    # a group with several members is a list of its own
    several = members.groupBy("group_key").agg(F.count("*").alias("_sets")).filter("_sets > 1").select("group_key")
    sizes = homes.select(F.col("set_key").alias("head"), F.col("n").cast("long").alias("n"))
    alone = several.join(heads, "group_key").join(sizes, "head").select(F.col("group_key").alias("shingle"), "group_key", F.lit(0).cast("long").alias("place"), "n")
    near_front = lists.filter(f"early > 0 AND n + 7 * {SPARE} >= 7 * place").select("shingle", "group_key", "place", "n")
    open_lists = stage(near_front.union(alone), "open")
    in_lists = stage(members.join(open_lists.select("group_key").distinct(), "group_key", "left_semi"), "open_members")
    for leaders in ROUNDS:
        more = _verified(docs, homes, _contracted(open_lists, in_lists, label, leaders), size, f"round{leaders}")
        if more.isEmpty():
            break
        before, label = label, _merged(label, more, "round_components")
        discard(more, before)

    placed = stage(
        members.join(label.withColumnRenamed("node", "set_key"), "set_key", "left").select("group_key", "set_key", F.coalesce("label", "set_key").alias("label")),
        "placed",
    )
    discard(open_lists, in_lists)
    span = placed.groupBy("group_key").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    # shingles shared by two groups are in lists, so those a group has in lists stand for its prefix
    slot = F.pmod(F.xxhash64("shingle"), F.lit(64 * len(MARKS)))
    mark = lambda k: F.bit_or(F.when(F.floor(slot / 64) == k, F.expr(f"shiftleft(1L, cast(pmod(xxhash64(shingle), {64 * len(MARKS)}) % 64 as int))")).otherwise(F.lit(0).cast("long")))
    marks = lists.groupBy("group_key").agg(F.count("*").alias("met"), *[mark(k).alias(c) for k, c in enumerate(MARKS)])
    span = span.join(marks, "group_key")
    rest = lists.filter("early > 0").join(span, "group_key").selectExpr("*", f"explode({_dealt(max(1, list_rows // 10))}) AS _cell")
    rest = rest.select("shingle", "_cell.i", "_cell.j", "_cell.role", "group_key", "place", "n", "low", "high", "met", *MARKS)
    rest = rest.withColumn("part", F.pmod(F.xxhash64("shingle", "i", "j"), F.lit(parts)))
    pairs = rest.groupBy("part").applyInArrow(_across, "a long, b long, times long, na long, nb long")
    pairs = pairs.groupBy("a", "b").agg(F.sum("times").alias("times"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    pairs = stage(pairs.filter(f"times >= least({SPARE + 1}, {SHARED})"), "near")
    # the shared prefix shingles of what is left, counted over all lists; a prefix is shorter than its text
    ends = pairs.select(F.col("a").alias("group_key")).union(pairs.select("b")).distinct()
    own = stage(lists.join(ends, "group_key", "left_semi").groupBy("group_key").agg(F.collect_list("shingle").alias("own")), "prefixes")
    pairs = pairs.join(own.select(F.col("group_key").alias("a"), F.col("own").alias("pa")), "a")
    pairs = pairs.join(own.select(F.col("group_key").alias("b"), F.col("own").alias("pb")), "b")
    pairs = pairs.filter(f"size(array_intersect(pa, pb)) >= {SHARED}").select("a", "b")
    one = lambda x: placed.select(F.col("group_key").alias(x), F.col("set_key").alias(f"s{x}"), F.col("label").alias(f"l{x}"))
    across = pairs.join(one("a"), "a").join(one("b"), "b").filter("la <> lb").select(F.least("sa", "sb").alias("a"), F.greatest("sa", "sb").alias("b"))
    inside = one("a").join(one("a").select("a", F.col("sa").alias("sb"), F.col("la").alias("lb")), "a").filter("sa < sb AND la <> lb").select("sa", "sb")
    second = _verified(docs, homes, across.union(inside).distinct(), size, "across")
    label = _merged(label, second, "set_components")

    rooted = homes.join(label.withColumnRenamed("node", "set_key"), "set_key", "left").withColumn("label", F.coalesce("label", "set_key"))
    smallest = rooted.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    by_set = stage(rooted.join(smallest, "label").select("set_key", "component_id", F.col("label").alias("component")), "by_set")
    return ident.join(by_set, "set_key", "left").select(
        "doc_id", "text_key", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "component"
    )

