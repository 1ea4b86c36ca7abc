"""Embedding near-dedup (operator 8): collision-counting projections, links at a cosine of ``least`` or more.

Equal vectors are one class. Each class has many one-dimensional projections on seeded directions. For two unit vectors
at the threshold a projection differs with a known spread, whatever the other vectors are. A window around one of twice
that spread holds the other with a chance of 0.954, a cell of eight spreads with a random edge holds both with 0.900;
unrelated vectors share them far more rarely.

1. Each of a few tables puts a class by its first ``depth`` projections into one cell. The depth grows with the logarithm
   of the number of classes, so that a vector meets a bounded number of unrelated ones; the number of tables follows from
   the depth and ``recall``.
2. In a cell the vectors are sorted by the next projection; the windows give the pairs, and collisions in ``COUNTED``
   further projections are counted pair by pair. Pairs below the count that ``recall`` asks for are dropped as soon as they
   cannot reach it.
3. The others are verified by the cosine in double precision. A pair that an earlier table finds as well is not counted
   again. A cell gives counts per vector and one edge per vector of its local components, never the pairs.

A cell of more than ``CHUNK`` vectors is cut into chunks that meet two by two, so a task's memory is bounded however many
vectors lie close together. Cells and pairs of chunks are dealt into buckets, many cells to a task's group, and the
buckets are worked off in rounds: a round moves about as many vectors as there are classes, and its files go with it, so
the disk does not grow with the tables or with the copies of a dense cell. Projections are worked out again from the vector
where they are needed, by sums in a fixed order, so every task gets the same.

Defined cases: a vector that is NULL, empty or zero or holds a NULL or non-finite component links with nothing; vectors
of different lengths do not link; repeated rows are vectors of their own, linked with each other; a NULL ``vec_id`` is
never the component's id unless all are NULL, and is kept only then; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridership.llm.common import components
from ridership.llm.text import U64, mix, ranges
from ridership.session import stage

COUNTED = 12
HIT = math.erf(2 / math.sqrt(2))  # chance of a collision at the threshold: a window of two spreads
SAME = 1 - math.sqrt(2 / math.pi) / 8  # chance of one cell at the threshold: cells of eight spreads, random edges
MET = 2_000
CHUNK = 8_192
BUCKET = 2_048  # rows of a group of cells
ROUND = 500_000  # rows moved in a round, or as many as there are classes
PAIR_BLOCK = 1_000_000
SHARE = 0.57  # of unrelated vectors that share a cell in one projection


@dataclass(frozen=True)
class Plan:
    """Number of tables, projections that make a cell, collisions that a pair must reach."""

    tables: int
    depth: int
    count: int

    @property
    def width(self) -> int:
        """Projections a table owns: those of the cell and the sorted one."""
        return self.depth + 1

    @property
    def directions(self) -> int:
        return self.tables * self.width + COUNTED


def make_plan(classes: int, recall: float) -> Plan:
    """Depth by the number of classes; count and tables so that a pair at the threshold is found with chance ``recall``."""
    depth = max(1, round(math.log(max(1.0, classes / MET)) / -math.log(SHARE)))
    chance, count = 0.0, COUNTED + 1
    while chance < 0.99:
        count -= 1
        chance += math.comb(COUNTED, count) * HIT**count * (1 - HIT) ** (COUNTED - count)
    found = SAME**depth * HIT * chance
    return Plan(math.ceil(math.log(1 - recall) / math.log(1 - found)), depth, count)


def _window(dims: int, least: float) -> float:
    return 2 * math.sqrt((2 - 2 * least) / dims)


def _directions(n: int, dims: int, seed: int) -> np.ndarray:
    d = np.random.default_rng([seed, dims]).normal(size=(n, dims))
    return d / np.linalg.norm(d, axis=1, keepdims=True)


def _projected(v: np.ndarray, plan: Plan, seed: int) -> np.ndarray:
    """Projections of the unit vectors; the sums run in one order, whichever rows come together."""
    dims = v.shape[1]
    directions = np.ascontiguousarray(_directions(plan.directions, dims, seed).T)
    out = np.empty((len(v), plan.directions), np.float32)
    for lo in range(0, len(v), 256):
        own = v[lo : lo + 256]
        own = own / np.abs(own).max(axis=1, keepdims=True)
        sums, norm = np.zeros((len(own), plan.directions)), np.zeros((len(own), 1))
        for d in range(dims):
            at = own[:, d : d + 1]
            sums += at * directions[d]
            norm += at * at
        out[lo : lo + 256] = sums / np.sqrt(norm)
    return out


def _cells(p: np.ndarray, plan: Plan, dims: int, least: float, seed: int) -> np.ndarray:
    """The cell of each row in each table, named by a hash of 64 bits."""
    width = 4 * _window(dims, least)
    edges = np.random.default_rng([seed, dims, 1]).uniform(0, width, (plan.tables, plan.depth))
    out = np.empty((len(p), plan.tables), U64)
    for t in range(plan.tables):
        name = np.full(len(p), mix(np.array([dims * 1000 + t], U64))[0])
        for d in range(plan.depth):
            step = np.floor((p[:, t * plan.width + d].astype(float) + edges[t, d]) / width).astype(np.int64)
            name = mix(name * U64(0x9E3779B97F4A7C15) + step.astype(U64))
        out[:, t] = name
    return out


def _batches(lists: pa.Array):
    """Rows and vectors of each length."""
    size = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy().astype(float)
    start = np.cumsum(size) - size
    for dims in np.unique(size):
        rows = np.flatnonzero(size == dims)
        yield rows, flat[start[rows][:, None] + np.arange(dims)]


def _counted(classes: DataFrame, plan: Plan, least: float, seed: int) -> DataFrame:
    """(tab, cell, n): how many classes of a batch are in each cell."""

    def run(batches):
        for b in batches:
            for _, v in _batches(b.column("vector")):
                cells = _cells(_projected(v, plan, seed), plan, v.shape[1], least, seed)
                for t in range(plan.tables):
                    cell, n = np.unique(cells[:, t], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(cell), t, np.int32)), pa.array(cell.view(np.int64)), pa.array(n.astype(np.int64))], names=["tab", "cell", "n"]
                    )

    return classes.select("vector").mapInArrow(run, "tab int, cell long, n long")


def _placed(classes: DataFrame, plan: Plan, least: float, seed: int, large: dict[int, dict[int, int]], buckets: int, rounds: int, turn: int) -> DataFrame:
    """The rows of a round: bucket, tab, cell, meet (a pair of chunks), side (0, 1, or 2 for a chunk with itself), class_id, size,
    vector. ``large`` has the number of chunks of each cell of a table that is cut.
    """
    names = ["bucket", "tab", "cell", "meet", "side", "class_id", "size", "vector"]

    def run(batches):
        known = {t: (np.array(sorted(x), np.int64), np.array([x[c] for c in sorted(x)], np.int64)) for t, x in large.items()}
        for b in batches:
            ids, lists = b.column("class_id").to_numpy(), b.column("vector")
            for rows, v in _batches(lists):
                cells = _cells(_projected(v, plan, seed), plan, v.shape[1], least, seed).view(np.int64)
                for t in range(plan.tables):
                    cell = cells[:, t]
                    chunks = np.ones(len(rows), np.int64)
                    if t in known:
                        place = np.minimum(np.searchsorted(known[t][0], cell), len(known[t][0]) - 1)
                        chunks = np.where(known[t][0][place] == cell, known[t][1][place], 1)
                    own = (mix(ids[rows].astype(U64) + U64(t + 1)) % chunks.astype(U64)).astype(np.int64)
                    # a chunk meets itself and every other chunk of its cell
                    who = np.repeat(np.arange(len(rows)), chunks)
                    other, mine = ranges(chunks), own[who]
                    meet = np.minimum(mine, other) << 32 | np.maximum(mine, other)
                    side = np.where(mine == other, 2, (mine > other).astype(np.int64))
                    group = mix(cell[who].view(U64) + mix(meet.astype(U64) + U64(t)))
                    bucket = (group % U64(buckets)).astype(np.int64)
                    use = np.flatnonzero(bucket % rounds == turn)
                    who = who[use]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(bucket[use].astype(np.int32)), pa.array(np.full(len(use), t, np.int32)), pa.array(cell[who]), pa.array(meet[use]),
                            pa.array(side[use].astype(np.int32)), pa.array(ids[rows[who]]), b.column("size").take(pa.array(rows[who])), lists.take(pa.array(rows[who])),
                        ],
                        names=names,
                    )

    kind = classes.schema["vector"].dataType.simpleString()
    return classes.select("class_id", "size", "vector").mapInArrow(run, f"bucket int, tab int, cell long, meet long, side int, class_id long, size long, vector {kind}")


def _local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest node of each node's component."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, root, new)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _pairs(group: np.ndarray, side: np.ndarray, line: np.ndarray, w: float):
    """Blocks of pairs (i, j) of rows of one group whose places on the line are at most ``w`` apart, each pair once."""
    by = np.lexsort((line, group))
    # groups one after the other on one line, further apart than any window
    gap = 2 * (float(np.abs(line).max()) + w) + 1
    key = group * gap + line
    points = by[side[by] != 0]
    queries = by[side[by] != 1]
    at = key[points]
    reach = w + 1e-9 * gap * (group.max() + 1)
    hi = np.searchsorted(at, key[queries] + reach, "right")
    lo = np.searchsorted(at, key[queries] - reach, "left")
    place = np.empty(len(key), np.int64)
    place[points] = np.arange(len(points))
    whole = side[queries] == 2
    lo[whole] = place[queries[whole]] + 1
    total = np.cumsum(hi - lo)
    begin = 0
    while begin < len(queries):
        end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + PAIR_BLOCK, "right")))
        many = hi[begin:end] - lo[begin:end]
        i = np.repeat(queries[begin:end], many)
        j = points[np.repeat(lo[begin:end], many) + ranges(many)]
        begin = end
        use = (group[i] == group[j]) & (np.abs(line[i] - line[j]) <= w)
        yield i[use], j[use]


def _meet(plan: Plan, least: float, seed: int):
    """Function of a bucket of cells: links per class and edges of local components."""

    def one(table: pa.Table, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        tab, cell, meet, side, ids, size = (table.column(c).to_numpy() for c in ("tab", "cell", "meet", "side", "class_id", "size"))
        n, dims = vectors.shape
        proj = _projected(vectors, plan, seed)
        cells = _cells(proj, plan, dims, least, seed)
        vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
        norm = np.sqrt((vectors * vectors).sum(axis=1))
        w = _window(dims, least)
        lines = np.ascontiguousarray(proj[:, plan.depth : plan.tables * plan.width : plan.width].T.astype(float))
        counted = np.ascontiguousarray(proj[:, plan.directions - COUNTED :].T.astype(float))
        by = np.lexsort((meet, cell, tab))
        new = np.ones(n, bool)
        new[1:] = (tab[by[1:]] != tab[by[:-1]]) | (cell[by[1:]] != cell[by[:-1]]) | (meet[by[1:]] != meet[by[:-1]])
        group = np.empty(n, np.int64)
        group[by] = np.cumsum(new) - 1
        links = np.zeros(n, np.int64)
        root = np.arange(n)
        for i, j in _pairs(group, side, lines[tab, np.arange(n)], w):
            use = ids[i] != ids[j]
            i, j = i[use], j[use]
            missed = np.zeros(len(i), np.int8)
            for line in counted:
                missed += np.abs(line[i] - line[j]) > w
                use = missed <= COUNTED - plan.count
                i, j, missed = i[use], j[use], missed[use]
            cosine = np.empty(len(i))
            for at in range(0, len(i), 65536):
                a, b = i[at : at + 65536], j[at : at + 65536]
                cosine[at : at + 65536] = (vectors[a] * vectors[b]).sum(axis=1) / (norm[a] * norm[b])
            use = cosine >= least
            i, j = i[use], j[use]
            first = np.ones(len(i), bool)
            for t in range(plan.tables - 1):
                # whether table t, an earlier one, holds the pair as well
                first &= ~((tab[i] > t) & (cells[i, t] == cells[j, t]) & (np.abs(lines[t, i] - lines[t, j]) <= w))
            for a, b in ((i[first], j[first]), (j[first], i[first])):
                links += np.bincount(a, size[b], minlength=n).astype(np.int64)
            root = _local_roots(n, np.concatenate([np.arange(n), i]), np.concatenate([root, j]))
        return ids, ids[root], links

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        out = [one(table.take(pa.array(rows)), v) for rows, v in _batches(table.column("vector").combine_chunks())]
        ids, other, links = (np.concatenate(x) for x in zip(*out))
        use = (links > 0) | (other != ids)
        return pa.table({"class_id": pa.array(ids[use]), "other": pa.array(other[use]), "links": pa.array(links[use])})

    return run


def near_duplicates(embeddings: DataFrame, least: float = 0.95, recall: float = 0.95, seed: int = 8) -> DataFrame:
    """One row per vector (vec_id, embedding): vec_id, n_links, component_id, kept."""
    given = embeddings.schema["embedding"].dataType
    kept = given.simpleString() if given.simpleString() == "array<float>" else "array<double>"
    vector = F.col("embedding").cast("array<double>")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kept).alias("kept"), vector.alias("vector")).withColumns(
        {"k1": F.xxhash64("vector"), "k2": F.xxhash64(F.lit(1), "vector")}
    )
    sound = F.expr(
        "size(vector) > 0 AND NOT exists(vector, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity')) AND exists(vector, x -> x <> 0)"
    )
    groups = rows.filter(sound).groupBy("k1", "k2").agg(F.first("kept").alias("vector"), F.count("*").alias("size"))
    classes = stage(groups.withColumn("class_id", F.monotonically_increasing_id()), "classes")
    n = classes.count()
    plan = make_plan(n, recall)
    # the cells to be cut: at most one for CHUNK rows of a table
    hot = _counted(classes, plan, least, seed).groupBy("tab", "cell").agg(F.sum("n").alias("n")).filter(F.col("n") > CHUNK)
    large: dict[int, dict[int, int]] = {}
    moved = plan.tables * n
    for r in stage(hot, "large_cells").collect():
        large.setdefault(r.tab, {})[r.cell] = -(-r.n // CHUNK)
        moved += r.n * (-(-r.n // CHUNK) - 1)
    rounds = -(-moved // max(ROUND, n)) or 1
    buckets = rounds * max(1, -(-moved // (rounds * BUCKET)))
    found = None
    for turn in range(rounds):
        placed = _placed(classes, plan, least, seed, large, buckets, rounds, turn)
        part = stage(placed.groupBy("bucket").applyInArrow(_meet(plan, least, seed), "class_id long, other long, links long"), "found")
        found = part if found is None else found.unionByName(part)
    links = found.groupBy("class_id").agg(F.sum("links").alias("links"))
    label = components(found.select(F.col("class_id").alias("a"), F.col("other").alias("b")), "vector_components")
    known = classes.select("k1", "k2", "class_id", "size").join(links, "class_id", "left").join(label.withColumnRenamed("node", "class_id"), "class_id", "left")
    known = known.select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("label", "class_id").alias("label"))
    ids = rows.select("vec_id", "k1", "k2", F.coalesce(sound, F.lit(False)).alias("sound"))
    joined = stage(ids.join(known, F.col("sound") & (ids.k1 == known.k1) & (ids.k2 == known.k2), "left").select("vec_id", "n_links", "label"), "linked")
    least_id = joined.filter("label IS NOT NULL").groupBy("label").agg(F.min("vec_id").alias("component_id"))
    out = joined.join(least_id, "label", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("label").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
    )
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
