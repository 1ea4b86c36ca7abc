"""Hard-negative mining (operator 13): exact integer scores by residues, then windows of the sorted scores.

Components become whole numbers, and a score is an integer inner product. It is computed modulo several small primes:
residues lie within half a prime of 0, so that float32 products and sums of a run of columns stay below 2^24 and a float32
matrix product is exact. The residues of a score give it back by Chinese remaindering, sign included; there are as many
primes as the largest possible score asks for.

1. Rows are dealt into chunks by their place in the stored table, anchors into blocks, both of bounded bytes. A cell is a
   chunk with a block, and each cell is one group; values decide nothing, so hot labels and repeated rows are spread.
2. Every cell keeps the best rows of each anchor's label; a ranking over the cells' answers gives the positives.
3. The anchors meet the chunks again with the scores of their positives. For each positive a cell keeps the first rows of
   other labels in the window of scores; a ranking over the answers gives the negatives.

A cell answers with a few rows an anchor, so what is shuffled are the chunks and the answers, never all pairs. Cells are
tasks over stored rows, and a lost one is run again.

Defined cases: rows without an id, label or vector, or with a NULL or non-finite component, take no part, nor do those
whose integer components have squares adding up to 2^53 or more, as multiples of their scores need not fit 64 bits. Scores
exist between vectors of equal length only; empty vectors have score 0 with each other. Ties go by the smaller id. A row is
never its own partner, nor are rows with the anchor's id; other repeated rows count each, equal anchor rows count once, and
different anchor rows with one id answer each for itself. A positive with a negative score has an empty window. An empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridership.session import stage

POSITIVES = 5
NEGATIVES = 3
CHUNK_BYTES = 16 << 20  # of the integers of a chunk
ANCHOR_ROWS = 64  # anchors that are scored at once within a cell
EXACT = 1 << 24  # up to here float32 holds every whole number
MOST_SQUARES = 1 << 53
PRIME_LIMIT = 256


def primes(bound: int, below: int = PRIME_LIMIT) -> list[int]:
    """The largest primes under ``below`` whose product is more than twice ``bound``."""
    out, product, n = [], 1, below
    while product <= 2 * bound + 1:
        n -= 1
        if n < 2:
            raise ValueError("not enough small primes")
        if all(n % k for k in range(2, int(n**0.5) + 1)):
            out.append(n)
            product *= n
    return out


def _residues(x: np.ndarray, p: int) -> np.ndarray:
    """Residues as float32 between -p/2 and p/2."""
    r = x % p
    return (r - p * (r > p // 2)).astype(np.float32)


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two int64 matrices, exact, by products modulo small primes.

    The squares of a row add up to less than 2^53, so scores and the product of the primes fit 64 bits.
    """
    if not a.shape[1] or not len(a) or not len(b):
        return np.zeros((len(a), len(b)), np.int64)
    squares = [int(np.square(x.astype(np.float64)).sum(axis=1).max()) for x in (a, b)]
    # by Cauchy and Schwarz, with room for the rounding of the squares
    moduli = primes(int((squares[0] + 1) ** 0.5 * (squares[1] + 1) ** 0.5 * (1 + 1e-9)) + 1)
    out = scale = None
    for p in moduli:
        ra, rb = _residues(a, p), _residues(b, p)
        run = EXACT // (p // 2) ** 2  # columns whose sum is exact
        r = np.zeros((len(a), len(b)), np.int64)
        for lo in range(0, a.shape[1], run):
            r += (ra[:, lo : lo + run] @ rb[:, lo : lo + run].T).astype(np.int64) % p
        r %= p
        if out is None:
            out, scale = r, p
        else:
            # the next digit of the score to the mixed base of the primes
            out += scale * (((r - out) % p) * pow(scale, -1, p) % p)
            scale *= p
    out -= scale * (out > scale // 2)
    return out


def _matrices(table: pa.Table, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of vectors of a length, and their components."""
    lists = table.column("ints").combine_chunks()
    at = lists.offsets.to_numpy()
    rows = np.flatnonzero(np.diff(at) == length)
    flat = lists.values.to_numpy(zero_copy_only=False)
    return rows, flat[at[rows][:, None] + np.arange(length)].astype(np.int64)


def _by_cell(pick: Callable[[dict[str, np.ndarray], np.ndarray, dict[str, np.ndarray], np.ndarray], list[tuple]], names: list[str]):
    """A function of a cell's anchors and rows: scores of equal lengths in blocks, given to ``pick`` anchor by anchor."""

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        found: list[tuple] = []
        # rows in the order of ids, so that a stable sort leaves ties by id
        rows = rows.sort_by("vec_id")
        lengths = np.unique(np.diff(anchors.column("ints").combine_chunks().offsets.to_numpy())) if len(anchors) else []
        for length in lengths:
            who, a = _matrices(anchors, int(length))
            which, b = _matrices(rows, int(length))
            if not len(which):
                continue
            own = {c: rows.column(c).to_numpy()[which] for c in ("vec_id", "label")}
            for lo in range(0, len(who), ANCHOR_ROWS):
                scores = exact_scores(a[lo : lo + ANCHOR_ROWS], b)
                part = anchors.take(pa.array(who[lo : lo + ANCHOR_ROWS]))
                these = {c: part.column(c).to_pylist() for c in part.column_names if c != "ints"}
                for i in range(len(part)):
                    found += pick({c: v[i] for c, v in these.items()}, scores[i], own)
        return pa.table({c: pa.array([int(f[k]) for f in found], pa.int64()) for k, c in enumerate(names)})

    return run


def _best(score: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The first ``k`` of the rows ``at`` by score downwards, ties in their order."""
    if len(at) > 4 * k:
        at = at[score[at] >= np.partition(score[at], len(at) - k)[len(at) - k]]
    return at[np.argsort(-score[at], kind="stable")[:k]]


def _cells(anchors: DataFrame, rows: DataFrame, run: Callable, schema: str) -> DataFrame:
    return anchors.groupBy("cell", "part").cogroup(rows.groupBy("cell", "part")).applyInArrow(run, schema)


def mine(
    vectors: DataFrame,
    anchor: Column,
    label: Column | None = None,
    scale: int = 256,
    window: tuple[int, int] = (50, 95),
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """Per anchor and positive the hardest negatives: anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score.

    ``anchor`` says which rows of ``vectors`` (vec_id, embedding, label) are anchors, ``label`` gives their label,
    ``window`` holds the least and the greatest score of a negative in percent of the positive's.
    """
    x = F.col("embedding").cast("array<double>")
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    ints = F.transform(x, lambda v: F.floor(v * scale))
    # a component out of reach of 64 bits is seen before it becomes a whole number
    reach = F.forall(x, lambda v: F.abs(v * scale) < float(MOST_SQUARES) ** 0.5)
    given = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), (F.col("label") if label is None else label).cast("long").alias("label"),
        F.when(sound & reach, ints).alias("ints"), F.coalesce(anchor, F.lit(False)).alias("anchor"),
    )
    rows = stage(given.dropna(subset=["vec_id", "label", "ints"]).filter(F.aggregate("ints", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")) < float(MOST_SQUARES)), "vectors")
    size = rows.agg(F.sum(F.size("ints") * 8 + 16).alias("all"), F.sum(F.when(F.col("anchor"), F.size("ints") * 8 + 16)).alias("own")).first()
    chunks, blocks = ((n or 0) // chunk_bytes + 1 for n in size)
    chunks = max(chunks, vectors.sparkSession.sparkContext.defaultParallelism)  # work for every core
    dealt = lambda place, n: F.pmod(F.xxhash64(place), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # a cell is (chunk of rows, block of anchors)
    met = rows.select("vec_id", "label", "ints", dealt(F.monotonically_increasing_id(), chunks).alias("cell"), every(blocks).alias("part"))
    anchors = rows.filter("anchor").select("vec_id", "label", "ints").distinct()
    anchors = stage(anchors.withColumn("anchor", F.xxhash64("vec_id", "label", "ints")), "anchors")
    asked = anchors.select("anchor", "vec_id", "label", "ints", every(chunks).alias("cell"), dealt(F.col("anchor"), blocks).alias("part"))

    def pick_positives(a, score, own):
        at = np.flatnonzero((own["label"] == a["label"]) & (own["vec_id"] != a["vec_id"]))
        return [(a["anchor"], a["vec_id"], own["vec_id"][i], score[i]) for i in _best(score, at, positives)]

    names = ["anchor", "anchor_id", "positive_id", "positive_score"]
    best = _cells(asked, met, _by_cell(pick_positives, names), ", ".join(f"{c} long" for c in names))
    order = Window.partitionBy("anchor", "anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    best = best.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= positives)
    least, most = window
    # whole numbers s with least * p <= 100 * s <= most * p
    bounds = best.withColumns({
        "low": F.expr(f"({least} * positive_score - pmod({least} * positive_score, 100L)) div 100 + cast(pmod({least} * positive_score, 100L) > 0 as long)"),
        "high": F.expr(f"({most} * positive_score - pmod({most} * positive_score, 100L)) div 100"),
    })
    wanted = bounds.filter("low <= high").groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("place", "positive_id", "positive_score", "low", "high"))).alias("windows"))
    wanted = stage(anchors.join(wanted, "anchor"), "windows")

    def pick_negatives(a, score, own):
        windows = a["windows"]
        other = np.flatnonzero((own["label"] != a["label"]) & (score >= min(w["low"] for w in windows)) & (score <= max(w["high"] for w in windows)))
        other = other[np.argsort(-score[other], kind="stable")]
        falling = -score[other]
        out = []
        for w in windows:
            first = np.searchsorted(falling, -w["high"], "left")
            for i in other[first : first + negatives]:
                if score[i] >= w["low"]:
                    out.append((a["anchor"], a["vec_id"], w["place"], w["positive_id"], own["vec_id"][i], w["positive_score"], score[i]))
        return out

    names = ["anchor", "anchor_id", "place", "positive_id", "negative_id", "positive_score", "negative_score"]
    asked = wanted.select("anchor", "vec_id", "label", "ints", "windows", every(chunks).alias("cell"), dealt(F.col("anchor"), blocks).alias("part"))
    hard = _cells(asked, met, _by_cell(pick_negatives, names), ", ".join(f"{c} long" for c in names))
    order = Window.partitionBy("anchor", "anchor_id", "place").orderBy(F.desc("negative_score"), "negative_id")
    hard = hard.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    return hard.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
