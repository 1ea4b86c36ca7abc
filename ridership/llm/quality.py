"""Quality classifier (operator 9): document evidence combined with what hosts and paths show.

1. Two logistic models, for ``quality`` and for ``toxic``, are fitted on at most ``max_labelled`` labelled documents
   (those first in a seeded order): hashed words and word stems that
   tell the classes apart, once per document, and a few measures of style. Each document's whole text is scored; the chance that it is good is P(quality) * (1 - P(toxic)).
2. Empirical Bayes over all documents: the global rate is the prior of the hosts, a host's posterior the prior of its
   paths. How strongly a site is drawn to its prior comes from the data: the spread of the sites' means beyond what
   their sizes explain (method of moments). Sparse sites stay near their prior. All of it is grouped sums.
3. A document's log odds are those of its path plus its own evidence (its log odds less those of the global rate); it is
   kept where the chance is at least ``threshold``.

Host and path are columns; the documents' source and language take their place here.

Defined cases: a NULL text is empty and is scored by its measures alone; a NULL host or path is a site of its own; repeated rows
are scored each; NULL labels are not used, several labels of a document count as the worst; without both classes among
the labels a model gives 0.5 to all; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridership.llm.common import small_batches
from ridership.llm.text import LOWER, slices, spans_hash, words
from ridership.session import stage

DIMS = 1 << 18
STYLE = 6
STEMS = (4, 5)  # bytes
TELLING = 15.0  # likelihood ratio that a word or stem must reach
MAX_LABELLED = 8_000
BLOCK = 1 << 18  # words and stems that the fit looks at together while it chooses among them


def features(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each run of texts: first row, (row, hash) of the distinct words and stems, and the style of each row."""
    for first, data, off in slices(texts):
        rows = len(off) - 1
        start, end, row = words(data, off)
        lower = LOWER[data]
        h = spans_hash(lower, start, end)
        hashes, owners = [h], [row]
        for n in STEMS:
            long = np.flatnonzero(end - start > n)
            hashes.append(spans_hash(lower, start[long], start[long] + n) ^ np.uint64(n))
            owners.append(row[long])
        code = np.unique(np.concatenate(owners) * DIMS + (np.concatenate(hashes) % np.uint64(DIMS)).astype(np.int64))
        exact = np.unique(row.astype(np.uint64) << np.uint64(40) | h >> np.uint64(24))
        size = np.maximum(np.diff(off), 1)
        n = np.bincount(row, minlength=rows)

        def share(mask: np.ndarray) -> np.ndarray:
            return np.diff(np.concatenate([[0], np.cumsum(mask)])[off]) / size  # noqa: B023

        upper = (data >= 65) & (data <= 90)
        letter = upper | ((data >= 97) & (data <= 122)) | (data >= 128)
        digit = (data >= 48) & (data <= 57)
        sign = ~letter & ~digit & (data > 32)
        distinct = np.bincount((exact >> np.uint64(40)).astype(np.int64), minlength=rows)
        style = np.stack(
            [share(upper), share(digit), share(sign), share(data == 10), distinct / np.maximum(n, 1), np.log1p(n) / 10], axis=1
        )
        yield first, code // DIMS, code % DIMS, style * 4


@dataclass(frozen=True)
class Model:
    """Weights of hashed words and of the style measures, and the constant."""

    word: np.ndarray
    style: np.ndarray
    bias: float

    def log_odds(self, row: np.ndarray, dim: np.ndarray, style: np.ndarray) -> np.ndarray:
        return np.bincount(row, self.word[dim], minlength=len(style)) + style @ self.style + self.bias


def fit(row: np.ndarray, dim: np.ndarray, style: np.ndarray, y: np.ndarray, steps: int = 300, l2: float = 1e-5) -> Model:
    """Logistic regression on the measures of style and on the words that tell the classes apart.

    A word counts if its likelihood ratio against the label passes ``TELLING``; accelerated gradient steps start from half
    its log odds. All-equal labels give the even model.
    """
    n = len(y)
    model = Model(np.zeros(DIMS), np.zeros(STYLE), 0.0)
    if n == 0 or y.min() == y.max():
        return model
    # in blocks, as few words are telling and the others should not be held several times over on the driver
    blocks = [slice(i, i + BLOCK) for i in range(0, len(dim), BLOCK)]
    seen, hit = np.zeros(DIMS, np.int64), np.zeros(DIMS)
    for at in blocks:
        seen += np.bincount(dim[at], minlength=DIMS)
        hit += np.bincount(dim[at], y[row[at]], minlength=DIMS)
    cells = [(hit, y.sum()), (seen - hit, n - y.sum())]
    ratio = 2 * sum(
        c * np.log(np.maximum(c, 1e-9) * n / (np.maximum(s, 1) * t))
        for k, t in cells
        for c, s in ((k, seen), (t - k, n - seen))
    )
    (in_good, good), (in_bad, bad) = cells
    start = np.where(ratio >= TELLING, 0.5 * np.log((in_good + 0.5) / (good + 1) / ((in_bad + 0.5) / (bad + 1))), 0.0)
    telling = ratio >= TELLING
    use = np.concatenate([np.zeros(0, np.int64), *[at.start + np.flatnonzero(telling[dim[at]]) for at in blocks]])
    row, dim = row[use].astype(np.int64), dim[use].astype(np.int64)
    # per-weight steps by how much each measure varies, so rare words move as fast as common ones
    rate = 4.0 / (np.sqrt(seen / n) + 0.02) / np.sqrt(len(dim) / n + STYLE)
    w, s, b = start, model.style, float(np.log(y.mean() / (1 - y.mean())))
    vw, vs, vb = np.zeros(DIMS), np.zeros(STYLE), 0.0
    for _ in range(steps):
        lead = Model(w + 0.9 * vw, s + 0.9 * vs, b + 0.9 * vb)
        err = (1 / (1 + np.exp(-np.clip(lead.log_odds(row, dim, style), -30, 30))) - y) / n
        vw = 0.9 * vw - rate * (np.bincount(dim, err[row], minlength=DIMS) + l2 * lead.word)
        vs = 0.9 * vs - 0.3 * (style.T @ err + l2 * lead.style)
        vb = 0.9 * vb - 0.3 * err.sum()
        w, s, b = w + vw, s + vs, b + vb
    return Model(w, s, float(b))


def fit_models(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, seed: int = 9) -> tuple[Model, Model]:
    """The models of ``quality`` and ``toxic`` from a bounded sample of labelled documents, fitted on the driver."""
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id")
    known = known.agg(F.min("quality").cast("int").alias("quality"), F.max("toxic").cast("int").alias("toxic"))
    sample = known.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(max_labelled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, row, dim, style in features(b.column("text")):
                cut = np.searchsorted(row, np.arange(len(style) + 1))
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id").slice(first, len(style)),
                        b.column("quality").slice(first, len(style)),
                        b.column("toxic").slice(first, len(style)),
                        pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(dim.astype(np.int32))),
                        pa.FixedSizeListArray.from_arrays(pa.array(style.ravel()), STYLE).cast(pa.list_(pa.float64())),
                    ],
                    names=["doc_id", "quality", "toxic", "dims", "style"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")
    got = rows.mapInArrow(run, "doc_id long, quality int, toxic int, dims array<int>, style array<double>").toArrow()
    got = got.sort_by("doc_id").combine_chunks()
    if not len(got):
        even = Model(np.zeros(DIMS), np.zeros(STYLE), 0.0)
        return even, even
    dims = got.column("dims").combine_chunks()
    row = np.repeat(np.arange(len(got), dtype=np.int32), np.diff(dims.offsets.to_numpy()))
    dim = dims.flatten().to_numpy()
    style = got.column("style").combine_chunks().flatten().to_numpy().reshape(-1, STYLE)
    return tuple(fit(row, dim, style, got.column(c).to_numpy().astype(float)) for c in ("quality", "toxic"))


def evidence(docs: DataFrame, models: tuple[Model, Model], host: Column, path: Column) -> DataFrame:
    """Chance of each whole text being good by the document alone: doc_id, text_key, host, path, p."""
    good, toxic = models

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = np.zeros(b.num_rows)
            for first, row, dim, style in features(b.column("text")):
                q, t = (1 / (1 + np.exp(-np.clip(m.log_odds(row, dim, style), -30, 30))) for m in (good, toxic))
                p[first : first + len(style)] = q * (1 - t)
            yield b.drop_columns(["text"]).append_column("p", pa.array(np.clip(p, 1e-6, 1 - 1e-6)))

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"),
        F.coalesce(host.cast("string"), F.lit("")).alias("host"),
        F.coalesce(path.cast("string"), F.lit("")).alias("path"),
        F.col("text").cast("string").alias("text"),
    )
    return rows.mapInArrow(run, "doc_id long, text_key long, host string, path string, p double")


def _shrink(sites: DataFrame, prior: str) -> Column:
    """Posterior mean of each site (n, s) drawn to the column ``prior`` with a strength from the sites' spread."""
    mean = F.col("s") / F.col("n")
    rate = F.col(prior)
    spread = sites.agg(
        F.sum(F.col("n") * (mean - rate) ** 2).alias("q"),
        F.sum(rate * (1 - rate)).alias("noise"),
        F.sum("n").alias("n"),
        F.sum(F.col("n") * rate * (1 - rate)).alias("v"),
    )
    # E[q] = noise + n * tau^2 ; strength + 1 = rate (1 - rate) / tau^2
    tau = F.greatest(F.try_divide(F.col("q") - F.col("noise"), F.col("n")), F.lit(1e-9))
    strength = spread.select(F.greatest(F.coalesce(F.try_divide(F.col("v"), F.col("n")) / tau - 1, F.lit(1.0)), F.lit(1.0))).scalar()
    return (strength * rate + F.col("s")) / (strength + F.col("n"))


def classify(docs: DataFrame, labels: DataFrame, host: Column, path: Column, threshold: float = 0.5, max_labelled: int = MAX_LABELLED, seed: int = 9) -> DataFrame:
    """doc_id, text_key, host, path, p (document alone), host_rate, path_rate, posterior, keep; one row per document."""
    small_batches(docs)
    scored = stage(evidence(docs, fit_models(docs, labels, max_labelled, seed), host, path), "evidence")
    paths = stage(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s")), "paths")
    rate = paths.agg((F.sum("s") / F.sum("n")).alias("r")).scalar()
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).withColumn("_prior", rate)
    hosts = stage(hosts.select("host", _shrink(hosts, "_prior").alias("host_rate"), F.col("_prior").alias("_all")), "hosts")
    below = paths.join(hosts, "host")
    sites = stage(below.select("host", "path", "host_rate", "_all", _shrink(below, "host_rate").alias("path_rate")), "sites")
    odds = lambda c: F.log(F.col(c) / (1 - F.col(c)))
    out = scored.join(sites, ["host", "path"]).withColumn("_odds", odds("path_rate") + odds("p") - odds("_all"))
    out = out.withColumn("posterior", 1 / (1 + F.exp(-F.col("_odds"))))
    return out.select("doc_id", "text_key", "host", "path", "p", "host_rate", "path_rate", "posterior", (F.col("posterior") >= threshold).alias("keep"))
