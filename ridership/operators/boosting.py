"""Boosted trees with softmax loss (M2-M4, M7): many models fitted side by side, each on a bounded number of rows.

A fit takes first- and second-order gradients of the softmax loss, sums them per node and bin of a feature, and splits where
the regularised gain is highest. A number has a bin per value up to ``VALUES`` values, else ``BINS`` bins at its quantiles; a category has a bin per value and is split
as one value against the others, which is what a one-hot column allows. Of two children, the one with fewer rows is summed and
the other is what it leaves of the parent. One task fits one model, on at most ``fit_rows`` rows
in a seeded order, a documented bound; every row is scored. Fitted models are rows of a DataFrame that hold all a score needs:
columns in order, values of the categories, edges of the bins, trees and classes. Writing the table saves the models.

Rows without a label or with a NULL number are left out of fits, and their prediction is NULL. A NULL category is a value of its
own; one that the fit has not seen counts as "another". Without rows there is no model and no prediction. Of equal gains the
first feature and bin win, of equal scores the lowest class.
"""

from __future__ import annotations

import itertools
import random
import sys
from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridership.functions.bins import adjust_bins
from ridership.operators.models import Features, prepare_classes
from ridership.operators.ordered import top_k
from ridership.operators.split import stratified_kfold
from ridership.session import stage

# the functions of this module travel to the executors by value
cloudpickle.register_pickle_by_value(sys.modules[__name__])

VALUES, BINS = 32, 16
FIT_ROWS, SEARCH_ROWS = 4_000, 600
PIECE_ROWS = 50_000
# weight of the squared leaf values, least sum of second-order gradients in a leaf
RIDGE, LEAST = 1.0, 1.0
SETTING = ("max_depth", "n_estimators", "learning_rate", "gamma")
MODEL = (
    "classes array<int>, columns array<string>, categories array<array<string>>, edges array<array<double>>, "
    "feature array<int>, cut array<int>, child array<int>, value array<double>, roots array<int>"
)


class _Codes:
    """Features of a batch as numbers of bins, counted over all features."""

    def __init__(self, categorical: Sequence[str], numbers: Sequence[str], categories: Sequence, edges: Sequence):
        self.categorical, self.numbers = categorical, numbers
        self.categories, self.edges = [list(v) for v in categories], [np.asarray(e, float) for e in edges]
        widths = [len(v) for v in self.categories] + [len(e) + 1 for e in self.edges]
        self.start = np.concatenate([[0], np.cumsum(widths)]).astype(int)
        self.is_category = np.arange(len(widths)) < len(self.categories)
        of_bin = np.repeat(np.arange(len(widths)), widths)
        self.bin_feature, self.bin_is_category, self.bin_start = of_bin, self.is_category[of_bin], self.start[of_bin]

    @classmethod
    def fit(cls, categorical: Sequence[str], numbers: Sequence[str], rows: pd.DataFrame) -> _Codes:
        edges = []
        for c in numbers:
            x = rows[c].to_numpy(float)
            values = np.unique(x)
            if len(values) > VALUES:
                edges.append(np.unique(np.quantile(x, np.arange(1, BINS) / BINS, method="lower")))
            else:
                edges.append((values[:-1] + values[1:]) / 2)
        return cls(categorical, numbers, [sorted(rows[c].unique()) for c in categorical], edges)

    def of(self, rows: pd.DataFrame) -> np.ndarray:
        out = [pd.Index(v).get_indexer(rows[c]) for c, v in zip(self.categorical, self.categories)]
        out += [np.searchsorted(e, rows[c].to_numpy(float)) for c, e in zip(self.numbers, self.edges)]
        # an unseen category has -1, which no cut equals
        return np.stack([np.where(x < 0, -1, x + s) for x, s in zip(out, self.start)], axis=1).reshape(len(rows), len(out))


def _splits(codes: _Codes, g: np.ndarray, h: np.ndarray, whole: slice) -> tuple[np.ndarray, np.ndarray]:
    """Best cut and its gain per node, from sums of the gradients per node and bin."""
    total_g, total_h = g[:, whole].sum(axis=1, keepdims=True), h[:, whole].sum(axis=1, keepdims=True)

    def left(x: np.ndarray, total: np.ndarray) -> np.ndarray:
        run = np.concatenate([np.zeros((len(x), 1)), np.cumsum(x, axis=1)], axis=1)
        return np.where(codes.bin_is_category, total - x, run[:, 1:] - run[:, codes.bin_start])

    lg, lh = left(g, total_g), left(h, total_h)
    rg, rh = total_g - lg, total_h - lh
    gain = lg**2 / (lh + RIDGE) + rg**2 / (rh + RIDGE) - total_g**2 / (total_h + RIDGE)
    gain[(lh < LEAST) | (rh < LEAST)] = -np.inf
    best = gain.argmax(axis=1)
    return best, gain[np.arange(len(gain)), best]


def _boost(codes: _Codes, x: np.ndarray, y: np.ndarray, classes: int, depth: int, rounds: int, rate: float, gamma: float) -> dict:
    """One tree per class and round; the trees of a round grow level by level together."""
    n, bins = len(x), codes.start[-1]
    varied = np.ascontiguousarray(x[:, np.diff(codes.start) > 1])
    width = varied.shape[1]
    if width:
        # the bins of a feature that splits nothing stay empty; node totals come from one that varies
        whole = np.flatnonzero(np.diff(codes.start) > 1)[0]
        whole = slice(codes.start[whole], codes.start[whole + 1])

    def sums(place: np.ndarray, nodes: int) -> list[np.ndarray]:
        """Gradient sums per node and bin, of the entries that have a place."""
        here = place >= 0
        key = (varied[entry[here] // classes] + (place[here] * bins)[:, None]).ravel()
        return [np.bincount(key, np.repeat(w[entry[here]], width), nodes * bins).reshape(nodes, bins) for w in (g, h)]

    margin = np.zeros((n, classes))
    parts, roots, made = [], [], 0
    for _ in range(rounds):
        p = np.exp(margin - margin.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = p.copy()
        g[np.arange(n), y] -= 1.0
        g, h = g.ravel(), np.maximum(2.0 * p * (1.0 - p), 1e-16).ravel()
        # an entry is a row in the tree of a class; ``at`` is its node within the level
        entry, at, nodes = np.arange(n * classes), np.tile(np.arange(classes), n), classes
        roots.extend(range(made, made + classes))
        for level in range(depth + 1):
            sum_g, sum_h = np.bincount(at, g[entry], nodes), np.bincount(at, h[entry], nodes)
            value = -rate * sum_g / (sum_h + RIDGE)
            feature, cut, child = np.full(nodes, -1), np.zeros(nodes, int), np.zeros(nodes, int)
            wide = np.flatnonzero(sum_h >= 2 * LEAST) if level < depth and width else np.empty(0, int)
            if len(wide):
                if level == 0:
                    own = sums(at, nodes)
                else:
                    rows = np.bincount(at, minlength=nodes).reshape(-1, 2)
                    pairs = np.unique(wide // 2)
                    few = 2 * pairs + (rows[pairs, 1] < rows[pairs, 0])
                    place = np.full(nodes, -1)
                    place[few] = np.arange(len(pairs))
                    own = []
                    for part, parent in zip(sums(place[at], len(pairs)), above):
                        both = np.zeros((nodes, bins))
                        both[few] = part
                        both[few ^ 1] = parent[pairs] - part
                        own.append(both)
                best, gain = _splits(codes, own[0][wide], own[1][wide], whole)
                taken = gain > max(gamma, 1e-6)
                split = wide[taken]
                feature[split], cut[split] = codes.bin_feature[best[taken]], best[taken]
                child[split] = made + nodes + 2 * np.arange(len(split))
                above = [part[split] for part in own]
            parts.append((feature, cut, child, value))
            leaf = feature[at] < 0
            margin.ravel()[entry[leaf]] += value[at[leaf]]
            entry, at = entry[~leaf], at[~leaf]
            if not len(entry):
                made += nodes
                break
            f = feature[at]
            code = x[entry // classes, f]
            right = np.where(codes.is_category[f], code == cut[at], code > cut[at])
            at = child[at] - made - nodes + right
            made += nodes
            nodes = 2 * int((feature >= 0).sum())
    names = ("feature", "cut", "child", "value")
    return {**{k: np.concatenate([p[i] for p in parts]) for i, k in enumerate(names)}, "roots": np.array(roots)}


def _scores(codes: _Codes, x: np.ndarray, model: Mapping, classes: int, block: int = 60) -> np.ndarray:
    """Sum of the leaf values per row and class, some trees at a time."""
    feature, cut, child, value, roots = (np.asarray(model[k]) for k in ("feature", "cut", "child", "value", "roots"))
    out = np.zeros((len(x), classes))
    for lo in range(0, len(roots), block * classes):
        at = np.tile(roots[lo : lo + block * classes], len(x))
        row = np.repeat(np.arange(len(x)), len(at) // len(x))
        # only those not yet in a leaf go on
        live = np.flatnonzero(feature[at] >= 0)
        while len(live):
            here = at[live]
            f = feature[here]
            code = x[row[live], f]
            at[live] = child[here] + np.where(codes.is_category[f], code == cut[here], code > cut[here])
            live = live[feature[at[live]] >= 0]
        out += value[at].reshape(len(x), -1, classes).sum(axis=1)
    return out


def _numbers(features: Features) -> tuple[str, ...]:
    return (*features.ordinal, *features.numeric)


def _known(features: Features) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in _numbers(features)], F.lit(True))


def _inputs(features: Features) -> list[Column]:
    """Categories as text, numbers as doubles, under the names that a fit and a score read."""
    text = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")).alias(f"_x_{c}") for c in features.categorical]
    return [*text, *[F.col(c).cast("double").alias(f"_x_{c}") for c in _numbers(features)]]


def _names(features: Features) -> tuple[list[str], list[str]]:
    return [f"_x_{c}" for c in features.categorical], [f"_x_{c}" for c in _numbers(features)]


def fit_boosted(
    rows: DataFrame, features: Features, settings: DataFrame, by: Sequence[str], label: str = "y_class", models: int | None = None
) -> DataFrame:
    """A model per row of ``settings`` (columns ``by`` and ``SETTING``), fitted on the rows with equal ``by``.

    ``rows`` are the rows of the fits, bounded by the caller (``fit_sample``). ``models`` says how many models there are, so
    that each gets a task of its own.
    """
    categorical, numbers = _names(features)
    columns = [*categorical, *numbers]

    def run(part: pd.DataFrame) -> pd.DataFrame:
        # one order of the rows, whatever order the shuffle gives
        part = part.sort_values([*columns, "_y"], kind="stable")
        setting = part.iloc[0]
        codes = _Codes.fit(categorical, numbers, part)
        classes, y = np.unique(part["_y"].to_numpy(), return_inverse=True)
        fitted = _boost(
            codes, codes.of(part), y, len(classes), int(setting["max_depth"]), int(setting["n_estimators"]),
            float(setting["learning_rate"]), float(setting["gamma"]),
        )
        own = {c: [setting[c]] for c in (*by, *SETTING)}
        state = {"classes": [classes], "columns": [[c[3:] for c in columns]], "categories": [codes.categories], "edges": [codes.edges]}
        return pd.DataFrame({**own, **state, **{k: [v] for k, v in fitted.items()}})

    known = rows.filter(F.col(label).isNotNull() & _known(features))
    data = known.select(*by, F.col(label).cast("int").alias("_y"), *_inputs(features)).join(F.broadcast(settings), list(by))
    if models:
        # ranges part models of equal size evenly, where hashes would put some together; a stated number keeps the adaptive
        # planner from joining the small partitions
        data = data.repartitionByRange(2 * models, *by)
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for c in (*by, *SETTING) for f in settings.schema.fields if f.name == c)
    return data.groupBy(*by).applyInPandas(run, f"{types}, {MODEL}")


def fit_sample(df: DataFrame, features: Features, by: Sequence[str], rows: int, label: str = "y_class", seed: int = 100) -> DataFrame:
    """At most ``rows`` labelled rows per group in a seeded order, the documented bound on a fit."""
    chosen = df.filter(F.col(label).isNotNull() & _known(features))
    used = list(dict.fromkeys([*by, *features.categorical, *_numbers(features), label]))
    chosen = chosen.select(*used)
    # plain columns: casts of them would multiply the planner's constraints on the hash
    columns = [F.col(c) for c in used]
    return top_k(chosen, list(by), [F.xxhash64(F.lit(seed), *columns), *columns], rows)


def predict_boosted(
    models: DataFrame, df: DataFrame, features: Features, by: Sequence[str], name: str = "y_pred", piece_rows: int = PIECE_ROWS,
    tasks: int | None = None,
) -> DataFrame:
    """All rows with the class of the model that has their ``by``.

    The rows are dealt into pieces of about ``piece_rows``; each piece meets its own copy of a model, so no task holds all rows
    of a model. ``tasks`` is for small tables with many models, which the adaptive planner would join into one task.
    """
    categorical, numbers = _names(features)
    wanted, given = [c[3:] for c in (*categorical, *numbers)], df.columns

    def run(part: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        answer = pd.Series([None] * len(part), index=part.index, dtype="Int32")
        known = part["_known"].to_numpy(bool) if len(part) else np.zeros(0, bool)
        if len(model) and known.any():
            state = model.iloc[0]
            if list(state["columns"]) != wanted:
                raise ValueError(f"the model was fitted on {list(state['columns'])}")
            codes = _Codes(categorical, numbers, state["categories"], state["edges"])
            classes = np.asarray(state["classes"])
            best = _scores(codes, codes.of(part[known]), state, len(classes)).argmax(axis=1)
            answer[known] = classes[best]
        return part[given].assign(**{name: answer})

    pieces = F.greatest(F.ceil(df.agg(F.count(F.lit(1))).scalar() / F.lit(piece_rows)), F.lit(1)).cast("int")
    place = F.pmod(F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema.fields if not _has_map(f.dataType)]), pieces).cast("int")
    rows = df.select("*", *_inputs(features), _known(features).alias("_known"), place.alias("_piece"))
    copies = models.withColumn("_piece", F.explode(F.sequence(F.lit(0), pieces - 1)))
    keys = [*by, "_piece"]
    if tasks:
        rows, copies = rows.repartition(tasks, *keys), copies.repartition(tasks, *keys)
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.IntegerType())])
    return rows.groupBy(*keys).cogroup(copies.groupBy(*keys)).applyInPandas(run, schema)


def _has_map(t: T.DataType) -> bool:
    if isinstance(t, T.StructType):
        return any(_has_map(f.dataType) for f in t.fields)
    return isinstance(t, T.MapType) or (isinstance(t, T.ArrayType) and _has_map(t.elementType))


def one_setting(df: DataFrame, by: Mapping[str, Sequence[str]], max_depth: int, n_estimators: int, learning_rate: float, gamma: float) -> DataFrame:
    """A settings table of the same setting for every value of one key."""
    ((key, values),) = by.items()
    rows = [(v, max_depth, n_estimators, learning_rate, gamma) for v in values]
    return df.sparkSession.createDataFrame(rows, f"{key} string, max_depth int, n_estimators int, learning_rate double, gamma double")


def cascade_halves(df: DataFrame, target: str = "y_reg100") -> DataFrame:
    """The rows of both cascade models (M2): ``half`` low with classes 0 to 2, high with the split top class less 2."""
    three, _ = prepare_classes(df, target)
    five = three.withColumn("y_class", adjust_bins(target, "y_class"))
    top = five.filter(F.col("y_class") >= 2).withColumn("y_class", F.col("y_class") - 2)
    return three.withColumn("half", F.lit("low")).unionByName(top.withColumn("half", F.lit("high"))).filter(F.col("y_class").isNotNull())


def fit_boosted_cascade(
    df: DataFrame,
    features: Features,
    target: str = "y_reg100",
    max_depth: int = 6,
    n_estimators: int = 100,
    learning_rate: float = 0.3,
    gamma: float = 0.0,
    fit_rows: int = FIT_ROWS,
    seed: int = 100,
) -> DataFrame:
    """Both models of the cascade (M2) as a table of two rows, stored so that every score reads the same trees."""
    rows = stage(fit_sample(cascade_halves(df, target), features, ["half"], fit_rows, seed=seed), "fit_rows")
    settings = one_setting(df, {"half": ["low", "high"]}, max_depth, n_estimators, learning_rate, gamma)
    return stage(fit_boosted(rows, features, settings, ["half"], models=2), "boosted")


def predict_boosted_cascade(models: DataFrame, df: DataFrame, features: Features) -> DataFrame:
    """The second model's answer plus 2 replaces the first one's class 2 (M2)."""
    low = predict_boosted(models, df.withColumn("half", F.lit("low")), features, ["half"], "_low")
    both = predict_boosted(models, low.withColumn("half", F.lit("high")), features, ["half"], "_high")
    answer = F.when(F.col("_low") == 2, F.col("_high") + 2).otherwise(F.col("_low"))
    return both.select(*df.columns, answer.cast("int").alias("y_pred"))


def save_models(models: DataFrame, path: str) -> None:
    """Write fitted models with their columns, categories and edges (M7)."""
    models.write.mode("overwrite").parquet(path)


def load_models(like: DataFrame, path: str) -> DataFrame:
    """Models written by ``save_models``, in the session of ``like``."""
    return like.sparkSession.read.parquet(path)


def draw_settings(space: Mapping[str, Sequence], n: int, seed: int = 100) -> list[dict]:
    """``n`` different settings of a grid (all, if fewer)."""
    every = [dict(zip(space, values)) for values in itertools.product(*space.values())]
    return random.Random(seed).sample(every, min(n, len(every)))


def random_search(
    df: DataFrame,
    features: Features,
    space: Mapping[str, Sequence],
    keys: Sequence[str],
    n_iter: int = 5,
    folds: int = 5,
    seed: int = 100,
    fit_rows: int = SEARCH_ROWS,
    by: str = "half",
    values: Sequence[str] = ("low", "high"),
) -> DataFrame:
    """Random settings scored by stratified cross-validation, for every one of the ``values`` of ``by`` (M4).

    ``df`` has ``y_class``; folds are dealt by class within each value of ``by``, the models of all settings and folds are
    fitted side by side, and each row is scored once per setting by the model that has not seen its fold. Returns per ``by``
    and setting: ``draw``, the parameters, the mean ``accuracy`` of the folds, the ``rows`` scored and the ``place`` (1 for
    the best; of equal ones the draw that came first).
    """
    grid = draw_settings(space, n_iter, seed)
    labelled = df.filter(F.col("y_class").isNotNull() & _known(features)).withColumn("_stratum", F.concat_ws("|", by, "y_class"))
    folded = stage(stratified_kfold(labelled, "_stratum", keys, folds, seed).drop("_stratum"), "folds")
    rows_of = [
        (v, i, k, *[kind(s[p]) for p, kind in zip(SETTING, (int, int, float, float))])
        for v in values for i, s in enumerate(grid) for k in range(folds)
    ]
    kinds = f"{by} string, draw int, kfold int, max_depth int, n_estimators int, learning_rate double, gamma double"
    settings = df.sparkSession.createDataFrame(rows_of, kinds)
    # the fit of a fold takes an equal share of its rows from each of the other folds
    share = max(1, fit_rows // max(1, folds - 1))
    sample = stage(fit_sample(folded, features, [by, "kfold"], share, seed=seed), "fit_rows")
    others = F.filter(F.array(*[F.lit(k) for k in range(folds)]), lambda k: k != F.col("kfold"))
    draws = F.array(*[F.lit(i) for i in range(len(grid))])
    rows = sample.withColumn("kfold", F.explode(others)).withColumn("draw", F.explode(draws))
    models = stage(fit_boosted(rows, features, settings, [by, "draw", "kfold"], models=len(rows_of)), "boosted")
    asked = folded.withColumn("draw", F.explode(draws))
    scored = predict_boosted(models, asked, features, [by, "draw", "kfold"], tasks=4 * len(rows_of))
    hits = scored.groupBy(by, "draw", "kfold").agg(F.avg((F.col("y_pred") == F.col("y_class")).cast("double")).alias("_share"), F.count(F.lit(1)).alias("_n"))
    out = hits.groupBy(by, "draw").agg(F.avg("_share").alias("accuracy"), F.sum("_n").alias("rows"))
    out = out.join(F.broadcast(settings.select("draw", *SETTING).distinct()), "draw")
    ahead = out.groupBy(by).agg(F.array_sort(F.collect_list(F.struct((-F.col("accuracy")).alias("a"), F.col("draw").alias("d")))).alias("_order"))
    place = F.array_position(F.transform("_order", lambda s: s["d"]), F.col("draw")).cast("int")
    return out.join(ahead, by).select(by, "draw", *SETTING, "accuracy", "rows", place.alias("place"))
