"""Occupancy classifiers on Spark ML (M1-M7); the search (M4) and softmax boosting are in ``boosting``."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    MultilayerPerceptronClassifier,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.feature import MinMaxScaler, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridership.functions.bins import CLASS_BINS, TARGET_MAX, Bound, adjust_bins, adjusted_bounds, assign_class
from ridership.operators.basic import cap_target
from ridership.operators.encode import apply_index, fit_categories, index_map, one_hot
from ridership.operators.enrich import concat
from ridership.operators.ordered import top_k
from ridership.operators.quantiles import class_bounds, collect_bounds
from ridership.operators.split import date_split, stratified_kfold
from ridership.session import stage


@dataclass(frozen=True)
class Features:
    """Columns a model sees: one-hot categories, ordinals (indexed in sorted order) and numbers."""

    categorical: tuple[str, ...]
    ordinal: tuple[str, ...]
    numeric: tuple[str, ...]


ROUTE_FEATURES = Features(
    ("route_id_direction", "is_holiday", "dayofweek", "is_school_break", "time_window"),
    ("year", "month", "hour", "day"),
    ("temperature", "humidity", "precipitation_intensity", "scheduled_headway"),
)


def prepare_classes(
    df: DataFrame, target: str = "y_reg100", five: bool = False, strict: bool = True
) -> tuple[DataFrame, list[Bound]]:
    """Cap the target and add ``y_class`` from the data's own percentiles; ``five`` splits the top class (M1)."""
    capped = cap_target(df, target, TARGET_MAX, strict)
    bounds = collect_bounds(class_bounds(capped, target, CLASS_BINS))
    out = capped.withColumn("y_class", assign_class(target, bounds))
    if five:
        out = out.withColumn("y_class", adjust_bins(target, "y_class"))
        bounds = adjusted_bounds(bounds)
    return out, bounds


def prepare_training(
    df: DataFrame, features: Features, target: str = "y_reg100", five: bool = False
) -> tuple[DataFrame, dict[str, list], list[Bound]]:
    """Classes, ordinal indexes and one-hot columns in place of the category columns (M1)."""
    out, bounds = prepare_classes(df, target, five)
    for c in features.ordinal:
        out = apply_index(out, index_map(out, c), c).drop(c)
    categories = fit_categories(out, features.categorical)
    return one_hot(out, categories).drop(*features.categorical), categories, bounds


def feature_stages(features: Features) -> list[Estimator]:
    """One-hot encode the categories and assemble into ``features``.

    Unseen categories get their own slot, ordinals go in as the numbers they are. A NULL number becomes NaN: fits leave such
    rows out, predictions on them are NULL.
    """
    text = [f"{c}_text" for c in features.categorical]
    ix = [f"{c}_ix" for c in features.categorical]
    hot = [f"{c}_hot" for c in features.categorical]
    return [
        StringIndexer(inputCols=text, outputCols=ix, stringOrderType="alphabetAsc", handleInvalid="keep"),
        OneHotEncoder(inputCols=ix, outputCols=hot, dropLast=False),
        VectorAssembler(
            inputCols=[*hot, *features.ordinal, *features.numeric], outputCol="features", handleInvalid="keep"
        ),
    ]


def _known(features: Features) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (*features.ordinal, *features.numeric)], F.lit(True))


def _as_text(df: DataFrame, features: Features) -> DataFrame:
    return df.withColumns({f"{c}_text": F.col(c).cast("string") for c in features.categorical})


def fit_classifier(df: DataFrame, features: Features, classifier: Estimator, label: str = "y_class") -> PipelineModel:
    """Feature stages and a classifier as one pipeline; rows without a label are left out.

    Without any row to fit on the pipeline has no stages; its predictions are NULL.
    """
    rows = _as_text(df.filter(F.col(label).isNotNull() & _known(features)), features).withColumn("label", F.col(label).cast("double"))
    few = len(rows.take(2))
    if not few:
        return PipelineModel(stages=[])
    if few == 1:
        # trees refuse a single row; twice the row is the same fit
        rows = rows.union(rows)
    return Pipeline(stages=[*feature_stages(features), classifier]).fit(rows)


def predict(model: PipelineModel, df: DataFrame, features: Features, name: str = "y_pred") -> DataFrame:
    """The input columns and the predicted class, NULL where a feature is NULL or the fit had no rows."""
    if not model.stages:
        return df.select(*df.columns, F.lit(None).cast("int").alias(name))
    out = model.transform(_as_text(df, features))
    return out.select(*df.columns, F.when(_known(features), F.col("prediction").cast("int")).alias(name))


def fit_forest(df: DataFrame, features: Features, trees: int = 100, depth: int = 8, seed: int = 100) -> PipelineModel:
    """Random forest (M3)."""
    return fit_classifier(df, features, RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed))


def fit_boosted_ovr(df: DataFrame, features: Features, rounds: int = 20, depth: int = 5, seed: int = 100) -> PipelineModel:
    """Boosted trees, one model per class against the rest (M3)."""
    return fit_classifier(df, features, OneVsRest(classifier=GBTClassifier(maxIter=rounds, maxDepth=depth, seed=seed)))


def fit_mlp(
    df: DataFrame, features: Features, hidden: Sequence[int] = (32,), iterations: int = 50, seed: int = 100
) -> PipelineModel:
    """Multilayer perceptron on scaled features (M3); its input width comes from the fitted feature stages.

    Without any row to fit on it has no stages, as that of ``fit_classifier``.
    """
    rows = _as_text(df.filter(F.col("y_class").isNotNull() & _known(features)), features).withColumn("label", F.col("y_class").cast("double"))
    if rows.isEmpty():
        return PipelineModel(stages=[])
    scaler = MinMaxScaler(inputCol="features", outputCol="scaled")
    stages = Pipeline(stages=[*feature_stages(features), scaler]).fit(rows)
    assembled = stages.transform(rows)
    width = assembled.select("scaled").first()["scaled"].size
    classes = int(assembled.agg(F.max("label")).first()[0]) + 1
    net = MultilayerPerceptronClassifier(
        featuresCol="scaled", layers=[width, *hidden, classes], maxIter=iterations, seed=seed
    )
    return PipelineModel(stages=[*stages.stages, net.fit(assembled)])


@dataclass(frozen=True)
class Cascade:
    """Model for classes 0, 1, 2 and model for classes 2, 3, 4 (M2)."""

    low: PipelineModel
    high: PipelineModel
    features: Features

    def save(self, path: str) -> None:
        """Write both pipelines, encoders included (M7)."""
        self.low.write().overwrite().save(f"{path}/low")
        self.high.write().overwrite().save(f"{path}/high")

    @classmethod
    def load(cls, path: str, features: Features) -> Cascade:
        return cls(PipelineModel.load(f"{path}/low"), PipelineModel.load(f"{path}/high"), features)


def fit_cascade(
    df: DataFrame, features: Features, target: str = "y_reg100", trees: int = 100, depth: int = 8, seed: int = 100
) -> Cascade:
    """Model A on the three classes of the data, model B on the split top class shifted by 2 (M2)."""
    three, _ = prepare_classes(df, target)
    five = three.withColumn("y_class", adjust_bins(target, "y_class"))
    top = five.filter(F.col("y_class") >= 2).withColumn("y_class", F.col("y_class") - 2)
    return Cascade(fit_forest(three, features, trees, depth, seed), fit_forest(top, features, trees, depth, seed), features)


def predict_cascade(cascade: Cascade, df: DataFrame) -> DataFrame:
    """B's answer plus 2 replaces A's class 2 (M2). B scores all rows, so no row order has to be kept."""
    a = predict(cascade.low, df, cascade.features, "_a")
    b = predict(cascade.high, a, cascade.features, "_b")
    return b.withColumn("y_pred", F.when(F.col("_a") == 2, F.col("_b") + 2).otherwise(F.col("_a"))).drop("_a", "_b")


def window_sweep(
    rows_for: Callable[[int], DataFrame],
    windows: Sequence[int],
    features: Features,
    keys: Sequence[str],
    folds: int = 3,
    trees: int = 20,
    depth: int = 5,
    seed: int = 100,
) -> DataFrame:
    """Rebuild the roll-up per window size; every fold is scored by a fit on the others (M5).

    ``rows_for`` gives the classed roll-up for a window size. Rows carry ``time_window_param`` and ``kfold``.
    """
    parts = []
    for w in windows:
        rows = stratified_kfold(rows_for(w).filter(F.col("y_class").isNotNull()), "y_class", keys, folds, seed)
        rows = stage(rows, "folds")
        for fold in range(folds):
            model = fit_forest(rows.filter(F.col("kfold") != fold), features, trees, depth, seed)
            scored = predict(model, rows.filter(F.col("kfold") == fold), features)
            parts.append(scored.withColumns({"time_window_param": F.lit(w), "y_true": F.col("y_class")}))
    return concat(*parts)


def _fit_softmax(iterations: int, route: str, features: Features) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Multinomial regression on the rows of one route: a weight per class for each number, each category and the constant."""
    numbers = [*features.ordinal, *features.numeric]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        classes = np.sort(rows["y_class"].unique())
        y = rows["y_class"].to_numpy()[:, None] == classes[None, :]
        x = rows[numbers].to_numpy(float).reshape(len(rows), len(numbers))
        mean, width = x.mean(axis=0), x.std(axis=0)
        width = np.where(width > 0, width, 1.0)
        names = list(numbers)
        blocks = [(x - mean) / width]
        for c in features.categorical:
            values = np.sort(rows[c].unique())
            names += [f"{c}={v}" for v in values]
            blocks.append(rows[c].to_numpy()[:, None] == values[None, :])
        blocks.append(np.ones((len(rows), 1)))
        x = np.concatenate(blocks, axis=1).astype(float)
        w = np.zeros((x.shape[1], len(classes)))
        speed = np.zeros_like(w)
        for _ in range(iterations):
            z = x @ (w + 0.9 * speed)
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            speed = 0.9 * speed - (2.0 / (1 + len(blocks))) * (x.T @ (p - y) / len(x))
            w = w + speed
        scaled = w.copy()
        n = len(numbers)
        scaled[:n] = w[:n] / width[:, None]
        scaled[-1] = w[-1] - (w[:n] * (mean / width)[:, None]).sum(axis=0)
        weights = {k: v.tolist() for k, v in zip([*names, ""], scaled)}
        return pd.DataFrame({route: [rows[route].iloc[0]], "_weights": [weights], "_classes": [classes.tolist()]})

    return run


def per_route_models(
    df: DataFrame,
    features: Features,
    ranges: Mapping[str, tuple[str, str]],
    route: str = "route_id_direction",
    iterations: int = 200,
    fit_rows: int = 20_000,
    seed: int = 100,
) -> DataFrame:
    """One multinomial regression per route, scored on the route's test dates (M6).

    A route lacking rows in one of the ranges is skipped. All routes are fitted side by side, each on its first
    ``fit_rows`` training rows in a seeded order, a documented bound on the rows of a fit; all test rows are scored, by
    expressions over the weights. A category that the fit has not seen adds nothing, a NULL feature gives NULL.
    """
    parts = date_split(df.filter(F.col("y_class").isNotNull()), dict(ranges))
    numbers = [*features.ordinal, *features.numeric]
    text = {c: F.col(c).cast("string") for c in (route, *features.categorical)}
    test = parts["test"]
    for n, part in parts.items():
        if n != "test":
            test = test.join(part.select(route).distinct(), route, "left_semi")
    train = parts["train"].filter(_known(features)).withColumns(text).select(route, *features.categorical, *numbers, "y_class")
    train = train.na.fill("", list(features.categorical))
    chosen = top_k(train, [route], [F.xxhash64(F.lit(seed), *train.columns), *[F.col(c) for c in train.columns]], fit_rows)
    fitted = chosen.groupBy(route).applyInPandas(
        _fit_softmax(iterations, route, features), f"{route} string, _weights map<string, array<double>>, _classes array<int>"
    )
    rows = test.withColumn("_route", F.col(route).cast("string")).join(fitted.withColumnRenamed(route, "_route"), "_route", "left")
    total = F.element_at("_weights", F.lit(""))

    def times(c: str) -> Callable[[Column, Column], Column]:
        return lambda a, w: a + w * F.col(c)

    for c in numbers:
        total = F.zip_with(total, F.element_at("_weights", F.lit(c)), times(c))
    for c in features.categorical:
        own = F.try_element_at("_weights", F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit(""))))
        total = F.zip_with(total, F.coalesce(own, F.transform(total, lambda a: F.lit(0.0))), lambda a, w: a + w)
    rows = rows.withColumn("_total", total)
    best = F.element_at("_classes", F.array_position("_total", F.array_max("_total")).cast("int"))
    return rows.select(*df.columns, F.when(_known(features) & F.col("_total").isNotNull(), best).alias("y_pred"))
