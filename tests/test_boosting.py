"""Softmax boosting against a plain version, and its defined cases."""

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from ridership.operators import boosting
from ridership.operators.models import Features

FEATURES = Features(("kind",), ("step",), ("x",))


def plain_margins(rows, y, classes, depth, rounds, rate, gamma):
    """Every cut of every feature tried on every node, by recursion."""
    n = len(rows)
    margin = np.zeros((n, classes))
    tests = [lambda r, v=v: r["kind"] == v for v in sorted(rows["kind"].unique())]
    for c in ("step", "x"):
        u = np.unique(rows[c])
        tests += [lambda r, c=c, e=e: r[c] > e for e in (u[:-1] + u[1:]) / 2]
    sides = [t(rows).to_numpy() for t in tests]
    for _ in range(rounds):
        p = np.exp(margin) / np.exp(margin).sum(axis=1, keepdims=True)
        step = np.zeros_like(margin)
        for k in range(classes):
            g, h = p[:, k] - (y == k), 2 * p[:, k] * (1 - p[:, k])

            def grow(inside, left):
                score = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1)
                best = (max(gamma, 1e-6), None)
                for s in sides if left else []:
                    a, b = inside & ~s, inside & s
                    if h[a].sum() < 1 or h[b].sum() < 1:
                        continue
                    gain = score(a) + score(b) - score(inside)
                    if gain > best[0] + 1e-12:
                        best = (gain, (a, b))
                if best[1] is None:
                    step[inside, k] = -rate * g[inside].sum() / (h[inside].sum() + 1)
                else:
                    for part in best[1]:
                        grow(part, left - 1)

            grow(np.ones(n, bool), depth)
        margin += step
    return margin


def table(n=120, seed=3):
    rng = np.random.default_rng(seed)
    rows = pd.DataFrame({"kind": rng.choice(list("abcd"), n), "step": rng.integers(0, 9, n) * 1.0, "x": rng.integers(0, 20, n) / 4})
    y = np.where(rows["kind"] == "b", 2, np.where(rows["x"] + rng.normal(0, 1, n) > 2.5, 1, 0))
    return rows, y


@pytest.mark.parametrize("depth, gamma", [(1, 0.0), (3, 0.0), (4, 1.5), (0, 0.0)])
def test_trees_equal_a_plain_version(depth, gamma):
    rows, y = table()
    codes = boosting._Codes.fit(["kind"], ["step", "x"], rows)
    x = codes.of(rows)
    model = boosting._boost(codes, x, y, 3, depth, 6, 0.3, gamma)
    want = plain_margins(rows, y, 3, depth, 6, 0.3, gamma)
    assert np.allclose(boosting._scores(codes, x, model, 3, block=4), want, atol=1e-9)


def test_features_without_a_choice():
    rows, y = table()
    rows = rows.assign(kind="a", step=1.0, x=2.0)
    codes = boosting._Codes.fit(["kind"], ["step", "x"], rows)
    x = codes.of(rows)
    model = boosting._boost(codes, x, y, 3, 4, 3, 0.3, 0.0)
    assert (model["feature"] == -1).all() and len(model["roots"]) == 9
    assert (boosting._scores(codes, x, model, 3).argmax(axis=1) == np.bincount(y).argmax()).all()


SCHEMA = "id int, half string, kind string, step int, x double, y_class int"


def known(spark, n=300):
    """The class follows from ``step``; both halves, repeated rows."""
    rows = [(i, h, "ab"[i % 2], i % 12, float(i % 7), (i % 12) // 4) for i in range(n) for h in ("low", "high")]
    return spark.createDataFrame(rows + rows[:10], SCHEMA)


def fitted(spark, df):
    settings = boosting.one_setting(df, {"half": ["low", "high"]}, 3, 10, 0.5, 0.0)
    return boosting.fit_boosted(boosting.fit_sample(df, FEATURES, ["half"], 200), FEATURES, settings, ["half"], models=2)


def test_fit_score_save_load_and_missing_values(spark, tmp_path):
    df = known(spark)
    path = str(tmp_path / "models")
    boosting.save_models(fitted(spark, df), path)
    models = boosting.load_models(df, path)
    assert models.count() == 2 and models.first()["columns"] == ["kind", "step", "x"]
    odd = [(-1, "low", None, 5, 1.0, None), (-2, "low", "new", 9, 1.0, None), (-3, "low", "a", None, 1.0, 0), (-4, "none", "a", 1, 1.0, 0), (-5, None, "a", 1, 1.0, 0)]
    asked = df.unionByName(spark.createDataFrame(odd, SCHEMA)).withColumn("value", F.lit("clash"))
    out = boosting.predict_boosted(models, asked, FEATURES, ["half"], piece_rows=40).collect()
    assert len(out) == df.count() + len(odd)
    got = {r["id"]: r["y_pred"] for r in out if r["id"] < 0}
    assert got == {-1: 1, -2: 2, -3: None, -4: None, -5: None}
    assert all(r["y_pred"] == r["y_class"] for r in out if r["id"] >= 0)
    with pytest.raises(Exception, match="fitted on"):
        boosting.predict_boosted(models, asked, Features(("kind",), ("x",), ("step",)), ["half"]).count()


def test_empty_tables(spark):
    df = known(spark)
    none = fitted(spark, df.limit(0))
    assert none.count() == 0
    assert {r["y_pred"] for r in boosting.predict_boosted(none, df, FEATURES, ["half"]).collect()} == {None}
    assert boosting.predict_boosted(fitted(spark, df), df.limit(0), FEATURES, ["half"]).count() == 0


def test_search_scores_every_row_once_per_setting(spark):
    df = known(spark)
    space = {"max_depth": [1, 3], "n_estimators": [4], "learning_rate": [0.5], "gamma": [0.0, 0.1]}
    out = boosting.random_search(df, FEATURES, space, ["id", "x"], n_iter=3, folds=3, fit_rows=200).collect()
    assert len(out) == 6 and {r["rows"] for r in out} == {305}
    assert sorted(r["place"] for r in out if r["half"] == "low") == [1, 2, 3]
    for r in out:
        assert 0 < r["accuracy"] <= 1 and (r["max_depth"] == 1 or r["accuracy"] > 0.99)
    first = [r for r in out if r["place"] == 1]
    assert all(f["accuracy"] >= r["accuracy"] for f in first for r in out if r["half"] == f["half"])
