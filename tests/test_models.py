"""The fitted-model queries run the operators' own defaults on the rows as they are."""

import pytest
from conftest import SMALL

from ridership.operators import boosting, models
from ridership.registry import QUERIES
from ridership.registry.models import SPACE, training_rows

FULL = models.ROUTE_FEATURES


class Stop(Exception):
    pass


def seen(monkeypatch, spark, key, name, module=models):
    """Arguments of the first call of an operator by a query."""
    calls = []

    def spy(*args, **settings):
        calls.append((args, settings))
        raise Stop

    monkeypatch.setattr(module, name, spy)
    with pytest.raises(Stop):
        QUERIES[key](spark, SMALL)
    return calls[0]


@pytest.mark.parametrize(
    "key, name",
    [("m2_cascade", "fit_cascade"), ("m3_forest", "fit_forest"), ("m3_boosted_ovr", "fit_boosted_ovr"), ("m3_mlp", "fit_mlp"), ("m7_save_load", "fit_cascade")],
)
def test_fits_run_on_all_features_and_defaults(monkeypatch, spark, key, name):
    args, settings = seen(monkeypatch, spark, key, name)
    assert args[1:] == (FULL,) and settings == {}


@pytest.mark.parametrize("key", ["m2_cascade", "m7_save_load"])
def test_cascade_gets_the_target_as_it_is(monkeypatch, spark, key):
    args, _ = seen(monkeypatch, spark, key, "fit_cascade")
    loads = lambda df: sorted(r[0] for r in df.select("y_reg100").collect())
    assert loads(args[0]) == loads(training_rows(spark, SMALL))


def test_search_draws_over_four_parameters(monkeypatch, spark):
    args, settings = seen(monkeypatch, spark, "m4_random_search", "random_search", boosting)
    assert args[1:3] == (FULL, SPACE) and settings == {}
    assert list(SPACE["max_depth"]) == [2, 8, 14, 20] and list(SPACE["n_estimators"]) == [100, 500, 900] and len(SPACE) == 4
    assert {r[0] for r in args[0].select("half").distinct().collect()} == {"low", "high"}


def test_sweep_takes_all_windows(monkeypatch, spark):
    args, settings = seen(monkeypatch, spark, "m5_window_sweep", "window_sweep")
    assert args[1:3] == ([1, 10, 20, 30, 40, 50, 60, 120], FULL) and settings == {}
    assert args[0](120).filter("y_class IS NOT NULL").count() > 0


@pytest.fixture(scope="module")
def bare(spark, tmp_path_factory):
    """A table set whose cleaning leaves no rows: no arrival is known."""
    path = str(tmp_path_factory.mktemp("none"))
    rows = [(101 * i, i, "view", 40.0 + i) for i in range(6)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double")
    events.selectExpr("event_id", "timestamp_ntz'2024-01-02 10:00:00' AS ts", "user_id", "event_type", "value", "'' AS props").write.parquet(f"{path}/events.parquet")
    for t in ("lineitem", "part"):
        spark.read.parquet(f"{SMALL}/{t}.parquet").limit(0).write.parquet(f"{path}/{t}.parquet")
    return path


@pytest.mark.parametrize("key", ["m1_prepare_training", "m2_cascade", "m3_forest", "m3_boosted_ovr", "m3_mlp", "m5_window_sweep", "m7_save_load", "same_day_splits"])
def test_no_training_rows_give_no_rows(spark, bare, key):
    assert QUERIES[key](spark, bare).collect() == []


def test_models_without_rows_answer_null(spark, tmp_path):
    rows = training_rows(spark, SMALL)
    cascade = models.fit_cascade(rows.limit(0), FULL)
    cascade.save(str(tmp_path))
    out = models.predict_cascade(models.Cascade.load(str(tmp_path), FULL), rows)
    assert out.count() == rows.count() and out.filter("y_pred IS NOT NULL").isEmpty()
    assert dict(out.dtypes)["y_pred"] == "int"
    net = models.predict(models.fit_mlp(models.prepare_classes(rows.limit(0))[0], FULL), rows, FULL)
    assert net.filter("y_pred IS NOT NULL").isEmpty()


def test_a_forest_of_one_row(spark):
    rows = models.prepare_classes(training_rows(spark, SMALL))[0].filter("y_class IS NOT NULL AND temperature IS NOT NULL AND humidity IS NOT NULL AND precipitation_intensity IS NOT NULL AND scheduled_headway IS NOT NULL")
    one = rows.orderBy("transit_date", "route_id_direction", "time_window").limit(1)
    assert [r.y_pred == r.y_class for r in models.predict(models.fit_forest(one, FULL, 20, 5), one, FULL).collect()] == [True]
