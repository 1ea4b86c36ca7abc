"""Hand-made rows for the corners: NULLs, ties, thresholds, gaps between bins, equal times, empty inputs."""

import os
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ridership import session
from ridership.functions import arrays, bins, times
from ridership.operators import asof, baseline, basic, clean, disruption, encode, enrich, geo, headway, metrics, quantiles
from ridership.operators import rollup, sequence, split
from ridership.operators.ordered import Along

T0 = datetime(2024, 1, 2, 8, 0)


def ids(df, col="id"):
    return sorted(r[0] for r in df.select(col).collect())


def column(spark, values, ddl, expr):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {ddl}")
    return [r[0] for r in rows.select(expr.alias("x"), "i").orderBy("i").select("x").collect()]


def test_block_drop_and_stop_drop_differ(spark):
    # trip 1 has no arrival at all, trip 2 of the same block misses one, trip 3 runs in another block
    rows = [
        (1, date(2024, 1, 1), 1, "a", None, 7),
        (2, date(2024, 1, 1), 1, "b", None, 7),
        (3, date(2024, 1, 1), 2, "a", None, 7),
        (4, date(2024, 1, 1), 2, "b", T0, 7),
        (5, date(2024, 1, 1), 3, "a", None, 8),
        (6, date(2024, 1, 1), 3, "b", T0, 8),
    ]
    df = spark.createDataFrame(
        rows, "id int, transit_date date, trip_id int, stop_id string, arrival_time timestamp, block_abbr int"
    ).withColumns({"vehicle_id": F.lit(None).cast("string"), "overload_id": F.lit(0), "load": F.lit(1)})
    assert ids(clean.drop_blocks_all_null(df)) == [5, 6]
    assert ids(clean.drop_stops_null_arrival(df)) == [4, 6]
    assert ids(clean.remove_null_events(df)) == [6]
    bad = clean.blocks_all_null(df)
    kept, aside = clean.drop_blocks_all_null(df), clean.quarantine(df, bad, "arrival_times_null")
    assert sorted(ids(kept) + ids(aside)) == [1, 2, 3, 4, 5, 6]


def test_short_trips_and_null_keys(spark):
    rows = [(i, 1) for i in range(3)] + [(i, 2) for i in range(10, 14)] + [(20, None)]
    df = spark.createDataFrame(rows, "id int, trip_id int")
    assert ids(clean.drop_short_groups(df, ["trip_id"])) == [10, 11, 12, 13, 20]


def test_ties_give_the_same_first(spark):
    df = spark.createDataFrame(
        [(1, T0, 2, None), (1, T0, 1, "x"), (1, T0, 3, "y")], "k int, t timestamp, seq int, v string"
    )
    assert clean.dedup_keep_first(df, ["k"], ["t", "seq"]).first()["seq"] == 1
    assert df.groupBy("k").agg(rollup.first_of("v", ["t", "seq"])).first()[1] == "x"
    assert df.groupBy("k").agg(rollup.last_of("v", ["t", "seq"])).first()[1] == "y"


def test_headway_flags_with_zero_and_null(spark):
    rows = [(0, 0, 600), (1, 600, 0), (2, None, 600), (3, 900, 600), (4, 300, 600), (5, 600, 600), (6, 0, 0), (7, 301, 600)]
    df = spark.createDataFrame(rows, "id int, actual_hdwy int, sched_hdwy int")
    got = {r["id"]: (r["is_gapped"], r["is_bunched"], r["is_target"]) for r in headway.headway_flags(df).collect()}
    assert got == {
        0: (0, 1, 0), 1: (0, 0, 0), 2: (0, 0, 0), 3: (1, 0, 0), 4: (0, 1, 0), 5: (0, 0, 1), 6: (0, 0, 0), 7: (0, 0, 1),
    }


def test_derived_load(spark):
    rows = [(1, s, load, ons, offs) for s, (load, ons, offs) in enumerate([(9, 9, 0), (5, 5, 0), (0, 2, 1), (0, 0, 3), (0, 7, 7)])]
    df = spark.createDataFrame(rows, "trip_id int, stop_sequence int, load int, ons int, offs int").withColumns(
        {"transit_date": F.lit(date(2024, 1, 1)), "scheduled_time": F.timestamp_seconds(F.col("stop_sequence") * 60)}
    )
    for pieces in (5_000_000, 2):
        out = headway.derived_load(df, piece_rows=pieces).orderBy("stop_sequence")
        assert [(r["stop_sequence"], r["derived_load"]) for r in out.collect()] == [(1, 5), (2, 6), (3, 3)]


def test_bins_have_gaps_and_inclusive_ends(spark):
    loads = [-1.0, 0.0, 9.0, 9.5, 10.0, 16.0, 55.0, 56.0, 100.0, 101.0, None]
    assert column(spark, loads, "double", bins.assign_class("v", bins.LOAD_CLASSES)) == [
        None, 0, 0, None, 1, 1, 2, 3, 4, None, None,
    ]
    assert column(spark, loads, "double", bins.interval_cut("v")) == [-1, 0, 0, 1, 1, 1, 2, 3, 4, -1, -1]
    gaps = [0, 6, 7, 8, 12, 13, 14, 55, 56, 57, 75, 76, 77, 100, 101]
    assert column(spark, gaps, "int", bins.same_day_cut("v")) == [0, 0, -1, 1, 1, -1, 2, 2, -1, 3, 3, -1, 4, 4, -1]
    whole = list(range(0, 101))
    assert all(c is not None for c in column(spark, whole, "int", bins.assign_class("v", bins.LOAD_CLASSES)))


def test_rolling_and_array_quantile_skip_null(spark):
    df = spark.createDataFrame([([5, None, 1, 9],), ([],), (None,), ([None],)], "a array<int>")
    got = [r[0] for r in df.select(arrays.lower_percentile("a", 95)).collect()]
    assert got == [5, None, None, None]
    assert [r[0] for r in df.select(arrays.array_mean("a")).collect()] == [5.0, None, None, None]


@pytest.mark.parametrize("piece_rows", [5_000_000, 1])
def test_asof_equal_times_and_tolerance(spark, piece_rows):
    day = timedelta(days=1)
    left = spark.createDataFrame(
        [(1, T0, "a"), (2, T0 + 30 * day, "a"), (3, T0 + 30 * day + timedelta(seconds=1), "a"), (4, T0, "b"), (5, None, "a"),
         (6, T0 - day, "a"), (7, T0, None)],
        "id int, t timestamp, k string",
    )
    right = spark.createDataFrame(
        [(T0, "a", 1), (T0, "a", 2), (None, "a", 3), (T0, None, 4)], "u timestamp, k string, seq int"
    )
    kw = {"by": ["k"], "right_cols": ["seq"], "tie": ["seq"], "tolerance_seconds": 30 * 86400, "piece_rows": piece_rows}
    back = {r["id"]: r["seq"] for r in asof.asof_join(left, right, "t", "u", direction="backward", **kw).collect()}
    assert back == {1: 2, 2: 2, 3: None, 4: None, 5: None, 6: None, 7: None}
    ahead = {r["id"]: r["seq"] for r in asof.asof_join(left, right, "t", "u", direction="forward", **kw).collect()}
    assert ahead == {1: 1, 2: None, 3: None, 4: None, 5: None, 6: 1, 7: None}


def test_null_runs(spark):
    runs = {"V": 1, "N": 2, "VN": 3, "VNV": 4, "NV": 5, "NVN": 3, "NVNV": None, "VVNNVN": 3}
    rows = [(i, s, None if c == "N" else T0) for i, text in enumerate(runs) for s, c in enumerate(text)]
    df = spark.createDataFrame(rows, "trip_id int, stop_sequence int, arrival_time timestamp")
    got = {r["trip_id"]: r["status"] for r in disruption.null_run_status(df, ["trip_id"]).collect()}
    assert [got[i] for i in range(len(runs))] == list(runs.values())


def test_decode_status(spark):
    codes = [1, 20, 300, None, -1]
    df = disruption.decode_status(spark.createDataFrame([(i, c) for i, c in enumerate(codes)], "i int, status int"))
    got = [(r["merged_status"], r["type"]) for r in df.orderBy("i").collect()]
    assert got == [
        (1, "no_overload"), (2, "nexttrip_overload"), (3, "sametrip_overload"), (5, "no_overload"), (None, None),
    ]


def test_time_texts_and_windows(spark):
    hms = ["25:10:00", "00:00:59"]
    assert column(spark, hms, "string", times.hms_to_seconds("v")) == [90600, 59]
    assert column(spark, hms, "string", times.hms_to_hour("v")) == [25, 0]
    assert column(spark, [90600, 59], "int", times.seconds_to_hms("v")) == ["01:10:00", "00:00:59"]
    at = [datetime(2024, 1, 1, 8, 15), datetime(2024, 1, 1, 23, 59), None]
    assert column(spark, at, "timestamp", times.time_window("v", 30)) == [16, 47, None]
    assert column(spark, at, "timestamp", times.time_window_rounded("v")) == [17.0, 48.0, None]
    assert column(spark, [5, 6, 22, None], "int", times.window_of_day("v")) == ["late_night", "am_rush", "late_night", None]


def test_weekday_numbers(spark):
    flags = {d: int(d in ("monday", "sunday")) for d, _ in times.gtfs_dayofweek()}
    df = spark.createDataFrame([tuple(flags.values())], ", ".join(f"{d} int" for d in flags))
    assert sorted(r["dayofweek"] for r in enrich.explode_weekdays(df).collect()) == [1, 2]
    assert sorted(r["dayofweek"] for r in enrich.explode_weekdays(df, compat=True).collect()) == [1, 7]


def test_clip_and_filters_keep_null(spark):
    df = spark.createDataFrame([(1, -5), (2, None), (3, 500)], "id int, load int")
    assert [r["load"] for r in basic.clip(df, "load", 0, 100).orderBy("id").collect()] == [0, None, 100]
    assert ids(basic.exclude_values(df, "load", [500])) == [1, 2]


def test_date_range_prunes_partitions(spark, tmp_path):
    df = spark.range(60).select(F.date_add(F.lit("2023-12-15").cast("date"), F.col("id").cast("int")).alias("transit_date"))
    parts = df.withColumns({"year": F.year("transit_date"), "month": F.month("transit_date")})
    parts.write.partitionBy("year", "month").parquet(str(tmp_path / "t"))
    out = basic.between_dates(
        spark.read.parquet(str(tmp_path / "t")), "transit_date", "2023-12-20", "2024-01-10", partition_cols=("year", "month")
    )
    assert out.count() == 22
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan
    assert len(out.inputFiles()) >= 1


def test_gtfs_version_and_missing_feed(spark):
    ev = spark.createDataFrame(
        [(1, date(2024, 1, 5), "a"), (2, date(2024, 1, 15), "a"), (3, date(2023, 1, 1), "a"), (4, date(2024, 1, 5), "z")],
        "id int, transit_date date, trip_id string",
    )
    feeds = spark.createDataFrame(
        [("a", date(2024, 1, 1), 10, 0), ("a", date(2024, 1, 10), 20, 0), ("a", date(2024, 1, 10), 20, 0)],
        "trip_id string, feed_date date, route_id int, direction_id int",
    )
    got = {r["id"]: r["gtfs_route_id"] for r in enrich.gtfs_version_in_force(ev, feeds).collect()}
    assert got == {1: 10, 2: 20, 3: None, 4: None}


def test_calendar_repeats_do_not_multiply_rows(spark):
    ev = spark.createDataFrame([(1, date(2024, 1, 1)), (2, date(2024, 1, 2))], "id int, transit_date date")
    cal = spark.createDataFrame([(date(2024, 1, 1),), (date(2024, 1, 1),), (None,)], "cal_date date")
    assert sorted((r["id"], r["is_holiday"]) for r in enrich.flag_holiday(ev, cal).collect()) == [(1, True), (2, False)]


@pytest.mark.parametrize("piece_rows", [5_000_000, 3])
def test_quantiles(spark, piece_rows):
    values = [0, 0, 0, 5, 7, 7, 9, 30, 31, 99, None]
    df = spark.createDataFrame([(v,) for v in values], "v int")
    known = sorted(v for v in values if v is not None)
    qs = [0.0, 0.33, 0.66, 0.95, 1.0]
    low = quantiles.exact_quantiles(df, "v", qs, kind="lower", piece_rows=piece_rows).first()
    assert list(low) == [known[int((len(known) - 1) * q)] for q in qs]
    lin = quantiles.exact_quantiles(df, "v", [0.5, 0.25], piece_rows=piece_rows).first()
    assert list(lin) == [7.0, 1.25]


def test_class_bounds_cover_all_whole_loads(spark):
    df = spark.range(101).select(F.col("id").alias("load"))
    bounds = quantiles.collect_bounds(quantiles.class_bounds(df, "load"))
    assert bounds == [(0.0, 33.0), (34.0, 66.0), (67.0, 100.0)]
    linear = quantiles.collect_bounds(quantiles.class_bounds(df, "load", kind="linear"))
    assert linear[2:] == [(67.0, 55.0), (56.0, 75.0), (76.0, 100.0)]
    assert bins.adjusted_bounds(bounds)[2:] == [(16.0, 55.0), (56.0, 75.0), (76.0, 100.0)]


def test_lookback_excludes_the_day_itself(spark):
    d = date(2024, 1, 20)
    rows = [(0, 5.0), (1, 9.0), (7, 11.0), (8, 1.0), (28, 0.0)]
    df = spark.createDataFrame(
        [("t", "r", d - timedelta(days=k), y) for k, y in rows],
        "trip_id string, route_id_direction string, transit_date date, y_reg100 double",
    )
    one = {r["transit_date"]: r["y_pred"] for r in baseline.lookback_percentile(df, 7, 0.0).collect()}
    assert one[d] == 9.0 and one[d - timedelta(days=28)] == -1.0
    four = {r["transit_date"]: r["y_pred"] for r in baseline.lookback_percentile(df, 28, 50.0).collect()}
    assert four[d] == 5.0


def test_cell_corner_and_half_inside_segment(spark):
    grid = geo.Grid(0.0, 0.0, 10, 4, 4, scale=1)
    line = spark.createDataFrame([(1, 5.0, 5.0, 15.0, 15.0)], "trip_id int, lon0 double, lat0 double, lon1 double, lat1 double")
    touched = {(r["ix"], r["iy"]) for r in geo.cells_crossed(line, grid, ["trip_id"]).collect()}
    assert touched == {(0, 0), (1, 1), (0, 1), (1, 0)}
    through = {(r["ix"], r["iy"]) for r in geo.cells_crossed(line, grid, ["trip_id"], touch=False).collect()}
    assert through == {(0, 0), (1, 1)}
    cells = spark.createDataFrame([(1, 0, 0), (1, 1, 0)], "trip_id int, ix long, iy long")
    segs = spark.createDataFrame(
        [(1, 1.0, 1.0, 9.0, 9.0), (2, 5.0, 5.0, 15.0, 5.0), (3, 5.0, 5.0, 5.0, 15.0), (4, -5.0, 5.0, 5.0, 5.0), (5, 3.0, 3.0, 3.0, 3.0)],
        "xd_id int, lon0 double, lat0 double, lon1 double, lat1 double",
    )
    assert ids(geo.segments_within(cells, segs, grid), "xd_id") == [1, 2, 5]


def test_polyline_points(spark):
    pts = spark.createDataFrame(
        [(1, date(2024, 1, 1), i, float(i), 0.0) for i in range(7)] + [(1, date(2024, 1, 2), 9, 9.0, 9.0)],
        "trip_id int, transit_date date, seq int, lon double, lat double",
    )
    for pieces in (2, 5_000_000):
        line = geo.trip_polyline(pts, piece_rows=pieces).orderBy("n").collect()
        assert [(r["n"], r["lon"]) for r in line] == [(i + 1, float(i)) for i in range(7)]


def test_sequence_counts(spark):
    df = spark.createDataFrame([(k, i, i) for k, n in ((1, 9), (2, 3), (3, 4)) for i in range(n)], "k int, i int, load int")
    for pieces in (5_000_000, 2):
        along = Along(["i"], F.col("i"), pieces)
        out = sequence.sliding_sequences(df, 2, 2, ["i", "load"], "load", ["k"], along)
        assert {r["k"]: r["count"] for r in out.groupBy("k").count().collect()} == {1: 6, 3: 1}
        row = out.filter("k = 3").first()
        assert [x["i"] for x in row["x"]] == [0, 1] and row["y"] == [2, 3]
        blocks = sequence.block_batches(df, 2, ["load"], "load", ["k"], along).orderBy("k", "batch").collect()
        assert [(r["k"], [x["load"] for x in r["x"]], r["y"]) for r in blocks] == [
            (1, [0, 1], 2), (1, [3, 4], 5), (1, [6, 7], 8), (2, [0, 1], 2), (3, [0, 1], 2),
        ]


def test_folds_are_even_and_repeatable(spark):
    df = spark.range(1000).withColumn("y", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 7))
    for pieces in (5_000_000, 50):
        folds = split.stratified_kfold(df, "y", ["id"], 5, piece_rows=pieces)
        counts = folds.groupBy("y", "kfold").count().groupBy("y").agg(F.max("count") - F.min("count")).collect()
        assert max(r[1] for r in counts) <= 1
    again = split.stratified_kfold(df.repartition(7), "y", ["id"], 5)
    assert folds.join(again, ["id", "kfold"]).count() == 1000
    shuffled = split.stratified_shuffle(df, "y", ["id"], 2, 0.3)
    assert shuffled.groupBy("split").count().count() == 2
    share = shuffled.groupBy("split").agg(F.avg(F.col("is_test").cast("int"))).collect()
    assert all(abs(r[1] - 0.3) < 0.01 for r in share)


def test_shuffled_splits_take_the_first_of_each_class(spark):
    # one class has most rows, one has a single row, some rows have no class; a clashing column is replaced
    rows = [(i, None if i % 50 == 7 else 0 if i % 10 else 1 + i % 3, i % 4, "x") for i in range(3000)] + [(3000, 9, 0, "x")]
    df = spark.createDataFrame(rows, "id long, y int, part int, split string")
    out = split.stratified_shuffle(df, "y", ["id", "part"], 4, 0.3)
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {(r["split"], r["id"]) for r in out.filter("is_test").collect()}
    known = [r for r in rows if r[1] is not None]
    assert out.count() == 4 * len(known) and out.columns == ["id", "y", "part", "split", "is_test"]
    place = Window.partitionBy("y").orderBy("_h", "id", "part")
    for i in range(4):
        plain = df.filter("y IS NOT NULL").withColumn("_h", F.xxhash64(F.lit(100 + i), "id", "part"))
        plain = plain.withColumns({"_rank": F.row_number().over(place), "_n": F.count("*").over(Window.partitionBy("y"))})
        assert {(i, r["id"]) for r in plain.filter("_rank <= round(_n * 0.3)").collect()} == {g for g in got if g[0] == i}
    assert split.stratified_shuffle(df.filter("y > 99"), "y", ["id"], 2).count() == 0
    assert split.stratified_shuffle(df, "y", ["id"], 2, 0.0).filter("is_test").count() == 0


def test_discarded_stages_are_gone(spark):
    kept, gone = session.stage(spark.range(3), "kept"), session.stage(spark.range(3), "gone")
    folder = gone.inputFiles()[0].removeprefix("file://").rsplit("/", 2)[0]
    assert os.path.isdir(folder)
    session.discard(gone, gone, spark.range(3))
    assert not os.path.exists(folder) and kept.count() == 3


def test_sparse_one_hot(spark):
    df = spark.createDataFrame([(1, "b", 10), (1, "b", 10), (2, None, 9), (3, "a", None)], "id int, c string, d int")
    slots = encode.category_slots(df, ["c", "d"])
    # numbers are in the order of numbers
    assert sorted((r["slot"], r["column"], r["value"]) for r in slots.collect()) == [(0, "c", "a"), (1, "c", "b"), (2, "d", "9"), (3, "d", "10")]
    unseen = df.union(spark.createDataFrame([(4, "z", None)], df.schema))
    hot = encode.one_hot_sparse(unseen, slots, ["c", "d"])
    got = sorted((r["id"], r["hot"]["size"], r["hot"]["indices"], r["hot"]["values"]) for r in hot.collect())
    assert got == [(1, 4, [1, 3], [1.0, 1.0])] * 2 + [(2, 4, [2], [1.0]), (3, 4, [0], [1.0]), (4, 4, [], [])]
    back = encode.one_hot_sparse_inverse(hot.drop("c", "d"), slots, {"c": "string", "d": "int"})
    assert back.columns == ["id", "c", "d"] and back.schema["d"].dataType.simpleString() == "int"
    assert sorted(back.collect(), key=lambda r: r["id"]) == [(1, "b", 10), (1, "b", 10), (2, None, 9), (3, "a", None), (4, None, None)]
    assert encode.one_hot_long(hot).count() == 6
    many = spark.range(100_000).select("id", F.format_string("v%06d", "id").alias("c"))
    vectors = encode.one_hot_sparse(many, encode.category_slots(many, ["c"]), ["c"])
    assert vectors.filter("hot.indices[0] = id AND size(hot.indices) = 1 AND hot.size = 100000").count() == 100_000
    empty = df.filter("id > 9")
    assert encode.one_hot_sparse(empty, encode.category_slots(empty, ["c"]), ["c"]).count() == 0


def test_encoders(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (2, "b", 4.0), (3, None, 2.0)], "id int, c string, x double")
    cats = encode.fit_categories(df, ["c"])
    hot = encode.one_hot(df, cats).drop("c")
    assert [(r["c_a"], r["c_b"]) for r in hot.orderBy("id").collect()] == [(1, 0), (0, 1), (0, 0)]
    assert [r["c"] for r in encode.one_hot_inverse(hot, cats).orderBy("id").collect()] == ["a", "b", None]
    many = df.sparkSession.range(10_001).select(F.format_string("v%05d", "id").alias("c"))
    assert len(encode.fit_categories(many, ["c"])["c"]) == 10_001
    index = encode.index_map(many.repartition(7), "c")
    assert index.filter(F.col("c_ix") != F.substring("c", 2, 5).cast("int")).count() == 0 and index.count() == 10_001
    constant = encode.fit_scaler(df.filter("x = 2"), ["x"])
    assert [r["x"] for r in encode.scale(df, constant).orderBy("id").collect()] == [0.0, 2.0, 0.0]


def test_scores_without_positives_are_zero(spark):
    df = spark.createDataFrame([(False, False)], "t boolean, p boolean")
    row = metrics.precision_recall_f1(df, F.col("t"), F.col("p")).first()
    assert (row["precision"], row["recall"], row["f1"], row["tn"]) == (0.0, 0.0, 0.0, 1)
    empty = metrics.precision_recall_f1(df.filter("false"), F.col("t"), F.col("p")).first()
    assert (empty["tp"], empty["f1"]) == (0, 0.0)


def test_resample_fills_empty_bins(spark):
    rows = [(1, T0, 10.0), (1, T0 + timedelta(minutes=10), 20.0), (1, T0 + timedelta(minutes=95), None), (1, T0 + timedelta(minutes=65), 5.0)]
    df = spark.createDataFrame(rows, "k int, t timestamp, v double")
    assert [r["v"] for r in rollup.resample_mean(df, ["k"], "t", "v", 30).orderBy("t").collect()] == [15.0, None, 5.0]
    assert [r["v"] for r in rollup.resample_sum(df, ["k"], "t", "v", 30).orderBy("t").collect()] == [30.0, 0.0, 5.0, 0.0]
    with pytest.raises(ValueError):
        rollup.resample_mean(df, ["k"], "t", "v", 50)


def test_trip_loads_keep_every_load(spark):
    df = spark.createDataFrame([(1, v) for v in (3, 1, 3, None, 0)], "trip_id int, load int").withColumn("transit_date", F.lit(T0.date()))
    out = rollup.trip_loads(df).select(arrays.expand_counts("load_counts", "load").alias("loads"))
    assert out.first()["loads"] == [0, 1, 3, 3]


def test_equal_segments_meet_a_trip_once(spark):
    """Segments through the same cells are one shape; only the last join gives a row per trip and segment."""
    grid = geo.Grid(0.0, 0.0, 10, 3, 3)
    cells = spark.createDataFrame([(t, x, y) for t in range(4) for x in range(2) for y in range(3)], "trip_id int, ix long, iy long")
    lines = [(i, 0.001, 0.001, 0.002, 0.003) for i in range(50)] + [(50, 0.005, 0.005, 0.015, 0.006), (51, 0.015, 0.005, 0.025, 0.006), (52, 0.001, 0.001, 0.05, 0.001)]
    segs = spark.createDataFrame(lines, "xd_id int, lon0 double, lat0 double, lon1 double, lat1 double")
    trip_shapes, members = geo.shapes_within(cells, segs, grid)
    assert sorted(map(tuple, trip_shapes.collect())) == [(t, s) for t in range(4) for s in (0, 50)]
    assert sorted(map(tuple, members.collect())) == [(i, 0) for i in range(50)] + [(50, 50), (51, 51)]
    pairs = sorted(map(tuple, geo.segments_within(cells, segs, grid).collect()))
    assert pairs == [(t, i) for t in range(4) for i in range(51)]
    assert sorted(r[0] for r in geo.segments_of_all_trips(trip_shapes, members).collect()) == list(range(51))


def test_folds_of_a_large_class_are_those_of_a_small_one(spark):
    """Ranked by ranges of hashes or in one window: the same folds, a missing class and repeated rows included."""
    rows = [(i % 900, None if i % 11 == 0 else i % 3) for i in range(1000)] + [(None, 1), (None, None)]
    df = spark.createDataFrame(rows, "id long, y int")
    counts = lambda n: sorted(map(str, split.stratified_kfold(df, "y", ["id"], 5, piece_rows=n).groupBy("id", "y", "kfold").count().collect()))
    assert counts(50) == counts(5_000_000)
    plan = split.stratified_kfold(df, "y", ["id"], 5, piece_rows=50)._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and "LeftOuter" not in plan


def test_block_text_is_made_before_the_join(spark):
    df = spark.createDataFrame([("d", 1, 3), ("d", 1, 1), ("d", 1, 3), ("d", 2, None), (None, 1, 5)], "transit_date string, block_abbr int, trip_id long")
    out = enrich.block_trip_ids(df, separator=",")
    got = sorted(((r.transit_date or "", r.block_abbr, r.trip_id or 0, r.block_trip_ids) for r in out.collect()), key=str)
    assert got == sorted([("", 1, 5, None), ("d", 1, 1, "1,3"), ("d", 1, 3, "1,3"), ("d", 1, 3, "1,3"), ("d", 2, 0, "")], key=str)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("array_join")


def test_events_around_meet_few_other_rows(spark):
    """The rows of a brute-force look, by a join on parts of a few hours and not on whole days."""
    at = lambda h: datetime(2024, 1, 1) + timedelta(hours=h)
    spans = [(0, 1, at(30), at(29), at(31)), (1, 1, at(30), None, None), (2, 1, at(50.5), at(10), None), (3, 2, at(3), None, at(4)), (4, None, at(5), at(4), at(6))]
    matched = spark.createDataFrame(spans, "disruption_id int, block_abbr int, disruption_ts timestamp, arrival_time_prev timestamp, arrival_time_next timestamp")
    rows = [(i, 1 + i % 2, at(i / 4) if i % 9 else None) for i in range(300)]
    events = spark.createDataFrame(rows, "event_id int, block_abbr int, arrival_time timestamp")
    pad = timedelta(hours=7)
    want = sorted(
        (k, e) for k, b, t, p, n in spans for e, eb, ea in rows
        if b == eb and ea is not None and (p - pad if p else t) <= ea <= (n + pad if n else t)
    )
    out = disruption.events_around(matched, events)
    assert sorted((r.disruption_id, r.event_id) for r in out.select("disruption_id", "event_id").collect()) == want
    assert "_day" not in out._jdf.queryExecution().optimizedPlan().toString()
