"""L1-L13 and N1-N10."""

from pyspark.sql import functions as F

from ridership.functions.times import epoch_micros
from ridership.operators import encode, metrics, sequence, split
from ridership.operators.basic import route_direction_key
from ridership.operators.enrich import concat
from ridership.operators.ordered import Along
from ridership.registry.base import EV, d, query, r
from ridership.registry.enrichment import MATCHED, matched
from ridership.registry.rollups import CLASSED, classed
from ridership.session import stage
from ridership.sources.bindings import bind

_RANGES = {
    "train": ("2024-01-01", "2024-01-12"),
    "val": ("2024-01-12", "2024-01-20"),
    "test": ("2024-01-20", "2024-01-30"),
}


def _register_split(closed: str, hi: str) -> None:
    union = " UNION ALL ".join(
        f"SELECT '{n}' AS part, event_id FROM stop_events WHERE transit_date >= DATE '{a}' AND transit_date {hi} DATE '{b}'"
        for n, (a, b) in _RANGES.items()
    )

    @query(f"l1_date_split_{closed}", "stop_events", union)
    def _(spark, sf):
        parts = split.date_split(bind(spark, sf, "stop_events"), _RANGES, closed=closed)
        return concat(*[p.select(F.lit(n).alias("part"), "event_id") for n, p in parts.items()])


_register_split("both", "<=")
_register_split("left", "<")

_K = 5


@query(
    "l2_stratified_kfold",
    "scored",
    f"""{CLASSED}, sizes AS (SELECT y_true, count(*) AS n FROM classed GROUP BY y_true)
    SELECT y_true, CAST(f AS INTEGER) AS kfold, n // {_K} + CASE WHEN f < n % {_K} THEN 1 ELSE 0 END AS n
    FROM sizes, generate_series(0, {_K - 1}) g(f) WHERE n // {_K} + CASE WHEN f < n % {_K} THEN 1 ELSE 0 END > 0""",
)
def _(spark, sf):
    rows, keys = classed(spark, sf), ["trip_id", "stop_sequence", "transit_date"]
    folds = split.stratified_kfold(rows, "y_true", keys, _K)
    return folds.groupBy("y_true", "kfold").agg(F.count("*").alias("n"))


@query(
    "l3_stratified_shuffle",
    "scored",
    f"""{CLASSED}, sizes AS (SELECT y_true, count(*) AS n FROM classed WHERE y_true IS NOT NULL GROUP BY y_true)
    , t AS (SELECT y_true, n, CAST(round(n * 0.3) AS BIGINT) AS t, CAST(s AS INTEGER) AS split
      FROM sizes, generate_series(0, 1) g(s))
    SELECT y_true, split, is_test, n FROM (SELECT y_true, split, 1 AS is_test, t AS n FROM t
      UNION ALL SELECT y_true, split, 0, n - t FROM t) WHERE n > 0""",
)
def _(spark, sf):
    rows = stage(classed(spark, sf).filter("y_true IS NOT NULL"), "classed")
    out = split.stratified_shuffle(rows, "y_true", ["trip_id", "stop_sequence", "transit_date"], 2)
    return out.groupBy("y_true", "split", F.col("is_test").cast("int").alias("is_test")).agg(F.count("*").alias("n"))


@query(
    "l4_sample_per_group",
    "stop_events",
    f"""{EV} SELECT route_id_direction, least(count(*), 20) AS n FROM (SELECT DISTINCT route_id_direction, transit_date,
      trip_id FROM ev) GROUP BY route_id_direction""",
)
def _(spark, sf):
    ev = route_direction_key(bind(spark, sf, "stop_events"))
    drawn = split.sample_per_group(ev, ["route_id_direction"], ["transit_date", "trip_id"], 20)
    return drawn.groupBy("route_id_direction").agg(F.count("*").alias("n"))


_STOPS = ("click", "error", "purchase", "signup", "view")


@query(
    "l5_one_hot",
    sql="SELECT event_id, "
    + ", ".join(f"CASE WHEN event_type = '{s}' THEN 1 ELSE 0 END AS stop_id_{s}" for s in _STOPS)
    + ", event_type AS stop_id FROM events",
)
def _(spark, sf):
    ev = bind(spark, sf, "stop_events").select("event_id", "stop_id")
    categories = encode.fit_categories(ev, ["stop_id"])
    hot = encode.one_hot(ev, categories).drop("stop_id")
    back = encode.one_hot_inverse(hot, categories)
    return hot.join(back, "event_id")


@query(
    "l5_one_hot_sparse",
    "stop_events",
    """, n AS (SELECT count(DISTINCT stop_id) AS stops, count(DISTINCT trip_id) AS trips FROM stop_events)
    SELECT event_id, stop_id, trip_id, dense_rank() OVER (ORDER BY stop_id) - 1 AS stop_slot,
      stops + dense_rank() OVER (ORDER BY trip_id) - 1 AS trip_slot, stops + trips AS size, 2 AS entries FROM stop_events, n""",
)
def _(spark, sf):
    ev = bind(spark, sf, "stop_events").select("event_id", "stop_id", "trip_id")
    cols = ["stop_id", "trip_id"]
    slots = stage(encode.category_slots(ev, cols), "slots")
    hot = encode.one_hot_sparse(ev, slots, cols).drop(*cols)
    back = encode.one_hot_sparse_inverse(hot, slots, {c: ev.schema[c].dataType.simpleString() for c in cols})
    rows = encode.one_hot_long(hot.withColumn("size", F.col("hot.size"))).groupBy("event_id")
    rows = rows.agg(
        F.min("slot").alias("stop_slot"), F.max("slot").alias("trip_slot"), F.first("size").alias("size"),
        F.sum("value").cast("int").alias("entries"),
    )
    return back.join(rows, "event_id")


@query(
    "l6_index_map",
    "stop_events",
    """SELECT event_id, stop_id, dense_rank() OVER (ORDER BY stop_id) - 1 AS stop_id_ix, stop_id AS stop_id_back
    FROM stop_events""",
)
def _(spark, sf):
    ev = bind(spark, sf, "stop_events").select("event_id", "stop_id")
    mapping = encode.index_map(ev, "stop_id")
    indexed = encode.apply_index(ev, mapping, "stop_id")
    back = encode.index_inverse(indexed.drop("stop_id"), mapping, "stop_id")
    return indexed.join(back.select("event_id", F.col("stop_id").alias("stop_id_back")), "event_id")


_TRAIN = "transit_date <= DATE '2024-01-15'"


def _register_scaler(kind: str, shift: str, width: str) -> None:
    @query(
        f"l7_scale_{kind}",
        "stop_events",
        f""", fit AS (SELECT {shift.format(c='ons')} AS a, {width.format(c='ons')} AS b, {shift.format(c='load')} AS e,
            {width.format(c='load')} AS f FROM stop_events WHERE {_TRAIN})
        SELECT event_id, {r('(ons - a) / b', 'ons')}, {r('(load - e) / f', 'load')} FROM stop_events, fit""",
    )
    def _(spark, sf):
        ev = bind(spark, sf, "stop_events")
        fitted = encode.fit_scaler(ev.filter(_TRAIN), ["ons", "load"], kind)
        return encode.scale(ev, fitted).select("event_id", "ons", "load")


_register_scaler("minmax", "CAST(min({c}) AS DOUBLE)", "CAST(max({c}) - min({c}) AS DOUBLE)")
_register_scaler("standard", "avg({c})", "stddev_pop({c})")


@query(
    "l8_align_columns",
    "stop_events",
    f"""SELECT load, {r('CAST(vehicle_id AS DOUBLE)', 'vehicle_id')}, event_id FROM stop_events
    WHERE vehicle_id IS NOT NULL AND load IS NOT NULL AND vehicle_id <> 7""",
)
def _(spark, sf):
    text = F.when(F.col("vehicle_id") == 7, "n/a").otherwise(F.col("vehicle_id").cast("string"))
    ev = bind(spark, sf, "stop_events").withColumn("vehicle_id", text)
    return encode.align_columns(ev, ["load", "vehicle_id", "event_id"], ["vehicle_id"])


_W = "(PARTITION BY block_abbr ORDER BY scheduled_time, event_id)"
_SEQ = {"cols": ["event_id", "load"], "keys": ["block_abbr"]}


def _over(n: int, m: int) -> str:
    """Frame from ``n`` rows before to ``m`` rows before."""
    end = f"{m} PRECEDING" if m else "CURRENT ROW"
    return f"{_W[:-1]} ROWS BETWEEN {n} PRECEDING AND {end})"


def _total(arr, field: str):
    return F.aggregate(arr, F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x[field].cast("long"), F.lit(0)))


def _joined(arr):
    return F.array_join(F.transform(arr, lambda x: F.coalesce(x.cast("string"), F.lit("-"))), ",")


def _list(expr: str, frame: str) -> str:
    return f"array_to_string(list(coalesce(CAST({expr} AS VARCHAR), '-')) OVER {frame}, ',')"


def _sequence_rows(spark, sf):
    ev = bind(spark, sf, "stop_events")
    return ev, Along(["scheduled_time", "event_id"], epoch_micros("scheduled_time"))


@query(
    "l9_sliding_sequences",
    "stop_events",
    f"""SELECT event_id, lag(event_id, 6) OVER w AS x_first, lag(event_id, 2) OVER w AS x_last,
      CAST(sum(coalesce(load, 0)) OVER {_over(6, 2)} AS BIGINT) AS x_load, {_list('load', _over(1, 0))} AS y
    FROM stop_events WINDOW w AS {_W} QUALIFY row_number() OVER w >= 7""",
)
def _(spark, sf):
    ev, along = _sequence_rows(spark, sf)
    out = sequence.sliding_sequences(ev, 5, 2, label="load", along=along, **_SEQ)
    return out.select(
        "event_id",
        F.get("x", F.lit(0))["event_id"].alias("x_first"),
        F.get("x", F.lit(4))["event_id"].alias("x_last"),
        _total("x", "load").alias("x_load"),
        _joined("y").alias("y"),
    )


@query(
    "l9_sliding_sequences_step",
    "stop_events",
    f"""SELECT event_id, lag(event_id, 6) OVER w AS x_first FROM stop_events WINDOW w AS {_W}
    QUALIFY row_number() OVER w >= 7 AND (row_number() OVER w - 7) % 3 = 0""",
)
def _(spark, sf):
    ev, along = _sequence_rows(spark, sf)
    out = sequence.sliding_sequences(ev, 5, 2, label="load", along=along, step=3, **_SEQ)
    return out.select("event_id", F.get("x", F.lit(0))["event_id"].alias("x_first"))


@query(
    "l10_encoder_decoder_sequences",
    "stop_events",
    f"""SELECT event_id, lag(event_id, 7) OVER w AS x_first, lag(event_id, 4) OVER w AS x_last,
      '-1,-1|-1,-1|-1,-1|-1,-1' AS decoder_input, {_list('load', _over(1, 0))} AS y
    FROM stop_events WINDOW w AS {_W} QUALIFY row_number() OVER w >= 8""",
)
def _(spark, sf):
    # 4 past rows, a gap of 2, 2 labels: runs of 8 rows
    ev, along = _sequence_rows(spark, sf)
    out = sequence.encoder_decoder_sequences(ev, 4, 2, label="load", along=along, offset=2, **_SEQ)
    return out.select(
        "event_id",
        F.get("x", F.lit(0))["event_id"].alias("x_first"),
        F.get("x", F.lit(3))["event_id"].alias("x_last"),
        F.array_join(F.transform("decoder_input", lambda x: F.array_join(x.cast("array<string>"), ",")), "|").alias("decoder_input"),
        _joined("y").alias("y"),
    )


@query(
    "l11_window_spec",
    "stop_events",
    f"""SELECT event_id, lag(event_id, 8) OVER w AS in_first, lag(event_id, 3) OVER w AS in_last,
      {_list('load', _over(1, 0))} AS labels FROM stop_events WINDOW w AS {_W} QUALIFY row_number() OVER w >= 9""",
)
def _(spark, sf):
    ev, along = _sequence_rows(spark, sf)
    out = sequence.window_spec(ev, 6, 2, 3, along=along, label_columns=["load"], **_SEQ)
    return out.select(
        "event_id",
        F.get("inputs", F.lit(0))["event_id"].alias("in_first"),
        F.get("inputs", F.lit(5))["event_id"].alias("in_last"),
        _joined(F.col("labels")["load"]).alias("labels"),
    )


@query(
    "l12_deterministic_future_sequences",
    "stop_events",
    f"""SELECT event_id, lag(event_id, 6) OVER w AS past_first, {_list('ons', _over(1, 0))} AS future_ons,
      {_list('load', _over(1, 0))} AS y FROM stop_events WINDOW w AS {_W} QUALIFY row_number() OVER w >= 7""",
)
def _(spark, sf):
    ev, along = _sequence_rows(spark, sf)
    out = sequence.deterministic_future_sequences(
        ev, 5, 2, ["load", "event_id", "ons"], 1, _SEQ["keys"], along
    )
    return out.select(
        "event_id",
        F.get("x_past", F.lit(0))["event_id"].alias("past_first"),
        _joined(F.col("x_future")["ons"]).alias("future_ons"),
        _joined("y").alias("y"),
    )


@query(
    "l13_block_batches",
    "stop_events",
    """, n AS (SELECT *, (row_number() OVER (PARTITION BY block_abbr ORDER BY scheduled_time, event_id) - 1) AS rn FROM stop_events)
    SELECT block_abbr, rn // 6 AS batch, min(event_id ORDER BY rn) FILTER (WHERE rn % 6 = 0) AS x_first,
      CAST(sum(coalesce(load, 0)) FILTER (WHERE rn % 6 < 5) AS BIGINT) AS x_load, max(load) FILTER (WHERE rn % 6 = 5) AS y
    FROM n GROUP BY block_abbr, rn // 6 HAVING count(*) = 6""",
)
def _(spark, sf):
    ev, along = _sequence_rows(spark, sf)
    out = sequence.block_batches(ev, 5, label="load", along=along, **_SEQ)
    return out.select(
        "block_abbr", "batch", F.get("x", F.lit(0))["event_id"].alias("x_first"), _total("x", "load").alias("x_load"), "y"
    )


_SQ = "pow(y_true - y_pred, 2)"


@query(
    "n1_rmse_by_window",
    "scored",
    f"{CLASSED} SELECT time_window, "
    + ", ".join(r(f"sqrt(avg({_SQ}) FILTER (WHERE kfold = {k}))", f'"{k}"') for k in range(3))
    + " FROM classed GROUP BY time_window",
)
def _(spark, sf):
    return metrics.rmse_by_window(classed(spark, sf), [0, 1, 2])


@query(
    "n2_mse_first_k",
    "scored",
    f"""{CLASSED}, head AS (SELECT * FROM classed QUALIFY row_number() OVER (PARTITION BY trip_id
        ORDER BY stop_sequence, transit_date, time_window, load) <= 3)
    SELECT trip_id, {r(f'avg({_SQ})', 'mse')} FROM head GROUP BY trip_id""",
)
def _(spark, sf):
    return metrics.mse_first_k(
        classed(spark, sf), 3, ["trip_id"], ["stop_sequence", "transit_date", "time_window", "load"]
    )


@query(
    "n2_mse_whole_trip",
    "scored",
    f"{CLASSED} SELECT trip_id, {r(f'avg({_SQ})', 'mse')} FROM classed GROUP BY trip_id",
)
def _(spark, sf):
    return metrics.mse_first_k(classed(spark, sf), None, ["trip_id"], [])


def _histogram(key: str, last: int) -> str:
    cols = ", ".join(
        f'count(*) FILTER (WHERE abs(y_true - y_pred) = {i}) AS "{i}"' for i in range(5)
    )
    return f"""{CLASSED} SELECT {key}, {cols} FROM generate_series(0, {last}) g(tw)
      LEFT JOIN classed ON classed.time_window = g.tw GROUP BY ALL"""


@query("n3_abs_error_histogram", "scored", _histogram("CAST(tw // 2 AS INTEGER) AS hour", 47))
def _(spark, sf):
    return metrics.abs_error_histogram(classed(spark, sf))


@query("n3_abs_error_histogram_compat", "scored", _histogram("CAST(tw AS INTEGER) AS time_window", 46))
def _(spark, sf):
    return metrics.abs_error_histogram(classed(spark, sf), pair=False, compat=True)


@query(
    "n4_compare_models",
    "scored",
    f"""{CLASSED}, a AS (SELECT time_window, avg(abs(y_true - y_pred)) AS e FROM classed GROUP BY ALL)
    , b AS (SELECT time_window, avg(abs(y_true - 1)) AS e FROM classed GROUP BY ALL)
    SELECT time_window, {r('a.e', 'model')}, {r('b.e', 'baseline')} FROM a FULL JOIN b USING (time_window)""",
)
def _(spark, sf):
    rows = classed(spark, sf)

    def error(pred):
        return rows.groupBy("time_window").agg(F.avg(F.abs(F.col("y_true") - pred)).alias("error"))

    return metrics.compare_models({"model": error(F.col("y_pred")), "baseline": error(F.lit(1))}, "time_window", "error")


DIFFS = f"""{MATCHED}, diffs AS (SELECT *, load - apc_load AS load_diff, ons - apc_ons AS ons_diff FROM matched)
, valid AS (SELECT * FROM diffs WHERE load_diff IS NOT NULL)
, remarks AS (SELECT transit_date, trip_id, remark FROM (SELECT transit_date, trip_id, remark, count(*) AS n FROM valid
    GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY transit_date, trip_id ORDER BY n DESC, remark) = 1)"""

_RATES = """
, rates AS (SELECT transit_date, trip_id, remark, bad, n - bad AS good, bad / n AS error_rate FROM (
    SELECT transit_date, trip_id, CAST(count(*) FILTER (WHERE load_diff NOT BETWEEN -2 AND 2) AS BIGINT) AS bad, count(*) AS n
    FROM valid GROUP BY ALL) JOIN remarks USING (transit_date, trip_id))"""


def _diffs(spark, sf):
    return metrics.count_discrepancy(matched(spark, sf))


def _rates(spark, sf):
    return metrics.trip_error_rate(_diffs(spark, sf).filter("load_diff IS NOT NULL"), "load_diff", -2, 2)


@query(
    "n5_trip_error_rate",
    "manual_checks",
    f"{DIFFS}{_RATES} SELECT {d('transit_date')}, trip_id, remark, good, bad, {r('error_rate', 'error_rate')} FROM rates",
)
def _(spark, sf):
    return _rates(spark, sf)


_SCORES = ", ".join(
    [
        r("CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END", "precision"),
        r("CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END", "recall"),
        r("CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END", "f1"),
    ]
)
_CONFUSION = """count(*) FILTER (WHERE t AND p) AS tp, count(*) FILTER (WHERE NOT t AND p) AS fp,
  count(*) FILTER (WHERE t AND NOT p) AS fn, count(*) FILTER (WHERE NOT t AND NOT p) AS tn"""


@query(
    "n6_precision_recall_f1",
    "manual_checks",
    f"""{DIFFS}{_RATES}, flags AS (SELECT error_rate >= 0.3 AS t, remark <> 'clean' AS p FROM rates)
    , c AS (SELECT {_CONFUSION} FROM flags) SELECT tp, fp, fn, tn, {_SCORES} FROM c""",
)
def _(spark, sf):
    return metrics.precision_recall_f1(_rates(spark, sf), F.col("error_rate") >= 0.3, F.col("remark") != "clean")


@query(
    "n7_threshold_sweep",
    "manual_checks",
    f"""{DIFFS}, cells AS (SELECT transit_date, trip_id, param, tolerance,
        count(*) FILTER (WHERE diff IS NULL OR abs(diff) > tolerance) / count(*) AS rate
      FROM (SELECT transit_date, trip_id, 'load' AS param, load_diff AS diff FROM valid
            UNION ALL SELECT transit_date, trip_id, 'ons', ons_diff FROM valid), generate_series(0, 20) g(tolerance)
      GROUP BY ALL)
    , flags AS (SELECT param, CAST(tolerance AS INTEGER) AS tolerance, k / 10 AS threshold, rate >= k / 10 AS t,
        remark <> 'clean' AS p FROM cells JOIN remarks USING (transit_date, trip_id), generate_series(0, 10) g(k))
    , c AS (SELECT param, tolerance, threshold, {_CONFUSION} FROM flags GROUP BY ALL)
    SELECT param, tolerance, {r('threshold', 'threshold')}, tp, fp, fn, tn, {_SCORES} FROM c""",
)
def _(spark, sf):
    return metrics.threshold_sweep(_diffs(spark, sf))


@query(
    "n8_confusion_matrix",
    "scored",
    f"""{CLASSED} SELECT CAST(g.y AS INTEGER) AS y_true, {', '.join(
        f'count(*) FILTER (WHERE y_pred = {i}) AS "{i}"' for i in range(5))}
    FROM generate_series(0, 4) g(y) LEFT JOIN classed ON classed.y_true = g.y GROUP BY g.y""",
)
def _(spark, sf):
    return metrics.confusion_matrix(classed(spark, sf), range(5))


@query(
    "n9_accuracy",
    "scored",
    f"{CLASSED} SELECT kfold, {r('avg(CAST(y_true = y_pred AS INTEGER))', 'accuracy')} FROM classed GROUP BY kfold",
)
def _(spark, sf):
    return metrics.accuracy(classed(spark, sf), by=["kfold"])


@query("n9_class_counts", "scored", f"{CLASSED} SELECT y_pred, count(*) AS count FROM classed GROUP BY y_pred")
def _(spark, sf):
    return metrics.class_counts(classed(spark, sf), "y_pred")


@query(
    "n10_count_discrepancy",
    "manual_checks",
    f"""{MATCHED} SELECT {d('transit_date')}, trip_id, stop_sequence, load - apc_load AS load_diff,
      ons - apc_ons AS ons_diff, offs - apc_offs AS offs_diff FROM matched""",
)
def _(spark, sf):
    return _diffs(spark, sf).select("transit_date", "trip_id", "stop_sequence", "load_diff", "ons_diff", "offs_diff")


