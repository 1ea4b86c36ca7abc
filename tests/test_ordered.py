"""Cut groups must give what a plain window over the whole group gives, also when one group holds most rows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ridership.operators import ordered
from ridership.operators.ordered import Along


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows in one group, a NULL group, NULL and tied positions, NULL values."""
    rng = random.Random(7)
    rows = []
    for i in range(900):
        key = 0 if i % 3 == 0 else rng.choice([1, 2, 3, 4, 5, None])
        pos = None if rng.random() < 0.03 else rng.randint(0, 60) if rng.random() < 0.7 else 30
        rows.append((i, key, pos, None if rng.random() < 0.4 else rng.randint(0, 9)))
    return spark.createDataFrame(rows, "id int, key int, pos int, v int").repartition(4).cache()


def along(piece_rows):
    return Along(["pos", "id"], F.col("pos"), piece_rows)


def window(keys, descending=False):
    sorts = [F.col(c).desc_nulls_last() if descending else F.col(c).asc_nulls_first() for c in ("pos", "id")]
    return Window.partitionBy(*keys).orderBy(*sorts)


def rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


PIECES = [5_000_000, 40, 7]


@pytest.mark.parametrize("piece_rows", PIECES)
@pytest.mark.parametrize("keys", [["key"], []])
@pytest.mark.parametrize("descending", [False, True])
def test_neighbours(skewed, keys, piece_rows, descending):
    exprs = {
        "l1": lambda w: F.lag("v").over(w),
        "l3": lambda w: F.lag("v", 3).over(w),
        "last4": lambda w: F.collect_list("v").over(w.rowsBetween(-4, -1)),
        "n": lambda w: F.count(F.lit(1)).over(w.rowsBetween(-4, -1)),
    }
    got = ordered.over_neighbours(skewed, keys, along(piece_rows), 4, exprs, descending, carry=["v"])
    want = skewed.withColumns({n: f(window(keys, descending)) for n, f in exprs.items()})
    assert rows(got) == rows(want)


@pytest.mark.parametrize("piece_rows", PIECES)
@pytest.mark.parametrize("keys", [["key"], []])
@pytest.mark.parametrize("descending", [False, True])
def test_running(skewed, keys, piece_rows, descending):
    w = window(keys, descending).rowsBetween(Window.unboundedPreceding, 0)
    got = ordered.running_sum(skewed, keys, along(piece_rows), {"s": F.col("v"), "rn": F.lit(1)}, descending)
    want = skewed.withColumns({"s": F.sum(F.coalesce("v", F.lit(0))).over(w), "rn": F.count(F.lit(1)).over(w)})
    assert rows(got) == rows(want)
    got = ordered.running_last(skewed, keys, along(piece_rows), {"last": F.col("v")}, descending)
    assert rows(got) == rows(skewed.withColumn("last", F.last("v", ignorenulls=True).over(w)))


def test_pieces_are_bounded_and_follow_the_order(skewed):
    cut = ordered.cut_pieces(skewed, ["key"], along(20))
    sizes = {
        r["key"]: (r["pieces"], r["largest"])
        for r in cut.groupBy("key", "_slot")
        .count()
        .groupBy("key")
        .agg(F.count("_slot").alias("pieces"), F.max("count").alias("largest"))
        .collect()
    }
    assert sizes[0][0] >= 8
    # 30 is the position of about a third of the rows; equal positions are cut by the next column of the order
    assert sizes[0][1] <= 20
    place = F.struct(F.coalesce("pos", F.lit(-1)).alias("pos"), "id")
    ends = cut.filter("key = 0").groupBy("_slot").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).orderBy("_slot")
    last = (-2, -1)
    for _, lo, hi in ends.collect():
        assert tuple(lo) > last
        last = tuple(hi)


def test_one_position_of_many_rows_is_cut(spark):
    same = spark.range(2000).selectExpr("1 AS key", "id", "7 AS pos")
    cut = ordered.cut_pieces(same, ["key"], along(100))
    assert cut.groupBy("_slot").count().agg(F.max("count")).first()[0] <= 100
    got = ordered.row_numbers(same, ["key"], along(100), "n")
    assert got.filter("n <> id + 1").count() == 0


def test_small_groups_are_left_whole(skewed):
    assert ordered.cut_pieces(skewed, ["key"], along(1000)).filter("_slot IS NOT NULL").count() == 0


def test_two_passes_share_the_pieces(skewed):
    cut = ordered.cut_pieces(skewed, ["key"], along(20))
    out = ordered.running_sum(cut, ["key"], along(20), {"s": F.col("v")})
    assert "_slot" in out.columns
    out = ordered.over_neighbours(out, ["key"], along(20), 1, {"p": lambda w: F.lag("s").over(w)}, carry=["s"])
    w = window(["key"])
    want = skewed.withColumn("s", F.sum(F.coalesce("v", F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    assert rows(out.drop("_slot")) == rows(want.withColumn("p", F.lag("s").over(w)))


def test_top_k(skewed):
    got = ordered.top_k(skewed, ["key"], [F.col("pos").desc(), F.col("id")], 3)
    assert got.groupBy("key").count().agg(F.max("count")).first()[0] == 3
    assert got.count() == 21  # seven groups, the NULL one included


def test_empty_input(skewed):
    none = skewed.filter("false")
    for keys in (["key"], []):
        assert ordered.running_sum(none, keys, along(5), {"s": F.col("v")}).count() == 0
        assert ordered.over_neighbours(none, keys, along(5), 2, {"p": lambda w: F.lag("v").over(w)}, carry=["v"]).count() == 0
