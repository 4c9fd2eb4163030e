"""Windows in ranges against Spark's own windows over whole series."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tallystone.operators import long_series as L


@pytest.fixture(scope="module")
def events(spark):
    rng = random.Random(5)
    rows = [(None if i % 97 == 0 else rng.choice([rng.randrange(500), 250]), i, "hot" if rng.random() < 0.8 else rng.choice(["a", None]), None if i < 6 or rng.random() < 0.3 else rng.randrange(-9, 9) * 1.0) for i in range(1200)]
    return spark.createDataFrame(rows, "t int, id int, k string, x double").repartition(5).cache()


def rows(df, *cols):
    return {r["id"]: tuple(None if r[c] is None else round(r[c], 9) for c in cols) for r in df.select("id", *cols).collect()}


@pytest.mark.parametrize("by", [[], ["k"]])
@pytest.mark.parametrize("ranges", [1, 8])
def test_equal_to_whole_windows(events, by, ranges):
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy("t", "id")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    place = events.withColumn("y", F.row_number().over(w) - 1)
    assert rows(L.placed(events, "t", by, ["id"], ranges, "y"), "y") == rows(place, "y")
    sums = events.withColumns({"y": F.sum("x").over(so_far), "n": F.sum(F.lit(1)).over(so_far)})
    assert rows(L.running_sums(events, "t", {"y": F.col("x"), "n": F.lit(1)}, by, ["id"], ranges), "y", "n") == rows(sums, "y", "n")
    assert rows(L.last_known(events, "t", "x", "y", by, ["id"], ranges), "y") == rows(events.withColumn("y", F.last("x", ignorenulls=True).over(so_far)), "y")


@pytest.mark.parametrize("before, after, span", [(6, 0, 50), (2, 2, 3), (0, 5, 5), (40, 30, 7), (0, 0, 10)])
def test_moving_frames_reach_over_borders(events, before, after, span):
    for by in ([], ["k"]):
        w = Window.partitionBy(*(by or [F.lit(0)])).orderBy("t", "id").rowsBetween(-before, after)
        want = events.withColumns({"m": F.avg("x").over(w), "n": F.count("x").over(w)})
        got = L.moving(events, "t", {"m": lambda w: F.avg("x").over(w), "n": lambda w: F.count("x").over(w)}, before, after, by, ["id"], 8, span)
        assert rows(got, "m", "n") == rows(want, "m", "n")
        assert sorted(got.columns) == sorted(want.columns)


def test_steps(events):
    w = Window.partitionBy(F.lit(0)).orderBy("t", "id")
    p = F.lag("x").over(w)
    want = events.withColumn("diff", F.col("x") - p).withColumn("pct", (F.col("x") / F.nullif(p, F.lit(0.0)) - 1) * 100)
    assert rows(L.steps(events, "t", "x", ties=["id"], ranges=8, span=20), "diff", "pct") == rows(want, "diff", "pct")


def test_a_long_series_is_many_tasks(events):
    plan = L.ranged(events, "t", 8).groupBy("__range").count().collect()
    assert len(plan) >= 4 and max(r["count"] for r in plan) < 900  # half of the rows have one value of t


def test_empty_series_and_bad_frames(events):
    none = events.limit(0)
    assert L.moving(none, "t", {"m": lambda w: F.avg("x").over(w)}, 2, 1).collect() == []
    assert L.running_sums(none, "t", {"s": F.col("x")}).collect() == []
    with pytest.raises(ValueError):
        L.moving(events, "t", {}, -1)
