import math

import pytest
from pyspark.sql import functions as F

from tallystone.operators import series as W
from tallystone.operators import shares as A


def series(spark, values):
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "year int, x double")


def values(df):
    return [r["y"] for r in df.orderBy("year").collect()]


def test_rolling_edges(spark):
    assert values(series(spark, [1, 2, 3, 4]).select("year", W.rolling("x", 2, 2, 3).alias("y"))) == [2, 2.5, 2.5, 3]
    assert values(series(spark, range(12)).select("year", W.rolling("x", 5, 4, 10).alias("y"))) == [None] * 5 + [4.5, 5.5, 6.5] + [None] * 4


def test_robust_z(spark):
    got = {r["x"]: r["z"] for r in W.robust_z(series(spark, [0, 1, 1, 2, 10]), "x").collect()}
    assert got == {0: pytest.approx(-0.6745), 1: 0, 2: pytest.approx(0.6745), 10: pytest.approx(6.0705)}
    assert {r["z"] for r in W.robust_z(series(spark, [3, 3, 3]), "x").collect()} == {0}


def test_change_points_need_five_rows(spark):
    assert W.change_points(series(spark, [0, 1, 50]), "x").count() == 0
    assert [r["year"] for r in W.change_points(series(spark, [0, 1, 1, 2, 2, 90, 91]), "x").collect()] == [5]


def test_cagr(spark):
    rows = series(spark, [100] * 5 + [150] * 3 + [200] * 5).withColumn("era", F.lit("e"))
    assert W.cagr(rows, "x", "era", F.lit(1820), F.lit(1859)).first()["cagr"] == pytest.approx(2 ** (1 / 39) - 1)
    assert W.cagr(rows.where("year < 4"), "x", "era", F.lit(1820), F.lit(1859)).first()["cagr"] is None


def test_ols_and_p_values(spark):
    p = spark.createDataFrame([(1.0, 2.0), (2.0, 4.5), (3.0, 5.0)], "x double, y double")
    r = W.ols(p, "y", "x").first()
    assert (r["slope"], r["intercept"], r["r"]) == (pytest.approx(1.5), pytest.approx(0.83333333), pytest.approx(0.93325653))
    assert W.t_probability(2.228138852, 10) == pytest.approx(0.05, abs=1e-8)
    assert W.t_probability(0, 5) == pytest.approx(1)


def test_lead_lag(spark):
    rows = spark.createDataFrame([(i, math.sin(i), math.sin(i - 2)) for i in range(60)], "year int, x double, y double")
    best = max(W.lead_lag(rows, "x", "y").collect(), key=lambda r: r["pearson_r"])
    assert best["lag"] == 2 and best["n"] == 58


def test_forward_fill(spark):
    rows = spark.createDataFrame([(0, None), (1, "H1"), (2, None), (3, ""), (4, None)], "pos int, h string").withColumn("p", F.lit(1))
    assert [r["y"] for r in rows.select("pos", W.fill_forward("h", ["pos"], ["p"]).alias("y")).orderBy("pos").collect()] == ["", "H1", "H1", "H1", "H1"]


def test_shares(spark):
    row = spark.createDataFrame([(0.5, 0.3, 0.2)], "a double, b double, c double")
    got = row.select(A.herfindahl([F.col(x) for x in "abc"]).alias("h"), A.entropy([F.lit(1.0), F.lit(1.0)]).alias("e")).first()
    assert got["h"] == pytest.approx(0.38) and got["e"] == pytest.approx(math.log(2))
    t = A.shares(spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 0.0)], "k string, x double"), ["k"], s="x")
    assert sorted((r["k"], r["s"]) for r in t.collect() if r["s"] is not None) == [("a", 0.25), ("a", 0.75)]
