"""Exact quantiles against numpy, in one round and in many."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallystone.operators.quantiles import exact_quantiles

AT = [0.0, 0.025, 0.25, 0.5, 0.9, 1.0]


def check(got, rows, at=AT):
    groups = {}
    for k, v in rows:
        if v is not None:
            groups.setdefault(k, []).append(v)
    assert {r["k"] for r in got} == set(groups) and len(got) == len(groups)
    for r in got:
        assert r["q"] == pytest.approx(list(np.quantile(groups[r["k"]], at)), abs=1e-9)


@pytest.mark.parametrize("bound, groups", [(1_000_000, 4_096), (40, 4_096), (40, 0)])
def test_hot_group_ties_and_nulls(spark, bound, groups):
    rng = np.random.default_rng(3)
    rows = [("hot", float(v)) for v in rng.lognormal(0, 3, 3000)] + [("hot", 1.5)] * 900 + [("ties", 7.0)] * 500
    rows += [(None, float(v)) for v in rng.integers(-50, 50, 400)] + [("one", 2.0), ("none", None), ("two", 1.0), ("two", 2.0)] + [("hot", None)] * 5
    df = spark.createDataFrame(rows, "k string, x double").withColumn("q", F.lit("clash")).repartition(6)
    check(exact_quantiles(df, ["k"], "x", AT, bound=bound, borders=7, broadcast_groups=groups).collect(), rows)


def test_no_task_sorts_more_than_the_bound(spark):
    df = spark.range(20_000).select(F.lit(1).alias("k"), (F.col("id") * 7919 % 20_011).cast("double").alias("x"))
    got = exact_quantiles(df, ["k"], "x", [0.5], bound=16, borders=9)
    assert got.first()["q"] == pytest.approx([np.median(np.arange(20_000) * 7919 % 20_011)])


def test_without_keys_and_whole_numbers(spark):
    df = spark.range(101).select(F.col("id").alias("x"))
    got = exact_quantiles(df, [], "x", [0.25, 0.333], name="of_all", bound=4, borders=3).collect()
    assert len(got) == 1 and got[0]["of_all"] == pytest.approx([25, 33.3])


def test_two_keys_empty_tables_and_nan(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "a", 3.0), (1, "b", 5.0), (2, None, float("nan")), (2, None, 1.0)], "a int, b string, x double")
    got = {(r["a"], r["b"]): r["q"] for r in exact_quantiles(df, ["a", "b"], "x", [0.0, 0.5, 1.0]).collect()}
    assert got[1, "a"] == [1, 2, 3] and got[1, "b"] == [5, 5, 5]
    assert got[2, None][0] == 1 and math.isnan(got[2, None][2])
    assert exact_quantiles(df.limit(0), ["a"], "x", [0.5]).collect() == []


def test_shares_are_checked(spark):
    with pytest.raises(ValueError):
        exact_quantiles(spark.range(3), [], "id", [1.5])
