"""Time series by year: windows over pre-aggregated rows, one row a year and key."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import ratio
from ..shipping import ship


def _w(order: str, by: Sequence[str]):
    return Window.partitionBy(*by).orderBy(order) if by else Window.orderBy(order)


def rolling(x: str, before: int, after: int, least: int, order: str = "year", by: Sequence[str] = ()) -> Column:
    """A centred mean over rows, null where fewer than `least` have a value."""
    w = _w(order, by).rowsBetween(-before, after)
    return F.when(F.count(x).over(w) >= least, F.avg(x).over(w))


def difference(x: str, order: str = "year", by: Sequence[str] = ()) -> Column:
    return F.col(x) - F.lag(x).over(_w(order, by))


def change(x: str, order: str = "year", by: Sequence[str] = ()) -> Column:
    """Relative change against the row before, in per cent; null over a zero."""
    before = F.lag(x).over(_w(order, by))
    return (ratio(F.col(x), before) - 1) * 100


def percent_change(x: str, order: str = "year", by: Sequence[str] = ()) -> Column:
    """Change against the row before in per cent, gaps filled from the last value; infinite over a zero, NaN from zero to zero."""
    w = _w(order, by).rowsBetween(Window.unboundedPreceding, 0)
    now = F.last(F.col(x).cast("double"), ignorenulls=True).over(w)
    before = F.last(F.col(x).cast("double"), ignorenulls=True).over(_w(order, by).rowsBetween(Window.unboundedPreceding, -1))
    over = F.when(now == 0, float("nan")).when(now > 0, float("inf")).otherwise(float("-inf"))
    return F.when(before.isNull() | now.isNull(), None).when(before == 0, over).otherwise((now / F.nullif(before, F.lit(0.0)) - 1) * 100)


def running(x: str | Column, order: str = "year", by: Sequence[str] = ()) -> Column:
    return F.sum(x).over(_w(order, by).rowsBetween(Window.unboundedPreceding, 0))


def fill_forward(x: str, order: Sequence[str], by: Sequence[str], empty: str = "") -> Column:
    """The last non-empty value so far, the row's own included."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return F.coalesce(F.last(F.nullif(F.col(x), F.lit("")), ignorenulls=True).over(w), F.lit(empty))


def robust_z(df: DataFrame, x: str, by: Sequence[str] = (), name: str = "z") -> DataFrame:
    """0.6745 (x - median) / MAD, 0 where the MAD is 0: two medians, joined back by key."""
    keys = list(by) or ["__all"]
    rows = df if by else df.withColumn("__all", F.lit(1))
    m = rows.groupBy(*keys).agg(F.median(x).alias("__m"))
    rows = rows.join(m, keys).withColumn("__d", F.abs(F.col(x) - F.col("__m")))
    mad = rows.groupBy(*keys).agg(F.median("__d").alias("__mad"))
    z = F.when(F.col("__mad") == 0, F.lit(0.0)).otherwise(0.6745 * (F.col(x) - F.col("__m")) / F.nullif(F.col("__mad"), F.lit(0.0)))
    return rows.join(mad, keys).withColumn(name, z).drop("__m", "__d", "__mad", "__all")


def change_points(df: DataFrame, x: str, threshold: float = 2.5, order: str = "year", by: Sequence[str] = ()) -> DataFrame:
    """Rows whose first difference is a robust outlier; the first row's difference is 0, and groups of under five rows have none."""
    rows = df.where(F.col(x).isNotNull())
    rows = rows.withColumn("diff", F.coalesce(difference(x, order, by), F.lit(0.0)))
    rows = rows.withColumn("__n", F.count("*").over(Window.partitionBy(*(by or [F.lit(1)]))))
    return robust_z(rows.where("__n >= 5"), "diff", by).where(F.abs("z") >= threshold).drop("__n")


def lead_lag(df: DataFrame, x: str, y: str, most: int = 10, order: str = "year", least: int = 10) -> DataFrame:
    """corr(x at t, y at t + lag) for lags -most..most, by row number: one equi-join for all lags."""
    rows = df.select(F.row_number().over(Window.orderBy(order)).alias("i"), F.col(x).alias("x"), F.col(y).alias("y"))
    left = rows.select("x", "i", F.explode(F.sequence(F.lit(-most), F.lit(most))).alias("lag")).withColumn("j", F.col("i") + F.col("lag"))
    both = left.join(rows.select(F.col("i").alias("j"), "y"), "j").where("x is not null and y is not null")
    out = both.groupBy("lag").agg(F.corr("x", "y").alias("r"), F.count("*").alias("n"))
    return out.select("lag", F.when(F.col("n") >= least, F.col("r")).alias("pearson_r"), "n")


def window_corr(df: DataFrame, x: str, y: str, span: int = 10, order: str = "year", least: int = 5) -> DataFrame:
    """corr over the years [start, start + span - 1] for each starting year but the last ones: each row is dealt to its windows."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(order, x, y)
    ends = rows.agg(F.min(order).alias("lo"), F.max(order).alias("hi"))  # one row
    dealt = rows.select(x, y, F.explode(F.sequence(F.col(order) - (span - 1), F.col(order))).alias("start")).join(F.broadcast(ends), F.col("start").between(F.col("lo"), F.col("hi") - span))
    out = dealt.groupBy("start").agg(F.corr(x, y).alias("r"), F.count("*").alias("n"))
    return out.where(F.col("n") >= least).select("start", "r", "n")


def cagr(df: DataFrame, x: str, group: str, first: Column, last: Column, order: str = "year", edge: int = 5) -> DataFrame:
    """Growth a year between the means of a group's first and last rows; null with fewer rows or means not over 0."""
    up, down = Window.partitionBy(group).orderBy(order), Window.partitionBy(group).orderBy(F.desc(order))
    rows = df.withColumn("__i", F.row_number().over(up)).withColumn("__j", F.row_number().over(down))
    out = rows.groupBy(group).agg(F.avg(F.when(F.col("__i") <= edge, F.col(x))).alias("a"), F.avg(F.when(F.col("__j") <= edge, F.col(x))).alias("b"), F.count("*").alias("n"))
    ok = (F.col("n") >= edge) & (F.col("a") > 0) & (F.col("b") > 0)
    return out.select(group, F.when(ok, F.pow(F.col("b") / F.nullif(F.col("a"), F.lit(0.0)), 1 / (last - first)) - 1).alias("cagr"))


def _beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    h = d
    for m in range(1, 300):
        for t in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + t * d
            d = 1 / (d if abs(d) > 1e-300 else 1e-300)
            c = 1 + t / (c if abs(c) > 1e-300 else 1e-300)
            h *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * h


def t_probability(t: float, degrees: float) -> float:
    """Two-sided probability of Student's t."""
    return _beta(degrees / 2, 0.5, degrees / (degrees + t * t))


def pearson_p(r: Column | str, n: Column | str) -> Column:
    """The p value of a correlation of n pairs."""
    ship(SparkSession.active())
    return F.pandas_udf(_pearson_p, "double")(r, n)


def _pearson_p(r: pd.Series, n: pd.Series) -> pd.Series:
    out = []
    for x, k in zip(r, n, strict=True):
        if x is None or math.isnan(x) or k < 3:
            out.append(None)
        else:
            out.append(0.0 if abs(x) >= 1 else t_probability(x * math.sqrt((k - 2) / (1 - x * x)), k - 2))
    return pd.Series(out, dtype="float64")


def ols(df: DataFrame, y: str, x: str) -> DataFrame:
    """Slope, intercept, r, the slope's standard error and its two-sided p value of a simple regression."""
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    s = pairs.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.corr(y, x).alias("r"), F.count("*").alias("n"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"))
    error = F.sqrt(ratio((1 - F.col("r") * F.col("r")) * F.col("syy"), (F.col("n") - 2) * F.col("sxx")))
    return s.select("slope", "intercept", "r", "n", error.alias("stderr"), pearson_p("r", F.col("n").cast("double")).alias("p_value"))


def correlations(df: DataFrame, vec: str) -> DataFrame:
    """(i, j, r): the correlation of every two dimensions, i < j; one pass, pairs of a row are summed where they are made."""
    x = df.select(F.col(vec).cast("array<double>").alias("v")).select("v", F.posexplode("v").alias("i", "x"))
    pairs = x.select("i", "x", F.posexplode("v").alias("j", "y")).where("i < j")
    return pairs.groupBy("i", "j").agg(F.corr("x", "y").alias("r"))
