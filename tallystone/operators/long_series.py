"""Windows over one long series, or a few hot ones: ranges of the order, halo rows and carried totals instead of one task a series."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

#: Ranges that an order is cut into.
RANGES = 1_024


def run_ends(borders: str, width: int) -> Column:
    """The last value of each whole run of `width` values of an array."""
    return F.filter(borders, lambda _, i: (i + 1) % width == 0)


def count_under(borders: str, ends: str, width: int, under: Callable[[Column], Column]) -> Column:
    """How many of an ascending array's values are under a bound: whole runs by their ends, then the values of the next run."""
    runs = F.size(F.filter(ends, under)) * width
    return runs + F.size(F.filter(F.slice(borders, runs + 1, width), under))


def ranged(df: DataFrame, order: str, ranges: int = RANGES) -> DataFrame:
    """df with __range, ascending with `order`: equal values share a range, null ones are in the first.

    The ranges are quantiles of a sketch. Where they are changes how work is shared out, never a result.
    """
    if ranges < 2:
        return df.withColumn("__range", F.lit(0))
    shares = F.array(*[F.lit((i + 1) / ranges) for i in range(ranges - 1)])
    width = math.isqrt(ranges)
    borders = df.agg(F.coalesce(F.array_distinct(F.percentile_approx(order, shares, 10_000)), F.array()).alias("__borders")).withColumn("__ends", run_ends("__borders", width))
    at = F.when(F.col(order).isNull(), 0).otherwise(count_under("__borders", "__ends", width, lambda b: b < F.col(order)))
    return df.join(F.broadcast(borders)).withColumn("__range", at).drop("__borders", "__ends")  # one row


def _within(by: Sequence[str], order: str, ties: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*by, "__range").orderBy(order, *ties)


def _carried(rows: DataFrame, by: Sequence[str], totals: Mapping[str, Column], carry: Callable[[str, WindowSpec], Column]) -> DataFrame:
    """rows with one column a total: what the ranges before a row's own carry over; a series has at most RANGES of them."""
    each = rows.groupBy(*by, "__range").agg(*[t.alias(name) for name, t in totals.items()])
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    before = each.select(*by, "__range", *[carry(name, w).alias(name) for name in totals])
    if not by:
        return rows.join(F.broadcast(before), "__range")  # a row a range
    return rows.alias("r").join(before.alias("b"), [F.col(f"r.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*by, "__range"]]).select("r.*", *[f"b.{name}" for name in totals])


def placed(df: DataFrame, order: str, by: Sequence[str] = (), ties: Sequence[str] = (), ranges: int = RANGES, name: str = "place") -> DataFrame:
    """df with each row's number in its series, from 0. Rows with equal `order` and `ties` come in any order."""
    rows = ranged(df, order, ranges)
    rows = _carried(rows, by, {"__before": F.count("*")}, lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0)))
    return rows.withColumn(name, F.col("__before") + F.row_number().over(_within(by, order, ties)) - 1).drop("__before", "__range")


def running_sums(df: DataFrame, order: str, sums: Mapping[str, Column], by: Sequence[str] = (), ties: Sequence[str] = (), ranges: int = RANGES) -> DataFrame:
    """df with one column a sum, up to each row and with it; null until a value came, as windows have it."""
    names = {name: f"__x{i}" for i, name in enumerate(sums)}
    rows = ranged(df.withColumns({names[name]: x for name, x in sums.items()}), order, ranges)
    rows = _carried(rows, by, {f"{c}_before": F.sum(c) for c in names.values()}, lambda c, w: F.sum(c).over(w))
    w = _within(by, order, ties).rowsBetween(Window.unboundedPreceding, 0)

    def both(c: str) -> Column:
        here, before = F.sum(c).over(w), F.col(f"{c}_before")
        return F.coalesce(here + before, here, before)

    return rows.withColumns({name: both(c) for name, c in names.items()}).drop("__range", *names.values(), *[f"{c}_before" for c in names.values()])


def last_known(df: DataFrame, order: str, x: str, name: str, by: Sequence[str] = (), ties: Sequence[str] = (), ranges: int = RANGES) -> DataFrame:
    """df with the last non-null x so far, the row's own included."""
    key = F.struct(order, *ties)
    rows = ranged(df, order, ranges)
    rows = _carried(rows, by, {"__last": F.max_by(x, F.when(F.col(x).isNotNull(), key))}, lambda c, w: F.last(c, ignorenulls=True).over(w))
    here = F.last(x, ignorenulls=True).over(_within(by, order, ties).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn(name, F.coalesce(here, F.col("__last"))).drop("__range", "__last")


def moving(df: DataFrame, order: str, values: Mapping[str, Callable[[WindowSpec], Column]], before: int, after: int = 0, by: Sequence[str] = (), ties: Sequence[str] = (), ranges: int = RANGES, span: int = 100_000) -> DataFrame:
    """df with one column a value over the rows from `before` rows back to `after` rows ahead.

    A series is cut into stretches of `span` rows (more if the frame is longer), counted by place. Each stretch also gets
    the halo rows next to it that its frames reach, so that it is a task of its own, and hands back its own rows only.
    A value gets the window of that frame, and may narrow it with `rowsBetween`.
    """
    if before < 0 or after < 0:
        raise ValueError("frames reach back and ahead by no less than 0 rows")
    size = max(span, before, after, 1)
    rows = placed(df, order, by, ties, ranges, "__place")
    own, inside = F.expr(f"__place div {size}"), F.col("__place") % size
    copies = F.filter(F.array(own, F.when(inside >= size - before, own + 1), F.when((inside < after) & (own > 0), own - 1)), lambda s: s.isNotNull())
    dealt = rows.withColumn("__own", own).withColumn("__stretch", F.explode(copies))
    w = Window.partitionBy(*by, "__stretch").orderBy("__place").rowsBetween(-before, after)
    return dealt.withColumns({name: f(w) for name, f in values.items()}).where("__stretch = __own").drop("__own", "__stretch", "__place")


def steps(df: DataFrame, order: str, x: str, by: Sequence[str] = (), ties: Sequence[str] = (), ranges: int = RANGES, span: int = 100_000) -> DataFrame:
    """df with diff and pct, the change of x against the row before and the same in per cent; null over a zero and at the start."""
    out = moving(df, order, {"__pair": lambda w: F.collect_list(F.struct(F.col(x).alias("x"))).over(w)}, 1, 0, by, ties, ranges, span)
    last = F.when(F.size("__pair") == 2, F.col("__pair")[0]["x"])
    return out.withColumn("diff", F.col(x) - last).withColumn("pct", (F.col(x) / F.nullif(last.cast("double"), F.lit(0.0)) - 1) * 100).drop("__pair")
