"""Grouped totals, shares, pivots and sweeps over settings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ratio


def totals(df: DataFrame, keys: Sequence[str], **sums: Column | str) -> DataFrame:
    """Sums by key; rows with a null key are left out."""
    kept = df.dropna(subset=list(keys)) if keys else df
    return kept.groupBy(*keys).agg(*[F.sum(x).alias(k) for k, x in sums.items()])


def shares(df: DataFrame, within: Sequence[str], **of: str) -> DataFrame:
    """Each row's share of the sum over its group: a window, not a join. of: share column to value column."""
    w = Window.partitionBy(*within)
    return df.select("*", *[ratio(F.col(v), F.sum(v).over(w)).alias(k) for k, v in of.items()])


def wide(df: DataFrame, keys: Sequence[str], pivot: str, values: Sequence, measure: Column, fill: float | None = 0.0) -> DataFrame:
    """One column for each of a fixed list of values, filled where a cell is empty; the list saves a pass over the data."""
    out = df.groupBy(*keys).pivot(pivot, list(values)).agg(measure)
    return out if fill is None else out.fillna(fill)


def weighted_mean(x: Column, w: Column) -> Column:
    return ratio(F.sum(x * w), F.sum(F.when(x.isNotNull(), w)))


def herfindahl(shares_: Sequence[Column]) -> Column:
    return sum((F.coalesce(s, F.lit(0.0)) * F.coalesce(s, F.lit(0.0)) for s in shares_), F.lit(0.0))


def entropy(cells: Sequence[Column]) -> Column:
    """Shannon entropy, natural logarithm, of cells clipped at 1e-9 and normalised."""
    clipped = [F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(1e-9)) for c in cells]
    total = sum(clipped[1:], clipped[0])
    return -sum((c / total * F.log(c / total) for c in clipped), F.lit(0.0))


def sweep(df: DataFrame, settings: Mapping[str, Sequence]) -> DataFrame:
    """All rows under each setting of one parameter table, in one scan: an exploded literal list."""
    for name, values in settings.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return df


def first_by(value: str | Column, *order: str | Column) -> Column:
    """The value of the first row in an order."""
    return F.min_by(value, F.struct(*order))


def joined_text(value: str, order: Sequence[str], sep: str = " ") -> Column:
    """A group's texts in an order."""
    rows = F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("__v"))))
    return F.array_join(F.transform(rows, lambda r: r["__v"]), sep)


def mode(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """The most frequent value of each group; of equal counts the least value."""
    n = df.groupBy(*keys, value).agg(F.count("*").alias("__n"))
    return n.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("__n"), F.col(value))).alias(name))


def top(df: DataFrame, within: Sequence[str], n: int, *order: Column, rank: str = "rank") -> DataFrame:
    """The first n rows of each group with their rank from 1."""
    w = Window.partitionBy(*within).orderBy(*order) if within else Window.orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)
