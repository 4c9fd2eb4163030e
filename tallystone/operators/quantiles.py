"""Exact quantiles of groups of any size: bucket counts first, then only the buckets that hold a wanted rank."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored
from .long_series import count_under, run_ends

#: Most distinct values that one window sorts, borders a group gets in a round, groups whose borders are broadcast, and parts of a group beyond that.
BOUND, BORDERS, BROADCAST_GROUPS, PARTS = 1_000_000, 127, 4_096, 16


def exact_quantiles(df: DataFrame, keys: Sequence[str], x: str, at: Sequence[float], name: str = "q", bound: int = BOUND, borders: int = BORDERS, broadcast_groups: int = BROADCAST_GROUPS) -> DataFrame:
    """(keys, name): an array with one quantile for each share of `at`, linear between ranks as `percentile` has it.

    `percentile` keeps all distinct values of a group in one task's memory. Here values are counted once by (keys, value),
    which is even for hot groups and for hot values. A group of over `bound` distinct values is cut at `borders` quantiles
    of a sketch; the buckets' counts tell exactly which bucket holds each rank, and only those buckets go to the next
    round. So a task sorts at most `bound` values, and each round leaves about one in `borders` of the values.

    Null keys are a group; null values do not count, NaN is the greatest value; a group without values is not returned.
    """
    if not at or not all(0 <= p <= 1 for p in at):
        raise ValueError("quantiles are between 0 and 1")
    if bound < 2 or borders < 1:
        raise ValueError("a bound of two values and one border are the least")
    key = F.struct(*keys).alias("k") if keys else F.struct(F.lit(0)).alias("k")
    known = df.select(key, F.col(x).cast("double").alias("v")).where("v is not null")
    counts = stored(known.groupBy("k", "v").agg(F.count("*").alias("n")), "counts").withColumn("path", F.lit(""))
    place = F.col("p") * (F.col("n") - 1)
    totals = counts.groupBy("k").agg(F.sum("n").alias("n")).select("k", "n", F.posexplode(F.array(*[F.lit(float(p)) for p in at])).alias("slot", "p"))
    wanted = stored(totals.select("k", "slot", (place - F.floor(place)).alias("part"), F.floor(place).alias("low"), F.ceil(place).alias("high")), "wanted")
    ranks = wanted.select("k", F.explode(F.array_distinct(F.array("low", "high"))).alias("at")).distinct().withColumns({"path": F.lit(""), "rank": F.col("at")})
    found = []
    while True:
        sizes = counts.groupBy("k", "path").agg(F.count("*").alias("d"))
        big = sizes.where(F.col("d") > bound).select("k", "path")
        n_big = big.count()
        if not n_big:
            found.append(_settled(counts, ranks))
            break
        cut = stored(_cut(counts, big, n_big, borders, broadcast_groups), "buckets")
        small = sizes.where(F.col("d") <= bound).select("k", "path")  # done now; the next round takes the large ones only
        found.append(_settled(*(t.join(small, ["k", "path"], "left_semi") for t in (counts, ranks))))
        ranks = stored(_next(cut, ranks, borders), "ranks")
        need = ranks.select("k", "path").distinct()
        n_need = need.count()
        counts = stored(_joined(cut.select("k", "v", "n", "next").withColumnRenamed("next", "path"), need, n_need, broadcast_groups), "counts")
    values = found[0]
    for t in found[1:]:
        values = values.unionByName(t)
    values = stored(values, "values")  # both ends look them up
    ends = [wanted.join(values.select("k", F.col("at").alias(r), F.col("v").alias(f"x_{r}")), ["k", r]).select("k", "slot", "part", f"x_{r}") for r in ("low", "high")]
    both = ends[0].join(ends[1].select("k", "slot", "x_high"), ["k", "slot"])
    value = F.when(F.col("part") == 0, F.col("x_low")).otherwise((1 - F.col("part")) * F.col("x_low") + F.col("part") * F.col("x_high"))
    out = both.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("slot", value.alias("q")))).alias("s"))  # one entry a share of `at`
    return out.select(*[F.col("k")[c].alias(c) for c in keys], F.col("s.q").alias(name))


def _joined(rows: DataFrame, groups: DataFrame, n: int, most: int) -> DataFrame:
    """rows with the columns of their group, other rows left out. Beyond the bound a group's rows are dealt to parts by value."""
    if n <= most:
        return rows.join(F.broadcast(groups), ["k", "path"])
    parts = groups.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return rows.withColumn("part", F.pmod(F.xxhash64("v"), F.lit(PARTS)).cast("int")).join(parts, ["k", "path", "part"]).drop("part")


def _cut(counts: DataFrame, big: DataFrame, n_big: int, borders: int, most: int) -> DataFrame:
    """(k, path, v, n, next): the large groups' values, each with the path of its bucket."""
    shares = F.array(*[F.lit((i + 1) / (borders + 1)) for i in range(borders)])
    of_big = _joined(counts, big, n_big, most)
    edges = of_big.groupBy("k", "path").agg(F.percentile_approx("v", shares, 10_000).alias("edges"))
    width = max(math.isqrt(borders), 1)
    bucket = count_under("edges", "ends", width, lambda e: e <= F.col("v"))
    return _joined(counts, edges.withColumn("ends", run_ends("edges", width)), n_big, most).withColumn("next", F.concat_ws(".", "path", bucket)).drop("edges", "ends")


def _bucket(path: str) -> Column:
    return F.substring_index(F.col(path), ".", -1).cast("int")


def _next(cut: DataFrame, ranks: DataFrame, borders: int) -> DataFrame:
    """(k, path, rank, at) in the buckets: a group has at most borders + 1 of them."""
    sums = cut.groupBy("k", "path", "next").agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("k", "path").orderBy(_bucket("next")))
    ends = sums.select("k", "path", "next", (upto - F.col("n")).alias("before"), upto.alias("upto"))
    inside = (F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("upto"))
    return ranks.join(ends, ["k", "path"]).where(inside).select("k", "at", F.col("next").alias("path"), (F.col("rank") - F.col("before")).alias("rank"))


def _settled(counts: DataFrame, ranks: DataFrame) -> DataFrame:
    """(k, at, v): the values at the ranks, in groups whose distinct values one task can sort."""
    upto = F.sum("n").over(Window.partitionBy("k", "path").orderBy("v"))
    ends = counts.select("k", "path", "v", "n", upto.alias("upto"))
    wanted = ranks.groupBy("k", "path").agg(F.collect_list(F.struct("rank", "at")).alias("w"))  # two ranks a share of `at`, at most
    inside = F.filter("w", lambda w: (w["rank"] >= F.col("upto") - F.col("n")) & (w["rank"] < F.col("upto")))
    return ends.join(wanted, ["k", "path"]).select("k", "v", F.explode(inside).alias("r")).select("k", F.col("r.at").alias("at"), "v")
