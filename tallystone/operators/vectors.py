"""Vector operators: standardising, outliers, clustering with an exact silhouette, projections."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship


def long_form(df: DataFrame, id_col: str, vec: str) -> DataFrame:
    return df.select(id_col, F.posexplode(vec).alias("i", "x")).withColumn("x", F.col("x").cast("double"))


def standardised(df: DataFrame, id_col: str, vec: str, fill: bool = False) -> DataFrame:
    """(id, i, z): each dimension less its mean, over its population deviation; 0 where it does not vary.

    With fill missing numbers are their dimension's median.
    """
    rows = long_form(df, id_col, vec)
    if fill:
        median = rows.groupBy("i").agg(F.median("x").alias("__m"))  # as many rows as dimensions
        rows = rows.join(F.broadcast(median), "i").withColumn("x", F.coalesce("x", "__m")).drop("__m")
    s = rows.groupBy("i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("d"))  # as many rows as dimensions
    z = F.when(F.col("d") == 0, 0.0).otherwise((F.col("x") - F.col("m")) / F.nullif(F.col("d"), F.lit(0.0)))
    return rows.join(F.broadcast(s), "i").select(id_col, "i", z.alias("z"))


def outliers(df: DataFrame, id_col: str, vec: str, quantile: float = 0.95) -> DataFrame:
    """(id, distance, outlier): distance of the standardised vector from the centre; over the quantile is an outlier."""
    d = standardised(df, id_col, vec).groupBy(id_col).agg(F.sqrt(F.sum(F.col("z") * F.col("z"))).alias("distance"))
    limit = d.agg(F.percentile("distance", F.lit(quantile)).alias("limit"))  # one row
    return d.crossJoin(F.broadcast(limit)).select(id_col, "distance", (F.col("distance") > F.col("limit")).alias("outlier"))


def silhouette(x: np.ndarray, label: np.ndarray) -> float:
    """Mean silhouette with Euclidean distances; rows alone in their cluster count 0; -1 for a single cluster."""
    names = np.unique(label)
    if len(names) < 2:
        return -1.0
    d = np.sqrt(np.maximum(((x[:, None] ** 2).sum(2) if x.ndim == 1 else (x * x).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * x @ x.T), 0))
    sums = np.stack([d[:, label == n].sum(1) for n in names], 1)
    size = np.array([(label == n).sum() for n in names])
    own = np.searchsorted(names, label)
    row = np.arange(len(x))
    a = sums[row, own] / np.maximum(size[own] - 1, 1)
    other = sums / size
    other[row, own] = np.inf
    b = other.min(1)
    return float(np.where(size[own] == 1, 0, (b - a) / np.maximum(np.maximum(a, b), 1e-300)).mean())


def svd(df: DataFrame, id_col: str, vec: str, n: int) -> DataFrame:
    """(id, projected): uncentred singular value projection of dense vectors; null vectors are left out."""
    from .decompose import svd as sparse

    rows = long_form(df, id_col, vec).select(id_col, F.col("i").cast("string").alias("term"), F.col("x").alias("w"))
    return sparse(rows, id_col, k=n)[0].withColumnRenamed("vector", "projected")


#: Rows of a pair of blocks that are multiplied out at once.
STRIP = 512


def pairwise_cosine(df: DataFrame, id_col: str, vec: str, block: int = 8192) -> DataFrame:
    """(n, mean, least, most, spread) of the dot products of all pairs of unit vectors: a task sums a pair of blocks and returns one row.

    The work is the square of the number of vectors, and so are the copies of blocks that are shuffled, over `block`.
    """
    ship(df.sparkSession)
    rows = df.select(F.col(id_col).alias("id"), F.col(vec).cast("array<double>").alias("v")).where("id is not null and v is not null")
    parts = -(-rows.count() // block) or 1
    own = F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")
    # block pairs p <= q: a row is left in those with its block first, and right in those with it second
    rows = rows.withColumn("o", own)
    left = rows.select(F.col("o").alias("p"), F.explode(F.sequence("o", F.lit(parts - 1))).alias("q"), F.lit(0).alias("side"), "id", "v")
    right = rows.select(F.explode(F.sequence(F.lit(0), "o")).alias("p"), F.col("o").alias("q"), F.lit(1).alias("side"), "id", "v")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        a, b = (group[group["side"] == s] for s in (0, 1))
        if not len(a) or not len(b):
            return pd.DataFrame({"n": [], "s": [], "q": [], "a": [], "b": []})
        left, right, one = np.stack(a["v"].to_numpy()), np.stack(b["v"].to_numpy()).T, group["p"].iloc[0] == group["q"].iloc[0]
        out = []
        for k in range(0, len(left), STRIP):
            x = left[k : k + STRIP] @ right
            x = x[a["id"].to_numpy()[k : k + STRIP, None] < b["id"].to_numpy()] if one else x.reshape(-1)
            if len(x):
                out.append((len(x), x.sum(), (x * x).sum(), x.min(), x.max()))
        return pd.DataFrame(out, columns=["n", "s", "q", "a", "b"])

    sums = left.unionByName(right).groupBy("p", "q").applyInPandas(run, "n long, s double, q double, a double, b double")
    t = sums.agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.min("a").alias("least"), F.max("b").alias("most"))
    mean = F.col("s") / F.nullif(F.col("n"), F.lit(0))
    return t.select("n", mean.alias("mean"), "least", "most", F.sqrt(F.greatest(F.col("q") / F.nullif(F.col("n"), F.lit(0)) - mean * mean, F.lit(0.0))).alias("spread"))


def purity(df: DataFrame, cluster: str, label: str) -> DataFrame:
    """One row: the share of rows that have their cluster's most frequent label."""
    c = df.groupBy(cluster, label).agg(F.count("*").alias("n"))
    m = c.groupBy(cluster).agg(F.max("n").alias("m"), F.sum("n").alias("n"))
    return m.agg((F.sum("m") / F.sum("n")).alias("purity"))


def chunk_mean(df: DataFrame, doc: str, vec: str, weight: str) -> DataFrame:
    """The weighted mean of a document's chunk vectors, dimension by dimension."""
    rows = df.select(doc, F.col(weight).alias("w"), F.posexplode(vec).alias("i", "x"))
    m = rows.groupBy(doc, "i").agg((F.sum(F.col("x") * F.col("w")) / F.sum("w")).alias("x"))
    return m.groupBy(doc).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda r: r["x"]).alias(vec))


def lag_similarity(series: DataFrame, order: str, back: int = 10) -> DataFrame:
    """Mean similarity of each unit to at most `back` units before it: series has (a, b, similarity) by unit numbers."""
    w = Window.partitionBy("b")
    return series.where((F.col("a") < F.col("b")) & (F.col("b") - F.col("a") <= back)).withColumn(order, F.avg("similarity").over(w)).select("b", order).distinct()
