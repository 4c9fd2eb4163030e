"""Agreement of raters, and bootstrap intervals from resampled pages."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship
from ..storage import stored


def _known(x: str) -> Column:
    return F.coalesce(F.col(x).cast("string"), F.lit("unknown"))


def cohen(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row (kappa, n): a cross table in long form; null labels are a class of their own."""
    c = df.groupBy(_known(a).alias("a"), _known(b).alias("b")).agg(F.count("*").alias("n"))
    row, column = c.groupBy(F.col("a").alias("k")).agg(F.sum("n").alias("x")), c.groupBy(F.col("b").alias("k")).agg(F.sum("n").alias("y"))
    expected = row.join(column, "k").agg(F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0)).alias("e"))
    seen = c.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("s"))
    both = seen.crossJoin(expected)  # one row each
    po, pe = F.col("s") / F.col("n"), F.col("e") / (F.col("n").cast("double") * F.col("n"))
    return both.select(F.try_divide(po - pe, F.nullif(1 - pe, F.lit(0.0))).alias("kappa"), "n")


def fleiss(df: DataFrame, raters: Sequence[str]) -> DataFrame:
    """One row (kappa, n_items, n_categories) for any number of raters; null if all agree by chance alone."""
    m = len(raters)
    items = df.select(F.array(*map(_known, raters)).alias("l"))
    same = F.aggregate(F.transform(F.array_distinct("l"), lambda k: F.size(F.filter("l", lambda x: x == k))), F.lit(0), lambda s, n: s + n * n)
    p = items.agg(F.avg((same - m) / float(m * (m - 1))).alias("p"), F.count("*").alias("n_items"))
    shares = items.select(F.explode("l").alias("k")).groupBy("k").agg(F.count("*").alias("n"))
    e = shares.agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("q"), F.sum("n").alias("t"), F.count("*").alias("n_categories"))
    pe = F.col("q") / (F.col("t").cast("double") * F.col("t"))
    return p.crossJoin(e).select(F.when(1 - pe >= 1e-10, (F.col("p") - pe) / F.nullif(1 - pe, F.lit(0.0))).alias("kappa"), "n_items", "n_categories")


def agreement(df: DataFrame, raters: Sequence[str]) -> DataFrame:
    """(label, n_items, n_agree, agree_rate) by the first rater's label."""
    same = F.size(F.array_distinct(F.array(*map(_known, raters)))) == 1
    g = df.groupBy(_known(raters[0]).alias("label")).agg(F.count("*").alias("n_items"), F.count_if(same).alias("n_agree"))
    return g.withColumn("agree_rate", F.col("n_agree") / F.col("n_items"))


#: Modulus and factors of the draws' hash; all products stay below 2**63.
_P, _A, _B, _C = 2147483647, 1000003, 7919, 48271


def draw_hash(draw: Column, slot: Column, seed: int) -> Column:
    """A number below 2**31 for a draw and a slot: two squarings modulo a prime, which SQL engines can repeat."""
    u = (draw * _A + slot * _B + seed) % _P
    u = (u * u + draw) % _P
    u = (u * _C + slot) % _P
    return (u * u + 12345) % _P


def numbered(pages: DataFrame, page: str, bucket: Column) -> DataFrame:
    """pages with __i, their place in the order of (bucket, page): counted in buckets, so that no task sorts all pages."""
    b = pages.withColumn("__b", bucket)
    sizes = b.groupBy("__b").agg(F.count("*").alias("__n"))  # one row a bucket
    before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    rank = F.row_number().over(Window.partitionBy("__b").orderBy(page)) - 1
    return b.withColumn("__r", rank).join(F.broadcast(first), "__b").withColumn("__i", F.col("__first") + F.col("__r")).drop("__b", "__r", "__first")


#: Slots of a draw that a task picks at once, and pages of a block, which a task sums for all draws.
SLOTS, BLOCK = 1 << 22, 1 << 15


def _folded(u: np.ndarray) -> np.ndarray:
    """u modulo the draws' prime 2**31 - 1, for 0 <= u < 2**63."""
    u = (u & _P) + (u >> 31)
    u = (u & _P) + (u >> 31)
    return np.where(u >= _P, u - _P, u)


def picks(draw: int, slots: np.ndarray, n: int, seed: int) -> np.ndarray:
    """The pages in a draw's slots: draw_hash modulo n, in numpy."""
    u = _folded(draw * _A + slots * _B + seed)
    u = _folded(u * u + draw)
    u = _folded(u * _C + slots)
    u = _folded(u * u + 12345)
    return u - u // n * n


def packed_picks(draw: int, first: int, n: int, seed: int, slots: int | None = None, size: int | None = None) -> Iterator[tuple[int, bytes]]:
    """(block, how often each of its pages is in the slots from first on, one compressed number a page) for blocks with picks."""
    slots, size = slots or SLOTS, size or BLOCK
    i = picks(draw, np.arange(first, min(n, first + slots), dtype=np.int64), n, seed)
    if n <= 4 * slots:
        counts = np.bincount(i, minlength=n)
        found = ((b, counts[b * size : (b + 1) * size]) for b in range(-(-n // size)))
    else:  # few slots for so many pages
        i = np.sort(i)
        cut = np.searchsorted(i, np.arange(0, n + size, size))
        found = ((b, np.bincount(i[cut[b] : cut[b + 1]] - b * size, minlength=min(size, n - b * size))) for b in np.flatnonzero(cut[1:] > cut[:-1]))
    for b, c in found:
        if c.any():
            kind = np.uint8 if c.max() < 256 else np.uint32
            yield int(b), bytes([np.dtype(kind).itemsize]) + zlib.compress(c.astype(kind).tobytes(), 1)


def _counts(part: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(part[1:]), np.uint8 if part[0] == 1 else np.uint32)


def _drawn_sums(values: DataFrame, n: int, draws: int, seed: int) -> DataFrame:
    """(k, draw, a, b): sums of values (i, k, a, b) over each draw's slots; null where a draw has no number that is not null."""
    spark = values.sparkSession
    ship(spark)
    size, ranges = BLOCK, -(-n // SLOTS)
    blocks = -(-n // size)
    slots = SLOTS

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for task in batch.column(0).to_pylist():
                draw, r = divmod(task, ranges)
                found = list(packed_picks(draw, r * slots, n, seed, slots, size))
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in found], pa.int64()), pa.array([draw] * len(found), pa.int64()), pa.array([p for _, p in found], pa.binary())], names=["block", "draw", "part"])

    def add(picked: pd.DataFrame, here: pd.DataFrame) -> pd.DataFrame:
        if not len(picked) or not len(here):
            return pd.DataFrame({c: [] for c in ("k", "draw", "a", "b", "na", "nb")})
        i, own = here["i"].to_numpy(), here["k"].to_numpy()
        order = np.argsort(own, kind="stable")
        i, own, x = i[order], own[order], here[["a", "b", "na", "nb"]].to_numpy(float)[order]
        finite = np.isfinite(x).all()
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        ends = np.append(first[1:], len(own))
        out = []
        for draw, part in zip(picked["draw"], picked["part"], strict=True):
            c = _counts(part)[i].astype(float)
            if finite:
                sums = np.stack([c[s:e] @ x[s:e] for s, e in zip(first, ends, strict=True)])
            else:  # what is not drawn does not count, whatever it is
                sums = np.add.reduceat(np.where(c[:, None] > 0, c[:, None] * x, 0.0), first)
            out.append(np.column_stack([own[first], np.full(len(first), draw), sums]))
        return pd.DataFrame(np.vstack(out), columns=["k", "draw", "a", "b", "na", "nb"])

    tasks = draws * ranges
    picked = spark.range(0, tasks, 1, min(tasks, 4 * spark.sparkContext.defaultParallelism)).mapInArrow(pick, "block long, draw long, part binary")
    dealt = values.select(F.expr(f"i div {size}").alias("block"), (F.col("i") % size).alias("i"), "k", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in "ab"], *[F.col(c).isNotNull().cast("double").alias("n" + c) for c in "ab"])
    parts = min(blocks, 2000)  # a block a task, or a few of many
    both = picked.repartition(parts, "block").groupBy("block").cogroup(dealt.repartition(parts, "block").groupBy("block"))
    each = both.applyInPandas(add, "k long, draw long, a double, b double, na double, nb double").groupBy("k", "draw")
    sums = each.agg(*[F.sum(c).alias(c) for c in ("a", "b", "na", "nb")])
    return sums.select("k", "draw", *[F.when(F.col("n" + c) > 0, F.col(c)).alias(c) for c in "ab"])


def bootstrap(df: DataFrame, page: str, stratum: str, num: Column, den: Column, draws: int = 1000, seed: int = 42, bucket: Column | None = None) -> DataFrame:
    """(stratum, estimate, ci_lower, ci_upper): ratios of sums over as many pages as there are, drawn with replacement.

    Pages are summed and numbered once; every draw has a slot a page, and a hash tells which page is in it. The work is
    draws times pages, spread over all tasks by draws; what is dealt to the blocks of pages is how often a draw has
    each of them, in about a quarter of a byte, and a block makes draws times strata rows. seed is not negative.
    With fewer than 10 draws that have a value there is no interval.
    """
    sums = df.groupBy(page, stratum).agg(F.sum(num).alias("a"), F.sum(den).alias("b"))
    sums = stored(sums, "sums")
    place = bucket if bucket is not None else F.pmod(F.xxhash64(page), F.lit(256))
    pages = stored(numbered(sums.select(page).distinct(), page, place), "pages")
    n = pages.count()
    # Strata travel as numbers; a null one has no interval.
    strata = sums.where(F.col(stratum).isNotNull()).select(stratum).distinct()
    strata = stored(strata.withColumn("k", F.monotonically_increasing_id()), "strata")
    values = pages.select(page, F.col("__i").alias("i")).join(sums, page).join(strata, stratum).select("i", "k", F.col("a").cast("double").alias("a"), F.col("b").cast("double").alias("b"))
    each = _drawn_sums(values, n, draws, seed) if n else values.select("k", F.col("i").alias("draw"), "a", "b")
    each = each.select("k", F.try_divide("a", F.nullif(F.col("b"), F.lit(0.0))).alias("x"))
    ci = each.groupBy("k").agg(F.percentile("x", F.array(F.lit(0.025), F.lit(0.975))).alias("q"), F.count("x").alias("n")).join(strata, "k").drop("k")
    estimate = sums.groupBy(stratum).agg(F.try_divide(F.sum("a"), F.nullif(F.sum("b"), F.lit(0.0))).alias("estimate"))
    return estimate.join(ci, stratum, "left").select(stratum, "estimate", *[F.when(F.col("n") >= 10, F.col("q")[i]).alias(k) for i, k in enumerate(("ci_lower", "ci_upper"))])


def confusion(df: DataFrame, a: str, b: str, labels: Sequence[str]) -> DataFrame:
    """(a, one column a label): how often each label of a meets each of b."""
    known = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    return known.groupBy(a).agg(*[F.count_if(F.col(b) == x).alias(x) for x in labels])


def deltas(values: DataFrame, bucket: str, setting: str, x: str, baseline: str) -> DataFrame:
    """(setting, n, max_delta_pp, mean_delta_pp, verdict): shares of each setting against the baseline's, bucket by bucket.

    At most 2 percentage points apart everywhere is robust, at most 5 moderate. Buckets that the baseline lacks do not count.
    """
    base = values.where(F.col(setting) == baseline).select(bucket, F.col(x).alias("__b"))
    d = (F.col(x) - F.col("__b")) * 100
    g = values.where(F.col(setting) != baseline).join(base, bucket).where(F.col(x).isNotNull() & F.col("__b").isNotNull())
    g = g.groupBy(setting).agg(F.count("*").alias("n"), F.max(F.abs(d)).alias("max_delta_pp"), F.avg(d).alias("mean_delta_pp"))
    top = F.round("max_delta_pp", 9)
    return g.withColumn("verdict", F.when(top <= 2, "robust").when(top <= 5, "moderate").otherwise("sensitive"))


def verdict(x: Column, least: float, yes: str = "pass", no: str = "check") -> Column:
    """The verdict on a rate or a kappa that must reach a level."""
    return F.when(x.isNotNull(), F.when(F.round(x, 9) >= least, yes).otherwise(no))
