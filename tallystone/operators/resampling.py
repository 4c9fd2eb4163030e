"""Bootstrap intervals from how often each page is drawn, told block by block: no row is made for a page in a draw."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from ..storage import stored
from .quantiles import exact_quantiles
from .reliability import numbered

#: Pages of a block; draws times so many counts are in a task's memory.
BLOCK = 1_024


def _node(seed: int, *at: int) -> np.random.Generator:
    """A generator for one node of the tree; the same wherever and however often it is asked for."""
    return np.random.Generator(np.random.Philox(np.random.SeedSequence([seed, *at])))


def block_draws(block: int, pages: int, draws: int, seed: int, size: int) -> np.ndarray:
    """How many of each draw's `pages` picks fall into a block, without asking any other block.

    Picks go down a binary tree over the blocks: a node hands a binomial share of its picks to its left half, in
    proportion to the pages there. Each task walks from the root to its own block, so that all tasks agree.
    """
    picks = np.full(draws, pages, np.int64)
    low, high = 0, -(-pages // size)
    while high - low > 1:
        middle = (low + high) // 2
        left, all_ = (min(pages, end * size) - low * size for end in (middle, high))
        to_left = _node(seed, 0, low, high).binomial(picks, left / all_)
        picks, low, high = (to_left, low, middle) if block < middle else (picks - to_left, middle, high)
    return picks


def page_draws(block: int, pages: int, draws: int, seed: int, size: int) -> np.ndarray:
    """(draws, pages of the block): how often each draw has each page of a block. A draw's counts sum to `pages` over all blocks."""
    here = min(pages, (block + 1) * size) - block * size
    picks = block_draws(block, pages, draws, seed, size)
    page = _node(seed, 1, block).integers(0, here, int(picks.sum()))
    return np.bincount(np.repeat(np.arange(draws), picks) * here + page, minlength=draws * here).reshape(draws, here)


def _drawn(sums: DataFrame, page: str, stratum: str, draws: int, seed: int, size: int, bucket: Column | None) -> DataFrame:
    """(draw, stratum, a, b): sums of all draws, one row a block, draw and stratum at most before they are added."""
    place = bucket if bucket is not None else F.pmod(F.xxhash64(page), F.lit(256))
    pages = stored(numbered(sums.select(page).distinct(), page, place), "pages")
    n = pages.count()
    ship(sums.sparkSession)
    block = F.expr(f"__i div {size}")
    # Strata as numbers within their block: a stratum of any type travels beside the arrays, not through them.
    rows = F.collect_list(F.struct((F.col("__i") % size).alias("i"), "a", "b")).alias("rows")
    dealt = sums.join(pages, page).groupBy(block.alias("block"), F.col(stratum).alias("stratum")).agg(rows).select("block", "stratum", *[F.col(f"rows.{c}").alias(c) for c in ("i", "a", "b")])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = None, None
        for batch in batches:
            for r in range(batch.num_rows):  # lists are read as arrays: as Python objects a batch of them fills the memory
                block = batch.column("block")[r].as_py()
                if block != known:
                    known, counts = block, page_draws(block, n, draws, seed, size)
                i, a, b = (batch.column(c)[r].values.to_numpy(zero_copy_only=False) for c in ("i", "a", "b"))
                picked = counts[:, i]
                hit = np.flatnonzero(picked.any(axis=1))
                again = batch.column("stratum").take(pa.array(np.full(len(hit), r)))
                yield pa.RecordBatch.from_arrays([pa.array(hit), again, pa.array((picked @ a)[hit]), pa.array((picked @ b)[hit])], names=["draw", "stratum", "a", "b"])

    kind = sums.schema[stratum].dataType.simpleString()
    ordered = dealt.repartition("block").sortWithinPartitions("block") if n else dealt
    return ordered.mapInArrow(summed, f"draw long, stratum {kind}, a double, b double").groupBy("draw", "stratum").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def block_bootstrap(df: DataFrame, page: str, stratum: str, num: Column, den: Column, draws: int = 1000, seed: int = 42, bucket: Column | None = None, size: int = BLOCK, at: tuple[float, float] = (0.025, 0.975)) -> DataFrame:
    """(stratum, estimate, ci_lower, ci_upper, n_draws): ratios of sums over as many pages as there are, drawn with replacement.

    The same intervals as `reliability.bootstrap`, from draws of another kind: a page's place in the order of (bucket,
    page) and the seed fix how often each draw has it, so that lost tasks give the same counts again. A block of pages
    makes draws times strata rows, however many pages it holds. Null sums count as 0; a draw without a value of a
    stratum, or with a denominator of 0, has no ratio there; under 10 ratios there is no interval. A page lies in its
    strata's rows once each, so a block's largest group has `size` entries.
    """
    sums = stored(df.groupBy(page, stratum).agg(F.coalesce(F.sum(num), F.lit(0)).cast("double").alias("a"), F.coalesce(F.sum(den), F.lit(0)).cast("double").alias("b")), "sums")
    each = stored(_drawn(sums, page, stratum, draws, seed, size, bucket).select("stratum", "draw", F.try_divide("a", F.nullif("b", F.lit(0.0))).alias("x")), "draws")
    n = each.groupBy("stratum").agg(F.count("x").alias("n_draws"))
    q = exact_quantiles(each, ["stratum"], "x", at).withColumnRenamed("stratum", "s")
    estimate = sums.groupBy(F.col(stratum).alias("t")).agg(F.try_divide(F.sum("a"), F.nullif(F.sum("b"), F.lit(0.0))).alias("estimate"))
    out = estimate.join(n, F.col("t").eqNullSafe(F.col("stratum")), "left").drop("stratum").join(q, F.col("t").eqNullSafe(F.col("s")), "left")
    ends = [F.when(F.col("n_draws") >= 10, F.col("q")[i]).alias(k) for i, k in enumerate(("ci_lower", "ci_upper"))]
    return out.select(F.col("t").alias(stratum), "estimate", *ends, F.coalesce("n_draws", F.lit(0)).alias("n_draws"))
