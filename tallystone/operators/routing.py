"""Choosing a pipeline for each page: best of all, skip labels, votes of neighbours, and their evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from .neighbours import nearest  # noqa: F401  the queries' name for it


def oracle_best(scores: DataFrame, full: str = "v2_full") -> DataFrame:
    """(page, best, best_score, gap): the best pipeline of each page, the first in order among equals, against the full one."""
    g = scores.groupBy("page").agg(F.min_by("pipeline", F.struct(-F.col("score"), "ord")).alias("best"), F.max("score").alias("best_score"), F.max(F.when(F.col("pipeline") == full, F.col("score"))).alias("full"))
    return g.select("page", "best", "best_score", (F.col("best_score") - F.col("full")).alias("gap"))


def skip_labels(scores: DataFrame, threshold: float, full: str = "v2_full") -> DataFrame:
    """(page, pipeline, skip): 1 where leaving one extractor out costs at most threshold; a missing score is 0."""
    w = Window.partitionBy("page")
    base = F.max(F.when(F.col("pipeline") == full, F.col("score"))).over(w)
    drop = base - F.col("score")
    rows = scores.select("page", "pipeline", F.when(drop.isNull(), 0).otherwise((F.round(drop, 9) <= threshold).cast("int")).alias("skip"))
    return rows.where(F.col("pipeline") != full)


def weighted_vote(near: DataFrame, labels: DataFrame, label_col: str, order: Column | None = None) -> DataFrame:
    """(a, label, confidence): neighbours vote with their similarities, not below 0; ties by the label's order."""
    votes = near.join(labels, near.b == labels.id).groupBy("a", label_col).agg(F.sum(F.greatest("similarity", F.lit(0.0))).alias("w"))
    total = F.sum("w").over(Window.partitionBy("a"))
    votes = votes.withColumn("confidence", F.when(total > 0, F.col("w") / F.nullif(total, F.lit(0.0))).otherwise(0.0))
    best = F.struct(-F.round("confidence", 9), order if order is not None else F.col(label_col))
    return votes.groupBy("a").agg(F.min_by(F.struct(F.col(label_col).alias("label"), "confidence"), best).alias("r")).select("a", "r.label", "r.confidence")


def decision(skipped: Column) -> Column:
    """The pipeline for a set of extractors to skip: none or several, the full one; one, the ablation without it."""
    return F.when(F.size(skipped) == 1, F.concat(F.lit("v2_no_"), skipped[0])).otherwise("v2_full")


def calls(pipeline: Column) -> Column:
    out = None
    for k, v in K.CALLS.items():
        out = F.when(pipeline == k, v) if out is None else out.when(pipeline == k, v)
    return out
