"""Leave-one-out routing: each page's pipeline is predicted from its nearest other pages, and the choices are evaluated.

Neighbours are found once for the greatest k; labels, votes, decisions and evaluations of all settings of a grid are
then aggregations over k rows a page, in one plan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored
from .vectors import long_form, standardised

EXTRACTORS = ["gemini", "gpt", "claude"]
CANDIDATES = ["v2_no_gemini", "v2_no_claude", "v2_no_gpt", "v2_full"]
FULL, FALLBACK = "v2_full", "v2_no_claude"


def weighted_features(df: DataFrame, id_col: str, vec_col: str, target: str, least: float = 0.15) -> DataFrame:
    """(id, v): standardised dimensions whose correlation with the target is at least `least`, times their share of all |r|.

    Without such a dimension all are taken; without any correlation they weigh alike.
    """
    x = long_form(df.select(id_col, vec_col, target), id_col, vec_col).join(df.select(id_col, target), id_col)
    r = x.groupBy("i").agg(F.abs(F.coalesce(F.corr("x", target), F.lit(0.0))).alias("r"))  # one row a dimension
    r = stored(r.withColumn("chosen", F.round("r", 9) >= least), "correlations")
    r = r if r.where("chosen").limit(1).count() == 0 else r.where("chosen")
    every = Window.partitionBy()
    share = F.when(F.sum("r").over(every) > 0, F.col("r") / F.nullif(F.sum("r").over(every), F.lit(0.0))).otherwise(1.0 / F.count("*").over(every))
    z = standardised(df, id_col, vec_col).join(F.broadcast(r.select("i", share.alias("w"))), "i")  # as many rows as dimensions
    return z.groupBy(id_col).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", (F.col("z") * F.col("w")).alias("x")))), lambda s: s["x"]).alias("v"))


def skip_labels(scores: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """(page, extractor, threshold, skip): 1 where the ablation without the extractor loses at most threshold; a missing score is 0."""
    s = scores.groupBy("page").agg(*[F.max(F.when(F.col("pipeline") == p, F.col("score"))).alias(p) for p in (FULL, *(f"v2_no_{e}" for e in EXTRACTORS))])
    long = s.select("page", FULL, F.explode(F.array(*[F.struct(F.lit(e).alias("extractor"), F.col(f"v2_no_{e}").alias("score")) for e in EXTRACTORS])).alias("x"), F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    skip = F.coalesce((F.round(F.col(FULL) - F.col("x.score"), 9) <= F.col("threshold")).cast("int"), F.lit(0))
    return long.select("page", "x.extractor", "threshold", skip.alias("skip"))


def _votes(near: DataFrame, labels: DataFrame, ks: Sequence[int]) -> DataFrame:
    theirs = labels.select(F.col("page").alias("b"), "extractor", "threshold", "skip")
    return near.select("a", "b", "similarity", "rank").join(theirs, "b").withColumn("k", F.explode(F.array(*map(F.lit, ks))))


def cosine_votes(near: DataFrame, labels: DataFrame, ks: Sequence[int]) -> DataFrame:
    """(a, extractor, threshold, k, confidence, true): the share of skipping neighbours, weighed by similarities not below 0."""
    w = F.greatest("similarity", F.lit(0.0))
    g = _votes(near, labels, ks).where("rank <= k").groupBy("a", "extractor", "threshold", "k").agg(F.sum(w).alias("w"), F.sum(w * F.col("skip")).alias("s"), F.avg("skip").alias("m"))
    g = g.withColumn("confidence", F.coalesce(F.col("s") / F.nullif("w", F.lit(0.0)), "m"))
    return _own(g, labels).select("a", "extractor", "threshold", "k", "confidence", "true")


def _own(df: DataFrame, labels: DataFrame) -> DataFrame:
    return df.join(labels.select(F.col("page").alias("a"), "extractor", "threshold", F.col("skip").alias("true")), ["a", "extractor", "threshold"])


def nearest_votes(near: DataFrame, labels: DataFrame, ks: Sequence[int]) -> DataFrame:
    """(a, extractor, threshold, k, p, true): the share of skipping pages among the nearest, all alike.

    As many are asked as k, the other pages that skip and those that do not, whichever is least; where the other pages
    have one label only, p is null and the extractor is kept.
    """
    n = labels.groupBy("extractor", "threshold").agg(F.sum("skip").alias("pos"), F.count("*").alias("n"))  # a few rows
    own = labels.select(F.col("page").alias("a"), "extractor", "threshold", F.col("skip").alias("true")).join(F.broadcast(n), ["extractor", "threshold"])
    own = own.withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    asked = own.withColumn("least", F.least(F.col("k"), F.col("pos") - F.col("true"), F.col("n") - F.col("pos") - (1 - F.col("true"))))
    votes = _votes(near, labels, ks).join(asked.select("a", "extractor", "threshold", "k", "least"), ["a", "extractor", "threshold", "k"]).where("rank <= least")
    p = votes.groupBy("a", "extractor", "threshold", "k").agg(F.avg("skip").alias("p"))
    return asked.select("a", "extractor", "threshold", "k", "true").join(p, ["a", "extractor", "threshold", "k"], "left")


def decided(votes: DataFrame, confidences: Sequence[float], cosine: bool) -> DataFrame:
    """(a, threshold, k, conf, pipeline, n_skipped, correct): with one extractor to skip the ablation without it, else the full pipeline."""
    v = votes.withColumn("conf", F.explode(F.array(*map(F.lit, confidences))))
    if cosine:
        v = v.withColumn("pred", (F.round("confidence", 9) >= F.col("conf")).cast("int")).withColumn("skip", F.col("pred") == 1)
    else:
        v = v.withColumn("pred", F.coalesce((F.round("p", 9) >= 0.5).cast("int"), F.lit(0)))
        v = v.withColumn("skip", (F.col("pred") == 1) & (F.round(F.greatest(F.col("p"), 1 - F.col("p")), 9) >= F.col("conf")))
    g = v.groupBy("a", "threshold", "k", "conf").agg(F.count_if("skip").alias("n_skipped"), F.max(F.when(F.col("skip"), F.col("extractor"))).alias("one"), F.count_if(F.col("pred") == F.col("true")).alias("correct"))
    return g.select("a", "threshold", "k", "conf", F.when(F.col("n_skipped") == 1, F.concat(F.lit("v2_no_"), "one")).otherwise(FULL).alias("pipeline"), "n_skipped", "correct")


def best_votes(near: DataFrame, best: DataFrame, ks: Sequence[int], confidences: Sequence[float]) -> DataFrame:
    """(a, k, conf, pipeline, predicted, confidence): neighbours vote for their best pipeline; below conf the fallback is taken.

    best is (page, best); of equal votes the first candidate wins, and so it does with no votes at all.
    """
    w = F.greatest("similarity", F.lit(0.0))
    rows = near.join(best.select(F.col("page").alias("b"), "best"), "b").withColumn("k", F.explode(F.array(*map(F.lit, ks)))).where("rank <= k")
    g = rows.groupBy("a", "k").agg(F.sum(w).alias("w"), *[F.sum(F.when(F.col("best") == c, w).otherwise(0.0)).alias(c) for c in CANDIDATES])
    votes = F.array(*[F.struct(F.round(F.coalesce(F.col(c) / F.nullif("w", F.lit(0.0)), F.lit(0.0)), 9).alias("share"), F.lit(-i).alias("ord"), F.lit(c).alias("name")) for i, c in enumerate(CANDIDATES)])
    g = g.select("a", "k", F.array_max(votes).alias("top"), F.explode(F.array(*map(F.lit, confidences))).alias("conf"))
    chosen = F.when(F.col("top.share") < F.col("conf"), FALLBACK).otherwise(F.col("top.name"))
    return g.select("a", "k", "conf", chosen.alias("pipeline"), F.col("top.name").alias("predicted"), F.col("top.share").alias("confidence"))


def evaluated(chosen: DataFrame, scores: DataFrame, by: Sequence[str], questions: int = 1) -> DataFrame:
    """One row a setting: accuracy, preservation of the full score, cost cut, least and spread of scores, failures, balanced scores.

    chosen has a, pipeline and correct (of so many questions a page). A chosen pipeline without a score becomes the full
    one. balanced weighs accuracy, preservation and cost by .3, .4, .3; balanced_sweep by .2, .5, .3.
    """
    s = scores.select(F.col("page").alias("a"), "pipeline", "score")
    full = s.where(F.col("pipeline") == FULL).select("a", F.col("score").alias("full_score"))
    c = chosen.join(s, ["a", "pipeline"], "left").join(full, "a")
    used = F.when(F.col("score").isNull(), FULL).otherwise(F.col("pipeline"))
    c = c.withColumn("calls", F.when(used == FULL, 3).otherwise(2)).withColumn("final", F.coalesce("score", "full_score"))
    g = c.groupBy(*by).agg(
        F.count("*").alias("n"), (F.sum("correct") / (questions * F.count("*"))).alias("accuracy"), (F.avg("final") / F.avg("full_score")).alias("preservation"), (1 - F.sum("calls") / (3 * F.count("*"))).alias("cost_reduction"),
        F.min("final").alias("min_score"), F.stddev_samp("final").alias("score_std"), F.count_if(F.round(F.col("final") - 0.9 * F.col("full_score"), 9) < 0).alias("failures"),
    )
    mean = lambda a, p, k: a * F.col("accuracy") + p * F.col("preservation") + k * F.col("cost_reduction")
    return g.withColumns({"balanced": mean(0.3, 0.4, 0.3), "balanced_sweep": mean(0.2, 0.5, 0.3)})
