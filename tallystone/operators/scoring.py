"""Scoring extracted pages against expected ones: counts, headers, amounts and fractions.

Count scores are plain aggregations. Matching is greedy and depends on the order of rows: a fold over a page's expected
rows, whose state holds the extracted rows that are left, as an expression over arrays. Distances of descriptions are
computed only where a pick needs them: between rows of equal amounts, between headers, and for the rows that stay without
a match. Rows of a page (a bounded number) are in the order of their indices, then types, texts, amounts and fractions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import amount_similarity, count_similarity, exactly_rounded, lev_ratio

TYPES = ["header", "entry", "total"]


def structure_score(pred: DataFrame, gt: DataFrame, page: str = "page") -> DataFrame:
    """(page, row_count_score, type_count_score): both sides in one aggregation, so pages of one side only count too."""
    both = pred.select(page, "row_type", F.lit(1).alias("p")).unionByName(gt.select(page, "row_type", F.lit(0).alias("p")))
    n = lambda p, t=None: F.count_if((F.col("p") == p) & ((F.col("row_type") == t) if t else F.lit(True)))
    g = both.groupBy(page).agg(n(1).alias("np"), n(0).alias("ng"), *[n(p, t).alias(f"{t}{p}") for t in TYPES for p in (0, 1)])
    types = sum((count_similarity(f"{t}1", f"{t}0") for t in TYPES), F.lit(0.0)) / len(TYPES)
    return g.select(page, count_similarity("np", "ng").alias("row_count_score"), types.alias("type_count_score"))


ROW = "row_index int, row_type string, description string, amount long, fraction double"


def _pages(pred: DataFrame, gt: DataFrame) -> DataFrame:
    """(page, pred, gt): both sides' rows of a page, each with its place `at`."""
    names = [x.split()[0] for x in ROW.split(", ")]
    most = {"int": (1 << 31) - 1, "long": (1 << 63) - 1, "double": float("inf"), "string": ""}
    order = [F.coalesce(F.col(n), F.lit(most[k]).cast(k)).alias(f"o_{n}") for n, k in (x.split() for x in ROW.split(", "))]  # missing numbers come last
    side = lambda df, p: df.select("page", F.lit(p).alias("p"), *[F.coalesce(n, F.lit("")).alias(n) if n == "description" else F.col(n) for n in names])
    row = F.struct(*order, "p", *names)
    both = side(pred, 1).unionByName(side(gt, 0)).groupBy("page").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    plain = lambda p: F.transform(F.filter("rows", lambda r: r["p"] == p), lambda r, i: F.struct(*[r[n].alias(n) for n in names], i.alias("at")))
    return both.select("page", plain(1).alias("pred"), plain(0).alias("gt"))


def _without(left: Column, best: Column) -> Column:
    return F.filter(left, lambda p: p["at"] != -best["m"])


def header_hits(pred: Column, gt: Column, least: float = 0.8) -> Column:
    """How many expected headers find a header of their own, each taking the best that is left."""

    def step(state: Column, g: Column) -> Column:
        best = F.array_max(F.transform(state["left"], lambda p: F.struct(lev_ratio(g["description"], p["description"]).alias("r"), (-p["at"]).alias("m"))))
        hit = F.coalesce(best["r"] >= least, F.lit(False))
        return F.struct(F.when(hit, _without(state["left"], best)).otherwise(state["left"]).alias("left"), (state["hits"] + hit.cast("int")).alias("hits"))

    return F.aggregate(gt, F.struct(pred.alias("left"), F.lit(0).alias("hits")), step, lambda s: s["hits"])


def amount_matches(pred: Column, gt: Column) -> Column:
    """(n, credit, similar, missed) over the expected rows with an amount.

    Each expected row takes, of the rows left with the same pounds, shillings and pence, one of its own type before
    another, then the most similar description. Entry against total counts half. A row without a match is compared
    with the closest amount that is left, which stays available; missed holds the places of such rows.
    """

    def step(state: Column, g: Column) -> Column:
        same = F.filter(state["left"], lambda p: p["amount"] == g["amount"])
        best = F.array_max(F.transform(same, lambda p: F.struct(p["row_type"].eqNullSafe(g["row_type"]).alias("e"), lev_ratio(g["description"], p["description"]).alias("r"), (-p["at"]).alias("m"))))
        none = best.isNull()
        close = F.coalesce(F.array_max(F.transform(state["left"], lambda p: amount_similarity(p["amount"], g["amount"]))), F.lit(0.0))
        return F.struct(
            F.when(none, state["left"]).otherwise(_without(state["left"], best)).alias("left"),
            (state["n"] + 1).alias("n"),
            (state["credit"] + F.when(none, 0.0).when(best["e"], 1.0).otherwise(0.5)).alias("credit"),
            (state["similar"] + F.when(none, close).otherwise(1.0)).alias("similar"),
            F.when(none, F.array_append(state["missed"], g["at"])).otherwise(state["missed"]).alias("missed"),
        )

    some = lambda rows: F.filter(rows, lambda r: r["amount"].isNotNull())
    start = F.struct(some(pred).alias("left"), F.lit(0).alias("n"), F.lit(0.0).alias("credit"), F.lit(0.0).alias("similar"), F.array().cast("array<int>").alias("missed"))
    return F.aggregate(some(gt), start, step, lambda s: s.dropFields("left"))


def fraction_matches(pred: Column, gt: Column) -> Column:
    """(n, hits): expected rows with a fraction, and how many of them find a row of their own with the same fraction and amount."""

    def step(state: Column, g: Column) -> Column:
        same = F.filter(state["left"], lambda p: (p["fraction"] == g["fraction"]) & p["amount"].eqNullSafe(g["amount"]))
        best = F.array_max(F.transform(same, lambda p: F.struct(p["row_type"].eqNullSafe(g["row_type"]).alias("e"), (-p["at"]).alias("m"))))
        hit = best.isNotNull()
        return F.struct(F.when(hit, _without(state["left"], best)).otherwise(state["left"]).alias("left"), (state["n"] + 1).alias("n"), (state["hits"] + hit.cast("int")).alias("hits"))

    some = lambda rows: F.filter(rows, lambda r: F.coalesce(r["fraction"] != 0, F.lit(False)))
    return F.aggregate(some(gt), F.struct(some(pred).alias("left"), F.lit(0).alias("n"), F.lit(0).alias("hits")), step, lambda s: s.dropFields("left"))


def page_scores(pred: DataFrame, gt: DataFrame) -> DataFrame:
    """Axis 1, axis 2 and the combined score of each page (rows: page, row_index, row_type, description, amount, fraction)."""
    kind = lambda rows, head: F.filter(rows, lambda r: (F.coalesce(r["row_type"], F.lit("")) == "header") == head)
    count = lambda rows, t: F.size(F.filter(rows, lambda r: F.coalesce(r["row_type"] == t, F.lit(False))))
    r4 = lambda x: exactly_rounded(x, 4)
    mean = lambda total, n: F.when(n == 0, F.lit(1.0)).otherwise(total / F.greatest(n, F.lit(1)))
    pages = _pages(pred, gt).select("page", "pred", "gt", *[kind(F.col(s), h).alias(f"{s}_{'heads' if h else 'money'}") for s in ("pred", "gt") for h in (True, False)])
    found = pages.select(
        "page", count_similarity(F.size("pred"), F.size("gt")).alias("rows"), (sum((count_similarity(count(F.col("pred"), t), count(F.col("gt"), t)) for t in TYPES), F.lit(0.0)) / len(TYPES)).alias("types"),
        header_hits(F.col("pred_heads"), F.col("gt_heads")).alias("hits"), F.size("gt_heads").alias("heads"), amount_matches(F.col("pred_money"), F.col("gt_money")).alias("m"), fraction_matches(F.col("pred_money"), F.col("gt_money")).alias("f"),
    )
    axis1 = r4((r4(F.col("rows")) + r4(F.col("types")) + r4(mean(F.col("hits"), F.col("heads")))) / 3)
    found = found.select("page", axis1.alias("axis1"), mean(F.col("m.credit"), F.col("m.n")).alias("a"), mean(F.col("m.similar"), F.col("m.n")).alias("b"), mean(F.col("f.hits"), F.col("f.n")).alias("c"))
    found = found.withColumn("axis2", r4(0.5 * F.col("a") + 0.3 * F.col("b") + 0.2 * F.col("c")))
    return found.select("page", "axis1", r4(F.col("a")).alias("axis2_match"), r4(F.col("b")).alias("axis2_similarity"), r4(F.col("c")).alias("axis2_fraction"), "axis2", r4(0.3 * F.col("axis1") + 0.7 * F.col("axis2")).alias("combined"))


def feedback(pred: DataFrame, gt: DataFrame) -> DataFrame:
    """Expected rows without a match, with the description that is closest to theirs."""
    missed = _pages(pred, gt).select("page", "pred", "gt", F.explode(amount_matches(F.col("pred"), F.col("gt"))["missed"]).alias("at")).withColumn("g", F.element_at("gt", F.col("at") + 1))
    closest = F.array_max(F.transform("pred", lambda p: F.struct(lev_ratio(F.col("g.description"), p["description"]).alias("r"), (-p["at"]).alias("m"), p["description"].alias("d"))))
    return missed.select("page", F.col("g.row_index").alias("row_index"), F.col("g.description").alias("description"), closest["d"].alias("closest"))
