"""Workbooks from end to end (S9, S10, S12, S15): lines become sheets, written by the sink and read by the source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import pages as src
from ..sources import sinks as snk
from ..sources import workbooks as books
from ..storage import new_path
from .page_queries import _ROWS, _typed
from .registry import query, r6


def _ledger(spark: SparkSession, sf: str) -> DataFrame:
    """A sheet an order, in the columns of the account workbooks: shillings are numbers, other cells texts."""
    t = _typed(spark, sf)
    fields = ["row_type", "description", "amount_pounds", "amount_shillings", "amount_pence_whole", "amount_pence_fraction"]
    named = [F.col(c).cast("int").alias(n) if c == "amount_shillings" else F.col(c).alias(n) for c, n in zip(fields, books.LEDGER, strict=True)]
    path = new_path(spark, "books")
    books.write_workbooks(t.select(F.col("page_id").alias("sheet"), *named, F.col("row_index").alias("No")), path, ["No"])
    return books.read_workbooks(spark, path)


_BOOK = _ROWS + """, book AS (SELECT *, CASE WHEN o % 4 = 1 THEN 0.5 ELSE 1.0 END::DOUBLE AS weight, CASE WHEN i = 0 THEN ['recepta','soluta','capitulum'][o % 3 + 1] || ' ' || y ELSE 'rent of farm ' || k END AS norm, unnest(CASE WHEN o % 4 = 1 THEN [y, y + 1] ELSE [y] END) AS year FROM rows_ WHERE pure OR row_type <> 'entry')
"""


@query("s09_workbook_rows", _BOOK + "SELECT year, row_type, count(*) AS n, CAST(sum(o) AS BIGINT) AS pages, round(sum(weight),6) AS weight, round(sum(amount)*240,6) AS pence, round(sum(amount*weight)*240,6) AS pence_weighted, CAST(sum(i + 1) AS BIGINT) AS places, min(norm) AS first_text, max(norm) AS last_text FROM book GROUP BY ALL")
def s09(spark, sf):
    g = books.ledger_rows(_ledger(spark, sf)).groupBy("year", "row_type")
    return g.agg(F.count("*").alias("n"), F.sum("page").alias("pages"), r6(F.sum("year_weight"), "weight"), r6(F.sum("amount_decimal") * 240, "pence"), r6(F.sum("amount_weighted") * 240, "pence_weighted"), F.sum("row_idx").alias("places"), F.min("description_norm").alias("first_text"), F.max("description_norm").alias("last_text"))


@query("s10_workbook_sides", _BOOK + "SELECT coalesce(side,'none') AS side, count(*) AS n, round(sum(amount*weight*CASE WHEN side IN ('left','right') THEN 0.5 ELSE 1 END)*240,6) AS pence_weighted FROM book GROUP BY 1")
def s10(spark, sf):
    sides = _typed(spark, sf).select("page_id", (F.col("row_index") + 1).alias("row_index"), "side")
    g = books.ledger_rows(_ledger(spark, sf), sides).groupBy(F.coalesce("side", F.lit("none")).alias("side"))
    return g.agg(F.count("*").alias("n"), r6(F.sum("amount_weighted") * 240, "pence_weighted"))


@query("s12_workbook_years", _BOOK + "SELECT year, count(*) AS n_descriptions, round(sum(amount*weight)*240,6) AS sum_pence, round(median(amount)*240,6) AS median_pence FROM book WHERE row_type <> 'header' GROUP BY year")
def s12(spark, sf):
    return books.year_documents(books.ledger_rows(_ledger(spark, sf))).select("year", "n_descriptions", r6(F.col("amount_sum") * 240, "sum_pence"), r6(F.col("amount_median") * 240, "median_pence"))


@query("s15_workbook_truth", _ROWS + "SELECT row_type, coalesce(side,'none') AS side, count(*) AS n, count(DISTINCT page_id) AS pages, round(sum(amount),6) AS amount, CAST(sum(i) AS BIGINT) AS places FROM rows_ GROUP BY ALL")
def s15(spark, sf):
    path, pages = new_path(spark, "truth"), new_path(spark, "pages")
    books.write_workbooks(_typed(spark, sf).select(F.col("page_id").alias("sheet"), *books.TRUTH, "side"), path, ["row_index"])
    snk.write_pages(books.truth_rows(books.read_workbooks(spark, path)), [*books.TRUTH, "side"], pages)
    r = src.page_rows(src.read_pages(spark, pages, lines=True))
    return r.groupBy("row_type", F.coalesce("side", F.lit("none")).alias("side")).agg(F.count("*").alias("n"), F.countDistinct("page_id").alias("pages"), r6(F.sum("amount"), "amount"), F.sum("row_index").alias("places"))
