"""Writers: tables, page documents, page summaries and text reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import natural_key


def write_table(df: DataFrame, path: str, kind: str = "parquet", by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite")
    w = w.option("header", True) if kind == "csv" else w
    (w.partitionBy(*by) if by else w).format(kind).save(path)


def page_documents(rows: DataFrame, fields: list[str], within: str | None = None) -> DataFrame:
    """One document a page: its rows in their order. A page is a bounded group.

    within is a column with one value a page: rows that are dealt by it already are not dealt again.
    """
    row = F.struct("row_index", *[f for f in fields if f != "row_index"])
    pages = rows.groupBy(*([within] if within else []), "page_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    return pages.drop(within) if within else pages


def write_pages(rows: DataFrame, fields: list[str], path: str, within: str | None = None) -> None:
    """A page a line, compressed: every row repeats the names of its fields."""
    page_documents(rows, fields, within).write.mode("overwrite").option("compression", "gzip").json(path)


def page_summary(rows: DataFrame) -> DataFrame:
    """Counts of rows by type for each page, in the natural order of page ids."""
    n = lambda t: F.count_if(F.col("row_type") == t)
    g = rows.groupBy("page_id").agg(F.count("*").alias("total_rows"), n("entry").alias("entries"), n("header").alias("headers"), n("total").alias("totals"))
    return g.orderBy(natural_key("page_id"), "page_id").withColumn("sheet", F.substring("page_id", 1, 31))


def report_lines(df: DataFrame, template: str, *columns: str | Column) -> DataFrame:
    """One line of text a row."""
    return df.select(F.format_string(template, *columns).alias("line"))
