"""The ledger model over the driver's tables, and the same views as SQL for the oracles.

A line of an order is a ledger row, its order the page. Months since January 1995 stand for years: 1700, 1702, 1705
and so on, so that eras, decades and the price index have all their values. A row of an odd line number spans two years.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import scalars as S


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list[str], at):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (at + 1).cast("int"))


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a ledger row, before the years are exploded."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag")
    m = (F.year("o_orderdate") - 1995) * 12 + F.month("o_orderdate") - 1
    year = (F.lit(1700) + F.floor(m * 5 / 2)).cast("int")
    span = F.when(F.col("l_linenumber") % 2 == 1, F.array(year, year + 1)).otherwise(F.array(year))
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").alias("page_id"), F.col("l_linenumber").alias("row_index"), F.col("l_partkey").alias("part"), span.alias("years"),
        S.lookup("o_orderstatus", {"F": "income", "O": "expenditure", "P": "balance_sheet"}).alias("direction"), _pick(K.CATEGORIES, F.col("l_partkey") % 10).alias("category"),
        _pick(K.LANGUAGES, F.col("l_suppkey") % 3).alias("language"), _pick(K.PERIODS, F.col("l_quantity").cast("int") % 10).alias("payment_period"),
        (F.col("l_returnflag") == "R").alias("is_arrears"), F.when(F.col("l_tax") < 0.08, F.col("l_discount") * 10).alias("confidence"), (F.col("l_extendedprice") / 100).alias("amount"),
    )


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a ledger row and year, with weights, real amounts, eras and decades."""
    r = rows(spark, sf_dir).withColumn("year_weight", 1.0 / F.size("years"))
    r = r.withColumn("year", F.explode("years")).drop("years")
    real = F.col("amount") / (S.price_index("year") / 100)
    return r.withColumns({"amount_w": F.col("amount") * F.col("year_weight"), "real_w": real * F.col("year_weight"), "era": S.era("year"), "era4": S.era("year", K.ERAS4), "decade": S.decade("year")})


def sql_case(x: str, anchors: dict[int, float]) -> str:
    p = sorted(anchors.items())
    parts = [f"WHEN {x} <= {p[0][0]} THEN {p[0][1]}::DOUBLE"]
    parts += [f"WHEN {x} <= {b} THEN {y}::DOUBLE + ({x} - {a}) * ({z - y!r})::DOUBLE / {b - a}" for (a, y), (b, z) in zip(p, p[1:], strict=False)]
    return f"(CASE {' '.join(parts)} ELSE {p[-1][1]}::DOUBLE END)"


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


ERA3 = "CASE WHEN year < 1760 THEN 'pre_industrial' WHEN year <= 1840 THEN 'industrial' ELSE 'post_industrial' END"
ERA4 = "CASE WHEN year < 1780 THEN 'pre_industrial' WHEN year < 1820 THEN 'transition' WHEN year < 1860 THEN 'early_industrial' ELSE 'late_industrial' END"

#: CTEs rows_ and entries, to be followed by a SELECT or by a comma and further CTEs.
ENTRIES = f"""
WITH rows_ AS (
  SELECT l_orderkey AS page_id, l_linenumber AS row_index, l_partkey AS part,
    CAST(1700 + floor(((year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1) * 5 / 2) AS INT) AS y0,
    CASE o_orderstatus WHEN 'F' THEN 'income' WHEN 'O' THEN 'expenditure' WHEN 'P' THEN 'balance_sheet' END AS direction,
    {_list(K.CATEGORIES)}[l_partkey % 10 + 1] AS category, {_list(K.LANGUAGES)}[l_suppkey % 3 + 1] AS language,
    {_list(K.PERIODS)}[CAST(l_quantity AS INT) % 10 + 1] AS payment_period, l_returnflag = 'R' AS is_arrears,
    CASE WHEN l_tax < 0.08 THEN l_discount * 10 END AS confidence, l_extendedprice / 100 AS amount
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
spanned AS (SELECT *, CASE WHEN row_index % 2 = 1 THEN [y0, y0 + 1] ELSE [y0] END AS years FROM rows_),
dealt AS (SELECT * EXCLUDE (years, y0), 1.0::DOUBLE / len(years) AS year_weight, unnest(years) AS year FROM spanned),
entries AS (
  SELECT *, amount * year_weight AS amount_w, amount / ({sql_case('year', K.PRICE_ANCHORS)} / 100) * year_weight AS real_w,
    {ERA3} AS era, {ERA4} AS era4, CAST(floor(year / 10) * 10 AS INT) AS decade FROM dealt)
"""
