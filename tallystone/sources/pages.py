"""Readers: page documents, enriched pages, score reports, vectors and images; and what follows from them at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import scalars as S
from ..operators.series import fill_forward

#: Amounts are numbers or empty texts in the files, so they are read as text.
ROW = (
    "row_index INT, row_type STRING, description STRING, amount_pounds STRING, amount_shillings STRING, amount_pence_whole STRING, amount_pence_fraction STRING, confidence_score DOUBLE, notes STRING, side STRING, "
    "section_header STRING, direction STRING, category STRING, language STRING, english_description STRING, place_name STRING, person_name STRING, payment_period STRING, is_signature BOOLEAN, is_arrears BOOLEAN"
)
PAGE = f"page_id STRING, layout_type STRING, rows ARRAY<STRUCT<{', '.join(f'{c.split()[0]}: {c.split()[1]}' for c in ROW.split(', '))}>>, _corrupt_record STRING"


def read_pages(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """One row a readable page; what is not JSON is left out. A missing page_id is the file's name.

    A file holds one page, or with lines one page a line, as write_pages writes them: one compressed file a task.
    """
    raw = spark.read.schema(PAGE).option("multiLine", not lines).option("mode", "PERMISSIVE").json(path)
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:_enriched)?\.json(?:\.gz)?$", 1)
    return raw.where("_corrupt_record is null and rows is not null").select(F.coalesce("page_id", name).alias("page_id"), "layout_type", "rows")


def page_rows(pages: DataFrame) -> DataFrame:
    """One row a ledger row, sanitised: known row types, clamped confidence, cleaned money."""
    r = pages.select("page_id", "layout_type", F.posexplode("rows").alias("pos", "r")).select("page_id", "layout_type", "pos", "r.*")
    kind = F.lower(F.trim("row_type"))
    return r.withColumns(
        {
            "row_type": F.when(kind.isin("header", "entry", "total"), kind).otherwise("entry"),
            "row_index": F.coalesce("row_index", "pos"),
            "amount": S.pounds(S.money("amount_pounds"), S.money("amount_shillings"), S.money("amount_pence_whole"), S.fraction("amount_pence_fraction")),
            "pence": S.pence("amount_pounds", "amount_shillings", "amount_pence_whole"),
            "confidence": F.round(F.least(F.greatest(F.coalesce("confidence_score", F.lit(0.5)), F.lit(0.0)), F.lit(1.0)), 2),
            "side_adjustment": F.when(F.col("side").isin("left", "right"), 0.5).otherwise(1.0),
            "direction": S.coerced("direction", K.DIRECTIONS, K.FALLBACK["direction"], "row_type"),
            "category": S.coerced("category", K.CATEGORIES, K.FALLBACK["category"], "row_type"),
            "language": S.coerced("language", K.LANGUAGES, K.FALLBACK["language"], "row_type"),
            "payment_period": S.coerced("payment_period", K.PERIODS, K.FALLBACK["payment_period"], "row_type"),
        }
    )


def with_headers(rows: DataFrame) -> DataFrame:
    """The last non-empty header above each row of its page."""
    h = rows.withColumn("__h", F.when(F.col("row_type") == "header", F.trim("description")))
    return h.withColumn("section_header", fill_forward("__h", ["pos"], ["page_id"])).drop("__h")


def entries(rows: DataFrame, typo_gap: int | None = 5) -> DataFrame:
    """Entry rows, once a year of their page, with weights, real amounts, eras and decades; pages without a year are left out."""
    e = rows.where("row_type = 'entry'").withColumn("years", S.page_years("page_id", typo_gap)).where("years is not null")
    e = e.withColumn("year_weight", 1.0 / F.size("years")).withColumn("page", S.page_number("page_id")).withColumn("year", F.explode("years")).drop("years")
    real = F.col("amount") / (S.price_index("year") / 100)
    return e.withColumns({"amount_w": F.col("amount") * F.col("year_weight"), "real_w": real * F.col("year_weight"), "era": S.era("year"), "era4": S.era("year", K.ERAS4), "decade": S.decade("year")})


def text_entries(entries_: DataFrame) -> DataFrame:
    """Entries with a gloss; missing labels are empty texts, a missing category is other."""
    blank = {c: F.coalesce(c, F.lit("")) for c in ("direction", "language", "payment_period", "place_name", "person_name")}
    return entries_.where("trim(coalesce(english_description, '')) <> ''").withColumns(blank | {"category": F.coalesce(F.nullif("category", F.lit("")), F.lit("other"))})


def headers(rows: DataFrame) -> DataFrame:
    """Header rows with their normalised text; those of digits and punctuation only are left out."""
    return rows.where("row_type = 'header'").withColumn("header_norm", S.normal_header("description")).where("header_norm is not null")


def of_pages(df: DataFrame, page_ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of a list of pages, and the listed pages that have none."""
    return df.join(page_ids, "page_id", "left_semi"), page_ids.join(df, "page_id", "left_anti")


def side_map(rows: DataFrame) -> DataFrame:
    """(page_id, row_index, side) of valid left and right rows; of repeated indices the last one."""
    valid = rows.where("side in ('left', 'right') and row_index is not null")
    return valid.groupBy("page_id", "row_index").agg(F.max_by("side", "pos").alias("side"))


def merge_labels(rows: DataFrame, labels: DataFrame, fields: Sequence[str], order: str = "ord") -> DataFrame:
    """Rows with labels by page and row index; the last of repeated labels wins, rows without one have nulls."""
    last = labels.groupBy("page_id", "row_index").agg(F.max_by(F.struct(*fields), order).alias("__l"))
    out = rows.drop(*fields).join(last, ["page_id", "row_index"], "left")
    return out.select(*[c for c in rows.columns if c not in fields], *[F.col(f"__l.{f}").alias(f) for f in fields])


def read_scores(spark: SparkSession, path: str, tag: str, renames: dict[str, str] | None = None) -> DataFrame:
    """A report of scores with a tag for its pipeline and harmonised column names; other columns stay text."""
    df = spark.read.option("header", True).csv(path)
    for old, new in (renames or {}).items():
        df = df.withColumnRenamed(old, new)
    scored = {c: F.col(c).try_cast("double") for c in df.columns if c.endswith(("_score", "axis1", "axis2", "combined"))}
    return df.withColumns(scored).withColumn("pipeline", F.lit(tag))


def read_vectors(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(page, vector) of a JSON object from page to a list of numbers, or with lines of one such object a line."""
    text = spark.read.option("wholetext", not lines).text(path)
    return text.select(F.explode(F.from_json("value", "map<string, array<double>>")).alias("page", "vector"))


def missing_columns(df: DataFrame, wanted: Sequence[str]) -> list[str]:
    """The wanted columns that a table lacks, in their order; a caller raises or leaves the table out."""
    return [c for c in wanted if c not in df.columns]


def clean_cells(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Cells of a sheet as texts: nulls and NaN are empty, whole floating numbers lose their fraction."""

    def cell(c: str) -> Column:
        kind = df.schema[c].dataType.simpleString()
        if kind in ("double", "float"):
            x = F.col(c).cast("double")
            whole = F.when((x == F.floor(x)) & (F.abs(x) < 1e15), F.floor(x).cast("long").cast("string"))
            return F.when(x.isNull() | F.isnan(x), "").otherwise(F.coalesce(whole, x.cast("string")))
        return F.coalesce(F.col(c).cast("string"), F.lit(""))

    return df.withColumns({c: cell(c) for c in columns})


def sheet_rows(spark: SparkSession, path: str, renames: dict[str, str] | None = None) -> DataFrame:
    """The rows of an exported workbook: a folder of CSV files with a header, one sheet a file; the sheet's name is the page's."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    for old, new in (renames or {}).items():
        df = df.withColumnRenamed(old, new)
    lacking = missing_columns(df, ["row_type", "description"])
    if lacking:
        raise ValueError(f"a sheet lacks the columns {', '.join(lacking)}")
    return df.withColumn("page_id", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)\.csv$", 1))


def images(spark: SparkSession, path: str, pattern: str = "*.png") -> DataFrame:
    """(page, path, length) of image files; their bytes are read only if asked for."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return f.select(F.regexp_extract("path", r"([^/]+)\.[^.]+$", 1).alias("page"), "path", "length", "content")


def todo(found: DataFrame, done: DataFrame, key: str = "page_id") -> DataFrame:
    """What is not done yet: resuming by an anti join on keys."""
    return found.join(done.select(key), key, "left_anti")
