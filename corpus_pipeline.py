"""A corpus cleaning pipeline over `documents`, stage by stage.

Each stage takes (spark, docs, sf_dir), works on all rows that it is given and returns a DataFrame, which is written
as Parquet and read again as the next stage's docs. All but the last return the columns of docs.

Rows with null texts carry no language and go in the first stage. Rows with null ids are never near duplicates. Rows
that repeat an id are judged by their texts; of rows with equal ids and texts near-dedup keeps one,
unless the text has no words. Empty tables give
empty results.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystone.llm import decontaminate, langid, line_dedup, minhash, pieces
from tallystone.llm.common import mark, materialize, release, shared_dir, table
from tallystone.llm.queries import vocabulary

#: A document whose best language has less than this mean probability is of no known language.
MIN_LANGUAGE = 0.4
#: Keys of 8 bytes that are broadcast: 16 MB.
BROADCAST_KEYS = 2_000_000


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents of a known language; `und` and very unsure ones go. The rows keep their columns as they are."""
    net = langid.fit(docs, F.expr("crc32(cast(doc_id as string)) % 5 <> 0"))
    judged = langid.predict(docs, net, extra={f"c{i}": F.col(f"`{c}`") for i, c in enumerate(docs.columns)})
    kept = judged.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_LANGUAGE))
    # `text` itself is not passed through the network's output twice: it is one of the kept columns
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def _row() -> Column:
    """A key of the rows of one id and text."""
    return F.xxhash64("doc_id", "text")


def line_cleaning(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines that several sites and several texts share, and documents that hold nothing else; n_chars follows the text.

    Near duplicates count as one text here: a text copied over many sites keeps its lines, and near-dedup keeps one of its copies.
    """
    since = mark()
    alike = minhash.components(docs.withColumn("__row", _row()), "__row")
    classes = materialize(alike.select(F.col("doc_id").alias("row"), F.col("component_id").alias("class")).distinct(), "classes")
    release(spark, since, classes)
    shared = line_dedup.shared_by_classes(docs, line_dedup.shared_lines(docs), classes, _row())
    shared = materialize(shared, "boilerplate")
    release(spark, since, shared)
    out = line_dedup.remove_lines(docs, shared)
    out = out.where("__removed = 0 or trim(text) <> ''").drop("__lines", "__removed")
    return out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text")).cast("long")) if "n_chars" in out.columns else out


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates (five words, similarity of 0.8): the one with the least id.

    Rows are told apart by id and text. Where two of a group have the least id, the one with the least key stays; of
    rows with that id and that text one stays.
    """
    since = mark()
    keyed = docs.withColumn("__row", F.when(F.col("doc_id").isNotNull(), _row()))
    found = minhash.components(keyed, "__row").where("doc_id is not null and n_shingles > 0")
    found = materialize(found.groupBy(F.col("doc_id").alias("row"), F.col("component_id").alias("group")).agg(F.count("*").alias("n")), "rows")
    release(spark, since, found)
    ids = keyed.where("__row is not null").select(F.col("__row").alias("row"), "doc_id").distinct()
    stays = found.join(ids, "row").groupBy("group").agg(F.min(F.struct("doc_id", "row")).alias("best")).select(F.col("best.row").alias("row"))
    kept = _without(keyed, materialize(found.join(stays, "row", "left_anti").select("row"), "gone"))
    again = materialize(found.where("n > 1").select("row"), "again")
    if not again.limit(1).count():
        return kept.drop("__row")
    twice = kept.join(again, F.col("__row") == F.col("row"), "left_semi").dropDuplicates(["__row"])
    return _without(kept, again).unionByName(twice).drop("__row")


def _without(keyed: DataFrame, rows: DataFrame) -> DataFrame:
    """keyed without the rows whose key is in a stored table of keys: few keys are broadcast, so that texts stay where they are."""
    few = rows.count() <= BROADCAST_KEYS
    return keyed.join(F.broadcast(rows) if few else rows.hint("merge"), F.col("__row") == F.col("row"), "left_anti")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with ten consecutive words of a benchmark item, or the whole of a shorter one."""
    keyed = docs.select(F.sha2("text", 256).alias("k"), "text")
    found = decontaminate.find(decontaminate.build_index(keyed, "k"), table(spark, sf_dir, "benchmark"))
    hit = found.where("n_hit > 0").select(F.col("doc_id").alias("__hit")).distinct()
    return docs.join(hit, F.sha2("text", 256) == F.col("__hit"), "left_anti")


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids, round_trip) of what is left."""
    out = pieces.encode_column(docs, vocabulary("piece_bpe_32k.model"), ["doc_id", "lang", "source"])
    return out.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_cleaning),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("SentencePiece encoding", sentencepiece),
]

#: SQL cannot express the network and the tokenizer; tests hold each stage against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder and read again; what a stage stored besides is deleted."""
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        since = mark()
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        release(spark, since)
        docs = spark.read.parquet(f"{base}/{k}")
    return docs
