"""Operator 7: cross-site boilerplate lines, found by HyperLogLog sketches of the sites that carry a line.

Every line is hashed; a sketch of its sites is kept for each hash and merged by aggregation, map side first, so that a
line found everywhere costs one sketch a task. Lines whose estimate is clearly over or under the threshold are decided
by the sketch; those near it get exact distinct counts. Lines that are boilerplate are then removed from the documents.

Lines are texts between newlines, trimmed of blanks; blank lines are never removed. Null texts stay null and have no
lines; a null site is no site. A document all of whose lines go keeps an empty text. Repeated rows are treated alike,
and a line counts once a site however often it is repeated. Columns other than the text are returned as they are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, lookup, materialize

#: A line is boilerplate if this many sites carry it.
SITES = 5
#: Sketches of 2**LG_K registers.
LG_K = 10
#: Shared lines up to this number are looked up from a broadcast table (24 bytes each). Of more, the hot ones are (see
#: lookup), and the rest by a shuffled join.
BROADCAST_ROWS = 200_000
#: Entries of all texts' lists of lines to remove that are broadcast; with more the texts are shuffled to their lists.
BROADCAST_DROPS = 10_000


def trimmed(line: Column) -> Column:
    return F.trim(line, F.lit(" \t\r\f\v"))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _exploded(docs: DataFrame, text_col: str, *keep: Column) -> DataFrame:
    """One row a line with its 96-bit hash; blank lines are left out."""
    rows = docs.where(col(text_col).isNotNull()).select(*keep, F.explode(_lines(col(text_col))).alias("line"))
    rows = rows.withColumn("line", trimmed(F.col("line"))).where("line <> ''")
    return rows.withColumn("h", F.xxhash64("line")).withColumn("g", F.hash("line")).drop("line")


def shared_lines(docs: DataFrame, site_col: str = "source", text_col: str = "text", sites: int = SITES, lg_k: int = LG_K) -> DataFrame:
    """(h, g, estimate, n_sites, n): hashes of the lines that at least `sites` sites carry.

    n_sites is the exact count for lines near the threshold and null for those that the sketch decided; n counts the
    line's occurrences.
    """
    return _spread(_exploded(docs, text_col, col(site_col).alias("site")).where("site is not null"), sites, lg_k)


def shared_by_classes(docs: DataFrame, shared: DataFrame, classes: DataFrame, row: Column, text_col: str = "text", least: int = SITES, lg_k: int = LG_K) -> DataFrame:
    """Those of the shared lines that documents of at least `least` classes carry.

    row is the key of a document, and classes holds (row, class) once for each. With copies in one class, a text that
    is copied over many sites does not make its own lines boilerplate.
    """
    lines = _matching(_exploded(docs, text_col, row.alias("row")), shared)
    lines = lines.join(classes, "row").select("h", "g", F.col("class").alias("site"))
    return shared.join(_spread(materialize(lines, "classes"), least, lg_k).select("h", "g"), ["h", "g"], "left_semi")


def _spread(lines: DataFrame, sites: int, lg_k: int) -> DataFrame:
    """(h, g, estimate, n_sites, n) of the lines (h, g, site) with at least `sites` different sites."""
    # A line of one site has spread 1 and needs no sketch: least and greatest site settle that in a plain aggregation.
    ends = lines.groupBy("h", "g").agg(F.min(F.xxhash64("site")).alias("a"), F.max(F.xxhash64("site")).alias("b"), F.count("*").alias("n")).where("a <> b" if sites > 1 else "true")
    spread = materialize(ends.select("h", "g", "n"), "spread")
    # each line and site once, so that a line found everywhere has a row a site; sketches and exact counts both read these
    several = materialize(_matching(lines, spread).groupBy("h", "g", "site").agg(F.count("*").alias("m")), "pairs")
    sketched = several.groupBy("h", "g").agg(F.hll_sketch_agg("site", F.lit(lg_k)).alias("s"), F.sum("m").alias("n"))
    sketched = materialize(sketched.select("h", "g", F.hll_sketch_estimate("s").alias("estimate"), "n"), "sketches")
    margin = 6 * 1.04 / math.sqrt(1 << lg_k)  # six standard errors of the estimate, and one site
    low, high = sites * (1 - margin) - 1, sites * (1 + margin) + 1
    sure = sketched.where(F.col("estimate") > high).select("h", "g", "estimate", F.lit(None).cast("long").alias("n_sites"), "n")
    near = sketched.where(F.col("estimate").between(low, high))
    counted = _matching(several.select("h", "g"), near).groupBy("h", "g").agg(F.count("*").alias("n_sites")).where(F.col("n_sites") >= sites)
    exact = near.join(counted, ["h", "g"]).select("h", "g", "estimate", "n_sites", "n")
    return materialize(sure.unionByName(exact), "boilerplate")


def _matching(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """Lines whose hash is wanted: wanted has one row a hash, and n, about the number of lines of that hash."""
    return lookup(lines, wanted.select("h", "g", "n"), ["h", "g"], small=BROADCAST_ROWS)


def remove_lines(docs: DataFrame, shared: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the shared lines; n_lines and n_removed of each text are in __lines and __removed."""
    # Each row is looked up by the hash of its whole text, so that ids may be null or repeated.
    key = ["__x", "__y", "__n"]
    texts = [F.xxhash64(col(text_col)).alias("__x"), F.hash(col(text_col)).alias("__y"), F.length(col(text_col)).alias("__n")]
    hits = _matching(_exploded(docs, text_col, *texts), shared).groupBy(*key, "h", "g").agg(F.count("*").alias("n"))
    # at most the lines of one text; n is at least the number of documents of that text
    drops = materialize(hits.groupBy(*key).agg(F.collect_list(F.struct("h", "g")).alias("__drop"), F.max("n").alias("n")), "drops")
    few = drops.agg(F.sum(F.size("__drop"))).first()[0] or 0
    keyed = docs.withColumns(dict(zip(key, [F.xxhash64(col(text_col)), F.hash(col(text_col)), F.length(col(text_col))], strict=True)))
    joined = lookup(keyed, drops, key, "left", small=BROADCAST_DROPS if few <= BROADCAST_DROPS else 0, shuffled=True)
    lines = _lines(col(text_col))
    kept = F.filter(lines, lambda x: ~F.array_contains("__drop", F.struct(F.xxhash64(trimmed(x)).alias("h"), F.hash(trimmed(x)).alias("g"))))
    text = F.when(F.col("__drop").isNull(), col(text_col)).otherwise(F.array_join(kept, "\n"))
    out = joined.withColumns({"__text": text, "__lines": F.when(col(text_col).isNull(), 0).otherwise(F.size(lines)).cast("long")})
    after = F.when(F.col("__text").isNull(), 0).when(F.col("__drop").isNull(), F.col("__lines")).otherwise(F.size(kept)).cast("long")
    out = out.withColumn("__removed", F.col("__lines") - after)
    return out.select(*[F.col("__text").alias(text_col) if c == text_col else col(c) for c in docs.columns], "__lines", "__removed")


def op7(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_removed, text): every document without its cross-site boilerplate."""
    out = remove_lines(docs, shared_lines(docs))
    return out.select("doc_id", F.col("__lines").alias("n_lines"), F.col("__removed").alias("n_removed"), "text")


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, source, pos, raw, trim(raw, e' \t\r\f\v') AS line
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS raw,
               generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL)),
shared AS (SELECT line FROM lines WHERE line <> '' GROUP BY line HAVING count(DISTINCT source) >= 5),
kept AS (
  SELECT doc_id, count(*) AS n_lines, count(shared.line) AS n_removed,
         coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (WHERE shared.line IS NULL), '') AS text
  FROM lines LEFT JOIN shared ON lines.line = shared.line GROUP BY doc_id)
SELECT d.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed,
       CASE WHEN d.text IS NULL THEN NULL ELSE k.text END AS text
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
