"""Page documents from end to end.

The driver's orders become page documents, written to the shared folder and read again by the library's readers, so
that these queries run the readers and sinks themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..operators import providers as P
from ..operators import text as T
from ..operators import vectors as V
from ..sources import pages as src
from ..sources import sinks as snk
from ..storage import new_path
from .bindings import _list, sql_case, table
from .registry import query, r6

FIELDS = ["row_type", "description", "amount_pounds", "amount_shillings", "amount_pence_whole", "amount_pence_fraction", "confidence_score", "side", "direction", "category", "language", "english_description", "place_name", "payment_period", "is_arrears"]


def _typed(spark: SparkSession, sf: str) -> DataFrame:
    """Rows as they are typed into page documents: with odd types, thousands, glyphs, out-of-range and missing values; and the order, which is the page's."""
    li = table(spark, sf, "lineitem")
    o, k, s = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey")
    y = F.lit(1700) + o % 190
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")  # one order's lines
    pick = lambda values, at: F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))
    li = li.withColumn("i", F.row_number().over(w) - 1)
    i = F.col("i")
    return li.select(
        "l_orderkey", F.when(o % 4 == 1, F.concat_ws("_", F.concat_ws("-", y, y + 1), o, F.lit("image"))).otherwise(F.concat_ws("_", y, o, F.lit("image"))).alias("page_id"),
        i.alias("row_index"), F.when(i == 0, "Header").when(i == 6, "total").when(k % 17 == 0, "Strange").otherwise("entry").alias("row_type"),
        F.when(i == 0, F.concat_ws(" ", pick(["Recepta", "Soluta", "Capitulum"], o % 3), y)).otherwise(F.concat(F.lit("rent of farm "), k)).alias("description"),
        F.when(k % 9 == 0, "").when(k % 11 == 0, "1,200").otherwise((k % 700).cast("string")).alias("amount_pounds"), (s % 20).cast("string").alias("amount_shillings"), (i % 12).cast("string").alias("amount_pence_whole"),
        pick(["½", "", "0.25"], k % 3).alias("amount_pence_fraction"), F.when(k % 8 != 0, i * 3 / 10.0 - 0.3).alias("confidence_score"), F.when(k % 4 < 3, pick(["left", "right", "both", "both"], k % 4)).alias("side"),
        F.when(o % 5 < 4, pick(["Income", "expenditure", " transfer ", "nonsense", "nonsense"], o % 5)).alias("direction"), F.when(k % 6 != 0, pick(K.CATEGORIES, k % 10)).alias("category"), pick(K.LANGUAGES, s % 3).alias("language"),
        F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("gloss "), k)).alias("english_description"), F.when(k % 7 == 0, "Oxford").alias("place_name"), pick(K.PERIODS, k % 10).alias("payment_period"), (k % 13 == 0).alias("is_arrears"),
    )


def _read(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of the page documents, written and read again."""
    path = new_path(spark, "pages")
    snk.write_pages(_typed(spark, sf), ["row_index", *FIELDS], path, within="l_orderkey")
    return src.page_rows(src.read_pages(spark, path, lines=True))


_ROWS = f"""
WITH li AS (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS INT) AS i, l_orderkey AS o, l_partkey AS k, l_suppkey AS s, 1700 + l_orderkey % 190 AS y FROM lineitem),
typed AS (SELECT o, i, y, k, s, CASE WHEN o % 4 = 1 THEN y || '-' || (y + 1) || '_' || o || '_image' ELSE y || '_' || o || '_image' END AS page_id,
    CASE WHEN i = 0 THEN 'header' WHEN i = 6 THEN 'total' ELSE 'entry' END AS row_type, i > 0 AND i <> 6 AND k % 17 <> 0 AS pure,
    CASE WHEN k % 9 = 0 THEN 0 WHEN k % 11 = 0 THEN 1200 ELSE k % 700 END + (s % 20) / 20.0::DOUBLE + ((i % 12) + [0.5, 0, 0.25][k % 3 + 1]::DOUBLE) / 240 AS amount,
    round(least(greatest(CASE WHEN k % 8 <> 0 THEN i * 3 / 10.0::DOUBLE - 0.3 ELSE 0.5 END, 0), 1), 2) AS confidence, CASE WHEN k % 4 < 3 THEN ['left','right','both'][k % 4 + 1] END AS side,
    CASE WHEN o % 5 < 3 THEN ['income','expenditure','transfer'][o % 5 + 1] ELSE 'unclear' END AS d0, CASE WHEN k % 6 <> 0 THEN {_list(K.CATEGORIES)}[k % 10 + 1] ELSE 'other' END AS c0, {_list(K.LANGUAGES)}[s % 3 + 1] AS l0,
    CASE WHEN k % 5 = 0 THEN '' ELSE 'gloss ' || k END AS gloss FROM li),
rows_ AS (SELECT *, CASE WHEN pure THEN d0 END AS direction, CASE WHEN pure THEN c0 END AS category, CASE WHEN pure THEN l0 END AS language FROM typed),
dealt AS (SELECT *, CASE WHEN o % 4 = 1 THEN 0.5 ELSE 1.0 END::DOUBLE AS year_weight, unnest(CASE WHEN o % 4 = 1 THEN [y, y + 1] ELSE [y] END) AS year FROM rows_ WHERE row_type = 'entry'),
entries AS (SELECT *, CAST(floor(year / 10) * 10 AS INT) AS decade, amount * year_weight AS amount_w, amount / ({sql_case('year', K.PRICE_ANCHORS)} / 100) * year_weight AS real_w FROM dealt)
"""


@query("s01_s04_page_entries", _ROWS + "SELECT decade, coalesce(direction,'-') AS direction, count(*) AS n, round(sum(year_weight),6) AS weight, round(sum(amount_w),6) AS amount, round(sum(real_w),6) AS real, round(avg(confidence),6) AS confidence FROM entries GROUP BY ALL")
def s01(spark, sf):
    e = src.entries(_read(spark, sf)).groupBy("decade", F.coalesce("direction", F.lit("-")).alias("direction"))
    return e.agg(F.count("*").alias("n"), r6(F.sum("year_weight"), "weight"), r6(F.sum("amount_w"), "amount"), r6(F.sum("real_w"), "real"), r6(F.avg("confidence"), "confidence"))


@query("s05_page_text_entries", _ROWS + "SELECT coalesce(category,'other') AS category, coalesce(direction,'') AS direction, count(*) AS n, count(*) FILTER (k % 7 = 0) AS placed FROM entries WHERE gloss <> '' GROUP BY ALL")
def s05(spark, sf):
    t = src.text_entries(src.entries(_read(spark, sf)))
    return t.groupBy("category", "direction").agg(F.count("*").alias("n"), F.count_if(F.col("place_name") != "").alias("placed"))


@query("s06_page_headers", "SELECT ['recepta','soluta','capitulum'][l_orderkey % 3 + 1] AS header_norm, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1")
def s06(spark, sf):
    return src.headers(_read(spark, sf)).groupBy("header_norm").agg(F.count("*").alias("n"))


@query("p16_section_headers", _ROWS + "SELECT ['Recepta','Soluta','Capitulum'][o % 3 + 1] || ' ' || y AS section_header, row_type, count(*) AS n, round(sum(amount),6) AS amount FROM rows_ GROUP BY ALL")
def p16(spark, sf):
    h = src.with_headers(_read(spark, sf))
    return h.groupBy("section_header", "row_type").agg(F.count("*").alias("n"), r6(F.sum("amount"), "amount"))


@query("s08_j16_rows_of_pages", _ROWS + ", w AS (SELECT DISTINCT page_id FROM rows_ WHERE o % 10 = 0 UNION ALL SELECT '1999_' || n_nationkey || '_image' FROM nation) SELECT 'rows' AS kind, count(*) AS n FROM rows_ WHERE page_id IN (SELECT page_id FROM w) UNION ALL SELECT 'missing', count(*) FROM w WHERE page_id NOT IN (SELECT page_id FROM rows_)")
def s08(spark, sf):
    wanted = _typed(spark, sf).where("split(page_id, '_')[1] % 10 = 0").select("page_id").distinct()
    wanted = wanted.unionByName(table(spark, sf, "nation").select(F.concat(F.lit("1999_"), "n_nationkey", F.lit("_image")).alias("page_id")))
    have, missing = src.of_pages(_read(spark, sf), wanted)
    return have.agg(F.count("*").alias("n")).select(F.lit("rows").alias("kind"), "n").unionByName(missing.agg(F.count("*").alias("n")).select(F.lit("missing").alias("kind"), "n"))


@query("s10_s11_page_sides", _ROWS + ", m AS (SELECT page_id, i // 2 AS j, arg_max(side, i) FILTER (side IN ('left','right')) AS side FROM rows_ GROUP BY ALL), r AS (SELECT rows_.page_id, i // 2 AS j, m.side FROM rows_ JOIN m ON rows_.page_id = m.page_id AND rows_.i // 2 = m.j) SELECT coalesce(side,'none') AS side, count(*) AS n, round(sum(CASE WHEN side IS NULL THEN 1.0 ELSE 0.5 END)::DOUBLE,6) AS adjusted FROM r GROUP BY 1")
def s10(spark, sf):
    r = _read(spark, sf).withColumn("row_index", F.floor(F.col("row_index") / 2).cast("int"))
    joined = r.drop("side").join(src.side_map(r), ["page_id", "row_index"], "left")
    factor = F.when(F.col("side").isNull(), 1.0).otherwise(0.5)
    return joined.groupBy(F.coalesce("side", F.lit("none")).alias("side")).agg(F.count("*").alias("n"), r6(F.sum(factor), "adjusted"))


@query("j09_page_labels", _ROWS + ", l AS (SELECT page_id, i, 'c' || (k % 5) AS category, k AS ord FROM rows_ WHERE k % 3 > 0 UNION ALL SELECT page_id, i, 'd' || (k % 5), -1 FROM rows_ WHERE k % 2 = 0), b AS (SELECT page_id, i, arg_max(category, ord) AS category FROM l GROUP BY ALL) SELECT b.category, count(*) AS n FROM rows_ LEFT JOIN b USING (page_id, i) GROUP BY 1")
def j09(spark, sf):
    r = _read(spark, sf)
    raw = _typed(spark, sf)
    keys = table(spark, sf, "lineitem").withColumn("i", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")) - 1)
    keys = keys.select(F.col("l_orderkey").cast("string").alias("o"), F.col("i").alias("row_index"), F.col("l_partkey").alias("k"))
    ids = raw.select("page_id", F.split("page_id", "_")[1].alias("o"), "row_index").join(keys, ["o", "row_index"])
    label = lambda letter: F.concat(F.lit(letter), (F.col("k") % 5).cast("string")).alias("category")
    labels = ids.where("k % 3 > 0").select("page_id", "row_index", label("c"), F.col("k").alias("ord")).unionByName(ids.where("k % 2 = 0").select("page_id", "row_index", label("d"), F.lit(-1).cast("long").alias("ord")))
    return src.merge_labels(r, labels, ["category"]).groupBy("category").agg(F.count("*").alias("n"))


@query("s19_g01_score_reports", "WITH s AS (SELECT doc_id AS page, unnest(['v2_no_gpt','v2_full']) AS pipeline, unnest([(doc_id*1299709 % 1000)/1000.0,(doc_id*15485863 % 1000)/1000.0])::DOUBLE AS score FROM documents) SELECT pipeline, count(*) AS n, count(score) FILTER (page % 7 <> 0) AS scored, round(avg(score) FILTER (page % 7 <> 0),6) AS mean_score FROM s GROUP BY pipeline")
def s19(spark, sf):
    d = table(spark, sf, "documents")
    out = None
    for tag, prime, column in (("v2_no_gpt", 1299709, "combined_score"), ("v2_full", 15485863, "final_combined")):
        path = new_path(spark, "report")
        x = F.when(F.col("doc_id") % 7 == 0, "n/a").otherwise(((F.col("doc_id") * prime) % 1000 / 1000).cast("string"))
        snk.write_table(d.select(F.col("doc_id").alias("page"), x.alias(column)), path, "csv")
        one = src.read_scores(spark, path, tag, {"combined_score": "final_combined"}).select("page", "pipeline", "final_combined")
        out = one if out is None else out.unionByName(one)
    return out.groupBy("pipeline").agg(F.count("*").alias("n"), F.count("final_combined").alias("scored"), r6(F.avg("final_combined"), "mean_score"))


@query("s20_vector_maps", "SELECT count(*) AS n, sum(len(embedding)) AS numbers, round(sum(list_sum(embedding::DOUBLE[])),4) AS total FROM embeddings")
def s20(spark, sf):
    path = new_path(spark, "vectors")
    e = table(spark, sf, "embeddings")
    # a line holds the vectors of 32 pages at most
    lines = e.groupBy(F.floor(F.col("vec_id") / 32).alias("g")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("vec_id").cast("string"), F.col("embedding").cast("array<double>"))))).alias("value"))
    lines.select("value").write.text(path)
    v = src.read_vectors(spark, path, lines=True)
    return v.agg(F.count("*").alias("n"), F.sum(F.size("vector")).alias("numbers"), F.round(F.sum(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x)), 4).alias("total"))


@query("s23_s24_pages_to_do", _ROWS + ", p AS (SELECT DISTINCT page_id, o FROM rows_) SELECT substr(page_id,1,3) AS century, count(*) AS n FROM p WHERE o % 3 <> 0 GROUP BY 1")
def s23(spark, sf):
    found = _read(spark, sf).select("page_id").distinct()
    done = _typed(spark, sf).where("split(page_id, '_')[1] % 3 = 0").select("page_id").distinct()
    return src.todo(found, done).groupBy(F.substring("page_id", 1, 3).alias("century")).agg(F.count("*").alias("n"))


_SUMMARY = "SELECT page_id, substr(page_id,1,31) AS sheet, count(*) AS total_rows, count(*) FILTER (row_type='entry') AS entries, count(*) FILTER (row_type='header') AS headers, count(*) FILTER (row_type='total') AS totals FROM rows_ GROUP BY page_id"


@query("k02_k03_page_summary", _ROWS + _SUMMARY)
def k03(spark, sf):
    return snk.page_summary(_read(spark, sf))


@query("k06_report_lines", _ROWS + ", p AS (" + _SUMMARY + ") SELECT page_id || ': ' || entries || ' entries, ' || headers || ' headers' AS line FROM p")
def k06(spark, sf):
    return snk.report_lines(snk.page_summary(_read(spark, sf)), "%s: %d entries, %d headers", "page_id", "entries", "headers")


@query("s15_k04_ground_truth", _ROWS + "SELECT page_id, count(*) AS n, string_agg(CASE WHEN k % 9 = 0 THEN '' ELSE CAST(k % 700 AS VARCHAR) || (CASE WHEN k % 2 = 0 THEN '' ELSE '.5' END) END, '|' ORDER BY i) AS cells FROM rows_ GROUP BY page_id")
def s15(spark, sf):
    """A master sheet with floating cells, cleaned and written as one document a page."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    o, k, y = F.col("l_orderkey"), F.col("l_partkey"), F.lit(1700) + F.col("l_orderkey") % 190
    sheet = table(spark, sf, "lineitem").withColumn("row_index", F.row_number().over(w) - 1)
    amount = F.when(k % 9 != 0, (k % 700).cast("double") + (k % 2) * 0.5)
    page = F.when(o % 4 == 1, F.concat_ws("_", F.concat_ws("-", y, y + 1), o, F.lit("image"))).otherwise(F.concat_ws("_", y, o, F.lit("image")))
    sheet = sheet.select(page.alias("page_id"), "row_index", amount.alias("amount_pounds"))
    path = new_path(spark, "truth")
    snk.write_pages(src.clean_cells(sheet, ["amount_pounds"]), ["row_index", "amount_pounds"], path)
    d = src.read_pages(spark, path, lines=True)
    return d.select("page_id", F.size("rows").cast("long").alias("n"), F.array_join(F.transform("rows", lambda r: r["amount_pounds"]), "|").alias("cells"))


_WANTED = ["l_orderkey", "row_type", "l_tax", "Description", "no such", "l_returnflag"]
_PRESENT = [w for w in _WANTED if w.startswith("l_")]


@query("f13_column_presence", " UNION ALL ".join(f"SELECT '{w}' AS name, {w in _PRESENT} AS present, {f'count({w})' if w in _PRESENT else '0'} AS n_values, count(*) AS n_rows FROM lineitem" for w in _WANTED))
def f13(spark, sf):
    t = table(spark, sf, "lineitem")
    lacking = src.missing_columns(t, _WANTED)
    counts = t.agg(F.count("*").alias("n_rows"), *[(F.lit(0) if w in lacking else F.count(w)).cast("long").alias(w) for w in _WANTED])  # one pass over the present columns, one row
    facts = F.array(*[F.struct(F.lit(w).alias("name"), F.lit(w not in lacking).alias("present"), F.col(f"`{w}`").alias("n_values")) for w in _WANTED])
    return counts.select("n_rows", F.inline(facts)).select("name", "present", "n_values", "n_rows")


@query("e11_candidates", _ROWS + ", n AS (SELECT page_id, 0 AS ord, 'full' AS name, count(*) AS n FROM rows_ WHERE k % 3 > 0 GROUP BY 1 UNION ALL SELECT page_id, 1, 'ablation', count(*) FROM rows_ WHERE k % 5 > 0 GROUP BY 1 UNION ALL SELECT page_id, 2, 'skeleton', count(*) FROM rows_ WHERE i < 4 GROUP BY 1) SELECT best, count(*) AS n FROM (SELECT page_id, arg_min(name, (-n) * 10 + ord) AS best FROM n GROUP BY 1) GROUP BY 1")
def e11(spark, sf):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    r = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("page_id"), F.col("l_partkey").alias("k"), (F.row_number().over(w) - 1).alias("i"))
    best = P.candidates({"full": r.where("k % 3 > 0"), "ablation": r.where("k % 5 > 0"), "skeleton": r.where("i < 4")})
    return best.groupBy("best").agg(F.count("*").alias("n"))


_STEP_TF = f"""WITH k AS (SELECT doc_id % 30 AS step, list_filter(regexp_extract_all(lower(coalesce(text,'')),'[a-z]{{2,}}'), lambda x: x NOT IN ({', '.join(repr(x) for x in K.LEDGER_STOPS)})) AS w FROM documents),
tf AS (SELECT step, term, count(*) AS tf FROM (SELECT step, unnest(w) AS term FROM k) GROUP BY ALL), v AS (SELECT term, ln((1+30)/(1+count(*)))+1 AS idf FROM tf GROUP BY term), w0 AS (SELECT step, term, tf*idf AS w FROM tf JOIN v USING (term)), w AS (SELECT step, term, w/sqrt(sum(w*w) OVER (PARTITION BY step)) AS w FROM w0)
"""


@query("w16_lag_similarity", _STEP_TF + ", s AS (SELECT a.step AS a, b.step AS b, sum(a.w*b.w) AS similarity FROM w a JOIN w b ON a.term=b.term AND a.step<b.step GROUP BY ALL) SELECT b, round(avg(similarity),6) AS mean_before FROM s WHERE b-a <= 10 GROUP BY b")
def w16(spark, sf):
    d = table(spark, sf, "documents").withColumn("step", F.col("doc_id") % 30)
    s = T.cosine(T.tfidf(T.term_counts(d, "step", "text", 2, K.LEDGER_STOPS), "step"), "step")
    return V.lag_similarity(s, "mean_before").select("b", r6("mean_before", "mean_before"))
