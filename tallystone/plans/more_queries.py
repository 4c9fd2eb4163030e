"""The rest of the inventory: pivots and report tables, routing features, clusters of documents, hooks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import scalars as S
from ..operators import providers as P
from ..operators import reliability as R
from ..operators import routing as G
from ..operators import series as W
from ..operators import shares as A
from ..operators import text as T
from ..operators import vectors as V
from .aggregate_queries import scores
from .bindings import ENTRIES, entries, table
from .model_queries import _NEAR5, _VOTE
from .page_queries import _STEP_TF
from .registry import query, r6
from .text_queries import _TF, DOCS, docs


@query("s05_text_entries", DOCS + "SELECT lang, count(*) AS n, count(*) FILTER (source IS NULL) AS no_source FROM d WHERE trim(t) <> '' GROUP BY lang")
def s05(spark, sf):
    return docs(spark, sf).where("trim(coalesce(text, '')) <> ''").groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("source").isNull()).alias("no_source"))


@query("s10_j10_side_map", "WITH s AS (SELECT l_orderkey AS sheet, l_linenumber AS i, arg_max(CASE l_partkey % 2 WHEN 0 THEN 'left' ELSE 'right' END, l_partkey) AS side FROM lineitem WHERE l_partkey % 5 > 0 GROUP BY 1, 2), r AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) SELECT coalesce(side,'none') AS side, count(*) AS n, round(sum(CASE WHEN side IS NULL THEN 1.0 ELSE 0.5 END),6) AS adjusted FROM r LEFT JOIN s ON l_orderkey=sheet AND l_linenumber=i GROUP BY 1")
def s10(spark, sf):
    li = table(spark, sf, "lineitem")
    side = F.when(F.col("l_partkey") % 2 == 0, "left").otherwise("right")
    g = li.groupBy("l_orderkey", "l_linenumber").agg(F.max_by(side, F.when(F.col("l_partkey") % 5 > 0, F.col("l_partkey"))).alias("side"))
    return g.groupBy(F.coalesce("side", F.lit("none")).alias("side")).agg(F.count("*").alias("n"), F.sum(F.when(F.col("side").isNull(), 1.0).otherwise(0.5)).cast("decimal(38,1)").alias("adjusted"))


@query("p12_p15_natural_order", "SELECT page_id, rank FROM (SELECT page_id, row_number() OVER (ORDER BY y, n) AS rank FROM (SELECT DISTINCT 1700 + CAST(o_orderkey % 190 AS INT) AS y, CAST(o_orderkey % 11 AS INT) AS n, (1700 + CAST(o_orderkey % 190 AS INT)) || '_' || (o_orderkey % 11) || '_image' AS page_id FROM orders))")
def p15(spark, sf):
    o = table(spark, sf, "orders").select(F.concat_ws("_", F.col("o_orderkey") % 190 + 1700, F.col("o_orderkey") % 11, F.lit("image")).alias("page_id")).distinct()
    return o.select("page_id", F.row_number().over(Window.orderBy(S.natural_key("page_id"))).alias("rank"))


@query("p26_config_names", "SELECT DISTINCT CASE o_orderstatus WHEN 'F' THEN 'v2_no_claude' WHEN 'O' THEN 'v2_no_gpt' ELSE 'v2_full' END || '/' || array_to_string(list_sort([lower(o_orderpriority[3:]), 'haiku']), '+') AS config FROM orders")
def p26(spark, sf):
    o = table(spark, sf, "orders").select("o_orderstatus", "o_orderpriority").distinct()
    tag = F.coalesce(S.lookup("o_orderstatus", {"F": "v2_no_claude", "O": "v2_no_gpt"}), F.lit("v2_full"))
    models = F.array_join(F.array_sort(F.array(F.lower(F.substring("o_orderpriority", 3, 30)), F.lit("haiku"))), "+")
    return o.select(F.concat_ws("/", tag, models).alias("config")).distinct()


@query("f05_f06_patterns", DOCS + "SELECT lang, count(*) FILTER (regexp_matches(t,'(tion|ment|heit)')) AS suffix, count(*) FILTER (regexp_matches(coalesce(text,''),'[A-Z]{3,}')) AS capitals, count(*) FILTER (len(t) >= 2000) AS long FROM d GROUP BY lang")
def f05(spark, sf):
    t = F.lower(F.coalesce("text", F.lit("")))
    return docs(spark, sf).groupBy("lang").agg(F.count_if(t.rlike("(tion|ment|heit)")).alias("suffix"), F.count_if(F.coalesce("text", F.lit("")).rlike("[A-Z]{3,}")).alias("capitals"), F.count_if(F.length(t) >= 2000).alias("long"))


@query("j11_outer_series", ENTRIES + ", a AS (SELECT year, sum(amount_w) AS x FROM entries WHERE direction='income' AND category='financial' GROUP BY year), b AS (SELECT year, sum(amount_w) AS y FROM entries WHERE direction='expenditure' AND category='charitable' GROUP BY year) SELECT year, round(x,6) AS income, round(y,6) AS charity FROM a FULL JOIN b USING (year)")
def j11(spark, sf):
    e = entries(spark, sf).where("(direction = 'income' and category = 'financial') or (direction = 'expenditure' and category = 'charitable')")
    part = lambda d: F.sum(F.when(F.col("direction") == d, F.col("amount_w")))
    return e.groupBy("year").agg(r6(part("income"), "income"), r6(part("expenditure"), "charity"))


@query("a01_a03_a22_counts", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, min(value) AS least, max(value) AS most, round(avg(value),6) AS mean, round(median(value),6) AS median FROM events GROUP BY 1")
def a01(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.min("value").alias("least"), F.max("value").alias("most"), r6(F.avg("value"), "mean"), r6(F.median("value"), "median"))


@query("w16_temporal_similarity", _TF.replace("SELECT lang, term, count(*) AS tf", "SELECT step, term, count(*) AS tf").replace("(SELECT lang, unnest(", "(SELECT step, unnest(").replace("SELECT doc_id, lang, list_filter", "SELECT doc_id, doc_id % 6 AS step, list_filter") + """, v AS (SELECT term, ln((1+6)/(1+count(*)))+1 AS idf FROM tf GROUP BY term), w0 AS (SELECT step, term, tf*idf AS w FROM tf JOIN v USING (term)), w AS (SELECT step, term, w/sqrt(sum(w*w) OVER (PARTITION BY step)) AS w FROM w0),
s AS (SELECT a.step AS a, b.step AS b, sum(a.w*b.w) AS similarity FROM w a JOIN w b ON a.term=b.term AND a.step<b.step GROUP BY ALL) SELECT b AS step, round(avg(similarity) FILTER (b-a <= 3),6) AS mean_before, round(max(similarity) FILTER (b-a=1),6) AS to_previous FROM s GROUP BY b""")  # fmt: skip
def w16(spark, sf):
    tf = T.term_counts(docs(spark, sf).withColumn("step", F.col("doc_id") % 6), "step", "text", 2, K.LEDGER_STOPS, pairs=True)
    s = T.cosine(T.tfidf(tf, "step"), "step")
    return s.groupBy(F.col("b").alias("step")).agg(r6(F.avg(F.when(F.col("b") - F.col("a") <= 3, F.col("similarity"))), "mean_before"), r6(F.max(F.when(F.col("b") - F.col("a") == 1, F.col("similarity"))), "to_previous"))


@query("q12_header_counts", "SELECT role, count(*) AS n_rows, count(DISTINCT lower(trim(text))) AS n_unique, round(count(DISTINCT lower(trim(text)))/count(*),6) AS diversity FROM conversations WHERE text IS NOT NULL GROUP BY role")
def q12(spark, sf):
    c = table(spark, sf, "conversations").where("text is not null").groupBy("role").agg(F.count("*").alias("n_rows"), F.countDistinct(F.lower(F.trim("text"))).alias("n_unique"))
    return c.select("role", "n_rows", "n_unique", r6(S.ratio("n_unique", "n_rows"), "diversity"))


@query("q27_role_crossover", ENTRIES + ", s AS (SELECT year, coalesce(sum(real_w) FILTER (category='maintenance'),0) AS a, coalesce(sum(real_w) FILTER (category='financial'),0) AS b FROM entries GROUP BY year) SELECT min(year) AS crossover, count(*) AS years_over FROM s WHERE round(b,6) > round(a,6)")
def q27(spark, sf):
    p = A.wide(entries(spark, sf), ["year"], "category", ["maintenance", "financial"], F.sum("real_w"))
    return p.where(F.round("financial", 6) > F.round("maintenance", 6)).agg(F.min("year").alias("crossover"), F.count("*").alias("years_over"))


@query("q34_category_terms", DOCS + """, k AS (SELECT lang, cat, unnest(regexp_extract_all(t,'[a-z]{4,}')) AS term FROM d), c AS (SELECT lang, cat, term, count(*) AS tf FROM k GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY lang, cat ORDER BY tf DESC, term) AS rank FROM c) SELECT lang, cat, rank, term, tf FROM r WHERE rank <= 8""")
def q34(spark, sf):
    c = docs(spark, sf).select("lang", "cat", F.explode(T.tokens("text", 4)).alias("term")).groupBy("lang", "cat", "term").agg(F.count("*").alias("tf"))
    return A.top(c, ["lang", "cat"], 8, F.desc("tf"), F.asc("term")).select("lang", "cat", "rank", "term", "tf")


@query("q40_cluster_pivot", "SELECT label, count(*) FILTER (vec_id % 4 = 0) AS c0, count(*) FILTER (vec_id % 4 = 1) AS c1, count(*) FILTER (vec_id % 4 = 2) AS c2, count(*) FILTER (vec_id % 4 = 3) AS c3 FROM embeddings GROUP BY label")
def q40(spark, sf):
    p = A.wide(table(spark, sf, "embeddings").withColumn("c", F.col("vec_id") % 4), ["label"], "c", [0, 1, 2, 3], F.count(F.lit(1)), fill=0)
    return p.select("label", *[F.col(str(i)).alias(f"c{i}") for i in range(4)])


@query("m07_purity", "WITH c AS (SELECT vec_id % 4 AS c, label, count(*) AS n FROM embeddings GROUP BY ALL) SELECT round(sum(m)/sum(s),6) AS purity FROM (SELECT c, max(n) AS m, sum(n) AS s FROM c GROUP BY c)")
def m07(spark, sf):
    return V.purity(table(spark, sf, "embeddings").withColumn("c", F.col("vec_id") % 4), "c", "label").select(r6("purity", "purity"))


@query("m11_chunk_mean", "WITH x AS (SELECT vec_id, vec_id % 50 AS doc, unnest(generate_series(0,63)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT doc, i, sum(x*(1+vec_id%7))/sum(1+vec_id%7) AS x FROM x GROUP BY ALL) SELECT doc, round(sum(x*(i+1)),6) AS digest FROM m GROUP BY doc")
def m11(spark, sf):
    e = table(spark, sf, "embeddings").select((F.col("vec_id") % 50).alias("doc"), (F.col("vec_id") % 7 + 1).alias("w"), "embedding")
    m = V.chunk_mean(e, "doc", "embedding", "w").select("doc", F.posexplode("embedding").alias("i", "x"))
    return m.groupBy("doc").agg(r6(F.sum(F.col("x") * (F.col("i") + 1)), "digest"))


@query("m01_svd_projection")
def m01(spark, sf):
    return V.svd(table(spark, sf, "embeddings"), "vec_id", "embedding", 4)


@query("m10_text_embedding")
def m10(spark, sf):
    return docs(spark, sf).select("doc_id", P.embedding("text").alias("vector"))


@query("r04_statistics", ENTRIES + "SELECT 'income_share' AS stat, CAST(decade AS VARCHAR) AS stratum, round(coalesce(sum(amount_w) FILTER (direction='income'),0)/sum(amount_w),6) AS x FROM entries WHERE direction IN ('income','expenditure') GROUP BY decade UNION ALL SELECT 'land_rent_share', era, round(coalesce(sum(amount_w) FILTER (category='land_rent'),0)/sum(amount_w),6) FROM entries GROUP BY era UNION ALL SELECT 'english_share', CAST(decade AS VARCHAR), round(coalesce(sum(year_weight) FILTER (language='english'),0)/sum(year_weight),6) FROM entries GROUP BY decade")
def r04(spark, sf):
    e = entries(spark, sf)
    part = lambda c, v: F.sum(F.when(c, F.col(v)).otherwise(0.0))
    ie = F.col("direction").isin("income", "expenditure")
    g = e.groupBy("decade", "era").agg(part(F.col("direction") == "income", "amount_w").alias("i"), part(ie, "amount_w").alias("ie"), part(F.col("category") == "land_rent", "amount_w").alias("l"), F.sum("amount_w").alias("a"), part(F.col("language") == "english", "year_weight").alias("e"), F.sum("year_weight").alias("n"))
    row = lambda s, k, x, y: F.struct(F.lit(s).alias("stat"), F.col(k).cast("string").alias("stratum"), F.col(x).alias("x"), F.col(y).alias("y"))
    long = g.select(F.inline(F.array(row("income_share", "decade", "i", "ie"), row("land_rent_share", "era", "l", "a"), row("english_share", "decade", "e", "n"))))
    return long.groupBy("stat", "stratum").agg(r6(S.ratio(F.sum("x"), F.sum("y")), "x")).where("x is not null")


_HV = "WITH h AS (SELECT CASE o_orderkey % 3 WHEN 0 THEN 'income' WHEN 1 THEN 'expenditure' END AS implied, CASE o_orderstatus WHEN 'F' THEN 'income' ELSE 'expenditure' END AS direction FROM orders)"


@query("r12_header_validation", _HV + " SELECT coalesce(implied,'OVERALL') AS header_direction, count(*) AS n_rows, round(avg((implied=direction)::INT),6) AS agree_rate FROM h WHERE implied IS NOT NULL GROUP BY ROLLUP(implied)")
def r12(spark, sf):
    h = table(spark, sf, "orders").select(F.when(F.col("o_orderkey") % 3 == 0, "income").when(F.col("o_orderkey") % 3 == 1, "expenditure").alias("implied"), F.when(F.col("o_orderstatus") == "F", "income").otherwise("expenditure").alias("direction"))
    h = h.where("implied is not null").withColumn("same", (F.col("implied") == F.col("direction")).cast("double"))
    return h.rollup("implied").agg(F.count("*").alias("n_rows"), F.avg("same").alias("r")).select(F.coalesce("implied", F.lit("OVERALL")).alias("header_direction"), "n_rows", r6("r", "agree_rate"))


@query("r12_confusion_matrix", _HV + " SELECT implied, count(*) FILTER (direction='income') AS income, count(*) FILTER (direction='expenditure') AS expenditure FROM h WHERE implied IS NOT NULL GROUP BY implied")
def r12_confusion(spark, sf):
    h = table(spark, sf, "orders").select(F.when(F.col("o_orderkey") % 3 == 0, "income").when(F.col("o_orderkey") % 3 == 1, "expenditure").alias("implied"), F.when(F.col("o_orderstatus") == "F", "income").otherwise("expenditure").alias("direction"))
    return R.confusion(h, "implied", "direction", ["income", "expenditure"])


@query("r20_report_tables", ENTRIES + """, s AS (SELECT unnest(['baseline','no_arrears','confident','annual']) AS setting), v AS (SELECT setting, decade, coalesce(sum(amount_w) FILTER (category='land_rent'),0)/sum(amount_w) AS x FROM entries, s WHERE setting='baseline' OR (setting='no_arrears' AND NOT coalesce(is_arrears,false)) OR (setting='confident' AND coalesce(confidence,0) >= 0.3) OR (setting='annual' AND payment_period='annual') GROUP BY ALL),
d AS (SELECT v.setting, (v.x-b.x)*100 AS d FROM v JOIN v b ON b.setting='baseline' AND v.setting<>'baseline' AND v.decade=b.decade) SELECT setting, count(*) AS n, round(max(abs(d)),6) AS max_delta_pp, round(avg(d),6) AS mean_delta_pp, CASE WHEN round(max(abs(d)),9) <= 2 THEN 'robust' WHEN round(max(abs(d)),9) <= 5 THEN 'moderate' ELSE 'sensitive' END AS verdict FROM d GROUP BY setting""")  # fmt: skip
def r20_tables(spark, sf):
    e = entries(spark, sf)
    tests = {"baseline": F.lit(True), "no_arrears": ~F.coalesce("is_arrears", F.lit(False)), "confident": F.coalesce("confidence", F.lit(0.0)) >= 0.3, "annual": F.col("payment_period") == "annual"}
    sums = [x for k, t in tests.items() for x in (F.sum(F.when(t, F.col("amount_w"))).alias(k), F.sum(F.when(t & (F.col("category") == "land_rent"), F.col("amount_w")).otherwise(0.0)).alias(k + "_land"))]
    wide = e.groupBy("decade").agg(*sums)
    long = wide.select("decade", F.inline(F.array(*[F.struct(F.lit(k).alias("setting"), S.ratio(F.col(k + "_land"), F.col(k)).alias("x")) for k in tests])))
    d = R.deltas(long.where("x is not null"), "decade", "setting", "x", "baseline")
    return d.select("setting", "n", r6("max_delta_pp", "max_delta_pp"), r6("mean_delta_pp", "mean_delta_pp"), "verdict")


@query("r20_verdicts", "WITH r AS (SELECT doc_id % 10 AS grp, avg((quality = CASE WHEN doc_id % 37 = 0 THEN 1-quality ELSE quality END)::INT) AS rate FROM labels GROUP BY 1) SELECT grp, round(rate,6) AS rate, CASE WHEN round(rate,9) >= 0.99 THEN 'pass' ELSE 'check' END AS agreement, CASE WHEN round(rate,9) >= 0.8 THEN 'pass' ELSE 'check' END AS kappa FROM r")
def r20_verdicts(spark, sf):
    q = F.col("quality")
    r = table(spark, sf, "labels").groupBy((F.col("doc_id") % 10).alias("grp")).agg(F.avg((q == F.when(F.col("doc_id") % 37 == 0, 1 - q).otherwise(q)).cast("double")).alias("rate"))
    return r.select("grp", r6("rate", "rate"), R.verdict(F.col("rate"), 0.99).alias("agreement"), R.verdict(F.col("rate"), 0.8).alias("kappa"))


@query("a16_correlation_matrix", "WITH x AS (SELECT vec_id, unnest(generate_series(0,63)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) SELECT CAST(a.i AS INT) AS i, CAST(b.i AS INT) AS j, round(corr(a.x,b.x),6) AS r FROM x a JOIN x b ON a.vec_id=b.vec_id AND a.i<b.i GROUP BY ALL")
def a16(spark, sf):
    return W.correlations(table(spark, sf, "embeddings"), "embedding").select("i", "j", r6("r", "r"))


@query("m02_median_fill", "WITH x AS (SELECT vec_id, unnest(generate_series(0,63)) AS i, unnest(embedding)::DOUBLE AS x0 FROM embeddings), y AS (SELECT vec_id, i, CASE WHEN (vec_id + i) % 9 = 0 THEN NULL ELSE x0 END AS x FROM x), f AS (SELECT vec_id, i, coalesce(x, quantile_cont(x,0.5) OVER (PARTITION BY i)) AS x FROM y) SELECT vec_id, CAST(i AS INT) AS i, round((x-avg(x) OVER (PARTITION BY i))/stddev_pop(x) OVER (PARTITION BY i),6) AS z FROM f")
def m02_fill(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x, i: F.when((F.col("vec_id") + i) % 9 != 0, x)).alias("embedding"))
    return V.standardised(e, "vec_id", "embedding", fill=True).select("vec_id", "i", r6("z", "z"))


@query("m08_top_neighbours", _STEP_TF + ", s AS (SELECT a.step AS a, b.step AS b, sum(a.w*b.w) AS x FROM w a JOIN w b ON a.term=b.term AND a.step<>b.step GROUP BY ALL) SELECT a, b, rank, round(x,6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(x,9) DESC, b) AS rank FROM s) WHERE rank <= 5")
def m08_top(spark, sf):
    d = table(spark, sf, "documents").withColumn("step", F.col("doc_id") % 30)
    s = T.cosine(T.tfidf(T.term_counts(d, "step", "text", 2, K.LEDGER_STOPS), "step"), "step")
    both = s.unionByName(s.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity"))
    return A.top(both, ["a"], 5, F.desc(F.round("similarity", 9)), F.asc("b")).select("a", "b", "rank", r6("similarity", "similarity"))


@query("r17_educational_direction", ENTRIES + "SELECT threshold, era, round(coalesce(sum(year_weight) FILTER (direction='income'),0)/sum(year_weight),6) AS income_pct, count(*) FILTER (direction='income') AS n_income FROM entries, (VALUES (0.0::DOUBLE),(0.3::DOUBLE),(0.6::DOUBLE)) t(threshold) WHERE category='educational' AND direction IN ('income','expenditure') AND confidence IS NOT NULL AND round(confidence,6) >= threshold GROUP BY ALL")
def r17(spark, sf):
    e = entries(spark, sf).where("category = 'educational' and direction in ('income', 'expenditure') and confidence is not null").withColumn("level", F.round("confidence", 6))
    income = F.col("direction") == "income"
    e = e.groupBy("level", "era").agg(F.sum(F.when(income, F.col("year_weight")).otherwise(0.0)).alias("a"), F.sum("year_weight").alias("s"), F.count_if(income).alias("k"))
    g = A.sweep(e, {"threshold": [0.0, 0.3, 0.6]}).where("level >= threshold").groupBy("threshold", "era").agg(F.sum("a").alias("a"), F.sum("s").alias("s"), F.sum("k").alias("n_income"))
    return g.select("threshold", "era", r6(S.ratio("a", "s"), "income_pct"), "n_income")


_SC = "WITH s AS (SELECT doc_id AS page, unnest(['v2_no_gemini','v2_no_claude','v2_no_gpt','v2_full']) AS pipeline, unnest([(doc_id*7919 % 1000)/1000.0,(doc_id*104729 % 1000)/1000.0,(doc_id*1299709 % 1000)/1000.0,(doc_id*15485863 % 1000)/1000.0])::DOUBLE AS score FROM documents)"


@query("e07_e10_ablation", _SC + ", p AS (SELECT page, max(score) FILTER (pipeline='v2_full') AS f, max(score) FILTER (pipeline='v2_no_gpt') AS g, max(score) FILTER (pipeline='v2_no_claude') AS c FROM s GROUP BY page) SELECT page, f AS v2_full, round(g-f,6) AS delta_no_gpt, round(c-f,6) AS delta_no_claude FROM p")
def e10(spark, sf):
    p = A.wide(scores(spark, sf), ["page"], "pipeline", K.PIPELINES, F.max("score"), fill=None)
    return p.select("page", "v2_full", r6(F.col("v2_no_gpt") - F.col("v2_full"), "delta_no_gpt"), r6(F.col("v2_no_claude") - F.col("v2_full"), "delta_no_claude"))


@query("g01_unified_scores", _SC + " SELECT pipeline, CASE WHEN pipeline='v2_full' THEN 'full' ELSE 'ablation' END AS tag, count(*) AS n, round(avg(score),6) AS mean_score FROM s GROUP BY ALL")
def g01(spark, sf):
    s = scores(spark, sf).withColumn("tag", F.when(F.col("pipeline") == "v2_full", "full").otherwise("ablation"))
    return s.groupBy("pipeline", "tag").agg(F.count("*").alias("n"), r6(F.avg("score"), "mean_score"))


@query("g04_g12_feature_weights", "WITH x AS (SELECT vec_id, unnest(generate_series(0,63)) AS i, unnest(embedding)::DOUBLE AS x, (vec_id*7919 % 1000)/1000.0::DOUBLE AS y FROM embeddings), r AS (SELECT i, corr(x, y) AS r FROM x GROUP BY i), k AS (SELECT * FROM r WHERE round(abs(r),9) >= 0.05) SELECT CAST(i AS INT) AS i, round(r,6) AS r, round(abs(r)/sum(abs(r)) OVER (),6) AS weight FROM k")
def g04(spark, sf):
    x = V.long_form(table(spark, sf, "embeddings"), "vec_id", "embedding").withColumn("y", (F.col("vec_id") * 7919) % 1000 / 1000.0)
    r = x.groupBy("i").agg(F.corr("x", "y").alias("r")).where(F.round(F.abs("r"), 9) >= 0.05).withColumn("a", F.abs("r"))
    return A.shares(r, [], weight="a").select("i", r6("r", "r"), r6("weight", "weight"))  # one row a dimension


@query("g05_euclidean_of_all", "WITH p AS (SELECT a.vec_id AS a, b.vec_id AS b, sqrt(list_sum(list_transform(generate_series(1,64), lambda i: pow(a.embedding[i]::DOUBLE-b.embedding[i]::DOUBLE,2)))) AS d FROM embeddings a JOIN embeddings b ON a.vec_id<>b.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(-d,9) DESC, b) AS rank FROM p) SELECT a, b, rank, round(d,6) AS distance FROM r WHERE rank <= 3")
def g05_all(spark, sf):
    n = G.nearest(table(spark, sf, "embeddings"), "vec_id", "embedding", 3, euclidean=True)
    return n.select("a", "b", "rank", r6(-F.col("similarity"), "distance"))


@query("g06_g08_decisions", _NEAR5 + _VOTE.format(label="CASE WHEN b % 3 = 0 THEN 'skip' ELSE 'keep' END") + ", d AS (SELECT CASE WHEN label='skip' AND confidence >= 0.6 THEN 'v2_no_gpt' ELSE 'v2_full' END AS pipeline FROM r WHERE rank = 1) SELECT pipeline, count(*) AS n, sum(CASE WHEN pipeline='v2_full' THEN 3 ELSE 2 END) AS calls FROM d GROUP BY 1")
def g06(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "embedding", F.when(F.col("vec_id") % 3 == 0, "skip").otherwise("keep").alias("label"))
    vote = G.weighted_vote(G.nearest(e, "vec_id", "embedding", 5), e.select(F.col("vec_id").alias("id"), "label"), "label")
    skipped = F.when((F.col("label") == "skip") & (F.col("confidence") >= 0.6), F.array(F.lit("gpt"))).otherwise(F.array().cast("array<string>"))
    chosen = vote.select("a", G.decision(skipped).alias("pipeline"))
    return chosen.groupBy("pipeline").agg(F.count("*").alias("n"), F.sum(G.calls(F.col("pipeline"))).alias("calls"))


_FIRST = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(t,'{w}')" for w in words) + f" THEN '{name}'" for name, words in P.CATEGORY_WORDS.items()) + " ELSE 'other' END"


@query("l01_l03_enrichment", f"SELECT {_FIRST} AS category, count(*) AS n FROM (SELECT lower(coalesce(text,'')) AS t FROM conversations) GROUP BY 1")
def l03(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("prompt"))
    r = P.replies(c, "prompt", P.stub)
    return r.select("conv_id", "turn", F.get_json_object(S.json_reply("reply"), "$.category").alias("category")).groupBy("category").agg(F.count("*").alias("n"))


_PERIOD = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(t,'{w}')" for w in words) + f" THEN '{name}'" for name, words in P.PERIOD_WORDS.items()) + " ELSE 'unclear' END"


@query("l03_rule_labels", f"WITH r AS (SELECT lower(coalesce(text,'')) AS t, turn % 4 = 0 AS head, conv_id % 3 AS h, turn % 3 AS s FROM conversations) SELECT CASE WHEN head THEN NULL WHEN h=0 THEN 'income' WHEN h=1 THEN 'expenditure' WHEN s=0 THEN 'income' WHEN s=1 THEN 'expenditure' ELSE 'unclear' END AS direction, CASE WHEN NOT head THEN {_FIRST} END AS category, CASE WHEN NOT head THEN {_PERIOD} END AS payment_period, CASE WHEN NOT head THEN contains(t,'arrear') END AS is_arrears, count(*) AS n FROM r GROUP BY ALL")
def l03_rules(spark, sf):
    pick = lambda values, at: F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))
    c = table(spark, sf, "conversations").select(F.col("text").alias("description"), F.when(F.col("turn") % 4 == 0, "header").otherwise("entry").alias("row_type"), pick(["Recepta", "Soluta", "Capitulum"], F.col("conv_id") % 3).alias("section_header"), pick(["left", "right", "both"], F.col("turn") % 3).alias("side"))
    return P.enriched(c).groupBy("direction", "category", "payment_period", "is_arrears").agg(F.count("*").alias("n"))


@query("l05_model_grid", "SELECT count(*) AS n, count(DISTINCT a || b) AS combinations FROM (SELECT page_id, unnest(['x','y','z']) AS a FROM pages), (VALUES ('p'),('q')) t(b)")
def l05(spark, sf):
    g = P.model_grid(a=["x", "y", "z"], b=["p", "q"])(table(spark, sf, "pages").select("page_id"))
    return g.agg(F.count("*").alias("n"), F.countDistinct(F.concat("a", "b")).alias("combinations"))


@query("o06_first_in_order", "SELECT event_type, arg_min(event_id, ts) AS first_id FROM events GROUP BY 1")
def o06(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(A.first_by("event_id", "ts", "event_id").alias("first_id"))


@query("o02_custom_order", "SELECT o_orderpriority, n, row_number() OVER (ORDER BY CASE o_orderpriority WHEN '5-LOW' THEN 0 ELSE 1 END, n DESC, o_orderpriority) AS rank FROM (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1)")
def o02(spark, sf):
    n = table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    w = Window.orderBy(F.when(F.col("o_orderpriority") == "5-LOW", 0).otherwise(1), F.desc("n"), "o_orderpriority")  # one row a priority
    return n.select("o_orderpriority", "n", F.row_number().over(w).alias("rank"))


@query("u04_distinct_pages", "SELECT count(*) AS n FROM (SELECT DISTINCT source, lang, md5(coalesce(text,'')) FROM documents)")
def u04(spark, sf):
    return docs(spark, sf).select("source", "lang", F.md5(F.coalesce("text", F.lit("")))).distinct().agg(F.count("*").alias("n"))


@query("w02_w07_daily", "WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS x FROM events GROUP BY 1) SELECT day, x AS n, round(CASE WHEN count(x) OVER w >= 3 THEN avg(x) OVER w END,6) AS rolling FROM d WINDOW w AS (ORDER BY day ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)")
def w02(spark, sf):
    d = table(spark, sf, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return d.select("day", "n", r6(W.rolling("n", 3, 3, 3, "day"), "rolling"))


