"""Text queries T1-T21, Q21-Q24, Q31-Q34 over documents; a bucket of ten ids stands for a decade, the site for a category."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import scalars as S
from ..functions.stopwords import english
from ..operators.fuzzy import similar_pairs
from ..operators import series as W
from ..operators import shares as A
from ..operators import text as T
from ..storage import stored
from .bindings import table
from .registry import query, r6

WORDS = ["the", "tion", "ment", "und", "que", "heit", "ciónmente", "zzz"]
DOCS = "WITH d AS (SELECT *, CAST(floor(doc_id / 100) * 10 + 1700 AS INT) AS decade, doc_id % 7 AS cat, lower(coalesce(text,'')) AS t FROM documents) "


def docs(spark, sf):
    return table(spark, sf, "documents").withColumn("decade", (F.lit(1700) + F.floor(F.col("doc_id") / 100) * 10).cast("int")).withColumn("cat", F.col("doc_id") % 7)


@query("t01_keyword_rates", DOCS + "SELECT decade, count(*) AS total, " + ", ".join(f"round(1000.0*count(*) FILTER (contains(t,'{w}'))/count(*),6) AS \"{w}\"" for w in WORDS) + " FROM d GROUP BY decade")
def t01(spark, sf):
    r = T.keyword_rates(docs(spark, sf), "decade", "text", WORDS)
    return r.select("decade", "total", *[r6(w, w) for w in WORDS])


@query("t02_first_appearance", DOCS + ", w AS (SELECT unnest(['the','tion','ment','und','que','heit','ciónmente','zzz']) AS term) SELECT term, (SELECT arg_min(doc_id, doc_id) FROM d WHERE contains(t, term)) AS doc_id, (SELECT arg_min(lang, doc_id) FROM d WHERE contains(t, term)) AS lang FROM w")
def t02(spark, sf):
    return T.first_appearance(docs(spark, sf), "text", WORDS, ["doc_id"], ["doc_id", "lang"])


@query("t04_bigrams", DOCS + f""", k AS (SELECT lang, regexp_extract_all(t,'[a-z]{{3,}}') AS w FROM d), b AS (SELECT lang, unnest(list_transform(generate_series(1, len(w)-1), lambda i: w[i] || ' ' || w[i+1])) AS bigram FROM k WHERE len(w) > 1)
SELECT lang, bigram, count(*) AS cnt FROM b WHERE bigram NOT IN ({', '.join(repr(x) for x in K.STOP_BIGRAMS)}) GROUP BY lang, bigram HAVING count(*) >= 5""")  # fmt: skip
def t04(spark, sf):
    return T.bigram_rows(docs(spark, sf), ["lang"], "text").groupBy("lang", "bigram").agg(F.count("*").alias("cnt")).where("cnt >= 5")


@query("t05_distinctive_bigrams", DOCS + f""", k AS (SELECT lang, regexp_extract_all(t,'[a-z]{{3,}}') AS w FROM d), b AS (SELECT lang, unnest(list_transform(generate_series(1, len(w)-1), lambda i: w[i] || ' ' || w[i+1])) AS bigram FROM k WHERE len(w) > 1),
c AS (SELECT lang, bigram, count(*) AS cnt FROM b WHERE bigram NOT IN ({', '.join(repr(x) for x in K.STOP_BIGRAMS)}) GROUP BY ALL),
g AS (SELECT *, sum(cnt) OVER (PARTITION BY bigram) nt, sum(cnt) OVER (PARTITION BY lang) ng, sum(cnt) OVER () na FROM c), l AS (SELECT *, (cnt/ng)/((nt-cnt+1)/(na-ng+1)) AS lift FROM g WHERE cnt >= 5),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY round(lift,9) DESC, bigram) AS rank FROM l) SELECT lang, bigram, cnt, round(lift,6) AS lift, rank FROM r WHERE rank <= 25""")  # fmt: skip
def t05(spark, sf):
    c = T.bigram_rows(docs(spark, sf), ["lang"], "text").groupBy("lang", "bigram").agg(F.count("*").alias("cnt"))
    return T.distinctive(c, "lang", "bigram").select("lang", "bigram", "cnt", r6("lift", "lift"), "rank")


@query("t06_signatures", DOCS + """, w AS (SELECT DISTINCT doc_id, cat, lang, unnest(regexp_extract_all(t,'[a-z]{4,}')) AS term FROM d), n AS (SELECT cat, count(*) AS nc FROM d GROUP BY cat), c AS (SELECT cat, term, count(*) AS df FROM w GROUP BY ALL), a AS (SELECT term, count(*) AS dfa FROM w GROUP BY term),
s AS (SELECT c.cat, c.term, df, log2((df/nc)/(dfa/(SELECT count(*) FROM d))) AS score FROM c JOIN n USING (cat) JOIN a USING (term) WHERE df >= 3 AND nc >= 5), r AS (SELECT *, row_number() OVER (PARTITION BY cat ORDER BY round(score,9) DESC, term) AS rank FROM s) SELECT cat, term, df, round(score,6) AS score, rank FROM r WHERE rank <= 10""")  # fmt: skip
def t06(spark, sf):
    d = docs(spark, sf)
    w = d.select("cat", F.explode(F.array_distinct(T.tokens("text", 4))).alias("term")).groupBy("cat", "term").agg(F.count("*").alias("df"))
    n = d.groupBy("cat").agg(F.count("*").alias("nc")).withColumn("na", F.sum("nc").over(Window.partitionBy()))  # one row a category
    w = w.withColumn("dfa", F.sum("df").over(Window.partitionBy("term"))).join(F.broadcast(n), "cat").where("df >= 3 and nc >= 5")
    s = w.withColumn("score", F.log2((F.col("df") / F.col("nc")) / (F.col("dfa") / F.col("na"))))
    return A.top(s, ["cat"], 10, F.desc(F.round("score", 9)), F.asc("term")).select("cat", "term", "df", r6("score", "score"), "rank")


@query("t07_calendar_language", DOCS + "SELECT decade, count(*) AS total, round(1000.0*sum((contains(t,'tion'))::INT+(contains(t,'ment'))::INT)/count(*),6) AS first_rate, round(1000.0*sum((contains(t,'heit'))::INT+(contains(t,'und'))::INT)/count(*),6) AS second_rate FROM d GROUP BY decade")
def t07(spark, sf):
    c = T.keyword_counts(docs(spark, sf), "decade", "text", ["tion", "ment", "heit", "und"])
    return c.select("decade", "total", r6(S.ratio((F.col("tion") + F.col("ment")) * 1000, F.col("total")), "first_rate"), r6(S.ratio((F.col("heit") + F.col("und")) * 1000, F.col("total")), "second_rate"))


@query("t08_complexity", DOCS + """SELECT decade, count(*) AS total_entries, round(avg(n),6) AS avg_words, round(median(n),6) AS median_words, round(avg(p::INT),6) AS personal_rate FROM (SELECT decade, len(list_filter(regexp_split_to_array(coalesce(text,''),'\\s+'), lambda x: x <> '')) AS n, regexp_matches(coalesce(text,''),'(?i)(^|[^\\p{L}\\p{N}_])(the|le|der)([^\\p{L}\\p{N}_]|$)') AS p FROM d) GROUP BY decade""")
def t08(spark, sf):
    c = T.complexity(docs(spark, sf), "decade", "text", {"personal_rate": F.coalesce("text", F.lit("")).rlike(r"(?i)\b(the|le|der)\b")})
    return c.select("decade", "total_entries", r6("avg_words", "avg_words"), r6("median_words", "median_words"), r6("personal_rate", "personal_rate"))


@query("t09_active_types", DOCS + ", c AS (SELECT decade, " + ", ".join(f"count(*) FILTER (contains(t,'{w}')) AS \"{w}\"" for w in WORDS) + " FROM d GROUP BY decade) SELECT decade, " + "+".join(f'("{w}">0)::INT' for w in WORDS) + " AS distinct_types FROM c")
def t09(spark, sf):
    c = T.keyword_counts(docs(spark, sf), "decade", "text", WORDS)
    return c.select("decade", sum(((F.col(w) > 0).cast("int") for w in WORDS), F.lit(0)).alias("distinct_types"))


_PERSON, _TRADE, _HOUSE = (r"(^|[^\p{L}\p{N}_])(" + x + r")([^\p{L}\p{N}_]|$)" for x in ("the|le", "tion|est", "de|la"))


@query("t10_payee_types", DOCS + f", f AS (SELECT decade, CAST(cat AS VARCHAR) AS category, regexp_matches(t,'{_PERSON}') AS p, regexp_matches(t,'{_TRADE}') AS q, regexp_matches(t,'{_HOUSE}') AS r FROM d), g AS (SELECT decade, category, p, q, r FROM f WHERE category IN ('0','1','2','9') UNION ALL SELECT decade, 'all', p, q, r FROM f), k AS (SELECT decade, category FROM (SELECT DISTINCT decade FROM f), (VALUES ('0'),('1'),('2'),('9'),('all')) c(category)) SELECT decade, category, count(p) AS n, round(100*avg(p::INT),6) AS personal_rate, round(100*avg((p AND q)::INT),6) AS trade_rate, round(100*avg(r::INT),6) AS institutional_rate FROM k LEFT JOIN g USING (decade, category) GROUP BY ALL")
def t10(spark, sf):
    t = F.lower(F.coalesce("text", F.lit("")))
    kinds = {"personal_rate": t.rlike(_PERSON), "trade_rate": t.rlike(_PERSON) & t.rlike(_TRADE), "institutional_rate": t.rlike(_HOUSE)}
    return T.payee_types(docs(spark, sf), "decade", "cat", [0, 1, 2, 9], kinds).select("decade", "category", "n", *[r6(k, k) for k in kinds])


@query("t11_category_rates", DOCS + "SELECT decade, count(*) AS total, " + ", ".join(f"round(1000.0*count(*) FILTER (contains(t,'{w}'))/count(*),6) AS \"{w}\"" for w in WORDS) + " FROM d WHERE cat = 3 GROUP BY decade")
def t11(spark, sf):
    c = T.keyword_rates(docs(spark, sf).where("cat = 3"), "decade", "text", WORDS)
    return c.select("decade", "total", *[r6(F.col(w), w) for w in WORDS])


STOPS = sorted({*english(), *K.LEDGER_STOPS})
_STOPS = ", ".join(repr(x) for x in STOPS)
#: Whole words without stop words, as SQL over t; of a-z only, or any.
_LATIN = f"list_filter(regexp_extract_all(t,'[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda x: regexp_full_match(x,'[a-z]+') AND x NOT IN ({_STOPS}))"
_ANY = f"list_filter(regexp_extract_all(t,'[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda x: x NOT IN ({_STOPS}))"
_BOTH = "list_concat(w, list_transform(generate_series(1, len(w)-1), lambda i: w[i] || ' ' || w[i+1]))"


@query("t12_top_words", DOCS + f""", w AS (SELECT DISTINCT doc_id, decade, unnest(list_filter(regexp_extract_all(t,'[a-z]{{5,}}'), lambda x: x NOT IN ({_STOPS}))) AS term FROM d), v AS (SELECT term FROM w GROUP BY term ORDER BY count(*) DESC, term LIMIT 40), n AS (SELECT decade, count(*) AS n FROM d GROUP BY decade)
SELECT n.decade, v.term, round(1000.0*count(w.doc_id)/any_value(n),6) AS rate FROM v CROSS JOIN n LEFT JOIN w ON w.term = v.term AND w.decade = n.decade GROUP BY n.decade, v.term""")  # fmt: skip
def t12(spark, sf):
    d = docs(spark, sf)
    c = stored(d.select("decade", F.explode(F.array_distinct(T.tokens("text", 5, STOPS))).alias("term")).groupBy("decade", "term").agg(F.count("*").alias("k")), "words")
    v = c.groupBy("term").agg(F.sum("k").alias("s")).orderBy(F.desc("s"), "term").limit(40).select("term")
    n = d.groupBy("decade").agg(F.count("*").alias("n"))
    terms = v.agg(F.collect_list("term").alias("terms"))  # one row of forty terms
    grid = n.crossJoin(F.broadcast(terms)).select("decade", "n", F.explode("terms").alias("term")).join(c, ["decade", "term"], "left")
    return grid.select("decade", "term", r6(F.coalesce("k", F.lit(0)) * 1000.0 / F.col("n"), "rate"))


@query("t16_token_patterns", DOCS + f""", w AS (SELECT 'latin' AS pattern, lang, unnest({_LATIN}) AS term FROM d UNION ALL SELECT 'any', lang, unnest({_ANY}) FROM d) SELECT pattern, lang, count(*) AS n, count(DISTINCT term) AS n_terms, min(term) AS first_term FROM w GROUP BY ALL""")
def t16(spark, sf):
    d = docs(spark, sf)
    both = [d.select(F.lit(k).alias("pattern"), "lang", F.explode(T.words("text", k == "latin", STOPS)).alias("term")) for k in ("latin", "any")]
    return both[0].unionByName(both[1]).groupBy("pattern", "lang").agg(F.count("*").alias("n"), F.countDistinct("term").alias("n_terms"), F.min("term").alias("first_term"))


@query("t17_stop_words", DOCS + f"SELECT lang, sum(len(list_filter(regexp_extract_all(t,'[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda x: x IN ({_STOPS})))) AS n_stops, {len(STOPS)} AS n_list FROM d GROUP BY lang")
def t17(spark, sf):
    n = F.size(T.words("text")) - F.size(T.words("text", stops=STOPS))
    return docs(spark, sf).groupBy("lang").agg(F.sum(n).alias("n_stops"), F.lit(len(STOPS)).alias("n_list"))


_TF = DOCS + f""", k AS (SELECT doc_id, lang, list_filter(regexp_extract_all(t,'[a-z]{{2,}}'), lambda x: x NOT IN ({', '.join(repr(x) for x in K.LEDGER_STOPS)})) AS w FROM d WHERE doc_id < 1000000000),
tf AS (SELECT lang, term, count(*) AS tf FROM (SELECT lang, unnest({_BOTH}) AS term FROM k) GROUP BY ALL)"""  # fmt: skip
_TF_LATIN = DOCS + f", k AS (SELECT doc_id, lang, {_LATIN} AS w FROM d), tf AS (SELECT lang, term, count(*) AS tf FROM (SELECT lang, unnest({_BOTH}) AS term FROM k) GROUP BY ALL)"


def _tf(spark, sf):
    """Words of a-z and pairs of them, without stop words."""
    return stored(T.term_counts(docs(spark, sf), "lang", "text", pairs=True, found=T.words("text", True, STOPS)), "tf")


def _era_terms(size: int, top: int) -> str:
    return _TF_LATIN + f""", v AS (SELECT term FROM tf GROUP BY term HAVING count(*) >= 2 ORDER BY sum(tf) DESC, term LIMIT {size}), f AS (SELECT lang, term, tf/sum(tf) OVER (PARTITION BY lang) AS relative_freq FROM tf JOIN v USING (term)),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY round(relative_freq,9) DESC, term) AS rank FROM f) SELECT lang, rank, term, round(relative_freq,6) AS relative_freq FROM r WHERE rank <= {top}"""


def _era_top(spark, sf, size: int, top: int):
    tf = _tf(spark, sf)
    v = T.vocabulary(tf, 2, size).select("term")
    f = A.shares(tf.join(F.broadcast(v), "term"), ["lang"], relative_freq="tf")  # at most size terms
    return A.top(f, ["lang"], top, F.desc(F.round("relative_freq", 9)), F.asc("term")).select("lang", "rank", "term", r6("relative_freq", "relative_freq"))


@query("t13_relative_frequency", _era_terms(5000, 30))
def t13(spark, sf):
    return _era_top(spark, sf, 5000, 30)


@query("t13_relative_frequency_3000", _era_terms(3000, 40))
def t13_small(spark, sf):
    return _era_top(spark, sf, 3000, 40)


@query("t14_emerging_terms", _TF_LATIN + """, v AS (SELECT term FROM tf GROUP BY term HAVING count(*) >= 2 ORDER BY sum(tf) DESC, term LIMIT 5000), f AS (SELECT lang, term, tf/sum(tf) OVER (PARTITION BY lang) AS x FROM tf JOIN v USING (term)), p AS (SELECT term, coalesce(sum(x) FILTER (lang='en'),0) AS en, coalesce(sum(x) FILTER (lang='fr'),0) AS fr, coalesce(sum(x) FILTER (lang='de'),0) AS de FROM f GROUP BY term)
(SELECT term, 'fr_vs_en' AS change, round(en,6) AS en, round(fr,6) AS fr, round(de,6) AS de FROM p ORDER BY round(p.fr-p.en,9) DESC, term LIMIT 80) UNION ALL (SELECT term, 'de_vs_en', round(en,6), round(fr,6), round(de,6) FROM p ORDER BY round(p.de-p.en,9) DESC, term LIMIT 80)""")  # fmt: skip
def t14(spark, sf):
    tf = _tf(spark, sf)
    f = A.shares(tf.join(F.broadcast(T.vocabulary(tf, 2, 5000).select("term")), "term"), ["lang"], x="tf")
    p = stored(A.wide(f, ["term"], "lang", ["en", "fr", "de"], F.sum("x")), "emerging")  # at most 5,000 terms
    a, b = (p.orderBy(F.desc(F.round(F.col(k) - F.col("en"), 9)), "term").limit(80).withColumn("change", F.lit(f"{k}_vs_en")) for k in ("fr", "de"))
    return a.unionByName(b).select("term", "change", r6("en", "en"), r6("fr", "fr"), r6("de", "de"))


_TFIDF = _TF_LATIN + """, n AS (SELECT count(DISTINCT lang) AS n FROM tf), v AS (SELECT term, ln((1+n)/(1+count(*)))+1 AS idf FROM tf, n GROUP BY term, n HAVING count(*) >= 1 ORDER BY sum(tf) DESC, term LIMIT 5000), w0 AS (SELECT lang, term, tf*idf AS w FROM tf JOIN v USING (term)), w AS (SELECT lang, term, w/sqrt(sum(w*w) OVER (PARTITION BY lang)) AS w FROM w0)"""


def _tfidf(spark, sf):
    counts = T.term_counts(docs(spark, sf), "lang", "text", pairs=True, found=T.words("text", True, STOPS))
    return T.tfidf(counts, "lang", size=5000)


@query("t15_tfidf", _TFIDF + " SELECT lang, term, round(w,6) AS w FROM w")
def t15(spark, sf):
    return _tfidf(spark, sf).select("lang", "term", r6("w", "w"))


@query("t18_top_terms", _TFIDF + ", r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY round(w,9) DESC, term) AS rank FROM w WHERE w > 0) SELECT lang, rank, term, round(w,6) AS w FROM r WHERE rank <= 15")
def t18(spark, sf):
    return A.top(_tfidf(spark, sf).where("w > 0"), ["lang"], 15, F.desc(F.round("w", 9)), F.asc("term")).select("lang", "rank", "term", r6("w", "w"))


@query("m08_similarity", _TFIDF + " SELECT a.lang AS a, b.lang AS b, round(sum(a.w*b.w),6) AS similarity FROM w a JOIN w b ON a.term=b.term AND a.lang<b.lang GROUP BY ALL")
def m08(spark, sf):
    return T.cosine(_tfidf(spark, sf), "lang").select("a", "b", r6("similarity", "similarity"))


_SIMILAR = "WITH c AS (SELECT coalesce(text,'') AS text, min(doc_id) AS class_id FROM documents GROUP BY 1), k AS (SELECT class_id, list_filter(regexp_extract_all(lower(text),'[a-z]{2,}'), lambda x: x NOT IN (" + ", ".join(repr(x) for x in K.LEDGER_STOPS) + """)) AS w FROM c),
tf AS (SELECT class_id, term, count(*) AS tf FROM (SELECT class_id, unnest(w) AS term FROM k) GROUP BY ALL), n AS (SELECT count(DISTINCT class_id) AS n FROM tf), v AS (SELECT term, ln((1+any_value(n))/(1+count(*)))+1 AS idf FROM tf, n GROUP BY term),
w0 AS (SELECT class_id, term, tf*idf AS w FROM tf JOIN v USING (term)), w AS (SELECT class_id, term, w/sqrt(sum(w*w) OVER (PARTITION BY class_id)) AS w FROM w0),
s AS (SELECT a.class_id AS a, b.class_id AS b, sum(a.w*b.w) AS x FROM w a JOIN w b ON a.term=b.term AND a.class_id<>b.class_id GROUP BY ALL HAVING round(sum(a.w*b.w),9) >= 0.8), l AS (SELECT a, count(*) AS n_links, round(max(x),6) AS most FROM s GROUP BY a)
SELECT doc_id, class_id, coalesce(n_links,0) AS n_links, most FROM documents JOIN c ON coalesce(documents.text,'')=c.text LEFT JOIN l ON a=class_id"""


@query("m08_similar_documents", _SIMILAR)
def m08_similar(spark, sf):
    """Every document with the least id of its text and the number of other texts with a cosine of at least 0.8."""
    d = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    classes = stored(d.withColumn("key", F.sha2("text", 256)).groupBy("key").agg(F.min("doc_id").alias("class_id"), F.any_value("text").alias("text")), "classes")
    pairs = stored(T.similar(T.tfidf(T.term_counts(classes, "class_id", "text", 2, K.LEDGER_STOPS), "class_id"), "class_id", 0.8), "pairs")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity"))
    links = both.groupBy(F.col("a").alias("class_id")).agg(F.count("*").alias("n_links"), F.max("similarity").alias("most"))
    ids = classes.select("key", "class_id").join(links, "class_id", "left")
    out = d.select("doc_id", F.sha2("text", 256).alias("key")).join(ids, "key")
    return out.select("doc_id", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), r6("most", "most"))


@query("t19_direction_contrast", DOCS + f""", b AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'income' ELSE 'expenditure' END AS side, lang AS scope, {_ANY} AS w FROM d WHERE doc_id % 3 < 2),
x AS (SELECT doc_id, side, scope, term, count(*) AS tf FROM (SELECT doc_id, side, scope, unnest({_BOTH}) AS term FROM b) GROUP BY ALL), v AS (SELECT term FROM x GROUP BY term HAVING count(*) >= 5 ORDER BY sum(tf) DESC, term LIMIT 6000),
s AS (SELECT scope FROM b WHERE scope IS NOT NULL GROUP BY scope HAVING count(*) >= 50 AND count(DISTINCT side) = 2), y AS (SELECT x.scope, side, term, tf FROM x JOIN s ON x.scope = s.scope UNION ALL SELECT 'overall', side, term, tf FROM x),
g AS (SELECT scope, term FROM (SELECT scope FROM s UNION ALL SELECT 'overall') , v), c AS (SELECT g.scope, g.term, coalesce(sum(tf) FILTER (side='income'),0) AS a, coalesce(sum(tf) FILTER (side='expenditure'),0) AS b FROM g LEFT JOIN y ON g.scope=y.scope AND g.term=y.term GROUP BY ALL)
SELECT scope, term, CAST(a AS BIGINT) AS n_first, CAST(b AS BIGINT) AS n_second, round(ln(((a+0.5)/(sum(a) OVER k + 0.5*count(*) OVER k))/((b+0.5)/(sum(b) OVER k + 0.5*count(*) OVER k))),6) AS log_odds FROM c WINDOW k AS (PARTITION BY scope)""")  # fmt: skip
def t19(spark, sf):
    d = docs(spark, sf).withColumn("side", F.when(F.col("doc_id") % 3 == 0, "income").when(F.col("doc_id") % 3 == 1, "expenditure"))
    o = T.contrast(d, "side", ("income", "expenditure"), "lang", T.words("text", stops=STOPS))
    return o.select("scope", "term", "n_first", "n_second", r6("log_odds", "log_odds"))


@query("t19_log_odds", _TF + """, p AS (SELECT term, coalesce(sum(tf) FILTER (lang='en'),0)::DOUBLE AS a, coalesce(sum(tf) FILTER (lang='fr'),0)::DOUBLE AS b FROM tf WHERE lang IN ('en','fr') GROUP BY term), s AS (SELECT sum(a) sa, sum(b) sb, count(*) v FROM p),
o AS (SELECT term, a, b, ln((a+0.5)/(sa-a+0.5*v)) - ln((b+0.5)/(sb-b+0.5*v)) AS lo FROM p, s) (SELECT term, CAST(a AS BIGINT) AS n_first, CAST(b AS BIGINT) AS n_second, round(lo,6) AS log_odds FROM o ORDER BY round(lo,9) DESC, term LIMIT 50)""")  # fmt: skip
def t19_odds(spark, sf):
    tf = T.term_counts(docs(spark, sf).where("lang in ('en', 'fr')"), "lang", "text", 2, K.LEDGER_STOPS, pairs=True)
    o = T.log_odds(tf, "lang", ("en", "fr"))
    return o.orderBy(F.desc(F.round("log_odds", 9)), "term").limit(50).select("term", "n_first", "n_second", r6("log_odds", "log_odds"))


@query("t20_recurring", "WITH h AS (SELECT trim(regexp_replace(regexp_replace(lower(coalesce(text,'')),'[^a-z0-9\\s]',' ','g'),'\\s+',' ','g')) AS norm, doc_id, text FROM documents) SELECT norm, count(*) AS n, count(DISTINCT doc_id % 50) AS n_years, min(doc_id) AS first_id, max(doc_id) AS last_id, arg_min(text, doc_id) AS sample FROM h GROUP BY norm HAVING count(*) >= 2")
def t20(spark, sf):
    h = table(spark, sf, "documents").withColumn("norm", S.normal_text("text"))
    g = h.groupBy("norm").agg(F.count("*").alias("n"), F.countDistinct(F.col("doc_id") % 50).alias("n_years"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.min_by("text", "doc_id").alias("sample"))
    return g.where("n >= 2")


@query("t21_levenshtein", "WITH p AS (SELECT DISTINCT p_name FROM part), q AS (SELECT a.p_name AS a, b.p_name AS b FROM p a JOIN p b ON split_part(a.p_name,' ',1)=split_part(b.p_name,' ',1) AND a.p_name<b.p_name) SELECT a, b, levenshtein(a,b) AS distance, round(1-2.0*levenshtein(a,b)/(length(a)+length(b)),6) AS lev_ratio FROM q")
def t21(spark, sf):
    p = table(spark, sf, "part").select("p_name", F.split("p_name", " ")[0].alias("k")).distinct()
    q = p.select(F.col("p_name").alias("a"), "k").join(p.select(F.col("p_name").alias("b"), "k"), "k").where("a < b")
    return q.select("a", "b", F.levenshtein("a", "b").alias("distance"), r6(S.lev_ratio("a", "b"), "lev_ratio"))


@query("t21_similar_names", "WITH p AS (SELECT DISTINCT p_name FROM part) SELECT a.p_name AS a, b.p_name AS b, levenshtein(a.p_name,b.p_name) AS distance, round(1-2.0*levenshtein(a.p_name,b.p_name)/(length(a.p_name)+length(b.p_name)),6) AS lev_ratio FROM p a JOIN p b ON a.p_name<b.p_name AND abs(length(a.p_name)-length(b.p_name))<=3 AND levenshtein(a.p_name,b.p_name)<=3")
def t21_similar(spark, sf):
    """Names within three edits of one another, among all names."""
    q = similar_pairs(table(spark, sf, "part"), "p_name", 3)
    return q.select("a", "b", "distance", r6(S.lev_ratio("a", "b"), "lev_ratio"))


@query("q21_innovation_emergence", DOCS + """, y AS (SELECT decade, 1000.0*count(*) FILTER (contains(t,'heit'))/count(*) AS x FROM d GROUP BY decade), r AS (SELECT *, CASE WHEN count(x) OVER w >= 3 THEN avg(x) OVER w END AS roll FROM y WINDOW w AS (ORDER BY decade ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
b AS (SELECT avg(x) + 0.5*stddev_samp(x) AS th FROM y WHERE decade < 1760) SELECT min(decade) FILTER (roll > th) AS emergence, round(any_value(th),6) AS threshold FROM r, b""")  # fmt: skip
def q21(spark, sf):
    y = T.keyword_rates(docs(spark, sf), "decade", "text", ["heit"]).withColumn("roll", W.rolling("heit", 2, 2, 3, "decade"))
    early = F.when(F.col("decade") < 1760, F.col("heit"))
    w = Window.partitionBy()  # one row a decade
    y = y.withColumn("th", F.avg(early).over(w) + 0.5 * F.stddev_samp(early).over(w))
    return y.agg(F.min(F.when(F.col("roll") > F.col("th"), F.col("decade"))).alias("emergence"), r6(F.any_value("th"), "threshold"))


@query("q22_heat_map", DOCS + ", g AS (SELECT lang, decade, avg(contains(t,'ment')::INT) AS x FROM d GROUP BY ALL) SELECT lang, decade, round(x/nullif(max(x) OVER (PARTITION BY lang),0),6) AS heat FROM g")
def q22(spark, sf):
    g = docs(spark, sf).groupBy("lang", "decade").agg(F.avg(F.lower(F.coalesce("text", F.lit(""))).contains("ment").cast("double")).alias("x"))
    return g.select("lang", "decade", r6(S.ratio(F.col("x"), F.max("x").over(Window.partitionBy("lang"))), "heat"))


@query("q23_trajectory", DOCS + "SELECT decade, round(sum(regexp_matches(t,'tion|heit')::INT)::DOUBLE/count(*),6) AS scholarship, round(sum(regexp_matches(t,'(^|[^\\p{L}\\p{N}_])que([^\\p{L}\\p{N}_]|$)')::INT)::DOUBLE/count(*),6) AS prize FROM d GROUP BY decade")
def q23(spark, sf):
    t = F.lower(F.coalesce("text", F.lit("")))
    return docs(spark, sf).groupBy("decade").agg(r6(F.avg(t.rlike("tion|heit").cast("double")), "scholarship"), r6(F.avg(t.rlike(r"\bque\b").cast("double")), "prize"))


_HEAD = DOCS + ", h AS (SELECT decade, trim(string_split(t, chr(10))[1]) AS head FROM d), f AS (SELECT head, min(decade) AS first FROM h WHERE head <> '' GROUP BY head), n AS (SELECT first AS decade, count(*) AS n_new FROM f GROUP BY first), u AS (SELECT decade, count(DISTINCT head) AS n_unique, count(*) AS n_rows FROM h WHERE head <> '' GROUP BY decade)"


@query("q24_header_diversity", _HEAD + " SELECT u.decade, n_rows, n_unique, coalesce(n_new,0) AS n_new, CAST(sum(coalesce(n_new,0)) OVER (ORDER BY u.decade) AS BIGINT) AS cumulative, round(n_unique/n_rows,6) AS diversity FROM u LEFT JOIN n ON u.decade=n.decade")
def q24(spark, sf):
    h = docs(spark, sf).select("decade", F.trim(F.split(F.lower(F.coalesce("text", F.lit(""))), "\n")[0]).alias("head")).where("head <> ''")
    u = h.groupBy("decade").agg(F.count("*").alias("n_rows"), F.countDistinct("head").alias("n_unique"))
    n = h.groupBy("head").agg(F.min("decade").alias("decade")).groupBy("decade").agg(F.count("*").alias("n_new"))
    j = u.join(n, "decade", "left").fillna(0, ["n_new"])
    return j.select("decade", "n_rows", "n_unique", "n_new", W.running("n_new", "decade").alias("cumulative"), r6(S.ratio("n_unique", "n_rows"), "diversity"))


_DRIFT = DOCS + """, k AS (SELECT lang, doc_id % 5 AS step, unnest(regexp_extract_all(t,'[a-z]{2,}')) AS term FROM d), tf AS (SELECT lang, step, term, count(*) AS tf FROM k GROUP BY ALL), v AS (SELECT lang, term, ln((1+5)/(1+count(*)))+1 AS idf FROM tf GROUP BY lang, term), w0 AS (SELECT lang, step, term, tf*idf AS w FROM tf JOIN v USING (lang, term)),
w AS (SELECT lang, step, term, w/sqrt(sum(w*w) OVER (PARTITION BY lang, step)) AS w FROM w0), s AS (SELECT a.lang, a.step AS a, b.step AS b, sum(a.w*b.w) AS sim FROM w a JOIN w b ON a.lang=b.lang AND a.term=b.term AND a.step<b.step GROUP BY ALL)"""  # fmt: skip


@query("m09_category_drift", _DRIFT + " SELECT lang, round(avg(sim),6) AS mean_pairwise_sim, round(min(sim),6) AS min_pairwise_sim, round(avg(sim) FILTER (b=a+1),6) AS mean_consecutive FROM s GROUP BY lang")
def m09(spark, sf):
    d = docs(spark, sf).withColumn("step", F.col("doc_id") % 5)
    tf = stored(T.term_counts(d, ["lang", "step"], "text", 2), "tf")
    idf = tf.groupBy("lang", "term").agg((F.log(6 / (1 + F.count("*"))) + 1).alias("idf"))
    w = stored(tf.join(idf, ["lang", "term"]).select("lang", "step", "term", (F.col("tf") * F.col("idf")).alias("w")), "weights")
    # squares are summed map side, one row a language and step
    norm = w.groupBy("lang", "step").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    w = w.join(norm, ["lang", "step"]).select("lang", "step", "term", (F.col("w") / F.col("norm")).alias("w"))
    a, b = w.select("lang", "term", F.col("step").alias("a"), F.col("w").alias("x")), w.select("lang", "term", F.col("step").alias("b"), F.col("w").alias("y"))
    s = a.join(b, ["lang", "term"]).where("a < b").groupBy("lang", "a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("sim"))  # five steps a language
    return s.groupBy("lang").agg(r6(F.avg("sim"), "mean_pairwise_sim"), r6(F.min("sim"), "min_pairwise_sim"), r6(F.avg(F.when(F.col("b") == F.col("a") + 1, F.col("sim"))), "mean_consecutive"))
