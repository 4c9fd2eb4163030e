"""Vectors and routing (J14, M2, M8, M14, G3-G11), evaluation (E1-E11) and reliability."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reliability as R
from ..operators import routing as G
from ..operators import scoring as E
from ..operators import vectors as V
from .aggregate_queries import scores
from .bindings import ENTRIES, entries, rows, table
from .registry import query, r6


@query("j14_nearest_of_all", "WITH p AS (SELECT a.vec_id AS a, b.vec_id AS b, list_sum(list_transform(generate_series(1,64), lambda i: a.embedding[i]::DOUBLE*b.embedding[i]::DOUBLE)) AS s FROM embeddings a JOIN embeddings b ON a.vec_id<>b.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(s,9) DESC, b) AS rank FROM p) SELECT a, b, rank, round(s,6) AS similarity FROM r WHERE rank <= 5")
def j14_all(spark, sf):
    n = G.nearest(table(spark, sf, "embeddings"), "vec_id", "embedding", 5)
    return n.select("a", "b", "rank", r6("similarity", "similarity"))


_NEAR5 = "WITH p AS (SELECT a.vec_id AS a, b.vec_id AS b, b.label AS lb, list_sum(list_transform(generate_series(1,64), lambda i: a.embedding[i]::DOUBLE*b.embedding[i]::DOUBLE)) AS s FROM embeddings a JOIN embeddings b ON a.vec_id<>b.vec_id), near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(s,9) DESC, b) AS rank FROM p) WHERE rank <= 5)"
_VOTE = ", v AS (SELECT a, {label} AS label, sum(greatest(s,0)) AS w FROM near GROUP BY ALL), c AS (SELECT a, label, coalesce(w/nullif(sum(w) OVER (PARTITION BY a),0),0) AS confidence FROM v), r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(confidence,9) DESC, label) AS rank FROM c)"


@query("g07_weighted_vote", _NEAR5 + _VOTE.format(label="lb") + " SELECT a AS vec_id, label, round(confidence,6) AS confidence FROM r WHERE rank = 1")
def g07(spark, sf):
    e = table(spark, sf, "embeddings")
    near = G.nearest(e, "vec_id", "embedding", 5)
    return G.weighted_vote(near, e.select(F.col("vec_id").alias("id"), "label"), "label").select(F.col("a").alias("vec_id"), "label", r6("confidence", "confidence"))


@query("m02_standardised", "WITH x AS (SELECT vec_id, unnest(generate_series(0,63)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), s AS (SELECT *, avg(x) OVER (PARTITION BY i) AS m, stddev_pop(x) OVER (PARTITION BY i) AS d FROM x) SELECT vec_id, CAST(i AS INT) AS i, round((x-m)/d,6) AS z FROM s")
def m02(spark, sf):
    return V.standardised(table(spark, sf, "embeddings"), "vec_id", "embedding").select("vec_id", "i", r6("z", "z"))


@query("m14_outliers", "WITH x AS (SELECT vec_id, unnest(generate_series(0,63)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), s AS (SELECT *, (x-avg(x) OVER (PARTITION BY i))/stddev_pop(x) OVER (PARTITION BY i) AS z FROM x), d AS (SELECT vec_id, sqrt(sum(z*z)) AS distance FROM s GROUP BY 1) SELECT vec_id, round(distance,6) AS distance, distance > (SELECT quantile_cont(distance,0.95) FROM d) AS outlier FROM d")
def m14(spark, sf):
    return V.outliers(table(spark, sf, "embeddings"), "vec_id", "embedding").select("vec_id", r6("distance", "distance"), "outlier")


_SC = "WITH s AS (SELECT doc_id AS page, unnest(['v2_no_gemini','v2_no_claude','v2_no_gpt','v2_full']) AS pipeline, unnest([(doc_id*7919 % 1000)/1000.0,(doc_id*104729 % 1000)/1000.0,(doc_id*1299709 % 1000)/1000.0,(doc_id*15485863 % 1000)/1000.0])::DOUBLE AS score FROM documents), f AS (SELECT page, score AS full_score FROM s WHERE pipeline='v2_full')"


@query("g03_skip_labels", _SC + " SELECT page, pipeline, CAST(round(full_score-score,9) <= 0.03 AS INT) AS skip FROM s JOIN f USING (page) WHERE pipeline <> 'v2_full'")
def g03(spark, sf):
    return G.skip_labels(scores(spark, sf), 0.03)


@query("g09_g10_sweep", _SC + """, t AS (SELECT unnest([0.01,0.03,0.05])::DOUBLE AS threshold), k AS (SELECT threshold, s.page, list(pipeline ORDER BY pipeline) FILTER (round(full_score-score,9) <= threshold AND pipeline <> 'v2_full') AS skipped FROM s JOIN f USING (page), t GROUP BY ALL),
c AS (SELECT threshold, page, CASE WHEN len(skipped)=1 THEN skipped[1] ELSE 'v2_full' END AS pipeline FROM k), e AS (SELECT c.threshold, c.page, s.score, f.full_score, CASE WHEN c.pipeline='v2_full' THEN 3 ELSE 2 END AS n FROM c JOIN s ON c.page=s.page AND c.pipeline=s.pipeline JOIN f ON c.page=f.page)
SELECT threshold, round(avg(score)/avg(full_score),6) AS preservation, round(1-avg(n)/3,6) AS cost_reduction, round(min(score),6) AS min_score, count(*) FILTER (score < 0.9*full_score) AS failures FROM e GROUP BY threshold""")  # fmt: skip
def g10(spark, sf):
    s = scores(spark, sf)
    wide = s.groupBy("page").agg(F.map_from_entries(F.collect_list(F.struct("pipeline", "score"))).alias("m"))  # four pipelines a page
    wide = wide.withColumn("full_score", F.element_at("m", "v2_full")).withColumn("threshold", F.explode(F.array(*map(F.lit, [0.01, 0.03, 0.05]))))
    skipped = F.filter(F.array(*map(F.lit, ["v2_no_claude", "v2_no_gemini", "v2_no_gpt"])), lambda p: F.round(F.col("full_score") - F.element_at("m", p), 9) <= F.col("threshold"))
    c = wide.withColumn("pipeline", F.when(F.size(skipped) == 1, skipped[0]).otherwise("v2_full")).withColumn("score", F.element_at("m", F.col("pipeline")))
    g = c.groupBy("threshold").agg((F.avg("score") / F.avg("full_score")).alias("p"), (1 - F.avg(G.calls(F.col("pipeline"))) / 3).alias("c"), F.min("score").alias("m"), F.count_if(F.col("score") < 0.9 * F.col("full_score")).alias("failures"))
    return g.select("threshold", r6("p", "preservation"), r6("c", "cost_reduction"), r6("m", "min_score"), "failures")


@query("g11_system_comparison", _SC + ", g AS (SELECT pipeline, avg(score) AS a, min(score) AS m, stddev_samp(score) AS d FROM s GROUP BY 1) SELECT pipeline, round(a,6) AS final_avg, round(m,6) AS min_score, round(d,6) AS score_std, round(m,9)=round(max(m) OVER (),9) AS is_highest_min, round(d,9)=round(min(d) OVER (),9) AS is_lowest_std FROM g")
def g11(spark, sf):
    from pyspark.sql import Window

    g = scores(spark, sf).groupBy("pipeline").agg(F.avg("score").alias("a"), F.min("score").alias("m"), F.stddev_samp("score").alias("d"))
    w = Window.partitionBy()  # one row a pipeline
    return g.select("pipeline", r6("a", "final_avg"), r6("m", "min_score"), r6("d", "score_std"), (F.round("m", 9) == F.round(F.max("m").over(w), 9)).alias("is_highest_min"), (F.round("d", 9) == F.round(F.min("d").over(w), 9)).alias("is_lowest_std"))


def _rows(spark, sf, noisy: bool):
    """Ledger rows as a page's expected rows, or with every 7th row gone, some amounts off and some types changed."""
    li = table(spark, sf, "lineitem")
    types = F.when(F.col("l_linenumber") == 1, "header").when(F.col("l_linenumber") == 7, "total").otherwise("entry")
    base = li.select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("row_index"), types.alias("row_type"), F.concat_ws(" ", F.col("l_returnflag"), F.col("l_linestatus"), F.col("l_partkey").cast("string")).alias("description"), F.floor("l_extendedprice").cast("long").alias("amount"), F.when(F.col("l_partkey") % 3 == 0, 0.5).alias("fraction"), F.col("l_partkey").alias("k"))
    if not noisy:
        return base.drop("k")
    kept = base.where("k % 7 <> 0").withColumn("amount", F.when(F.col("k") % 11 == 0, F.col("amount") + 1).otherwise(F.col("amount")))
    return kept.withColumn("row_type", F.when((F.col("k") % 13 == 0) & (F.col("row_type") == "entry"), "total").otherwise(F.col("row_type"))).drop("k")


@query("e01_structure", """WITH g AS (SELECT l_orderkey AS page, l_partkey AS k, CASE l_linenumber WHEN 1 THEN 'header' WHEN 7 THEN 'total' ELSE 'entry' END AS t FROM lineitem), p AS (SELECT page, CASE WHEN k%13=0 AND t='entry' THEN 'total' ELSE t END AS t FROM g WHERE k%7<>0),
b AS (SELECT page, t, 1 AS s FROM p UNION ALL SELECT page, t, 0 FROM g), c AS (SELECT page, count(*) FILTER (s=1) np, count(*) FILTER (s=0) ng, count(*) FILTER (s=1 AND t='header') h1, count(*) FILTER (s=0 AND t='header') h0, count(*) FILTER (s=1 AND t='entry') e1, count(*) FILTER (s=0 AND t='entry') e0, count(*) FILTER (s=1 AND t='total') t1, count(*) FILTER (s=0 AND t='total') t0 FROM b GROUP BY page)
SELECT page, round(greatest(0,1-abs(np-ng)/ng),6) AS row_count_score, round((CASE WHEN h0=0 THEN (h1=0)::INT ELSE greatest(0,1-abs(h1-h0)/h0) END + CASE WHEN e0=0 THEN (e1=0)::INT ELSE greatest(0,1-abs(e1-e0)/e0) END + CASE WHEN t0=0 THEN (t1=0)::INT ELSE greatest(0,1-abs(t1-t0)/t0) END)/3,6) AS type_count_score FROM c""")  # fmt: skip
def e01(spark, sf):
    return E.structure_score(_rows(spark, sf, True), _rows(spark, sf, False)).select("page", r6("row_count_score", "row_count_score"), r6("type_count_score", "type_count_score"))


_LEV = "CASE WHEN length({a})+length({b})=0 THEN 1.0 ELSE 1-2.0*levenshtein({a},{b})/(length({a})+length({b})) END"
_SIMILAR = "CASE WHEN greatest(x.a,g.a)=0 THEN 1.0 ELSE greatest(0.0, 1-abs(x.a-g.a)/greatest(x.a,g.a)::DOUBLE) END"
#: Greedy matching row by row: a recursive step takes each page's next expected row, and a list holds what is left.
_GREEDY = """WITH RECURSIVE g0 AS (SELECT l_orderkey AS page, l_linenumber AS ri, CASE l_linenumber WHEN 1 THEN 'header' WHEN 7 THEN 'total' ELSE 'entry' END AS t, l_returnflag || ' ' || l_linestatus || ' ' || l_partkey AS d, CAST(floor(l_extendedprice) AS BIGINT) AS a, CASE WHEN l_partkey % 3 = 0 THEN 0.5::DOUBLE END AS f, l_partkey AS k FROM lineitem),
p0 AS (SELECT page, ri, CASE WHEN k % 13 = 0 AND t = 'entry' THEN 'total' ELSE t END AS t, d, CASE WHEN k % 11 = 0 THEN a + 1 ELSE a END AS a, f FROM g0 WHERE k % 7 <> 0),
gn AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY ri, t, d, a, f NULLS LAST) AS n FROM g0), pn AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY ri, t, d, a, f NULLS LAST) AS n FROM p0), pages AS (SELECT DISTINCT page FROM g0)"""


def _matching(name: str, where: str, fraction: bool = False) -> str:
    """CTEs that match the expected rows of a kind: {name}(page, s, ps, credit, sims, missed)."""
    same = "x.a = g.a AND x.f = g.f" if fraction else "x.a = g.a"
    order = "{e: (x.t = g.t)::INT, m: -x.n}" if fraction else "{e: (x.t = g.t)::INT, r: " + _LEV.format(a="g.d", b="x.d") + ", m: -x.n}"
    return f""", {name}_l AS (SELECT page, list({{n: n, t: t, d: d, a: a, f: f}} ORDER BY n) AS ps FROM pn WHERE {where} GROUP BY page), {name}_g AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY n) AS s FROM gn WHERE {where}),
{name} AS (SELECT pages.page, 0::BIGINT AS s, coalesce(ps, []) AS ps, 0.0::DOUBLE AS credit, 0.0::DOUBLE AS sims, []::BIGINT[] AS missed FROM pages LEFT JOIN {name}_l USING (page)
UNION ALL SELECT page, s, CASE WHEN b IS NULL THEN ps ELSE list_filter(ps, lambda x: x.n <> -b.m) END, credit + CASE WHEN b IS NULL THEN 0 WHEN b.e = 1 THEN 1 ELSE 0.5 END, sims + CASE WHEN b IS NULL THEN close ELSE 1 END, CASE WHEN b IS NULL THEN list_append(missed, gi) ELSE missed END
FROM (SELECT q.page, g.s, ps, credit, sims, missed, g.n AS gi, list_sort(list_transform(list_filter(ps, lambda x: {same}), lambda x: {order}), 'DESC')[1] AS b, coalesce(list_max(list_transform(ps, lambda x: {_SIMILAR})), 0) AS close FROM {name} q JOIN {name}_g g ON g.page = q.page AND g.s = q.s + 1))"""


_HEADS = """, h_l AS (SELECT page, list({n: n, d: d} ORDER BY n) AS ps FROM pn WHERE t = 'header' GROUP BY page), h_g AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY n) AS s FROM gn WHERE t = 'header'),
h AS (SELECT pages.page, 0::BIGINT AS s, coalesce(ps, []) AS ps, 0::BIGINT AS hits FROM pages LEFT JOIN h_l USING (page)
UNION ALL SELECT page, s, CASE WHEN b.r >= 0.8 THEN list_filter(ps, lambda x: x.n <> -b.m) ELSE ps END, hits + coalesce(b.r >= 0.8, false)::INT
FROM (SELECT h.page, g.s, ps, hits, list_sort(list_transform(ps, lambda x: {r: """ + _LEV.format(a="g.d", b="x.d") + """, m: -x.n}), 'DESC')[1] AS b FROM h JOIN h_g g ON g.page = h.page AND g.s = h.s + 1))"""
_SHARE = "CASE WHEN {g} = 0 THEN ({p} = 0)::INT ELSE greatest(0.0, 1 - abs({p} - {g}) / {g}::DOUBLE) END"


@query("e02_e06_page_scores", _GREEDY + _HEADS + _matching("m", "t <> 'header'") + _matching("f", "t <> 'header' AND f IS NOT NULL", True) + f""",
c AS (SELECT page, count(*) FILTER (s=1) np, count(*) FILTER (s=0) ng, count(*) FILTER (s=1 AND t='header') h1, count(*) FILTER (s=0 AND t='header') h0, count(*) FILTER (s=1 AND t='entry') e1, count(*) FILTER (s=0 AND t='entry') e0, count(*) FILTER (s=1 AND t='total') t1, count(*) FILTER (s=0 AND t='total') t0 FROM (SELECT page, t, 1 AS s FROM pn UNION ALL SELECT page, t, 0 FROM gn) GROUP BY page),
k AS (SELECT page, {_SHARE.format(p='np', g='ng')} AS rows_, ({_SHARE.format(p='h1', g='h0')} + {_SHARE.format(p='e1', g='e0')} + {_SHARE.format(p='t1', g='t0')}) / 3 AS types FROM c),
lh AS (SELECT page, max(s) AS n, arg_max(hits, s) AS hits FROM h GROUP BY page), lm AS (SELECT page, max(s) AS n, arg_max(credit, s) AS credit, arg_max(sims, s) AS sims FROM m GROUP BY page), lf AS (SELECT page, max(s) AS n, arg_max(len(missed), s) AS missed FROM f GROUP BY page),
x AS (SELECT page, printf('%.4f', (printf('%.4f', rows_)::DOUBLE + printf('%.4f', types)::DOUBLE + printf('%.4f', CASE WHEN lh.n = 0 THEN 1 ELSE lh.hits / lh.n::DOUBLE END)::DOUBLE) / 3)::DOUBLE AS axis1, CASE WHEN lm.n = 0 THEN 1 ELSE credit / lm.n END AS a, CASE WHEN lm.n = 0 THEN 1 ELSE sims / lm.n END AS b, CASE WHEN lf.n = 0 THEN 1 ELSE (lf.n - missed) / lf.n::DOUBLE END AS c FROM k JOIN lh USING (page) JOIN lm USING (page) JOIN lf USING (page)),
y AS (SELECT *, printf('%.4f', 0.5*a + 0.3*b + 0.2*c)::DOUBLE AS axis2 FROM x)
SELECT page, axis1, printf('%.4f', a)::DOUBLE AS axis2_match, printf('%.4f', b)::DOUBLE AS axis2_similarity, printf('%.4f', c)::DOUBLE AS axis2_fraction, axis2, printf('%.4f', 0.3*axis1 + 0.7*axis2)::DOUBLE AS combined FROM y""")  # fmt: skip
def e02(spark, sf):
    return E.page_scores(_rows(spark, sf, True), _rows(spark, sf, False))


@query("e08_feedback", _GREEDY + _matching("m", "true") + """, z AS (SELECT page, unnest(arg_max(missed, s)) AS n FROM m GROUP BY page), ps AS (SELECT page, list({n: n, d: d} ORDER BY n) AS ps FROM pn GROUP BY page)
SELECT page, ri AS row_index, d AS description, list_sort(list_transform(ps, lambda x: {r: """ + _LEV.format(a="gn.d", b="x.d") + """, m: -x.n, d: x.d}), 'DESC')[1].d AS closest FROM z JOIN gn USING (page, n) LEFT JOIN ps USING (page)""")
def e08(spark, sf):
    return E.feedback(_rows(spark, sf, True), _rows(spark, sf, False))


@query("e11_most_rows", "SELECT o_custkey, (array_agg(o_orderkey ORDER BY n DESC, o_orderkey))[1] AS best FROM (SELECT o_custkey, o_orderkey, count(*) AS n FROM orders JOIN lineitem ON o_orderkey=l_orderkey GROUP BY ALL) GROUP BY o_custkey")
def e11(spark, sf):
    n = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    j = table(spark, sf, "orders").select("o_orderkey", "o_custkey").join(n, "o_orderkey")
    return j.groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct(-F.col("n"), "o_orderkey")).alias("best"))


_RATERS = "WITH r AS (SELECT doc_id, CAST(quality AS VARCHAR) AS a, CAST(CASE WHEN doc_id % 5 = 0 THEN 1-quality ELSE quality END AS VARCHAR) AS b, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE CAST(1-toxic AS VARCHAR) END AS c FROM labels)"


def _raters(spark, sf):
    q = F.col("quality")
    return table(spark, sf, "labels").select("doc_id", q.cast("string").alias("a"), F.when(F.col("doc_id") % 5 == 0, 1 - q).otherwise(q).cast("string").alias("b"), F.when(F.col("doc_id") % 9 != 0, (1 - F.col("toxic")).cast("string")).alias("c"))


@query("r01_cohen", _RATERS + ", k AS (SELECT coalesce(a,'unknown') a, coalesce(c,'unknown') b FROM r), n AS (SELECT count(*) n, count(*) FILTER (a=b) s FROM k), e AS (SELECT sum(x*y) AS e FROM (SELECT a, count(*) x FROM k GROUP BY a) p JOIN (SELECT b, count(*) y FROM k GROUP BY b) q ON a=b) SELECT round((s/n - e/(n*n::DOUBLE))/(1-e/(n*n::DOUBLE)),6) AS kappa, n FROM n, e")
def r01(spark, sf):
    return R.cohen(_raters(spark, sf), "a", "c").select(r6("kappa", "kappa"), "n")


@query("r02_fleiss", _RATERS + ", l AS (SELECT doc_id, unnest([a, b, coalesce(c,'unknown')]) AS k FROM r), i AS (SELECT doc_id, k, count(*) AS n FROM l GROUP BY ALL), p AS (SELECT doc_id, (sum(n*n)-3)/6.0 AS p FROM i GROUP BY doc_id), q AS (SELECT sum(pow(n/(SELECT count(*) FROM l),2)) AS pe, count(*) AS n_categories FROM (SELECT k, count(*) AS n FROM l GROUP BY k)) SELECT round((avg(p)-any_value(pe))/(1-any_value(pe)),6) AS kappa, count(*) AS n_items, any_value(n_categories) AS n_categories FROM p, q")
def r02(spark, sf):
    return R.fleiss(_raters(spark, sf), ["a", "b", "c"]).select(r6("kappa", "kappa"), "n_items", "n_categories")


@query("r03_agreement", _RATERS + " SELECT a AS label, count(*) AS n_items, count(*) FILTER (a=b AND a=coalesce(c,'unknown')) AS n_agree, round(count(*) FILTER (a=b AND a=coalesce(c,'unknown'))/count(*),6) AS agree_rate FROM r GROUP BY a")
def r03(spark, sf):
    return R.agreement(_raters(spark, sf), ["a", "b", "c"]).select("label", "n_items", "n_agree", r6("agree_rate", "agree_rate"))


@query("r05_bootstrap", ENTRIES + """, e AS (SELECT page_id, decade, CASE WHEN direction='income' THEN amount_w ELSE 0 END AS x, amount_w AS y FROM entries WHERE direction IN ('income','expenditure')), s AS (SELECT page_id, decade, sum(x) AS a, sum(y) AS b FROM e GROUP BY ALL),
p AS (SELECT page_id, row_number() OVER (ORDER BY page_id % 256, page_id) - 1 AS i FROM (SELECT DISTINCT page_id FROM s)), m AS (SELECT count(*) AS n FROM p),
u0 AS (SELECT id // n AS d, id % n AS j, n FROM m, (SELECT unnest(range(0, (SELECT CAST(n * 1000 AS BIGINT) FROM m))) AS id)), u1 AS (SELECT d, j, n, (d * 1000003 + j * 7919 + 42) % 2147483647 AS u FROM u0), u2 AS (SELECT d, j, n, (((u * u + d) % 2147483647) * 48271 + j) % 2147483647 AS u2 FROM u1),
k AS (SELECT d, ((u2 * u2 + 12345) % 2147483647) % n AS i FROM u2), x AS (SELECT decade, d, sum(a)/nullif(sum(b),0) AS x FROM k JOIN p USING (i) JOIN s USING (page_id) GROUP BY ALL),
c AS (SELECT decade, quantile_cont(x,0.025) AS lo, quantile_cont(x,0.975) AS hi, count(x) AS n FROM x GROUP BY decade)
SELECT decade, round((SELECT sum(a)/nullif(sum(b),0) FROM s t WHERE t.decade=c.decade),6) AS estimate, round(CASE WHEN n >= 10 THEN lo END,6) AS ci_lower, round(CASE WHEN n >= 10 THEN hi END,6) AS ci_upper FROM c""")  # fmt: skip
def r05(spark, sf):
    e = entries(spark, sf).where("direction in ('income', 'expenditure')")
    b = R.bootstrap(e, "page_id", "decade", F.when(F.col("direction") == "income", F.col("amount_w")).otherwise(0.0), F.col("amount_w"), bucket=F.col("page_id") % 256)
    return b.select("decade", *[r6(c, c) for c in ("estimate", "ci_lower", "ci_upper")])


@query("s01_scan_explode", "SELECT l_orderkey AS page_id, count(*) AS n_rows, sum(1 + l_linenumber % 2) AS n_years FROM lineitem JOIN orders ON l_orderkey=o_orderkey GROUP BY 1")
def s01(spark, sf):
    return rows(spark, sf).groupBy("page_id").agg(F.count("*").alias("n_rows"), F.sum(F.size("years")).alias("n_years"))
