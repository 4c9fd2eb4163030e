"""Joins J1-J18, aggregations A1-A12 and A22-A24, orders O1-O9 and set operations U1-U7."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import shares as A
from .bindings import table
from .registry import query, r6


@query("j01_share_window", "SELECT n_regionkey, n_name, round(sum(c_acctbal)/sum(sum(c_acctbal)) OVER (PARTITION BY n_regionkey),6) AS share FROM customer JOIN nation ON c_nationkey=n_nationkey GROUP BY n_regionkey, n_name")
def j01(spark, sf):
    t = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.sum("c_acctbal").alias("s")).join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return A.shares(t, ["n_regionkey"], share="s").select("n_regionkey", "n_name", r6("share", "share"))


@query("j02_left_fill", "SELECT c_custkey, coalesce(n,0) AS n_orders, round(coalesce(s,0),6) AS total FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS s FROM orders WHERE o_orderstatus='P' GROUP BY 1) ON c_custkey=o_custkey")
def j02(spark, sf):
    o = table(spark, sf, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"), F.sum("o_totalprice").alias("s"))
    return table(spark, sf, "customer").select("c_custkey").join(o, "c_custkey", "left").select("c_custkey", F.coalesce("n_orders", F.lit(0)).alias("n_orders"), r6(F.coalesce("s", F.lit(0.0)), "total"))


@query("j06_e09_full_outer", "WITH a AS (SELECT o_custkey AS k, max(o_totalprice) AS v1 FROM orders WHERE o_orderstatus='F' GROUP BY 1), b AS (SELECT o_custkey AS k, max(o_totalprice) AS v2 FROM orders WHERE o_orderstatus='O' GROUP BY 1) SELECT k AS page, coalesce(v1,0) AS v1, coalesce(v2,0) AS v2, CASE WHEN coalesce(v1,0)>coalesce(v2,0) THEN 'v1' WHEN coalesce(v1,0)<coalesce(v2,0) THEN 'v2' ELSE 'tie' END AS winner FROM a FULL JOIN b USING (k)")
def j06(spark, sf):
    o = table(spark, sf, "orders").where("o_orderstatus in ('F', 'O')")  # both sides of the outer join in one aggregation
    best = lambda s: F.coalesce(F.max(F.when(F.col("o_orderstatus") == s, F.col("o_totalprice"))), F.lit(0.0))
    p = o.groupBy(F.col("o_custkey").alias("page")).agg(best("F").alias("v1"), best("O").alias("v2"))
    return p.select("page", "v1", "v2", F.when(F.col("v1") > F.col("v2"), "v1").when(F.col("v1") < F.col("v2"), "v2").otherwise("tie").alias("winner"))


@query("j08_three_way", "SELECT count(*) AS n, round(sum(l_extendedprice),2) AS s FROM lineitem JOIN orders ON l_orderkey=o_orderkey JOIN customer ON o_custkey=c_custkey WHERE c_mktsegment='BUILDING'")
def j08(spark, sf):
    c = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    o = table(spark, sf, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey")
    li = table(spark, sf, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return li.agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("s"))


@query("j09_merge_last", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS i FROM conversations) SELECT o_orderkey, turn AS last_turn, md5(text) AS h FROM orders LEFT JOIN (SELECT * FROM r WHERE i=1) ON o_orderkey=conv_id")
def j09(spark, sf):
    last = table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("o_orderkey")).agg(F.max_by(F.struct("turn", "text"), F.struct("turn", "role", "text")).alias("r"))
    return table(spark, sf, "orders").select("o_orderkey").join(last, "o_orderkey", "left").select("o_orderkey", F.col("r.turn").alias("last_turn"), F.md5("r.text").alias("h"))


@query("j16_semi_anti", "SELECT (SELECT count(*) FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)) AS with_orders, (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)) AS without")
def j16(spark, sf):
    c, o = table(spark, sf, "customer").select("c_custkey"), table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("hit", F.lit(1))
    return c.join(o, "c_custkey", "left").agg(F.count("hit").alias("with_orders"), F.count_if(F.col("hit").isNull()).alias("without"))


@query("j17_reindex", "SELECT k AS size, coalesce(n,0) AS n FROM (SELECT unnest(generate_series(0,60)) AS k) LEFT JOIN (SELECT p_size, count(*) AS n FROM part GROUP BY 1) ON k=p_size")
def j17(spark, sf):
    n = table(spark, sf, "part").groupBy(F.col("p_size").cast("long").alias("size")).agg(F.count("*").alias("n"))
    return spark.range(61).select(F.col("id").alias("size")).join(n, "size", "left").select("size", F.coalesce("n", F.lit(0)).alias("n"))


@query("a02_conditional", "SELECT l_linestatus, round(sum(l_extendedprice) FILTER (l_returnflag='R'),4) AS returned, count(*) FILTER (l_discount>0.05) AS discounted FROM lineitem GROUP BY 1")
def a02(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_linestatus").agg(F.round(F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_extendedprice"))), 4).alias("returned"), F.count_if(F.col("l_discount") > 0.05).alias("discounted"))


@query("a04_percentiles", "SELECT l_returnflag, " + ", ".join(f"round(quantile_cont(l_extendedprice,{p}),6) AS p{int(p * 1000)}" for p in (0.025, 0.25, 0.75, 0.95, 0.975)) + " FROM lineitem GROUP BY 1")
def a04(spark, sf):
    ps = [0.025, 0.25, 0.75, 0.95, 0.975]
    t = table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.percentile("l_extendedprice", F.array(*map(F.lit, ps))).alias("p"))
    return t.select("l_returnflag", *[r6(F.col("p")[i], f"p{int(p * 1000)}") for i, p in enumerate(ps)])


@query("a05_pivot", "SELECT o_orderpriority, " + ", ".join(f"round(coalesce(sum(o_totalprice) FILTER (o_orderstatus='{s}'),0),4) AS \"{s}\"" for s in "FOPX") + " FROM orders GROUP BY 1")
def a05(spark, sf):
    p = A.wide(table(spark, sf, "orders"), ["o_orderpriority"], "o_orderstatus", list("FOPX"), F.sum("o_totalprice"))
    return p.select("o_orderpriority", *[F.round(s, 4).alias(s) for s in "FOPX"])


@query("a06_crosstab", "SELECT l_returnflag, count(*) FILTER (l_linestatus='F') AS f, count(*) FILTER (l_linestatus='O') AS o FROM lineitem GROUP BY 1")
def a06(spark, sf):
    return A.wide(table(spark, sf, "lineitem"), ["l_returnflag"], "l_linestatus", ["F", "O"], F.count(F.lit(1)), fill=0).select("l_returnflag", F.col("F").alias("f"), F.col("O").alias("o"))


@query("a08_a10_ordered", "SELECT conv_id, arg_min(role, turn) AS first_role, md5(string_agg(text, ' ' ORDER BY turn, role, text)) AS h, count(*) AS n FROM conversations GROUP BY conv_id")
def a08(spark, sf):
    c = table(spark, sf, "conversations")
    return c.groupBy("conv_id").agg(A.first_by("role", "turn").alias("first_role"), F.md5(A.joined_text("text", ["turn", "role", "text"])).alias("h"), F.count("*").alias("n"))


@query("a11_mode", "SELECT c_nationkey, (array_agg(c_mktsegment ORDER BY n DESC, c_mktsegment))[1] AS segment FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL) GROUP BY c_nationkey")
def a11(spark, sf):
    return A.mode(table(spark, sf, "customer"), ["c_nationkey"], "c_mktsegment", "segment")


@query("a12_argmax", "SELECT o_custkey, (array_agg(o_orderkey ORDER BY o_totalprice DESC, o_orderkey))[1] AS best FROM orders GROUP BY 1")
def a12(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct(-F.col("o_totalprice"), "o_orderkey")).alias("best"))


@query("a24_grouping_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), ())")
def a24(spark, sf):
    return table(spark, sf, "orders").groupingSets([["o_orderstatus", "o_orderpriority"], ["o_orderstatus"], []], "o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


def _last_orders(spark, sf):
    o = table(spark, sf, "orders").where("o_orderstatus = 'P' and o_totalprice > 300000").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderkey").alias("o_orderkey"))
    return table(spark, sf, "customer").select("c_custkey").join(o, "c_custkey", "left").orderBy(F.asc_nulls_last("o_orderkey"), "c_custkey")


@query("o05_nulls_last_whole", "SELECT c_custkey, o_orderkey FROM (SELECT c_custkey, max(o_orderkey) AS o_orderkey FROM customer LEFT JOIN orders ON c_custkey=o_custkey AND o_orderstatus='P' AND o_totalprice>300000 GROUP BY 1) ORDER BY o_orderkey NULLS LAST, c_custkey")
def o05_whole(spark, sf):
    return _last_orders(spark, sf)


@query("o08_stratified_sample", "SELECT source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY (doc_id*7919) % 10007, doc_id) AS i FROM documents) WHERE i <= 5")
def o08(spark, sf):
    d = table(spark, sf, "documents").select("source", "doc_id")
    return A.top(d, ["source"], 5, (F.col("doc_id") * 7919) % 10007, F.col("doc_id")).select("source", "doc_id")


@query("u01_u07_sets", "WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus='F'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus='O') SELECT 'both' AS what, count(*) AS n FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT 'first', count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT 'any', count(*) FROM (SELECT k FROM a UNION SELECT k FROM b)")
def u01(spark, sf):
    o = table(spark, sf, "orders").where("o_orderstatus in ('F', 'O')").groupBy("o_custkey").agg(F.bool_or(F.col("o_orderstatus") == "F").alias("f"), F.bool_or(F.col("o_orderstatus") == "O").alias("o"))
    c = o.agg(F.count_if(F.col("f") & F.col("o")).alias("both"), F.count_if(F.col("f") & ~F.col("o")).alias("first"), F.count("*").alias("any"))
    return c.unpivot([], ["both", "first", "any"], "what", "n")


@query("u06_melt", "SELECT c_custkey, metric, value FROM (UNPIVOT (SELECT c_custkey, c_acctbal AS balance, c_nationkey::DOUBLE AS nation FROM customer) ON balance, nation INTO NAME metric VALUE value)")
def u06(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_acctbal").alias("balance"), F.col("c_nationkey").cast("double").alias("nation"))
    return c.unpivot(["c_custkey"], ["balance", "nation"], "metric", "value")


@query("g02_oracle_best", "WITH s AS (SELECT doc_id AS page, unnest(['v2_no_gemini','v2_no_claude','v2_no_gpt','v2_full']) AS pipeline, unnest([(doc_id*7919 % 1000)/1000.0,(doc_id*104729 % 1000)/1000.0,(doc_id*1299709 % 1000)/1000.0,(doc_id*15485863 % 1000)/1000.0])::DOUBLE AS score, unnest([0,1,2,3]) AS o FROM documents) SELECT page, (array_agg(pipeline ORDER BY score DESC, o))[1] AS best, max(score) AS best_score, round(max(score)-max(score) FILTER (pipeline='v2_full'),6) AS gap FROM s GROUP BY page")
def g02(spark, sf):
    from ..operators import routing as R

    return R.oracle_best(scores(spark, sf)).select("page", "best", "best_score", r6("gap", "gap"))


def scores(spark, sf):
    """Scores of four pipelines a page, from arithmetic on the id."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("page"))
    from ..functions.constants import PIPELINES

    rows = F.array(*[F.struct(F.lit(p).alias("pipeline"), ((F.col("page") * m) % 1000 / 1000.0).alias("score"), F.lit(i).alias("ord")) for i, (p, m) in enumerate(zip(PIPELINES, (7919, 104729, 1299709, 15485863), strict=True))])
    return d.select("page", F.inline(rows))
