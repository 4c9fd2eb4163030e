"""Windows W1-W16 and series statistics over months."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import series as W
from ..operators import shares as A
from .bindings import ENTRIES, entries, table
from .registry import query, r6

_Y = ENTRIES + ", y AS (SELECT year, sum(amount_w) AS x FROM entries GROUP BY year) "


def _y(spark, sf):
    return A.totals(entries(spark, sf), ["year"], x="amount_w")


@query("w01_w03_rolling", _Y + """SELECT year, round(CASE WHEN count(x) OVER a >= 3 THEN avg(x) OVER a END,6) AS five, round(CASE WHEN count(x) OVER b >= 3 THEN avg(x) OVER b END,6) AS seven, round(CASE WHEN count(x) OVER c >= 10 THEN avg(x) OVER c END,6) AS ten FROM y
WINDOW a AS (ORDER BY year ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), b AS (ORDER BY year ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), c AS (ORDER BY year ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING)""")  # fmt: skip
def w01(spark, sf):
    return _y(spark, sf).select("year", r6(W.rolling("x", 2, 2, 3), "five"), r6(W.rolling("x", 3, 3, 3), "seven"), r6(W.rolling("x", 5, 4, 10), "ten"))


@query("w04_w08_differences", _Y + "SELECT year, round(coalesce(x-lag(x) OVER (ORDER BY year),0),6) AS diff, round((x/nullif(lag(x) OVER (ORDER BY year),0)-1)*100,6) AS pct FROM y")
def w04(spark, sf):
    return _y(spark, sf).select("year", r6(F.coalesce(W.difference("x"), F.lit(0.0)), "diff"), r6(W.change("x"), "pct"))


@query("w09_forward_fill", "SELECT conv_id, turn, coalesce(last_value(CASE WHEN role='user' THEN md5(text) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING),'') AS header FROM conversations")
def w09(spark, sf):
    c = table(spark, sf, "conversations").withColumn("h", F.when(F.col("role") == "user", F.md5("text")))
    return c.select("conv_id", "turn", W.fill_forward("h", ["turn", "role", "text"], ["conv_id"]).alias("header"))


@query("w10_group_span", "SELECT DISTINCT o_custkey, min(o_orderdate) OVER (PARTITION BY o_custkey)::DATE AS first_day, max(o_orderdate) OVER (PARTITION BY o_custkey)::DATE AS last_day FROM orders")
def w10(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").cast("date").alias("first_day"), F.max("o_orderdate").cast("date").alias("last_day"))


@query("w11_running_distinct", "WITH f AS (SELECT o_custkey, min(date_trunc('month',o_orderdate))::DATE AS m FROM orders GROUP BY 1), n AS (SELECT m, count(*) AS n_new FROM f GROUP BY m) SELECT m AS month, n_new, CAST(sum(n_new) OVER (ORDER BY m) AS BIGINT) AS cumulative FROM n")
def w11(spark, sf):
    f = table(spark, sf, "orders").groupBy("o_custkey").agg(F.min(F.trunc("o_orderdate", "month")).alias("month"))
    return f.groupBy("month").agg(F.count("*").alias("n_new")).select("month", "n_new", W.running("n_new", "month").alias("cumulative"))


@query("w12_rank", "SELECT c_mktsegment, c_custkey, rank FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer) WHERE rank <= 20")
def w12(spark, sf):
    return A.top(table(spark, sf, "customer"), ["c_mktsegment"], 20, F.desc("c_acctbal"), F.asc("c_custkey")).select("c_mktsegment", "c_custkey", "rank")


@query("w14_w15_thresholds", _Y + ", d AS (SELECT year, x, lag(x) OVER (ORDER BY year) AS p FROM y WHERE year >= 1820) SELECT min(year) FILTER (x > 50000) AS first_over, bool_and(p IS NULL OR x >= p) AS monotonic FROM d")
def w14(spark, sf):
    d = _y(spark, sf).where("year >= 1820").withColumn("p", F.lag("x").over(Window.orderBy("year")))
    return d.agg(F.min(F.when(F.col("x") > 50000, F.col("year"))).alias("first_over"), F.bool_and(F.col("p").isNull() | (F.col("x") >= F.col("p"))).alias("monotonic"))


@query("a17_robust_z", "WITH d AS (SELECT ts::DATE AS day, sum(value) AS x FROM events GROUP BY 1), m AS (SELECT *, median(x) OVER () AS med FROM d), z AS (SELECT *, median(abs(x-med)) OVER () AS mad FROM m) SELECT day, round(CASE WHEN mad=0 THEN 0 ELSE 0.6745*(x-med)/mad END,6) AS z FROM z")
def a17(spark, sf):
    d = table(spark, sf, "events").groupBy(F.to_date("ts").alias("day")).agg(F.sum("value").alias("x"))
    return W.robust_z(d, "x").select("day", r6("z", "z"))


@query("a20_distribution", "WITH b AS (SELECT event_type, CAST(floor(value/5) AS INT) AS bin, value FROM events), c AS (SELECT event_type, bin, count(*) AS n FROM b GROUP BY ALL), p AS (SELECT *, n/sum(n) OVER (PARTITION BY event_type) AS p FROM c), m AS (SELECT event_type, avg(value) AS mu FROM events GROUP BY 1), s AS (SELECT event_type, avg(pow(value-mu,3))/pow(avg(pow(value-mu,2)),1.5) AS skew FROM events JOIN m USING (event_type) GROUP BY 1) SELECT event_type, round(sum(-p*log2(p)),6) AS entropy, arg_max(bin, n*100000-bin) AS mode_bin, round(any_value(skew),6) AS skew FROM p JOIN s USING (event_type) GROUP BY event_type")
def a20(spark, sf):
    e = table(spark, sf, "events").select("event_type", F.floor(F.col("value") / 5).cast("int").alias("bin"), "value")
    c = e.groupBy("event_type", "bin").agg(F.count("*").alias("n"))
    p = A.shares(c, ["event_type"], p="n").groupBy("event_type").agg(F.sum(-F.col("p") * F.log2("p")).alias("h"), F.max_by("bin", F.struct("n", -F.col("bin"))).alias("mode_bin"))
    return p.join(e.groupBy("event_type").agg(F.skewness("value").alias("skew")), "event_type").select("event_type", r6("h", "entropy"), "mode_bin", r6("skew", "skew"))


@query("a13_a16_correlations", "SELECT event_type, round(stddev_samp(value),6) AS std, round(stddev_pop(value),6) AS std0, round(corr(value, user_id),6) AS r_user, round(corr(value, CAST(json_extract(props,'$.k') AS DOUBLE)),6) AS r_k FROM events GROUP BY event_type")
def a13(spark, sf):
    e = table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("double"))
    return e.groupBy("event_type").agg(r6(F.stddev_samp("value"), "std"), r6(F.stddev_pop("value"), "std0"), r6(F.corr("value", "user_id"), "r_user"), r6(F.corr("value", "k"), "r_k"))
