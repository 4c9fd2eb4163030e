"""Scalar rules P1-P28 and predicates F1-F12, over values written as the ledger writes them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import scalars as S
from .bindings import ENTRIES, entries, sql_case, table
from .registry import query, r6

#: Pounds, shillings, pence and a fraction of an extended price, as typed text with blanks and glyphs.
_PARTS = """WITH m AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice AS x, CAST(floor(l_extendedprice) AS BIGINT) AS p, CAST(floor(l_quantity) AS INT) % 20 AS s, l_linenumber % 12 AS d, l_orderkey % 5 AS f FROM lineitem),
t AS (SELECT *, CASE WHEN p % 7 = 0 THEN '' WHEN p % 7 = 1 THEN '£' || p ELSE p || '.0' END AS pt, CASE s WHEN 0 THEN '' ELSE CAST(s AS VARCHAR) END AS st, CAST(d AS VARCHAR) AS dt, ['½','1/4','.75','x',''][f+1] AS ft FROM m)"""


def _parts(spark, sf):
    m = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.floor("l_extendedprice").alias("p"), (F.floor("l_quantity").cast("int") % 20).alias("s"), (F.col("l_linenumber") % 12).alias("d"), (F.col("l_orderkey") % 5).alias("f"))
    pt = F.when(F.col("p") % 7 == 0, "").when(F.col("p") % 7 == 1, F.concat(F.lit("£"), "p")).otherwise(F.concat("p", F.lit(".0")))
    return m.select("*", pt.alias("pt"), F.when(F.col("s") == 0, "").otherwise(F.col("s").cast("string")).alias("st"), F.col("d").cast("string").alias("dt"), F.element_at(F.array(*map(F.lit, ["½", "1/4", ".75", "x", ""])), (F.col("f") + 1).cast("int")).alias("ft"))


_MONEY = "coalesce(try_cast(regexp_replace(pt,'[^0-9.\\-]','','g') AS DOUBLE),0)"
_FR = "CASE ft WHEN '½' THEN 0.5 WHEN '1/4' THEN 0.25 WHEN '.75' THEN 0.75 ELSE 0 END"


@query("p01_p05_money", _PARTS + f" SELECT l_orderkey, l_linenumber, l_partkey, {_MONEY} AS pounds, CAST({_FR} AS DOUBLE) AS fraction, round({_MONEY} + coalesce(try_cast(st AS DOUBLE),0)/20 + (coalesce(try_cast(dt AS DOUBLE),0)+{_FR})/240,6) AS amount FROM t")
def p01(spark, sf):
    p, f = S.money("pt"), S.fraction("ft")
    return _parts(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", p.alias("pounds"), f.alias("fraction"), r6(S.pounds(p, S.money("st"), S.money("dt"), f), "amount"))


_KNOWN = "CASE x WHEN '½' THEN 0.5 WHEN '1/4' THEN 0.25 WHEN '.75' THEN 0.75 WHEN '.5' THEN 0.5"


@query("p02_p04_variants", "WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey, ['½','1/4','.75','0.5','-1','x','','1e1',' .5 '][l_partkey % 9 + 1] AS t, CASE WHEN l_partkey % 4 = 0 THEN '' ELSE '£' || (l_partkey % 700) || '.5' END AS m FROM lineitem), w AS (SELECT *, lower(trim(t)) AS x FROM v) " + f"SELECT l_orderkey, l_linenumber, l_partkey, CAST({_KNOWN} ELSE 0 END AS DOUBLE) AS mapped, CAST({_KNOWN} WHEN '0.5' THEN 0.5 ELSE 0 END AS DOUBLE) AS digits, CAST({_KNOWN} WHEN '0.5' THEN 0.5 WHEN '-1' THEN -1 WHEN '1e1' THEN 10 ELSE 0 END AS DOUBLE) AS numbers, CASE WHEN m = '' THEN 0 ELSE l_partkey % 700 + 0.5 END::DOUBLE AS strict FROM w")
def p02(spark, sf):
    k = F.col("l_partkey")
    t = F.element_at(F.array(*map(F.lit, ["½", "1/4", ".75", "0.5", "-1", "x", "", "1e1", " .5 "])), (k % 9 + 1).cast("int"))
    m = F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("£"), k % 700, F.lit(".5")))
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", t.alias("t"), m.alias("m"))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", S.fraction("t", "none").alias("mapped"), S.fraction("t", "digits").alias("digits"), S.fraction("t").alias("numbers"), S.money_strict("m").alias("strict"))


@query("p06_pence", _PARTS + " SELECT l_orderkey, l_linenumber, l_partkey, CAST(trunc(coalesce(try_cast(pt AS DOUBLE),0)) AS BIGINT)*240 + CAST(coalesce(try_cast(st AS DOUBLE),0) AS BIGINT)*12 + CAST(dt AS BIGINT) AS pence FROM t")
def p06(spark, sf):
    return _parts(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", S.pence("pt", "st", "dt").alias("pence"))


@query("p07_normal_values", _PARTS + " SELECT pt, st, CASE WHEN regexp_replace(trim(pt),'\\.0$','')='0' THEN '' ELSE regexp_replace(trim(pt),'\\.0$','') END AS np, count(*) AS n FROM t GROUP BY ALL HAVING count(*) > 1")
def p07(spark, sf):
    return _parts(spark, sf).groupBy("pt", "st", S.normal_value("pt").alias("np")).agg(F.count("*").alias("n")).where("n > 1")


@query("p08_descriptions", "SELECT p_partkey, trim(lower('\"' || p_name || '\"'))[2:-2] AS cleaned FROM part")
def p08(spark, sf):
    return table(spark, sf, "part").select("p_partkey", S.clean_description(F.concat(F.lit('"'), "p_name", F.lit('"'))).alias("cleaned"))


@query("p10_price_index", ENTRIES + f"SELECT year, count(*) AS n, round({sql_case('year', K.PRICE_ANCHORS)},6) AS main, round({sql_case('year', K.PRICE_ANCHORS_ALT)},6) AS alt FROM entries GROUP BY year")
def p10(spark, sf):
    years = entries(spark, sf).groupBy("year").agg(F.count("*").alias("n"))
    return years.select("year", "n", r6(S.price_index("year"), "main"), r6(S.price_index("year", K.PRICE_ANCHORS_ALT), "alt"))


_PID = "CASE o_orderkey % 4 WHEN 0 THEN y || '_' || n || '_image' WHEN 1 THEN y || '-' || (y+2) || '_' || n || '_image' WHEN 2 THEN (y+1) || '-' || y || '_' || n || '_image' ELSE 'scan ' || y END"


@query("p13_page_ids", f"WITH k AS (SELECT o_orderkey, 1700 + CAST(o_orderkey % 190 AS INT) AS y, o_orderkey % 9 AS n, o_orderkey % 4 AS m FROM orders) SELECT o_orderkey, {_PID} AS page_id, CASE m WHEN 1 THEN [y,y+1,y+2] WHEN 2 THEN [y,y+1] ELSE [y] END AS years, CAST(CASE m WHEN 3 THEN 1 ELSE n END AS INT) AS page FROM k")
def p13(spark, sf):
    k = table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") % 190 + 1700).alias("y"), (F.col("o_orderkey") % 9).alias("n"), (F.col("o_orderkey") % 4).alias("m"))
    tail = F.concat(F.lit("_"), "n", F.lit("_image"))
    pid = F.when(F.col("m") == 0, F.concat("y", tail)).when(F.col("m") == 1, F.concat("y", F.lit("-"), F.col("y") + 2, tail)).when(F.col("m") == 2, F.concat(F.col("y") + 1, F.lit("-"), "y", tail)).otherwise(F.concat(F.lit("scan "), "y"))
    return k.select("o_orderkey", pid.alias("page_id")).select("o_orderkey", "page_id", S.page_years("page_id").alias("years"), S.page_number("page_id").alias("page"))


@query("p14_normal_text", "SELECT doc_id, md5(trim(regexp_replace(regexp_replace(lower(coalesce(text,'')),'[^a-z0-9\\s]',' ','g'),'\\s+',' ','g'))) AS h FROM documents")
def p14(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(S.normal_text("text")).alias("h"))


@query("p17_coercion", "SELECT o_orderkey, CASE WHEN o_orderstatus='P' THEN NULL WHEN lower(o_orderstatus) IN ('f') THEN 'f' ELSE 'unclear' END AS direction FROM orders")
def p17(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", S.coerced("o_orderstatus", ["f"], "unclear", F.when(F.col("o_orderstatus") == "P", "total").otherwise("Entry ")).alias("direction"))


@query("p19_header_direction", "WITH h AS (SELECT o_orderkey, ['Soluta Ordinaria','Arrearagia recepta','Recepta et soluta','Misc','stipendia'][o_orderkey % 5 + 1] AS header FROM orders) SELECT header, CASE WHEN regexp_matches(lower(header),'^(soluta|stipendia)') THEN 'expenditure' WHEN contains(lower(header),'recepta') OR contains(lower(header),'arrearagia') THEN 'income' END AS implied, count(*) AS n FROM h GROUP BY ALL")
def p19(spark, sf):
    h = table(spark, sf, "orders").select(F.element_at(F.array(*map(F.lit, ["Soluta Ordinaria", "Arrearagia recepta", "Recepta et soluta", "Misc", "stipendia"])), (F.col("o_orderkey") % 5 + 1).cast("int")).alias("header"))
    return h.groupBy("header", S.header_direction("header").alias("implied")).agg(F.count("*").alias("n"))


_NAMES = ["Worcester College", "City Bank", "Banbury", "Paris", "York Minster", "rector of Thame", "coal merchant"]


def _groups_sql(groups, default):
    return "CASE " + " ".join("WHEN " + " OR ".join(f"contains(x,'{w}')" for w in v) + f" THEN '{k}'" for k, v in groups.items()) + f" ELSE '{default}' END"


@query("p20_p21_groups", f"WITH n AS (SELECT lower({_NAMES!r}[c_custkey % 7 + 1]) AS x FROM customer) SELECT x, {_groups_sql(K.PLACE_CLUSTERS, 'other')} AS place, {_groups_sql(K.ROLES, 'unclassified')} AS role, count(*) AS n FROM n GROUP BY ALL")
def p20(spark, sf):
    n = table(spark, sf, "customer").select(F.lower(F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("c_custkey") % 7 + 1).cast("int"))).alias("x"))
    return n.groupBy("x", S.first_group("x", K.PLACE_CLUSTERS, "other").alias("place"), S.first_group("x", K.ROLES, "unclassified").alias("role")).agg(F.count("*").alias("n"))


@query("p24_p25_bands", "SELECT c_custkey, CASE WHEN c_acctbal >= 8000 THEN 'high' WHEN c_acctbal >= 2000 THEN 'middle' ELSE 'low' END AS band, round(c_acctbal/nullif(c_nationkey,0),6) AS per_nation FROM customer")
def p24(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", S.band("c_acctbal", [(8000, "high"), (2000, "middle")], "low").alias("band"), r6(S.ratio("c_acctbal", "c_nationkey"), "per_nation"))


@query("p27_json_replies", "SELECT event_id, CASE WHEN event_id % 3 < 2 THEN CAST(json_extract(props,'$.k') AS BIGINT) END AS k FROM events")
def p27(spark, sf):
    e = table(spark, sf, "events")
    reply = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Here:\n```json\n"), "props", F.lit("\n```"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("sure "), "props")).otherwise(F.concat("props", F.lit(" }")))
    return e.select("event_id", F.get_json_object(S.json_reply(reply), "$.k").cast("long").alias("k"))


@query("p28_currency_rules", _PARTS + " SELECT (p >= 0 AND s BETWEEN 0 AND 19 AND d BETWEEN 0 AND 11) AS valid, count(*) AS n FROM t GROUP BY ALL")
def p28(spark, sf):
    return _parts(spark, sf).groupBy(S.currency_valid(F.col("p"), F.col("s"), F.col("d")).alias("valid")).agg(F.count("*").alias("n"))


@query("f02_f03_filters", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderstatus IN ('F','O') AND o_orderpriority IS NOT NULL AND o_orderpriority <> '4-NOT SPECIFIED' GROUP BY ALL")
def f02(spark, sf):
    o = table(spark, sf, "orders").where(F.col("o_orderstatus").isin("F", "O") & F.col("o_orderpriority").isNotNull() & (F.col("o_orderpriority") != "4-NOT SPECIFIED"))
    return o.groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("f07_f08_arrears_confidence", "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE NOT coalesce(l_returnflag='R', false) AND l_discount >= 0.05 GROUP BY ALL")
def f07(spark, sf):
    li = table(spark, sf, "lineitem").where(~F.coalesce(F.col("l_returnflag") == "R", F.lit(False)) & F.col("l_discount").isNotNull() & (F.col("l_discount") >= 0.05))
    return li.groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query("f09_supported_years", "WITH k AS (SELECT month(o_orderdate) AS m, count(DISTINCT o_custkey) AS n FROM orders GROUP BY 1 HAVING count(DISTINCT o_custkey) >= 850) SELECT m, count(*) AS rows FROM orders JOIN k ON month(o_orderdate)=m GROUP BY m")
def f09(spark, sf):
    o = table(spark, sf, "orders").select(F.month("o_orderdate").cast("bigint").alias("m"), "o_custkey")
    k = o.groupBy("m").agg(F.countDistinct("o_custkey").alias("n")).where("n >= 850")
    return o.join(F.broadcast(k), "m", "left_semi").groupBy("m").agg(F.count("*").alias("rows"))  # twelve months


@query("f12_exact_match", _PARTS + " , a AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN regexp_replace(trim(pt),'\\.0$','')='0' THEN '' ELSE regexp_replace(trim(pt),'\\.0$','') END AS p1, CAST(p AS VARCHAR) AS p2 FROM t) SELECT l_orderkey, l_linenumber, l_partkey, p1 = p2 AS same FROM a")
def f12(spark, sf):
    return _parts(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", S.normal_value("pt").eqNullSafe(S.normal_value("p")).alias("same"))


@query("e05_amount_similarity", "SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN greatest(a,b)=0 THEN 1 ELSE greatest(0,1-abs(a-b)/greatest(a,b)) END,6) AS similarity FROM (SELECT *, l_quantity*10 AS a, (l_tax+l_discount)*1000 AS b FROM lineitem)")
def e05(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", r6(S.amount_similarity(F.col("l_quantity") * 10, (F.col("l_tax") + F.col("l_discount")) * 1000), "similarity"))
