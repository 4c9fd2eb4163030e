"""Composite ledger queries Q1-Q28 and Q38-Q40, and the sensitivity sweeps R6-R20."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import scalars as S
from ..operators import series as W
from ..operators import shares as A
from .bindings import ENTRIES, entries, sql_case
from .registry import query, r6

IE = ["income", "expenditure"]


def _balance(e, *keys):
    t = A.totals(e.where(F.col("direction").isin(*IE)), [*keys, "direction"], n="year_weight", s="amount_w", r="real_w")
    out = t.groupBy(*keys).pivot("direction", IE).agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("r").alias("r")).fillna(0.0)
    return out


@query("q01_direction_balance", ENTRIES + """SELECT year, round(coalesce(sum(year_weight) FILTER (direction='income'),0),6) AS n_income, round(coalesce(sum(year_weight) FILTER (direction='expenditure'),0),6) AS n_expenditure,
 round(coalesce(sum(amount_w) FILTER (direction='income'),0) / nullif(sum(amount_w),0),6) AS income_share, round(coalesce(sum(amount_w) FILTER (direction='income'),0) - coalesce(sum(amount_w) FILTER (direction='expenditure'),0),6) AS net_nominal,
 round(coalesce(sum(real_w) FILTER (direction='income'),0) - coalesce(sum(real_w) FILTER (direction='expenditure'),0),6) AS net_real FROM entries WHERE direction IN ('income','expenditure') GROUP BY year""")  # fmt: skip
def q01(spark, sf):
    b = _balance(entries(spark, sf), "year")
    return b.select("year", r6("income_n", "n_income"), r6("expenditure_n", "n_expenditure"), r6(S.ratio(F.col("income_s"), F.col("income_s") + F.col("expenditure_s")), "income_share"), r6(F.col("income_s") - F.col("expenditure_s"), "net_nominal"), r6(F.col("income_r") - F.col("expenditure_r"), "net_real"))


@query("q02_category_shares", ENTRIES + """, g AS (SELECT 'era' AS level, era AS bucket, category, sum(year_weight) n, sum(amount_w) s FROM entries GROUP BY ALL UNION ALL SELECT 'year', CAST(year AS VARCHAR), category, sum(year_weight), sum(amount_w) FROM entries GROUP BY ALL)
SELECT level, bucket, category, round(n,6) AS n_entries, round(n / sum(n) OVER (PARTITION BY level, bucket),6) AS entry_share, round(s / sum(s) OVER (PARTITION BY level, bucket),6) AS amount_share FROM g""")  # fmt: skip
def q02(spark, sf):
    e = entries(spark, sf).select("category", "year_weight", "amount_w", F.explode(F.array(F.struct(F.lit("era").alias("level"), F.col("era").alias("bucket")), F.struct(F.lit("year").alias("level"), F.col("year").cast("string").alias("bucket")))).alias("g"))
    t = A.totals(e.select("g.level", "g.bucket", "category", "year_weight", "amount_w"), ["level", "bucket", "category"], n="year_weight", s="amount_w")
    t = A.shares(t, ["level", "bucket"], entry_share="n", amount_share="s")
    return t.select("level", "bucket", "category", r6("n", "n_entries"), r6("entry_share", "entry_share"), r6("amount_share", "amount_share"))


def _language(spark, sf):
    t = A.totals(entries(spark, sf), ["year", "language"], n="year_weight")
    return A.shares(t, ["year"], share="n")


@query("q03_language_shares", ENTRIES + "SELECT year, language, round(sum(year_weight) / sum(sum(year_weight)) OVER (PARTITION BY year),6) AS share FROM entries GROUP BY year, language")
def q03(spark, sf):
    return _language(spark, sf).select("year", "language", r6("share", "share"))


@query("q03_language_crossover", ENTRIES + ", p AS (SELECT year, coalesce(sum(year_weight) FILTER (language='english'),0) e, coalesce(sum(year_weight) FILTER (language='latin'),0) l FROM entries GROUP BY year) SELECT min(year) AS crossover FROM p WHERE round(e,9) > round(l,9)")
def q03x(spark, sf):
    p = A.wide(_language(spark, sf), ["year"], "language", ["english", "latin"], F.sum("n"))
    return p.where(F.round("english", 9) > F.round("latin", 9)).agg(F.min("year").alias("crossover"))


@query("q04_period_shares", ENTRIES + "SELECT era, payment_period, round(sum(year_weight),6) AS n, round(sum(year_weight) / sum(sum(year_weight)) OVER (PARTITION BY era),6) AS share FROM entries WHERE payment_period IS NOT NULL AND payment_period <> 'unclear' GROUP BY era, payment_period")
def q04(spark, sf):
    t = A.totals(entries(spark, sf).where("payment_period <> 'unclear'"), ["era", "payment_period"], n="year_weight")
    return A.shares(t, ["era"], share="n").select("era", "payment_period", r6("n", "n"), r6("share", "share"))


@query("q05_arrears", ENTRIES + "SELECT year, round(coalesce(sum(year_weight) FILTER (is_arrears),0)/sum(year_weight),6) AS rate, round(coalesce(sum(amount_w) FILTER (is_arrears),0)/sum(amount_w),6) AS amount_share FROM entries GROUP BY year")
def q05(spark, sf):
    e = entries(spark, sf).groupBy("year").agg(F.sum(F.when(F.col("is_arrears"), F.col("year_weight")).otherwise(0.0)).alias("a"), F.sum("year_weight").alias("n"), F.sum(F.when(F.col("is_arrears"), F.col("amount_w")).otherwise(0.0)).alias("b"), F.sum("amount_w").alias("s"))
    return e.select("year", r6(S.ratio("a", "n"), "rate"), r6(S.ratio("b", "s"), "amount_share"))


@query("q06_names_by_era", ENTRIES + """, nm AS (SELECT e.*, trim(unnest(string_split(replace(p_name,' ','; '),';'))) AS name FROM entries e JOIN part ON part = p_partkey)
SELECT era, name, round(sum(year_weight),6) AS n, min(year) AS first_year, max(year) AS last_year FROM nm WHERE name <> '' GROUP BY era, name""")  # fmt: skip
def q06(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias("part"), F.regexp_replace("p_name", " ", "; ").alias("people"))
    e = entries(spark, sf).groupBy("part", "era", "year").agg(F.sum("year_weight").alias("w"))  # one row a part and year before the names are spread
    n = e.join(p, "part").select("era", "year", "w", F.explode(S.names("people")).alias("name"))
    return n.groupBy("era", "name").agg(F.sum("w").alias("n"), F.min("year").alias("first_year"), F.max("year").alias("last_year")).select("era", "name", r6("n", "n"), "first_year", "last_year")


@query("q07_category_direction_era", ENTRIES + "SELECT era, category, direction, round(sum(year_weight),6) AS n_entries, round(sum(amount_w),6) AS amount_sum FROM entries GROUP BY ALL")
def q07(spark, sf):
    return A.totals(entries(spark, sf), ["era", "category", "direction"], n="year_weight", s="amount_w").select("era", "category", "direction", r6("n", "n_entries"), r6("s", "amount_sum"))


_METRICS = ENTRIES + """, m AS (SELECT year, sum(amount_w) AS amount, sum(real_w) AS amount_real, coalesce(sum(amount_w) FILTER (direction='income'),0)/sum(amount_w) AS income_share, coalesce(sum(year_weight) FILTER (is_arrears),0)/sum(year_weight) AS arrears_rate FROM entries GROUP BY year),
long AS (UNPIVOT m ON amount, amount_real, income_share, arrears_rate INTO NAME metric VALUE x),
d AS (SELECT *, coalesce(x - lag(x) OVER (PARTITION BY metric ORDER BY year),0) AS diff FROM long),
md AS (SELECT *, median(diff) OVER (PARTITION BY metric) AS med FROM d),
z AS (SELECT *, median(abs(diff - med)) OVER (PARTITION BY metric) AS mad FROM md)"""  # fmt: skip


def _metrics(spark, sf):
    e = entries(spark, sf).groupBy("year").agg(
        F.sum("amount_w").alias("amount"), F.sum("real_w").alias("amount_real"), (F.sum(F.when(F.col("direction") == "income", F.col("amount_w")).otherwise(0.0)) / F.sum("amount_w")).alias("income_share"),
        (F.sum(F.when(F.col("is_arrears"), F.col("year_weight")).otherwise(0.0)) / F.sum("year_weight")).alias("arrears_rate"),
    )
    return e.unpivot(["year"], ["amount", "amount_real", "income_share", "arrears_rate"], "metric", "x")


@query("q08_change_points", _METRICS + " SELECT metric, year, round(diff,6) AS diff, round(0.6745*(diff-med)/mad,6) AS z FROM z WHERE abs(0.6745*(diff-med)/mad) >= 2.5")
def q08(spark, sf):
    return W.change_points(_metrics(spark, sf), "x", 2.5, by=["metric"]).select("metric", "year", r6("diff", "diff"), r6("z", "z"))


@query("r13_change_point_thresholds", _METRICS + """ SELECT t.threshold, metric, count(*) AS n_change_points, list(year ORDER BY year) AS years FROM z, (VALUES (2.0::DOUBLE),(2.5::DOUBLE),(3.0::DOUBLE)) t(threshold) WHERE abs(0.6745*(diff-med)/mad) >= t.threshold GROUP BY ALL""")
def r13(spark, sf):
    z = W.change_points(_metrics(spark, sf), "x", 2.0, by=["metric"])
    z = A.sweep(z, {"threshold": [2.0, 2.5, 3.0]}).where("abs(z) >= threshold")
    return z.groupBy("threshold", "metric").agg(F.count("*").alias("n_change_points"), F.array_sort(F.collect_list("year")).alias("years"))


@query("q09_yearly_summary", ENTRIES + """SELECT year, count(DISTINCT page_id) AS n_pages, round(sum(year_weight),6) AS n_rows, round(median(amount),6) AS median_amount, round(quantile_cont(amount,0.9),6) AS p90_amount, round(max(amount),6) AS max_amount,
 round(sum(amount_w),6) AS total, round(sum(real_w),6) AS total_real, round(sum(year_weight)/count(DISTINCT page_id),6) AS rows_per_page FROM entries GROUP BY year""")  # fmt: skip
def q09(spark, sf):
    e = entries(spark, sf).groupBy("year").agg(F.countDistinct("page_id").alias("n_pages"), F.sum("year_weight").alias("n"), F.median("amount").alias("m"), F.percentile("amount", F.lit(0.9)).alias("p"), F.max("amount").alias("x"), F.sum("amount_w").alias("t"), F.sum("real_w").alias("r"))
    return e.select("year", "n_pages", r6("n", "n_rows"), r6("m", "median_amount"), r6("p", "p90_amount"), r6("x", "max_amount"), r6("t", "total"), r6("r", "total_real"), r6(S.ratio("n", "n_pages"), "rows_per_page"))


@query("q11_era_stats", ENTRIES + """, y AS (SELECT year, era, sum(amount_w) t, sum(real_w) r FROM entries GROUP BY ALL), e AS (SELECT era, avg(t) t, avg(r) r, median(t) m, count(*) n FROM y GROUP BY era)
SELECT era, n AS n_years, round(t,6) AS mean_total, round(m,6) AS median_total, round(r,6) AS mean_real, round(t / (SELECT t FROM e WHERE era='pre_industrial'),6) AS nominal_ratio, round(r / (SELECT r FROM e WHERE era='pre_industrial'),6) AS real_ratio FROM e""")  # fmt: skip
def q11(spark, sf):
    y = A.totals(entries(spark, sf), ["year", "era"], t="amount_w", r="real_w")
    e = y.groupBy("era").agg(F.avg("t").alias("t"), F.avg("r").alias("r"), F.median("t").alias("m"), F.count("*").alias("n_years"))
    w = Window.partitionBy()  # one row an era
    base = lambda c: F.max(F.when(F.col("era") == "pre_industrial", F.col(c))).over(w)
    return e.select("era", "n_years", r6("t", "mean_total"), r6("m", "median_total"), r6("r", "mean_real"), r6(S.ratio(F.col("t"), base("t")), "nominal_ratio"), r6(S.ratio(F.col("r"), base("r")), "real_ratio"))


_CATSUM = ", ".join(f"coalesce(sum(real_w) FILTER (category='{c}'),0)/sum(real_w) AS {c}" for c in K.CATEGORIES)


def _income_mix(spark, sf, direction):
    e = entries(spark, sf).where(F.col("direction") == direction)
    p = A.wide(e, ["year"], "category", K.CATEGORIES, F.sum("real_w"))
    total = sum((F.col(c) for c in K.CATEGORIES), F.lit(0.0))
    return p.select("year", *[S.ratio(F.col(c), total).alias(c) for c in K.CATEGORIES])


@query("q13_revenue_diversification", ENTRIES + f""", s AS (SELECT year, {_CATSUM} FROM entries WHERE direction='income' GROUP BY year), h AS (SELECT *, {' + '.join(f'{c}*{c}' for c in K.CATEGORIES)} AS hhi FROM s)
SELECT year, round(land_rent,6) AS land_rent, round(hhi,6) AS hhi, round(CASE WHEN count(hhi) OVER w >= 3 THEN avg(hhi) OVER w END,6) AS hhi_rolling FROM h WINDOW w AS (ORDER BY year ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)""")  # fmt: skip
def q13(spark, sf):
    s = _income_mix(spark, sf, "income").withColumn("hhi", A.herfindahl([F.col(c) for c in K.CATEGORIES]))
    return s.select("year", r6("land_rent", "land_rent"), r6("hhi", "hhi"), r6(W.rolling("hhi", 2, 2, 3), "hhi_rolling"))


@query("q14_lead_lag", ENTRIES + f""", s AS (SELECT row_number() OVER (ORDER BY year) i, * FROM (SELECT year, {_CATSUM} FROM entries WHERE direction='income' GROUP BY year))
SELECT lag, round(corr(a.land_rent, b.financial),6) AS pearson_r, count(*) AS n FROM (SELECT unnest(generate_series(-10,10)) AS lag) l, s a JOIN s b ON b.i = a.i + lag GROUP BY lag HAVING count(*) >= 10""")  # fmt: skip
def q14(spark, sf):
    return W.lead_lag(_income_mix(spark, sf, "income"), "land_rent", "financial").where("n >= 10").select(F.col("lag").cast("bigint").alias("lag"), r6("pearson_r", "pearson_r"), "n")


#: The two-sided probability of Student's t with v degrees of freedom by its finite series, as SQL over r (a correlation) and v.
_P_VALUE = """CASE WHEN v < 1 THEN NULL WHEN abs(r) >= 1 THEN 0 WHEN v % 2 = 0 THEN 1 - abs(r) * list_sum(list_transform(generate_series(0, v // 2 - 1), lambda k: exp(lgamma(k + 0.5) - lgamma(k + 1) - lgamma(0.5)) * pow(1 - r * r, k)))
  ELSE 1 - 2 / pi() * (asin(abs(r)) + CASE WHEN v = 1 THEN 0 ELSE abs(r) * sqrt(1 - r * r) * list_sum(list_transform(generate_series(0, (v - 3) // 2), lambda k: exp(lgamma(k + 1) - lgamma(k + 1.5) + lgamma(0.5) - ln(2)) * pow(1 - r * r, k))) END) END"""


@query("a14_lead_lag_significance", ENTRIES + f""", s AS (SELECT row_number() OVER (ORDER BY year) i, * FROM (SELECT year, {_CATSUM} FROM entries WHERE direction='income' GROUP BY year)), c AS (SELECT lag, corr(a.land_rent, b.financial) AS r, count(*) AS n, CAST(count(*) - 2 AS BIGINT) AS v FROM (SELECT unnest(generate_series(-10,10)) AS lag) l, s a JOIN s b ON b.i = a.i + lag GROUP BY lag)
SELECT lag, round(r,6) AS pearson_r, round({_P_VALUE},6) AS p_value, CASE WHEN lag=0 THEN 'SIMULTANEOUS' WHEN lag>0 THEN 'LEADS' ELSE 'REACTIVE' END AS verdict FROM c""")  # fmt: skip
def a14(spark, sf):
    out = W.lead_lag(_income_mix(spark, sf, "income"), "land_rent", "financial")
    return out.select(F.col("lag").cast("bigint").alias("lag"), r6("pearson_r", "pearson_r"), r6(W.pearson_p("pearson_r", F.col("n").cast("double")), "p_value"), F.when(F.col("lag") == 0, "SIMULTANEOUS").when(F.col("lag") > 0, "LEADS").otherwise("REACTIVE").alias("verdict"))


@query("w08_percent_change", ENTRIES + """, s AS (SELECT year, CASE WHEN year % 5 = 0 THEN NULL WHEN year % 7 = 0 THEN 0 ELSE sum(amount_w) END AS x FROM entries GROUP BY year), f AS (SELECT year, last_value(x IGNORE NULLS) OVER (ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS x, last_value(x IGNORE NULLS) OVER (ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM s)
SELECT year, round(CASE WHEN b = 0 THEN NULL ELSE (x/nullif(b,0)-1)*100 END,6) AS change, coalesce(b = 0 AND x > 0, false) AS infinite, coalesce(b = 0 AND x = 0, false) AS undefined FROM f""")  # fmt: skip
def w08(spark, sf):
    s = entries(spark, sf).groupBy("year").agg(F.sum("amount_w").alias("x")).withColumn("x", F.when(F.col("year") % 5 == 0, None).when(F.col("year") % 7 == 0, 0.0).otherwise(F.col("x")))
    c = s.select("year", W.percent_change("x").alias("c"))
    finite = F.when(~F.isnan("c") & (F.abs("c") != float("inf")), F.col("c"))
    return c.select("year", r6(finite, "change"), F.coalesce(F.col("c") == float("inf"), F.lit(False)).alias("infinite"), F.coalesce(F.isnan("c"), F.lit(False)).alias("undefined"))


@query("q15_rolling_correlation", ENTRIES + f""", s AS (SELECT year, {_CATSUM} FROM entries WHERE direction='income' GROUP BY year), lim AS (SELECT min(year) lo, max(year) hi FROM s)
SELECT start, round(corr(land_rent, financial),6) AS r, count(*) AS n FROM (SELECT unnest(generate_series(lo, hi - 10)) AS start FROM lim) g JOIN s ON year BETWEEN start AND start + 9 GROUP BY start HAVING count(*) >= 5""")  # fmt: skip
def q15(spark, sf):
    return W.window_corr(_income_mix(spark, sf, "income"), "land_rent", "financial").select(F.col("start").cast("bigint").alias("start"), r6("r", "r"), "n")


@query("q16_expenditure_reallocation", ENTRIES + f""", s AS (SELECT year, {_CATSUM} FROM entries WHERE direction='expenditure' GROUP BY year), l AS (SELECT CASE WHEN year < 1780 THEN 'pre' WHEN year >= 1860 THEN 'late' END AS era4, category, x FROM (UNPIVOT s ON {', '.join(K.CATEGORIES)} INTO NAME category VALUE x)), g AS (SELECT category, avg(x) FILTER (era4='pre') a, avg(x) FILTER (era4='late') b FROM l GROUP BY category)
SELECT category, round(a,6) AS pre_avg, round(b,6) AS late_avg, round((b-a)/nullif(a,0)*100,6) AS pct_vs_pre FROM g""")  # fmt: skip
def q16(spark, sf):
    s = _income_mix(spark, sf, "expenditure").unpivot(["year"], K.CATEGORIES, "category", "x").withColumn("e", S.era("year", K.ERAS4))
    p = A.wide(s, ["category"], "e", ["pre_industrial", "late_industrial"], F.avg("x"), fill=None)
    return p.select("category", r6("pre_industrial", "pre_avg"), r6("late_industrial", "late_avg"), r6(S.ratio(F.col("late_industrial") - F.col("pre_industrial"), F.col("pre_industrial")) * 100, "pct_vs_pre"))


@query("a15_ols_significance", ENTRIES + f""", s AS (SELECT year, {_CATSUM} FROM entries WHERE direction='expenditure' GROUP BY year), d AS (SELECT (educational+salary_stipend) - lag(educational+salary_stipend) OVER (ORDER BY year) AS m, (ecclesiastical+domestic) - lag(ecclesiastical+domestic) OVER (ORDER BY year) AS t FROM s), c AS (SELECT corr(m,t) AS r, regr_slope(m,t) AS slope, CAST(count(m) - 2 AS BIGINT) AS v FROM d WHERE m IS NOT NULL)
SELECT round(slope,6) AS slope, round({_P_VALUE},6) AS p_value FROM c""")  # fmt: skip
def a15(spark, sf):
    s = _income_mix(spark, sf, "expenditure").select("year", (F.col("educational") + F.col("salary_stipend")).alias("modern"), (F.col("ecclesiastical") + F.col("domestic")).alias("trad"))
    return W.ols(s.select(W.difference("modern").alias("m"), W.difference("trad").alias("t")), "m", "t").select(r6("slope", "slope"), r6("p_value", "p_value"))


@query("q17_ols", ENTRIES + f""", s AS (SELECT year, {_CATSUM} FROM entries WHERE direction='expenditure' GROUP BY year), d AS (SELECT (educational+salary_stipend) - lag(educational+salary_stipend) OVER (ORDER BY year) AS m, (ecclesiastical+domestic) - lag(ecclesiastical+domestic) OVER (ORDER BY year) AS t FROM s)
SELECT round(regr_slope(m,t),6) AS slope, round(regr_intercept(m,t),6) AS intercept, round(corr(m,t),6) AS r, count(m) AS n, round(sqrt((1-corr(m,t)*corr(m,t))*regr_syy(m,t)/((count(m)-2)*regr_sxx(m,t))),6) AS stderr FROM d WHERE m IS NOT NULL""")  # fmt: skip
def q17(spark, sf):
    s = _income_mix(spark, sf, "expenditure").select("year", (F.col("educational") + F.col("salary_stipend")).alias("modern"), (F.col("ecclesiastical") + F.col("domestic")).alias("trad"))
    d = s.select(W.difference("modern").alias("m"), W.difference("trad").alias("t"))
    return W.ols(d, "m", "t").select(r6("slope", "slope"), r6("intercept", "intercept"), r6("r", "r"), "n", r6("stderr", "stderr"))


_STRESS = ENTRIES + """, a AS (SELECT year, coalesce(sum(amount_w) FILTER (is_arrears),0)/nullif(sum(amount_w),0) AS rate FROM entries WHERE category='land_rent' GROUP BY year), b AS (SELECT year, coalesce(sum(amount_w) FILTER (category='land_rent'),0)/sum(amount_w) AS share FROM entries WHERE direction='income' GROUP BY year),
s AS (SELECT year, rate, share, rate*share AS stress FROM a FULL JOIN b USING (year))"""  # fmt: skip


def _stress(spark, sf):
    e = entries(spark, sf)
    part = lambda c: F.sum(F.when(c, F.col("amount_w")).otherwise(0.0))
    a = e.where("category = 'land_rent'").groupBy("year").agg(S.ratio(part(F.col("is_arrears")), F.sum("amount_w")).alias("rate"))
    b = e.where("direction = 'income'").groupBy("year").agg(S.ratio(part(F.col("category") == "land_rent"), F.sum("amount_w")).alias("share"))
    return a.join(b, "year", "full").withColumn("stress", F.col("rate") * F.col("share"))


@query("q18_stress_index", _STRESS + " SELECT year, round(rate,6) AS rate, round(share,6) AS share, round(stress,6) AS stress FROM s")
def q18(spark, sf):
    return _stress(spark, sf).select("year", r6("rate", "rate"), r6("share", "share"), r6("stress", "stress"))


@query("q19_stress_anomalies", _STRESS + ", m AS (SELECT *, median(stress) OVER () AS med FROM s WHERE stress IS NOT NULL), z AS (SELECT *, median(abs(stress-med)) OVER () AS mad FROM m) SELECT year, round(0.6745*(stress-med)/mad,6) AS z FROM z WHERE abs(0.6745*(stress-med)/mad) > 2")
def q19(spark, sf):
    return W.robust_z(_stress(spark, sf).where("stress is not null"), "stress").where("abs(z) > 2").select("year", r6("z", "z"))


_MOD = "CASE payment_period " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in K.MODERNITY.items()) + " END"


@query("q20_payment_modernity", ENTRIES + f""", x AS (SELECT *, {_MOD} AS m FROM entries), y AS (SELECT year, sum(m*year_weight)/sum(year_weight) AS idx FROM x WHERE m IS NOT NULL GROUP BY year)
SELECT year, round(idx + 1e-9,6) AS modernity, round(CASE WHEN count(idx) OVER w >= 3 THEN avg(idx) OVER w END + 1e-9,6) AS rolling FROM y WINDOW w AS (ORDER BY year ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)""")  # fmt: skip
def q20(spark, sf):
    e = entries(spark, sf).withColumn("m", S.lookup("payment_period", K.MODERNITY)).where("m is not null")
    y = e.groupBy("year").agg(A.weighted_mean(F.col("m"), F.col("year_weight")).alias("idx"))
    # few weights give exact halves of the last digit: both sides round those up
    return y.select("year", r6(F.col("idx") + 1e-9, "modernity"), r6(W.rolling("idx", 3, 3, 3) + 1e-9, "rolling"))


_PSUM = ", ".join(f"greatest(coalesce(sum(year_weight) FILTER (payment_period='{p}'),0),1e-9) AS {p}" for p in K.PERIODS[:-1])
_PTOT = "(" + "+".join(K.PERIODS[:-1]) + ")"


@query("a19_period_entropy", ENTRIES + f", p AS (SELECT era4, {_PSUM} FROM entries WHERE payment_period <> 'unclear' GROUP BY era4) SELECT era4 AS era, round({'+'.join(f'-{x}/{_PTOT}*ln({x}/{_PTOT})' for x in K.PERIODS[:-1])},6) AS entropy FROM p")
def a19(spark, sf):
    p = A.wide(entries(spark, sf).where("payment_period <> 'unclear'"), ["era4"], "payment_period", K.PERIODS[:-1], F.sum("year_weight"))
    return p.select(F.col("era4").alias("era"), r6(A.entropy([F.col(x) for x in K.PERIODS[:-1]]), "entropy"))


@query("q20_modernity_by_category_era", ENTRIES + f", x AS (SELECT *, {_MOD} AS m FROM entries) SELECT era4 AS era, category, round(sum(m*year_weight)/sum(year_weight),6) AS modernity_score FROM x WHERE m IS NOT NULL GROUP BY era4, category")
def q20b(spark, sf):
    e = entries(spark, sf).withColumn("m", S.lookup("payment_period", K.MODERNITY)).where("m is not null")
    return e.groupBy(F.col("era4").alias("era"), "category").agg(r6(A.weighted_mean(F.col("m"), F.col("year_weight")), "modernity_score"))


_PLACE = {"oxford_local": ["ring", "bolt"], "london": ["widget", "gear"], "other_england": ["red", "blue"]}
_PLACESQL = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(p_name),'{w}')" for w in v) + f" THEN '{k}'" for k, v in _PLACE.items()) + " ELSE 'other' END"


@query("q25_place_category", ENTRIES + f", p AS (SELECT e.*, {_PLACESQL} AS place FROM entries e JOIN part ON part=p_partkey) SELECT place, category, round(sum(real_w),6) AS amount FROM p GROUP BY ALL")
def q25(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias("part"), S.first_group("p_name", _PLACE, "other").alias("place"))
    t = entries(spark, sf).groupBy("part", "category").agg(F.sum("real_w").alias("a"))
    return t.join(p, "part").groupBy("place", "category").agg(r6(F.sum("a"), "amount"))


@query("q25_london_share", ENTRIES + f", p AS (SELECT e.*, {_PLACESQL} AS place FROM entries e JOIN part ON part=p_partkey WHERE direction='expenditure') SELECT year, round(coalesce(sum(real_w) FILTER (place='london'),0)/sum(real_w),6) AS london_share FROM p GROUP BY year")
def q25b(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias("part"), S.first_group("p_name", _PLACE, "other").alias("place"))
    t = entries(spark, sf).where("direction = 'expenditure'").groupBy("part", "year").agg(F.sum("real_w").alias("a"))
    return t.join(p, "part").groupBy("year").agg(r6(S.ratio(F.sum(F.when(F.col("place") == "london", F.col("a")).otherwise(0.0)), F.sum("a")), "london_share"))


@query("q26_persistence", ENTRIES + "SELECT part, min(year) AS first_year, max(year) AS last_year, max(year)-min(year) AS span, round(sum(year_weight),6) AS n FROM entries GROUP BY part HAVING sum(year_weight) >= 1")
def q26(spark, sf):
    t = entries(spark, sf).groupBy("part").agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.sum("year_weight").alias("n")).where("n >= 1")
    return t.select("part", "first_year", "last_year", (F.col("last_year") - F.col("first_year")).alias("span"), r6("n", "n"))


@query("q28_educational_growth", ENTRIES + """, y AS (SELECT year, sum(real_w) AS x FROM entries WHERE category='educational' GROUP BY year)
SELECT year, round(x,6) AS total_real, round((x/nullif(lag(x) OVER (ORDER BY year),0)-1)*100,6) AS yoy FROM y""")  # fmt: skip
def q28(spark, sf):
    y = A.totals(entries(spark, sf).where("category = 'educational'"), ["year"], x="real_w")
    return y.select("year", r6("x", "total_real"), r6(W.change("x"), "yoy"))


@query("q28_top_jumps", ENTRIES + """, y AS (SELECT year, sum(real_w) AS x FROM entries WHERE category='educational' GROUP BY year), g AS (SELECT year, (x/nullif(lag(x) OVER (ORDER BY year),0)-1)*100 AS yoy FROM y)
SELECT year, round(yoy,6) AS yoy FROM g WHERE yoy IS NOT NULL ORDER BY g.yoy DESC, year LIMIT 10""")  # fmt: skip
def q28b(spark, sf):
    y = A.totals(entries(spark, sf).where("category = 'educational'"), ["year"], x="real_w").select("year", W.change("x").alias("g"))
    return y.where("g is not null").orderBy(F.desc("g"), "year").limit(10).select("year", r6("g", "yoy"))


@query("a21_cagr", ENTRIES + """, y AS (SELECT year, era4, sum(real_w) AS x FROM entries WHERE category='educational' GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY era4 ORDER BY year) i, row_number() OVER (PARTITION BY era4 ORDER BY year DESC) j FROM y),
g AS (SELECT era4, avg(x) FILTER (i<=5) a, avg(x) FILTER (j<=5) b, count(*) n, CASE era4 WHEN 'pre_industrial' THEN 79 WHEN 'transition' THEN 39 WHEN 'early_industrial' THEN 39 ELSE 40 END AS d FROM n GROUP BY era4)
SELECT era4 AS era, round(CASE WHEN n>=5 AND a>0 AND b>0 THEN pow(b/a,1.0/d)-1 END,6) AS cagr FROM g""")  # fmt: skip
def a21(spark, sf):
    y = A.totals(entries(spark, sf).where("category = 'educational'"), ["year", "era4"], x="real_w")
    bounds = {"pre_industrial": (1700, 1779), "transition": (1780, 1819), "early_industrial": (1820, 1859), "late_industrial": (1860, 1900)}
    out = W.cagr(y, "x", "era4", S.lookup("era4", {k: v[0] for k, v in bounds.items()}), S.lookup("era4", {k: v[1] for k, v in bounds.items()}))
    return out.select(F.col("era4").alias("era"), r6("cagr", "cagr"))


@query("q38_summary", ENTRIES + "SELECT direction, round(sum(year_weight),6) AS n, round(100*sum(year_weight)/sum(sum(year_weight)) OVER (),6) AS pct FROM entries GROUP BY direction")
def q38(spark, sf):
    t = A.totals(entries(spark, sf), ["direction"], n="year_weight")
    return A.shares(t, [], s="n").select("direction", r6("n", "n"), r6(F.col("s") * 100, "pct"))


@query("q39_page_sheet", ENTRIES + "SELECT page_id, count(*) AS total_rows, count(*) FILTER (direction='income') AS n_income, count(*) FILTER (direction='expenditure') AS n_expenditure FROM rows_ GROUP BY page_id")
def q39(spark, sf):
    from .bindings import rows

    return rows(spark, sf).groupBy("page_id").agg(F.count("*").alias("total_rows"), F.count_if(F.col("direction") == "income").alias("n_income"), F.count_if(F.col("direction") == "expenditure").alias("n_expenditure"))


# --- sensitivity sweeps: one scan for all settings -------------------------------------------------------------------

_CONF = "(VALUES (0.0::DOUBLE),(0.3::DOUBLE),(0.6::DOUBLE)) t(threshold)"


@query("r08_era_schemes", ENTRIES + """, s AS (SELECT 'baseline' AS scheme, CASE WHEN year<1760 THEN 'pre_industrial' WHEN year<=1840 THEN 'industrial' ELSE 'post_industrial' END AS bucket, category, amount_w FROM entries UNION ALL
 SELECT 'alt_a', CASE WHEN year<1750 THEN 'pre_industrial' WHEN year<=1850 THEN 'industrial' ELSE 'post_industrial' END, category, amount_w FROM entries UNION ALL
 SELECT 'alt_b', CASE WHEN year<1780 THEN 'pre_industrial' WHEN year<=1840 THEN 'industrial' ELSE 'post_industrial' END, category, amount_w FROM entries UNION ALL
 SELECT 'alt_c', CASE WHEN year<1760 THEN 'pre_industrial' WHEN year<=1800 THEN 'early_industrial' WHEN year<=1840 THEN 'late_industrial' ELSE 'post_industrial' END, category, amount_w FROM entries)
SELECT scheme, bucket AS era, category, round(sum(amount_w)/sum(sum(amount_w)) OVER (PARTITION BY scheme, bucket),6) AS share FROM s GROUP BY scheme, bucket, category""")  # fmt: skip
def r08(spark, sf):
    y = A.totals(entries(spark, sf), ["year", "category"], s="amount_w")  # one row a year and category before the schemes multiply it
    y = A.sweep(y, {"scheme": list(K.ERA_SCHEMES)})
    era = F.coalesce(*[F.when(F.col("scheme") == k, S.era("year", v)) for k, v in K.ERA_SCHEMES.items()])
    t = A.totals(y.withColumn("era", era), ["scheme", "era", "category"], s="s")
    return A.shares(t, ["scheme", "era"], share="s").select("scheme", "era", "category", r6("share", "share"))


@query("r09_deflators", ENTRIES + f""", s AS (SELECT decade, direction, amount_w, year, unnest(['nominal','main','alt']) AS deflator FROM entries WHERE direction IN ('income','expenditure')),
v AS (SELECT decade, deflator, direction, amount_w / CASE deflator WHEN 'nominal' THEN 1 WHEN 'main' THEN {sql_case('year', K.PRICE_ANCHORS)}/100 ELSE {sql_case('year', K.PRICE_ANCHORS_ALT)}/100 END AS x FROM s)
SELECT decade, deflator, round(coalesce(sum(x) FILTER (direction='income'),0)/sum(x),6) AS income_share, round(coalesce(sum(x) FILTER (direction='income'),0)-coalesce(sum(x) FILTER (direction='expenditure'),0),6) AS net_real FROM v GROUP BY decade, deflator""")  # fmt: skip
def r09(spark, sf):
    y = A.totals(entries(spark, sf).where(F.col("direction").isin(*IE)), ["year", "decade", "direction"], s="amount_w")
    y = A.sweep(y, {"deflator": ["nominal", "main", "alt"]})
    index = F.when(F.col("deflator") == "nominal", 100.0).when(F.col("deflator") == "main", S.price_index("year")).otherwise(S.price_index("year", K.PRICE_ANCHORS_ALT))
    p = A.wide(y.withColumn("x", F.col("s") / (index / 100)), ["decade", "deflator"], "direction", IE, F.sum("x"))
    return p.select("decade", "deflator", r6(S.ratio(F.col("income"), F.col("income") + F.col("expenditure")), "income_share"), r6(F.col("income") - F.col("expenditure"), "net_real"))


@query("r10_year_weights", ENTRIES + """, e AS (SELECT *, min(year) OVER (PARTITION BY page_id, row_index, part) lo, max(year) OVER (PARTITION BY page_id, row_index, part) hi FROM entries), s AS (SELECT *, unnest(['equal','first','last']) AS mode FROM e),
v AS (SELECT mode, era, category, CASE mode WHEN 'equal' THEN amount*year_weight WHEN 'first' THEN CASE WHEN year=lo THEN amount ELSE 0 END ELSE CASE WHEN year=hi THEN amount ELSE 0 END END AS x FROM s)
SELECT mode, era, category, round(sum(x)/sum(sum(x)) OVER (PARTITION BY mode, era),6) AS share FROM v GROUP BY mode, era, category""")  # fmt: skip
def r10(spark, sf):
    from .bindings import rows

    r = rows(spark, sf).withColumn("year", F.explode("years"))
    r = A.sweep(r, {"mode": ["equal", "first", "last"]})
    x = F.when(F.col("mode") == "equal", F.col("amount") / F.size("years")).when(F.col("mode") == "first", F.when(F.col("year") == F.element_at("years", 1), F.col("amount")).otherwise(0.0)).otherwise(F.when(F.col("year") == F.element_at("years", -1), F.col("amount")).otherwise(0.0))
    t = A.totals(r.withColumn("era", S.era("year")).withColumn("x", x), ["mode", "era", "category"], s="x")
    return A.shares(t, ["mode", "era"], share="s").select("mode", "era", "category", r6("share", "share"))


@query("r11_arrears", ENTRIES + """, s AS (SELECT *, unnest([true,false]) AS exclude_arrears FROM entries) SELECT decade, exclude_arrears, round(coalesce(sum(amount_w) FILTER (direction='income'),0)/sum(amount_w),6) AS income_share FROM s WHERE direction IN ('income','expenditure') AND NOT (exclude_arrears AND coalesce(is_arrears,false)) GROUP BY decade, exclude_arrears""")
def r11(spark, sf):
    y = A.totals(entries(spark, sf).where(F.col("direction").isin(*IE)).withColumn("late", F.coalesce("is_arrears", F.lit(False))), ["decade", "direction", "late"], s="amount_w")
    y = A.sweep(y, {"exclude_arrears": [True, False]}).where("not (exclude_arrears and late)")
    p = A.wide(y, ["decade", "exclude_arrears"], "direction", IE, F.sum("s"))
    return p.select("decade", "exclude_arrears", r6(S.ratio(F.col("income"), F.col("income") + F.col("expenditure")), "income_share"))


@query("r14_confidence", ENTRIES + f"SELECT threshold AS confidence_threshold, era, count(*) AS n_entries, round(coalesce(sum(amount_w) FILTER (category='land_rent'),0)/sum(amount_w),6) AS land_rent_share FROM entries, {_CONF} WHERE confidence IS NOT NULL AND round(confidence,9) >= threshold GROUP BY ALL")
def r14(spark, sf):
    e = entries(spark, sf).where("confidence is not null").withColumn("level", F.floor(F.round(F.col("confidence") * 10, 6)) / 10)
    e = e.groupBy("level", "era").agg(F.count("*").alias("n"), F.sum(F.when(F.col("category") == "land_rent", F.col("amount_w")).otherwise(0.0)).alias("a"), F.sum("amount_w").alias("s"))
    e = A.sweep(e, {"confidence_threshold": [0.0, 0.3, 0.6]}).where("round(level, 6) >= confidence_threshold")
    g = e.groupBy("confidence_threshold", "era").agg(F.sum("n").alias("n_entries"), F.sum("a").alias("a"), F.sum("s").alias("s"))
    return g.select("confidence_threshold", "era", "n_entries", r6(S.ratio("a", "s"), "land_rent_share"))


@query("r15_sparse_years", ENTRIES + """, y AS (SELECT year, count(DISTINCT page_id) AS pages FROM entries GROUP BY year) SELECT k AS min_pages, era, count(DISTINCT e.year) AS n_years, round(coalesce(sum(amount_w) FILTER (category='land_rent'),0)/sum(amount_w),6) AS land_rent_share FROM entries e JOIN y USING (year), (VALUES (1),(100),(180),(200)) t(k) WHERE pages >= k GROUP BY k, era""")
def r15(spark, sf):
    y = entries(spark, sf).groupBy("year", "era").agg(F.countDistinct("page_id").alias("pages"), F.sum(F.when(F.col("category") == "land_rent", F.col("amount_w")).otherwise(0.0)).alias("a"), F.sum("amount_w").alias("s"))
    g = A.sweep(y, {"min_pages": [1, 100, 180, 200]}).where("pages >= min_pages").groupBy("min_pages", "era").agg(F.count("*").alias("n_years"), F.sum("a").alias("a"), F.sum("s").alias("s"))
    return g.select("min_pages", "era", "n_years", r6(S.ratio("a", "s"), "land_rent_share"))


@query("r16_financial_share", ENTRIES + f"SELECT threshold, era, round(coalesce(sum(year_weight) FILTER (category='financial'),0)/sum(year_weight),6) AS financial_share FROM entries, {_CONF} WHERE confidence IS NOT NULL AND round(confidence,9) >= threshold GROUP BY ALL")
def r16(spark, sf):
    e = entries(spark, sf).where("confidence is not null").withColumn("level", F.round("confidence", 6))
    e = e.groupBy("level", "era").agg(F.sum(F.when(F.col("category") == "financial", F.col("year_weight")).otherwise(0.0)).alias("a"), F.sum("year_weight").alias("s"))
    g = A.sweep(e, {"threshold": [0.0, 0.3, 0.6]}).where("level >= threshold").groupBy("threshold", "era").agg(F.sum("a").alias("a"), F.sum("s").alias("s"))
    return g.select("threshold", "era", r6(S.ratio("a", "s"), "financial_share"))


@query("r18_language_timing", ENTRIES + ", d AS (SELECT decade, coalesce(sum(year_weight) FILTER (language='english'),0)/sum(year_weight) AS share FROM entries GROUP BY decade) SELECT min(decade) FILTER (round(share,9) >= 0.33) AS first_decade, round(max(share),6) AS max_share FROM d")
def r18(spark, sf):
    d = entries(spark, sf).groupBy("decade").agg((F.sum(F.when(F.col("language") == "english", F.col("year_weight")).otherwise(0.0)) / F.sum("year_weight")).alias("s"))
    return d.agg(F.min(F.when(F.round("s", 9) >= 0.33, F.col("decade"))).alias("first_decade"), r6(F.max("s"), "max_share"))


@query("r19_balance", ENTRIES + """SELECT era, round(sum(year_weight) FILTER (direction='income')/sum(year_weight),6) AS entry_income_share, round(sum(amount_w) FILTER (direction='income')/sum(amount_w),6) AS amount_income_share, round(sum(amount_w) FILTER (direction='income')/sum(amount_w) FILTER (direction='expenditure'),6) AS balance_ratio FROM entries WHERE direction IN ('income','expenditure') GROUP BY era""")
def r19(spark, sf):
    b = _balance(entries(spark, sf), "era")
    return b.select("era", r6(S.ratio(F.col("income_n"), F.col("income_n") + F.col("expenditure_n")), "entry_income_share"), r6(S.ratio(F.col("income_s"), F.col("income_s") + F.col("expenditure_s")), "amount_income_share"), r6(S.ratio("income_s", "expenditure_s"), "balance_ratio"))


@query("r20_delta_report", ENTRIES + """, g AS (SELECT era, exclude, coalesce(sum(amount_w) FILTER (category='land_rent'),0)/sum(amount_w) AS x FROM (SELECT *, unnest([true,false]) AS exclude FROM entries) WHERE NOT (exclude AND coalesce(is_arrears,false)) GROUP BY era, exclude)
SELECT a.era, round((a.x-b.x)*100,6) AS delta_pp, CASE WHEN abs(a.x-b.x)*100 <= 2 THEN 'robust' WHEN abs(a.x-b.x)*100 <= 5 THEN 'moderate' ELSE 'sensitive' END AS verdict FROM g a JOIN g b ON a.era=b.era AND a.exclude AND NOT b.exclude""")  # fmt: skip
def r20(spark, sf):
    e = entries(spark, sf).withColumn("late", F.coalesce("is_arrears", F.lit(False)))
    part = lambda c: F.sum(F.when(c, F.col("amount_w")).otherwise(0.0))
    land = F.col("category") == "land_rent"
    g = e.groupBy("era").agg(S.ratio(part(land & ~F.col("late")), part(~F.col("late"))).alias("x"), S.ratio(part(land), F.sum("amount_w")).alias("b"))
    d = F.abs(F.col("x") - F.col("b")) * 100
    return g.select("era", r6((F.col("x") - F.col("b")) * 100, "delta_pp"), F.when(d <= 2, "robust").when(d <= 5, "moderate").otherwise("sensitive").alias("verdict"))
