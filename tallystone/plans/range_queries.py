"""Long series, quantiles of hot groups and block bootstraps: whole tables whose groups are too large for one task."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import long_series as L
from ..operators.quantiles import exact_quantiles
from ..operators.resampling import block_bootstrap
from .bindings import ENTRIES, entries, table
from .registry import query, r6

_SERIES = "(PARTITION BY event_type ORDER BY ts, event_id"


@query("w01_event_rolling", """SELECT event_id, round(CASE WHEN count(value) OVER a >= 3 THEN avg(value) OVER a END,6) AS seven, round(avg(value) OVER b,6) AS thirty, max(value) OVER b AS most FROM events
WINDOW a AS (ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), b AS (ORDER BY ts, event_id ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)""")  # fmt: skip
def w01_events(spark, sf):
    e = table(spark, sf, "events").select("event_id", "ts", "value")
    seven = lambda w: F.when(F.count("value").over(w.rowsBetween(-3, 3)) >= 3, F.avg("value").over(w.rowsBetween(-3, 3)))
    thirty = lambda f: lambda w: f("value").over(w.rowsBetween(-29, 0))
    e = L.moving(e, "ts", {"seven": seven, "thirty": thirty(F.avg), "most": thirty(F.max)}, 29, 3, ties=["event_id"])
    return e.select("event_id", r6("seven", "seven"), r6("thirty", "thirty"), "most")


@query("w04_event_steps", f"SELECT event_id, event_type, round(value-lag(value) OVER {_SERIES}),6) AS diff, round((value/nullif(lag(value) OVER {_SERIES}),0)-1)*100,6) AS pct FROM events")
def w04_events(spark, sf):
    e = L.steps(table(spark, sf, "events").select("event_id", "event_type", "ts", "value"), "ts", "value", ["event_type"], ["event_id"])
    return e.select("event_id", "event_type", r6("diff", "diff"), r6("pct", "pct"))


@query("w06_event_running", f"SELECT event_id, row_number() OVER {_SERIES}) AS place, round(sum(value) OVER {_SERIES} ROWS UNBOUNDED PRECEDING),4) AS total, last_value(CASE WHEN value > 90 THEN user_id END IGNORE NULLS) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_high FROM events")
def w06_events(spark, sf):
    e = table(spark, sf, "events").select("event_id", "event_type", "ts", "value", F.when(F.col("value") > 90, F.col("user_id")).alias("high"))
    e = L.running_sums(e, "ts", {"total": F.col("value"), "place": F.lit(1)}, ["event_type"], ["event_id"])
    e = L.last_known(e, "ts", "high", "last_high", ties=["event_id"])
    return e.select("event_id", "place", (F.round("total", 4) + F.lit(0.0)).alias("total"), "last_high")


@query("a04_direction_quantiles", ENTRIES + "SELECT direction, era, count(amount) AS n, round(quantile_cont(amount,0.1),6) AS p10, round(median(amount),6) AS p50, round(quantile_cont(amount,0.99),6) AS p99 FROM entries GROUP BY ALL")
def a04_entries(spark, sf):
    e = entries(spark, sf).select("direction", "era", "amount")
    n = e.groupBy("direction", "era").agg(F.count("amount").alias("n"))
    q = exact_quantiles(e, ["direction", "era"], "amount", [0.1, 0.5, 0.99]).select(F.col("direction").alias("d"), F.col("era").alias("e"), "q")
    both = n.join(q, F.col("direction").eqNullSafe(F.col("d")) & F.col("era").eqNullSafe(F.col("e")), "left")
    return both.select("direction", "era", "n", *[r6(F.col("q")[i], f"p{p}") for i, p in enumerate((10, 50, 99))])


@query("r05_block_bootstrap")
def r05_blocks(spark, sf):
    e = entries(spark, sf).where("direction in ('income', 'expenditure')")
    b = block_bootstrap(e, "page_id", "decade", F.when(F.col("direction") == "income", F.col("amount_w")).otherwise(0.0), F.col("amount_w"), bucket=F.col("page_id") % 256)
    return b.select("decade", *[r6(c, c) for c in ("estimate", "ci_lower", "ci_upper")], "n_draws")
