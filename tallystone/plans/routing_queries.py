"""Leave-one-out routing (G3-G10): the grids of 48, 36 and 20 settings over vectors and scores of all pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import leave_one_out as L
from ..operators import routing as G
from ..storage import stored
from .bindings import table
from .registry import query, r6

THRESHOLDS, KS = [0.005, 0.01, 0.02, 0.03], [3, 5, 7]
_PRIMES = {"v2_no_gemini": 7919, "v2_no_claude": 104729, "v2_no_gpt": 1299709, "v2_full": 15485863}


def _scores(spark, sf):
    """Four pipelines' scores of each vector's page; one ablation has no score for some pages."""
    v = F.col("vec_id")
    parts = [F.struct(F.lit(p).alias("pipeline"), F.lit(i).alias("ord"), F.when(~((v % 11 == 0) & F.lit(p == "v2_no_gpt")), 0.8 + (v * n) % 1000 / 5000.0).alias("score")) for i, (p, n) in enumerate(_PRIMES.items())]
    return table(spark, sf, "embeddings").select(v.alias("page"), F.inline(F.array(*parts))).where("score is not null")


def _target(spark, sf):
    e = F.col("embedding")
    return table(spark, sf, "embeddings").withColumn("y", e[3].cast("double") + 0.5 * e[10].cast("double") + (F.col("vec_id") * 7919) % 1000 / 4000.0)


_S = "s AS (SELECT vec_id AS page, unnest(['v2_no_gemini','v2_no_claude','v2_no_gpt','v2_full']) AS pipeline, unnest([0,1,2,3]) AS ord, unnest([0.8+(vec_id*7919%1000)/5000.0, 0.8+(vec_id*104729%1000)/5000.0, CASE WHEN vec_id%11=0 THEN NULL ELSE 0.8+(vec_id*1299709%1000)/5000.0 END, 0.8+(vec_id*15485863%1000)/5000.0])::DOUBLE AS score FROM embeddings), sc AS (SELECT * FROM s WHERE score IS NOT NULL), fs AS (SELECT page, score AS full_score FROM sc WHERE pipeline='v2_full')"
_DOT = "p AS (SELECT a.vec_id AS a, b.vec_id AS b, list_sum(list_transform(generate_series(1,64), lambda i: a.embedding[i]::DOUBLE*b.embedding[i]::DOUBLE)) AS sim FROM embeddings a JOIN embeddings b ON a.vec_id<>b.vec_id), near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(sim,9) DESC, b) AS rank FROM p) WHERE rank <= {k})"
_FEATURES = """x AS (SELECT vec_id, unnest(generate_series(0,63)) AS i, unnest(embedding)::DOUBLE AS x, embedding[4]::DOUBLE + 0.5*embedding[11]::DOUBLE + (vec_id*7919 % 1000)/4000.0::DOUBLE AS y FROM embeddings), r0 AS (SELECT i, abs(coalesce(corr(x,y),0)) AS r FROM x GROUP BY i),
r AS (SELECT i, r/sum(r) OVER () AS w FROM r0 WHERE round(r,9) >= 0.15 OR (SELECT max(round(r,9)) FROM r0) < 0.15), z AS (SELECT vec_id, i, (x-avg(x) OVER (PARTITION BY i))/stddev_pop(x) OVER (PARTITION BY i) AS z FROM x), f AS (SELECT vec_id, list(z*w ORDER BY i) AS v FROM z JOIN r USING (i) GROUP BY vec_id)"""
_L2 = "p AS (SELECT a.vec_id AS a, b.vec_id AS b, -sqrt(list_sum(list_transform(generate_series(1,len(a.v)), lambda i: pow(a.v[i]-b.v[i],2)))) AS sim FROM f a JOIN f b ON a.vec_id<>b.vec_id), near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(sim,9) DESC, b) AS rank FROM p) WHERE rank <= 7)"
_LABELS = "l AS (SELECT fs.page, e AS extractor, threshold, coalesce(CAST(round(full_score-sc.score,9) <= threshold AS INT),0) AS skip FROM fs CROSS JOIN (VALUES ('gemini'),('gpt'),('claude')) x(e) CROSS JOIN (VALUES (0.005::DOUBLE),(0.01::DOUBLE),(0.02::DOUBLE),(0.03::DOUBLE)) t(threshold) LEFT JOIN sc ON sc.page=fs.page AND sc.pipeline='v2_no_'||e), ks AS (SELECT unnest([3,5,7]) AS k)"
_CHOSEN = "g AS (SELECT a, threshold, k, conf, count(*) FILTER (skip) AS n_skipped, max(extractor) FILTER (skip) AS one, count(*) FILTER (pred=own) AS correct FROM d GROUP BY ALL), c AS (SELECT a, threshold, k, conf, n_skipped, correct, CASE WHEN n_skipped=1 THEN 'v2_no_'||one ELSE 'v2_full' END AS pipeline FROM g)"


def _evaluated(by: str, questions: int) -> str:
    return f""", j AS (SELECT c.*, coalesce(sc.score, full_score) AS final, full_score, CASE WHEN sc.score IS NULL OR c.pipeline='v2_full' THEN 3 ELSE 2 END AS calls FROM c LEFT JOIN sc ON sc.page=c.a AND sc.pipeline=c.pipeline JOIN fs ON fs.page=c.a),
m AS (SELECT {by}, count(*) AS n, sum(correct)/({questions}.0*count(*)) AS acc, avg(final)/avg(full_score) AS pres, 1-sum(calls)/(3.0*count(*)) AS cost, min(final) AS lo, stddev_samp(final) AS sd, count(*) FILTER (round(final-0.9*full_score,9)<0) AS failures FROM j GROUP BY ALL)
SELECT {by}, n, round(acc,6) AS accuracy, round(pres,6) AS preservation, round(cost,6) AS cost_reduction, round(lo,6) AS min_score, round(sd,6) AS score_std, failures, round(.3*acc+.4*pres+.3*cost,6) AS balanced, round(.2*acc+.5*pres+.3*cost,6) AS balanced_sweep FROM m"""


def _table(df, by: list[str]):
    return df.select(*by, "n", *[r6(c, c) for c in ("accuracy", "preservation", "cost_reduction", "min_score", "score_std")], "failures", r6("balanced", "balanced"), r6("balanced_sweep", "balanced_sweep"))


_G5 = "WITH " + ", ".join([_S, _FEATURES, _L2, _LABELS]) + """, n AS (SELECT extractor, threshold, sum(skip) AS pos, count(*) AS n FROM l GROUP BY ALL), q AS (SELECT l.page AS a, l.extractor, l.threshold, k, skip AS own, least(k, pos-skip, n-pos-(1-skip)) AS least FROM l JOIN n ON l.extractor=n.extractor AND l.threshold=n.threshold, ks),
v AS (SELECT q.a, q.extractor, q.threshold, q.k, q.own, avg(l.skip) AS p FROM q LEFT JOIN near ON near.a=q.a AND near.rank<=q.least LEFT JOIN l ON l.page=near.b AND l.extractor=q.extractor AND l.threshold=q.threshold GROUP BY ALL),
d AS (SELECT *, coalesce(CAST(round(p,9)>=0.5 AS INT),0) AS pred, coalesce(round(p,9)>=0.5 AND round(greatest(p,1-p),9)>=conf, false) AS skip FROM v, (VALUES (0.55::DOUBLE),(0.6::DOUBLE),(0.65::DOUBLE),(0.7::DOUBLE)) t(conf)), """ + _CHOSEN


def _euclidean(spark, sf):
    scores = _scores(spark, sf)
    near = stored(G.nearest(L.weighted_features(_target(spark, sf), "vec_id", "embedding", "y"), "vec_id", "v", max(KS), euclidean=True), "near")
    return scores, L.decided(L.nearest_votes(near, L.skip_labels(scores, THRESHOLDS), KS), [0.55, 0.6, 0.65, 0.7], cosine=False)


@query("g05_g10_euclidean_sweep", _G5 + _evaluated("threshold, k, conf", 3))
def g05_sweep(spark, sf):
    scores, chosen = _euclidean(spark, sf)
    by = ["threshold", "k", "conf"]
    return _table(L.evaluated(chosen, scores, by, 3), by)


@query("g08_decisions", _G5 + " SELECT a AS page, pipeline, n_skipped, correct FROM c WHERE threshold=0.03 AND k=7 AND conf=0.65")
def g08(spark, sf):
    _, chosen = _euclidean(spark, sf)
    return chosen.where("threshold = 0.03 and k = 7 and conf = 0.65").select(F.col("a").alias("page"), "pipeline", "n_skipped", "correct")


_G6 = "WITH " + ", ".join([_S, _DOT.format(k=7), _LABELS]) + """, v AS (SELECT near.a, l.extractor, l.threshold, k, coalesce(sum(greatest(sim,0)*skip)/nullif(sum(greatest(sim,0)),0), avg(skip)) AS x FROM near JOIN l ON l.page=near.b, ks WHERE rank<=k GROUP BY ALL),
d AS (SELECT v.*, conf, own.skip AS own, CAST(round(x,9)>=conf AS INT) AS pred, round(x,9)>=conf AS skip FROM v JOIN l own ON own.page=v.a AND own.extractor=v.extractor AND own.threshold=v.threshold, (VALUES (0.6::DOUBLE),(0.65::DOUBLE),(0.7::DOUBLE)) t(conf)), """ + _CHOSEN


@query("g06_g10_cosine_sweep", _G6 + _evaluated("threshold, k, conf", 3))
def g06_sweep(spark, sf):
    scores = _scores(spark, sf)
    near = stored(G.nearest(table(spark, sf, "embeddings"), "vec_id", "embedding", max(KS)), "near")
    chosen = L.decided(L.cosine_votes(near, L.skip_labels(scores, THRESHOLDS), KS), [0.6, 0.65, 0.7], cosine=True)
    by = ["threshold", "k", "conf"]
    return _table(L.evaluated(chosen, scores, by, 3), by)


_CASES = ", ".join(f"coalesce(sum(greatest(sim,0)) FILTER (best='{c}'),0)/nullif(sum(greatest(sim,0)),0)" for c in L.CANDIDATES)
_G7 = "WITH " + ", ".join([_S, _DOT.format(k=9)]) + f""", best AS (SELECT page, arg_min(pipeline, -score*100 + ord/1e6) AS best FROM sc GROUP BY page), w AS (SELECT a, k, list_transform([{_CASES}], lambda x: round(coalesce(x,0),9)) AS shares FROM near JOIN best ON best.page=near.b, (SELECT unnest([3,5,7,9]) AS k) ks WHERE rank<=k GROUP BY ALL),
c0 AS (SELECT a, k, conf, list_max(shares) AS confidence, ['v2_no_gemini','v2_no_claude','v2_no_gpt','v2_full'][list_position(shares, list_max(shares))] AS predicted FROM w, (VALUES (0.3::DOUBLE),(0.4::DOUBLE),(0.5::DOUBLE),(0.6::DOUBLE),(0.7::DOUBLE)) t(conf)),
c1 AS (SELECT *, CASE WHEN confidence < conf THEN 'v2_no_claude' ELSE predicted END AS pipeline FROM c0), c AS (SELECT c1.a, k, conf, c1.pipeline, CAST(CASE WHEN sc.score IS NULL THEN 'v2_full' ELSE c1.pipeline END = best AS INT) AS correct FROM c1 JOIN best ON best.page=c1.a LEFT JOIN sc ON sc.page=c1.a AND sc.pipeline=c1.pipeline)"""


@query("g07_g10_multiclass_sweep", _G7 + _evaluated("k, conf", 1))
def g07_sweep(spark, sf):
    scores = stored(_scores(spark, sf), "scores")
    near = stored(G.nearest(table(spark, sf, "embeddings"), "vec_id", "embedding", 9), "near")
    best = G.oracle_best(scores).select("page", "best")
    votes = L.best_votes(near, best, [3, 5, 7, 9], [0.3, 0.4, 0.5, 0.6, 0.7])
    known = votes.join(scores.select(F.col("page").alias("a"), "pipeline", F.lit(True).alias("known")), ["a", "pipeline"], "left")
    taken = F.when(F.col("known"), F.col("pipeline")).otherwise(L.FULL)
    chosen = known.join(best.withColumnRenamed("page", "a"), "a").withColumn("correct", (taken == F.col("best")).cast("int"))
    return _table(L.evaluated(chosen, scores, ["k", "conf"]), ["k", "conf"])


@query("g04_selected_features", "WITH " + _FEATURES + " SELECT vec_id, len(v) AS n_features, round(list_sum(list_transform(generate_series(1,len(v)), lambda i: i*v[i])),6) AS digest FROM f")
def g04_selected(spark, sf):
    f = L.weighted_features(_target(spark, sf), "vec_id", "embedding", "y")
    return f.select("vec_id", F.size("v").alias("n_features"), r6(F.aggregate(F.transform("v", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x), "digest"))
