"""Clusters and projections by their properties: no SQL can repeat them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallystone.operators import clusters as C
from tallystone.operators import decompose as DC
from tallystone.operators import kmeans as KM
from tallystone.operators import providers as P
from tallystone.operators import text as T
from tallystone.operators import vectors as V
from tallystone.plans import cluster_queries, registry

SF = "/root/testdata/sf0.001"


def blobs(spark, k=4, n=30, d=6, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 8, (k, d))
    rows = [(i * n + j, i, [float(x) for x in centres[i] + rng.normal(0, 0.5, d)]) for i in range(k) for j in range(n)]
    return spark.createDataFrame(rows, "id long, truth int, vector array<double>")


def brute_silhouette(x, label):
    out = []
    for i in range(len(x)):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        own = [d[j] for j in range(len(x)) if label[j] == label[i] and j != i]
        other = min((np.mean([d[j] for j in range(len(x)) if label[j] == c]) for c in set(label) if c != label[i]), default=0)
        out.append((other - np.mean(own)) / max(other, np.mean(own)) if own else 0.0)
    return float(np.mean(out))


def test_silhouette_is_that_of_brute_force():
    rng = np.random.default_rng(2)
    x, label = rng.normal(0, 1, (40, 3)), rng.integers(0, 4, 40)
    label[0] = 9
    assert V.silhouette(x, label) == pytest.approx(brute_silhouette(x, label.tolist()))
    assert V.silhouette(x, np.zeros(40, int)) == -1.0


def test_clusters_find_the_groups_and_their_number(spark):
    df = blobs(spark)
    found, k, s = C.clustered(df, "id", ks=range(2, 9), restarts=10)
    rows = found.join(df, "id")
    assert k == 4 and s > 0.7 and V.purity(rows, "cluster", "truth").first()[0] == 1.0
    x = np.array([r["vector"] for r in rows.orderBy("id").collect()])
    assert s == pytest.approx(brute_silhouette(x, [r["cluster"] for r in rows.orderBy("id").collect()]))
    again, _, _ = C.clustered(df.repartition(7), "id", ks=range(2, 9), restarts=10)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, found.collect()))


def test_clusters_of_many_rows(spark):
    """6000 rows, 40 restarts: the same path as for few."""
    df = blobs(spark, k=5, n=1200, d=8).repartition(5)
    found, k, s = C.clustered(df, "id", ks=[2, 4, 5, 6], restarts=40)
    assert k == 5 and V.purity(found.join(df, "id"), "cluster", "truth").first()[0] == 1.0 and s > 0.7 and found.count() == 6000


def test_steps_are_those_of_brute_force(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(90, 3))
    rows = spark.createDataFrame([([float(v) for v in r],) for r in x], "v array<double>").repartition(3)
    models = [KM.Model(k, r, KM.first_centres(x, k, np.random.default_rng([k, r]))) for k in (2, 3, 7) for r in range(4)]
    for m, (sums, counts, cost) in zip(models, KM._sums(rows, models), strict=True):
        d = ((x[:, None] - m.centres) ** 2).sum(2)
        label = d.argmin(1)
        assert counts.tolist() == [(label == c).sum() for c in range(m.k)] and cost == pytest.approx(d.min(1).sum())
        assert np.allclose(sums, [x[label == c].sum(0) for c in range(m.k)])


def test_more_restarts_never_cost_more(spark):
    x = np.random.default_rng(5).normal(0, 1, (80, 2))
    rows = spark.createDataFrame([([float(v) for v in r],) for r in x], "v array<double>")
    one, many = (KM.fit(rows, [3, 6], n, 1) for n in (1, 30))
    assert all(b.cost <= a.cost + 1e-9 and b.k == a.k for a, b in zip(one, many, strict=True))
    d = ((x[:, None] - many[1].centres) ** 2).sum(2)
    assert many[1].cost == pytest.approx(d.min(1).sum())


def test_rows_that_nothing_tells_apart_are_one_cluster(spark):
    df = spark.createDataFrame([(i, [0.0, 0.0]) for i in range(5)] + [(9, None)], "id long, vector array<double>")
    found, k, s = C.clustered(df, "id", ks=[2, 3], restarts=2)
    assert sorted(map(tuple, found.collect())) == [(i, 0) for i in range(5)] and (k, s) == (1, -1.0)
    found, k, s = C.clustered(df.where("id = 9"), "id")
    assert found.count() == 0 and k == 1


@pytest.mark.parametrize("block", [2048, 4])
def test_projection_is_the_singular_value_decomposition(spark, monkeypatch, block):
    monkeypatch.setattr(DC, "BLOCK", block)
    rng = np.random.default_rng(3)
    x = rng.random((9, 12)) * (rng.random((9, 12)) < 0.5)
    rows = [(i, f"t{j}", float(x[i, j])) for i in range(9) for j in range(12) if x[i, j]]
    got = {r["d"]: r["vector"] for r in C.projected(spark.createDataFrame(rows, "d int, term string, w double"), "d", cap=4).collect()}
    u, s, _ = np.linalg.svd(x)
    y, want = np.array([got[i] for i in range(9)]), u[:, :4] * s[:4]
    assert y.shape == (9, 4) and np.allclose(np.abs(y), np.abs(want), atol=1e-6) and np.allclose(y @ y.T, want @ want.T, atol=1e-6)


@pytest.mark.parametrize("noise,passes", [(0.02, DC.PASSES), (1.0, 20)])
def test_singular_values_of_a_larger_sparse_table(spark, noise, passes):
    """Topics over noise with the usual passes; little but noise, whose values lie close together, with more."""
    rng = np.random.default_rng(6)
    few = lambda *n: rng.random(n) * (rng.random(n) < 0.15)
    x = few(700, 12) @ (few(12, 300) * 1.4 ** -np.arange(12)[:, None]) + noise * few(700, 300)
    at = np.argwhere(x)
    rows = [(int(i), f"t{j}", float(x[i, j])) for i, j in at]
    df = spark.createDataFrame([*rows, (None, "t1", 1.0), (3, None, 2.0), (4, "t2x", None)], "d int, term string, w double").repartition(4)
    out, values = DC.svd(df, "d", k=5, passes=passes)
    want = np.linalg.svd(x, compute_uv=False)[:5]
    assert np.allclose(values, want, rtol=1e-6)
    y = np.array([r["vector"] for r in out.orderBy("d").collect()])
    assert np.allclose((y * y).sum(0), want**2, rtol=1e-5)
    assert np.abs(y.T @ y - np.diag(want**2)).max() < 1e-6 * want[0] ** 2


def test_components_rule_and_empty_tables(spark):
    rows = [(i, f"t{j}", 1.0 + i * j) for i in range(6) for j in range(4)]
    df = spark.createDataFrame(rows, "d int, term string, w double")
    assert [len(DC.svd(df, "d", cap=c)[1]) for c in (200, 2)] == [3, 2]
    out, values = DC.svd(df.where("1 = 0"), "d")
    assert out.count() == 0 and values == [] and out.columns == ["d", "vector"]


def test_svd_leaves_null_vectors_out(spark):
    df = spark.createDataFrame([(1, [3.0, 0.0]), (2, [0.0, 1.0]), (3, None)], "id int, v array<double>")
    got = {r["id"]: r["projected"] for r in V.svd(df, "id", "v", 2).collect()}
    assert set(got) == {1, 2} and np.allclose(np.abs([got[1], got[2]]), [[3, 0], [0, 1]])


def test_plane_is_centred_and_principal(spark):
    df = blobs(spark, k=3)
    x = np.array([r["vector"] for r in df.orderBy("id").collect()])
    u, s, _ = np.linalg.svd(x - x.mean(0))
    got = np.array([[r["pc1"], r["pc2"]] for r in C.plane(df, "id").orderBy("id").collect()])
    assert np.allclose(np.abs(got), np.abs(u[:, :2] * s[:2]), atol=1e-6)


def test_hybrids_and_fallbacks(spark):
    a = spark.createDataFrame([(1, [1.0, 2.0]), (2, [0.0, 4.0])], "id int, vector array<double>")
    b = spark.createDataFrame([(1, [10.0]), (3, [0.0])], "id int, vector array<double>")
    assert [tuple(r) for r in C.hybrid([(a, 0.4), (b, 0.6)], "id").collect()] == [(1, pytest.approx([0.4, 0.8, 6.0]))]
    assert C.first_available([("x", None), ("y", a)])[0] == "y"
    with pytest.raises(ValueError):
        C.first_available([("x", None)])


def test_document_clusters_follow_the_languages(spark):
    rows = registry.QUERIES["q29_entry_clusters"](spark, SF).collect()
    assert rows[0]["purity"] > 0.9 and sum(r["n"] for r in rows) == spark.read.parquet(f"{SF}/documents.parquet").where("text is not null").count()


def test_year_clusters_cover_all_years(spark):
    for name in ("q30_year_clusters", "q36_hybrid_year_clusters"):
        rows = registry.QUERIES[name](spark, SF).collect()
        assert rows and (name != "q30_year_clusters" or sum(r["n"] for r in rows) == 60)


def test_texts_are_embedded_once_in_small_batches(spark):
    import hashlib
    import re

    texts = [None, "", " ", "The élan the x1 漢字 straße", "a_b " * 3000, "\U0001f600 'tis"] + [f"w{i} w{i % 7} common" for i in range(1500)]
    d = spark.createDataFrame([(i % 5, t) for i, t in enumerate(texts)], "year int, text string").coalesce(1)
    keys = [f"spark.sql.execution.arrow.max{x}PerBatch" for x in ("Records", "Bytes")]
    old = [spark.conf.get(k) for k in keys]
    try:
        spark.conf.set(keys[0], "10000")
        got = [r["v"] for r in d.select(P.embedding("text").alias("v")).collect()]
        assert int(spark.conf.get(keys[0])) <= 1000 and int(spark.conf.get(keys[1])) <= 8 << 20
        for t, v in zip(texts, got, strict=True):
            want = np.zeros(64)
            for w in re.findall(r"\w+", (t or "").lower()):
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                want[h % 64] += 1 if h >> 63 else -1
            assert np.allclose(v, want / (np.sqrt((want * want).sum()) or 1.0), rtol=1e-15, atol=0)
        dense = cluster_queries._dense(d, "year")
        assert "ArrowEvalPython" not in dense._jdf.queryExecution().toString() and dense.count() == 5
    finally:
        for k, x in zip(keys, old, strict=True):
            spark.conf.set(k, x)


def test_whole_words_and_stop_words(spark):
    df = spark.createDataFrame([("The abc1 and élan x86 plain_word Farm farm's rent",), (None,)], "t string")
    got = df.select(T.words("t").alias("any"), T.words("t", True).alias("latin"), T.words("t", True, ["the", "and"]).alias("kept")).collect()
    assert got[0]["any"] == ["the", "abc1", "and", "élan", "x86", "plain_word", "farm", "farm", "rent"]
    assert got[0]["latin"] == ["the", "and", "farm", "farm", "rent"] and got[0]["kept"] == ["farm", "farm", "rent"] and got[1]["any"] == []


def test_sheets_and_cells(spark, tmp_path):
    from tallystone.sources import pages as S

    df = spark.createDataFrame([(1.0, 2.5, "a"), (None, float("nan"), None)], "x double, y double, z string")
    assert [tuple(r) for r in S.clean_cells(df, ["x", "y", "z"]).collect()] == [("1", "2.5", "a"), ("", "", "")]
    (tmp_path / "1721_6_image.csv").write_text("Type,description\nentry,rent\n")
    rows = S.sheet_rows(spark, str(tmp_path), {"Type": "row_type"}).collect()
    assert rows[0]["page_id"] == "1721_6_image" and rows[0]["row_type"] == "entry"
    with pytest.raises(ValueError):
        S.sheet_rows(spark, str(tmp_path))


def test_skip_labels_and_single_class(spark):
    from tallystone.operators import leave_one_out as L

    scores = spark.createDataFrame([(p, q, s) for p in (1, 2, 3) for q, s in (("v2_full", 0.9), ("v2_no_gpt", 0.89), ("v2_no_claude", 0.5))], "page int, pipeline string, score double")
    labels = L.skip_labels(scores, [0.03])
    assert {(r["extractor"], r["skip"]) for r in labels.collect()} == {("gpt", 1), ("claude", 0), ("gemini", 0)}
    near = spark.createDataFrame([(a, b, 0.5, r) for a in (1, 2, 3) for r, b in enumerate([x for x in (1, 2, 3) if x != a], 1)], "a int, b int, similarity double, rank int")
    votes = L.nearest_votes(near, labels, [1])
    assert all(r["p"] is None for r in votes.collect())  # all other pages have one label
    assert {r["pipeline"] for r in L.decided(votes, [0.5], cosine=False).collect()} == {"v2_full"}
    assert {r["pipeline"] for r in L.decided(L.cosine_votes(near, labels, [1]), [0.5], cosine=True).collect()} == {"v2_no_gpt"}


@pytest.mark.parametrize("block, strip", [(8192, 512), (100, 7)])
def test_pairwise_cosine_in_strips(spark, monkeypatch, block, strip):
    monkeypatch.setattr(V, "STRIP", strip)
    x = np.random.default_rng(4).normal(size=(430, 6))
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    r = V.pairwise_cosine(df, "id", "v", block=block).first()
    s = (x @ x.T)[np.triu_indices(len(x), 1)]
    assert r["n"] == len(s) and np.allclose([r["mean"], r["least"], r["most"], r["spread"]], [s.mean(), s.min(), s.max(), s.std()])


def test_first_centres_and_silhouettes_are_of_all_vectors(spark, monkeypatch):
    """No sample: a group of 3 rows among 400 gets its centre, and the silhouette is that of brute force over all."""
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 0.5, (n, 3)) for c, n in ((0, 250), (9, 147), (60, 3))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>").repartition(5)
    for name, value in (("SEED_ROWS", 20), ("SILHOUETTE_ROWS", 20), ("BLOCK", 64), ("STRIP", 7)):
        monkeypatch.setattr(KM, name, value)
    found, k, s = C.clustered(df, "id", ks=[2, 3, 4, 5], restarts=6)
    label = [r["cluster"] for r in found.orderBy("id").collect()]
    assert k == 3 and [label.count(c) for c in range(3)] == [250, 147, 3] and s == pytest.approx(brute_silhouette(x, label), rel=1e-9)
    again, _, t = C.clustered(df.repartition(2), "id", ks=[2, 3, 4, 5], restarts=6)
    assert [r["cluster"] for r in again.orderBy("id").collect()] == label and t == pytest.approx(s)


def test_first_centres_are_drawn_by_squared_distances(spark):
    x = [[0.0], [1.0], [3.0], [0.0]]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "id long, v array<double>")
    hashed = rows.select("v", F.xxhash64("id", "v").alias("h"))
    models = [KM.Model(2, r, np.zeros((1, 1))) for r in range(4000)]
    drawn = [v[0] for v in KM._drawn(hashed, models, np.random.default_rng(1).integers(0, 1 << 63, 4000, dtype=np.uint64))]
    assert set(drawn) == {1.0, 3.0} and drawn.count(3.0) / 4000 == pytest.approx(0.9, abs=0.02)
    first = [v[0] for v in KM._drawn(hashed, [KM.Model(2, r, np.empty((0, 1))) for r in range(4000)], np.random.default_rng(2).integers(0, 1 << 63, 4000, dtype=np.uint64))]
    assert first.count(0.0) / 4000 == pytest.approx(0.5, abs=0.03)
