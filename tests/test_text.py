"""Similar vectors and contrasts against brute force, with terms that all documents share."""

import math
import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from tallystone.operators import text as T


def vectors(n, seed):
    """Unit vectors of groups of near copies; one term is in all, one group holds a third."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        g = 0 if i % 3 == 0 else i // 4
        words = random.Random(g).sample(range(400), 12) + rng.sample(range(400), rng.choice([0, 2, 8]))
        w = Counter(words) + Counter({-1: 1 + i % 2})
        norm = math.sqrt(sum(x * x for x in w.values()))
        out.append({str(t): x / norm for t, x in w.items()})
    return out


def dots(v):
    return {(i, j): sum(x * v[j].get(t, 0) for t, x in v[i].items()) for i, j in combinations(range(len(v)), 2)}


def frame(spark, v):
    return spark.createDataFrame([(i, t, x) for i, d in enumerate(v) for t, x in d.items()] or [(0, "x", 0.0)], "doc int, term string, w double").where("w > 0")


@pytest.mark.parametrize("block", [7, 1024])
def test_cosine_in_blocks(spark, block):
    v = vectors(60, 1)
    got = {(r["a"], r["b"]): r["similarity"] for r in T.cosine(frame(spark, v), "doc", block=block, shards=3).collect()}
    want = {k: x for k, x in dots(v).items() if x > 0}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


@pytest.mark.parametrize("least", [0.3, 0.8, 1.0])
def test_similar_pairs(spark, least):
    v = vectors(90, 2)
    v += [dict(v[5]), dict(v[5])]  # equal vectors have a similarity of 1
    got = {(r["a"], r["b"]): r["similarity"] for r in T.similar(frame(spark, v), "doc", least).collect()}
    want = {k: x for k, x in dots(v).items() if round(x, 12) >= least}
    assert want and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_no_vectors(spark):
    assert T.similar(frame(spark, []), "doc", 0.5).count() == 0 and T.cosine(frame(spark, []), "doc").count() == 0


def test_contrast_counts_rows_once(spark):
    """A term's documents are rows, however often a row has it; sides and scopes that are null do not count."""
    rows = [("a", "x", "p p p q"), ("b", "x", "p q"), ("b", "y", "q q"), ("a", None, "p"), (None, "x", "p"), ("a", "y", ""), ("a", "x", None)]
    df = spark.createDataFrame(rows, "side string, scope string, text string")
    out = T.contrast(df, "side", ("a", "b"), "scope", T.words(T.F.regexp_replace("text", "([pq])", "$1$1")), min_df=3, least_rows=1)
    got = {(r["scope"], r["term"]): (r["n_first"], r["n_second"]) for r in out.collect()}
    assert got == {("overall", "pp"): (4, 1), ("overall", "qq"): (1, 3), ("x", "pp"): (3, 1), ("x", "qq"): (1, 1), ("y", "pp"): (0, 0), ("y", "qq"): (0, 2)}


def test_similar_documents_make_no_rows_for_terms_of_pairs(spark, monkeypatch):
    """Over several blocks, with very frequent, middling and rare terms, against the whole matrix; only similar pairs come out of a task."""
    rng = np.random.default_rng(5)
    x = np.where(rng.random((700, 60)) < np.concatenate([[0.95] * 5, [0.3] * 20, [0.02] * 35]), rng.gamma(1.0, size=(700, 60)), 0.0)
    x[600:] = x[:100] + (x[:100] > 0) * rng.random((100, 60)) * 0.05
    x[:, 0] += 0.1
    x /= np.linalg.norm(x, axis=1)[:, None]
    rows = [(int(i), f"t{j}", float(x[i, j])) for i, j in zip(*np.nonzero(x), strict=True)]
    df = spark.createDataFrame(rows, "d long, term string, w double").repartition(3)
    tags, kept = [], T.stored
    monkeypatch.setattr(T, "stored", lambda t, tag: tags.append(tag) or kept(t, tag))
    got = {(r["a"], r["b"]): r["similarity"] for r in T.similar(df, "d", 0.8).collect()}
    s = x @ x.T
    assert set(got) == {(i, j) for i in range(700) for j in range(i + 1, 700) if round(s[i, j], 12) >= 0.8} and len(got) > 100
    assert all(abs(s[k] - v) < 1e-12 for k, v in got.items())
    assert "candidates" not in tags


def test_block_products_are_the_matrix(spark):
    rng = np.random.default_rng(6)
    x, y = (np.where(rng.random((n, 90)) < np.linspace(0.01, 1, 90), rng.normal(size=(n, 90)), 0.0) for n in (130, 170))
    part = lambda z: tuple(k[np.lexsort((np.nonzero(z)[0], np.nonzero(z)[1]))] for k in (*np.nonzero(z), z[np.nonzero(z)]))
    assert np.allclose(T.block_products(part(x), part(y), 130, 170), x @ y.T, atol=1e-12)


def test_texts_are_cut_once_for_words_and_pairs(spark):
    df = spark.createDataFrame([(1, "Rent of the old farm"), (2, "farm"), (3, None), (1, "old farm")], "doc long, text string")
    counts = T.term_counts(df, "doc", "text", pairs=True, found=T.words("text"))
    assert counts._jdf.queryExecution().executedPlan().toString().count("regexp_extract_all") == 1
    assert {(r["doc"], r["term"]): r["tf"] for r in counts.collect()} == {(1, "rent"): 1, (1, "of"): 1, (1, "the"): 1, (1, "old"): 2, (1, "farm"): 2, (1, "rent of"): 1, (1, "of the"): 1, (1, "the old"): 1, (1, "old farm"): 2, (2, "farm"): 1}


def test_similar_documents_shuffle_no_copies_of_blocks(spark, monkeypatch):
    """Only the numbers of blocks are dealt to tasks: vectors are read where they are stored."""
    monkeypatch.setattr(T, "SIMILAR_BLOCK", 16)
    rng = np.random.default_rng(7)
    x = np.abs(rng.normal(size=(120, 9))) * (rng.random((120, 9)) < 0.7)
    x[:, 0] += 0.1
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(int(i), f"t{j}", float(x[i, j])) for i, j in np.argwhere(x)], "d long, term string, w double")
    out = T.similar(df, "d", 0.9)
    plan = out._jdf.queryExecution().toString()
    assert "CoGroup" not in plan and all("terms" not in line and "ws" not in line for line in plan.splitlines() if "Exchange" in line)
    s = x @ x.T
    assert {(r["a"], r["b"]) for r in out.collect()} == {(i, j) for i in range(120) for j in range(i + 1, 120) if round(s[i, j], 12) >= 0.9}


def test_capped_weights_need_no_table_of_all_terms(spark, monkeypatch):
    """Those of tfidf over all terms, while only terms of the vocabulary are stored by document."""
    rng = random.Random(4)
    rows = [(rng.choice(["x", "y", "z", None]) if i % 9 else f"u{i}", " ".join(rng.choice("aa bb cc dd ee ff gg".split()) for _ in range(rng.randrange(12)))) for i in range(60)]
    df = spark.createDataFrame([*rows, ("empty", ""), ("null", None), ("x", "once twice once")], "unit string, text string").repartition(3)
    want = T.tfidf(T.term_counts(df.where("unit is not null"), "unit", "text", pairs=True, found=T.words("text")), "unit", min_df=2, size=15)
    want = sorted((r["unit"], r["term"], r["w"]) for r in want.collect())
    tables, kept = {}, T.stored
    monkeypatch.setattr(T, "stored", lambda t, tag: tables.setdefault(tag, kept(t, tag)))
    got = T.capped_tfidf(df, "unit", T.words("text"), 15).collect()
    names = sorted({t for _, t, _ in want}, key=str.encode)
    assert len(names) == 15 and tables["tf"].columns == ["d", "i", "tf"] and tables["tf"].agg(T.F.max("i")).first()[0] == 14
    got = sorted((r["unit"], names[r["term"]], r["w"]) for r in got)
    assert [g[:2] for g in got] == [w[:2] for w in want] and np.allclose([g[2] for g in got], [w[2] for w in want], rtol=1e-12)
