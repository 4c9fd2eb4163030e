import numpy as np
import pytest
from pyspark.sql import functions as F

from tallystone.operators import reliability as R
from tallystone.operators import routing as G
from tallystone.operators import scoring as E
from tallystone.operators import text as T
from tallystone.plans import registry


def row(kind, amount, text, fraction=None):
    return {"row_type": kind, "amount": amount, "description": text, "fraction": fraction}


# --- the same matching in plain Python


def levenshtein(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
    return row[-1]


def lev_ratio(a: str, b: str) -> float:
    n = len(a) + len(b)
    return 1 - 2 * levenshtein(a, b) / n if n else 1.0


def alike(g: dict, p: dict) -> float:
    """The similarity of an expected and an extracted row's descriptions, from the known distance if there is one."""
    a, b = g["description"], p["description"]
    if "distances" not in g:
        return lev_ratio(a, b)
    n = len(a) + len(b)
    return 1 - 2 * g["distances"][p["at"]] / n if n else 1.0


def match_headers(pred: list[dict | str], gt: list[dict | str], least: float = 0.8) -> float:
    """The share of expected headers (rows or texts) that find a header of their own, each taking the best that is left."""
    rows = lambda x: [r if isinstance(r, dict) else {"description": r} for r in x]
    left, hits = rows(pred), 0
    for g in rows(gt):
        scored = [(alike(g, p), -i) for i, p in enumerate(left)]
        if scored and max(scored)[0] >= least:
            left.pop(-max(scored)[1])
            hits += 1
    return hits / len(gt) if gt else 1.0


def _similar(a: int, b: int) -> float:
    return 1.0 if max(a, b) == 0 else max(0.0, 1 - abs(a - b) / max(a, b))


def match_amounts(pred: list[dict], gt: list[dict]) -> tuple[float, float, list[int | None]]:
    """(match, similarity, matched prediction of each expected row), both means over the expected rows with an amount.

    Each expected row takes, of the rows left with the same pounds, shillings and pence, one of its own type before
    another, then the most similar description. Entry against total counts half. A row without a match is compared
    with the closest amount that is left, which stays available.
    """
    left = [i for i, p in enumerate(pred) if p["amount"] is not None]
    credit, similar, taken = [], [], []
    for g in gt:
        if g["amount"] is None:
            continue
        same = [i for i in left if pred[i]["amount"] == g["amount"]]
        if same:
            best = max(same, key=lambda i: (pred[i]["row_type"] == g["row_type"], alike(g, pred[i]), -i))
            left.remove(best)
            credit.append(1.0 if pred[best]["row_type"] == g["row_type"] else 0.5)
            similar.append(1.0)
            taken.append(best)
        else:
            credit.append(0.0)
            similar.append(max((_similar(pred[i]["amount"], g["amount"]) for i in left), default=0.0))
            taken.append(None)
    n = len(credit)
    return (sum(credit) / n, sum(similar) / n, taken) if n else (1.0, 1.0, taken)


def match_fractions(pred: list[dict], gt: list[dict]) -> float:
    """The share of expected rows with a fraction that find a row of their own with the same fraction and amount."""
    left = [i for i, p in enumerate(pred) if p["fraction"]]
    want = [g for g in gt if g["fraction"]]
    hits = 0
    for g in want:
        same = [i for i in left if pred[i]["fraction"] == g["fraction"] and pred[i]["amount"] == g["amount"]]
        if same:
            left.remove(max(same, key=lambda i: (pred[i]["row_type"] == g["row_type"], -i)))
            hits += 1
    return hits / len(want) if want else 1.0


def test_greedy_matching():
    assert match_amounts([row("entry", 240, "b"), row("entry", 240, "a")], [row("entry", 240, "a"), row("entry", 240, "b")]) == (1, 1, [1, 0])
    assert match_amounts([row("entry", 1200, "x")], [row("total", 1200, "x")])[:2] == (0.5, 1)
    assert match_amounts([row("entry", 241, "x")], [row("entry", 240, "x")])[:2] == (0, pytest.approx(240 / 241))
    assert match_amounts([], [row("entry", None, "x")])[:2] == (1, 1)
    assert match_headers(["Receipts", "Payments"], ["Receipts", "Paymens", "Other"]) == pytest.approx(2 / 3)
    assert match_fractions([row("entry", 1, "a", 0.5)], [row("total", 1, "a", 0.5), row("entry", 1, "a", 0.5)]) == 0.5


def test_page_scores(spark):
    schema = "page long, row_index int, row_type string, description string, amount long, fraction double"
    gt = spark.createDataFrame([(1, 0, "header", "H", None, None), (1, 1, "entry", "a", 240, 0.5), (2, 0, "entry", "x", 10, None)], schema)
    pred = spark.createDataFrame([(1, 0, "header", "H", None, None), (1, 1, "entry", "a", 240, 0.5), (3, 0, "entry", "y", 1, None)], schema)
    got = {r["page"]: r for r in E.page_scores(pred, gt).collect()}
    assert got[1]["combined"] == 1.0 and got[2]["axis2_match"] == 0 and set(got) == {1, 2, 3}
    s = {r["page"]: r["row_count_score"] for r in E.structure_score(pred, gt).collect()}
    assert s == {1: 1.0, 2: 0.0, 3: 0.0}
    assert [(r["page"], r["closest"]) for r in E.feedback(pred, gt).collect()] == [(2, None)]


def test_kappas(spark):
    r = spark.createDataFrame([("x", "x"), ("x", "y"), ("y", "y"), ("y", "y")], "a string, b string")
    assert R.cohen(r, "a", "b").first()["kappa"] == pytest.approx(0.5)
    f = spark.createDataFrame([("x", "x", "x"), ("x", "y", "y")], "a string, b string, c string")
    assert R.fleiss(f, ["a", "b", "c"]).first()["kappa"] == pytest.approx(0.25)
    g = spark.createDataFrame([("x", "x", "x"), ("x", "y", "x")], "a string, b string, c string")
    assert R.agreement(g, ["a", "b", "c"]).first()["agree_rate"] == 0.5


def test_bootstrap_holds_the_estimate(spark):
    from pyspark.sql import functions as F

    rows = spark.range(400).select((F.col("id") % 80).alias("page"), (F.col("id") % 2).alias("s"), (F.col("id") % 7).cast("double").alias("a"), F.lit(7.0).alias("b"))
    for r in R.bootstrap(rows, "page", "s", F.col("a"), F.col("b"), draws=200).collect():
        assert r["ci_lower"] < r["estimate"] < r["ci_upper"]


def test_votes(spark):
    near = spark.createDataFrame([(0, 1, 0.9), (0, 2, 0.6), (0, 3, -0.2)], "a long, b long, similarity double")
    labels = spark.createDataFrame([(1, "skip"), (2, "keep"), (3, "skip")], "id long, label string")
    assert G.weighted_vote(near, labels, "label").first()["confidence"] == pytest.approx(0.6)


def test_decisions(spark):
    df = spark.createDataFrame([(["gpt"],), (["gpt", "claude"],), ([],)], "s array<string>")
    from pyspark.sql import functions as F

    assert [r[0] for r in df.select(G.decision(F.col("s"))).collect()] == ["v2_no_gpt", "v2_full", "v2_full"]


def test_bigrams_and_idf(spark):
    df = spark.createDataFrame([(1, "To the Mr. Smith paid rent")], "k int, t string")
    assert [r["bigram"] for r in T.bigram_rows(df, ["k"], "t").collect()] == ["the smith", "smith paid", "paid rent"]
    docs = spark.createDataFrame([(1, "aa bb"), (2, "bb"), (3, "bb")], "d int, t string")
    w = {(r["d"], r["term"]): r["w"] for r in T.tfidf(T.term_counts(docs, "d", "t"), "d").collect()}
    assert w[(1, "aa")] / w[(1, "bb")] == pytest.approx(1.693147, rel=1e-5)


@pytest.mark.parametrize("euclidean", [False, True])
def test_nearest_are_of_all_vectors(spark, euclidean):
    """Over several blocks, with copies of a vector, against the whole matrix; g07 votes with those neighbours."""
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding", "label")
    extra = e.where("vec_id < 3").crossJoin(spark.range(6)).select((F.col("vec_id") * 10 + 100_000 + F.col("id")).alias("vec_id"), "embedding", "label")
    rows = e.unionByName(extra).collect()
    x = np.array([r["embedding"] for r in rows], float)
    ids = [r["vec_id"] for r in rows]

    def brute(n, x, ids, euclidean):
        s = -np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) if euclidean else (x[:, None] * x[None]).sum(2)
        return {(ids[i], ids[j], r + 1) for i in range(len(ids)) for r, j in enumerate(sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-round(s[i, j], 9), ids[j]))[:n])}

    got = G.nearest(e.unionByName(extra), "vec_id", "embedding", 4, euclidean, block=150)
    assert {(r["a"], r["b"], r["rank"]) for r in got.collect()} == brute(4, x, ids, euclidean)
    if not euclidean:
        n, label = len(rows) - 18, {r["vec_id"]: r["label"] for r in rows}
        first = sorted(range(len(rows)), key=lambda i: ids[i])[:n]
        x, ids, votes = x[first], [ids[i] for i in first], {}
        at = {v: i for i, v in enumerate(ids)}
        for a, b, _ in brute(5, x, ids, False):
            v = votes.setdefault(a, {})
            v[label[b]] = v.get(label[b], 0.0) + max(float((x[at[a]] * x[at[b]]).sum()), 0.0)
        want = {a: min(v, key=lambda k: (-round(v[k] / (sum(v.values()) or 1.0), 9), k)) for a, v in votes.items()}
        assert {r["vec_id"]: r["label"] for r in registry.QUERIES["g07_weighted_vote"](spark, "/root/testdata/sf0.001").collect()} == want


@pytest.mark.parametrize("euclidean", [False, True])
@pytest.mark.parametrize("spread", [0.05, 3.0])
def test_cells_that_cannot_hold_a_nearer_one_are_not_visited(spark, euclidean, spread):
    """Vectors of very different lengths, in clusters and without; copies tie. In clusters few pairs are compared."""
    rng = np.random.default_rng(4)
    x = (rng.normal(size=(20, 8)) * 4)[rng.integers(0, 20, 1500)] + spread * rng.normal(size=(1500, 8))
    x[1400:1410] = x[0]
    x[1410] = 0
    if not euclidean:
        x /= np.maximum(np.linalg.norm(x, axis=1), 1e-9)[:, None] * rng.choice([1.0, 1.0, 0.97], 1500)[:, None]
    ids = rng.permutation(1500).tolist()
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in zip(ids, x, strict=True)] + [(None, [1.0] * 8), (7777, None)], "id long, v array<double>").repartition(3)
    report = {}
    got = {(r["a"], r["b"], r["rank"]) for r in G.nearest(df, "id", "v", 5, euclidean, block=64, report=report).collect()}
    s = -np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) if euclidean else (x[:, None] * x[None]).sum(2)
    want = set()
    for i in range(1500):
        order = sorted((j for j in range(1500) if j != i), key=lambda j: (-round(s[i, j], 9), ids[j]))[:5]
        want |= {(ids[i], ids[j], r) for r, j in enumerate(order, 1)}
    assert got == want
    assert 0 < report["share"] <= 1 and (spread > 1 or report["share"] < 0.3)


@pytest.mark.parametrize("euclidean", [False, True])
def test_a_vector_is_sent_once_a_shelf(spark, euclidean):
    """Without clusters nearly every cell is visited, but no copy of a vector is made for each of them."""
    x = np.random.default_rng(9).normal(size=(1200, 24))
    report = {}
    got = G.nearest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>"), "id", "v", 3, euclidean, block=100, report=report).collect()
    s = -np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) if euclidean else x @ x.T
    np.fill_diagonal(s, -np.inf)
    assert {(r["a"], r["rank"]): r["b"] for r in got} == {(i, r + 1): j for i in range(1200) for r, j in enumerate(np.argsort(-s[i])[:3].tolist())}
    assert report["sent"] <= 8 and report["share"] > 0.5  # of some 37 cells


def test_few_vectors_and_none(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, v array<double>")
    assert sorted((r["a"], r["b"], r["rank"]) for r in G.nearest(df, "id", "v", 5).collect()) == [(1, 2, 1), (2, 1, 1)]
    assert G.nearest(df.where("id = 1"), "id", "v", 5).count() == 0 and G.nearest(df.where("id = 0"), "id", "v", 5).count() == 0


def _share(a, b):
    return (1.0 if a == 0 else 0.0) if b == 0 else max(0.0, 1 - abs(a - b) / b)


def brute_scores(p, g):
    count = lambda x, t: sum(r["row_type"] == t for r in x)
    heads = [[r for r in x if r["row_type"] == "header"] for x in (p, g)]
    axis1 = round((round(_share(len(p), len(g)), 4) + round(sum(_share(count(p, t), count(g, t)) for t in E.TYPES) / 3, 4) + round(match_headers(*heads), 4)) / 3, 4)
    money = [[r for r in x if r["row_type"] != "header"] for x in (p, g)]
    match, similar, _ = match_amounts(*money)
    fraction = match_fractions(*money)
    axis2 = round(0.5 * match + 0.3 * similar + 0.2 * fraction, 4)
    return [axis1, round(match, 4), round(similar, 4), round(fraction, 4), axis2, round(0.3 * axis1 + 0.7 * axis2, 4)]


def test_folds_match_as_plain_python_does(spark):
    """Random pages with many equal amounts, fractions, types and texts, nulls among them; no Python in the plan."""
    import random

    rng = random.Random(7)
    schema = "page long, row_index int, row_type string, description string, amount long, fraction double"
    texts = ["rent", "rents", "Rent of a farm", "", None, "wages", "wage", "corn sold", "élan"]
    make = lambda page: [(page, i, rng.choice(["header", "entry", "entry", "total", None]), rng.choice(texts), rng.choice([None, 0, 240, 240, 241, 1200, 7]), rng.choice([None, None, 0.0, 0.5, 0.25])) for i in range(rng.randint(0, 9))]
    sides = [[r for page in range(150) for r in make(page)] for _ in range(2)]
    pred, gt = (spark.createDataFrame(x, schema) for x in sides)
    scores, missed = E.page_scores(pred, gt), E.feedback(pred, gt)
    for df in (scores, missed):
        assert "Python" not in df._jdf.queryExecution().executedPlan().toString() and "Arrow" not in df._jdf.queryExecution().executedPlan().toString()
    got = {r["page"]: list(r)[1:] for r in scores.collect()}
    pages = [[[{"row_index": i, "row_type": t, "description": d or "", "amount": a, "fraction": f} for q, i, t, d, a, f in x if q == page] for page in range(150)] for x in sides]
    want, left = {}, []
    for page, (p, g) in enumerate(zip(*pages, strict=True)):
        if p or g:
            want[page] = brute_scores(p, g)
        some = [r for r in g if r["amount"] is not None]
        left += [(page, r["row_index"], r["description"], max(p, key=lambda x, r=r: alike(r, x), default={"description": None})["description"]) for r, t in zip(some, match_amounts(p, some)[2], strict=True) if t is None]
    assert got == want
    assert sorted(map(tuple, missed.collect()), key=str) == sorted(left, key=str)


def test_numbers_are_rounded_by_their_binary_value(spark):
    from tallystone.functions import scalars as S

    rng = np.random.default_rng(3)
    x = [0.03125, 0.09375, 0.00005, 0.12345, 1.00005, 2.5, 0.0, 0.3 * 0.9001 + 0.7 * 0.8502, *(rng.integers(0, 200001, 3000) / 100000).tolist(), *(0.3 * rng.integers(0, 10001, 2000) / 10000 + 0.7 * rng.integers(0, 10001, 2000) / 10000).tolist()]
    df = spark.createDataFrame([(v,) for v in x], "x double")
    assert all(r["y"] == round(r["x"], 4) for r in df.select("x", S.exactly_rounded(F.col("x"), 4).alias("y")).collect())


@pytest.mark.parametrize("most,q", [(1, 2), (2, 2), (3, 3), (2, 1)])
def test_similar_pairs_are_those_of_all_pairs(spark, most, q):
    """Short and long texts, repeated grams, texts that share nearly all of them, nulls and copies."""
    import random

    from tallystone.operators.fuzzy import similar_pairs

    rng = random.Random(most * 10 + q)
    texts = {"", "a", "b", "ab", "ba", "abc", "aaaaaaaa", "aaaaaaa", "élan", "elan", "\U0001f600x"}
    texts |= {"".join(rng.choice("ab") for _ in range(rng.randint(0, 9))) for _ in range(60)}
    for base in ("the old mill at the river", "abababababababab", "rent of a farm"):
        for _ in range(25):
            t = list(base)
            for _ in range(rng.randint(0, 4)):
                i = rng.randint(0, len(t))
                t[i : i + rng.randint(0, 1)] = [rng.choice("ab x")] * rng.randint(0, 1)
            texts.add("".join(t))
    df = spark.createDataFrame([(t,) for t in [*texts, "ab", "abc", None]], "t string").repartition(3)
    got = {(r["a"], r["b"]): r["distance"] for r in similar_pairs(df, "t", most, q).collect()}
    order = sorted(texts, key=lambda t: t.encode())
    want = {(a, b): d for i, a in enumerate(order) for b in order[i + 1 :] if (d := levenshtein(a, b)) <= most}
    assert got == want
