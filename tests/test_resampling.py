"""Block bootstrap: its counts, and its intervals against a plain bootstrap."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallystone.operators import reliability as R
from tallystone.operators import resampling as B


@pytest.mark.parametrize("pages, size", [(1, 4), (4, 4), (37, 4), (1000, 64), (1025, 1024)])
def test_counts_sum_to_the_pages(pages, size):
    counts = np.hstack([B.page_draws(b, pages, 50, 7, size) for b in range(-(-pages // size))])
    assert counts.shape == (50, pages) and (counts >= 0).all()
    assert (counts.sum(axis=1) == pages).all()


def test_counts_are_those_of_draws_with_replacement():
    counts = np.hstack([B.page_draws(b, 100, 20_000, 3, 8) for b in range(13)])
    assert np.abs(counts.mean(axis=0) - 1).max() < 0.05
    assert np.abs(counts.var(axis=0) - 0.99).max() < 0.06  # n p (1 - p)
    assert np.abs(np.corrcoef(counts[:, 3], counts[:, 90])[0, 1] + 1 / 99) < 0.03  # over a border
    assert np.abs(np.corrcoef(counts[:, 3], counts[:, 4])[0, 1] + 1 / 99) < 0.03  # within a block


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(11)
    return [(p, s, float(rng.gamma(2.0)), float(1 + rng.gamma(3.0))) for p in range(300) for s in ("a", "b", None) if s != "b" or p % 3 == 0]


def test_intervals_are_those_of_a_plain_bootstrap(spark, rows):
    df = spark.createDataFrame(rows, "page long, s string, x double, y double").withColumn("estimate", F.lit("clash")).repartition(7)
    got = {r["s"]: r for r in B.block_bootstrap(df, "page", "s", F.col("x"), F.col("y"), draws=4000, size=32).collect()}
    rng = np.random.default_rng(12)
    picks = rng.integers(0, 300, (4000, 300))
    counts = np.apply_along_axis(np.bincount, 1, picks, minlength=300)
    assert set(got) == {"a", "b", None}
    for s, r in got.items():
        mine = [q for q in rows if q[1] == s]
        p, x, y = (np.array([q[i] for q in mine]) for i in (0, 2, 3))
        ratio = counts[:, p] @ x / (counts[:, p] @ y)
        low, high = np.quantile(ratio, [0.025, 0.975])
        assert r["estimate"] == pytest.approx(x.sum() / y.sum()) and r["n_draws"] == 4000
        assert abs(r["ci_lower"] - low) < 0.1 * (high - low) and abs(r["ci_upper"] - high) < 0.1 * (high - low)


def test_same_seed_same_rows_whatever_the_partitions(spark, rows):
    df = spark.createDataFrame(rows, "page long, s string, x double, y double")
    a, b = ({r["s"]: [round(r[c], 9) for c in ("ci_lower", "ci_upper")] for r in B.block_bootstrap(t, "page", "s", F.col("x"), F.col("y"), draws=40, size=16).collect()} for t in (df.repartition(2), df.repartition(9)))
    assert a == b


def test_nulls_zeros_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "z", None, None), (2, "z", 1.0, 0.0), (1, "k", 1.0, 2.0)], "page long, s string, x double, y double")
    got = {r["s"]: r for r in B.block_bootstrap(df, "page", "s", F.col("x"), F.col("y"), draws=50).collect()}
    assert got["z"]["estimate"] is None and got["z"]["n_draws"] == 0 and got["z"]["ci_lower"] is None
    assert got["k"]["ci_lower"] == got["k"]["ci_upper"] == 0.5 and 10 <= got["k"]["n_draws"] < 50
    assert B.block_bootstrap(df.limit(0), "page", "s", F.col("x"), F.col("y")).collect() == []


@pytest.mark.parametrize("slots, size", [(1 << 22, 1 << 15), (64, 16), (1000, 7)])
def test_plain_draws_make_no_row_for_a_page_and_are_those_of_the_hash(spark, monkeypatch, slots, size):
    """Rows of odd values, over several blocks and ranges of slots, against the hash page by page."""
    monkeypatch.setattr(R, "SLOTS", slots, raising=False)
    monkeypatch.setattr(R, "BLOCK", size, raising=False)
    made, plain = [], type(spark).range
    monkeypatch.setattr(type(spark), "range", lambda self, start, end=None, *a: made.append(end or start) or plain(self, start, end, *a))
    rng = np.random.default_rng(2)
    n, draws = 500, 20
    rows = [(p, s, float(rng.gamma(2.0)), float(1 + rng.gamma(3.0))) for p in range(n) for s in ("a", "b") if s == "a" or p % 3 == 0]
    rows += [(7, "c", 1.0, float("inf")), (8, "c", 1.0, 2.0), (9, "n", None, 4.0), (9, None, 1.0, 1.0), (9, "z", 1.0, 0.0)]
    df = spark.createDataFrame(rows, "page long, s string, x double, y double").repartition(5)
    got = {r["s"]: (r["ci_lower"], r["ci_upper"]) for r in R.bootstrap(df, "page", "s", F.col("x"), F.col("y"), draws=draws, bucket=F.col("page") % 1).collect()}
    assert max(made, default=0) <= draws * -(-n // slots)  # a task's slots are one row
    h = spark.sql(f"select d, j from (select explode(sequence(0L, {draws - 1}L)) d) cross join (select explode(sequence(0L, {n - 1}L)) j)")
    counts = np.zeros((draws, n))
    for r in h.select("d", (R.draw_hash(F.col("d"), F.col("j"), 42) % n).alias("i")).collect():
        counts[r["d"], r["i"]] += 1
    for s in ("a", "b", "c"):
        mine = [q for q in rows if q[1] == s]
        p, x, y = (np.array([q[k] for q in mine]) for k in (0, 2, 3))
        c = counts[:, p]
        with np.errstate(invalid="ignore"):
            ratio = np.where(c > 0, c * x, 0).sum(1) / np.where(c > 0, c * y, 0).sum(1)
        ratio = ratio[c.any(axis=1)]
        want = np.quantile(ratio, [0.025, 0.975]) if len(ratio) >= 10 else (None, None)
        assert got[s] == pytest.approx(tuple(want))
    assert got["n"] == got["z"] == got[None] == (None, None)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_draws_read_lists_as_arrays(spark, kind):
    sums = spark.createDataFrame([(p, s, float(p), 1.0) for p in range(50) for s in (1, None) if s or p % 2], "page long, s long, a double, b double").withColumn("s", F.col("s").cast(kind))
    out = B._drawn(sums, "page", "s", 20, 5, 8, None)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "MapInPandas" not in plan  # no Python object for each entry of a list
    b = {}
    for r in out.collect():
        b.setdefault(r["stratum"], []).append(r["b"])
    assert set(b) == {1 if kind == "long" else "1", None} and b[1 if kind == "long" else "1"] == [50.0] * 20
