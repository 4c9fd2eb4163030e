"""Hand-computed cases of the cleaning rules."""

import pytest
from pyspark.sql import functions as F

from tallystone.functions import constants as K
from tallystone.functions import scalars as S


def one(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r["y"] for r in rows.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_money_and_fractions(spark):
    assert one(spark, [None, "", "£1,200", "1.2.3", "-", " 7 ", "3.5"], S.money) == [0, 0, 1200, 0, 0, 7, 3.5]
    assert one(spark, ["¾", "1/4", ".5", "x", None, "0.75"], S.fraction) == [0.75, 0.25, 0.5, 0, 0, 0.75]


def test_amounts(spark):
    r = spark.createDataFrame([("3", "4", "6", "½")], "p string, s string, d string, f string")
    got = r.select(S.pounds(S.money("p"), S.money("s"), S.money("d"), S.fraction("f")).alias("a"), S.pence("p", "s", "d").alias("b")).first()
    assert got["a"] == pytest.approx(3.2270833333) and got["b"] == 774


def test_normal_values(spark):
    assert one(spark, ["0", "5.0", " 7 ", None, "0.0"], S.normal_value) == ["", "5", "7", "", ""]
    assert one(spark, ['"Quoted"', " 'a' ", "Plain", None, "\"x'"], S.clean_description) == ["quoted", "a", "plain", "", "\"x'"]
    assert one(spark, ["Paid the Smith, 3rd  time!", None], S.normal_text) == ["paid the smith 3rd time", ""]
    assert one(spark, ["Soluta 1745. Ordinaria", "1745", "12 - 4"], S.normal_header) == ["soluta . ordinaria", None, None]


def test_price_index_and_eras(spark):
    assert one(spark, [1699, 1755, 1905, None], S.price_index, "int") == [100.0, pytest.approx(110.2), 169.7, None]
    assert one(spark, [1759, 1760, 1840, 1841], S.era, "int") == ["pre_industrial", "industrial", "industrial", "post_industrial"]
    assert one(spark, [1779, 1780, 1819, 1820, 1859, 1860], lambda x: S.era(x, K.ERAS4), "int") == ["pre_industrial", "transition", "transition", "early_industrial", "early_industrial", "late_industrial"]
    assert one(spark, [1799, 1800], S.decade, "int") == [1790, 1800]


def test_page_ids(spark):
    ids = ["1700_1_image", "1721-1722_6_image", "1775-1774_2_image", "1769-1700_3_image", "scan of 1801", "none", None]
    assert one(spark, ids, S.page_years) == [[1700], [1721, 1722], [1774, 1775], [1769, 1770], [1801], None, None]
    assert len(one(spark, ["1769-1700_3_image"], lambda x: S.page_years(x, None))[0]) == 70
    assert one(spark, ids[:5], S.page_number) == [1, 6, 2, 3, 1]


def test_labels(spark):
    assert one(spark, ["in", None, " Latin "], lambda x: S.coerced(x, K.LANGUAGES, "mixed")) == ["mixed", "mixed", "latin"]
    assert one(spark, ["Soluta Ordinaria", "Arrearagia recepta", "Recepta et soluta", "Misc"], S.header_direction) == ["expenditure", "income", "income", None]
    assert one(spark, ["Worcester College", "City Bank", "Banbury", "Paris"], lambda x: S.first_group(x, K.PLACE_CLUSTERS, "other")) == ["oxford_local", "london", "oxfordshire", "other"]
    assert one(spark, ["A; B;; C ", None, ""], S.names) == [["A", "B", "C"], [], []]


def test_ratios(spark):
    r = spark.createDataFrame([("abc", "abd"), ("abc", ""), ("", "")], "a string, b string").select(S.lev_ratio("a", "b").alias("r")).collect()
    assert [x["r"] for x in r] == [pytest.approx(2 / 3), -1, 1]
    r = spark.createDataFrame([(240, 241), (0, 0), (1, 3)], "a int, b int").select(S.amount_similarity("a", "b").alias("r"), S.ratio("a", F.lit(0)).alias("z")).collect()
    assert [x["r"] for x in r] == [pytest.approx(240 / 241), 1, pytest.approx(1 / 3)] and r[0]["z"] is None


def test_json_replies(spark):
    x = ['{"a": 1}', 'Sure:\n```json\n{"a": {"b": 2}}\n```', "no", None, '{"a": 1', '{"a": 1} }']
    assert one(spark, x, S.json_reply) == ['{"a": 1}', '{"a": {"b": 2}}', None, None, None, None]


def test_strict_amounts_are_errors(spark):


    ok = spark.createDataFrame([("£1,200.5",), ("",), (None,)], "x string").select(S.money_strict("x").alias("y")).collect()
    assert [r["y"] for r in ok] == [1200.5, 0.0, 0.0]
    with pytest.raises(Exception, match="not an amount"):
        spark.createDataFrame([("1.2.3",)], "x string").select(S.money_strict("x")).collect()
