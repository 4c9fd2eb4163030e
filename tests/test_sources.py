import json

from pyspark.sql import functions as F

from tallystone.operators import providers as P
from tallystone.sources import pages as S
from tallystone.sources import sinks as K
from tallystone.streaming import streams as M


def write(path, name, rows, **more):
    (path / name).write_text(json.dumps({"rows": rows, **more}))


def entry(i, text, pounds="", kind="entry", **more):
    return {"row_index": i, "row_type": kind, "description": text, "amount_pounds": pounds, "amount_shillings": 4, "amount_pence_whole": "6", "amount_pence_fraction": "½", **more}


def test_pages_to_entries(spark, tmp_path):
    write(tmp_path, "1721-1722_6_image_enriched.json", [entry(0, "Recepta", kind="header"), entry(1, "rent of farm", 3, direction="Income", category="land_rent"), entry(2, "odd", kind="strange")])
    write(tmp_path, "x.json", [entry(0, "alone", "1,200", confidence_score=2.5)], page_id="1800_1_image")
    (tmp_path / "bad.json").write_text("{not json")
    pages = S.read_pages(spark, str(tmp_path))
    assert {r["page_id"] for r in pages.collect()} == {"1721-1722_6_image", "1800_1_image"}
    rows = S.with_headers(S.page_rows(pages))
    e = {(r["page_id"], r["row_index"], r["year"]): r for r in S.entries(rows).collect()}
    assert len(e) == 5
    r = e[("1721-1722_6_image", 1, 1722)]
    assert r["section_header"] == "Recepta" and r["direction"] == "income" and r["year_weight"] == 0.5 and abs(r["amount"] - 3.2270833333) < 1e-9
    assert e[("1800_1_image", 0, 1800)]["confidence"] == 1.0 and e[("1800_1_image", 0, 1800)]["category"] == "other"
    assert [r["header_norm"] for r in S.headers(rows).collect()] == ["recepta"]
    have, missing = S.of_pages(rows, spark.createDataFrame([("1800_1_image",), ("1900_1_image",)], "page_id string"))
    assert have.count() == 1 and missing.first()["page_id"] == "1900_1_image"
    summary = [tuple(r)[:5] for r in K.page_summary(rows).collect()]
    assert summary == [("1721-1722_6_image", 3, 2, 1, 0), ("1800_1_image", 1, 1, 0, 0)]
    K.write_pages(rows, ["row_index", "description"], str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    labels = P.enriched(rows).where("description = 'rent of farm'").first()
    assert labels["direction"] == "income" and labels["category"] == "land_rent"


def test_merge_takes_the_last_label(spark):
    rows = spark.createDataFrame([("p", 0), ("p", 1)], "page_id string, row_index int")
    labels = spark.createDataFrame([("p", 0, "a", 1), ("p", 0, "b", 2)], "page_id string, row_index int, category string, ord int")
    assert {r["row_index"]: r["category"] for r in S.merge_labels(rows, labels, ["category"]).collect()} == {0: "b", 1: None}


def test_other_readers(spark, tmp_path):
    (tmp_path / "v.json").write_text('{"p1": [0.5, 1], "p2": []}')
    assert {r["page"]: r["vector"] for r in S.read_vectors(spark, str(tmp_path / "v.json")).collect()} == {"p1": [0.5, 1.0], "p2": []}
    (tmp_path / "s.csv").write_text("page,axis1_score\n1_1,0.5\n2_1,x\n")
    assert [r["axis1"] for r in S.read_scores(spark, str(tmp_path / "s.csv"), "t", {"axis1_score": "axis1"}).collect()] == [0.5, None]
    (tmp_path / "a.png").write_bytes(b"123")
    assert S.images(spark, str(tmp_path)).select("page", "length").first()[:] == ("a", 3)


def test_providers(spark):
    df = spark.createDataFrame([(1, "rent of the farm per annum"), (2, None)], "id int, prompt string")
    got = {r["id"]: r["reply"] for r in P.replies(df, "prompt", P.stub).collect()}
    assert "land_rent" in got[1] and "annual" in got[1]

    def fails(_):
        raise RuntimeError

    assert {r["reply"] for r in P.replies(df, "prompt", fails).collect()} == {""}
    best = P.candidates({"x": df.withColumn("page_id", F.lit(1)), "y": df.withColumn("page_id", F.lit(1))}).first()
    assert best["best"] == "x"
    assert P.model_grid(a=["1", "2"], b=["3"])(df).count() == 4


def test_streams(spark, tmp_path):
    src = "/root/testdata/sf0.001/events.parquet"
    events = spark.read.parquet(src)
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = M.windowed_totals(stream, "ts", "event_type", "value").writeStream.format("memory").queryName("totals").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("totals").agg(F.sum("n")).first()[0]
    assert 0 < got <= events.count()
    M.upsert(M.first_seen(stream, "ts", "user_id", "10000 days"), str(tmp_path / "c2"), str(tmp_path / "out")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == events.select("user_id").distinct().count()


def test_new_pages_are_read_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    write(tmp_path / "in", "1.json", [entry(0, "a"), entry(1, "b")], page_id="1700_1_image")
    read = lambda: M.upsert(M.new_pages(spark, str(tmp_path / "in")).select("page_id", F.size("rows").alias("n")), str(tmp_path / "c"), str(tmp_path / "out")).awaitTermination(120)
    read()
    write(tmp_path / "in", "2.json", [entry(0, "c")], page_id="1701_1_image")
    read()
    assert sorted(tuple(r)[:2] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("1700_1_image", 2), ("1701_1_image", 1)]


def test_running_counts(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    M.running_counts(stream, "event_type").writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    assert {tuple(r) for r in spark.table("counts").collect()} == {tuple(r) for r in events.groupBy("event_type").count().collect()}


def test_retries_keep_the_better_score(spark):
    scores = spark.createDataFrame([(1, 0.5), (2, 0.9)], "page int, combined double")
    again = P.retried(scores, lambda df: df.withColumn("combined", F.lit(0.6)), times=1)
    assert {r["page"]: r["combined"] for r in again.collect()} == {1: 0.6, 2: 0.9}


def test_pages_are_compressed_and_dealt_once(spark, tmp_path):
    rows = spark.range(60).select((F.col("id") % 6).alias("order"), (F.col("id") / 6).cast("int").alias("row_index"), F.concat(F.lit("rent of farm "), "id").alias("description"))
    rows = rows.repartition(4, "order").select("order", F.concat_ws("_", F.lit("1700"), "order", F.lit("image")).alias("page_id"), "row_index", "description")
    assert K.page_documents(rows, ["row_index", "description"], within="order")._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    K.write_pages(rows, ["row_index", "description"], str(tmp_path / "out"), within="order")
    assert {p.suffix for p in (tmp_path / "out").glob("part-*")} == {".gz"}
    back = S.page_rows(S.read_pages(spark, str(tmp_path / "out"), lines=True)).select("page_id", "row_index", "description")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.drop("order").collect()))
