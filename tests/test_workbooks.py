"""Workbooks: the sink's own, and ones with texts by number, odd cells and broken sheets."""

import zipfile

import pytest
from pyspark.sql import functions as F

from tallystone.sources import workbooks as W

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
DOC = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def book(path, sheets, texts=None):
    """A workbook written by hand: sheets is {name: the XML of its rows}."""
    with zipfile.ZipFile(path, "w") as z:
        ids = list(enumerate(sheets.items(), 1))
        z.writestr("xl/workbook.xml", f'<workbook {MAIN} xmlns:r="{DOC}"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, (n, _) in ids) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{i}" Target="{"/xl/" if i % 2 else ""}worksheets/s{i}.xml"/>' for i, _ in ids) + "</Relationships>")
        for i, (_, rows) in ids:
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {MAIN}><sheetData>{rows}</sheetData></worksheet>")
        if texts is not None:
            z.writestr("xl/sharedStrings.xml", f"<sst {MAIN}>" + "".join(f"<si>{t}</si>" for t in texts) + "</sst>")


def cells(df):
    return {(r["sheet"], r["row_number"]): r["cells"] for r in df.collect()}


def test_kinds_of_cells(spark, tmp_path):
    rows = (
        '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="D1" t="s"><v>0</v></c></row>'
        '<row r="3"><c r="A3"><v>1.2E3</v></c><c r="B3" t="b"><v>1</v></c><c r="D3" t="e"><v>#DIV/0!</v></c></row>'
        '<row r="4"><c r="B4" t="str"><f>X</f><v>formula</v></c><c r="D4" t="inlineStr"><is><r><t>in</t></r><r><t>line</t></r></is></c></row>'
        '<row r="5"><c r="A5" t="s"><v>9</v></c></row><row r="6"><c r="A6"><v>1E-3</v></c><c r="B6" t="s"><v>2</v></c></row>'
    )
    book(tmp_path / "a.xlsx", {"x": rows, "empty": "", "names only": '<row r="1"><c r="A1"><v>1</v></c></row>'}, ["<t>n</t>", "<r><t>te</t></r><r><t>xt</t></r><rPh><t>no</t></rPh>", "<t>N/A</t>"])
    got = cells(W.read_workbooks(spark, str(tmp_path)))
    blank = {"n": None, "text": None, "Unnamed: 2": None, "n.1": None}
    assert got == {("x", 3): blank | {"n": "1200", "text": "True"}, ("x", 4): blank | {"text": "formula", "n.1": "inline"}, ("x", 6): blank | {"n": "0.001"}}


def test_broken_sheets_and_files(spark, tmp_path):
    good = '<row r="1"><c t="str"><v>k</v></c></row><row r="2"><c t="str"><v>v</v></c></row>'
    book(tmp_path / "a.xlsx", {"good": good, "bad": good + "<row r='3'><c>"})
    (tmp_path / "b.xlsx").write_bytes(b"no archive")
    rows = W.read_workbooks(spark, str(tmp_path), "permissive").collect()
    assert sorted((r["file"], r["sheet"] or "", r["row_number"] or 0, r["problem"] is None) for r in rows) == [("a.xlsx", "bad", 0, False), ("a.xlsx", "bad", 2, True), ("a.xlsx", "good", 2, True), ("b.xlsx", "", 0, False)]
    with pytest.raises(Exception, match="b.xlsx"):
        W.read_workbooks(spark, str(tmp_path / "b.xlsx")).collect()
    assert W.read_workbooks(spark, str(tmp_path / "c*.xlsx")).count() == 0
    with pytest.raises(Exception, match="nowhere"):
        W.read_workbooks(spark, str(tmp_path / "nowhere.xlsx")).collect()


def test_round_trip_in_shares(spark, tmp_path):
    """Every row comes back once, however many tasks share a workbook."""
    df = spark.range(3000).select(F.concat(F.lit("s/"), F.col("id") % 37).alias("sheet"), "id", F.concat(F.lit("a<&> \x01é"), "id").alias("t"), (F.col("id") / 4).alias("x"), (F.col("id") % 2 == 0).alias("b"), F.lit(None).cast("string").alias("none"))
    path = str(tmp_path / "out")
    for _ in range(2):  # the second takes the first's place
        W.write_workbooks(df, path, ["id"])
    read = spark.read.format("workbook").option("shareBytes", 500).load("file://" + path)
    assert read.rdd.getNumPartitions() > 37
    rows = read.collect()
    assert sorted(int(r["cells"]["id"]) for r in rows) == list(range(3000))
    for r in rows:
        i = int(r["cells"]["id"])
        assert r["sheet"] == f"s_{i % 37}" and r["cells"]["t"] == f"a<&> �é{i}" and float(r["cells"]["x"]) == i / 4 and r["cells"]["b"] == str(i % 2 == 0) and r["cells"]["none"] is None
        assert r["row_number"] == i // 37 + 2
    assert not [p for p in (tmp_path / "out").iterdir() if p.name.startswith("_")]


def test_sheet_names_that_clash_and_empty_tables(spark, tmp_path):
    df = spark.createDataFrame([("a" * 40 + x, 1) for x in "bcd"] + [("A" * 40, 1), (None, 2), ("", 3)], "page string, v int")
    W.write_workbooks(df.coalesce(1), str(tmp_path / "o"), ["v"], sheet="page")
    names = [r["sheet"] for r in W.read_workbooks(spark, str(tmp_path / "o")).collect()]
    assert len(names) == 6 and all(len(n) <= 31 for n in names)
    W.write_workbooks(df.where("false"), str(tmp_path / "e"), ["v"], sheet="page")
    assert W.read_workbooks(spark, str(tmp_path / "e")).count() == 0


def test_ledger_sheets(spark, tmp_path):
    head = lambda *names: "<row r='1'>" + "".join(f"<c t='inlineStr'><is><t>{n}</t></is></c>" for n in names) + "</row>"
    row = lambda r, *v: f"<row r='{r}'>" + "".join("<c/>" if x is None else f"<c t='str'><v>{x}</v></c>" for x in v) + "</row>"
    full = head(*W.LEDGER) + row(2, " Entry ", "Rent, of 3 farms!", "1,200", "10", "6", "½") + row(3, "strange", "x", "1") + row(4, "total", None, "x", None, None, "3/4")
    book(tmp_path / "a.xlsx", {"1769-1700_3_image": full, "1750_1_image": full, "notes": full, "1751_2_image": head(*W.LEDGER[:-1]) + row(2, "entry", "x")})
    book_rows = W.read_workbooks(spark, str(tmp_path))
    got = sorted((r["year"], r["row_idx"], r["row_type"], r["description_norm"], round(r["amount_decimal"], 6), r["year_weight"], r["sheet_year_span"]) for r in W.ledger_rows(book_rows).collect())
    one = round(1200 + 10 / 20 + 6.5 / 240, 6)
    assert got == [(y, i, k, t, a, w, s) for y, w, s in ((1750, 1.0, "1750"), (1769, 0.5, "1769-1770"), (1770, 0.5, "1769-1770")) for i, k, t, a in ((1, "entry", "rent of 3 farms", one), (3, "total", "", round(0.75 / 240, 6)))]
    sides = spark.createDataFrame([("1750_1_image", 1, "left"), ("1750_1_image", 3, "both")], "page_id string, row_index int, side string")
    assert {(r["sheet"], r["row_idx"]) for r in W.ledger_rows(book_rows, sides).where("side_adjustment = 0.5").collect()} == {("1750_1_image", 1)}


def test_truth_sheets(spark, tmp_path):
    head = "<row r='1'>" + "".join(f"<c t='str'><v>{n}</v></c>" for n in W.TRUTH) + "</row>"
    rows = "<row r='2'><c><v>0</v></c><c t='str'><v> Header</v></c><c t='str'><v>\"quoted \"</v></c><c><v>3</v></c></row><row r='3'><c/><c/><c t='str'><v>left out</v></c></row><row r='4'><c><v>1</v></c></row>"
    book(tmp_path / "a.xlsx", {"p": head + rows})
    got = [tuple(r) for r in W.truth_rows(W.read_workbooks(spark, str(tmp_path))).orderBy("row_number").collect()]
    assert got == [("p", 2, 0, "header", "quoted ", "3", "", "", "", None), ("p", 4, 1, "nan", "", "", "", "", "", None)]


def test_written_workbooks_have_a_bounded_number_of_sheets(spark, tmp_path):
    """So that no directory grows with the table; sheets stay whole, rows in order."""
    df = spark.range(120).selectExpr("id", "concat('s', id div 4) as sheet", "id % 3 as v").coalesce(1)
    W.write_workbooks(df, str(tmp_path / "o"), ["id"], sheets=7)
    sheets = []
    for f in (tmp_path / "o").glob("*.xlsx"):
        with zipfile.ZipFile(f) as z:
            sheets.append(sum(n.startswith("xl/worksheets/") for n in z.namelist()))
    assert sum(sheets) == 30 and max(sheets) <= 7
    rows = W.read_workbooks(spark, str(tmp_path / "o")).orderBy("sheet", "row_number").collect()
    assert {(r["sheet"], r["cells"]["id"], r["cells"]["v"]) for r in rows} == {(f"s{i // 4}", str(i), str(i % 3)) for i in range(120)} and len(rows) == 120
    assert not [p for p in (tmp_path / "o").iterdir() if p.name.startswith("_")]


def test_small_sheets_are_parsed_at_once_and_large_ones_as_streams(tmp_path, monkeypatch):
    row = lambda r, *v: f"<row r='{r}'>" + "".join("<c/>" if x is None else f"<c t='inlineStr'><is><t>{x}</t></is></c>" for x in v) + "</row>"
    good = row(1, "a", "b") + row(2, "x", None) + row(3, None, None) + "<row r='4'><c><v>007</v></c><c><v>12</v></c></row>"
    book(tmp_path / "a.xlsx", {"one": good, "two": good, "bad": good + "<row r='5'><c>"})
    reader = W.WorkbookReader({"path": str(tmp_path), "mode": "permissive"})
    rows = lambda: [r for s in reader.partitions() for b in reader.read(s) for r in b.to_pylist()]
    streamed, whole = [], W.ElementTree.iterparse
    monkeypatch.setattr(W.ElementTree, "iterparse", lambda *a: streamed.append(a) or whole(*a))
    got = rows()
    assert len(streamed) == 1  # the broken sheet alone, for the rows before its fault
    assert [(r["sheet"], r["row_number"], r["cells"] and dict(r["cells"])) for r in got][:3] == [("one", 2, {"a": "x", "b": None}), ("one", 4, {"a": "7", "b": "12"}), ("two", 2, {"a": "x", "b": None})]
    assert len(got) == 7 and got[6]["cells"] is None and got[6]["problem"]
    monkeypatch.setattr(W, "SHEET_BYTES", 0)
    monkeypatch.setattr(W, "WHOLE", 0)
    assert [{**r, "problem": r["problem"] is None} for r in rows()] == [{**r, "problem": r["problem"] is None} for r in got] and len(streamed) == 4


def test_large_sheets_are_written_in_pieces(spark, tmp_path, monkeypatch):
    df = spark.range(50).selectExpr("id", "concat('s', id div 25) as sheet", "id % 3 as v")
    monkeypatch.setattr(W, "SHEET_BYTES", 40)
    schema = df.select("sheet", "id", "v").schema
    writer = W.WorkbookWriter({"path": str(tmp_path / "o")}, schema, True)
    writer.commit([writer.write(iter(df.orderBy("id").select("sheet", "id", "v").toArrow().to_batches()))])
    reader = W.WorkbookReader({"path": str(tmp_path / "o")})
    rows = [r for s in reader.partitions() for b in reader.read(s) for r in b.to_pylist()]
    assert [(r["sheet"], r["row_number"], dict(r["cells"])["id"]) for r in rows] == [(f"s{i // 25}", i % 25 + 2, str(i)) for i in range(50)]
