"""Workbooks (.xlsx) as a Spark data source and sink: `spark.read.format("workbook")`, `df.write.format("workbook")`.

A task reads a share of one workbook's sheets, by size, and of the archive only its directory, its texts and these
sheets; the rows of a sheet are streamed. The driver lists files and opens none. Paths are what pyarrow's file systems
read: shared folders, or addresses with a scheme.

The first row of a sheet names its columns. Cells are texts: numbers without exponent, errors null, texts that stand
for a missing value null. A workbook or sheet that cannot be read gives an error, or with mode `permissive` one row
that tells the problem, after the rows before it. Sheets without rows give none.
"""

from __future__ import annotations

import io
import re
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from contextlib import nullcontext
from dataclasses import dataclass
from decimal import Decimal
from fnmatch import fnmatch
from functools import lru_cache
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..functions import scalars as S
from ..shipping import ship

SCHEMA = "file STRING, sheet STRING, sheet_index INT, row_number INT, cells MAP<STRING, STRING>, problem STRING"
_ARROW = pa.schema([("file", pa.string()), ("sheet", pa.string()), ("sheet_index", pa.int32()), ("row_number", pa.int32()), ("cells", pa.map_(pa.string(), pa.string())), ("problem", pa.string())])

# Texts of a cell that stand for a missing value.
MISSING = frozenset(["", " ", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"])

# The names and limits of the format.
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_DOC = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
MAX_ROWS, MAX_NAME = 1_048_576, 31

#: Sheets of a written workbook. Whoever reads a share of one reads its whole directory, so that this must not grow with the table.
SHEETS = 1_000
#: Bytes up to which a file, and the XML of a sheet, is held as a whole, since many small reads and elements of a stream cost more than the work on them.
WHOLE, SHEET_BYTES = 16 << 20, 1 << 20

_PLAIN = re.compile(r"(0|[1-9][0-9]{0,14})").fullmatch
_ILLEGAL = re.compile("[^\\x09\\x0A\\x20-\\uD7FF\\uE000-\\uFFFD\\U00010000-\\U0010FFFF]").sub


def _open(path: str) -> tuple[fs.FileSystem, str]:
    if re.match(r"^[a-z][a-z0-9+.-]*:/", path):
        return fs.FileSystem.from_uri(path if "://" in path else path.replace(":/", ":///", 1))
    return fs.LocalFileSystem(), path


@lru_cache(1024)
def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _number(text: str) -> str | None:
    """A number as plain digits, so that no later cleaning takes an exponent apart; null if it is none."""
    if _PLAIN(text):
        return text
    try:
        x = Decimal(repr(float(text)))
    except ValueError:
        return None
    if not x.is_finite():
        return None
    return str(int(x)) if x == x.to_integral_value() else format(x, "f")


def _column(reference: str | None, before: int) -> int:
    """The place of a cell from a name like `AB7`; without one it is the next."""
    letters = re.match(r"[A-Z]+", reference) if reference else None
    if letters is None:
        return before + 1
    at = 0
    for c in letters[0]:
        at = at * 26 + ord(c) - 64
    return at - 1


def _elements(stream, name: str) -> Iterator[ElementTree.Element]:
    """Finished elements of a name, each freed, with all that came before it, once the next is asked for."""
    if isinstance(stream, ElementTree.Element):
        yield from (e for e in stream.iter() if _local(e.tag) == name)
        return
    parents: list[ElementTree.Element] = []
    for event, e in ElementTree.iterparse(stream, ("start", "end")):
        if event == "start":
            parents.append(e)
            continue
        parents.pop()
        if _local(e.tag) == name:
            yield e
            if parents:
                parents[-1].clear()


def _text(e: ElementTree.Element) -> str:
    """The runs of a text, without their phonetic readings."""
    return "".join(t.text or "" for part in (e, *e) if part is e or _local(part.tag) == "r" for t in part if _local(t.tag) == "t")


def _value(cell: ElementTree.Element, texts: list[str]) -> str | None:
    if not len(cell):
        return None
    kind = cell.get("t", "n")
    if kind == "inlineStr" and len(cell) == len(cell[0]) == 1 and _local(cell[0].tag) == "is" and _local(cell[0][0].tag) == "t":
        got = cell[0][0].text or ""
    elif kind == "inlineStr":
        inner = next((x for x in cell if _local(x.tag) == "is"), None)
        got = None if inner is None else _text(inner)
    else:
        v = next((x.text for x in cell if _local(x.tag) == "v"), None)
        if v is None or kind == "e":
            return None
        if kind == "s":
            got = texts[int(v)] if v.strip().isdigit() and int(v) < len(texts) else None
        else:
            got = {"b": lambda: "True" if v.strip() == "1" else "False", "n": lambda: _number(v)}.get(kind, lambda: v)()
    return None if got in MISSING else got


def _sheets(z: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, member) of the sheets in their order."""
    target = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    out = []
    for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{{{_MAIN}}}sheet"):
        t = target.get(s.get(f"{{{_DOC}}}id"), "")
        out.append((s.get("name", ""), t.lstrip("/") if t.startswith("/") else "xl/" + t))
    return out


def _names(first: dict[int, str | None]) -> dict[int, str]:
    """Column names by place; a repeated one gets a number, one that is missing its place."""
    out: dict[int, str] = {}
    seen: dict[str, int] = {}
    for i in range(max(first, default=-1) + 1):
        name = first.get(i) or f"Unnamed: {i}"
        n = seen[name] = seen.get(name, -1) + 1
        out[i] = f"{name}.{n}" if n else name
    return out


def _sheet(z: zipfile.ZipFile, member: str):
    """A small sheet's tree, or its stream: if it is large, or broken, as the rows before the fault are wanted too."""
    if z.getinfo(member).file_size <= SHEET_BYTES:
        try:
            return nullcontext(ElementTree.fromstring(z.read(member)))
        except (ElementTree.ParseError, zipfile.BadZipFile, zlib.error):
            pass
    return z.open(member)


def _rows(stream, texts: list[str]) -> Iterator[tuple[int, tuple[list[str], list[str | None]]]]:
    """(number, (names, values)) of the rows that have any value."""
    names: dict[int, str] | None = None
    number = 0
    for row in _elements(stream, "row"):
        number = int(row.get("r") or number + 1)
        cells, at = {}, -1
        for c in row:
            if _local(c.tag) == "c":
                at = _column(c.get("r"), at)
                cells[at] = _value(c, texts)
        if names is None:
            names = _names(cells)
        elif any(v is not None for v in cells.values()):
            yield number, (list(names.values()), [cells.get(i) for i in names])


@dataclass
class Share(InputPartition):
    path: str
    part: int
    parts: int


class WorkbookReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.strict = options["path"], options.get("mode", "failfast").lower() != "permissive"
        self.share = int(options.get("sharebytes", 8 << 20))

    def partitions(self) -> list[InputPartition]:
        """One a share of a file, by the listed sizes alone."""
        system, path = _open(self.path)
        folder, _, pattern = path.rpartition("/")
        if any(c in pattern for c in "*?["):
            infos = [i for i in system.get_file_info(fs.FileSelector(folder or ".")) if fnmatch(i.base_name, pattern)]
        else:
            one = system.get_file_info(path)
            if one.type == fs.FileType.NotFound:
                raise FileNotFoundError(self.path)
            infos = [one] if one.is_file else [i for i in system.get_file_info(fs.FileSelector(path)) if i.base_name.lower().endswith(".xlsx")]
        files = sorted((i.path, i.size or 0) for i in infos if i.is_file and not i.base_name.startswith(("_", ".", "~")))
        out: list[InputPartition] = []
        for p, size in files:
            parts = max(1, -(-size // self.share))
            out += [Share(_address(self.path, path, p), k, parts) for k in range(parts)]
        return out

    def read(self, share: Share | None) -> Iterator[pa.RecordBatch]:
        if share is None:  # no files
            return
        name = share.path.rpartition("/")[2]
        buffer: list[tuple] = []

        def batch() -> pa.RecordBatch:
            columns = [list(c) for c in zip(*buffer, strict=True)]
            at, offsets, names, values = 0, [], [], []
            for c in columns[4]:
                offsets.append(None if c is None else at)
                if c is not None:
                    names += c[0]
                    values += c[1]
                    at = len(names)
            cells = pa.MapArray.from_arrays(pa.array([*offsets, at], pa.int32()), pa.array(names, pa.string()), pa.array(values, pa.string()))
            arrays = [cells if i == 4 else pa.array(c, t) for i, (c, t) in enumerate(zip(columns, _ARROW.types, strict=True))]
            buffer.clear()
            return pa.RecordBatch.from_arrays(arrays, schema=_ARROW)

        where: tuple[str | None, int | None] = (None, None)
        try:
            system, path = _open(share.path)
            with system.open_input_file(path) as f, zipfile.ZipFile(io.BytesIO(f.read()) if f.size() <= WHOLE else f) as z:
                sheets = _sheets(z)
                size = {i.filename: i.compress_size for i in z.infolist()}
                total, before, mine = sum(size.get(m, 0) for _, m in sheets) or 1, 0, []
                for k, (sheet, member) in enumerate(sheets):
                    if before * share.parts // total == share.part:
                        mine.append((k, sheet, member))
                    before += min(size.get(member, 0), total - 1 - before)
                texts: list[str] = []
                if mine and "xl/sharedStrings.xml" in size:
                    with z.open("xl/sharedStrings.xml") as s:
                        texts = [_text(e) for e in _elements(s, "si")]
                for k, sheet, member in mine:
                    where = (sheet, k)
                    try:
                        with _sheet(z, member) as s:
                            for number, cells in _rows(s, texts):
                                buffer.append((name, sheet, k, number, cells, None))
                                if len(buffer) >= 2000:
                                    yield batch()
                    except (KeyError, ValueError, ElementTree.ParseError, zipfile.BadZipFile) as e:
                        if self.strict:
                            raise
                        buffer.append((name, sheet, k, None, None, f"{type(e).__name__}: {e}"))
        except (KeyError, ValueError, ElementTree.ParseError, zipfile.BadZipFile) as e:
            if self.strict:
                raise ValueError(f"{share.path}, sheet {where[0]}: {e}") from e
            if share.part == 0:
                buffer.append((name, *where, None, None, f"{type(e).__name__}: {e}"))
        if buffer:
            yield batch()


def _address(given: str, root: str, found: str) -> str:
    """The address of a found file in the form of the given one, so that a task opens the same file system."""
    return given[: len(given) - len(root)] + found if given.endswith(root) else found


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class WorkbookWriter(DataSourceArrowWriter):
    """A task writes workbooks of at most SHEETS sheets, streamed, its rows in the order that they come in: a change of
    the sheet's name starts the next sheet, and a workbook that is full the next workbook. Files are written beside the
    folder's others and moved in when all are whole."""

    def __init__(self, options: dict[str, str], schema: StructType, overwrite: bool):
        self.given, self.overwrite = options["path"].rstrip("/"), overwrite
        self.path = _open(self.given)[1]
        self.names = [n for n in schema.names if n != "sheet"]
        self.at = schema.names.index("sheet")
        self.temporary = f"{self.path}/_temporary-{uuid.uuid4().hex}"
        self.sheets = int(options.get("sheets", SHEETS))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, _ = _open(self.given)
        system.create_dir(self.temporary, recursive=True)
        done: list[str] = []
        book: _Book | None = None
        raw = None
        try:
            for b in iterator:
                columns = [b.column(i).to_pylist() for i in range(b.num_columns)]
                for r in range(b.num_rows):
                    sheet = columns[self.at][r]
                    if book is not None and len(book.sheets) >= self.sheets and sheet != book.given:
                        book.close()
                        raw.close()
                        book = None
                    if book is None:
                        done.append(f"part-{uuid.uuid4().hex}.xlsx")
                        raw = system.open_output_stream(f"{self.temporary}/{done[-1]}", compression=None)
                        book = _Book(raw, self.names)
                    book.add(sheet, [c[r] for i, c in enumerate(columns) if i != self.at])
            if book is not None:
                book.close()
        finally:
            if raw is not None:
                raw.close()
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        system, _ = _open(self.given)
        if self.overwrite:
            for i in system.get_file_info(fs.FileSelector(self.path, allow_not_found=True)):
                if i.is_file:
                    system.delete_file(i.path)
        system.create_dir(self.temporary, recursive=True)
        for m in messages:
            for name in m.names if m is not None else ():
                system.move(f"{self.temporary}/{name}", f"{self.path}/{name}")
        system.delete_dir(self.temporary)

    def abort(self, messages: list[Written | None]) -> None:
        system, _ = _open(self.given)
        if system.get_file_info(self.temporary).type == fs.FileType.Directory:
            system.delete_dir(self.temporary)


class _Book:
    def __init__(self, raw, names: list[str]):
        self.zip = zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED)
        self.names, self.sheets, self.taken = names, [], set()
        self.given: str | None = None
        self.out = None
        self.rows: list[str] | None = None  # of the open sheet, not yet written

    def _row(self, number: int, values: list) -> None:
        cells = []
        for v in values:
            if v is None:
                cells.append("<c/>")
            elif isinstance(v, bool):
                cells.append(f'<c t="b"><v>{int(v)}</v></c>')
            elif isinstance(v, (int, float, Decimal)) and v == v and abs(v) != float("inf"):
                cells.append(f"<c><v>{v}</v></c>")
            else:
                text = _ILLEGAL("\uFFFD", str(v))
                cells.append(f'<c t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>')
        self.rows.append(f'<row r="{number}">{"".join(cells)}</row>')
        self.held += len(self.rows[-1])
        if self.held > SHEET_BYTES:
            self._flush()

    def _flush(self) -> None:
        """Writes what a large sheet has so far; a small one is written in one piece at its end."""
        if self.out is None:
            self.out = self.zip.open(f"xl/worksheets/sheet{len(self.sheets)}.xml", "w", force_zip64=True)
        self.out.write("".join(self.rows).encode())
        self.rows, self.held = [], 0

    def _next(self, given: str) -> None:
        self._end()
        base = re.sub(r"[\[\]:*?/\\]", "_", given)[:MAX_NAME] or "sheet"
        name, n = base, 1
        while name.lower() in self.taken:
            n += 1
            name = base[: MAX_NAME - len(str(n)) - 3] + f" ({n})"
        self.taken.add(name.lower())
        self.sheets.append(name)
        self.rows, self.held = [f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{_MAIN}"><sheetData>'], 0
        self.number = 1
        self._row(1, self.names)

    def _end(self) -> None:
        if self.rows is None:
            return
        self.rows.append("</sheetData></worksheet>")
        if self.out is None:
            self.zip.writestr(f"xl/worksheets/sheet{len(self.sheets)}.xml", "".join(self.rows))
        else:
            self._flush()
            self.out.close()
        self.out = self.rows = None

    def add(self, sheet: str | None, values: list) -> None:
        if self.rows is None or sheet != self.given or self.number >= MAX_ROWS:
            self._next(sheet or "")
            self.given = sheet
        self.number += 1
        self._row(self.number, values)

    def close(self) -> None:
        self._end()
        quoted = lambda x: escape(x, {'"': "&quot;"})
        ids = range(1, len(self.sheets) + 1)
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in ids)
        self.zip.writestr("[Content_Types].xml", f'<?xml version="1.0" encoding="UTF-8"?><Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>')
        self.zip.writestr("_rels/.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_DOC}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        sheets = "".join(f'<sheet name="{quoted(n)}" sheetId="{i}" r:id="rId{i}"/>' for i, n in zip(ids, self.sheets, strict=True))
        self.zip.writestr("xl/workbook.xml", f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="{_MAIN}" xmlns:r="{_DOC}"><sheets>{sheets}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{i}" Type="{_DOC}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in ids)
        self.zip.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{_PACKAGE}/relationships">{links}</Relationships>')
        self.zip.close()


class Workbooks(DataSource):
    """Options: path (a file, a folder, or a pattern of names in a folder), mode, shareBytes."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return WorkbookReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> WorkbookWriter:
        return WorkbookWriter(dict(self.options), schema, overwrite)


def _ready(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(Workbooks)


def read_workbooks(spark: SparkSession, path: str, mode: str = "failfast") -> DataFrame:
    """(file, sheet, sheet_index, row_number, cells, problem): one row a row of a sheet that has any value."""
    _ready(spark)
    return spark.read.format("workbook").option("mode", mode).load(path)


def write_workbooks(df: DataFrame, path: str, order: list[str], sheet: str = "sheet", sheets: int = SHEETS) -> None:
    """A folder of workbooks of at most so many sheets: each sheet is whole in one of them, its rows in an order. A sheet is a bounded group."""
    _ready(df.sparkSession)
    named = df.withColumnRenamed(sheet, "sheet")
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # one or more workbooks each; by number, so that small sheets are not merged into one task
    named.repartition(parts, "sheet").sortWithinPartitions("sheet", *order).write.format("workbook").option("sheets", sheets).mode("overwrite").save(path)


#: The columns of an account sheet.
LEDGER = ["Type", "Description", "£ (Pounds)", "s (Shillings)", "d (Pence)", "d Fraction"]


def ledger_rows(book: DataFrame, sides: DataFrame | None = None) -> DataFrame:
    """Account rows, once a year of their sheet: amounts, texts as typed and normal, weights by the number of years.

    Sheets whose name is no page's, or that lack a column, are left out, as are rows of another type. With a table of
    (page_id, row_index, side), rows with a side count half.
    """
    cell = lambda k: F.col("cells")[k]
    kept = book.where(F.col("sheet").rlike(r"^\d{4}(-\d{4})?_\d+_image$"))
    for k in LEDGER:
        kept = kept.where(F.map_contains_key("cells", k))
    r = kept.select(
        "file", "sheet", S.page_number("sheet").alias("page"), (F.col("row_number") - 1).alias("row_idx"), F.lower(F.trim(cell("Type"))).alias("row_type"),
        F.coalesce(cell("Description"), F.lit("")).alias("description_raw"), S.normal_text(cell("Description")).alias("description_norm"),
        S.pounds(S.money(cell(LEDGER[2])), S.money(cell(LEDGER[3])), S.money(cell(LEDGER[4])), S.fraction(cell(LEDGER[5]))).alias("amount_decimal"), S.page_years("sheet").alias("years"),
    ).where("row_type in ('header', 'entry', 'total')")
    factor: Column = F.lit(1.0)
    if sides is not None:
        s = sides.select(F.col("page_id").alias("sheet"), F.col("row_index").alias("row_idx"), "side")
        r = r.join(s, ["sheet", "row_idx"], "left")
        factor = F.when(F.col("side").isin("left", "right"), 0.5).otherwise(1.0)
    r = r.withColumns({"year_weight": 1.0 / F.size("years"), "side_adjustment": factor})
    r = r.withColumn("sheet_year_span", F.when(F.size("years") > 1, F.concat_ws("-", F.element_at("years", 1), F.element_at("years", -1))).otherwise(F.element_at("years", 1).cast("string")))
    r = r.withColumn("year", F.explode("years")).drop("years")
    return r.withColumns({"amount_weighted": F.col("amount_decimal") * F.col("year_weight") * F.col("side_adjustment"), "era": S.era("year")})


def year_documents(rows: DataFrame) -> DataFrame:
    """A year's entries and totals with a text: their number, the sum and median of their amounts. Texts stay rows: a year is the document of term_counts."""
    described = rows.where("row_type in ('entry', 'total') and description_norm <> ''")
    g = described.groupBy("year").agg(F.count("*").alias("n_descriptions"), F.sum("amount_weighted").alias("amount_sum"), F.median("amount_decimal").alias("amount_median"))
    return g.withColumn("era", S.era("year"))


#: The columns of a ground-truth sheet, in the order of its documents.
TRUTH = ["row_index", "row_type", "description", "amount_pounds", "amount_shillings", "amount_pence_whole", "amount_pence_fraction"]


def truth_rows(book: DataFrame) -> DataFrame:
    """Rows of ground-truth sheets with page_id, in their order; rows with neither index nor type are left out."""
    cell = lambda k: F.trim(F.col("cells")[k])
    text = F.coalesce(cell("description"), F.lit(""))
    bare = F.when(text.rlike(r'(?s)^".*"$') & (F.length(text) > 1), F.substr(text, F.lit(2), F.length(text) - 2)).when(text == '"', "").otherwise(text)
    values = {k: F.coalesce(cell(k), F.lit("")).alias(k) for k in TRUTH if k.startswith("amount") or k == "row_index"}
    rows = book.where(F.coalesce(cell("row_index"), cell("row_type")).isNotNull())
    side = F.nullif(cell("side"), F.lit(""))
    kind = F.lower(F.coalesce(cell("row_type"), F.lit("nan")))
    return rows.select(F.col("sheet").alias("page_id"), "row_number", values["row_index"].try_cast("int").alias("row_index"), kind.alias("row_type"), bare.alias("description"), *[values[k] for k in TRUTH[3:]], side.alias("side"))
