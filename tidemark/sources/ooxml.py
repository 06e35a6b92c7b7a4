"""Spreadsheets and documents of the Office Open XML kind, by the standard library's ZIP and XML.

Reading: Spark lists and reads the files, wherever they lie; each file is parsed in a task, row by row.
Writing: a Python data source; each task writes workbooks of its own rows, and what failed tasks left is
removed at the commit.
"""

from __future__ import annotations

import datetime as dt
import io
import posixpath
import re
import uuid
import zipfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from decimal import Decimal
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..functions.columns import moment

#: Fixed values of the format: names of its parts and elements, and its limits.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINKS = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
MOST_ROWS, MOST_CHARS = 1_048_576, 32_767
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
EPOCH, EPOCH_1904 = dt.datetime(1899, 12, 30), dt.datetime(1904, 1, 1)
DAY = 86_400_000_000

_COLUMN = re.compile(r"[A-Z]+")
_CODED = re.compile(r"_x([0-9A-Fa-f]{4})_")
_UNSAFE = re.compile(r"[\x00-\x08\x0b\x0c\x0d\x0e-\x1f￾￿]|_(?=x[0-9A-Fa-f]{4}_)")
#: What a broken file raises while it is read.
BROKEN = (zipfile.BadZipFile, ElementTree.ParseError, KeyError, EOFError, ValueError, IndexError, NotImplementedError, OverflowError, RuntimeError)


def _coded(text: str) -> str:
    """Text with the characters that XML has not, and what looks like their code, as codes."""
    return escape(_UNSAFE.sub(lambda m: f"_x{ord(m[0]):04X}_", text))


def _uncoded(text: str) -> str:
    return _CODED.sub(lambda m: chr(int(m[1], 16)), text)


def _place(reference: str) -> int:
    """Number, from 0, of a cell's column: A, B, ..., Z, AA, ..."""
    n = 0
    for letter in _COLUMN.match(reference)[0]:
        n = n * 26 + ord(letter) - 64
    return n - 1


def _runs(item: ElementTree.Element) -> str:
    """The text of an item: its own, or its runs'; readings of ideographs don't count."""
    own = [t.text or "" for child in item for t in ([child] if child.tag == f"{MAIN}t" else child.iterfind(f"{MAIN}t") if child.tag == f"{MAIN}r" else ())]
    return _uncoded("".join(own))


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """The numbers of cell styles that show dates."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in root.iter(f"{MAIN}numFmt")}
    dates = {i for i, code in own.items() if re.search("[ymdhs]", re.sub(r'"[^"]*"|\\.|\[(?![hms]+\])[^\]]*\]', "", code), re.I)} | (DATE_FORMATS - own.keys())
    cells = root.find(f"{MAIN}cellXfs")
    return {i for i, x in enumerate(cells if cells is not None else ()) if int(x.get("numFmtId", 0)) in dates}


def _date(serial: str, epoch: dt.datetime) -> str:
    return (epoch + dt.timedelta(microseconds=int((Decimal(serial) * DAY).to_integral_value()))).isoformat(" ")


def sheet_rows(content: bytes, sheet: str | None = None) -> Iterator[tuple[str, int, list[str | None]]]:
    """(sheet, row number, cells as text) of a workbook's sheets, or of the one of this name.

    Dates are in ISO form, booleans true or false, errors null; formulas give their stored value. Broken
    content raises one of BROKEN.
    """
    book = zipfile.ZipFile(io.BytesIO(content))
    if broken := book.testzip():
        raise zipfile.BadZipFile(broken)
    root = ElementTree.fromstring(book.read("xl/workbook.xml"))
    settings = root.find(f"{MAIN}workbookPr")
    epoch = EPOCH_1904 if settings is not None and settings.get("date1904") in ("1", "true") else EPOCH
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    dates, shared = _date_styles(book), []
    if "xl/sharedStrings.xml" in book.namelist():
        for _, item in ElementTree.iterparse(book.open("xl/sharedStrings.xml")):
            if item.tag == f"{MAIN}si":
                shared.append(_runs(item))
                item.clear()

    def value(cell: ElementTree.Element) -> str | None:
        kind = cell.get("t", "n")
        if kind == "inlineStr":
            inline = cell.find(f"{MAIN}is")
            return None if inline is None else _runs(inline)
        raw = cell.findtext(f"{MAIN}v")
        if raw is None or kind == "e":
            return None
        if kind == "s":
            return shared[int(raw)]
        if kind == "b":
            return "true" if raw == "1" else "false"
        if kind == "str":
            return _uncoded(raw)
        return _date(raw, epoch) if kind == "n" and int(cell.get("s", -1)) in dates else raw

    for part in root.iter(f"{MAIN}sheet"):
        if sheet is not None and part.get("name") != sheet:
            continue
        target = targets[part.get(f"{LINKS}id")]
        path, number = posixpath.normpath(target.lstrip("/") if target.startswith("/") else f"xl/{target}"), 0
        for _, row in ElementTree.iterparse(book.open(path)):
            if row.tag != f"{MAIN}row":
                continue
            number = int(row.get("r", number + 1))
            cells: list[str | None] = []
            for cell in row.iterfind(f"{MAIN}c"):
                at = _place(cell.get("r")) if cell.get("r") else len(cells)
                cells += [None] * (at + 1 - len(cells))
                cells[at] = value(cell)
            row.clear()
            yield part.get("name"), number, cells


def workbook_text(content: bytes) -> str:
    """All sheets' rows that have a value, as lines, with bars between cells."""
    return "\n".join(" | ".join(x or "" for x in cells) for _, _, cells in sheet_rows(content) if any(cells))


def document_text(content: bytes) -> str:
    """Paragraphs as lines; tables' rows as lines with bars between cells."""
    document = zipfile.ZipFile(io.BytesIO(content))
    body = ElementTree.fromstring(document.read("word/document.xml")).find(f"{WORD}body")
    marks = {f"{WORD}tab": "\t", f"{WORD}br": "\n", f"{WORD}cr": "\n"}

    def text(block: ElementTree.Element) -> str:
        return "".join(marks.get(x.tag) or (x.text or "" if x.tag == f"{WORD}t" else "") for x in block.iter())

    lines = []
    for block in body if body is not None else ():
        if block.tag == f"{WORD}tbl":
            lines += [" | ".join(" ".join(text(p) for p in cell.iter(f"{WORD}p")) for cell in row.iterfind(f"{WORD}tc")) for row in block.iterfind(f"{WORD}tr")]
        elif block.tag == f"{WORD}p":
            lines.append(text(block))
    return "\n".join(lines)


def read_sheets(spark: SparkSession, path: str, schema: str | T.StructType, sheet: str | None = None) -> DataFrame:
    """Rows of the workbooks under path, a file for each task, under their header's names and as the schema's types.

    Each sheet's first row names its columns; the schema's columns are found by name, absent ones are
    null, as is what can't be read as the type. Rows without any value are left out. A missing path, and
    empty or broken files, give no rows: a file counts whole or not at all.
    """
    kinds = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    names = [f.name for f in kinds]
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.xlsx").load(path).select("content")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                parts, header, at = [], None, {}
                columns: list[list[str | None]] = [[] for _ in names]
                try:
                    for own, _, cells in sheet_rows(content.as_py() or b"", sheet):
                        if own != header:
                            header, at = own, {name: i for i, name in reversed(list(enumerate(cells))) if name is not None}
                            continue
                        if all(x is None for x in cells):
                            continue
                        for name, column in zip(names, columns, strict=True):
                            i = at.get(name, len(cells))
                            column.append(cells[i] if i < len(cells) else None)
                        if len(columns[0]) == 10_000:
                            parts.append(pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], [f"_{i}" for i in range(len(names))]))
                            columns = [[] for _ in names]
                except BROKEN:
                    continue
                yield from parts
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], [f"_{i}" for i in range(len(names))])

    texts = files.mapInArrow(run, ", ".join(f"_{i} string" for i in range(len(names))))

    def typed(i: int, field: T.StructField):
        raw = F.col(f"_{i}")
        if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            return F.coalesce(raw.try_cast(field.dataType), moment(raw).cast(field.dataType)).alias(field.name)
        return raw.try_cast(field.dataType).alias(field.name)

    return texts.select(*[typed(i, f) for i, f in enumerate(kinds)])


@dataclass
class Written(WriterCommitMessage):
    files: list[str]
    rows: int


class SheetSink(DataSource):
    """Format tidemark_xlsx. Options: path, and sheet, the sheets' name."""

    @classmethod
    def name(cls) -> str:
        return "tidemark_xlsx"

    def writer(self, schema: T.StructType, overwrite: bool) -> SheetWriter:
        return SheetWriter(self.options["path"], self.options.get("sheet", "Sheet1"), schema, overwrite)


class SheetWriter(DataSourceArrowWriter):
    """Workbooks of up to MOST_ROWS rows under a folder; a text too long for a cell is an error."""

    def __init__(self, path: str, sheet: str, schema: T.StructType, overwrite: bool):
        self.path, self.sheet, self.names, self.overwrite = path, sheet, [f.name for f in schema], overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = FileSystem.from_uri(self.path)
        fs.create_dir(root, recursive=True)
        files, rows, book = [], 0, None
        try:
            for batch in iterator:
                for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    if book is None or book.rows == MOST_ROWS:
                        if book:
                            book.close()
                        files.append(f"part-{uuid.uuid4().hex}.xlsx")
                        book = _Book(fs.open_output_stream(f"{root}/{files[-1]}"), self.sheet, self.names)
                    book.add(row)
                    rows += 1
        finally:
            if book:
                book.close()
        return Written(files, rows)

    def commit(self, messages: Sequence[Written | None]) -> None:
        """Files of this write stay, those of its failed tasks go; if it overwrites, all others go too."""
        fs, root = FileSystem.from_uri(self.path)
        fs.create_dir(root, recursive=True)
        known = f"{root}/_committed"
        own = {x for m in messages if m for x in m.files}
        if not self.overwrite and fs.get_file_info(known).is_file:
            with fs.open_input_stream(known) as f:
                own |= set(f.read().decode().split())
        for info in fs.get_file_info(FileSelector(root)):
            if info.extension == "xlsx" and info.base_name not in own:
                fs.delete_file(info.path)
        with fs.open_output_stream(known) as f:
            f.write("\n".join(sorted(own)).encode())

    def abort(self, messages: Sequence[Written | None]) -> None:
        fs, root = FileSystem.from_uri(self.path)
        for name in {x for m in messages if m for x in m.files}:
            if fs.get_file_info(f"{root}/{name}").is_file:
                fs.delete_file(f"{root}/{name}")


_XML = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_KIND = "application/vnd.openxmlformats-officedocument.spreadsheetml"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"


class _Book:
    """One workbook with one sheet, written as its rows come."""

    def __init__(self, file, sheet: str, names: Sequence[str]):
        main = MAIN.strip("{}")
        self.file, self.rows = file, 0
        self.zip = zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED)
        self.zip.writestr("[Content_Types].xml", f'{_XML}<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{_KIND}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{_KIND}.worksheet+xml"/><Override PartName="/xl/styles.xml" ContentType="{_KIND}.styles+xml"/></Types>')
        self.zip.writestr("_rels/.rels", f'{_XML}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        self.zip.writestr("xl/workbook.xml", f'{_XML}<workbook xmlns="{main}" xmlns:r="{_REL}"><sheets><sheet name="{escape(sheet, {chr(34): "&quot;"})}" sheetId="1" r:id="rId1"/></sheets></workbook>')
        self.zip.writestr("xl/_rels/workbook.xml.rels", f'{_XML}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_REL}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Type="{_REL}/styles" Target="styles.xml"/></Relationships>')
        self.zip.writestr("xl/styles.xml", f'{_XML}<styleSheet xmlns="{main}"><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf numFmtId="0" xfId="0"/><xf numFmtId="22" applyNumberFormat="1" xfId="0"/></cellXfs></styleSheet>')
        self.part = self.zip.open("xl/worksheets/sheet1.xml", "w", force_zip64=True)
        self.part.write(f'{_XML}<worksheet xmlns="{main}"><sheetData>'.encode())
        self.add(names)

    def add(self, row: Sequence) -> None:
        self.rows += 1
        self.part.write(f'<row r="{self.rows}">{"".join(map(self._cell, row))}</row>'.encode())

    @staticmethod
    def _cell(x) -> str:
        if x is None:
            return "<c/>"
        if isinstance(x, bool):
            return f'<c t="b"><v>{int(x)}</v></c>'
        if isinstance(x, dt.datetime):
            days = Decimal((x.replace(tzinfo=None) - EPOCH) // dt.timedelta(microseconds=1)) / DAY
            return f'<c s="1"><v>{days:.14f}</v></c>'
        if isinstance(x, dt.date):
            return f'<c s="1"><v>{(dt.datetime.combine(x, dt.time()) - EPOCH).days}</v></c>'
        if isinstance(x, (int, Decimal)) or isinstance(x, float) and x - x == 0:
            return f"<c><v>{x!r}</v></c>" if not isinstance(x, Decimal) else f"<c><v>{x}</v></c>"
        if isinstance(x, float):
            return "<c/>"  # no such numbers in a sheet
        text = str(x)
        if len(text) > MOST_CHARS:
            raise ValueError(f"a cell holds {MOST_CHARS} characters, not {len(text)}")
        return f'<c t="inlineStr"><is><t xml:space="preserve">{_coded(text)}</t></is></c>'

    def close(self) -> None:
        self.part.write(b"</sheetData></worksheet>")
        self.part.close()
        self.zip.close()
        self.file.close()


def write_sheets(df: DataFrame, path: str, mode: str = "overwrite", sheet: str = "Sheet1") -> None:
    """df as workbooks under path, one for each task that has rows: a header and the rows. Nested columns are written as JSON; NaN and infinities are empty.

    A table without rows has no workbook. Times keep microseconds.
    """
    from .sinks import flat

    spark = df.sparkSession
    spark.dataSource.register(SheetSink)
    flat(df).write.format("tidemark_xlsx").option("path", path).option("sheet", sheet).mode(mode).save()
