import datetime as dt
import io
import zipfile
from decimal import Decimal

import pytest

from tidemark.sources import ooxml, readers

MAIN, REL, PACKAGE, W = ooxml.MAIN.strip("{}"), ooxml.LINKS.strip("{}"), "http://schemas.openxmlformats.org/package/2006/relationships", ooxml.WORD.strip("{}")


def workbook(sheets, shared="", styles="", settings=""):
    """A workbook as other programs write it: names to XML of rows."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        listed = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{REL}">{settings}<sheets>{listed}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{PACKAGE}">' + "".join(f'<Relationship Id="r{i}" Target="{"/xl/" if i % 2 else ""}worksheets/s{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>")
        for i, rows in enumerate(sheets.values(), 1):
            z.writestr(f"xl/worksheets/s{i}.xml", f'<worksheet xmlns="{MAIN}"><sheetData>{rows}</sheetData></worksheet>')
        if shared:
            z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{MAIN}">{shared}</sst>')
        if styles:
            z.writestr("xl/styles.xml", f'<styleSheet xmlns="{MAIN}">{styles}</styleSheet>')
    return out.getvalue()


SHARED = "<si><t>day</t></si><si><r><t>pr</t></r><r><t>ice</t></r><rPh><t>reading</t></rPh></si><si><t>x_x000D_y _x005F_x0041_</t></si>"
STYLES = '<numFmts><numFmt numFmtId="164" formatCode="yyyy/mm/dd"/><numFmt numFmtId="165" formatCode="0.0 &quot;days&quot; [Red]"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/></cellXfs>'
ROWS = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c><c r="AA1" t="str"><v>note</v></c></row><row r="5"><c r="A5" s="1"><v>45292.5</v></c><c r="C5" s="3"><v>7.25</v></c><c r="AA5" t="s"><v>2</v></c></row><row r="6"><c r="A6" s="2"><v>45293</v></c><c r="C6" t="e"><v>#N/A</v></c><c r="AA6" t="b"><v>1</v></c></row><row r="7"/><row r="8"><c r="AA8"><f>1+1</f><v>2</v></c></row>'


def test_sheets_of_other_programs(spark, tmp_path):
    good = workbook({"A": ROWS, "B": '<row><c t="inlineStr"><is><t>price</t></is></c></row><row><c><v>1</v></c></row>'}, SHARED, STYLES)
    files = {"a.xlsx": good, "sub/b.xlsx": workbook({"A": '<row><c t="inlineStr"><is><t>day</t></is></c></row><row><c s="1"><v>0</v></c></row>'}, "", STYLES, '<workbookPr date1904="1"/>'), "empty.xlsx": b"", "cut.xlsx": good[: len(good) // 2], "text.xlsx": b"not a zip", "none.xlsx": workbook({}), "bad.xlsx": workbook({"A": "<row><c t='s'><v>9</v></c></row>"}), "other.csv": b"day\n1"}
    for name, content in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    schema = "day timestamp_ntz, price double, note string, absent int"
    got = sorted(map(tuple, ooxml.read_sheets(spark, str(tmp_path), schema).collect()), key=str)
    assert got == sorted([(dt.datetime(2024, 1, 1, 12), 7.25, "x\ry _x0041_", None), (dt.datetime(2024, 1, 2), None, "true", None), (None, None, "2", None), (None, 1.0, None, None), (dt.datetime(1904, 1, 1), None, None, None)], key=str)
    assert [tuple(r) for r in ooxml.read_sheets(spark, str(tmp_path), "price double", sheet="B").collect()] == [(1.0,)]
    assert readers.read_excel(spark, str(tmp_path / "missing"), schema).collect() == [] == readers.read_excel(spark, str(tmp_path / "text.xlsx"), schema).collect()
    assert ooxml.workbook_text(good).split("\n")[:2] == ["day |  | price" + " | " * 24 + "note", "2024-01-01 12:00:00 |  | 7.25" + " | " * 24 + "x\ry _x0041_"]
    assert readers.office_text("a.xlsx", b"broken") == ""


def test_round_trip(spark, tmp_path):
    rows = [
        (1, "plain & <tags> \"quotes\"", 0.1, True, dt.datetime(2024, 2, 29, 23, 59, 59, 999_999), dt.date(1999, 12, 31), Decimal("12345678901234.56"), 2**60 + 1),
        (2, " spaces kept \n lines \x01\x0b _x0041_ 漢字 \U0001f600", -1e300, False, dt.datetime(1900, 3, 1), dt.date(2100, 1, 1), Decimal("-0.01"), -5),
        (3, None, None, None, None, None, None, None),
        (4, "", 3.0, None, dt.datetime(2000, 1, 1, 0, 0, 0, 1), None, None, 0),
    ]
    df = spark.createDataFrame(rows, "id int, text string, x double, flag boolean, at timestamp_ntz, day date, money decimal(18,2), big long")
    path = str(tmp_path / "out")
    ooxml.write_sheets(df.repartition(3), path)
    assert sorted(map(tuple, ooxml.read_sheets(spark, path, df.schema).collect())) == rows
    ooxml.write_sheets(df.where("id = 1"), path, mode="append")
    assert ooxml.read_sheets(spark, path, df.schema).count() == 5
    ooxml.write_sheets(df.where("id = 2"), path)
    assert [r.id for r in ooxml.read_sheets(spark, path, df.schema).collect()] == [2]
    ooxml.write_sheets(df.where("id > 9"), path)
    assert ooxml.read_sheets(spark, path, df.schema).collect() == []
    odd = spark.createDataFrame([(1, float("nan"), [1, 2])], "id int, x double, xs array<int>")
    ooxml.write_sheets(odd, str(tmp_path / "odd"))
    assert [tuple(r) for r in ooxml.read_sheets(spark, str(tmp_path / "odd"), "id int, x double, xs string").collect()] == [(1, None, "[1,2]")]


def test_more_rows_than_a_sheet_holds(spark, tmp_path, monkeypatch):
    sink = ooxml.SheetWriter(str(tmp_path / "many"), "S", spark.range(1).schema, True)
    monkeypatch.setattr(ooxml, "MOST_ROWS", 11)
    import pyarrow as pa

    done = sink.write(iter([pa.RecordBatch.from_pydict({"id": list(range(25))})]))
    (tmp_path / "many" / "part-lost.xlsx").write_bytes(b"of a task that failed")
    sink.commit([done, None])
    assert len(done.files) == 3 and len(list((tmp_path / "many").glob("*.xlsx"))) == 3
    assert sorted(r.id for r in ooxml.read_sheets(spark, str(tmp_path / "many"), "id int").collect()) == list(range(25))
    sink.abort([done])
    assert list((tmp_path / "many").glob("*.xlsx")) == []
    with pytest.raises(ValueError):
        sink.write(iter([pa.RecordBatch.from_pydict({"id": ["x" * 40_000]})]))


def test_documents(spark, tmp_path):
    body = "<w:p><w:r><w:t>first </w:t></w:r><w:r><w:t>line</w:t><w:tab/><w:t>x</w:t></w:r></w:p><w:p/><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p><w:p><w:r><w:t>c</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:sectPr/>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>')
    (tmp_path / "a.docx").write_bytes(out.getvalue())
    (tmp_path / "b.docx").write_bytes(b"broken")
    got = {r.title: r.text for r in readers.extracted(readers.list_files(spark, str(tmp_path), ("docx",)), readers.office_text).collect()}
    assert got == {"a": "first line\tx\n\na | b c", "b": ""}
