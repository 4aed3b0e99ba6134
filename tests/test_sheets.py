"""Workbooks: what others write (shared strings, gaps, several sheets), what the writer writes, and failing options."""

import zipfile

import pytest

from tessera.sources import readers, sheets

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def workbook(path, tabs, strings=()):
    """A file as a spreadsheet program makes it: strings shared, cells and rows without content left out."""
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook {MAIN} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(tabs, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="rId{i}" Target="worksheets/s{i}.xml"/>' for i in range(1, len(tabs) + 1)) + "</Relationships>")
        if strings:
            z.writestr("xl/sharedStrings.xml", f"<sst {MAIN}>" + "".join(f"<si>{s}</si>" for s in strings) + "</sst>")
        for i, rows in enumerate(tabs.values(), 1):
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {MAIN}><sheetData>{rows}</sheetData></worksheet>")


STRINGS = ("<t>name source</t>", "<r><t>two </t></r><r><t>runs</t></r><rPh><t>hint</t></rPh>", "<t>_x000B_tab</t>")
FIRST = """<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>n</t></is></c><c r="D1" t="inlineStr"><is><t>n</t></is></c></row>
<row r="2"><c r="A2" t="s"><v>1</v></c><c r="C2"><v>1.50</v></c><c r="D2" t="b"><v>1</v></c></row><row r="4"><c r="A4" t="s"><v>2</v></c><c r="B4" t="e"><v>#N/A</v></c></row>"""
SECOND = '<row><c t="str"><v>note</v></c></row><row/><row><c t="str"><v>name source</v></c><c t="str"><v>other</v></c></row><row><c t="str"><v>x</v></c><c><v>3</v></c></row>'


@pytest.fixture(scope="module")
def book(tmp_path_factory):
    path = tmp_path_factory.mktemp("books") / "meta.xlsx"
    workbook(path, {"First one": FIRST, "Second": SECOND, "Empty": ""}, STRINGS)
    return str(path)


def test_shared_strings_gaps_and_kinds(spark, book):
    df = sheets.read_sheet(spark, book)
    assert df.columns == ["name source", "column_2", "n", "n.1"]
    assert [tuple(r) for r in df.collect()] == [("two runs", None, "1.50", "true"), (None, None, None, None), ("\x0btab", None, None, None)]
    assert readers.read_table(spark, book).count() == 3
    assert [tuple(r) for r in readers.read_metadata(spark, book, "two runs", columns=["name source", "n"]).collect()] == [("two runs", "1.50")]


def test_sheets_skipped_rows_and_headers(spark, book):
    assert [tuple(r) for r in sheets.read_sheet(spark, book, "Second", skip_rows=2).collect()] == [("x", "3")]
    assert [tuple(r) for r in sheets.read_sheet(spark, book, 1, skip_rows=3, header=False).collect()] == [("x", "3")]
    assert sheets.read_sheet(spark, book, 1, skip_rows=3, header=False, names=["a", "b"]).columns == ["a", "b"]
    every = sheets.read_sheet(spark, book, "*")
    assert every.rdd.getNumPartitions() == 3 and every.columns == ["name source", "column_2", "n", "n.1", "note"] and every.count() == 6
    assert sheets.read_sheet(spark, book, "Empty").columns == []
    with pytest.raises(Exception, match="no sheet Third"):
        sheets.read_sheet(spark, book, "Third")


def test_what_is_written_is_read(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(["a", None, "", " b\n\tc ", "\x00\x1f\r", "_x0041_", "<&>'\"", "😀" * 200, "￿"])]
    df = spark.createDataFrame(rows, "id long, value string")
    path = str(tmp_path / "out")
    sheets.write_sheet(df.repartition(3), path, preface="one\ntwo")
    back = {int(r["id"]): r["value"] for r in sheets.read_sheet(spark, path, skip_rows=2).collect()}
    assert back == dict(rows)
    sheets.write_sheet(df.limit(1), path, mode="overwrite")
    assert sheets.read_sheet(spark, path).count() == 1
    assert not any("_temporary" in p.name for p in (tmp_path / "out").iterdir())


def test_columns_far_out():
    assert [sheets._letters(i) for i in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]
