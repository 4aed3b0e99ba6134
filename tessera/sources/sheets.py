"""Workbooks (zipped XML sheets) as a data source: a partition for each sheet of each file, rows streamed from the archive."""

from __future__ import annotations

import posixpath
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

#: Rows of a batch, and rows that a sheet may have by its format.
BATCH, MOST_ROWS = 4096, 1_048_576
# Fixed values of the format.
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_CONTROL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]|_x[0-9A-Fa-f]{4}_")
_ESCAPED = re.compile("_x([0-9A-Fa-f]{4})_")


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[str]:
    """The workbook at path, or those in the folder there by name."""
    system, at = _place(path)
    if system.get_file_info(at).type == fs.FileType.Directory:
        return sorted(f.path for f in system.get_file_info(fs.FileSelector(at)) if f.type == fs.FileType.File and f.base_name.endswith(".xlsx"))
    return [at]


def _text(node: ElementTree.Element) -> str:
    """All runs of a string, phonetic hints left out."""
    runs = [t.text or "" for child in node for t in ([child] if child.tag == f"{_MAIN}t" else child.findall(f"{_MAIN}t") if child.tag == f"{_MAIN}r" else [])]
    return _ESCAPED.sub(lambda m: chr(int(m[1], 16)), "".join(runs))


class Workbook:
    """A workbook that is read as it is asked for; shared strings are held, rows aren't."""

    def __init__(self, system: fs.FileSystem, path: str):
        self.archive = zipfile.ZipFile(system.open_input_file(path))
        related = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(self.archive.read("xl/_rels/workbook.xml.rels"))}
        sheets = ElementTree.fromstring(self.archive.read("xl/workbook.xml")).find(f"{_MAIN}sheets")
        self.sheets = {s.get("name"): posixpath.normpath(posixpath.join("/xl", related[s.get(_REL)])).lstrip("/") for s in (sheets if sheets is not None else ())}

    def shared(self) -> list[str]:
        if "xl/sharedStrings.xml" not in self.archive.namelist():
            return []
        out = []
        with self.archive.open("xl/sharedStrings.xml") as f:
            for _, node in ElementTree.iterparse(f):
                if node.tag == f"{_MAIN}si":
                    out.append(_text(node))
                    node.clear()
        return out

    def rows(self, sheet: str, skip: int = 0) -> Iterator[list[str | None]]:
        """Cells of every row from the first after `skip` lines, as texts; rows and cells that the file leaves out are empty. Errors are null."""
        shared, due = self.shared(), skip + 1
        with self.archive.open(self.sheets[sheet]) as f:
            nodes = ElementTree.iterparse(f, events=("start", "end"))
            _, root = next(nodes)
            at = 0
            for event, node in nodes:
                if event == "start" or node.tag != f"{_MAIN}row":
                    continue
                at = int(node.get("r") or at + 1)
                if at >= due:
                    yield from ([] for _ in range(at - due))
                    due = at + 1
                    yield self._cells(node, shared)
                node.clear()
                for part in root:  # rows that are done
                    part.clear()

    def _cells(self, row: ElementTree.Element, shared: list[str]) -> list[str | None]:
        out: list[str | None] = []
        for cell in row.findall(f"{_MAIN}c"):
            letters = re.match("[A-Z]*", cell.get("r") or "")[0]
            column = 0
            for c in letters:
                column = column * 26 + ord(c) - 64
            out += [None] * (column - 1 - len(out))
            kind, value = cell.get("t"), cell.find(f"{_MAIN}v")
            held = value.text if value is not None else None
            if kind == "inlineStr":
                inner = cell.find(f"{_MAIN}is")
                held = _text(inner) if inner is not None else None
            elif kind == "s" and held is not None:
                held = shared[int(held)]
            elif kind == "b" and held is not None:
                held = "true" if held == "1" else "false"
            elif kind == "e":
                held = None
            out.append(held)
        return out


@dataclass
class SheetPartition(InputPartition):
    path: str
    sheet: str


class SheetReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.schema, self.options = schema, options

    def partitions(self) -> list[SheetPartition]:
        system, _ = _place(self.options["path"])
        return [SheetPartition(path, sheet) for path in _files(self.options["path"]) for sheet in _chosen(Workbook(system, path), self.options)] or [SheetPartition("", "")]

    def read(self, partition: SheetPartition) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        system, _ = _place(self.options["path"])
        rows = Workbook(system, partition.path).rows(partition.sheet, int(self.options.get("skip_rows", 0)))
        names = self.schema.fieldNames()
        where = list(range(len(names)))
        if self.options.get("header", "true").lower() == "true":
            head = _header(next(rows, []))
            where = [head.index(n) if n in head else -1 for n in names]
        batch: list[list[str | None]] = []
        for row in rows:
            batch.append([row[i] if 0 <= i < len(row) else None for i in where])
            if len(batch) == BATCH:
                yield self._made(batch, names)
                batch = []
        if batch:
            yield self._made(batch, names)

    @staticmethod
    def _made(batch: list[list[str | None]], names: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in batch], pa.string()) for i in range(len(names))], names=names)


def _chosen(book: Workbook, options: dict) -> list[str]:
    """The sheet of the option: a name, a place from 0, or all of them by *; the first without one."""
    asked, names = options.get("sheet", "0"), list(book.sheets)
    if asked == "*":
        return names
    if asked in names:
        return [asked]
    if asked.isdigit() and int(asked) < len(names):
        return [names[int(asked)]]
    raise ValueError(f"no sheet {asked}: there are {', '.join(names)}")


def _header(cells: list[str | None]) -> list[str]:
    """Names of columns: an empty one by its place, a repeated one with its number."""
    out: list[str] = []
    for i, c in enumerate(cells):
        name = c if c not in (None, "") else f"column_{i + 1}"
        out.append(name if name not in out else f"{name}.{sum(o == name or o.startswith(f'{name}.') for o in out)}")
    return out


class SheetWriter(DataSourceWriter):
    """A workbook for each task, written beside its place and put there when the job commits; attempts that don't count leave nothing."""

    def __init__(self, schema: T.StructType, options: dict, overwrite: bool):
        self.names, self.options, self.overwrite = schema.fieldNames(), options, overwrite

    def write(self, rows: Iterator) -> WriterCommitMessage:
        system, at = _place(self.options["path"])
        name = f"part-{uuid.uuid4().hex}.xlsx"
        system.create_dir(f"{at}/_temporary", recursive=True)
        with system.open_output_stream(f"{at}/_temporary/{name}") as f, zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as book:
            _frame(book, self.options.get("sheet", "Sheet1"))
            with book.open("xl/worksheets/sheet1.xml", "w") as sheet:
                sheet.write(b'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>')
                lines = [[p] for p in self.options.get("preface", "").split("\n") if p] + [self.names]
                for n, line in enumerate(lines):
                    sheet.write(_row(line, n + 1))
                for n, row in enumerate(rows, len(lines) + 1):
                    if n > MOST_ROWS:
                        raise ValueError(f"a sheet holds {MOST_ROWS} rows: deal the rows to more tasks")
                    sheet.write(_row(list(row), n))
                sheet.write(b"</sheetData></worksheet>")
        return Written(name)

    def commit(self, messages: list) -> None:
        system, at = _place(self.options["path"])
        for old in _files(at if "://" not in self.options["path"] else self.options["path"]) if self.overwrite else ():
            system.delete_file(old)
        for m in messages:
            if m is not None:
                system.move(f"{at}/_temporary/{m.name}", f"{at}/{m.name}")
        if system.get_file_info(f"{at}/_temporary").type == fs.FileType.Directory:
            system.delete_dir(f"{at}/_temporary")

    def abort(self, messages: list) -> None:
        system, at = _place(self.options["path"])
        if system.get_file_info(f"{at}/_temporary").type == fs.FileType.Directory:
            system.delete_dir(f"{at}/_temporary")


@dataclass
class Written(WriterCommitMessage):
    name: str


def _row(values: list, number: int) -> bytes:
    coded = lambda v: escape(_CONTROL.sub(lambda m: "".join(f"_x{ord(c):04X}_" for c in m[0]) if len(m[0]) == 1 else f"_x005F_{m[0][1:]}", str(v)).replace("\r", "_x000D_"))
    cells = (f'<c r="{_letters(i)}{number}" t="inlineStr"><is><t xml:space="preserve">{coded(v)}</t></is></c>' for i, v in enumerate(values) if v is not None)
    return f'<row r="{number}">{"".join(cells)}</row>'.encode()


def _letters(i: int) -> str:
    out = ""
    i += 1
    while i:
        i, rest = divmod(i - 1, 26)
        out = chr(65 + rest) + out
    return out


def _frame(book: zipfile.ZipFile, sheet: str) -> None:
    """The parts around one sheet, fixed by the format."""
    base, office = "http://schemas.openxmlformats.org/package/2006", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    book.writestr("[Content_Types].xml", f'<Types xmlns="{base}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kind}.worksheet+xml"/></Types>')
    book.writestr("_rels/.rels", f'<Relationships xmlns="{base}/relationships"><Relationship Id="rId1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
    book.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{base}/relationships"><Relationship Id="rId1" Type="{office}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
    book.writestr("xl/workbook.xml", f'<workbook xmlns="{_MAIN[1:-1]}" xmlns:r="{office}"><sheets><sheet name={quoteattr(sheet)} sheetId="1" r:id="rId1"/></sheets></workbook>')


class SheetSource(DataSource):
    """Options: path (a workbook, or a folder of them), sheet (a name, a place from 0, or *), skip_rows, header; for writing sheet and preface (lines above the header). All columns are text."""

    @classmethod
    def name(cls) -> str:
        return "sheet"

    def schema(self) -> T.StructType:
        system, _ = _place(self.options["path"])
        names: list[str] = []
        for path in _files(self.options["path"]):
            book = Workbook(system, path)
            for sheet in _chosen(book, self.options):
                first = next(book.rows(sheet, int(self.options.get("skip_rows", 0))), [])
                head = _header(first) if self.options.get("header", "true").lower() == "true" else [f"column_{i + 1}" for i in range(len(first))]
                names += [h for h in head if h not in names]
        return T.StructType([T.StructField(n, T.StringType()) for n in names])

    def reader(self, schema: T.StructType) -> SheetReader:
        return SheetReader(schema, dict(self.options))

    def writer(self, schema: T.StructType, overwrite: bool) -> SheetWriter:
        return SheetWriter(schema, dict(self.options), overwrite)


def read_sheet(spark: SparkSession, path: str, sheet: str | int = 0, skip_rows: int = 0, header: bool = True, names: list[str] | None = None) -> DataFrame:
    """Rows of a sheet as text, those of all sheets and files of a folder by the names of their headers. Without a header columns are column_1 .. or `names`.

    A task reads a sheet; it holds the workbook's shared strings and a batch of rows. Empty cells are null; an empty sheet has no rows and no columns.
    """
    spark.dataSource.register(SheetSource)
    reader = spark.read.format("sheet").options(path=path, sheet=str(sheet), skip_rows=str(skip_rows), header=str(header).lower())
    return (reader.schema(T.StructType([T.StructField(n, T.StringType()) for n in names])) if names else reader).load()


def write_sheet(df: DataFrame, path: str, sheet: str = "Sheet1", preface: str = "", mode: str = "append") -> None:
    """df as workbooks in the folder `path`, one for each partition, a header in each; all values as text, nulls as empty cells."""
    df.sparkSession.dataSource.register(SheetSource)
    texts = (F.col("`" + c.replace("`", "``") + "`").cast("string").alias(c) for c in df.columns)
    df.select(*texts).write.format("sheet").mode(mode).options(path=path, sheet=sheet, preface=preface).save()
