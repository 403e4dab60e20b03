"""Workbooks as a data source: ``format("workbook")`` reads and writes XLSX files, one partition for each file.

An XLSX file is a ZIP of XML, which is read and written as a stream. The first sheet's first row is the header: names are trimmed, a blank one is
``col_<i>``, and all values are texts. Paths are of any store that Arrow's file systems know. Tasks write files under hidden names, which
commit gives their own; a sheet that is full goes on in the next file.
"""

from __future__ import annotations

import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from tidewell.sources.archives import store_of

#: Rows that a sheet may have, the header included (a fixed value of the format).
SHEET_ROWS = 1 << 20
_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_PARTS = {
    "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
    '<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
    '<Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
    "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/workbook.xml": f'<workbook xmlns="{_NS[1:-1]}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Sheet1" sheetId="1" r:id="r1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
}


def _files(path: str) -> list[str]:
    store, at = store_of(path)
    info = store.get_file_info(at)
    if info.type == pafs.FileType.File:
        return [path]
    found = [i.base_name for i in store.get_file_info(pafs.FileSelector(at)) if i.base_name.lower().endswith(".xlsx") and i.base_name[0] not in "._~"]
    return [f"{path.rstrip('/')}/{n}" for n in sorted(found)]


def _unescaped(text: str) -> str:
    """Characters that XML has no place for are written as _xHHHH_."""
    return re.sub(r"_x([0-9A-Fa-f]{4})_", lambda m: chr(int(m[1], 16)), text)


def _escaped(text: str) -> str:
    text = re.sub(r"_(?=x[0-9A-Fa-f]{4}_)", "_x005F_", text)
    return escape(re.sub(r"[\x00-\x08\x0b-\x1f￾￿]", lambda m: f"_x{ord(m[0]):04X}_", text))


def _column(reference: str) -> int:
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = 26 * n + ord(c.upper()) - 64
    return n - 1


def _number(text: str) -> str:
    """A number as it is, a whole one without its point."""
    value = float(text)
    return str(int(value)) if value.is_integer() and abs(value) < 2**53 else text


def sheet_rows(path: str) -> Iterator[list[str | None]]:
    """The rows of a file's first sheet, as texts; a row ends with its last cell."""
    store, at = store_of(path)
    with store.open_input_file(at) as raw, zipfile.ZipFile(raw) as book:
        names = book.namelist()
        shared: list[str] = []
        if "xl/sharedStrings.xml" in names:
            with book.open("xl/sharedStrings.xml") as part:
                for _, e in ElementTree.iterparse(part):
                    if e.tag == f"{_NS}si":
                        shared.append(_unescaped("".join(t.text or "" for t in e.iter(f"{_NS}t"))))
                        e.clear()
        first = min((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
        with book.open(first) as part:
            for _, e in ElementTree.iterparse(part):
                if e.tag != f"{_NS}row":
                    continue
                row: list[str | None] = []
                for cell in e:
                    place = _column(cell.get("r", "")) if cell.get("r") else len(row)
                    row += [None] * (place + 1 - len(row))
                    kind, value = cell.get("t", "n"), cell.findtext(f"{_NS}v")
                    if kind == "inlineStr":
                        row[place] = _unescaped("".join(t.text or "" for t in cell.iter(f"{_NS}t")))
                    elif value is not None:
                        row[place] = shared[int(value)] if kind == "s" else _number(value) if kind == "n" else {"1": "true", "0": "false"}[value] if kind == "b" else _unescaped(value)
                yield row
                e.clear()


def header_names(row: list[str | None]) -> list[str]:
    """Trimmed names, ``col_<i>`` where blank; a name that comes again gets its place."""
    names: list[str] = []
    for i, v in enumerate(row):
        name = (v or "").strip() or f"col_{i}"
        names.append(name if name.lower() not in {n.lower() for n in names} else f"{name}_{i}")
    return names


@dataclass
class _File(InputPartition):
    path: str


class _Reader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.names, self.path, self.header = schema.names, options["path"], options.get("header", "true") == "true"

    def partitions(self):
        return [_File(p) for p in _files(self.path)] or [_File("")]

    def read(self, partition):
        rows = sheet_rows(partition.path) if partition.path else iter(())
        if self.header:
            place = {n: i for i, n in enumerate(header_names(next(rows, [])))}
            at = [place.get(n, -1) for n in self.names]
        else:
            at = list(range(len(self.names)))
        for row in rows:
            if any(v is not None for v in row):
                yield tuple(row[i] if 0 <= i < len(row) else None for i in at)


@dataclass
class _Written(WriterCommitMessage):
    parts: list[str]


class _Writer(DataSourceWriter):
    def __init__(self, schema: T.StructType, options: dict, overwrite: bool):
        self.names, self.path, self.overwrite, self.rows = schema.names, options["path"].rstrip("/"), overwrite, int(options.get("sheetRows", SHEET_ROWS))
        self.header = options.get("header", "true") == "true"

    def write(self, iterator):
        store, at = store_of(self.path)
        store.create_dir(at)
        parts: list[str] = []
        row = next(iterator, None)
        while row is not None:
            name = f"{uuid.uuid4().hex}.xlsx"
            parts.append(name)
            with store.open_output_stream(f"{at}/.{name}") as raw, zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as book:
                for part, text in _PARTS.items():
                    book.writestr(part, text)
                with book.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as sheet:
                    sheet.write(f'<worksheet xmlns="{_NS[1:-1]}"><sheetData>'.encode())
                    if self.header:
                        sheet.write(self._row(self.names))
                    n = int(self.header)
                    while row is not None and n < self.rows:
                        sheet.write(self._row(row))
                        n, row = n + 1, next(iterator, None)
                    sheet.write(b"</sheetData></worksheet>")
        return _Written(parts)

    @staticmethod
    def _row(values) -> bytes:
        cells = []
        for v in values:
            if v is None:
                cells.append("<c/>")
            elif isinstance(v, bool):
                cells.append(f'<c t="b"><v>{int(v)}</v></c>')
            elif isinstance(v, int | float) and abs(v) < 2**53:
                cells.append(f"<c><v>{v!r}</v></c>")
            else:
                cells.append(f'<c t="inlineStr"><is><t xml:space="preserve">{_escaped(str(v))}</t></is></c>')
        return f"<row>{''.join(cells)}</row>".encode()

    def commit(self, messages):
        store, at = store_of(self.path)
        store.create_dir(at)
        old = _files(self.path) if self.overwrite else []
        for name in [n for m in messages if m for n in m.parts]:
            store.move(f"{at}/.{name}", f"{at}/{name}")
        for path in old:
            store.delete_file(store_of(path)[1])

    def abort(self, messages):
        store, at = store_of(self.path)
        for name in [n for m in messages if m for n in m.parts]:
            if store.get_file_info(f"{at}/.{name}").type == pafs.FileType.File:
                store.delete_file(f"{at}/.{name}")


class Workbooks(DataSource):
    """Options: path, header (true), sheetRows."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self):
        """The columns of the first file's first row, all texts."""
        files = _files(self.options["path"])
        first = next(sheet_rows(files[0]), []) if files else []
        header = self.options.get("header", "true") == "true"
        names = header_names(first) if header else [f"_{i}" for i in range(len(first))]
        return T.StructType([T.StructField(n, T.StringType()) for n in names])

    def reader(self, schema):
        return _Reader(schema, self.options)

    def writer(self, schema, overwrite):
        return _Writer(schema, self.options, overwrite)


def workbooks(spark: SparkSession) -> SparkSession:
    """Makes ``format("workbook")`` known to a session."""
    spark.dataSource.register(Workbooks)
    return spark
