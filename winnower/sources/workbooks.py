"""Workbooks (.xlsx) without a spreadsheet library: sheet names, reading and writing of plain cells.

A workbook is one compressed file and is read by one task; the format itself holds at most 1 048 576 rows a sheet.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_ROWS = 1_048_576
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _sheets(book: zipfile.ZipFile) -> dict[str, str]:
    """Sheet name -> member, in the workbook's order."""
    rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    found = ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet")
    return {s.get("name"): "xl/" + rels[s.get(f"{_REL}id")].removeprefix("/xl/") for s in found}


def _column(reference: str) -> int:
    at = 0
    for letter in re.match(r"[A-Z]+", reference).group():
        at = 26 * at + ord(letter) - 64
    return at - 1


def _rows(content: bytes, sheet: str | None) -> Iterator[list[str | None]]:
    """Rows of text; numbers as written, booleans as TRUE and FALSE, empty cells None."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        members = _sheets(book)
        member = members[sheet] if sheet else next(iter(members.values()))
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))]
        with book.open(member) as data:
            for _, row in ElementTree.iterparse(data):
                if row.tag != f"{_MAIN}row":
                    continue
                cells: list[str | None] = []
                for c in row.iter(f"{_MAIN}c"):
                    at = _column(c.get("r")) if c.get("r") else len(cells)
                    cells += [None] * (at + 1 - len(cells))
                    kind, value = c.get("t"), c.find(f"{_MAIN}v")
                    if kind == "inlineStr":
                        cells[at] = "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
                    elif value is not None and value.text is not None:
                        cells[at] = shared[int(value.text)] if kind == "s" else {"1": "TRUE", "0": "FALSE"}[value.text] if kind == "b" else value.text
                yield cells
                row.clear()


def sheet_names(spark: SparkSession, path: str) -> list[str]:
    """Names of a workbook's sheets in order; none for other files."""
    if not path.lower().endswith((".xlsx", ".xlsm")):
        return []
    names = spark.read.format("binaryFile").load(path).select("content").first()
    with zipfile.ZipFile(io.BytesIO(bytes(names[0]))) as book:
        return list(_sheets(book))


def read_sheet(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """A sheet (the first, if none is named) with its first row as header, all values as text."""
    files = spark.read.format("binaryFile").load(path).select("content")
    header = next(_rows(bytes(files.first()[0]), sheet))
    names = [h if h else f"column_{k + 1}" for k, h in enumerate(header)]

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                rows, first = [], True
                for cells in _rows(bytes(content), sheet):
                    if first:
                        first = False
                        continue
                    rows.append([*cells, *[None] * len(names)][: len(names)])
                    if len(rows) == 10_000:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
                yield pd.DataFrame(rows, columns=names, dtype=object)

    return files.mapInPandas(parse, ", ".join(f"`{n}` string" for n in names))


def workbook(sheets: dict[str, DataFrame]) -> bytes:
    """The file's bytes: a sheet per table, numbers as numbers, text with formula-like beginnings made harmless.

    Rows stream from the executors a partition at a time; a table with more rows than a sheet holds is an error.
    """
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        names = []
        for k, (name, df) in enumerate(sheets.items(), 1):
            if df.limit(MOST_ROWS).count() >= MOST_ROWS:
                raise ValueError(f"{name}: more rows than a sheet holds; write it as Parquet or text")
            names.append(re.sub(r"[\[\]:*?/\\]", "_", name)[:31])
            with book.open(f"xl/worksheets/sheet{k}.xml", "w") as sheet:
                sheet.write(b'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>')
                sheet.write(_line(df.columns))
                for row in df.toLocalIterator():
                    sheet.write(_line(list(row)))
                sheet.write(b"</sheetData></worksheet>")
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for k in range(1, len(names) + 1))
        book.writestr("[Content_Types].xml", '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>' + kinds + "</Types>")
        rels = "http://schemas.openxmlformats.org/package/2006/relationships"
        kind = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        book.writestr("_rels/.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{rels}"><Relationship Id="rId1" Type="{kind}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        book.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{rels}">' + "".join(f'<Relationship Id="rId{k}" Type="{kind}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(names) + 1)) + "</Relationships>")
        listed = "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{k}" r:id="rId{k}"/>' for k, n in enumerate(names, 1))
        book.writestr("xl/workbook.xml", f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="{kind}"><sheets>{listed}</sheets></workbook>')
    return out.getvalue()


def _line(values: list) -> bytes:
    cells = []
    for v in values:
        if v is None or v != v:
            cells.append("<c/>")
        elif isinstance(v, bool):
            cells.append(f'<c t="b"><v>{int(v)}</v></c>')
        elif isinstance(v, (int, float)):
            cells.append(f"<c><v>{v!r}</v></c>")
        else:
            text = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", str(v))
            text = "'" + text if text[:1] in "=+-@\t\r" and text else text
            cells.append(f'<c t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>')
    return f"<row>{''.join(cells)}</row>".encode()


def write_workbook(spark: SparkSession, path: str, sheets: dict[str, DataFrame]) -> None:
    """Write a workbook through the file system that ``path`` names; an existing file is never touched."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, False)
    try:
        stream.write(bytearray(workbook(sheets)))
    finally:
        stream.close()


def report_sheets(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Tables with nested columns flattened to JSON text, ready for a workbook."""
    out = {}
    for name, df in tables.items():
        nested = [c for c, t in df.dtypes if t.startswith(("array", "map", "struct"))]
        out[name] = df.withColumns({c: F.to_json(F.col(c)) for c in nested}) if nested else df
    return out
