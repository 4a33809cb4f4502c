"""Workbooks (.xlsx) as tables: sheets are zipped XML, read row by row inside tasks; no other library is needed."""

from __future__ import annotations

import datetime as dt
import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from typing import Any
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from emberline.sources.tables import CORRUPT

#: Fixed names of the format.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
RELATION = "{http://schemas.openxmlformats.org/package/2006/relationships}Relationship"
#: Day 0 of the two calendars that a workbook can count its dates in.
DAY_0, DAY_0_OF_1904 = dt.datetime(1899, 12, 30), dt.datetime(1904, 1, 1)
#: Rows handed on at once, and rows of a written sheet (the format ends at 1,048,576).
ROWS_AT_ONCE, ROWS_A_SHEET = 10_000, 500_000


def _cells(book: zipfile.ZipFile, name: str, shared: list[str]) -> Iterator[dict[int, str | None]]:
    """The rows of a sheet: column number (from 0) to text. Rows are dropped from memory as soon as they are read."""
    with book.open(name) as f:
        data = None
        for event, e in ET.iterparse(f, events=("start", "end")):
            if event == "start":
                data = e if e.tag == f"{MAIN}sheetData" else data
                continue
            if e.tag != f"{MAIN}row":
                continue
            row: dict[int, str | None] = {}
            at = 0
            for c in e.iter(f"{MAIN}c"):
                letters = re.match(r"[A-Z]+", c.get("r", ""))
                if letters:
                    at = 0
                    for x in letters.group():
                        at = at * 26 + ord(x) - 64
                    at -= 1
                kind, value = c.get("t", "n"), c.find(f"{MAIN}v")
                if kind == "inlineStr":
                    row[at] = "".join(t.text or "" for t in c.iter(f"{MAIN}t"))
                elif value is not None and kind != "e":  # an error value is no value
                    row[at] = shared[int(value.text)] if kind == "s" else value.text or ""
                at += 1
            data.clear()
            yield row


def sheets(content: bytes) -> Iterator[tuple[str, bool, Iterator[dict[int, str | None]]]]:
    """Name, whether dates count from 1904, and rows of each sheet of a workbook, in its order."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in book.namelist():
            with book.open("xl/sharedStrings.xml") as f:
                for _, e in ET.iterparse(f, events=("end",)):
                    if e.tag == f"{MAIN}si":
                        # phonetic guides (rPh) are no part of the text
                        hidden = {id(t) for r in e.iter(f"{MAIN}rPh") for t in r.iter(f"{MAIN}t")}
                        shared.append("".join(t.text or "" for t in e.iter(f"{MAIN}t") if id(t) not in hidden))
                        e.clear()
        links = {r.get("Id"): r.get("Target") for r in ET.fromstring(book.read("xl/_rels/workbook.xml.rels")).iter(RELATION)}
        top = ET.fromstring(book.read("xl/workbook.xml"))
        since_1904 = any(p.get("date1904") in ("1", "true") for p in top.iter(f"{MAIN}workbookPr"))
        for s in top.iter(f"{MAIN}sheet"):
            target = links[s.get(LINK)]
            yield s.get("name"), since_1904, _cells(book, target.lstrip("/") if target.startswith("/") else f"xl/{target}", shared)


def typed(text: str | None, kind: T.DataType, day_0: dt.datetime) -> Any:
    """A cell's text as a value; ValueError where it doesn't fit. Days are numbers (with part of a day as fraction) or ISO texts."""
    if text is None:
        return None
    if isinstance(kind, T.StringType):
        return text
    if text == "":
        return None
    if isinstance(kind, (T.LongType, T.IntegerType, T.ShortType)):
        number = int(text) if re.fullmatch(r"[+-]?\d+", text) else float(text)
        if number != int(number):
            raise ValueError(text)
        return int(number)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return float(text)
    if isinstance(kind, T.BooleanType):
        return {"1": True, "0": False, "true": True, "false": False}[text.lower()] if text.lower() in ("1", "0", "true", "false") else _no(text)
    if isinstance(kind, (T.TimestampNTZType, T.TimestampType, T.DateType)):
        when = day_0 + dt.timedelta(microseconds=round(float(text) * 86_400_000_000)) if re.fullmatch(r"[+-]?[\d.]+([eE][+-]?\d+)?", text) else dt.datetime.fromisoformat(text.replace("Z", ""))
        return when.date() if isinstance(kind, T.DateType) else when
    raise TypeError(f"{kind.simpleString()} has no form in a workbook")


def _no(text: str) -> None:
    raise ValueError(text)


def table_rows(content: bytes, schema: T.StructType, sheet: str | int | None = None) -> Iterator[list]:
    """Values of the schema's columns and the text of what doesn't fit, of each row below a sheet's first, which names the columns. sheet: a name or a place from 0; all sheets without."""
    for place, (name, since_1904, rows) in enumerate(sheets(content)):
        if sheet is not None and sheet not in (name, place):
            continue
        day_0 = DAY_0_OF_1904 if since_1904 else DAY_0
        at = {text: k for k, text in next(rows, {}).items()}
        for row in rows:
            if not row:
                continue
            out, bad = [], False
            for f in schema.fields:
                text = row.get(at.get(f.name, -1))
                try:
                    out.append(typed(text, f.dataType, day_0))
                except (ValueError, OverflowError):
                    out.append(None)
                    bad = True
            yield [*out, "\t".join(row.get(k) or "" for k in range(max(row) + 1)) if bad else None]


def parsed(workbooks: DataFrame, schema: T.StructType, sheet: str | int | None = None) -> DataFrame:
    """The rows of workbooks (content: binary): the schema's columns, found by their names in the first row of each sheet, and CORRUPT, the text of a row of which some cell doesn't fit (that cell is null)."""
    full = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    names = full.fieldNames()

    def frame(rows: list[list]) -> pd.DataFrame:
        return pd.DataFrame({n: pd.Series([r[k] for r in rows], dtype=object) for k, n in enumerate(names)})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for content in f["content"].dropna():
                rows: list[list] = []
                for row in table_rows(bytes(content), schema, sheet):
                    rows.append(row)
                    if len(rows) == ROWS_AT_ONCE:
                        yield frame(rows)
                        rows = []
                if rows:
                    yield frame(rows)

    return workbooks.select("content").mapInPandas(run, full)


def read_workbooks(spark: SparkSession, path: str, schema: T.StructType, sheet: str | int | None = None) -> DataFrame:
    """Rows of the .xlsx files at path, wherever Spark can read. A file is one task's work; what a workbook can hold bounds it."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path)
    return parsed(files, schema, sheet)


def _letters(k: int) -> str:
    out = ""
    while k >= 0:
        out, k = chr(65 + k % 26) + out, k // 26 - 1
    return out


def _cell(where: str, value: Any) -> str:
    if value is None or (isinstance(value, float) and value != value) or value is pd.NaT:
        return ""
    if isinstance(value, bool):
        return f'<c r="{where}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)):
        return f'<c r="{where}"><v>{value!r}</v></c>'
    if isinstance(value, (dt.datetime, dt.date)):
        return f'<c r="{where}" t="d"><v>{value.isoformat()}</v></c>'
    return f'<c r="{where}" t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'


def workbook(tables: dict[str, tuple[list[str], list[tuple]]]) -> bytes:
    """A workbook with a sheet for each name: column names and rows. Characters that XML has no place for are an error of the reader's."""
    package, office = "http://schemas.openxmlformats.org/package/2006", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    head, main = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>', MAIN.strip("{}")
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    names = list(tables)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{kind}.worksheet+xml"/>' for k in range(1, len(names) + 1))
        z.writestr("[Content_Types].xml", f'{head}<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>{parts}</Types>')
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{package}/relationships">' + "".join(f'<Relationship Id="rId{k}" Type="{office}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(names) + 1)) + "</Relationships>")
        listed = "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{k}" r:id="rId{k}"/>' for k, n in enumerate(names, 1))
        z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{main}" xmlns:r="{office}"><sheets>{listed}</sheets></workbook>')
        for k, n in enumerate(names, 1):
            columns, rows = tables[n]
            with z.open(f"xl/worksheets/sheet{k}.xml", "w") as f:
                f.write(f'{head}<worksheet xmlns="{main}"><sheetData>'.encode())
                for at, row in enumerate([tuple(columns), *rows], 1):
                    f.write(f'<row r="{at}">{"".join(_cell(f"{_letters(j)}{at}", v) for j, v in enumerate(row))}</row>'.encode())
                f.write(b"</sheetData></worksheet>")
    return out.getvalue()


def as_workbooks(rows: DataFrame, sheet: str = "data", rows_a_sheet: int = ROWS_A_SHEET) -> DataFrame:
    """content: workbooks with the rows, one for so many rows of a partition; each is made in the memory of its task."""
    names = rows.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        for f in frames:
            columns = [[None if x is None or x is pd.NaT or x != x else x.item() if hasattr(x, "item") else x for x in f[n].astype(object)] for n in names]
            held += zip(*columns, strict=True)
            while len(held) >= rows_a_sheet:
                yield pd.DataFrame({"content": [workbook({sheet: (names, held[:rows_a_sheet])})]})
                held = held[rows_a_sheet:]
        if held:
            yield pd.DataFrame({"content": [workbook({sheet: (names, held)})]})

    return rows.mapInPandas(run, "content binary")
