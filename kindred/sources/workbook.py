"""Folders of .xlsx workbooks as one table: one task per file, sheets parsed as a stream."""

from __future__ import annotations

import io
import posixpath
import zipfile
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from kindred.errors import NO_ROWS, CleaningError, EmptyDataError
from kindred.sources.typing import NA_VALUES, unique_names

# XML namespaces of the file format and its built-in date formats.
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_DATE_FORMATS = {*range(14, 23), *range(45, 48)}

_CATALOG = "path string, sheet_index int, sheet_name string"
_ROWS = "path string, row_no bigint, cells array<struct<text:string,kind:string>>"


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(str(path))


def _sheets(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, part) of each sheet, in workbook order."""
    parts = {
        r.get("Id"): r.get("Target")
        for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    }
    root = ElementTree.fromstring(book.read("xl/workbook.xml"))
    return [
        (s.get("name"), posixpath.normpath(posixpath.join("/xl", parts[s.get(_REL + "id")]))[1:])
        for s in root.iter(_MAIN + "sheet")
    ]


def workbook_catalog(spark: SparkSession, path: str) -> DataFrame:
    """path, sheet_index, sheet_name of every sheet of every workbook."""

    def list_sheets(batches):
        for batch in batches:
            rows = []
            for name, content in zip(batch["path"], batch["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as book:
                    rows += [(name, i, sheet) for i, (sheet, _) in enumerate(_sheets(book))]
            yield pd.DataFrame(rows, columns=["path", "sheet_index", "sheet_name"])

    return _files(spark, path).select("path", "content").mapInPandas(list_sheets, _CATALOG)


def _texts(node) -> str:
    """Text of a string item without its phonetic hints."""
    runs = [t for child in node if child.tag != _MAIN + "rPh" for t in child.iter(_MAIN + "t")]
    return "".join(t.text or "" for t in runs)


def _shared_strings(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    root = ElementTree.fromstring(book.read("xl/sharedStrings.xml"))
    return [_texts(item) for item in root.iter(_MAIN + "si")]


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """Indices of the cell styles that show a date."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    custom = {
        int(f.get("numFmtId"))
        for f in root.iter(_MAIN + "numFmt")
        if set(f.get("formatCode", "").split(";")[0].lower().replace("general", "")) & set("ymdhs")
    }
    formats = root.find(_MAIN + "cellXfs")
    return {
        i for i, xf in enumerate(formats if formats is not None else [])
        if int(xf.get("numFmtId", 0)) in _DATE_FORMATS | custom
    }


def _column(reference: str) -> int:
    number = 0
    for ch in reference:
        if not ch.isalpha():
            break
        number = number * 26 + ord(ch.upper()) - ord("A") + 1
    return number - 1


def _cell(node, shared, dates, epoch):
    """(text, kind) with kind n, b, s or d; None for an empty cell."""
    kind, value = node.get("t", "n"), node.findtext(_MAIN + "v")
    if kind == "inlineStr":
        inline = node.find(_MAIN + "is")
        return None if inline is None else (_texts(inline), "s")
    if value is None or value == "":
        return None
    if kind == "s":
        return shared[int(value)], "s"
    if kind == "b":
        return ("true" if value == "1" else "false"), "b"
    if kind == "d":
        return value, "d"
    if kind != "n":
        return (None if kind == "e" else (value, "s"))
    if int(node.get("s", 0)) in dates:
        moment = epoch + timedelta(seconds=round(float(value) * 86400, 3))
        return moment.isoformat(sep=" "), "d"
    number = float(value)
    return (str(int(number)) if number.is_integer() and abs(number) < 1e15 else value), "n"


def _rows(book: zipfile.ZipFile, part: str):
    """Rows of one sheet as they are read; the sheet is never held as a whole."""
    shared, dates = _shared_strings(book), _date_styles(book)
    head = book.read("xl/workbook.xml")
    epoch = datetime(1904, 1, 1) if b'date1904="1"' in head else datetime(1899, 12, 30)
    with book.open(part) as stream:
        for _, node in ElementTree.iterparse(stream):
            if node.tag != _MAIN + "row":
                continue
            cells: list = []
            for cell in node.iter(_MAIN + "c"):
                place = _column(cell.get("r", "")) if cell.get("r") else len(cells)
                cells.extend([None] * (place - len(cells)))
                cells.append(_cell(cell, shared, dates, epoch))
            node.clear()
            yield cells


def _row_reader(sheet: str | None, header_only: bool, batch_rows: int = 5_000):
    def read(batches):
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as book:
                    sheets = _sheets(book)
                    part = dict(sheets).get(sheet) if sheet is not None else sheets[0][1]
                    if part is None:
                        raise ValueError(f"Worksheet '{sheet}' not found in {name}")
                    chunk, number = [], 0
                    for cells in _rows(book, part):
                        if not any(c is not None for c in cells):
                            continue
                        if header_only or number:
                            packed = [c and {"text": c[0], "kind": c[1]} for c in cells]
                            chunk.append((name, number, packed))
                        number += 1
                        if header_only:
                            break
                        if len(chunk) == batch_rows:
                            yield pd.DataFrame(chunk, columns=["path", "row_no", "cells"])
                            chunk = []
                    if chunk:
                        yield pd.DataFrame(chunk, columns=["path", "row_no", "cells"])

    return read


def read_workbooks(
    spark: SparkSession, path: str, sheet: str | None = None, na_values=NA_VALUES
) -> DataFrame:
    """One sheet (the first by default) of every workbook under ``path``, stacked.

    All files must have the same header row. A column is bigint, double, boolean or timestamp if
    all its cells are of that kind, else string.
    """
    if sheet is not None and workbook_catalog(spark, path).where(
        F.col("sheet_name") == sheet
    ).isEmpty():
        raise CleaningError(f"Worksheet '{sheet}' not found.")
    files = _files(spark, path).select("path", "content")
    headers = (
        files.mapInPandas(_row_reader(sheet, True), _ROWS)
        .select(F.transform("cells", lambda c: c["text"]).alias("names"))
        .distinct()
        .limit(2)
        .collect()
    )
    if not headers:
        raise EmptyDataError(NO_ROWS)
    if len(headers) > 1:
        raise CleaningError("The workbooks do not share one header row.")
    names = unique_names(headers[0]["names"])
    rows = files.mapInPandas(_row_reader(sheet, False), _ROWS)

    def text(i):
        return F.get("cells", F.lit(i))["text"]

    def kind(i):
        return F.get("cells", F.lit(i))["kind"]

    def value(i):
        missing = (kind(i) == "s") & text(i).isin(*na_values)
        return F.when(~missing, text(i))

    tests = [F.count(F.lit(1)).alias("rows")]
    for i in range(len(names)):
        present = value(i).isNotNull()
        tests += [
            F.count_if(present).alias(f"all{i}"),
            *[F.count_if(present & (kind(i) == k)).alias(f"{k}{i}") for k in "nbd"],
            F.count_if(present & (kind(i) == "n") & text(i).rlike("^-?[0-9]+$")).alias(f"w{i}"),
        ]
    fits = rows.agg(*tests).first()
    if not fits["rows"]:
        raise EmptyDataError(NO_ROWS)
    columns = []
    for i, name in enumerate(names):
        n = fits[f"all{i}"]
        candidates = (("w", "bigint"), ("n", "double"), ("b", "boolean"), ("d", "timestamp"))
        dtype = next((t for k, t in candidates if fits[f"{k}{i}"] == n), "string")
        columns.append(value(i).try_cast("double" if not n else dtype).alias(name))
    return rows.select(*columns)
