"""Workbooks of the XML kind (.xlsx, .xlsm), read by tasks with the standard library alone.

A workbook is a zip archive, which can't be split: a task takes a file, streams the XML of one sheet and hands its rows
out in batches. Only names of sheets and the header come to the driver. All cells are text, as in other text files; types
are decided by all of them afterwards. Dates are numbers under a date format, and become ISO text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows of a batch.
ROWS = 4_096
#: Numbers of the built-in formats that show dates or times.
DATE_FORMATS = (*range(14, 23), *range(45, 48))


def files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("content")


def sheet_names(spark: SparkSession, path: str) -> list[str]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in opened(content.as_py())[1]], pa.string())], ["name"])

    return [r["name"] for r in files(spark, path).mapInArrow(run, "name string").collect()]


def rows(spark: SparkSession, path: str, sheet: int = 0) -> DataFrame:
    """(place, cells): the filled rows of a sheet in order, cells as text or null."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                held: list[tuple[int, list[str | None]]] = []
                for row in sheet_rows(content.as_py(), sheet):
                    held.append(row)
                    if len(held) == ROWS:
                        yield packed(held)
                        held = []
                yield packed(held)

    return files(spark, path).mapInArrow(run, "place long, cells array<string>")


def packed(held: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p for p, _ in held], pa.int64()), pa.array([c for _, c in held], pa.list_(pa.string()))], ["place", "cells"])


def tag(element) -> str:
    """An element's name without its namespace, of which the format has two editions."""
    return element.tag.rpartition("}")[2]


def opened(content: bytes):
    """The archive, and name and part of each sheet."""
    import io
    import zipfile
    from xml.etree import ElementTree as xml

    book = zipfile.ZipFile(io.BytesIO(content))
    parts = {r.get("Id"): r.get("Target") for r in xml.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    found = []
    for s in xml.fromstring(book.read("xl/workbook.xml")).iter():
        if tag(s) == "sheet":
            target = parts[next(v for k, v in s.attrib.items() if k.rpartition("}")[2] == "id")]
            found.append((s.get("name"), target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
    return book, found


def shared_strings(book) -> list[str]:
    from xml.etree import ElementTree as xml

    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    out = []
    with book.open("xl/sharedStrings.xml") as f:
        for _, e in xml.iterparse(f):
            if tag(e) == "si":
                out.append("".join(t.text or "" for t in e.iter() if tag(t) == "t"))
                e.clear()
    return out


def date_styles(book) -> set[int]:
    """The cell styles whose format shows a date or a time."""
    import re
    from xml.etree import ElementTree as xml

    if "xl/styles.xml" not in book.namelist():
        return set()
    root = xml.fromstring(book.read("xl/styles.xml"))
    own = {int(e.get("numFmtId")) for e in root.iter() if tag(e) == "numFmt" and re.search("[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", e.get("formatCode", "").lower()))}
    styles = next((list(e) for e in root if tag(e) == "cellXfs"), [])
    return {i for i, x in enumerate(styles) if int(x.get("numFmtId", 0)) in own or int(x.get("numFmtId", 0)) in DATE_FORMATS}


def moment(serial: float) -> str:
    """ISO text of a day number (day 60 of the format doesn't exist), with the time of day where there is one."""
    import datetime

    when = datetime.datetime(1899, 12, 30 if serial >= 60 else 31) + datetime.timedelta(seconds=round(serial * 86_400))
    return when.strftime("%Y-%m-%d" if serial == int(serial) else "%Y-%m-%d %H:%M:%S")


def sheet_rows(content: bytes, sheet: int) -> Iterator[tuple[int, list[str | None]]]:
    from xml.etree import ElementTree as xml

    book, sheets = opened(content)
    strings, dates = shared_strings(book), date_styles(book)
    place = 0
    with book.open(sheets[sheet][1]) as f:
        for _, e in xml.iterparse(f):
            if tag(e) != "row":
                continue
            cells: list[str | None] = []
            for c in e:
                letters = "".join(x for x in c.get("r", "") if x.isalpha())
                at = len(cells)
                if letters:
                    at = 0
                    for x in letters:
                        at = at * 26 + ord(x.upper()) - 64
                    at -= 1
                cells += [None] * (at + 1 - len(cells))
                cells[at] = cell_text(c, strings, dates)
            e.clear()
            if any(x is not None for x in cells):
                yield place, cells
                place += 1


def cell_text(c, strings: list[str], dates: set[int]) -> str | None:
    kind = c.get("t", "n")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in c.iter() if tag(t) == "t")
    value = next((v.text for v in c if tag(v) == "v"), None)
    if value is None or kind == "e":
        return None
    if kind == "s":
        return strings[int(value)]
    if kind == "b":
        return "True" if value == "1" else "False"
    if kind == "n" and int(c.get("s", 0)) in dates:
        return moment(float(value))
    return value
