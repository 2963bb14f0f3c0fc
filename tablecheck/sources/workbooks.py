"""Folders of ``.xlsx`` workbooks as one table; a task reads a workbook row by row.

The first worksheet in the order of the tabs is read, which the workbook names by a relationship and not by the name of a part.
Cells whose style shows a date or a time give ISO text; error cells are null.
"""

from __future__ import annotations

import datetime
import io
import itertools
import re
import string
import warnings
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names
from ..operators.writetypes import cast_columns, infer_write_types
from ..plans.files import access_settings, any_case, files_to_open, open_file
from ..plans.shipping import ship_package
from ..plans.storage import stored
from .options import normalize_options

ROW_SCHEMA = "path string, row_number bigint, is_header boolean, width int, cells array<string>, error string"
_BATCH = 1000
#: Bad files that an error or a warning names.
_NAMED = 10

# Namespaces and part names of the format, and its built-in number formats for dates and times.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
RELATION = "{http://schemas.openxmlformats.org/package/2006/relationships}Relationship"
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
# Quoted text, colours and conditions in brackets (but not elapsed time), escaped characters.
NOT_DATE_PARTS = re.compile(r'"[^"]*"|\[(?!h+\]|m+\]|s+\])[^\]]*\]|\\.|_.|\*.', re.I)


class NotAWorkbook(ValueError):
    """The file has the ending of a workbook and other content."""


@dataclass
class Book:
    """What the cells of a workbook refer to: the part of its first sheet, shared texts, date styles, first day."""

    sheet: str
    texts: list[str] = field(default_factory=list)
    dated: set[int] = field(default_factory=set)
    day_zero: datetime.datetime = datetime.datetime(1899, 12, 30)

    @classmethod
    def of(cls, archive: zipfile.ZipFile) -> Book:
        parts = set(archive.namelist())
        tree = ElementTree.fromstring(archive.read("xl/workbook.xml"))
        targets = {}
        for link in ElementTree.fromstring(archive.read("xl/_rels/workbook.xml.rels")).iter(RELATION):
            if link.attrib["Type"].endswith("/worksheet"):
                target = link.attrib["Target"]
                targets[link.attrib["Id"]] = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        sheets = [targets[s.attrib[LINK]] for s in tree.iter(f"{MAIN}sheet") if s.attrib[LINK] in targets]
        if not sheets:
            raise ValueError("the workbook has no worksheet")
        book = cls(sheets[0])
        if any(p.attrib.get("date1904") in ("1", "true") for p in tree.iter(f"{MAIN}workbookPr")):
            book.day_zero = datetime.datetime(1904, 1, 1)
        if "xl/sharedStrings.xml" in parts:
            with archive.open("xl/sharedStrings.xml") as part:
                for _, item in ElementTree.iterparse(part):
                    if item.tag == f"{MAIN}si":
                        book.texts.append(_plain_text(item))
                        item.clear()
        if "xl/styles.xml" in parts:
            styles = ElementTree.fromstring(archive.read("xl/styles.xml"))
            own = {int(f.attrib["numFmtId"]) for f in styles.iter(f"{MAIN}numFmt") if re.search("[ymdhs]", NOT_DATE_PARTS.sub("", f.attrib["formatCode"]), re.I)}
            cells = styles.find(f"{MAIN}cellXfs")
            book.dated = {k for k, x in enumerate(cells if cells is not None else ()) if int(x.attrib.get("numFmtId", 0)) in DATE_FORMATS | own}
        return book

    def text_of(self, cell: ElementTree.Element) -> str | None:
        kind = cell.attrib.get("t", "n")
        if kind == "inlineStr":
            return _plain_text(cell)
        value = cell.findtext(f"{MAIN}v")
        if value is None or kind == "e":
            return None
        if kind == "s":
            return self.texts[int(value)]
        if kind == "b":
            return {"1": "true"}.get(value, "false")
        if kind == "n" and int(cell.attrib.get("s", 0)) in self.dated:
            return self.moment(float(value))
        return value

    def moment(self, serial: float) -> str:
        """ISO text of a day number: a time below 1, a date where there is no time of day."""
        at = self.day_zero + datetime.timedelta(seconds=round(serial * 86_400))
        if 0 <= serial < 1:
            return at.time().isoformat()
        return at.date().isoformat() if at.time() == datetime.time() else at.isoformat(sep=" ")


def _plain_text(node: ElementTree.Element) -> str:
    """All runs of a text, without phonetic hints."""
    return "".join(t.text or "" for child in node for t in ([child] if child.tag == f"{MAIN}t" else child.iter(f"{MAIN}t") if child.tag != f"{MAIN}rPh" else ()))


def column_names() -> Iterator[str]:
    """A, B, ..., Z, AA, AB, ..."""
    for size in itertools.count(1):
        yield from map("".join, itertools.product(string.ascii_uppercase, repeat=size))


def column_place(reference: str) -> int:
    """Place of the column in a cell's reference, from 1; 0 without one."""
    letters = reference.rstrip(string.digits)
    return sum((1 + string.ascii_uppercase.index(letter)) * 26**k for k, letter in enumerate(reversed(letters)))


def sheet_rows(content: io.BufferedIOBase) -> Iterator[tuple[int, dict[int, str | None]]]:
    """(row number, {column place: text}) of the first worksheet, in order. Rows and cells without a reference follow the one before."""
    if content.read(2) not in (b"", b"PK"):
        raise NotAWorkbook("the file is no zip archive")
    content.seek(0)
    with zipfile.ZipFile(content) as archive:
        book = Book.of(archive)
        number = 0
        with archive.open(book.sheet) as part:
            for _, row in ElementTree.iterparse(part):
                if row.tag != f"{MAIN}row":
                    continue
                number = int(row.attrib.get("r", number + 1))
                place, cells = 0, {}
                for cell in row.iterfind(f"{MAIN}c"):
                    place = column_place(cell.attrib.get("r", "")) or place + 1
                    cells[place] = book.text_of(cell)
                yield number, cells
                row.clear()


def table_rows(content: io.BufferedIOBase, header_row: int, data_start_row: int) -> Iterator[tuple[int, bool, int, list[str | None]]]:
    """(row number, is header, width, cells) of the header and of the data rows up to the first empty one.

    The table is as wide as its header or its first data row, whichever is wider.
    """
    width, following = 0, data_start_row
    for number, cells in sheet_rows(content):
        filled = [place for place, text in cells.items() if text]
        if number == header_row or number == data_start_row:
            width = max(filled, default=0) if not width else max(width, *filled, 0)
        line = [cells.get(place) for place in range(1, width + 1)]
        if number == header_row:
            yield number, True, width, line
        elif number >= data_start_row:
            if number > following or not filled:
                return
            following = number + 1
            yield number, False, width, line


def workbook_rows(files: DataFrame, options: dict) -> DataFrame:
    """Rows of every workbook of ``files_to_open``; a bad workbook gives a row with ``error``, after those read before it failed.

    So who reads this must look for errors: rows without one are not the whole of a bad workbook.
    """
    settings = access_settings(files.sparkSession)
    header_row, data_start_row = options["header_row"], options["data_start_row"]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fields = ["path", "row_number", "is_header", "width", "cells", "error"]
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                rows = []
                try:
                    with open_file(path, settings, content) as source:
                        for number, is_header, width, cells in table_rows(source, header_row, data_start_row):
                            rows.append((path, number, is_header, width, cells, None))
                            if len(rows) == _BATCH:
                                yield pd.DataFrame(rows, columns=fields)
                                rows = []
                except Exception as problem:  # reported, so that all bad workbooks become known at once
                    rows.append((path, None, False, 0, None, f"{type(problem).__name__}: {problem}"))
                if rows:
                    yield pd.DataFrame(rows, columns=fields)

    ship_package(files.sparkSession)
    return files.select("path", "content").mapInPandas(read, ROW_SCHEMA)


def _whole(rows: DataFrame, only_workbooks: bool) -> DataFrame:
    """The rows without errors, if no workbook has one: what could be read of a bad one is not the table that was asked for.

    Files that are no workbooks have nothing to give. They are left out with a warning, unless only workbooks are expected.
    """
    bad = rows.filter("error IS NOT NULL").select("path", "error")
    other = F.col("error").startswith(f"{NotAWorkbook.__name__}:")
    for chosen, fails in ((F.lit(True) if only_workbooks else ~other, True), (other, False)):
        named = bad.filter(chosen).orderBy("path").limit(_NAMED + 1).collect()
        if not named:
            continue
        text = "; ".join(f"{r.path}: {r.error}" for r in named[:_NAMED]) + ("; and others" if len(named) > _NAMED else "")
        if fails:
            raise ValueError(f"Workbooks cannot be read whole: {text}")
        warnings.warn(f"No workbooks, left out: {text}", stacklevel=3)
    return rows.filter("error IS NULL")


def read_workbooks(spark: SparkSession, path: str, options: dict | None = None, only_workbooks: bool = False) -> DataFrame:
    """All workbooks below ``path`` (a file, folder or glob) as one table with a ``_path`` column.

    Columns are the header names in order of their first place (letters of the
    sheet when ``header_row`` is 0). The header names, at most a few thousand,
    come to the driver; the rows do not. Workbooks are parsed once, as names,
    types and rows would each do so again.

    A workbook that fails, at whatever row, raises an error with its path. A file that begins as no zip archive does is no workbook; it is
    left out with a warning, or raises an error too with ``only_workbooks``.
    """
    chosen = normalize_options("workbook", options)
    rows = _whole(stored(workbook_rows(files_to_open(spark, path, any_case("xlsx")), chosen)), only_workbooks)
    if chosen["header_row"]:
        headers = rows.filter("is_header").select("path", F.posexplode("cells").alias("pos", "name"))
        headers = headers.withColumn("name", F.coalesce(F.nullif(F.trim("name"), F.lit("")), F.concat(F.lit("column_"), F.col("pos") + 1)))
        found = headers.groupBy("name").agg(F.min("pos").alias("pos")).orderBy("pos", "name").collect()
        wanted = [r.name for r in found]
        by_name = headers.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("name", "pos"))).alias("at"))
        data = rows.filter("NOT is_header").join(by_name, "path")
        values = [F.get("cells", F.try_element_at("at", F.lit(n))).alias(n) for n in wanted]
    else:
        width = rows.agg(F.coalesce(F.max("width"), F.lit(0)).alias("w")).first().w
        wanted = list(itertools.islice(column_names(), width))
        data = rows.filter("NOT is_header")
        values = [F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(wanted)]
    table = data.select(F.col("path").alias("_path"), F.col("row_number").alias("_row"), *values)
    if not chosen["infer_types"] or not wanted:
        return table
    types = {r.column: r.write_type for r in infer_write_types(table.select(*[names.col(n) for n in wanted])).collect()}
    return cast_columns(table, {n: types[n] for n in wanted})
