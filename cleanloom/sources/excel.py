"""Workbook source: .xlsx files read in parallel, one file per task, rows streamed out of the sheet."""

from __future__ import annotations

import datetime as dt
import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cleanloom.operators.infer import cast_physical, physical_types
from cleanloom.session import scratch_path
from cleanloom.sources.csv import ROW_KEY, null_tokens_to_null, unique_names

ROWS_PER_BATCH = 5000
# Built-in number formats that show dates.
DATE_FORMAT_IDS = frozenset([*range(14, 23), *range(45, 48)])


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _children(data: bytes, tag: str):
    for _, node in ElementTree.iterparse(io.BytesIO(data)):
        if _local(node.tag) == tag:
            yield node


def _sheet_path(book: zipfile.ZipFile, sheet) -> str:
    sheets = list(_children(book.read("xl/workbook.xml"), "sheet"))
    names = [s.get("name") for s in sheets]
    if isinstance(sheet, str) and sheet not in names:
        raise ValueError(f"no sheet {sheet!r}, found {names}")
    node = sheets[names.index(sheet) if isinstance(sheet, str) else sheet]
    link = next(v for k, v in node.attrib.items() if _local(k) == "id")
    target = next(r.get("Target") for r in _children(book.read("xl/_rels/workbook.xml.rels"), "Relationship")
                  if r.get("Id") == link)
    return target.lstrip("/") if target.startswith("/") else f"xl/{target}"


def _shared_strings(book) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    return ["".join(t.text or "" for t in node.iter() if _local(t.tag) == "t")
            for node in _children(book.read("xl/sharedStrings.xml"), "si")]


def _date_styles(book) -> set[int]:
    """Cell styles that show a date."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    custom = {int(n.get("numFmtId")) for n in root.iter() if _local(n.tag) == "numFmt"
              and re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", n.get("formatCode", "").lower()))}
    cells = next((n for n in root.iter() if _local(n.tag) == "cellXfs"), [])
    return {i for i, xf in enumerate(cells) if int(xf.get("numFmtId", 0)) in custom | DATE_FORMAT_IDS}


def _position(reference: str | None, after: int) -> int:
    letters = re.match(r"[A-Z]+", reference or "")
    if not letters:
        return after
    place = 0
    for ch in letters.group():
        place = place * 26 + ord(ch) - 64
    return place - 1


def _cell_value(cell, shared, dates) -> str | None:
    form = cell.get("t", "n")
    if form == "inlineStr":
        return "".join(t.text or "" for t in cell.iter() if _local(t.tag) == "t")
    value = next((n.text for n in cell if _local(n.tag) == "v"), None)
    if value is None or form == "e":
        return None
    if form == "s":
        return shared[int(value)]
    if form == "b":
        return "True" if value == "1" else "False"
    if form == "n" and int(cell.get("s", 0)) in dates:
        moment = dt.datetime(1899, 12, 30) + dt.timedelta(days=float(value))
        return moment.replace(microsecond=0).isoformat(sep=" ")
    return value


def sheet_rows(content: bytes, sheet=0):
    """Yield (row number, cell texts) of one sheet; blank rows in between come as empty lists."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared, dates = _shared_strings(book), _date_styles(book)
        expected = 1
        with book.open(_sheet_path(book, sheet)) as stream:
            for _, node in ElementTree.iterparse(stream):
                if _local(node.tag) != "row":
                    continue
                number = int(node.get("r", expected))
                while expected < number:
                    yield expected, []
                    expected += 1
                cells: list = []
                for cell in node:
                    place = _position(cell.get("r"), len(cells))
                    cells += [None] * (place + 1 - len(cells))
                    cells[place] = _cell_value(cell, shared, dates)
                yield number, cells
                expected = number + 1
                node.clear()


def parse_workbooks(files: DataFrame, sheet=0, infer: bool = True, names: list[str] | None = None, keyed: bool = False) -> DataFrame:
    """Rows of many workbooks held as (path, content). Columns are matched by header name.

    The header is the first row of each sheet; ``names`` skips the pass that collects the headers.
    """
    if names is None:
        def headers(batches):
            for pdf in batches:
                for content in pdf["content"]:
                    first = next((cells for _, cells in sheet_rows(content, sheet)), [])
                    header = unique_names([c or "" for c in first])
                    yield pd.DataFrame({"place": range(len(header)), "name": header})

        # A row per column name reaches the driver, however many workbooks there are.
        found = files.select("content").mapInPandas(headers, "place int, name string").groupBy("name").agg(F.min("place").alias("place"))
        names = [row["name"] for row in found.orderBy("place", "name").collect()]
    columns = list(names)

    def rows(batches):
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                source = sheet_rows(content, sheet)
                header = unique_names([c or "" for c in next(source, (1, []))[1]])
                place = [header.index(c) if c in header else None for c in columns]
                numbers, cells = [], []
                for number, values in source:
                    numbers.append(number)
                    cells.append([values[p] if p is not None and p < len(values) else None for p in place])
                    if len(numbers) >= ROWS_PER_BATCH:
                        yield pd.DataFrame({"path": path, "row": numbers, "cells": cells})
                        numbers, cells = [], []
                if numbers:
                    yield pd.DataFrame({"path": path, "row": numbers, "cells": cells})

    schema = "path string, row long, cells array<string>"
    stored = scratch_path(files.sparkSession, "workbooks")  # each workbook is unpacked once
    files.select("path", "content").mapInPandas(rows, schema).write.parquet(stored)
    parsed = files.sparkSession.read.schema(schema).parquet(stored)
    key = [F.col("path").alias(ROW_KEY[0]), F.lit(0).cast("long").alias(ROW_KEY[1]), F.col("row").alias(ROW_KEY[2])]
    df = null_tokens_to_null(parsed.select(*[F.col("cells")[i].alias(c) for i, c in enumerate(columns)], *(key if keyed else [])))
    return cast_physical(df, physical_types(df, columns)) if infer else df


def read_excel(spark: SparkSession, path, sheet=0, infer: bool = True, keyed: bool = False) -> DataFrame:
    """Read one .xlsx file, a folder of them, or a glob. ``keyed`` adds the place of each row."""
    files = spark.read.format("binaryFile").load(path)
    return parse_workbooks(files, sheet, infer, keyed=keyed)
