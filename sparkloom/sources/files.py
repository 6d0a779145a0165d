"""Reading and writing files.  Text stays text until it is coerced on purpose."""

from __future__ import annotations

import functools
import io
import itertools
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """All columns as text; a byte-order mark at the start of the header goes."""
    df = spark.read.csv(path, header=True, sep=sep, inferSchema=False, multiLine=True, escape='"')
    return df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])


def read_any(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """By suffix: csv, tsv, json and jsonl, parquet, orc, txt, and xlsx as grids of its sheets."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    reader = spark.read.schema(schema) if schema else spark.read
    if kind in ("csv", "tsv"):
        return read_csv(spark, path, "\t" if kind == "tsv" else ",")
    if kind in ("json", "jsonl"):
        return reader.json(path, multiLine=kind == "json")
    if kind in ("parquet", "orc"):
        return reader.format(kind).load(path)
    if kind == "xlsx":
        return read_xlsx(spark, path)
    if kind == "txt":
        return spark.read.text(path)
    raise ValueError(f"no reader for {kind!r}")


def raw_grid(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """A sheet without a header as (row_idx, cells); row numbers follow the file order of one file."""
    df = spark.read.csv(path, header=False, sep=sep, inferSchema=False)
    cells = F.array(*[F.col(c) for c in df.columns])
    return df.select(F.monotonically_increasing_id().alias("row_idx"), cells.alias("cells"))


_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def xlsx_rows(content: bytes) -> Iterator[tuple[str, int, list[str | None]]]:
    """Sheet name, row number and cells as text of a workbook, row by row; empty rows are left out.

    Shared and inline strings, numbers and formulas' last values; dates stay the numbers that they are stored as.
    """
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = set(book.namelist())
        text = lambda node: "".join(t.text or "" for t in node.iter(f"{_MAIN}t"))
        shared = [text(s) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")] if "xl/sharedStrings.xml" in names else []
        targets = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
            path = targets.get(sheet.get(_LINK), "")
            path = path.lstrip("/") if path.startswith("/") else f"xl/{path}"
            if path not in names:
                continue
            with book.open(path) as stream:
                for _, row in ElementTree.iterparse(stream):
                    if row.tag != f"{_MAIN}row":
                        continue
                    cells: list[str | None] = []
                    for c in row.iter(f"{_MAIN}c"):
                        at = functools.reduce(lambda n, ch: 26 * n + ord(ch) - 64, re.match("[A-Z]*", c.get("r", ""))[0], 0) or len(cells) + 1
                        cells += [None] * (at - len(cells))
                        value = c.find(f"{_MAIN}v")
                        if c.get("t") == "inlineStr":
                            cells[at - 1] = text(c)
                        elif value is not None and value.text is not None:
                            cells[at - 1] = shared[int(value.text)] if c.get("t") == "s" else value.text
                    if any(x is not None for x in cells):
                        yield sheet.get("name", ""), int(row.get("r", 0)) - 1, cells
                    row.clear()


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """All sheets of all workbooks under a path as grids: (path, sheet, row_idx, cells); a workbook is read by one task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                rows = xlsx_rows(content)
                while part := list(itertools.islice(rows, 10_000)):
                    yield pd.DataFrame([(p, *r) for r in part], columns=["path", "sheet", "row_idx", "cells"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, sheet string, row_idx long, cells array<string>")


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 of each file."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def write_records(df: DataFrame, path: str, kind: str = "json", mode: str = "append", by: list[str] | None = None) -> None:
    """Records as JSON lines, CSV or parquet; with ``by`` one folder for each kind of record."""
    writer = df.write.mode(mode)
    if by:
        writer = writer.partitionBy(*by)
    if kind == "csv":
        writer = writer.option("header", True)
    writer.format(kind).save(path)


def route_messages(df: DataFrame, kind: str, path: str) -> None:
    """One sink for several kinds of messages: each kind in its own folder, by one write."""
    write_records(df, path, "json", "append", [kind])
