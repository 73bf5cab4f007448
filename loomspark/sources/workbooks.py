"""XLSX workbooks as a long table of cells.

``read_workbooks`` takes them from any file system of Spark's, a file a task.  The data source
``xlsx`` (``XlsxSource``) makes a partition of each sheet, so that a large workbook isn't one task, and
``CellTable`` keeps the cells and parses only files that have changed.
"""

from __future__ import annotations

import io
import json
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from typing import IO
from urllib.parse import quote
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import IntegerType, LongType, StringType, StructType, TimestampType

from loomspark.streaming.store import Store, TableSpec

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
CELLS = "file string, sheet string, row int, col int, value string"


def column_number(reference: str) -> int:
    """``A1`` is 0, ``B1`` 1, ``AA1`` 26."""
    n = 0
    for letter in re.match("[A-Z]+", reference)[0]:
        n = n * 26 + ord(letter) - 64
    return n - 1


def _text(node: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in node.iter(f"{_MAIN}t"))


def _tree(book: zipfile.ZipFile, name: str) -> ElementTree.Element:
    return ElementTree.fromstring(book.read(name))


def _sheets(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """Name and member of each sheet, in order."""
    targets = {x.get("Id"): x.get("Target").lstrip("/") for x in _tree(book, "xl/_rels/workbook.xml.rels")}
    found = ((x.get("name"), targets[x.get(_LINK)]) for x in _tree(book, "xl/workbook.xml").iter(f"{_MAIN}sheet"))
    return [(name, target if target.startswith("xl/") else f"xl/{target}") for name, target in found]


def _shared_texts(book: zipfile.ZipFile) -> list[str]:
    out = []
    if "xl/sharedStrings.xml" in book.namelist():
        with book.open("xl/sharedStrings.xml") as stream:
            for _, node in ElementTree.iterparse(stream):
                if node.tag == f"{_MAIN}si":
                    out.append(_text(node))
                    node.clear()
    return out


def _sheet_cells(stream: IO[bytes], shared: list[str]) -> Iterator[tuple[int, int, str]]:
    """``row, col, value`` of a sheet's filled cells, row by row: a row is given up once it is read.
    A row or cell that doesn't say where it is follows the one before."""
    rows, row, col = None, 0, -1
    for event, node in ElementTree.iterparse(stream, events=("start", "end")):
        if event == "start":
            if node.tag == f"{_MAIN}sheetData":
                rows = node
            elif node.tag == f"{_MAIN}row":
                row, col = int(node.get("r") or row + 1), -1
        elif node.tag == f"{_MAIN}c":
            place = node.get("r")
            col = column_number(place) if place else col + 1
            value = node.findtext(f"{_MAIN}v")
            if node.get("t") == "s" and value is not None:
                value = shared[int(value)]
            elif node.get("t") == "inlineStr":
                value = _text(node)
            if value:
                yield int(re.search("[0-9]+", place)[0]) if place else row, col, value
        elif node.tag == f"{_MAIN}row" and rows is not None:
            rows.clear()


def workbook_cells(content: bytes) -> Iterator[tuple[str, int, int, str]]:
    """``sheet, row, col, value`` of the filled cells; rows count from 1, columns from 0."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared = _shared_texts(book)
        for name, member in _sheets(book):
            with book.open(member) as stream:
                for row, col, value in _sheet_cells(stream, shared):
                    yield name, row, col, value


# ---- a partition a sheet ---------------------------------------------------------------
def _opened(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of what Spark calls ``path``."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(quote(path, safe=":/@")) if "://" in path else (fs.LocalFileSystem(), path)


@lru_cache(maxsize=1)
def _texts_of(path: str, mark: int) -> list[str]:
    """A workbook's shared strings: a worker that takes its sheets one after another reads them once."""
    files, name = _opened(path)
    with files.open_input_file(name) as file, zipfile.ZipFile(file) as book:
        return _shared_texts(book)


@dataclass
class _Sheet(InputPartition):
    path: str
    mark: int
    name: str
    member: str


class _XlsxReader(DataSourceReader):
    BATCH = 10_000

    def __init__(self, paths: list[str]):
        self.paths = paths

    def _books(self) -> Iterator[str]:
        for path in self.paths:
            files, name = _opened(path)
            if files.get_file_info(name).type != fs.FileType.Directory:
                yield path
                continue
            for found in sorted(files.get_file_info(fs.FileSelector(name)), key=lambda f: f.path):
                if found.is_file and found.base_name.endswith(".xlsx") and not found.base_name.startswith("~$"):
                    yield f"{path.rstrip('/')}/{found.base_name}"

    def partitions(self) -> list[_Sheet]:
        out = []
        for path in self._books():
            files, name = _opened(path)
            mark = files.get_file_info(name).mtime_ns or 0
            # a zip's directory is at its end: only it and the list of sheets are read here
            with files.open_input_file(name) as file, zipfile.ZipFile(file) as book:
                out += [_Sheet(path, mark, *sheet) for sheet in _sheets(book)]
        return out or [_Sheet("", 0, "", "")]

    def read(self, sheet: _Sheet) -> Iterator[pa.RecordBatch]:
        if not sheet.path:
            return
        shape = pa.schema({"path": pa.string(), "file": pa.string(), "sheet": pa.string(), "row": pa.int32(), "col": pa.int32(), "value": pa.string()})
        files, name = _opened(sheet.path)
        shared = _texts_of(sheet.path, sheet.mark)

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            columns = [[sheet.path] * len(rows), [name.rpartition("/")[2]] * len(rows), [sheet.name] * len(rows), *map(list, zip(*rows))]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, shape)], schema=shape)

        with files.open_input_file(name) as file, zipfile.ZipFile(file) as book, book.open(sheet.member) as stream:
            rows = []
            for cell in _sheet_cells(stream, shared):
                rows.append(cell)
                if len(rows) == self.BATCH:
                    yield batch(rows)
                    rows = []
            if rows:
                yield batch(rows)


class XlsxSource(DataSource):
    """``path, file, sheet, row, col, value`` of the filled cells of workbooks, a partition a sheet.

    ``load(path)`` takes a workbook or a folder, without files that an editor has locked; the option
    ``files`` is a JSON list of workbooks instead.  A partition holds its sheet's current row, one batch
    of cells and the workbook's shared strings.
    """

    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def schema(self) -> str:
        return f"path string, {CELLS}"

    def reader(self, schema: StructType) -> DataSourceReader:
        files = self.options.get("files")
        return _XlsxReader([self.options["path"]] if files is None else json.loads(files))


def read_sheets(spark: SparkSession, *paths: str) -> DataFrame:
    """Cells of workbooks or folders by the data source ``xlsx``."""
    spark.dataSource.register(XlsxSource)
    return spark.read.format("xlsx").option("files", json.dumps(paths)).load()


def _files(spark: SparkSession, path: str) -> DataFrame:
    """The workbooks under a path but for those that an editor has locked."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path)
    return found.where(~F.startswith(F.substring_index("path", "/", -1), F.lit("~$")))


def fingerprint(spark: SparkSession, path: str) -> tuple[int, int]:
    """Number of the workbooks, and a hash that changes with their names, sizes and times."""
    mark = F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")
    n, sum_ = _files(spark, path).agg(F.count("*"), F.coalesce(F.sum(mark), F.lit(0))).first()
    return n, int(sum_)


class WorkbookCache:
    """Cells of the workbooks under a path, read again only when the files have changed."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._mark, self._cells = None, None

    def cells(self) -> DataFrame:
        if (mark := fingerprint(self.spark, self.path)) != self._mark:
            if self._cells is not None:
                self._cells.unpersist()
            self._mark, self._cells = mark, read_workbooks(self.spark, self.path).cache()
        return self._cells


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """The filled cells of all workbooks under a path; a file is one task's work."""

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"]):
                rows = [(file.rpartition("/")[2], *c) for c in workbook_cells(bytes(content))]
                yield pd.DataFrame(rows, columns=["file", "sheet", "row", "col", "value"])

    return _files(spark, path).select("path", "content").mapInPandas(cells, CELLS)


class CellTable:
    """Cells of the workbooks under a path, kept in a store; only changed files are parsed.

    A file is told by path, length and time.  Files and cells change together, in one version of the
    store; a cell counts if it comes from its file's last state, so cells that a change leaves out, and
    files that are gone, are there no more.
    """

    FILE = StructType().add("path", StringType()).add("length", LongType()).add("modificationTime", TimestampType()).add("mark", LongType())
    CELL = (
        StructType().add("path", StringType()).add("sheet", StringType()).add("row", IntegerType()).add("col", IntegerType())
        .add("file", StringType()).add("value", StringType()).add("mark", LongType())
    )

    def __init__(self, spark: SparkSession, path: str, store: str):
        self.spark, self.path = spark, path
        self.store = Store(spark, store, {
            "files": TableSpec(self.FILE, ("path",), ("length", "modificationTime", "mark")),
            "cells": TableSpec(self.CELL, ("path", "sheet", "row", "col"), ("file", "value", "mark")),
        }, buckets=8)

    def refresh(self) -> dict[str, int]:
        """Bring the table up to date: how many files were ``parsed`` and ``removed``."""
        columns = ["path", "length", "modificationTime"]
        now = _files(self.spark, self.path).select(*columns, F.xxhash64(*columns).alias("mark"))
        old = self.store.read("files").select("path", F.col("mark").alias("_old"))
        # a file that is gone has no mark
        both = now.join(old, "path", "full").where(~F.col("mark").eqNullSafe(F.col("_old"))).select(*columns, "mark")
        rows = both.collect()  # changed files, of which the listing is with the driver already
        parsed = [r["path"] for r in rows if r["mark"] is not None]
        if not rows:
            return {"parsed": 0, "removed": 0}
        changed = self.spark.createDataFrame(rows, self.FILE)
        batch = {"files": changed}
        if parsed:
            marks = F.broadcast(changed.select("path", "mark"))  # a row a changed file
            batch["cells"] = read_sheets(self.spark, *parsed).join(marks, "path").select(*self.CELL.names)
        self.store.merge(batch, uuid.uuid4().hex, 0)
        return {"parsed": len(parsed), "removed": len(rows) - len(parsed)}

    def cells(self) -> DataFrame:
        """``file, sheet, row, col, value``, as ``read_workbooks`` gives them."""
        version = self.store.version()
        files = self.store.read("files", version).where(F.col("mark").isNotNull()).select("path", "mark")
        return self.store.read("cells", version).join(files, ["path", "mark"]).select("file", "sheet", "row", "col", "value")
