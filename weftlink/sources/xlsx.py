"""Worksheet source: one sheet of an .xlsx file, every cell as text.

A workbook is one zip archive of XML, so a file is read by one task; several files are read by several
tasks. ``read_sheet`` takes any path that Spark reads; ``spark.read.format("sheet").option("sheet", name).load(path)``
after ``register`` is for paths that the driver and the executors have mounted.
"""

import glob
import io
import json
import re
import zipfile
from collections.abc import Iterator
from typing import BinaryIO
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

# ---- fixed values -------------------------------------------------------------------------
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
OFFICE = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
# -------------------------------------------------------------------------------------------


def _column(reference: str) -> int:
    number = 0
    for letter in re.match("[A-Z]+", reference).group():
        number = number * 26 + ord(letter) - 64
    return number - 1


def _plain(node: ElementTree.Element) -> str:
    # phonetic hints are not part of the text
    return "".join(t.text or "" for part in node if part.tag != f"{MAIN}rPh" for t in part.iter(f"{MAIN}t"))


def read_rows(path: str | BinaryIO, sheet: str) -> Iterator[list[str | None]]:
    """The rows of a sheet of a workbook, given as a local path or an open file."""
    with zipfile.ZipFile(path) as book:
        workbook = ElementTree.fromstring(book.read("xl/workbook.xml"))
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        targets = {s.get("name"): links[s.get(f"{OFFICE}id")] for s in workbook.iter(f"{MAIN}sheet")}
        if sheet not in targets:
            raise ValueError(f"{path if isinstance(path, str) else 'a workbook'} has no sheet {sheet!r}; it has {', '.join(targets)}")
        shared: list[str] = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = [_text_of(s) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))]
        target = targets[sheet].lstrip("/")
        with book.open(target if target.startswith("xl/") else f"xl/{target}") as xml:
            for _, row in ElementTree.iterparse(xml):
                if row.tag != f"{MAIN}row":
                    continue
                cells: dict[int, str | None] = {}
                for cell in row.iter(f"{MAIN}c"):
                    cells[_column(cell.get("r"))] = _value(cell, shared)
                yield [cells.get(i) for i in range(max(cells, default=-1) + 1)]
                row.clear()


def _text_of(item: ElementTree.Element) -> str:
    direct = item.find(f"{MAIN}t")
    return direct.text or "" if direct is not None else _plain(item)


def _value(cell: ElementTree.Element, shared: list[str]) -> str | None:
    kind = cell.get("t")
    if kind == "inlineStr":
        return _text_of(cell.find(f"{MAIN}is"))
    value = cell.find(f"{MAIN}v")
    if value is None or value.text is None:
        return None
    return shared[int(value.text)] if kind == "s" else value.text


def header_names(header: list[str | None]) -> list[str]:
    return [n or f"column{i + 1}" for i, n in enumerate(header)]


class SheetSource(DataSource):
    """Options: ``path`` (glob allowed) and ``sheet``; the first row of each file names its columns.

    The table has the columns of all files; a column that a file lacks is NULL in its rows.
    """

    @classmethod
    def name(cls) -> str:
        return "sheet"

    def _files(self) -> list[str]:
        files = sorted(glob.glob(self.options["path"]))
        if not files:
            raise FileNotFoundError(self.options["path"])
        return files

    def schema(self) -> StructType:
        names = [n for f in self._files() for n in header_names(next(read_rows(f, self.options["sheet"])))]
        return StructType([StructField(n, StringType()) for n in dict.fromkeys(names)])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _SheetReader(self._files(), self.options["sheet"], schema)


class _SheetReader(DataSourceReader):
    def __init__(self, files: list[str], sheet: str, schema: StructType) -> None:
        self.files, self.sheet, self.names = files, sheet, schema.fieldNames()

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(f) for f in self.files]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from named_rows(partition.value, self.sheet, self.names, partition.value)


def named_rows(book: str | BinaryIO, sheet: str, names: list[str], what: str) -> Iterator[tuple]:
    """The rows under the header, their cells in the order of ``names``; rows without a cell are left out."""
    rows = read_rows(book, sheet)
    header = header_names(next(rows))
    if unknown := [n for n in header if n not in names]:
        raise ValueError(f"{what} has columns that the schema lacks: {', '.join(unknown)}")
    places = [header.index(n) if n in header else None for n in names]
    for row in rows:
        if any(v is not None for v in row[len(header) :]):
            raise ValueError(f"{what} has a row with cells beyond its {len(header)} named columns")
        padded = row + [None] * len(header)
        values = [None if i is None else padded[i] for i in places]
        if any(v is not None for v in values):
            yield tuple(values)


@F.udtf
class SheetRows:
    """``(path, content, sheet, names)``: a workbook's bytes as rows; ``names`` is a constant JSON list of the columns."""

    @staticmethod
    def analyze(path: AnalyzeArgument, content: AnalyzeArgument, sheet: AnalyzeArgument, names: AnalyzeArgument) -> AnalyzeResult:
        if not isinstance(names.value, str):
            raise ValueError("names must be a constant JSON list")
        return AnalyzeResult(StructType([StructField(n, StringType()) for n in json.loads(names.value)]))

    def eval(self, path: str, content: bytes, sheet: str, names: str) -> Iterator[tuple]:
        yield from named_rows(io.BytesIO(content), sheet, json.loads(names), path)


def sheet_rows(books: DataFrame, sheet: str) -> DataFrame:
    """One sheet of each workbook of ``path, content``, with the columns of all of them; a header is read before the rows."""
    spark = books.sparkSession

    def headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                names = header_names(next(read_rows(io.BytesIO(content.as_py()), sheet)))
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(range(len(names)), pa.int64())], names=["name", "at"])

    found = books.select("content").mapInArrow(headers, "name string, at long").groupBy("name").agg(F.min("at").alias("at"))
    names = [r.name for r in found.orderBy("at", "name").collect()]  # one for each column of a sheet
    spark.udtf.register("sheet_rows", SheetRows)
    call = "SELECT t.* FROM {books} b, LATERAL sheet_rows(b.path, b.content, :sheet, :names) t"
    return spark.sql(call, {"sheet": sheet, "names": json.dumps(names)}, books=books.select("path", "content"))


def read_sheet(spark: SparkSession, path: str, sheet: str) -> DataFrame:
    """One sheet of all workbooks under a path (globs allowed) of any file system that Spark reads."""
    return sheet_rows(spark.read.format("binaryFile").load(path), sheet)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SheetSource)
