"""Workbooks (.xlsx) as a partitioned data source, and tables as workbooks.

Format ``workbook`` scans a workbook or a folder of them.  A partition is a range of rows of one
sheet; the sheet's stated size sets the ranges, and the last one of a sheet is open, so a wrong or
missing size loses no row.  Rows before a range are skipped by their tags, without parsing; the
range itself is parsed as a stream.  Only columns named in the schema are kept, and of the shared
strings only those that the range refers to, so a task holds its own rows and nothing else.

Columns: ``file``, ``sheet`` (from 1), ``row`` (from 0, the place among the sheet's rows), and letters
of the sheet's columns, all of them strings.  A cell that is missing or has no value is null.
Readings over shared strings are left out, runs are joined.  A sheet that isn't there is an error.
"""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from chomeflow.sources.shared import qualified

ROWS_PER_PARTITION = 50_000
BLOCK = 1 << 18
_NS = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_TAG = f"{{{_NS}}}"


def _rows(stream, start: int, stop: int | None) -> Iterator[tuple[int, ElementTree.Element]]:
    """(place, element) of the rows from ``start`` up to ``stop``."""
    head = b""
    while not (opened := re.search(rb"<((?:[\w.-]+:)?)sheetData(?:\s[^>]*?)?(/?)>", head)):
        if not (block := stream.read(BLOCK)):
            return
        head += block
    if opened[2]:
        return
    parser = ElementTree.XMLPullParser(["start", "end"])
    parser.feed(head[: opened.end()])
    row, rest, at, seen = re.compile(b"<" + opened[1] + rb"row(?=[\s/>])"), head[opened.end() :], 0, 0
    while True:
        if found := row.search(rest, at):
            if seen == start:
                rest = rest[found.start() :]
                break
            seen, at = seen + 1, found.end()
        elif block := stream.read(BLOCK):
            # a tag may be cut by the end of a block
            rest, at = rest[max(at, len(rest) - 64) :] + block, 0
        else:
            return
    place, data = start, None
    while rest:
        parser.feed(rest)
        for event, element in parser.read_events():
            if element.tag == f"{_TAG}sheetData":
                data = element
            elif event == "end" and element.tag == f"{_TAG}row":
                yield place, element
                data.clear()
                place += 1
                if place == stop:
                    return
        rest = stream.read(BLOCK)


def _strings(book: zipfile.ZipFile, wanted: set[int]) -> dict[int, str]:
    """Shared strings by number: each entry's own text, or the text of its runs."""
    out: dict[int, str] = {}
    if not wanted:
        return out
    with book.open("xl/sharedStrings.xml") as stream:
        n, root = 0, None
        for event, item in ElementTree.iterparse(stream, ["start", "end"]):
            if root is None:
                root = item
            elif event == "end" and item.tag == f"{_TAG}si":
                if n in wanted:
                    own = item.find(f"{_TAG}t")
                    parts = [own] if own is not None else item.findall(f"{_TAG}r/{_TAG}t")
                    out[n] = "".join(t.text or "" for t in parts)
                n += 1
                root.clear()
    return out


@dataclass
class Range(InputPartition):
    """Rows ``start`` up to ``stop`` (None: all others) of a sheet."""

    file: str
    sheet: int
    start: int
    stop: int | None


class WorkbookReader(DataSourceReader):
    def __init__(self, path: str, sheets: list[int], rows: int, columns: list[str]):
        self.path, self.sheets, self.rows, self.columns = path, sheets, rows, columns

    def partitions(self) -> list[Range]:
        system, at = fs.FileSystem.from_uri(self.path)
        files = [at]
        if system.get_file_info(at).type == fs.FileType.Directory:
            files = sorted(f.path for f in system.get_file_info(fs.FileSelector(at)) if f.path.endswith(".xlsx"))
        return [r for f in files for r in self._ranges(system, f)]

    def _ranges(self, system: fs.FileSystem, file: str) -> Iterator[Range]:
        with system.open_input_file(file) as f, zipfile.ZipFile(f) as book:
            for sheet in self.sheets:
                with book.open(f"xl/worksheets/sheet{sheet}.xml") as stream:
                    size = re.search(rb'<(?:[\w.-]+:)?dimension[^>]*ref="[A-Z]+\d+:[A-Z]+(\d+)"', stream.read(1 << 16))
                starts = range(0, max(1, int(size[1]) if size else 1), self.rows)
                for start in starts:
                    yield Range(file, sheet, start, None if start == starts[-1] else start + self.rows)

    def read(self, partition: Range) -> Iterator[tuple]:
        system, _ = fs.FileSystem.from_uri(self.path)
        fixed = {"file": partition.file.rsplit("/", 1)[-1], "sheet": partition.sheet}
        with system.open_input_file(partition.file) as f, zipfile.ZipFile(f) as book:
            held: list[tuple[int, dict[str, str | int]]] = []
            with book.open(f"xl/worksheets/sheet{partition.sheet}.xml") as stream:
                for place, row in _rows(stream, partition.start, partition.stop):
                    cells: dict[str, str | int] = {}
                    for cell in row.findall(f"{_TAG}c"):
                        letters = re.match("[A-Z]+", cell.get("r", "A"))[0]
                        value = cell.find(f"{_TAG}v") if letters in self.columns else None
                        if value is not None and value.text is not None:
                            cells[letters] = int(value.text) if cell.get("t") == "s" else value.text
                    held.append((place, cells))
            shared = _strings(book, {v for _, cells in held for v in cells.values() if isinstance(v, int)})
        for place, cells in held:
            told = fixed | {"row": place} | {c: shared[v] if isinstance(v, int) else v for c, v in cells.items()}
            yield tuple(told.get(c) for c in self.columns)


class WorkbookSource(DataSource):
    """Options ``path``, ``sheets`` (numbers, by commas) and ``rowsPerPartition``."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return "file string, sheet int, row int, A string, B string, C string"

    def reader(self, schema) -> WorkbookReader:
        sheets = [int(s) for s in self.options.get("sheets", "1").split(",")]
        return WorkbookReader(self.options["path"], sheets, int(self.options.get("rowsPerPartition", ROWS_PER_PARTITION)), schema.fieldNames())


def scan_workbook(spark: SparkSession, path: str, sheets: list[int], schema: str = "row int, A string, B string, C string", rows_per_partition: int = ROWS_PER_PARTITION) -> DataFrame:
    """The rows of some sheets of a workbook, or of all workbooks in a folder."""
    spark.dataSource.register(WorkbookSource)
    told = {"path": qualified(spark, path), "sheets": ",".join(map(str, sheets)), "rowsPerPartition": str(rows_per_partition)}
    return spark.read.format("workbook").schema(schema).options(**told).load()


def _letters(n: int) -> str:
    return (_letters(n // 26 - 1) if n >= 26 else "") + chr(65 + n % 26)


def write_workbooks(df: DataFrame, folder: str, rows_per_file: int = ROWS_PER_PARTITION) -> int:
    """The table as workbooks of one sheet and at most ``rows_per_file`` rows, written by the tasks; gives the number of rows.

    Values are cast to strings, nulls left out.  A task that runs again writes the same files again.
    """
    at = qualified(df.sparkSession, folder)

    def save(name: str, rows: list[tuple]) -> None:
        system, root = fs.FileSystem.from_uri(at)
        numbers: dict[str, int] = {}
        cell = lambda r, c, v: f'<c r="{_letters(c)}{r}" t="s"><v>{numbers.setdefault(v, len(numbers))}</v></c>'
        body = "".join(f'<row r="{r}">' + "".join(cell(r, c, v) for c, v in enumerate(row) if v is not None) + "</row>" for r, row in enumerate(rows, 1))
        size = f"A1:{_letters(len(rows[0]) - 1)}{len(rows)}"
        system.create_dir(root, recursive=True)
        with system.open_output_stream(f"{root}/{name}.xlsx") as f, zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as book:
            book.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{_NS}"><dimension ref="{size}"/><sheetData>{body}</sheetData></worksheet>')
            items = "".join(f'<si><t xml:space="preserve">{escape(s)}</t></si>' for s in numbers)
            book.writestr("xl/sharedStrings.xml", f'<sst xmlns="{_NS}">{items}</sst>')

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        n = files = 0
        part = TaskContext.get().partitionId()
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(row)
                if len(held) == rows_per_file:
                    save(f"part-{part:06d}-{files:06d}", held)
                    n, files, held = n + len(held), files + 1, []
        if held:
            save(f"part-{part:06d}-{files:06d}", held)
        yield pa.RecordBatch.from_arrays([pa.array([n + len(held)], pa.int64())], ["n"])

    texts = df.select(*[df[c].cast("string") for c in df.columns])
    return sum(r["n"] for r in texts.mapInArrow(task, "n long").groupBy().sum("n").toDF("n").collect() if r["n"])
