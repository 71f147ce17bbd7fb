"""JSON arrays written by many tasks.

A data source writer: each task streams its rows to files of its own in a staging folder beside
the target; what the driver gets of them is names and counts.  The commit takes the files of the
tasks that Spark names, in order of their partitions, so of a task that ran twice only one attempt
counts, and an abort removes the staging folder.  The target appears, or is replaced, only in the commit.

Two layouts: a folder of files that are an array each, of ``rowsPerFile`` rows at most, whose names keep
the order of the rows (no byte passes through the driver); or, with ``single``, one file with one array for
exchange, to which the commit copies the files block by block.

Nulls inside rows are written as nulls.  A table without rows gives an empty array.  Rows keep the
order of the DataFrame if it is sorted.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from chomeflow.sources.shared import qualified

ROWS_PER_FILE = 100_000
BLOCK = 8 << 20


@dataclass
class Written(WriterCommitMessage):
    """The files of one task, in order."""

    partition: int
    files: list[str]


class JsonArrayWriter(DataSourceArrowWriter):
    """Of one column of JSON texts."""

    def __init__(self, path: str, single: bool, rows_per_file: int, overwrite: bool):
        self.path, self.single, self.rows_per_file, self.overwrite = path, single, rows_per_file, overwrite
        self.run = uuid.uuid4().hex

    def _places(self) -> tuple[fs.FileSystem, str, str]:
        """The file system, the target and the staging folder in it."""
        system, target = fs.FileSystem.from_uri(self.path)
        return system, target.rstrip("/"), f"{target.rstrip('/')}.staging-{self.run}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, _, staging = self._places()
        task = TaskContext.get()
        start, end = (b"", b"") if self.single else (b"[\n", b"\n]\n")
        files: list[str] = []
        out, rows = None, 0
        system.create_dir(staging, recursive=True)
        try:
            for batch in iterator:
                for text in batch.column(0):
                    if out is not None and not self.single and rows == self.rows_per_file:
                        out.write(end)
                        out.close()
                        out = None
                    if out is None:
                        files.append(f"{task.partitionId():08d}-{len(files):06d}-{task.taskAttemptId()}")
                        out, rows = system.open_output_stream(f"{staging}/{files[-1]}"), 0
                    out.write((b",\n" if rows else start) + (text.as_py() or "null").encode())
                    rows += 1
            if out is not None:
                out.write(end)
        finally:
            if out is not None:
                out.close()
        return Written(task.partitionId(), files)

    def commit(self, messages: list[Written | None]) -> None:
        system, target, staging = self._places()
        files = [f for m in sorted((m for m in messages if m is not None), key=lambda m: m.partition) for f in m.files]
        system.create_dir(staging, recursive=True)
        if self.single:
            with system.open_output_stream(f"{staging}/whole") as out:
                out.write(b"[\n")
                for i, name in enumerate(files):
                    out.write(b",\n" if i else b"")
                    with system.open_input_stream(f"{staging}/{name}") as part:
                        while block := part.read(BLOCK):
                            out.write(block)
                out.write(b"\n]\n")
        elif not files:
            files = ["00000000-000000-none"]
            with system.open_output_stream(f"{staging}/{files[0]}") as out:
                out.write(b"[]\n")
        there = system.get_file_info(target)
        if there.type != fs.FileType.NotFound:
            if self.overwrite:
                (system.delete_dir if there.type == fs.FileType.Directory else system.delete_file)(target)
            elif self.single or there.type == fs.FileType.File:
                raise FileExistsError(target)
        if self.single:
            system.move(f"{staging}/whole", target)
        else:
            system.create_dir(target, recursive=True)
            for i, name in enumerate(files):
                system.move(f"{staging}/{name}", f"{target}/part-{i:08d}-{self.run}.json")
        system.delete_dir(staging)

    def abort(self, messages: list[Written | None]) -> None:
        system, _, staging = self._places()
        if system.get_file_info(staging).type != fs.FileType.NotFound:
            system.delete_dir(staging)


class JsonArraySource(DataSource):
    """Format ``json_array``; options ``path``, ``single`` and ``rowsPerFile``."""

    @classmethod
    def name(cls) -> str:
        return "json_array"

    def writer(self, schema, overwrite: bool) -> JsonArrayWriter:
        single = str(self.options.get("single", "false")).lower() == "true"
        return JsonArrayWriter(self.options["path"], single, int(self.options.get("rowsPerFile", ROWS_PER_FILE)), overwrite)


def write_json_array(df: DataFrame, path: str, single: bool = False, rows_per_file: int = ROWS_PER_FILE, mode: str = "overwrite") -> None:
    """The rows as JSON objects, in the order of the DataFrame, in the folder ``path`` or, with ``single``, in the file ``path``."""
    spark = df.sparkSession
    spark.dataSource.register(JsonArraySource)
    rows = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
    rows.write.format("json_array").options(path=qualified(spark, path), single=str(single).lower(), rowsPerFile=str(rows_per_file)).mode(mode).save()
