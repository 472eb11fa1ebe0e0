"""Text files under names of their own.

Spark names its files itself; consumers of a results tree expect ``metrics.csv`` or
``gold.txt`` at a given place. This sink takes lines ``(path, ord, line)``, writes each path's
lines in order into a file beside its place, and moves the files to their names only when
all tasks have ended. A lost task writes its files again, a failed job leaves
the former files as they were, and a repeated job replaces them.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

LINES = "path string, ord long, line string"


@dataclass
class Written(WriterCommitMessage):
    """What a task has written: (present place, place it is meant for)."""

    files: list[tuple[str, str]]


class NamedFiles(DataSource):
    """The sink's entry for Spark, with the options ``path`` (the root folder), ``header`` and ``footer`` (a first and a
    last line for each file) and ``between`` (what stands between two lines, besides the line end)."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return LINES

    def writer(self, schema, overwrite: bool) -> NamedFileWriter:
        return NamedFileWriter(self.options["path"], self.options.get("header"), self.options.get("footer"), self.options.get("between", ""))


class NamedFileWriter(DataSourceArrowWriter):
    def __init__(self, root: str, header: str | None, footer: str | None, between: str):
        self.root, self.header, self.footer, self.between = root.rstrip("/"), header, footer, between

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """One task's lines, sorted by path and place; a file is open only while its lines come."""
        store, root = pa.fs.FileSystem.from_uri(self.root)
        files, sink, current = [], None, None
        for batch in iterator:
            for path, line in zip(batch.column("path").to_pylist(), batch.column("line").to_pylist()):
                if sink is None or path != current:
                    self._end(sink)
                    folder, name = _place(root, path)
                    store.create_dir(folder, recursive=True)
                    present = f"{folder}/_{name}.{uuid.uuid4().hex}"
                    sink, current = store.open_output_stream(present), path
                    files.append((present, f"{folder}/{name}"))
                    if self.header is not None:
                        sink.write(f"{self.header}\n".encode())
                else:
                    sink.write(f"{self.between}\n".encode())
                sink.write((line or "").encode())
        self._end(sink)
        return Written(files)

    def _end(self, sink) -> None:
        if sink is not None:
            sink.write(b"\n" if self.footer is None else f"\n{self.footer}\n".encode())
            sink.close()

    def commit(self, messages: list[Written | None]) -> None:
        store, _ = pa.fs.FileSystem.from_uri(self.root)
        for present, name in _files(messages):
            store.move(present, name)

    def abort(self, messages: list[Written | None]) -> None:
        store, _ = pa.fs.FileSystem.from_uri(self.root)
        for present, _ in _files(messages):
            store.delete_file(present)


def _files(messages: list[Written | None]) -> list[tuple[str, str]]:
    return [file for message in messages if message is not None for file in message.files]


def _place(root: str, path: str) -> tuple[str, str]:
    """Folder and name of a path below the root; a path that leads elsewhere is refused."""
    parts = (path or "").split("/")
    if not all(parts) or {".", ".."} & set(parts):
        raise ValueError(f"not a path below the root: {path!r}")
    return "/".join([root, *parts[:-1]]), parts[-1]


def write_named(lines: DataFrame, root: str, files: int = 0, **options: str) -> None:
    """Write lines ``(path, ord, line)`` to files below ``root``, which every executor has to reach.

    Options are ``header``, ``footer`` and ``between``. A file is written by one task, line by line, many files by
    many tasks; where the caller knows the number of ``files``, there are as many tasks at least. The driver gets
    their names, no lines.
    """
    spark = lines.sparkSession
    spark.dataSource.register(NamedFiles)
    tasks = max(files, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = lines.select("path", "ord", "line").repartition(tasks, "path").sortWithinPartitions("path", "ord")
    dealt.write.format("named_files").mode("append").options(**options).save(root)
