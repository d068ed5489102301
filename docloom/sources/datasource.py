"""Folders of documents as a data source: ``spark.read.format("docloom")`` and ``df.write.format("docloom")``.

Reading plans by size: a partition holds files of about ``partition_bytes``, one at least, so that many small files
share a task and a large one has its own. Filters on ``path``, ``name`` and ``length`` are decided while planning, before
any file is opened, and contents are read only where the schema has a column for them. Files are reached by
pyarrow's file systems, which know local and shared folders, HDFS and object stores by their URI.

Writing takes ``name`` and ``content``: each task writes below a folder of its own attempt, and the commit of the job
moves what the attempts that Spark accepted have written. A failed or repeated attempt leaves nothing that a reader sees;
a task that outlives the abort of its job may leave a folder ``_attempts-*``.
"""

from __future__ import annotations

import fnmatch
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "path string, name string, length long, content binary"
PARTITION_BYTES = 64 << 20

_TESTS = {
    EqualTo: lambda v, f: v == f.value,
    In: lambda v, f: v in f.value,
    GreaterThan: lambda v, f: v > f.value,
    GreaterThanOrEqual: lambda v, f: v >= f.value,
    LessThan: lambda v, f: v < f.value,
    LessThanOrEqual: lambda v, f: v <= f.value,
    StringStartsWith: lambda v, f: v.startswith(f.value),
    StringEndsWith: lambda v, f: v.endswith(f.value),
    StringContains: lambda v, f: f.value in v,
}


def _at(uri: str) -> tuple[fs.FileSystem, str]:
    return (fs.LocalFileSystem(), os.path.abspath(uri)) if "://" not in uri and not uri.startswith("file:") else fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1))


@dataclass
class Files(InputPartition):
    """Paths and lengths of the files of a task."""

    files: tuple[tuple[str, int], ...]


def planned(files: list[tuple[str, int]], partition_bytes: int) -> list[Files]:
    """Files in order of their paths, cut where a partition would grow beyond its bytes."""
    out: list[Files] = []
    held, size = [], 0
    for path, n in sorted(files):
        if held and size + n > partition_bytes:
            out.append(Files(tuple(held)))
            held, size = [], 0
        held.append((path, n))
        size += n
    return [*out, Files(tuple(held))] if held else out


class FolderReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.uri, self.pattern = options["path"], options.get("pattern", "*")
        self.partition_bytes = int(options.get("partitionbytes", options.get("partition_bytes", PARTITION_BYTES)))
        self.columns = [(f.name, f.dataType.simpleString()) for f in schema.fields]
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Keeps those on what a listing tells; the others go back to Spark."""
        for f in filters:
            if type(f) in _TESTS and f.attribute in (("path",), ("name",), ("length",)) and f.value is not None:
                self.filters.append(f)
            else:
                yield f

    def _holds(self, path: str, length: int) -> bool:
        row = {"path": path, "name": path.rsplit("/", 1)[-1], "length": length}
        return all(_TESTS[type(f)](row[f.attribute[0]], f) for f in self.filters)

    def partitions(self) -> list[Files]:
        store, root = _at(self.uri)
        found = store.get_file_info(fs.FileSelector(root, recursive=True))
        files = [(i.path, i.size) for i in found if i.is_file and fnmatch.fnmatch(i.base_name, self.pattern) and not i.base_name.startswith((".", "_")) and "/_attempts-" not in i.path]
        return planned([f for f in files if self._holds(*f)], self.partition_bytes) or [Files(())]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = _at(self.uri)
        types = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}
        for path, length in partition.files:
            row = {"path": path, "name": path.rsplit("/", 1)[-1], "length": length}
            if any(c == "content" for c, _ in self.columns):
                with store.open_input_file(path) as f:
                    row["content"] = f.read()
            yield pa.RecordBatch.from_arrays([pa.array([row[c]], types[t]) for c, t in self.columns], [c for c, _ in self.columns])


@dataclass
class Written(WriterCommitMessage):
    folder: str
    names: tuple[str, ...]


class FolderWriter(DataSourceWriter):
    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        self.uri, self.overwrite, self.job = options["path"], overwrite, uuid.uuid4().hex
        self.place = [f.name for f in schema.fields].index("name"), [f.name for f in schema.fields].index("content")

    def write(self, rows: Iterator) -> Written:
        store, root = _at(self.uri)
        folder = f"{root}/_attempts-{self.job}/{uuid.uuid4().hex}"
        store.create_dir(folder, recursive=True)
        names = []
        for row in rows:
            name, content = row[self.place[0]], row[self.place[1]]
            if not name or "/" in name or name.startswith((".", "_")):
                raise ValueError(f"not a file name: {name!r}")
            with store.open_output_stream(f"{folder}/{name}") as f:
                f.write(bytes(content or b""))
            names.append(name)
        if len(set(names)) < len(names):
            raise ValueError("two rows have one name")
        return Written(folder, tuple(names))

    def commit(self, messages: list[Written | None]) -> None:
        store, root = _at(self.uri)
        taken: set[str] = set()
        done = [m for m in messages if m is not None]
        for m in done:
            if again := taken & set(m.names):
                self.abort(messages)
                raise ValueError(f"two rows have one name: {min(again)}")
            taken |= set(m.names)
        if self.overwrite:
            old = [i.path for i in store.get_file_info(fs.FileSelector(root)) if i.is_file]
            for path in old:
                store.delete_file(path)
        for m in done:
            for name in m.names:
                store.move(f"{m.folder}/{name}", f"{root}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        store, root = _at(self.uri)
        at = f"{root}/_attempts-{self.job}"
        if store.get_file_info(at).type == fs.FileType.Directory:
            store.delete_dir(at)


class Folder(DataSource):
    """``path`` (a folder's URI), ``pattern`` of names, ``partition_bytes``. The schema may be any of the columns of SCHEMA."""

    @classmethod
    def name(cls) -> str:
        return "docloom"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> FolderReader:
        return FolderReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> FolderWriter:
        return FolderWriter(self.options, schema, overwrite)


def register(spark) -> None:
    """Makes the format known to a session, with filters pushed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Folder)
