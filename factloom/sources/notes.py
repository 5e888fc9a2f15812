"""The data source "notes": a folder of Markdown files as a table, read in packs of files by the executors.

Files with a Markdown suffix in any case are taken, also those whose names begin with a dot or an underscore;
directories of tools, those whose names begin with a dot and links to directories are not entered. Options: path,
max_bytes (files beyond it come without text and marked skipped), pack_bytes (size of a partition).
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from factloom.session import spread

# Fixed values.
SUFFIXES = (".md", ".markdown")
SKIPPED_DIRS = frozenset({"node_modules", "venv", "__pycache__"})
MAX_BYTES = 20 * 1024 * 1024
SCHEMA = "path string, text string, mtime double, size bigint, sha1 string, skipped boolean"


def scan(root: str | os.PathLike) -> list[tuple[str, int]]:
    """(absolute path, size) of all note files below a folder, in order of path."""
    found = []
    for folder, dirs, files in os.walk(root):
        dirs[:] = [d for d in dirs if not d.startswith(".") and d not in SKIPPED_DIRS]
        for name in files:
            if os.path.splitext(name.lower())[1] in SUFFIXES or name.lower() in SUFFIXES:
                full = os.path.join(folder, name)
                if os.path.isfile(full):
                    found.append((full, os.path.getsize(full)))
    return sorted(found)


def read_file(root: str, name: str, max_bytes: int) -> tuple:
    """A row of the source."""
    path = os.path.join(root, name)
    stat = os.stat(path)
    if stat.st_size > max_bytes:
        return (name, None, stat.st_mtime, stat.st_size, None, True)
    with open(path, "rb") as f:
        data = f.read()
    return (name, data.decode("utf-8", "replace"), stat.st_mtime, len(data), hashlib.sha1(data, usedforsecurity=False).hexdigest(), False)


class Pack(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class NotesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = str(options["path"])
        self.max_bytes = int(options.get("max_bytes", MAX_BYTES))
        self.pack_bytes = int(options.get("pack_bytes", 8 << 20))

    def partitions(self) -> list[InputPartition]:
        packs, now, held = [], [], 0
        for path, size in scan(self.root):
            if now and held + size > self.pack_bytes:
                packs.append(Pack(now))
                now, held = [], 0
            now.append(path)
            held += size
        return packs + [Pack(now)]

    def read(self, partition: Pack) -> Iterator[tuple]:
        for path in partition.paths:
            yield read_file(self.root, Path(path).relative_to(self.root).as_posix(), self.max_bytes)


class NotesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "notes"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return NotesReader(self.options)


def read_notes(spark: SparkSession, root: str | os.PathLike, **options) -> DataFrame:
    spark.dataSource.register(NotesSource)
    return spark.read.format("notes").options(path=str(root), **options).load()


def list_notes(spark: SparkSession, root: str | os.PathLike) -> DataFrame:
    """(path, mtime, size) of all note files, none of them read."""
    rows = [(Path(p).relative_to(root).as_posix(), os.stat(p).st_mtime, size) for p, size in scan(root)]
    return spark.createDataFrame(rows, "path string, mtime double, size bigint")


def read_some(files: DataFrame, root: str | os.PathLike, max_bytes: int = MAX_BYTES) -> DataFrame:
    """The rows of the source for the files named in a column path."""
    top = str(root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "text", "mtime", "size", "sha1", "skipped"]
        kinds = [pa.string(), pa.string(), pa.float64(), pa.int64(), pa.string(), pa.bool_()]
        for batch in batches:
            for name in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(read_file(top, name, max_bytes), kinds)], names)

    return spread(files.select("path"), "path").mapInArrow(run, SCHEMA)


def from_texts(spark: SparkSession, texts: dict[str, str], mtimes: dict[str, float] | None = None) -> DataFrame:
    """Notes held in memory; times default to 0, which means undated."""
    rows = [(p, t, float((mtimes or {}).get(p, 0.0)), len(t.encode()), hashlib.sha1(t.encode(), usedforsecurity=False).hexdigest(), False) for p, t in sorted(texts.items())]
    return spark.createDataFrame(rows, SCHEMA)
