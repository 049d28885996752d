"""Folders of any number of files, listed and read by tasks.

Spark's own file source holds the name of every file in the driver, once for each scan, and reads some thirty small files a task. Here a
task lists a folder, a level of folders at a time, and the names go to a table; other tasks open the files. The driver holds counts.
Names that Spark's source passes over (with a first `_` or `.`) and empty files are passed over here too.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.session import stored

#: Files that the driver may list.
FEW = 2_000
#: Files of a task.
FILES = 2_000
#: Rows and bytes that a task holds before it passes them on; one large file is held alone.
ROWS, BYTES = 1_000, 8 << 20

LISTED = pa.schema([("path", pa.string()), ("modificationTime", pa.timestamp("us", "UTC")), ("length", pa.int64()), ("is_folder", pa.bool_())])
READ = pa.schema([("path", pa.string()), ("modificationTime", pa.timestamp("us", "UTC")), ("length", pa.int64()), ("content", pa.binary())])


def located(address: str):
    """The file system of an address, and the path there."""
    from pyarrow import fs

    if address.startswith("file:") or "://" not in address:
        return fs.LocalFileSystem(), "/" + address.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(address)


def _hidden(name: str) -> bool:
    return (name.startswith("_") and "=" not in name) or name.startswith(".") or name.endswith("._COPYING_")


def _children(address: str) -> Iterator[tuple[str, int, int, bool]]:
    """Name, modification time in microseconds, length, and whether it is a folder."""
    from pyarrow import fs

    system, root = located(address)
    if isinstance(system, fs.LocalFileSystem):
        with os.scandir(root) as found:
            for x in found:
                s = x.stat()
                yield x.name, s.st_mtime_ns // 1000, s.st_size, x.is_dir()
    else:
        for x in system.get_file_info(fs.FileSelector(root)):
            yield x.base_name, (x.mtime_ns or 0) // 1000, x.size or 0, x.type == fs.FileType.Directory


def _list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), LISTED.types, strict=True)], schema=LISTED)

    for b in batches:
        for address in b.column("path").to_pylist():
            rows = []
            for name, at, length, is_folder in _children(address):
                if not _hidden(name) and (is_folder or length > 0):
                    rows.append((f"{address.rstrip('/')}/{name}", at, length, is_folder))
                if len(rows) >= 10 * ROWS:
                    yield out(rows)
                    rows = []
            if rows:
                yield out(rows)


def listed(spark: SparkSession, path: str) -> DataFrame | None:
    """path, modificationTime and length of all files below a folder, as a table; None where path is no folder, or in a store that tasks
    don't reach, which Spark's source has to list."""
    from pyarrow import ArrowException

    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(at) or not system.getFileStatus(at).isDirectory():
        return None
    root = system.makeQualified(at).toString()
    try:
        located(root)
    except (ArrowException, OSError):
        return None
    schema = "path string, modificationTime timestamp, length bigint, is_folder boolean"
    folders, out, many = spark.createDataFrame([(root,)], "path string"), None, 1
    while many:
        level = stored(folders.repartition(many).mapInArrow(_list, schema), "listed")
        files = level.where("not is_folder").drop("is_folder")
        out = files if out is None else out.unionByName(files)
        folders = level.where("is_folder").select("path")
        many = min(folders.count(), 1024)
    return out


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, system, base, held, size = None, None, "", [], 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), READ.types, strict=True)], schema=READ)

    for b in batches:
        for path, at, length in zip(*(b.column(c).to_pylist() for c in ("path", "modificationTime", "length")), strict=True):
            folder, _, name = path.rpartition("/")
            if folder != last:
                last, (system, base) = folder, located(folder)
            with system.open_input_stream(f"{base}/{name}") as f:
                content = f.read()
            held.append((path, at, length, content))
            size += len(content)
            if size >= BYTES or len(held) >= ROWS:
                yield out()
                held, size = [], 0
    if held:
        yield out()


def read(files: DataFrame, count: int) -> DataFrame:
    """path, modificationTime, length and content of listed files, of which there are `count`, some thousand a task."""
    spark = files.sparkSession
    tasks = max(min(count, spark.sparkContext.defaultParallelism), -(-count // FILES), 1)
    rows = files.select("path", "modificationTime", "length").repartition(tasks)
    return rows.mapInArrow(_read, "path string, modificationTime timestamp, length bigint, content binary")
