"""A sink that writes one text file for each row: df.write.format("text_files").mode("append").save(folder).

Rows have `file` (a name that is unique in the table) and `value`. Each task writes a folder of its own below a staging folder that
belongs to the write; what a task has written is named in its commit message, and the commit moves the folders of the tasks
that succeeded into place, one rename for each. Nothing of a failed or repeated task is seen. The folder is reached by its address
(file, hdfs, s3 and others that pyarrow knows), so tasks need no Spark there.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from lectern.operators.running import running
from lectern.sources import folders
from lectern.sources.files import decoded, safe_file_name, scan_files

NAME = "text_files"


def _system(path: str):
    """The file system of an address, and the path there."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    return fs.LocalFileSystem(), path


@dataclass
class Written(WriterCommitMessage):
    """A task's folder, and how many files are in it."""

    folder: str
    files: int


class TextFilesWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path.rstrip("/"), overwrite, uuid.uuid4().hex

    def write(self, rows: Iterator) -> Written:
        system, root = _system(self.path)
        name = uuid.uuid4().hex
        folder, n = f"{root}/_staging-{self.job}/{name}", 0
        system.create_dir(folder, recursive=True)
        for row in rows:
            with system.open_output_stream(f"{folder}/{row['file']}") as out:
                out.write((row["value"] or "").encode())
            n += 1
        return Written(name, n)

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        system, root = _system(self.path)
        if self.overwrite:
            for x in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
                if x.base_name.startswith("part-"):
                    system.delete_dir(x.path)
        for i, m in enumerate(m for m in messages if m and m.files):
            system.move(f"{root}/_staging-{self.job}/{m.folder}", f"{root}/part-{i:05d}-{self.job}")
        self.abort(messages)

    def abort(self, messages: list) -> None:
        from pyarrow import fs

        system, root = _system(self.path)
        staged = f"{root}/_staging-{self.job}"
        if system.get_file_info(staged).type != fs.FileType.NotFound:
            system.delete_dir(staged)


class TextFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "file string, value string"

    def writer(self, schema, overwrite: bool) -> TextFilesWriter:
        return TextFilesWriter(self.options["path"], overwrite)


def numbered_names(rows: DataFrame) -> DataFrame:
    """rows with `file` names made unique: of equal names (whatever their case) all but the first get _2, _3 and so on before the
    extension, in the order of `value`. One name may have most of the rows."""
    counted = running(rows.withColumn("_key", F.lower("file")), ["_key"], ["file", "value"], {}, number="_no")
    stem, end = F.regexp_extract("file", r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract("file", r"^(.*?)(\.[^.]*)?$", 2)
    return counted.withColumn("file", F.when(F.col("_no") == 1, F.col("file")).otherwise(F.concat(stem, F.lit("_"), F.col("_no").cast("string"), end))).select(*rows.columns)


def write_files(rows: DataFrame, path: str, overwrite: bool = False) -> None:
    """A text file for each row (file, value) in folders below path, one folder for each task."""
    rows.sparkSession.dataSource.register(TextFiles)
    rows.select("file", "value").write.format(NAME).mode("overwrite" if overwrite else "append").save(path)


def read_back(spark: SparkSession, path: str, few: int = folders.FEW) -> DataFrame:
    """file and value of what write_files wrote; of more files than `few` the driver holds no names."""
    table = folders.listed(spark, path)
    count = 0 if table is None else table.count()
    found = folders.read(table, count) if count > few else scan_files(spark, path)
    return found.select(F.regexp_extract("path", r"([^/]+)\z", 1).alias("file"), decoded(F.col("content"))["text"].alias("value"))


def file_name(name, at):
    """The name of a prepared text's file, from that of its source and a time."""
    return F.concat(safe_file_name(name), F.lit("_bereinigt_"), F.date_format(at, "yyyy-MM-dd'T'HH-mm-ss"), F.lit(".txt"))
