"""Folders of markdown files as a Spark data source: read a file as a row, write a row as a file.

Files are listed once and read and written in tasks, by pyarrow's file systems (local paths, and URIs of
the stores that it knows).  Names may have spaces, percent signs and letters of any script.

    spark.dataSource.register(MarkdownNotes)
    spark.read.format("markdown_notes").load(folder)
    df.write.format("markdown_notes").mode("append").save(folder)

Reading gives (file_name, stem, content, mtime), empty files too, in partitions of at most FILES files.
A read that the system asks to repeat (EAGAIN) is tried again.

Writing takes (stem, content): each file is written under a hidden name and then moved to its own, so that
a file is there whole or not at all, and a task that runs again replaces its files by equal ones.  Stems
that occur twice, or are no file names, are an error before anything is written.
"""

from __future__ import annotations

import errno
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Files of a partition, and tries for a read.
FILES, TRIES, DELAY = 512, 3, 0.5
SUFFIX = ".md"


def _opened(folder: str):
    """(file system, path) of a folder."""
    import os

    from pyarrow import fs

    if "://" in folder or folder.startswith("file:"):
        return fs.FileSystem.from_uri(folder)
    return fs.LocalFileSystem(), os.path.abspath(folder)


def read_retrying(read, tries: int = TRIES, delay: float = DELAY):
    """What read gives; where the system says to try again it is called up to tries times, after longer and longer pauses."""
    for attempt in range(1, tries + 1):
        try:
            return read()
        except OSError as e:
            if e.errno != errno.EAGAIN or attempt == tries:
                raise
            time.sleep(delay * attempt)


@dataclass
class Files(InputPartition):
    names: list[str]


class _Reader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        system, path = _opened(self.folder)
        found = system.get_file_info(fs.FileSelector(path))
        names = sorted(f.base_name for f in found if f.is_file and f.base_name.endswith(SUFFIX) and not f.base_name.startswith("."))
        return [Files(names[i : i + FILES]) for i in range(0, len(names), FILES)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        system, path = _opened(self.folder)

        def content(name: str) -> str:
            with system.open_input_stream(f"{path}/{name}") as f:
                return f.read().decode("utf-8")

        for name in partition.names:
            text = read_retrying(lambda name=name: content(name))
            yield name, name[: -len(SUFFIX)], text, system.get_file_info(f"{path}/{name}").mtime


@dataclass
class Written(WriterCommitMessage):
    n: int


class _Writer(DataSourceWriter):
    def __init__(self, folder: str, schema: StructType):
        self.folder, self.at = folder, [schema.names.index(c) for c in ("stem", "content")]

    def write(self, rows: Iterator) -> Written:
        system, path = _opened(self.folder)
        system.create_dir(path)
        stem, content = self.at
        n = 0
        for row in rows:
            hidden = f"{path}/.{uuid.uuid4().hex}.part"
            with system.open_output_stream(hidden) as f:
                f.write((row[content] or "").encode("utf-8"))
            system.move(hidden, f"{path}/{row[stem]}{SUFFIX}")
            n += 1
        return Written(n)


class MarkdownNotes(DataSource):
    """The folder in option ``path``; see the module."""

    @classmethod
    def name(cls) -> str:
        return "markdown_notes"

    def schema(self) -> str:
        return "file_name string, stem string, content string, mtime timestamp"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], schema)


def read_notes(spark: SparkSession, folder: str) -> DataFrame:
    """(file_name, stem, content, mtime) of the markdown files of one folder."""
    spark.dataSource.register(MarkdownNotes)
    return spark.read.format("markdown_notes").load(folder)


def write_notes(df: DataFrame, folder: str) -> None:
    """A file for each row (stem, content); files of other names stay."""
    odd = df.where(F.col("stem").isNull() | (F.col("stem") == "") | F.col("stem").rlike(r"^\.|[/\x00]")).select("stem").first()
    if odd is not None:
        raise ValueError(f"no file name: {odd['stem']!r}")
    twice = df.groupBy("stem").count().where("count > 1").select("stem").first()
    if twice is not None:
        raise ValueError(f"two rows for one file: {twice['stem']}")
    df.sparkSession.dataSource.register(MarkdownNotes)
    df.select("stem", "content").write.format("markdown_notes").mode("append").save(folder)


def delete_notes(df: DataFrame, folder: str) -> None:
    """Removes the files of rows (stem), in tasks; files that are gone already are no error."""

    def remove(rows: Iterator) -> None:
        system, path = _opened(folder)
        for row in rows:
            try:
                system.delete_file(f"{path}/{row['stem']}{SUFFIX}")
            except FileNotFoundError:
                pass

    df.select("stem").foreachPartition(remove)
