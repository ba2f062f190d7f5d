"""Image files written by the tasks that hold them, in two steps.

A task writes its files below a folder of its own attempt and reports only that folder. When all
tasks are through, the files of the attempts that count are moved to their places, a rename each; files of attempts
that failed, or that ran twice, are never seen there. An aborted job leaves nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

FORMAT = "orrery_images"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    """The folder of one attempt."""

    folder: str


class ImageWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path.rstrip("/"), overwrite
        self.staged = f"{self.path}/_staged-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> Written:
        store, root = opened(self.staged)
        task = TaskContext.get()
        folder = f"{root}/{task.partitionId()}-{task.taskAttemptId()}"
        store.create_dir(folder, recursive=True)
        for row in iterator:
            name = row["name"]
            if not name or "/" in name or name.startswith(("_", ".")):
                raise ValueError(f"not a file name: {name!r}")
            with store.open_output_stream(f"{folder}/{name}") as out:
                out.write(row["content"])
        return Written(folder)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = opened(self.path)
        store.create_dir(root, recursive=True)
        if self.overwrite:
            for old in store.get_file_info(fs.FileSelector(root)):
                if old.type == fs.FileType.File:
                    store.delete_file(old.path)
        for message in messages:
            for file in store.get_file_info(fs.FileSelector(message.folder)) if message else ():
                store.move(file.path, f"{root}/{file.base_name}")
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        store, root = opened(self.staged)
        if store.get_file_info(root).type != fs.FileType.NotFound:
            store.delete_dir(root)


class ImageSink(DataSource):
    """``df.write.format(FORMAT).mode(...).save(path)`` for rows (name, content): a file for each row."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema, overwrite: bool) -> ImageWriter:
        return ImageWriter(self.options["path"], overwrite)


def save(files: DataFrame, path: str, mode: str = "append") -> None:
    """Write (name, content) rows as files of the folder ``path``, which all executors must reach.

    ``append`` replaces files of equal names and leaves others; ``overwrite`` removes the folder's other files
    too, once all new ones are written. A null content is an empty file; of rows with one name one stays.
    """
    from pyspark.sql import functions as F

    register(files.sparkSession)
    rows = files.select(F.col("name").cast("string").alias("name"), F.coalesce("content", F.lit(b"")).alias("content"))
    rows.write.format(FORMAT).mode(mode).save(path)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ImageSink)
