"""Files as a data source to write to: folders are replaced whole, when all tasks have ended well.

    spark.dataSource.register(FileSink)
    files.write.format("gazetta_files").option("staging", path).mode("append").save()    # folder, name (below the folder), content
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


def place(path: str) -> tuple:
    """Arrow's file system of a path, and the path in it."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("/") else (fs.LocalFileSystem(), path)


@dataclass
class Staged(WriterCommitMessage):
    """The folders that a task has written: where they go and where they are staged."""

    folders: list[tuple[str, str]]


class FileWriter(DataSourceWriter):
    """Each task stages the folders it meets, under one folder or beside their places; all rows of a folder must be in one partition."""

    def __init__(self, staging: str | None = None) -> None:
        self.staging, self.run = staging and staging.rstrip("/"), uuid.uuid4().hex

    def top(self, folder: str) -> str:
        return f"{self.staging or folder.rpartition('/')[0]}/.staged-{self.run}"

    def write(self, rows: Iterator) -> Staged:
        context = TaskContext.get()
        attempt = f"{context.partitionId()}-{context.taskAttemptId()}"
        seen: dict[str, str] = {}
        for row in rows:
            at = seen.setdefault(row.folder, f"{self.top(row.folder)}/{attempt}/{len(seen)}")
            where, path = place(f"{at}/{row.name}")
            where.create_dir(path.rpartition("/")[0], recursive=True)
            with where.open_output_stream(path) as out:
                out.write(bytes(row.content))
        return Staged(sorted(seen.items()))

    def commit(self, messages: list[Staged | None]) -> None:
        """Puts staged folders in place of the old ones, one rename each; what an attempt that was lost has staged goes too."""
        folders = [x for m in messages if m is not None for x in m.folders]
        if len({f for f, _ in folders}) != len(folders):
            raise ValueError("files of one folder were dealt to several tasks")
        for folder, staged in folders:
            where, path = place(folder)
            if where.get_file_info(path).type.name == "Directory":
                where.delete_dir(path)
            where.create_dir(path.rpartition("/")[0], recursive=True)
            where.move(place(staged)[1], path)
        self._swept(folders)

    def abort(self, messages: list[Staged | None]) -> None:
        self._swept([x for m in messages if m is not None for x in m.folders])

    def _swept(self, folders: list[tuple[str, str]]) -> None:
        for top in {self.top(f) for f, _ in folders} | ({self.top("")} if self.staging else set()):
            where, path = place(top)
            if where.get_file_info(path).type.name == "Directory":
                where.delete_dir(path)


class FileSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gazetta_files"

    def schema(self) -> str:
        return "folder string, name string, content binary"

    def writer(self, schema, overwrite: bool) -> FileWriter:
        return FileWriter(self.options.get("staging"))
