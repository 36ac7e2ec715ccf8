"""Samples as files: two images and a JSON document for each form, written by Spark's tasks and shown all at once.

Each task writes into a folder of its own below a hidden one; when all are done, the driver renames these folders, one for each
task. Of a task that ran twice only the one that Spark kept is shown; if the job fails, the hidden folder goes. Any file system
that Arrow knows will do.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

#: The columns that are written, and how a name goes on for each.
ENDINGS = {"p1": "_p1.png", "p2": "_p2.png", "document": ".json"}
SCHEMA = "name string, p1 binary, p2 binary, document string"


@dataclass
class _Written(WriterCommitMessage):
    folder: str
    rows: int


class _Writer(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool) -> None:
        self.uri, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def _at(self) -> tuple[FileSystem, str]:
        return FileSystem.from_uri(self.uri)

    def write(self, iterator: Iterator[Row]) -> _Written:
        system, path = self._at()
        folder, rows = f"{path}/_writing-{self.job}/{uuid.uuid4().hex}", 0
        system.create_dir(folder)
        for row in iterator:
            for column, ending in ENDINGS.items():
                content = row[column]
                if content is not None:  # a form may have one page
                    with system.open_output_stream(f"{folder}/{row['name']}{ending}") as out:
                        out.write(content.encode() if isinstance(content, str) else bytes(content))
            rows += 1
        return _Written(folder, rows)

    def commit(self, messages: list[_Written | None]) -> None:
        system, path = self._at()
        if self.overwrite:
            for old in system.get_file_info(FileSelector(path, allow_not_found=True)):
                if old.type == FileType.Directory and old.base_name.startswith("part-"):
                    system.delete_dir(old.path)
        for i, done in enumerate(m for m in messages if m is not None and m.rows):
            system.move(done.folder, f"{path}/part-{i:05d}-{self.job}")
        self._clear(system, path)

    def abort(self, messages: list[_Written | None]) -> None:
        self._clear(*self._at())

    def _clear(self, system: FileSystem, path: str) -> None:
        hidden = f"{path}/_writing-{self.job}"
        if system.get_file_info(hidden).type == FileType.Directory:
            system.delete_dir(hidden)


class SampleFiles(DataSource):
    """`df.write.format("sample_files").save(path)` for rows (name, p1, p2, document); overwriting replaces what it wrote before."""

    @classmethod
    def name(cls) -> str:
        return "sample_files"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        if sorted(schema.names) != sorted(["name", *ENDINGS]):
            raise ValueError(f"samples have the columns {SCHEMA}")
        path = self.options["path"]
        return _Writer(path if "://" in path or path.startswith("/") else path.replace("file:", "file://", 1), overwrite)


def write_sample_files(samples: DataFrame, path: str, *, mode: str = "overwrite") -> None:
    """Rows (name, p1, p2, document) as <name>_p1.png, <name>_p2.png and <name>.json in folders part-* below path.

    Names are taken as distinct. Nulls have no file. read_pages() and read_samples() read `path/part-*` back.
    """
    samples.sparkSession.dataSource.register(SampleFiles)
    samples.select("name", *ENDINGS).write.format("sample_files").mode(mode).save(path)
