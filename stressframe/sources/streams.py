"""Files of bytes written by tasks: rows of one file in their order, one behind the other."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as stores
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from .binary import store

ROWS = "file string, data binary"


@dataclass
class Written(WriterCommitMessage):
    """Temporary names of the files that a task has written, by their names."""

    names: dict[str, str]


class OrderedWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.folder, self.temporary = options["path"].rstrip("/"), f"_temporary-{options['job']}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, root = store(self.folder)
        files.create_dir(f"{root}/{self.temporary}", recursive=True)
        out, current, names = None, None, {}
        for batch in iterator:
            for name, data in zip(batch.column("file").to_pylist(), batch.column("data").to_pylist(), strict=True):
                if name != current:
                    if out is not None:
                        out.close()
                    if name in names:
                        raise ValueError(f"rows of {name} are not together")
                    current, names[name] = name, uuid.uuid4().hex
                    out = files.open_output_stream(f"{root}/{self.temporary}/{names[name]}", compression=None)
                out.write(data)
        if out is not None:
            out.close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        files, root = store(self.folder)
        for message in messages:
            for name, held in (message.names if message else {}).items():
                files.move(f"{root}/{self.temporary}/{held}", f"{root}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        files, root = store(self.folder)
        if files.get_file_info(f"{root}/{self.temporary}").type == stores.FileType.Directory:
            files.delete_dir(f"{root}/{self.temporary}")


class OrderedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ordered_files"

    def schema(self) -> str:
        return ROWS

    def writer(self, schema, overwrite: bool) -> OrderedWriter:
        return OrderedWriter(self.options)


def write(rows: DataFrame, folder: str) -> None:
    """Write ``rows`` (file, data), in which the rows of a file stand together in one partition and in order."""
    rows.sparkSession.dataSource.register(OrderedFiles)
    rows.select("file", "data").write.format("ordered_files").options(path=folder, job=uuid.uuid4().hex).mode("append").save()
