"""A Spark data source of Arrow IPC files and streams; a task reads one file."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.feather
import pyarrow.fs
import pyarrow.ipc
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema

#: How framings begin: fixed values.
FILE_MAGIC, FEATHER_MAGIC = b"ARROW1", b"FEA1"


def _open(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pyarrow.fs.LocalFileSystem(), path)


def _files(path: str) -> list[str]:
    fs, inner = _open(path)
    info = fs.get_file_info(inner)
    if info.type != pyarrow.fs.FileType.Directory:
        return [path]
    prefix = path.removesuffix(inner)
    return [prefix + f.path for f in fs.get_file_info(pyarrow.fs.FileSelector(inner)) if f.is_file]


def batches(path: str) -> Iterator[pa.RecordBatch]:
    """The record batches of one file, whose framing its first bytes tell."""
    fs, inner = _open(path)
    with fs.open_input_file(inner) as source:
        magic = source.read(6)
        source.seek(0)
        if magic == FILE_MAGIC:
            reader = pyarrow.ipc.open_file(source)
            for i in range(reader.num_record_batches):
                yield reader.get_batch(i)
        elif magic.startswith(FEATHER_MAGIC):
            yield from pyarrow.feather.read_table(source).to_batches()
        else:
            yield from pyarrow.ipc.open_stream(source)


class ArrowIpcReader(DataSourceReader):
    def __init__(self, path: str):
        self._path = path

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(f) for f in _files(self._path)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        for batch in batches(partition.value):
            if batch.num_rows:
                yield batch


class ArrowIpcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "arrow_ipc"

    def schema(self):
        first = next(batches(_files(self.options["path"])[0]), None)
        return from_arrow_schema(first.schema if first is not None else pa.schema([]))

    def reader(self, schema) -> ArrowIpcReader:
        return ArrowIpcReader(self.options["path"])
