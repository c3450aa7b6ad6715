"""Data of any supported form as a DataFrame."""

from __future__ import annotations

import time
from collections.abc import Iterable, Iterator
from functools import reduce
from pathlib import Path
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.errors import PlumblineError, UnsupportedDataError
from plumbline.plans.kinds import unique_names
from plumbline.shared import new_path
from plumbline.sources.arrow_ipc import ArrowIpcSource

ARROW, EXCEL = (".arrow", ".feather", ".ipc"), (".xlsx", ".xlsm", ".xlsb", ".xls", ".ods")


def session() -> SparkSession:
    """The running session, or one on this machine."""
    return SparkSession.getActiveSession() or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    return bool(hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(hadoop))


def read_path(path: str, spark: SparkSession | None = None) -> DataFrame:
    """A file or folder, by its suffix: Parquet, ORC, CSV, JSON, JSON lines, Arrow IPC or a workbook's first sheet."""
    spark = spark or session()
    if not _exists(spark, path):
        raise PlumblineError(f"{path} doesn't exist")
    suffix = Path(path.rstrip("/")).suffix.lower()
    if suffix == ".parquet":
        return spark.read.parquet(path)
    if suffix == ".orc":
        return spark.read.orc(path)
    if suffix == ".csv":
        return spark.read.csv(path, header=True, inferSchema=True)
    if suffix == ".json":
        return spark.read.json(path, multiLine=True)
    if suffix in (".jsonl", ".ndjson"):
        return spark.read.json(path)
    if suffix in ARROW:
        spark.dataSource.register(ArrowIpcSource)
        return spark.read.format("arrow_ipc").load(path)
    if suffix in EXCEL:
        import pandas as pd

        try:
            return from_pandas(pd.read_excel(path), spark)
        except ImportError as e:
            raise PlumblineError(f"{path} is a workbook, and no library that reads it is installed: {e}") from e
    raise UnsupportedDataError(f"no reader for {suffix or path!r}; there are .parquet, .orc, .csv, .json, .jsonl, {', '.join(ARROW + EXCEL)}")


def from_pandas(frame: Any, spark: SparkSession | None = None) -> DataFrame:
    """A pandas frame; repeated column names get suffixes, and durations are seconds."""
    frame = _named(frame)
    return from_arrow(pa.Table.from_pandas(_plain(frame), preserve_index=False), spark, rows=len(frame))


def _named(frame: Any) -> Any:
    frame = frame.copy(deep=False)
    frame.columns = unique_names([str(c) for c in frame.columns])
    for c in frame.columns:
        if frame[c].dtype.kind == "m":
            frame[c] = frame[c].dt.total_seconds()
    return frame


def _plain(frame: Any) -> Any:
    """Columns of mixed objects as text, which Arrow would refuse."""
    for c in frame.columns:
        if frame[c].dtype == object:
            try:
                pa.array(frame[c], from_pandas=True)
            except (pa.ArrowInvalid, pa.ArrowTypeError):
                frame[c] = frame[c].map(lambda v: None if v is None or v != v else str(v))
    return frame


def from_arrow(table: pa.Table, spark: SparkSession | None = None, rows: int | None = None) -> DataFrame:
    spark = spark or session()
    if not table.num_columns:
        return spark.range(rows or table.num_rows).select()
    table = table.rename_columns(unique_names(table.column_names))
    columns = []
    for c in table.columns:
        if pa.types.is_null(c.type):
            c = c.cast(pa.string())
        elif pa.types.is_dictionary(c.type):
            c = c.cast(c.type.value_type)
        elif pa.types.is_unsigned_integer(c.type):
            c = c.cast(pa.int64() if c.type.bit_width < 64 else pa.float64())
        elif pa.types.is_time(c.type):
            c = pa.chunked_array([pa.array([None if v is None else v.hour * 3600 + v.minute * 60 + v.second + v.microsecond / 1e6 for v in c.to_pylist()], pa.float64())])
        elif pa.types.is_duration(c.type):
            per = {"s": 1, "ms": 1e3, "us": 1e6, "ns": 1e9}[c.type.unit]
            c = pa.compute.divide(c.cast(pa.int64()).cast(pa.float64()), per)
        elif pa.types.is_timestamp(c.type) and c.type.unit == "ns":
            c = c.cast(pa.timestamp("us", c.type.tz), safe=False)
        columns.append(c)
    return spark.createDataFrame(pa.table(dict(zip(table.column_names, columns, strict=True))))


#: Bytes of Arrow data that the driver holds of a source that is read piece by piece.
HELD = 64 << 20


def from_batches(batches: Iterable[pa.RecordBatch | pa.Table], spark: SparkSession | None = None, schema: pa.Schema | None = None) -> DataFrame:
    """The rows of Arrow batches, of which the driver holds HELD bytes or one batch at a time: they go to the shared folder as Parquet, in order, and are read from there.

    A source that fits into HELD isn't written. Columns that a piece lacks, or has without a
    type, are null there; numbers take the wider of their types.
    """
    spark = spark or session()
    held: list[pa.Table] = []
    names: dict[str, None] = {}
    folders: dict[str, str] = {}  # of pieces of one schema
    size, path, n = 0, None, 0

    def flush() -> None:
        nonlocal path, held, size, n
        path = path or new_path(spark, "source")
        table = pa.concat_tables(held, promote_options="permissive")
        names.update(dict.fromkeys(table.column_names))
        typed = table.select([f.name for f in table.schema if not pa.types.is_null(f.type)])
        frame = from_arrow(typed, spark, rows=table.num_rows)
        folder = folders.setdefault(frame.schema.simpleString(), f"{path}/schema-{len(folders)}")
        frame.coalesce(1).write.mode("append").parquet(f"{folder}/piece-{n:08d}")
        held, size, n = [], 0, n + 1

    for batch in batches:
        table = batch if isinstance(batch, pa.Table) else pa.Table.from_batches([batch])
        held.append(table)
        size += table.nbytes
        if size >= HELD:
            flush()
    if path is None:
        if not held and schema is None:
            raise UnsupportedDataError("a source without a piece has no columns")
        whole = pa.concat_tables(held, promote_options="permissive") if held else schema.empty_table()
        return from_arrow(whole, spark, rows=sum(t.num_rows for t in held))
    if held:
        flush()
    parts = [spark.read.option("recursiveFileLookup", "true").parquet(folder) for folder in folders.values()]
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    empty = [F.lit(None).cast("string").alias(c) for c in names if c not in whole.columns]
    return whole.select("*", *empty).select(*[F.col(f"`{c}`") for c in names])


def _pieces(data: Iterable[Any]) -> Iterator[pa.Table]:
    """Frames of an iterable as Arrow tables, one at a time."""
    for part in data:
        if isinstance(part, (str, int, float)):
            continue
        module = type(part).__module__.split(".")[0]
        if module == "pandas":
            yield pa.Table.from_pandas(_plain(_named(part)), preserve_index=False)
        elif module == "polars":
            yield (part.collect() if hasattr(part, "collect") else part).to_arrow()
        elif isinstance(part, pa.RecordBatch):
            yield pa.Table.from_batches([part])
        elif isinstance(part, pa.Table):
            yield part
        else:
            raise UnsupportedDataError(f"no reader for a piece that is a {type(part).__name__}")


def read(data: Any, spark: SparkSession | None = None) -> DataFrame:
    """Any supported data: a DataFrame, a path, a pandas or polars frame, an Arrow table, reader, dataset or stream, a DuckDB relation, or an iterable of frames."""
    if data is None:
        raise ValueError("there is no data")
    if isinstance(data, DataFrame) or type(data).__module__.startswith("pyspark.sql") and hasattr(data, "schema"):
        names = unique_names(data.columns)
        return data if names == data.columns else data.toDF(*names)
    if isinstance(data, (str, Path)):
        return read_path(str(data), spark)
    module = type(data).__module__.split(".")[0]
    if module == "pandas" and hasattr(data, "columns"):
        return from_pandas(data, spark)
    if module == "polars":
        if hasattr(data, "collect_batches"):
            return from_batches((b.to_arrow() for b in data.collect_batches()), spark)
        frame = data.collect() if hasattr(data, "collect") else data
        return from_arrow(frame.to_arrow(), spark, rows=frame.height)
    if isinstance(data, pa.Table):
        return from_arrow(data, spark)
    if isinstance(data, pa.RecordBatch):
        return from_arrow(pa.Table.from_batches([data]), spark)
    if isinstance(data, pa.RecordBatchReader):
        return from_batches(data, spark, data.schema)
    for method in ("to_arrow_reader", "fetch_record_batch", "fetch_arrow_table"):
        if hasattr(data, method):
            found = getattr(data, method)()
            return from_arrow(found, spark) if isinstance(found, pa.Table) else from_batches(found, spark, found.schema)
    if module == "pyarrow" and hasattr(data, "to_batches"):
        return from_batches(data.to_batches(), spark, data.schema)
    if hasattr(data, "__arrow_c_stream__"):
        reader = pa.RecordBatchReader.from_stream(data)
        return from_batches(reader, spark, reader.schema)
    if isinstance(data, (Iterator, Iterable)) and not isinstance(data, (dict, bytes)):
        if isinstance(data, (list, tuple)) and data and all(isinstance(part, DataFrame) for part in data):
            return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), data)
        return from_batches(_pieces(data), spark)
    raise UnsupportedDataError(f"no reader for {type(data).__name__}")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema) as stream:
            stream.write_batch(batch)
        yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["piece"])


def chunks(data: Any, chunk_size: int | None = None, spark: SparkSession | None = None) -> Iterator[pa.Table]:
    """The rows of any data in tables of ``chunk_size`` rows, the last of fewer; None leaves the pieces as executors make them.

    Rows travel as Arrow batches, a partition at a time; no row becomes a Python object, and
    the driver holds a chunk and a partition. Data without rows or columns give no table.
    """
    if chunk_size is not None and chunk_size < 1:
        raise UnsupportedDataError(f"chunk_size must be positive, not {chunk_size}")
    df = read(data, spark)
    held: list[pa.Table] = []
    for row in df.mapInArrow(_packed, "piece binary").toLocalIterator() if df.columns else ():
        piece = pa.ipc.open_stream(row["piece"]).read_all()
        if chunk_size is None:
            if piece.num_rows:
                yield piece
            continue
        while piece.num_rows:
            wanted = chunk_size - sum(t.num_rows for t in held)
            held.append(piece.slice(0, wanted))
            piece = piece.slice(wanted)
            if sum(t.num_rows for t in held) == chunk_size:
                yield pa.concat_tables(held)
                held = []
    if held:
        yield pa.concat_tables(held)


def chunks_with_metrics(data: Any, chunk_size: int | None = None, spark: SparkSession | None = None) -> Iterator[tuple[pa.Table, dict[str, float]]]:
    """``chunks``, each with its number, first row, rows, bytes and the seconds that it took to come."""
    start, began = 0, time.perf_counter()
    for number, table in enumerate(chunks(data, chunk_size, spark)):
        yield table, {"chunk": number, "start_row": start, "rows": table.num_rows, "bytes": table.nbytes, "seconds": time.perf_counter() - began}
        start, began = start + table.num_rows, time.perf_counter()


def partition_sizes(df: DataFrame) -> DataFrame:
    """(partition, rows): how rows lie in partitions."""
    return df.groupBy(F.spark_partition_id().alias("partition")).agg(F.count("*").alias("rows"))
