"""The data source "npy": NumPy arrays of any rank as rows, read and written in row ranges.

    spark.dataSource.register(ArraySource)
    spark.read.format("npy").option("rowsPerTask", 100_000).load(folder)     # file, row, x
    df.write.format("npy").mode("append").save(folder)

x is a double, or an array of arrays as deep as the rank less one. A file's rows are contiguous, so a range of them is read by its
offset, and one large file is many tasks. Written parts are arrays of at most rowsPerFile consecutive rows of a task, named by
their first row, in a folder of their own until the job is committed; sort by row to have them in order. Paths go through Arrow's
file systems.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

ROWS = 100_000
#: Bytes of an array that are in memory at once when it is read.
CHUNK = 8_000_000


def _file_system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _files(path: str) -> list[str]:
    system, inner = _file_system(path)
    info = system.get_file_info(inner)
    if info.type == pafs.FileType.File:
        return [inner]
    found = system.get_file_info(pafs.FileSelector(inner)) if info.type == pafs.FileType.Directory else []
    return sorted(f.path for f in found if f.is_file and f.base_name.endswith(".npy") and not f.base_name.startswith(("_", ".")))


@dataclass(frozen=True)
class Header:
    """Shape, type and first byte of a file's array."""

    shape: tuple[int, ...]
    dtype: np.dtype
    offset: int

    @staticmethod
    def of(system: pafs.FileSystem, path: str) -> Header:
        with system.open_input_file(path) as f:
            version = np.lib.format.read_magic(f)
            read = {(1, 0): np.lib.format.read_array_header_1_0, (2, 0): np.lib.format.read_array_header_2_0}.get(version)
            if read is None:
                raise ValueError(f"{path}: version {version} of the format is not known")
            shape, fortran, dtype = read(f)
            if fortran and len(shape) > 1 or dtype.hasobject or not shape:
                raise ValueError(f"{path}: rows of this array are not contiguous numbers")
            return Header(shape, dtype, f.tell())


def _nested(depth: int) -> T.DataType:
    return T.ArrayType(_nested(depth - 1)) if depth else T.DoubleType()


def _lists(a: np.ndarray) -> pa.Array:
    """Rows of an array as nested lists of doubles."""
    out = pa.array(np.ascontiguousarray(a, dtype=np.float64).ravel())
    for k in range(a.ndim - 1, 0, -1):
        count = int(np.prod(a.shape[:k]))
        out = pa.ListArray.from_arrays(pa.array(np.arange(count + 1, dtype=np.int32) * a.shape[k], pa.int32()), out)
    return out


def _array(lists: pa.Array) -> np.ndarray:
    """The inverse of _lists(); nulls are NaN, rows of different shapes a ValueError."""
    shape: list[int] = [len(lists)]
    while pa.types.is_list(lists.type):
        sizes = np.unique(np.diff(lists.offsets.to_numpy()))
        if len(sizes) > 1 or lists.null_count:
            raise ValueError("rows of different shapes make no array")
        shape.append(int(sizes[0]) if len(sizes) else 0)
        lists = lists.flatten()
    return lists.to_numpy(zero_copy_only=False).astype(np.float64).reshape(shape)


@dataclass
class _Range(InputPartition):
    path: str
    begin: int
    end: int


class _Reader(DataSourceReader):
    def __init__(self, path: str, rows: int):
        self.path, self.rows = path, rows

    def partitions(self) -> list[InputPartition]:
        system, _ = _file_system(self.path)
        out: list[InputPartition] = []
        for f in _files(self.path):
            n = Header.of(system, f).shape[0]
            out += [_Range(f, a, min(a + self.rows, n)) for a in range(0, n, self.rows)]
        return out or [_Range("", 0, 0)]

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        if part.begin == part.end:
            return
        system, _ = _file_system(self.path)
        head = Header.of(system, part.path)
        width = int(np.prod(head.shape[1:])) * head.dtype.itemsize
        step = max(1, CHUNK // max(1, width))
        with system.open_input_file(part.path) as f:
            for a in range(part.begin, part.end, step):
                b = min(a + step, part.end)
                f.seek(head.offset + a * width)
                x = np.frombuffer(f.read((b - a) * width), head.dtype).reshape(b - a, *head.shape[1:])
                names = pa.array([posixpath.basename(part.path)]).take(pa.array(np.zeros(b - a, np.int32)))
                yield pa.RecordBatch.from_arrays([names, pa.array(np.arange(a, b)), _lists(x)], names=["file", "row", "x"])


@dataclass
class _Written(WriterCommitMessage):
    files: list[str]


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, rows: int, overwrite: bool):
        self.path, self.rows, self.overwrite = path, rows, overwrite
        self.apart = f"_writing-{uuid.uuid4().hex}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Written:
        system, folder = _file_system(self.path)
        system.create_dir(f"{folder}/{self.apart}", recursive=True)
        files: list[str] = []
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> None:
            rows, x = (np.concatenate(c) for c in zip(*held, strict=True))
            order = np.argsort(rows, kind="stable")
            name = f"part-{int(rows[order[0]]):015d}-{uuid.uuid4().hex[:8]}.npy"
            with system.open_output_stream(f"{folder}/{self.apart}/{name}") as f:
                np.lib.format.write_array(f, x[order], version=(1, 0), allow_pickle=False)
            files.append(name)
            held.clear()

        for whole in batches:
            at, a = {n: whole.column(whole.schema.names.index(n)) for n in ("row", "x")}, 0
            while a < whole.num_rows:
                take = min(whole.num_rows - a, self.rows - sum(len(r) for r, _ in held))
                held.append((at["row"].slice(a, take).to_numpy(), _array(at["x"].slice(a, take))))
                a += take
                if sum(len(r) for r, _ in held) == self.rows:
                    flush()
        if held:
            flush()
        return _Written(files)

    def commit(self, messages: list[_Written | None]) -> None:
        system, folder = _file_system(self.path)
        system.create_dir(folder, recursive=True)
        if self.overwrite:
            for f in _files(self.path):
                system.delete_file(f)
        for name in (f for m in messages if m for f in m.files):
            system.move(f"{folder}/{self.apart}/{name}", f"{folder}/{name}")
        self.abort([])

    def abort(self, messages: list[_Written | None]) -> None:
        system, folder = _file_system(self.path)
        if system.get_file_info(f"{folder}/{self.apart}").type == pafs.FileType.Directory:
            system.delete_dir(f"{folder}/{self.apart}")


class ArraySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> T.StructType:
        """file, row and x, as deep as the first array; all arrays of a folder must be as deep."""
        system, _ = _file_system(self.options["path"])
        depths = {len(Header.of(system, f).shape) - 1 for f in _files(self.options["path"])} or {0}
        if len(depths) > 1:
            raise ValueError("arrays of different ranks in one folder")
        return T.StructType([T.StructField("file", T.StringType()), T.StructField("row", T.LongType()), T.StructField("x", _nested(depths.pop()))])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("rowsPerTask", ROWS)))

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        if not {"row", "x"} <= set(schema.names):
            raise ValueError("columns row and x are needed")
        return _Writer(self.options["path"], int(self.options.get("rowsPerFile", ROWS)), overwrite)


def read_arrays(spark: SparkSession, path: str, rows_per_task: int = ROWS) -> DataFrame:
    """file, row, x of .npy files of one rank."""
    spark.dataSource.register(ArraySource)
    return spark.read.format("npy").option("rowsPerTask", rows_per_task).load(path)


def write_arrays(df: DataFrame, path: str, partitions: int, rows_per_file: int = ROWS, mode: str = "overwrite") -> None:
    """row and x as .npy parts whose names follow the order of rows."""
    df.sparkSession.dataSource.register(ArraySource)
    df.select(F.col("row").cast("long").alias("row"), "x").repartitionByRange(partitions, "row").sortWithinPartitions("row").write.format("npy").option("rowsPerFile", rows_per_file).mode(mode).save(path)
