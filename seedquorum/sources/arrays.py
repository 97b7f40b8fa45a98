"""NumPy arrays (.npy, .npz) as a Spark data source, format ``arrays``.

Read: only the arrays that are asked for are opened, so others (labels, say) are never touched. A stored array is cut into row ranges, each a
task of its own that seeks to its rows; a compressed one is a task that streams it in blocks. Comparisons of ``row`` with a number prune ranges.
Write: each task writes files under a temporary folder; only when all have ended are they moved into place, else all go.

Paths are opened by Python in the tasks: local or mounted folders, and what pyarrow.fs opens (hdfs, s3, gs). Elsewhere read with ``files.read_arrays``.
"""

from __future__ import annotations

import fnmatch
import io
import math
import struct
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, FloatType, IntegerType, LongType, StringType, StructField, StructType

from seedquorum.operators.relational import ValidationError
from seedquorum.plans.shipping import ship

#: Rows of a task, and of a batch within it.
ROWS_A_TASK, ROWS_A_BATCH = 100_000, 4096
#: The one array of a .npy file.
SINGLE = "array"


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def list_files(path: str) -> list[str]:
    """The .npy and .npz files of a path: itself, those of a folder, or those that its last part matches."""
    f, p = _open(path)
    folder, _, pattern = p.rpartition("/")
    if any(c in pattern for c in "*?["):
        found = [i.path for i in f.get_file_info(pafs.FileSelector(folder)) if i.is_file and fnmatch.fnmatch(i.base_name, pattern)]
    else:
        info = f.get_file_info(p)
        found = [i.path for i in f.get_file_info(pafs.FileSelector(p, recursive=True)) if i.is_file and "/_" not in i.path[len(p) :]] if info.type == pafs.FileType.Directory else [p] if info.is_file else []
    found = sorted(x for x in found if x.endswith((".npy", ".npz")))
    if not found:
        raise ValidationError(f"no arrays under {path}")
    return found


@dataclass(frozen=True)
class Member:
    """One array of a file: where its data begin (None if compressed), its shape and type."""

    start: int | None
    shape: tuple[int, ...]
    dtype: np.dtype

    @property
    def row_bytes(self) -> int:
        return self.dtype.itemsize * math.prod(self.shape[1:])


def _header(f) -> tuple[tuple[int, ...], np.dtype]:
    version = np.lib.format.read_magic(f)
    shape, fortran, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
    if fortran and len(shape) > 1:
        raise ValidationError("arrays in Fortran order aren't read by rows")
    if dtype.hasobject or len(shape) not in (1, 2):
        raise ValidationError(f"an array of shape {shape} and type {dtype}")
    return shape, dtype


def members(f, path: str, names: list[str]) -> dict[str, Member]:
    """The named arrays of an open file; a missing one is an error, others aren't opened."""
    if path.endswith(".npy"):
        if names != [SINGLE]:
            raise ValidationError(f"{path} holds one array, {SINGLE}")
        shape, dtype = _header(f)
        return {SINGLE: Member(f.tell(), shape, dtype)}
    out = {}
    with zipfile.ZipFile(f) as z:
        for name in names:
            try:
                info = z.getinfo(f"{name}.npy")
            except KeyError:
                raise ValidationError(f"{path} has no array {name}") from None
            with z.open(info) as m:
                shape, dtype = _header(m)
                ahead = m.tell()
            start = None
            if info.compress_type == zipfile.ZIP_STORED:
                f.seek(info.header_offset)
                local = f.read(30)
                start = info.header_offset + 30 + sum(struct.unpack("<HH", local[26:30])) + ahead
            out[name] = Member(start, shape, dtype)
    if len({m.shape[0] for m in out.values()}) > 1:
        raise ValidationError(f"{path}: arrays of different lengths {({n: m.shape[0] for n, m in out.items()})}")
    return out


def _spark_type(m: Member) -> DataType:
    kind = {"f": FloatType() if m.dtype.itemsize <= 4 else DoubleType(), "i": IntegerType() if m.dtype.itemsize <= 4 else LongType(), "u": LongType(), "b": BooleanType(), "U": StringType(), "S": StringType()}.get(m.dtype.kind)
    if kind is None:
        raise ValidationError(f"no column type for {m.dtype}")
    return ArrayType(kind) if len(m.shape) == 2 else kind


def _arrow(a: np.ndarray, kind: DataType) -> pa.Array:
    inner = kind.elementType if isinstance(kind, ArrayType) else kind
    to = {"float": pa.float32(), "double": pa.float64(), "int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}[inner.simpleString()]
    flat = a.ravel()
    values = pa.array(flat.astype(str) if a.dtype.kind in "US" else flat.astype(to.to_pandas_dtype()) if to != pa.bool_() else flat, to)
    if a.ndim == 1:
        return values
    return pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1, dtype=np.int32) * a.shape[1]), values)


@dataclass
class RowRange(InputPartition):
    path: str
    first: int
    end: int


class ArrayReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, names: list[str], rows: int):
        self.path, self.schema, self.names, self.rows = path, schema, names, rows
        self.low, self.high = 0, 1 << 62

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            n = getattr(f, "value", None)
            if getattr(f, "attribute", None) == ("row",) and isinstance(n, int):
                if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                    self.low = max(self.low, n + isinstance(f, GreaterThan))
                if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                    self.high = min(self.high, n + (not isinstance(f, LessThan)))
            yield f  # Spark still checks each row

    def partitions(self) -> list[RowRange]:
        out = []
        for path in list_files(self.path):
            f, p = _open(path)
            with f.open_input_file(p) as file:
                found = members(file, p, self.names)
            n = min(m.shape[0] for m in found.values())
            first, end = min(self.low, n), min(self.high, n)
            step = self.rows if all(m.start is not None for m in found.values()) else max(1, n)
            out += [RowRange(path, i, min(i + step, end)) for i in range(first, end, step)]
        return out or [RowRange("", 0, 0)]

    def read(self, part: RowRange) -> Iterator[pa.RecordBatch]:
        if part.first >= part.end:
            return
        f, p = _open(part.path)
        with f.open_input_file(p) as file:
            found = members(file, p, self.names)
            streams = {}
            for name, m in found.items():
                if m.start is None:
                    streams[name] = zipfile.ZipFile(f.open_input_file(p)).open(f"{name}.npy")
                    _header(streams[name])
                    left = part.first * m.row_bytes
                    while left:
                        left -= len(streams[name].read(min(left, 1 << 20))) or left
            for i in range(part.first, part.end, ROWS_A_BATCH):
                n, columns = min(ROWS_A_BATCH, part.end - i), []
                for field in self.schema.fields:
                    if field.name == "path":
                        columns.append(pa.array([part.path] * n, pa.string()))
                    elif field.name == "row":
                        columns.append(pa.array(np.arange(i, i + n)))
                    else:
                        m = found[field.name]
                        if m.start is None:
                            raw = streams[field.name].read(n * m.row_bytes)
                        else:
                            file.seek(m.start + i * m.row_bytes)
                            raw = file.read(n * m.row_bytes)
                        columns.append(_arrow(np.frombuffer(raw, m.dtype).reshape(n, *m.shape[1:]), field.dataType))
                yield pa.RecordBatch.from_arrays(columns, [x.name for x in self.schema.fields])


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class ArrayWriter(DataSourceArrowWriter):
    """A file for up to ``rows`` rows of a task; the first column of arrays and plain columns alike, each an array of the file."""

    def __init__(self, path: str, overwrite: bool, compressed: bool, rows: int):
        self.path, self.overwrite, self.compressed, self.rows = path.rstrip("/"), overwrite, compressed, rows
        f, p = _open(self.path)
        if f.get_file_info(p).type != pafs.FileType.NotFound and not overwrite:
            raise ValidationError(f"{path} exists")
        self.staging = f"{p}/_temporary-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        f, _ = _open(self.path)
        out, kept, n = [], [], 0

        def flush():
            table = pa.Table.from_batches(kept)
            arrays = {}
            for name in table.column_names:
                c = table[name].combine_chunks()
                if c.null_count:
                    raise ValidationError(f"null in {name}")
                if pa.types.is_list(c.type):
                    width = {len(x) for x in c.slice(0, 1)} | set(np.diff(c.offsets.to_numpy()).tolist())
                    if len(width) > 1:
                        raise ValidationError(f"rows of different lengths in {name}")
                    v = c.flatten()
                    arrays[name] = v.to_numpy(zero_copy_only=False).reshape(len(c), -1)
                else:
                    v = c.to_numpy(zero_copy_only=False)
                    arrays[name] = v.astype(str) if v.dtype == object else v
            f.create_dir(self.staging, recursive=True)
            name = f"{self.staging}/part-{uuid.uuid4().hex}.npz"
            buffer = io.BytesIO()
            (np.savez_compressed if self.compressed else np.savez)(buffer, **arrays)
            with f.open_output_stream(name) as s:
                s.write(buffer.getbuffer())
            out.append(name)
            kept.clear()

        for batch in iterator:
            for i in range(0, batch.num_rows, self.rows):
                part = batch.slice(i, self.rows)
                if n + part.num_rows > self.rows and kept:
                    flush()
                    n = 0
                kept.append(part)
                n += part.num_rows
        if kept:
            flush()
        return Written(out)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        f, p = _open(self.path)
        f.create_dir(p, recursive=True)
        old = [i.path for i in f.get_file_info(pafs.FileSelector(p)) if i.is_file and i.base_name.startswith("part-")] if self.overwrite else []
        for name in (name for m in messages if m for name in m.files):
            f.move(name, f"{p}/{name.rpartition('/')[2]}")
        for name in old:
            f.delete_file(name)
        self._clean(f)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        f, p = _open(self.path)
        self._clean(f)
        if f.get_file_info(p).type != pafs.FileType.NotFound and not f.get_file_info(pafs.FileSelector(p)):
            f.delete_dir(p)

    def _clean(self, f: pafs.FileSystem) -> None:
        if f.get_file_info(self.staging).type != pafs.FileType.NotFound:
            f.delete_dir(self.staging)


class Arrays(DataSource):
    """Options: path, arrays (names by comma), rows (of a task or file), compressed."""

    @classmethod
    def name(cls) -> str:
        return "arrays"

    def _names(self) -> list[str]:
        names = [n.strip() for n in self.options.get("arrays", SINGLE).split(",")]
        if {"path", "row"} & set(names):
            raise ValidationError("an array can't be read as path or row")
        return names

    def schema(self) -> StructType:
        first = list_files(self.options["path"])[0]
        f, p = _open(first)
        with f.open_input_file(p) as file:
            found = members(file, p, self._names())
        return StructType([StructField("path", StringType()), StructField("row", LongType()), *(StructField(n, _spark_type(m)) for n, m in found.items())])

    def reader(self, schema: StructType) -> ArrayReader:
        return ArrayReader(self.options["path"], schema, self._names(), int(self.options.get("rows", ROWS_A_TASK)))

    def writer(self, schema: StructType, overwrite: bool) -> ArrayWriter:
        return ArrayWriter(self.options["path"], overwrite, self.options.get("compressed", "false") == "true", int(self.options.get("rows", ROWS_A_TASK)))


def _registered(spark: SparkSession) -> None:
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Arrays)


def scan_arrays(spark: SparkSession, path: str, arrays: list[str], rows: int = ROWS_A_TASK) -> DataFrame:
    """path, row and a column for each of ``arrays``, of the .npy and .npz files of a path; no other array is opened."""
    _registered(spark)
    return spark.read.format("arrays").option("path", path).option("arrays", ",".join(arrays)).option("rows", rows).load()


def write_arrays(df: DataFrame, path: str, mode: str = "errorifexists", rows: int = ROWS_A_TASK, compressed: bool = False) -> None:
    """Each column as an array of .npz files; all files or none. ``errorifexists`` or ``overwrite``, which drops old parts once the new ones are there."""
    _registered(df.sparkSession)
    if mode not in ("errorifexists", "overwrite"):
        raise ValueError(mode)
    plain = df.select(*(F.col(f"`{c}`") for c in df.columns))
    plain.write.format("arrays").option("path", path).option("rows", rows).option("compressed", str(compressed).lower()).mode("overwrite" if mode == "overwrite" else "append").save()
