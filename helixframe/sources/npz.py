"""npz files as a Spark data source: embedding files (``embeddings``, ``y_true``) and prediction files (``y_pred``).

Reading: one task for each file, one column for each array of the schema (a vector array becomes ``array<...>``), plus ``file`` and ``row`` where
the schema names them.  Only the members a schema names are opened, so a scan of the labels never touches the vectors; members are read
``batch_rows`` rows at a time, so a file of any length takes bounded memory.

Writing: every task writes files of at most ``max_rows`` rows into a hidden folder of the job; the commit moves them next to the data under a
marker that hides them until the last one is in place, and a failed job removes its folder.  A reader ignores hidden names and files of a
job whose marker is still there, so a killed write shows nothing.

Paths may be plain (a folder that all executors see) or URIs that pyarrow can open.  Defined cases: npz holds no nulls, so a null value, a null
element and vectors of unequal length raise; an empty table writes no file; a folder without files needs a schema and has no rows;
arrays of unequal length in a file raise.
"""

from __future__ import annotations

import io
import json
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

META = {"file": T.StringType(), "row": T.LongType()}
_SPARK = {"f4": T.FloatType(), "f8": T.DoubleType(), "i1": T.ByteType(), "i2": T.ShortType(), "i4": T.IntegerType(), "i8": T.LongType(), "b1": T.BooleanType(),
          "u1": T.ShortType(), "u2": T.IntegerType(), "u4": T.LongType()}
_NUMPY = {T.FloatType(): "f4", T.DoubleType(): "f8", T.ByteType(): "i1", T.ShortType(): "i2", T.IntegerType(): "i4", T.LongType(): "i8", T.BooleanType(): "?"}
MARKER = "_publishing-"


def _fs(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def npz_files(path: str) -> list[str]:
    """The published npz files below ``path`` (or the file itself), in order."""
    fs, root = _fs(path)
    info = fs.get_file_info(root)
    if info.type == pafs.FileType.File:
        return [root]
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [f.path for f in fs.get_file_info(pafs.FileSelector(root, recursive=True)) if f.type == pafs.FileType.File]
    parts = {p: p[len(root):].strip("/").split("/") for p in found}
    hidden = {x[-1][len(MARKER):] for x in parts.values() if x[-1].startswith(MARKER)}
    keep = lambda x: x[-1].endswith(".npz") and not any(s.startswith(("_", ".")) for s in x) and not any(job in x[-1] for job in hidden)
    return sorted(p for p, x in parts.items() if keep(x))


class _Member:
    """One array of a file, read row by row without holding it."""

    def __init__(self, archive: zipfile.ZipFile, name: str):
        self.name, self.f = name, archive.open(name + ".npy")
        version = np.lib.format.read_magic(self.f)
        read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
        self.shape, self.fortran, self.dtype = read(self.f)
        if self.dtype.hasobject:
            raise ValueError(f"array {name!r} holds objects")
        if not self.shape or len(self.shape) > 2:
            raise ValueError(f"array {name!r} has {len(self.shape)} dimensions: rows need one or two")
        self.whole = None
        if self.fortran and len(self.shape) == 2:  # columns lie one after the other: rows need all of them
            flat = np.frombuffer(self.f.read(), self.dtype)
            self.whole, self.at = flat.reshape(self.shape[::-1]).T, 0

    def take(self, n: int) -> np.ndarray:
        if self.whole is not None:
            self.at += n
            return self.whole[self.at - n:self.at]
        width = int(np.prod(self.shape[1:], dtype=np.int64))
        data = self.f.read(n * width * self.dtype.itemsize)
        return np.frombuffer(data, self.dtype).reshape((n, *self.shape[1:]))


def _field(name: str, dtype: np.dtype, dims: int) -> T.StructField:
    kind = _SPARK.get(dtype.str[1:])
    if kind is None:
        raise ValueError(f"array {name!r} has type {dtype}, which has no column type")
    return T.StructField(name, T.ArrayType(kind) if dims == 2 else kind)


@dataclass
class _File(InputPartition):
    path: str


class NpzReader(DataSourceReader):
    def __init__(self, schema: T.StructType, path: str, batch_rows: int):
        self.schema, self.path, self.batch_rows = schema, path, batch_rows

    def partitions(self):
        return [_File(p) for p in npz_files(self.path)] or [_File("")]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema
        if not partition.path:
            return
        schema = to_arrow_schema(self.schema)
        names = [f.name for f in self.schema if f.name not in META]
        fs, _ = _fs(self.path)
        with fs.open_input_file(partition.path) as raw, zipfile.ZipFile(raw) as archive:
            # with no array asked for, the shortest member tells the number of rows
            opened = {n: _Member(archive, n) for n in names} or {"": _Member(archive, min(archive.infolist(), key=lambda i: i.file_size).filename[:-4])}
            sizes = {m.shape[0] for m in opened.values()}
            if len(sizes) > 1:
                raise ValueError(f"arrays of {partition.path} differ in length: { {n: m.shape[0] for n, m in opened.items()} }")
            n = sizes.pop()
            for at in range(0, n, self.batch_rows):
                m = min(self.batch_rows, n - at)
                cols = []
                for f in schema:
                    if f.name == "file":
                        cols.append(pa.array([partition.path] * m, f.type))
                    elif f.name == "row":
                        cols.append(pa.array(np.arange(at, at + m), f.type))
                    else:
                        x = opened[f.name].take(m)
                        if x.ndim == 2:
                            values = pa.array(np.ascontiguousarray(x).ravel()).cast(f.type.value_type)
                            cols.append(pa.ListArray.from_arrays(pa.array(np.arange(m + 1) * x.shape[1], pa.int32()), values).cast(f.type))
                        else:
                            cols.append(pa.array(np.ascontiguousarray(x)).cast(f.type))
                yield pa.RecordBatch.from_arrays(cols, schema=schema)


@dataclass
class _Written(WriterCommitMessage):
    names: list


def _array(column: pa.Array, kind: T.DataType, name: str) -> np.ndarray:
    if column.null_count:
        raise ValueError(f"column {name!r} has nulls, which npz cannot hold")
    if not isinstance(kind, T.ArrayType):
        return column.to_numpy(zero_copy_only=False).astype(_NUMPY[kind])
    widths = np.diff(column.offsets.to_numpy())
    flat = column.flatten()
    if flat.null_count:
        raise ValueError(f"column {name!r} has vectors with nulls")
    if len(widths) and (widths != widths[0]).any():
        raise ValueError(f"column {name!r} has vectors of unequal length")
    return flat.to_numpy(zero_copy_only=False).astype(_NUMPY[kind.elementType]).reshape(len(column), -1)


class NpzWriter(DataSourceArrowWriter):
    def __init__(self, schema: T.StructType, path: str, overwrite: bool, max_rows: int, compressed: bool):
        for f in schema:
            kind = f.dataType.elementType if isinstance(f.dataType, T.ArrayType) else f.dataType
            if kind not in _NUMPY:
                raise ValueError(f"column {f.name!r} of type {f.dataType.simpleString()} has no array type")
        self.schema, self.path, self.overwrite, self.max_rows, self.compressed = schema, path, overwrite, max_rows, compressed
        self.job = uuid.uuid4().hex
        fs, root = _fs(path)
        fs.create_dir(f"{root}/_job-{self.job}", recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        from pyspark import TaskContext
        fs, root = _fs(self.path)
        part, attempt, names, held, size = TaskContext.get().partitionId(), uuid.uuid4().hex[:8], [], [], 0

        def flush(batches):
            table = pa.Table.from_batches(batches).combine_chunks()
            arrays = {f.name: _array(table.column(i).chunk(0), f.dataType, f.name) for i, f in enumerate(self.schema)}
            name = f"part-{part:05d}-{len(names):04d}-{attempt}-{self.job}.npz"
            buffer = io.BytesIO()
            (np.savez_compressed if self.compressed else np.savez)(buffer, **arrays)
            with fs.open_output_stream(f"{root}/_job-{self.job}/{name}") as out:
                out.write(buffer.getbuffer())
            names.append(name)

        for batch in iterator:
            while batch.num_rows:
                held.append(batch.slice(0, self.max_rows - size))
                batch = batch.slice(held[-1].num_rows)
                size += held[-1].num_rows
                if size == self.max_rows:
                    flush(held)
                    held, size = [], 0
        if size:
            flush(held)
        return _Written(names)

    def commit(self, messages) -> None:
        """Publishes the files of the tasks that count; those of repeated attempts stay in the job's folder and go with it."""
        fs, root = _fs(self.path)
        before = npz_files(self.path) if self.overwrite else []
        marker = f"{root}/{MARKER}{self.job}"
        with fs.open_output_stream(marker) as out:
            out.write(json.dumps([n for m in messages if m for n in m.names]).encode())
        for m in messages:
            for name in m.names if m else ():
                fs.move(f"{root}/_job-{self.job}/{name}", f"{root}/{name}")
        fs.delete_file(marker)
        for p in before:
            fs.delete_file(p)
        fs.delete_dir(f"{root}/_job-{self.job}")

    def abort(self, messages) -> None:
        fs, root = _fs(self.path)
        if fs.get_file_info(f"{root}/_job-{self.job}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{root}/_job-{self.job}")


class NpzDataSource(DataSource):
    """``spark.read.format("npz")``; options: path, columns (comma-joined arrays), batch_rows; for writing max_rows, compressed."""

    @classmethod
    def name(cls) -> str:
        return "npz"

    def _path(self) -> str:
        path = self.options.get("path")
        if not path:
            raise ValueError("npz needs a path")
        return path.rstrip("/")

    def schema(self) -> T.StructType:
        """From the headers of the first file; no data is read."""
        files = npz_files(self._path())
        if not files:
            raise ValueError("a folder without npz files needs a schema")
        fs, _ = _fs(self._path())
        with fs.open_input_file(files[0]) as raw, zipfile.ZipFile(raw) as archive:
            wanted = self.options.get("columns")
            names = [n.strip() for n in wanted.split(",")] if wanted else [i.filename[:-4] for i in archive.infolist() if i.filename.endswith(".npy")]
            members = {n: _Member(archive, n) for n in names if n not in META}
            return T.StructType([T.StructField(n, META[n]) if n in META else _field(n, members[n].dtype, len(members[n].shape)) for n in names])

    def reader(self, schema: T.StructType) -> NpzReader:
        return NpzReader(schema, self._path(), int(self.options.get("batch_rows", "8192")))

    def writer(self, schema: T.StructType, overwrite: bool) -> NpzWriter:
        return NpzWriter(schema, self._path(), overwrite, int(self.options.get("max_rows", "65536")), self.options.get("compressed", "true").lower() == "true")


def read_npz(spark: SparkSession, path: str, columns: list[str] | None = None, schema: str | T.StructType | None = None) -> DataFrame:
    """The arrays of all files below ``path`` as rows; ``columns`` (``file`` and ``row`` among them, if wanted) are all that is read."""
    spark.dataSource.register(NpzDataSource)
    r = spark.read.format("npz")
    if schema is not None:
        r = r.schema(schema)
    elif columns:
        r = r.option("columns", ",".join(columns))
    return r.load(path)


def write_npz(df: DataFrame, path: str, mode: str = "append", max_rows: int = 65536) -> None:
    """Writes every column as an array, in files of at most ``max_rows`` rows."""
    df.sparkSession.dataSource.register(NpzDataSource)
    df.write.format("npz").mode(mode).option("max_rows", str(max_rows)).save(path)
