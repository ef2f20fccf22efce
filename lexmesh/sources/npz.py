"""NumPy archives as a source and a sink (S16, K3): rows of a vectors member, with the words of a vocabulary member beside them.

``spark.read.format("npz")`` after ``register``. Options: vectors and tokens (names of members, ``vectors`` and ``vocab`` by
default; tokens is left out where the archive lacks it), rows (of a partition), first and last (of the rows to read of each
archive, last not included). A member that is stored plainly is read by ranges of rows, and what lies outside of first and last
isn't read; a compressed one is read from its start by one task, some rows at a time. (Filters aren't pushed: in this version of
Spark a query without a filter that can be pushed reads the partitions of an earlier one that had such a filter.) Paths go through Arrow's file systems, so a store is read like a local folder. Pickled members are
refused.

Writing makes one archive for each ``rows`` rows of a task, in the order of the tasks; files get their names when all tasks have
ended, so one that is run again leaves nothing behind. Option dtype: float32 (default), float16 or float64.
"""

from __future__ import annotations

import io
import struct
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

ROWS = 65_536
STEP = 4096  # rows of a batch
MOST_BYTES = 64 << 20  # of the words of one archive


def store(path: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return pa.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pa.fs.LocalFileSystem(), path)


def files_of(path: str) -> list[str]:
    """The archives of a path: itself, or those directly in it, by name."""
    fs, at = store(path)
    scheme = path[: len(path) - len(at)] if path.endswith(at) else ""
    info = fs.get_file_info(at)
    if info.type == pa.fs.FileType.Directory:
        names = [f.path for f in fs.get_file_info(pa.fs.FileSelector(at)) if f.is_file and f.base_name.endswith(".npz") and not f.base_name.startswith(("_", "."))]
        return [scheme + n for n in sorted(names)]
    if info.type == pa.fs.FileType.NotFound:
        raise FileNotFoundError(path)
    return [path]


@dataclass
class Member:
    """An array in an archive: where its data begins if it is stored plainly, else -1."""

    name: str
    dtype: np.dtype
    shape: tuple[int, ...]
    offset: int

    @property
    def row(self) -> int:
        return self.dtype.itemsize * int(np.prod(self.shape[1:], dtype=np.int64))


def _header(f: Any, name: str) -> tuple[np.dtype, tuple[int, ...]]:
    version = np.lib.format.read_magic(f)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, by_column, dtype = read(f)
    if dtype.hasobject:
        raise ValueError(f"{name} is pickled")
    if by_column and len(shape) > 1:
        raise ValueError(f"{name} is stored by columns")
    return dtype, shape


def members(path: str) -> dict[str, Member]:
    fs, at = store(path)
    out = {}
    with fs.open_input_file(at) as raw, zipfile.ZipFile(raw) as z:
        for info in z.infolist():
            name = info.filename.removesuffix(".npy")
            with z.open(info) as f:
                try:
                    dtype, shape = _header(f, name)
                except ValueError as e:
                    if "pickled" not in str(e):
                        raise
                    continue
                length = f.tell()
            offset = -1
            if info.compress_type == zipfile.ZIP_STORED:
                raw.seek(info.header_offset + 26)
                offset = info.header_offset + 30 + sum(struct.unpack("<HH", raw.read(4))) + length
            out[name] = Member(name, dtype, shape, offset)
    return out


def read_rows(path: str, m: Member, lo: int, hi: int, step: int = STEP) -> Iterator[np.ndarray]:
    """Rows lo to hi of a member, up to step at a time."""
    fs, at = store(path)
    with fs.open_input_file(at) as raw:
        if m.offset >= 0:
            raw.seek(m.offset + lo * m.row)
            f: Any = raw
        else:
            f = zipfile.ZipFile(raw).open(f"{m.name}.npy")
            _header(f, m.name)
            left = lo * m.row
            while left:
                left -= len(f.read(min(left, 1 << 20))) or left
        for at_row in range(lo, hi, step):
            n = min(step, hi - at_row)
            data = f.read(n * m.row)
            if len(data) < n * m.row:
                raise ValueError(f"{m.name} of {path} ends after {at_row + len(data) // max(1, m.row)} rows")
            yield np.frombuffer(data, m.dtype).reshape(n, *m.shape[1:]) if m.row else np.zeros((n, *m.shape[1:]), m.dtype)


def scalars(path: str) -> dict[str, Any]:
    """The members that are single values, as metadata is kept."""
    return {n: next(read_rows(path, Member(n, m.dtype, (1,), m.offset), 0, 1))[0].item() for n, m in members(path).items() if m.shape == ()}


def matrix(path: str, name: str, most: int = 1 << 26) -> np.ndarray:
    """A whole member of at most ``most`` values, as for the weights of a ridge map."""
    m = members(path)[name]
    if int(np.prod(m.shape, dtype=np.int64)) > most:
        raise ValueError(f"{name} of {path} has more than {most} values; read it as rows")
    parts = list(read_rows(path, m, 0, m.shape[0]))
    return np.concatenate(parts) if parts else np.zeros(m.shape, m.dtype)


@dataclass
class Rows(InputPartition):
    path: str
    lo: int
    hi: int


class NpzReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.path, self.rows = options["path"], int(options.get("rows", ROWS))
        self.vectors, self.tokens = options.get("vectors", "vectors"), options.get("tokens", "vocab")
        self.named, self.wide = "token" in schema.fieldNames(), schema["vec"].dataType.simpleString() == "array<double>"
        self.lo, self.hi = int(options.get("first", 0)), int(options.get("last", 1 << 62))

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path in files_of(self.path):
            found = self._members(path)
            n = found[0].shape[0]
            step = self.rows if all(m.offset >= 0 for m in found) else max(1, n)
            first, last = max(0, self.lo), min(n, self.hi)
            out += [Rows(path, lo, min(lo + step, last)) for lo in range(first, last, step)]
        return out or [Rows("", 0, 0)]

    def _members(self, path: str) -> list[Member]:
        found = members(path)
        if self.vectors not in found or len(found[self.vectors].shape) != 2:
            raise ValueError(f"{path} has no matrix {self.vectors!r}")
        wanted = [found[self.vectors], *([found[self.tokens]] if self.named else [])]
        if len({m.shape[0] for m in wanted}) > 1:
            raise ValueError(f"{path}: {wanted[0].shape[0]} vectors, but {wanted[1].shape[0]} words")
        return wanted

    def read(self, part: Rows) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        v, *words = self._members(part.path)
        kind = pa.float64() if self.wide else pa.float32()
        names = ["file", "idx", *(["token"] if words else []), "vec"]
        tokens = read_rows(part.path, words[0], part.lo, part.hi) if words else None
        at = part.lo
        for block in read_rows(part.path, v, part.lo, part.hi):
            n = len(block)
            flat = pa.array(block.astype(np.float64 if self.wide else np.float32).ravel(), kind)
            vec = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * v.shape[1]), flat)
            columns = [pa.array([part.path] * n, pa.string()), pa.array(np.arange(at, at + n)), vec]
            if tokens is not None:
                columns.insert(2, pa.array([str(w) if not isinstance(w, bytes) else w.decode() for w in next(tokens).tolist()], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names)
            at += n


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class NpzWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], schema: StructType, overwrite: bool):
        self.path, self.rows, self.overwrite = options["path"], int(options.get("rows", ROWS)), overwrite
        self.vectors, self.tokens, self.dtype = options.get("vectors", "vectors"), options.get("tokens", "vocab"), np.dtype(options.get("dtype", "float32"))
        if "vec" not in schema.fieldNames():
            raise ValueError("column vec is missing")
        self.named, self.run = "token" in schema.fieldNames(), uuid.uuid4().hex[:12]

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        fs, folder = store(self.path)
        fs.create_dir(folder, recursive=True)
        made: list[tuple[str, str]] = []
        held: list[pa.RecordBatch] = []

        def flush() -> None:
            t = pa.Table.from_batches(held)
            held.clear()
            column = t.column("vec").combine_chunks()
            if column.null_count or (len(column) and len(column.flatten()) % len(column)):
                raise ValueError("vectors must all have one length")
            arrays = {self.vectors: column.flatten().to_numpy(zero_copy_only=False).astype(self.dtype).reshape(len(column), -1)}
            if self.named:
                words = t.column("token").to_pylist()
                if None in words or any(w.endswith("\0") for w in words):
                    raise ValueError("a word is null or ends in a null character")
                arrays[self.tokens] = np.array(words, dtype=np.str_)
            name = f"part-{task:05d}-{len(made):05d}-{self.run}.npz"
            hidden = f"{folder}/_{uuid.uuid4().hex}-{name}"
            out = io.BytesIO()
            np.savez(out, **arrays)
            with fs.open_output_stream(hidden) as f:
                f.write(out.getbuffer())
            made.append((hidden, f"{folder}/{name}"))

        widest, count, step = 0, 0, min(STEP, self.rows)
        for b in batches:
            for lo in range(0, b.num_rows, step):
                part = b.slice(lo, step)
                longest = max((len(w or "") for w in part.column(part.schema.get_field_index("token")).to_pylist()), default=0) if self.named else 0
                if held and (count + part.num_rows > self.rows or (count + part.num_rows) * 4 * max(widest, longest) > MOST_BYTES):
                    flush()
                    widest = count = 0
                held.append(part)
                widest, count = max(widest, longest), count + part.num_rows
        if held:
            flush()
        return Written(made)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, folder = store(self.path)
        fs.create_dir(folder, recursive=True)
        if self.overwrite:
            for f in files_of(self.path):
                fs.delete_file(store(f)[1])
        for m in messages:
            for hidden, name in m.files if m else []:
                fs.move(hidden, name)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, _ = store(self.path)
        for m in messages:
            for hidden, _name in m.files if m else []:
                fs.delete_file(hidden)


class NpzSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npz"

    def schema(self) -> str:
        files = files_of(self.options["path"])
        if not files:
            raise FileNotFoundError(f"no archives in {self.options['path']}")
        found = members(files[0])
        v = found.get(self.options.get("vectors", "vectors"))
        if v is None:
            raise ValueError(f"{files[0]} has no matrix {self.options.get('vectors', 'vectors')!r}")
        named = self.options.get("tokens", "vocab") in found
        return f"file string, idx long, {'token string, ' if named else ''}vec array<{'double' if v.dtype.itemsize > 4 else 'float'}>"

    def reader(self, schema: StructType) -> DataSourceReader:
        return NpzReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return NpzWriter(self.options, schema, overwrite)


def register(spark: SparkSession) -> None:
    """Make format npz known to the session."""
    spark.dataSource.register(NpzSource)


def read_npz(spark: SparkSession, path: str, **options: Any) -> DataFrame:
    """(file, idx, token, vec) of an archive or a folder of archives; token only where the archives have words."""
    register(spark)
    return spark.read.format("npz").options(**options).load(path)


def write_npz(df: DataFrame, path: str, mode: str = "overwrite", **options: Any) -> None:
    """df's vec, and token if it has it, as archives in a folder."""
    register(df.sparkSession)
    wanted = [c for c in ("token", "vec") if c in df.columns]
    df.select(*wanted).write.format("npz").options(**options).mode(mode).save(path)
