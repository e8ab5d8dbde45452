"""Raw float clouds as a data source: spark.read.format("raw_cloud").option("dim", 64).load(path).

A cloud is one file, a list of files, or a folder, of little-endian float32 vectors put end to end. Reading
is split by byte ranges, so that one file is read by many tasks, and each task gives Arrow batches. pid
is the position, files in the order given, or in the order of a folder's list of files, or else of their names.

Writing makes one file a task, and last of all the folder's list of files (LISTING), so that a reader sees a
write whole or not at all; what failed tasks leave behind is never listed. Paths are local or shared
folders, or URIs of the stores that Arrow's file systems know.

Defined cases: an empty file or folder gives no rows; a file whose length is no multiple of a vector is an
error, as is a vector to be written that is null, or of another length.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Bytes that a task reads, and that an Arrow batch holds, about.
TASK_BYTES, BATCH_BYTES = 64 << 20, 4 << 20
LISTING = "_files.json"
SCHEMA = "pid long, vec array<float>"
NUMBER = np.dtype("<f4")


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    scheme, _, rest = path.partition(":")
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    return fs.LocalFileSystem(), path


def listed(store: fs.FileSystem, folder: str) -> list[str] | None:
    """The folder's own list of files; None where it has none."""
    if store.get_file_info(f"{folder}/{LISTING}").type == fs.FileType.NotFound:
        return None
    with store.open_input_stream(f"{folder}/{LISTING}") as lines:
        return json.loads(lines.read())


def files_of(path: str) -> list[tuple[str, int]]:
    """Files of a path and their bytes, in order. Paths of a folder's files are those of the folder."""
    store, at = opened(path)
    info = store.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    names = listed(store, at)
    if names is None:
        found = store.get_file_info(fs.FileSelector(at))
        names = sorted(f.base_name for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")))
    sizes = store.get_file_info([f"{at}/{name}" for name in names]) if names else []
    return [(f"{path.rstrip('/')}/{name}", f.size) for name, f in zip(names, sizes, strict=True)]


def paths_of(options: dict) -> list[str]:
    return json.loads(options["files"]) if "files" in options else [options["path"]]


@dataclass
class Range(InputPartition):
    """n vectors of a file from vector `first` on, whose pid is `pid`."""

    path: str
    first: int
    n: int
    pid: int


class RawReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths, self.dim = paths_of(options), int(options["dim"])
        if self.dim < 1:
            raise ValueError("dim must be positive")
        self.rows = max(1, int(options.get("taskBytes", TASK_BYTES)) // (4 * self.dim))

    def partitions(self) -> list[Range]:
        out, pid = [], 0
        for path, size in (f for p in self.paths for f in files_of(p)):
            if size % (4 * self.dim):
                raise ValueError(f"{path}: {size} bytes are no whole number of vectors of {self.dim}")
            n = size // (4 * self.dim)
            out += [Range(path, at, min(self.rows, n - at), pid + at) for at in range(0, n, self.rows)]
            pid += n
        return out or [Range("", 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.n:
            return
        store, at = opened(partition.path)
        step = max(1, BATCH_BYTES // (4 * self.dim))
        with store.open_input_file(at) as data:
            for i in range(0, partition.n, step):
                n = min(step, partition.n - i)
                numbers = np.frombuffer(data.read_at(4 * self.dim * n, 4 * self.dim * (partition.first + i)), NUMBER)
                offsets = np.arange(0, (n + 1) * self.dim, self.dim, dtype=np.int32)
                vecs = pa.ListArray.from_arrays(pa.array(offsets), pa.array(numbers.astype(np.float32)))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(n, dtype=np.int64) + partition.pid + i), vecs], names=["pid", "vec"])


@dataclass
class Written(WriterCommitMessage):
    partition: int
    name: str
    n: int


class RawWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, columns: list[str], overwrite: bool):
        self.path, self.dim, self.at, self.overwrite = options["path"], int(options["dim"]), columns.index("vec"), overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        store, at = opened(self.path)
        store.create_dir(at, recursive=True)
        partition, n = TaskContext.get().partitionId(), 0
        name = f"part-{partition:06d}-{uuid.uuid4().hex}.f32"
        with store.open_output_stream(f"{at}/{name}") as out:
            for batch in iterator:
                vecs = batch.column(self.at)
                lengths = np.diff(vecs.offsets.to_numpy())
                if vecs.null_count or vecs.flatten().null_count or (lengths != self.dim).any():
                    raise ValueError(f"a vector is not of {self.dim} components")
                out.write(vecs.flatten().to_numpy(zero_copy_only=False).astype(NUMBER).tobytes())
                n += batch.num_rows
        return Written(partition, name, n)

    def commit(self, messages: list[Written | None]) -> None:
        store, at = opened(self.path)
        store.create_dir(at, recursive=True)
        before = listed(store, at) or []
        names = [m.name for m in sorted((m for m in messages if m and m.n), key=lambda m: m.partition)]
        with store.open_output_stream(f"{at}/{LISTING}") as out:
            out.write(json.dumps(names if self.overwrite else before + names).encode())
        for name in before if self.overwrite else []:
            store.delete_file(f"{at}/{name}")

    def abort(self, messages: list[Written | None]) -> None:
        store, at = opened(self.path)
        for m in messages:
            if m:
                store.delete_file(f"{at}/{m.name}")


class RawCloud(DataSource):
    """Options: path, or files (a JSON list), dim, taskBytes."""

    @classmethod
    def name(cls) -> str:
        return "raw_cloud"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RawReader:
        return RawReader(self.options)

    def writer(self, schema, overwrite: bool) -> RawWriter:
        return RawWriter(self.options, schema.fieldNames(), overwrite)


def read_raw(spark: SparkSession, paths: str | list[str], dim: int, task_bytes: int = TASK_BYTES) -> DataFrame:
    """pid, vec of raw little-endian float32 files or folders. pid is the position, files in the order given."""
    files = [paths] if isinstance(paths, str) else list(paths)
    if not files:
        raise ValueError("no files")
    spark.dataSource.register(RawCloud)
    return spark.read.format("raw_cloud").option("files", json.dumps(files)).option("dim", dim).option("taskBytes", task_bytes).load()


def write_raw(points: DataFrame, path: str, dim: int, append: bool = False) -> None:
    """points(pid, vec) as a folder of raw files, in the order of pid: read again, pid is the place in that
    order, after what was there if it is appended."""
    points.sparkSession.dataSource.register(RawCloud)
    ordered = points.select("pid", points["vec"].cast("array<float>").alias("vec")).repartitionByRange("pid").sortWithinPartitions("pid")
    ordered.write.format("raw_cloud").mode("append" if append else "overwrite").option("dim", dim).save(path)
