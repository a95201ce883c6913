"""Array files, (T, 2, X, Y) in the `.npy` format, as a data source of field lines on any file system of `pyarrow.fs`.

    spark.dataSource.register(ArrayFiles)
    lines = spark.read.format("grid_arrays").option("chunk_steps", 100).load("s3://bucket/arrays")
    frames.write.format("grid_arrays").mode("append").save("file:///shared/arrays")

A file is read in slices of `chunk_steps` steps: only headers are read while planning, and a task reads its slices' bytes, a
few MB of frames at a time. A file's stem names the dataset; `stem@offset` is a part that starts at a later step. A task writes below
temporary names of its own attempt, and the commit moves whole files to their places: a repeated or lost task leaves none
behind, an aborted job none at all.
"""

from __future__ import annotations

import io
import json
import posixpath
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.window import Window

from gridtide.schema import FIELD_LINE

FORMAT = "grid_arrays"
CHUNK_STEPS = 100
TEMPORARY = "_temporary"
#: Cells that one batch of lines holds.
BATCH_BYTES = 4 << 20
#: Bytes that one task reads, and the number of tasks that are wanted first.
TASK_BYTES, TASKS = 32 << 20, 256
#: One frame of a part per row: its place in the file, the file's number of frames, and the cells by channel, x and y.
FRAME = "dataset string, part int, t int, frames int, nx int, ny int, u_x array<double>, u_y array<double>"


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a URI or of an absolute local path."""
    return fs.FileSystem.from_uri(uri)


@dataclass
class Header:
    shape: tuple[int, ...]
    dtype: np.dtype
    start: int

    @classmethod
    def of(cls, file: pa.NativeFile, name: str) -> Header:
        """The header of an open file; anything but a (T, 2, X, Y) array in C order is refused."""
        lead = file.read(12)
        size = 10 + int.from_bytes(lead[8:10], "little") if lead[6:7] == b"\x01" else 12 + int.from_bytes(lead[8:12], "little")
        raw = io.BytesIO(lead + file.read(size - 12))
        version = np.lib.format.read_magic(raw)
        read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
        shape, fortran, dtype = read(raw)
        if len(shape) != 4 or shape[1] != 2 or fortran:
            raise ValueError(f"{name}: expected (T, 2, X, Y) in C order, got {shape}{' in Fortran order' if fortran else ''}")
        return cls(shape, dtype, size)

    def frames(self, file: pa.NativeFile, t0: int, t1: int) -> Iterator[np.ndarray]:
        """The frames of steps t0 to t1, read one by one."""
        size = int(np.prod(self.shape[1:])) * self.dtype.itemsize
        file.seek(self.start + t0 * size)
        for _ in range(t0, t1):
            raw = file.read(size)
            if len(raw) != size:
                raise ValueError("array file ends before its header says")
            yield np.frombuffer(raw, self.dtype).reshape(self.shape[1:]).astype(np.float64)


def named(path: str) -> tuple[str, int]:
    """(dataset, first step) of a file's name."""
    stem = posixpath.basename(path).rsplit(".", 1)[0]
    name, _, offset = stem.partition("@")
    return name, int(offset or 0)


def batches_of(path: str, dataset: str, offset: int, t0: int, t1: int) -> Iterator[pa.RecordBatch]:
    """Field lines of steps t0 to t1, as many whole frames in a batch as `BATCH_BYTES` hold, one at least."""
    system, place = opened(path)
    with system.open_input_file(place) as file:
        header = Header.of(file, path)
        _, channels, nx, ny = header.shape
        many = max(1, BATCH_BYTES // max(1, 8 * channels * nx * ny))
        frames = header.frames(file, t0, t1)
        for start in range(t0, t1, many):
            block = np.stack(list(islice(frames, many)))
            t = np.repeat(np.arange(offset + start, offset + start + len(block), dtype=np.int32), nx)
            x = np.tile(np.arange(nx, dtype=np.int32), len(block))
            names = pa.array([dataset] * len(t))
            yield pa.RecordBatch.from_arrays(
                [names, pa.array(t), pa.array(x), _rows(block[:, 0].reshape(-1, ny)), _rows(block[:, 1].reshape(-1, ny))],
                names=["dataset", "t", "x", "u_x", "u_y"],
            )


def _rows(values: np.ndarray) -> pa.Array:
    ends = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.ravel()))


@dataclass
class Slice:
    path: str
    dataset: str
    offset: int
    t0: int
    t1: int


@dataclass
class Slices(InputPartition):
    """What one task reads."""

    slices: list[Slice]


def packed(sized: list[tuple[Slice, int]]) -> list[Slices]:
    """Slices and their bytes as partitions of up to `TASK_BYTES`, or of less, to have `TASKS` of them: a task costs more
    than a small slice. A slice is never cut."""
    most = min(TASK_BYTES, sum(size for _, size in sized) / TASKS)
    out, held = [], 0
    for piece, size in sized:
        if not out or held + size > most:
            out.append(Slices([]))
            held = 0
        out[-1].slices.append(piece)
        held += size
    return out


def files(uri: str, excluded: Sequence[str] = ()) -> list[str]:
    """URIs of the array files below a folder, or of one file, without those whose name is excluded."""
    system, place = opened(uri)
    info = system.get_file_info(place)
    found = system.get_file_info(fs.FileSelector(place, recursive=True)) if info.type == fs.FileType.Directory else [info]
    prefix = uri.rstrip("/")[: len(uri.rstrip("/")) - len(place.rstrip("/"))]
    paths = sorted(f.path for f in found if f.type == fs.FileType.File and f.path.endswith(".npy") and f"/{TEMPORARY}/" not in f.path)
    return [prefix + p for p in paths if posixpath.basename(p) not in excluded]


class _Reader(DataSourceReader):
    def __init__(self, folder: str, steps: int, excluded: Sequence[str]) -> None:
        self.folder, self.steps, self.excluded = folder, steps, excluded

    def partitions(self) -> list[Slices]:
        found = []
        for path in files(self.folder, self.excluded):
            system, place = opened(path)
            with system.open_input_file(place) as file:
                header = Header.of(file, path)
            n, frame = header.shape[0], int(np.prod(header.shape[1:])) * header.dtype.itemsize
            ends = [(t, min(t + self.steps, n)) for t in range(0, n, self.steps)]
            found += [(Slice(path, *named(path), *span), (span[1] - span[0]) * frame) for span in ends]
        return packed(found) or [Slices([])]

    def read(self, partition: Slices) -> Iterator[pa.RecordBatch]:
        for s in partition.slices:
            yield from batches_of(s.path, s.dataset, s.offset, s.t0, s.t1)


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class _Writer(DataSourceArrowWriter):
    """Writes frames (`FRAME`) that come ordered by dataset, part and t."""

    def __init__(self, folder: str, overwrite: bool) -> None:
        self.folder, self.overwrite, self.job = folder, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        system, place = opened(self.folder)
        context = TaskContext.get()
        own = f"{place}/{TEMPORARY}/{self.job}/{context.partitionId()}-{context.taskAttemptId()}"
        system.create_dir(own, recursive=True)
        files, file, left, now = [], None, 0, None
        for batch in iterator:
            # Cells stay in Arrow: a list of them would hold a Python number for each.
            rows = batch.select(["dataset", "part", "t", "frames", "nx", "ny"]).to_pylist()
            cells = {c: (batch.column(c).flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(batch.column(c).value_lengths().to_numpy())))) for c in ("u_x", "u_y")}
            for i, row in enumerate(rows):
                if file is None:
                    now, left = (row["dataset"], row["part"]), row["frames"]
                    name = f"{row['dataset']}@{row['t']}.npy"
                    files.append((f"{own}/{name}", f"{place}/{name}"))
                    file = system.open_output_stream(f"{own}/{name}")
                    head = io.BytesIO()
                    np.lib.format.write_array_header_1_0(head, {"descr": "<f8", "fortran_order": False, "shape": (left, 2, row["nx"], row["ny"])})
                    file.write(head.getvalue())
                if (row["dataset"], row["part"]) != now:
                    raise ValueError(f"part {now} lacks {left} frames")
                for values, ends in cells.values():
                    if ends[i + 1] - ends[i] != row["nx"] * row["ny"]:
                        raise ValueError(f"{row['dataset']}: frame {row['t']} has {ends[i + 1] - ends[i]} of {row['nx'] * row['ny']} cells")
                    file.write(np.ascontiguousarray(values[ends[i] : ends[i + 1]], "<f8").tobytes())
                left -= 1
                if not left:
                    file.close()
                    file = None
        if file is not None:
            raise ValueError(f"part {now} lacks {left} frames")
        return _Written(files)

    def commit(self, messages: list[_Written | None]) -> None:
        system, place = opened(self.folder)
        files = [f for m in messages if m is not None for f in m.files]
        if self.overwrite:
            kept = {final for _, final in files}
            for info in system.get_file_info(fs.FileSelector(place)):
                if info.path.endswith(".npy") and info.path not in kept:
                    system.delete_file(info.path)
        for temporary, final in files:
            system.move(temporary, final)
        self.abort(messages)

    def abort(self, messages: list[_Written | None]) -> None:
        system, place = opened(self.folder)
        own = f"{place}/{TEMPORARY}/{self.job}"
        if system.get_file_info(own).type == fs.FileType.Directory:
            system.delete_dir(own)


class ArrayFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return FIELD_LINE

    def reader(self, schema: T.StructType) -> DataSourceReader:
        steps = int(self.options.get("chunk_steps", CHUNK_STEPS))
        if steps < 1:
            raise ValueError(f"chunk_steps must be >= 1, got {steps}")
        return _Reader(self.options["path"], steps, json.loads(self.options.get("excluded", "[]")))

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], overwrite)


def read_arrays(spark: SparkSession, uri: str, chunk_steps: int = CHUNK_STEPS, excluded: Sequence[str] = ()) -> DataFrame:
    """Field lines of all array files below a folder, or of one file; files of excluded names are left out."""
    spark.dataSource.register(ArrayFiles)
    return spark.read.format(FORMAT).option("chunk_steps", chunk_steps).option("excluded", json.dumps(list(excluded))).load(uri)


def write_arrays(field: DataFrame, uri: str, chunk_steps: int = CHUNK_STEPS, overwrite: bool = False) -> None:
    """Dense (T, 2, X, Y) parts of at most `chunk_steps` steps, each written by one task, a frame at a time."""
    field.sparkSession.dataSource.register(ArrayFiles)
    part = F.floor(F.col("t") / chunk_steps).cast("int")
    frames = field.groupBy("dataset", "t").agg(
        F.array_sort(F.collect_list(F.struct("x", "y", "u_x", "u_y"))).alias("c"),
        (F.max("x") + 1).alias("nx"), (F.max("y") + 1).alias("ny"),
    ).select(
        "dataset", part.alias("part"), "t", "nx", "ny", F.col("c.u_x").alias("u_x"), F.col("c.u_y").alias("u_y")
    )
    counted = frames.withColumn("frames", F.count("*").over(Window.partitionBy("dataset", "part")).cast("int"))
    ordered = counted.repartition("dataset", "part").sortWithinPartitions("dataset", "part", "t")
    shaped = ordered.select(*[F.col(f.name).cast(f.dataType) for f in T.StructType.fromDDL(FRAME)])
    shaped.write.format(FORMAT).mode("overwrite" if overwrite else "append").save(uri)
