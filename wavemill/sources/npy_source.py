"""`.npy` arrays as a Spark data source that is read by ranges.

`spark.read.format("npy_epochs")` plans its partitions from the files' headers: a partition is a range of a file's first
axis, of about `bytes_per_task` bytes, and a task reads the bytes of its range and nothing else. Filters on `file_pos` and
`recording` reach the plan: files and ranges that they rule out are not planned. Arrays of one axis (labels) come as
(recording, file_pos, y), those of three (epochs, channels, samples) as a row per epoch and channel.

Options: path (a folder), suffix (the end of the files' names, which `recording` leaves out), depth (folders between path
and files; unset: any), beside (only files that have a neighbour with this suffix), bytes_per_task. Stores are those that
Arrow opens by their address; `opens` tells. Arrays in Fortran order and of objects are refused.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

EPOCHS, LABELS = "recording string, file_pos long, channel int, samples array<double>", "recording string, file_pos long, y int"
BYTES_PER_TASK, HEADER_BYTES = 64 << 20, 1 << 16


@dataclass
class EpochRange(InputPartition):
    address: str
    recording: str
    offset: int
    first: int
    count: int
    dtype: str
    shape: tuple[int, ...]  # of one entry of the first axis


def opens(address: str) -> bool:
    """Does Arrow know the store of this address?"""
    try:
        fs.FileSystem.from_uri(address) if "://" in address or address.startswith("file:") else fs.LocalFileSystem()
    except (pa.ArrowException, OSError, ValueError):
        return False
    return True


def _store(address: str) -> tuple[fs.FileSystem, str, str]:
    """The file system, the path in it, and what comes before the path in an address."""
    if "://" not in address and not address.startswith("file:"):
        return fs.LocalFileSystem(), address, ""
    system, path = fs.FileSystem.from_uri(address)
    return system, path, address[: len(address) - len(path)] if address.endswith(path) else ""


def header(raw: bytes) -> tuple[int, tuple[int, ...], np.dtype]:
    """Where an array's bytes begin, its shape and its type, from the first bytes of its file."""
    stream = io.BytesIO(raw)
    read = {1: np.lib.format.read_array_header_1_0, 2: np.lib.format.read_array_header_2_0}.get(np.lib.format.read_magic(stream)[0])
    if read is None:
        raise ValueError("unknown version of the .npy format")
    shape, fortran, dtype = read(stream)
    if dtype.hasobject:
        raise ValueError("arrays of objects need pickle, which is not read (allow_pickle=False)")
    if fortran and len(shape) > 1:
        raise ValueError("arrays in Fortran order can't be read by ranges")
    return stream.tell(), tuple(shape), dtype


class NpyReader(DataSourceReader):
    def __init__(self, options: dict[str, str], labels: bool):
        self.path, self.suffix, self.beside = options["path"].rstrip("/"), options.get("suffix", ".npy"), options.get("beside")
        self.depth, self.each = int(options.get("depth", -1)), int(options.get("bytes_per_task", BYTES_PER_TASK))
        self.labels, self.low, self.high, self.recordings = labels, 0, None, None

    def pushFilters(self, filters):
        """Bounds on file_pos and sets of recordings are kept for the plan; Spark checks all filters again."""
        for f in filters:
            name, value = getattr(f, "attribute", ()), getattr(f, "value", None)
            if name == ("file_pos",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                self.low = max(self.low, value + isinstance(f, GreaterThan))
            if name == ("file_pos",) and isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                stop = value + (not isinstance(f, LessThan))
                self.high = stop if self.high is None else min(self.high, stop)
            if name == ("recording",) and isinstance(f, (EqualTo, In)):
                allowed = set(value if isinstance(f, In) else [value])
                self.recordings = allowed if self.recordings is None else self.recordings & allowed
            yield f

    def _files(self, system: fs.FileSystem, root: str) -> Iterator[str]:
        found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        paths = {f.path for f in found if f.type == fs.FileType.File}
        for path in sorted(paths):
            inner = path[len(root) :].strip("/")
            if path.endswith(self.suffix) and (self.depth < 0 or inner.count("/") == self.depth):
                if self.beside is None or path[: -len(self.suffix)] + self.beside in paths:
                    yield path

    def partitions(self) -> list[EpochRange]:
        system, root, before = _store(self.path)
        out = []
        for path in self._files(system, root):
            recording = before + path[: -len(self.suffix)]
            if self.recordings is not None and recording not in self.recordings:
                continue
            with system.open_input_file(path) as f:
                offset, shape, dtype = header(f.read(HEADER_BYTES))
            inner = shape[1:]
            if len(inner) != (0 if self.labels else 2):
                raise ValueError(f"{path}: an array of {len(shape)} axes")
            size = dtype.itemsize * int(np.prod(inner, dtype=np.int64))
            step = max(self.each // max(size, 1), 1)
            for first in range(self.low, min(shape[0], shape[0] if self.high is None else self.high), step):
                count = min(step, shape[0] - first, (shape[0] if self.high is None else self.high) - first)
                out.append(EpochRange(before + path, recording, offset + first * size, first, count, dtype.str, inner))
        return out or [EpochRange("", "", 0, 0, 0, "<f8", ())]

    def read(self, partition: EpochRange) -> Iterator[pa.RecordBatch]:
        p = partition
        if not p.count:
            return
        system, path, _ = _store(p.address)
        dtype = np.dtype(p.dtype)
        size = dtype.itemsize * int(np.prod(p.shape, dtype=np.int64))
        slice_ = max((4 << 20) // max(size, 1), 1)
        with system.open_input_file(path) as f:
            f.seek(p.offset)
            for at in range(0, p.count, slice_):
                n = min(slice_, p.count - at)
                raw = f.read(n * size)
                if len(raw) < n * size:
                    raise ValueError(f"{p.address} ends before epoch {p.first + at + n}")
                block = np.frombuffer(raw, dtype).reshape(n, *p.shape)
                place = np.arange(p.first + at, p.first + at + n)
                if self.labels:
                    yield pa.RecordBatch.from_arrays([pa.array([p.recording] * n), pa.array(place), pa.array(block.astype(np.int32))], names=["recording", "file_pos", "y"])
                    continue
                channels, samples = p.shape
                values = pa.array(block.astype(float).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n * channels + 1, dtype=np.int32) * samples), values)
                yield pa.RecordBatch.from_arrays([pa.array([p.recording] * (n * channels)), pa.array(np.repeat(place, channels)), pa.array(np.tile(np.arange(channels, dtype=np.int32), n)), lists], names=["recording", "file_pos", "channel", "samples"])


class NpyEpochs(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npy_epochs"

    def schema(self) -> str:
        return EPOCHS

    def reader(self, schema) -> NpyReader:
        return NpyReader(dict(self.options), labels=False)


class NpyLabels(NpyEpochs):
    @classmethod
    def name(cls) -> str:
        return "npy_labels"

    def schema(self) -> str:
        return LABELS

    def reader(self, schema) -> NpyReader:
        return NpyReader(dict(self.options), labels=True)


def has_files(path: str, suffix: str, beside: str, depth: int) -> bool:
    """Is there a file with its neighbour? Only names are looked at."""
    reader = NpyReader({"path": path, "suffix": suffix, "beside": beside, "depth": str(depth)}, labels=False)
    system, root, _ = _store(reader.path)
    return next(reader._files(system, root), None) is not None


def register(spark: SparkSession) -> None:
    """The formats npy_epochs and npy_labels, with filters pushed into the plan."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(NpyEpochs)
    spark.dataSource.register(NpyLabels)
