"""Sources: binary detector formats as a Spark data source, tables, and arrays.

``register(spark)`` makes ``spark.read.format("gridloom")`` available: the driver reads headers only, each input
partition is a range of frames, and a range predicate on frame_id narrows the ranges before anything is read.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import asdict, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from gridloom.cube import Cube
from gridloom.session import ship

from .formats import REGISTRY, Format, FormatError, Layout, RawCSR

__all__ = ["FormatError", "FrameSource", "Layout", "detect", "load", "register", "register_format", "unregister_format"]

#: Bytes of decoded frames of one input partition.
PARTITION_BYTES = 128 * 1024 * 1024
#: Bytes of a partition at least, where more partitions than those would only serve to use all cores.
LEAST_BYTES = 16 * 1024 * 1024
#: Bytes of one Arrow batch.
BATCH_BYTES = 8 * 1024 * 1024


#: Column types that hold a file's pixels without loss, by kind and size (there are no unsigned ones); others are double.
NATIVE = {"u1": "smallint", "i1": "tinyint", "u2": "int", "i2": "smallint", "u4": "bigint", "i4": "int", "i8": "bigint", "f4": "float", "c8": "float"}
ARROW = {"tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64(), "float": pa.float32(), "double": pa.float64()}


def column_type(dtype: str) -> str:
    """The element type of a frame column for a file's dtype."""
    kind = np.dtype(dtype)
    return NATIVE.get(f"{kind.kind}{kind.itemsize}", "double")


class FrameRange(InputPartition):
    def __init__(self, start: int, stop: int) -> None:
        super().__init__((start, stop))
        self.start, self.stop = start, stop


class FrameReader(DataSourceReader):
    def __init__(self, layout: dict, partitions: int | None, kind: str | None = None) -> None:
        self.layout = layout
        self.kind = kind or column_type(layout["dtype"])
        self.wanted = partitions
        self.low, self.high = 0, layout["n_frames"]

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Takes range predicates on frame_id; everything else is left to Spark."""
        for f in filters:
            if getattr(f, "attribute", None) == ("frame_id",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if isinstance(f, (EqualTo, GreaterThanOrEqual)):
                    self.low = max(self.low, int(f.value))
                if isinstance(f, GreaterThan):
                    self.low = max(self.low, int(f.value) + 1)
                if isinstance(f, (EqualTo, LessThanOrEqual)):
                    self.high = min(self.high, int(f.value) + 1)
                if isinstance(f, LessThan):
                    self.high = min(self.high, int(f.value))
            else:
                yield f

    def partitions(self) -> list[FrameRange]:
        n = self.high - self.low
        if n <= 0:
            return [FrameRange(0, 0)]
        size = ARROW[self.kind].bit_width // 8 * int(np.prod(self.layout["sig_shape"]))
        parts = self.wanted or max(1, -(-n * size // PARTITION_BYTES))
        cuts = np.linspace(self.low, self.high, min(parts, n) + 1).astype(int)
        return [FrameRange(int(a), int(b)) for a, b in zip(cuts, cuts[1:], strict=False)]

    def read(self, partition: FrameRange) -> Iterator[pa.RecordBatch]:
        layout = Layout(**self.layout)
        kind = REGISTRY[layout.format]
        stored = ARROW[self.kind]
        step = max(1, BATCH_BYTES // (stored.bit_width // 8 * layout.n_px))
        for a in range(partition.start, partition.stop, step):
            b = min(a + step, partition.stop)
            x = kind.frames(layout, a, b)
            columns = [pa.array(np.arange(a, b), pa.int64())]
            offsets = pa.array(np.arange(b - a + 1, dtype=np.int32) * layout.n_px)
            for part in (x.real, x.imag) if np.iscomplexobj(x) else (x,):
                columns.append(pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(part, stored.to_pandas_dtype()).reshape(-1))))
            yield pa.record_batch(columns, ["frame_id", "frame", "frame_im"][: len(columns)])


class FrameStream(DataSourceStreamReader):
    """Frames of a file that grows: each micro-batch has the whole frames that have arrived since the last one."""

    def __init__(self, options: dict) -> None:
        self.options = options
        self.most = int(options.get("framespertrigger", 0))
        self.sent = 0

    def _layout(self) -> Layout:
        return REGISTRY[self.options["format"]].open(self.options["path"], **json.loads(self.options.get("open", "{}")))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"frame": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        there = self._layout().n_frames
        self.sent = min(there, self.sent + self.most) if self.most else there
        return {"frame": self.sent}

    def partitions(self, start: dict, end: dict) -> list[FrameRange]:
        self.sent = max(self.sent, end["frame"])
        reader = FrameReader(asdict(self._layout()), None, "double")
        reader.low, reader.high = start["frame"], end["frame"]
        return reader.partitions()

    def read(self, partition: FrameRange) -> Iterator[pa.RecordBatch]:
        return FrameReader(asdict(self._layout()), None, "double").read(partition)

    def commit(self, end: dict) -> None:
        """Nothing is held back."""


class FrameSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gridloom"

    def schema(self) -> str:
        dtype = json.loads(self.options["layout"])["dtype"] if "layout" in self.options else "f8"
        kind = column_type(dtype) if "layout" in self.options else "double"
        im = f", frame_im array<{kind}>" if np.dtype(dtype).kind == "c" else ""
        return f"frame_id long, frame array<{kind}>" + im

    def reader(self, schema: StructType) -> FrameReader:
        parts = self.options.get("partitions")
        return FrameReader(json.loads(self.options["layout"]), int(parts) if parts else None)

    def streamReader(self, schema: StructType) -> FrameStream:  # noqa: N802
        return FrameStream(dict(self.options))


def register(spark: SparkSession) -> None:
    ship(spark).dataSource.register(FrameSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def register_format(name: str, cls: type[Format]) -> None:
    REGISTRY[name] = cls


def unregister_format(name: str) -> None:
    del REGISTRY[name]


def detect(path: str) -> str | None:
    """The format of a file; formats with the file's extension are tried first."""
    ext = os.path.splitext(path)[1].lstrip(".").lower()
    for name, cls in sorted(REGISTRY.items(), key=lambda kv: ext not in kv[1].extensions):
        if cls.detect(path):
            return name
    return None


def load(spark: SparkSession, filetype: str, path: str | None = None, *, sync_offset: int = 0, num_partitions: int | None = None, data: np.ndarray | None = None, datashape: tuple[int, ...] | None = None, sig_dims: int = 2, **options) -> Cube:  # noqa: ANN003
    """A cube from a file (``filetype`` may be ``auto``) or from memory (``memory`` with ``data`` or ``datashape``)."""
    if filetype == "memory":
        array = np.zeros(datashape, np.float32) if data is None else np.asarray(data)
        return Cube.from_numpy(spark, array, sig_dims).synced(sync_offset)
    if filetype == "auto":
        filetype = detect(path)
        if filetype is None:
            raise FormatError(f"cannot tell the format of {path}")
    if filetype not in REGISTRY:
        raise FormatError(f"unknown format {filetype!r}")
    layout = REGISTRY[filetype].open(path, **options)
    if int(np.prod(layout.nav_shape)) > layout.n_frames + abs(sync_offset):
        raise FormatError(f"{layout.n_frames} frames for {layout.nav_shape}")
    register(spark)
    size = ARROW[column_type(layout.dtype)].bit_width // 8 * layout.n_frames * layout.n_px
    if not num_partitions:  # small files still use the cores there are
        num_partitions = max(1, -(-size // PARTITION_BYTES), min(spark.sparkContext.defaultParallelism, size // LEAST_BYTES))
    df = spark.read.format("gridloom").option("layout", json.dumps(asdict(layout))).option("partitions", num_partitions).load()
    shape = tuple(layout.nav_shape)
    cube = Cube(df, shape, tuple(layout.sig_shape), np.dtype(layout.dtype).kind == "c", REGISTRY[filetype].found_corrections(path))
    if cube.n_frames == layout.n_frames:
        cube = replace(cube, origin=(df, asdict(layout), num_partitions, ()))
    if sync_offset:
        return cube.synced(sync_offset)
    return cube if cube.n_frames == layout.n_frames else replace(cube, df=df.filter(f"frame_id < {cube.n_frames}"))


def follow(spark: SparkSession, filetype: str, path: str, nav_shape: tuple[int, ...], sig_shape: tuple[int, ...], frames_per_trigger: int = 0, **options) -> Cube:  # noqa: ANN003
    """A streaming cube of a file that is being written (formats that can be opened while they grow, such as raw)."""
    register(spark)
    stream = spark.readStream.format("gridloom").option("format", filetype).option("path", path)
    opened = {k: v for k, v in {**options, "sig_shape": sig_shape}.items() if v is not None}
    df = stream.option("open", json.dumps(opened)).option("framesPerTrigger", frames_per_trigger).load()
    return Cube(df, tuple(nav_shape), tuple(sig_shape))


def csr_pixels(spark: SparkSession, path: str, **options):  # noqa: ANN003, ANN201
    """A sparse file as pixel rows (frame_id, px, v), without making frames dense."""
    layout = RawCSR.open(path, **options)
    ranges = spark.range(0, layout.n_frames, 1, max(1, layout.n_frames // 4096))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ids = np.asarray(batch.column(0))
                ptr, indices, values = RawCSR.rows(layout, int(ids[0]), int(ids[-1]) + 1)
                yield pa.record_batch([pa.array(np.repeat(ids, np.diff(ptr))), pa.array(indices), pa.array(values.astype(np.float64))], ["frame_id", "px", "v"])

    return ship(spark) and ranges.mapInArrow(run, "frame_id long, px long, v double")
