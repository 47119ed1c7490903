"""Reductions over frames (one value per pixel) and over pixels (one value per frame).

Per-pixel reductions have two plans. ``expr``: pixel form and a grouped aggregate; Catalyst combines on the map side,
so one row per pixel and task is shuffled. ``kernel``: each task folds its frames into one partial vector with array
operations, and only the partials are exploded and merged; for large frames this avoids a row per pixel and frame.
``auto`` takes the kernel from ``KERNEL_PX`` pixels on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.cube import Cube

KERNEL_PX = 1024


def frames_of(batch: pa.RecordBatch, name: str = "frame") -> np.ndarray:
    """A batch's frames as a matrix."""
    lists = batch.column(batch.schema.get_field_index(name))
    flat = np.array(lists.flatten(), np.float64)
    return flat.reshape(len(lists), -1) if len(lists) else flat.reshape(0, 0)


def _kernel(cube: Cube, method: str) -> bool:
    return not cube.complex and (method == "kernel" or method == "auto" and cube.n_px >= KERNEL_PX)


#: Partial vectors merged by one task before they are exploded into pixels.
FAN = 32
_VECTORS = "n long, mean array<double>, m2 array<double>, total array<double>"


class _Moments:
    """Count, mean, squared deviations and sum of each pixel; merging is exact in any grouping up to rounding."""

    def __init__(self) -> None:
        self.n, self.mean, self.m2, self.total = 0, None, None, None

    def add(self, n: int, mean: np.ndarray, m2: np.ndarray, total: np.ndarray) -> None:
        if not n:
            return
        if self.mean is None:
            self.n, self.mean, self.m2, self.total = n, mean.copy(), m2.copy(), total.copy()
            return
        delta, both = mean - self.mean, self.n + n
        self.m2 += m2 + delta**2 * (self.n * n / both)
        self.mean += delta * (n / both)
        self.total += total
        self.n = both

    def rows(self) -> Iterator[pa.RecordBatch]:
        if self.mean is not None:
            yield pa.record_batch([pa.array([self.n], pa.int64()), *(pa.array([v.tolist()], pa.list_(pa.float64())) for v in (self.mean, self.m2, self.total))], ["n", "mean", "m2", "total"])


def _partials(cube: Cube) -> DataFrame:
    """px, n, mean, m2, total: one row per pixel and task (of at most ``FAN`` groups of tasks)."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Moments()
        for batch in batches:
            x = frames_of(batch)
            if len(x):
                total = x.sum(axis=0)
                mean = total / len(x)
                x -= mean
                out.add(len(x), mean, np.einsum("ij,ij->j", x, x), total)
        yield from out.rows()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Moments()
        for batch in batches:
            vectors = [frames_of(batch, c) for c in ("mean", "m2", "total")]
            for n, *parts in zip(batch.column(0).to_pylist(), *vectors, strict=True):
                out.add(n, *parts)
        yield from out.rows()

    rows = cube.mapped(fold, _VECTORS)
    tasks = 0 if cube.df.isStreaming else rows.rdd.getNumPartitions()
    while tasks > FAN:
        tasks = -(-tasks // FAN)
        rows = rows.repartition(tasks).mapInArrow(merge, _VECTORS)
    both = rows.select("n", F.posexplode(F.arrays_zip("mean", "m2", "total")).alias("px", "s"))
    return both.select(F.col("px").cast("long").alias("px"), "n", "s.mean", "s.m2", "s.total")


def _folded(cube: Cube, names: list[str], of, join, how) -> DataFrame:  # noqa: ANN001
    """px and ``names``: vectors that each task makes of its frames (``of`` a batch), joined by ``join`` in a tree; ``how`` is the aggregate of what is left."""
    schema = ", ".join(f"{n} array<double>" for n in names)

    def rows_of(total: list[np.ndarray] | None) -> Iterator[pa.RecordBatch]:
        if total is not None:
            yield pa.record_batch([pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v)) for v in total], names)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            x = frames_of(batch)
            if len(x):
                own = of(x)
                total = own if total is None else [join(a, b) for a, b in zip(total, own, strict=True)]
        yield from rows_of(total)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for own in zip(*(frames_of(batch, n) for n in names), strict=True):
                total = list(own) if total is None else [join(a, b) for a, b in zip(total, own, strict=True)]
        yield from rows_of(total)

    rows = cube.mapped(fold, schema)
    tasks = 0 if cube.df.isStreaming else rows.rdd.getNumPartitions()
    while tasks > FAN:
        tasks = -(-tasks // FAN)
        rows = rows.repartition(tasks).mapInArrow(merge, schema)
    flat = rows.select(F.posexplode(F.arrays_zip(*names)).alias("px", "s"))
    return flat.groupBy(F.col("px").cast("long").alias("px")).agg(*[how(F.col(f"s.{n}")).alias(n) for n in names])


def sum_frames(cube: Cube, method: str = "auto") -> DataFrame:
    """px, intensity (and intensity_im): sum over frames."""
    if _kernel(cube, method):
        return _partials(cube).groupBy("px").agg(F.sum("total").alias("intensity"))
    out = [F.sum(F.col("v").cast("double")).alias("intensity")] + ([F.sum("v_im").alias("intensity_im")] if cube.complex else [])
    return cube.pixels().groupBy("px").agg(*out)


def sum_sig(cube: Cube) -> DataFrame:
    """frame_id, intensity: sum over pixels; a projection, no shuffle."""
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x.cast("double"))
    return cube.df.select("frame_id", total("frame").alias("intensity"), *([total("frame_im").alias("intensity_im")] if cube.complex else []))


def logsum(cube: Cube, method: str = "auto") -> DataFrame:
    """px, logsum: sum over frames of ln(x - least pixel of the frame + 1)."""
    if _kernel(cube, method):
        return _folded(cube, ["logsum"], lambda x: [np.log(x - x.min(axis=1, keepdims=True) + 1).sum(axis=0)], np.add, F.sum)
    shifted = cube.df.select(F.array_min("frame").cast("double").alias("low"), F.posexplode("frame").alias("px", "v"))
    return shifted.groupBy(F.col("px").cast("long").alias("px")).agg(F.sum(F.log(F.col("v").cast("double") - F.col("low") + 1)).alias("logsum"))


def stddev(cube: Cube, method: str = "auto") -> DataFrame:
    """px, num_frames, sum, mean, varsum, var, std: population statistics over frames.

    Of complex cubes the spread is that of both parts together, and sum_im, mean_im are there too.
    """
    if _kernel(cube, method):
        # at most FAN partial means of a pixel: few enough to be listed
        merged = _partials(cube).groupBy("px").agg(F.sum("n").alias("num_frames"), F.sum("total").alias("sum"), F.sum("m2").alias("within"), _between(F.col("n"), F.col("mean")).alias("between"))
        spread = merged.withColumn("mean", F.col("sum") / F.col("num_frames")).withColumn("varsum", F.col("within") + F.col("between"))
    else:
        v = F.col("v").cast("double")
        aggs = [F.count(F.lit(1)).alias("num_frames"), F.sum(v).alias("sum"), F.avg(v).alias("mean"), F.var_pop(v).alias("_v")]
        if cube.complex:
            aggs += [F.sum("v_im").alias("sum_im"), F.avg("v_im").alias("mean_im"), F.var_pop("v_im").alias("_w")]
        var = F.col("_v") + (F.col("_w") if cube.complex else F.lit(0.0))
        spread = cube.pixels().groupBy("px").agg(*aggs).withColumn("varsum", var * F.col("num_frames"))
    out = spread.withColumn("var", F.col("varsum") / F.col("num_frames")).withColumn("std", F.sqrt("var"))
    return out.select("px", "num_frames", "sum", "mean", "varsum", "var", "std", *(c for c in ("sum_im", "mean_im") if c in out.columns))


def _between(n: Column, mean: Column) -> Column:
    """Spread of partial means around their weighted mean: the weighted second moment about a first pass's mean."""
    pairs = F.collect_list(F.struct(n.alias("n"), mean.alias("m")))
    total = F.aggregate(pairs, F.lit(0.0), lambda a, p: a + p["n"])
    centre = F.aggregate(pairs, F.lit(0.0), lambda a, p: a + p["n"] * p["m"]) / total
    return F.aggregate(pairs, F.lit(0.0), lambda a, p: a + p["n"] * F.pow(p["m"] - centre, F.lit(2.0)))


def max_frame(cube: Cube, floor: float | None = 0.0, method: str = "auto") -> DataFrame:
    """px, intensity: maximum over frames, not below ``floor`` (None: no floor)."""
    if _kernel(cube, method):
        low = -np.inf if floor is None else floor
        return _folded(cube, ["intensity"], lambda x: [np.maximum(x.max(axis=0), low)], np.maximum, F.max)
    top = F.max(F.col("v").cast("double"))
    return cube.pixels().groupBy("px").agg((top if floor is None else F.greatest(F.lit(floor), top)).alias("intensity"))


def frame_stats(cube: Cube) -> DataFrame:
    """frame_id, mean, min, max, std (population) of each frame; a projection."""
    n = F.size("frame").cast("double")
    mean = F.aggregate("frame", F.lit(0.0), lambda a, x: a + x.cast("double")) / n
    rows = cube.df.select("frame_id", "frame", mean.alias("mean"))
    spread = F.aggregate(F.transform("frame", lambda x: F.pow(x.cast("double") - F.col("mean"), F.lit(2.0))), F.lit(0.0), lambda a, x: a + x)
    return rows.select("frame_id", "mean", F.array_min("frame").cast("double").alias("min"), F.array_max("frame").cast("double").alias("max"), F.sqrt(spread / n).alias("std"))


def threshold_sum(cube: Cube, threshold: float, method: str = "auto") -> DataFrame:
    """px, intensity: sum over frames of the values above ``threshold``; pixels without one are absent."""
    if _kernel(cube, method):
        found = _folded(cube, ["intensity", "n"], lambda x: [np.where(x > threshold, x, 0.0).sum(axis=0), (x > threshold).sum(axis=0).astype(float)], np.add, F.sum)
        return found.filter("n > 0").drop("n")
    return cube.pixels().filter(F.col("v") > threshold).groupBy("px").agg(F.sum(F.col("v").cast("double")).alias("intensity"))


def pick_pixel(cube: Cube, *coords: int) -> DataFrame:
    """frame_id, intensity of one pixel."""
    px = int(np.ravel_multi_index(coords, cube.sig_shape))
    return cube.df.select("frame_id", F.element_at("frame", px + 1).alias("intensity"))


def pick(cube: Cube) -> DataFrame:
    """The selected frames themselves, with navigation coordinates."""
    return cube.with_nav()


def coordinates(cube: Cube) -> DataFrame:
    """frame_id and navigation coordinates of the frames that are there."""
    return cube.with_nav(cube.df.select("frame_id"))


def count_frames(cube: Cube) -> DataFrame:
    """px, num_frames: every frame has every pixel, so frames are counted and no pixel is read."""
    counted = cube.df.agg(F.count(F.lit(1)).alias("num_frames"))
    return counted.filter("num_frames > 0").select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cube.n_px - 1).cast("long"))).alias("px"), "num_frames")


def no_op(cube: Cube) -> None:
    """Reads everything and returns nothing."""
    cube.df.write.format("noop").mode("overwrite").save()


def bin_pixels(cube: Cube, size: int) -> DataFrame:
    """frame_id, bin_y, bin_x, v: mean over blocks of ``size`` x ``size`` pixels, smaller ones at the far edges.

    Frames are binned where they are; nothing is shuffled.
    """
    height, width = cube.sig_shape
    at_y, at_x = np.arange(0, height, size), np.arange(0, width, size)
    area = np.outer(np.diff(np.append(at_y, height)), np.diff(np.append(at_x, width)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = frames_of(batch).reshape(-1, height, width)
                out = np.add.reduceat(np.add.reduceat(x, at_y, axis=1), at_x, axis=2) / area
                yield pa.record_batch([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * area.size, pa.int32()), pa.array(out.reshape(-1)))], ["frame_id", "bins"])

    rows = cube.mapped(run, "frame_id long, bins array<double>").select("frame_id", F.posexplode("bins").alias("k", "v"))
    return rows.select("frame_id", F.floor(F.col("k") / len(at_x)).cast("int").alias("bin_y"), (F.col("k") % len(at_x)).cast("int").alias("bin_x"), "v")
