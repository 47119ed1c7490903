"""Detector corrections: dark subtraction, gain, and repair of excluded pixels.

Value after correction: (x - dark) * gain; then each excluded pixel becomes the mean of those neighbours (all of the
3^d - 1 around it that are in the frame) that are not excluded. The plan is a join of the pixel form with two small
side tables, or for whole frames one pass per Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.cube import Cube
from gridloom.operators.reduce import frames_of


class RepairError(ValueError):
    """An excluded pixel has no neighbour to be repaired from."""


@dataclass(frozen=True)
class CorrectionSet:
    """dark, gain: arrays over the signal; excluded: coordinates, one row per axis (d, n), or a bool array over the signal."""

    dark: np.ndarray | None = None
    gain: np.ndarray | None = None
    excluded: np.ndarray | None = None
    allow_empty: bool = False

    def have_corrections(self) -> bool:
        return any(x is not None for x in (self.dark, self.gain, self.excluded))

    def excluded_flat(self, shape: tuple[int, ...]) -> np.ndarray:
        if self.excluded is None:
            return np.zeros(0, np.int64)
        e = np.asarray(self.excluded)
        if e.dtype == bool and e.shape == tuple(shape):
            return np.flatnonzero(e)
        return np.unique(np.ravel_multi_index(tuple(e), shape)) if e.size else np.zeros(0, np.int64)

    def repairs(self, shape: tuple[int, ...]) -> dict[int, np.ndarray]:
        """Excluded pixel -> pixels to average."""
        bad = self.excluded_flat(shape)
        lost = set(bad.tolist())
        out = {}
        for px in bad.tolist():
            here = np.array(np.unravel_index(px, shape))
            around = [here + step for step in product((-1, 0, 1), repeat=len(shape)) if any(step)]
            flat = [int(np.ravel_multi_index(tuple(p), shape)) for p in around if (p >= 0).all() and (p < shape).all()]
            good = [p for p in flat if p not in lost]
            if not good and not self.allow_empty:
                raise RepairError(f"pixel {tuple(here.tolist())} has no usable neighbour")
            out[px] = np.array(good, np.int64)
        return out


def apply_to_frames(x: np.ndarray, corr: CorrectionSet, shape: tuple[int, ...], repairs: dict[int, np.ndarray] | None = None) -> np.ndarray:
    """Corrects a matrix of flattened frames."""
    out = np.array(x, np.result_type(x, np.float32, *(np.asarray(a) for a in (corr.dark, corr.gain) if a is not None)), copy=True)
    if corr.dark is not None:
        out -= np.asarray(corr.dark).reshape(-1)
    if corr.gain is not None:
        out *= np.asarray(corr.gain).reshape(-1)
    for px, around in (corr.repairs(shape) if repairs is None else repairs).items():
        if len(around):
            out[:, px] = out[:, around].mean(axis=1)
    return out


def correct(cube: Cube, corr: CorrectionSet | None) -> Cube:
    """The corrected cube; lazy, one pass by Arrow batch. Complex frames stay complex."""
    if corr is None or not corr.have_corrections():
        return cube
    shape, repairs, both = cube.sig_shape, corr.repairs(cube.sig_shape), cube.complex
    if not both and any(np.iscomplexobj(a) for a in (corr.dark, corr.gain) if a is not None):
        raise ValueError("complex corrections need a complex cube")
    names = ["frame", "frame_im"] if both else ["frame"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = frames_of(batch) + 1j * frames_of(batch, "frame_im") if both else frames_of(batch)
                out = apply_to_frames(x, corr, shape, repairs)
                offsets = pa.array(np.arange(len(out) + 1) * out.shape[1], pa.int32())
                parts = (out.real, out.imag) if both else (out,)
                yield pa.record_batch([batch.column(0), *(pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(p).reshape(-1))) for p in parts)], ["frame_id", *names])

    schema = "frame_id long, " + ", ".join(f"{n} array<double>" for n in names)
    done = replace(cube, df=cube.mapped(run, schema), corrections=None)
    if cube.origin is None or cube.origin[0] is not cube.df:
        return done
    # what follows runs in the task that reads and corrects
    return replace(done, origin=(done.df, *cube.origin[1:3], (*cube.origin[3], run)))


def correct_pixels(cube: Cube, corr: CorrectionSet) -> DataFrame:
    """frame_id, px, v after correction, by joins alone.

    The side tables have a row per pixel, and per excluded pixel and neighbour: at most nine times the pixels of one
    frame. They are broadcast where that is under a million rows and joined by shuffle beyond.
    """
    spark, n = cube.spark, cube.n_px
    small = (lambda df: F.broadcast(df)) if 9 * n < 1_000_000 else (lambda df: df)
    repairs = corr.repairs(cube.sig_shape)
    flat = lambda a, value: np.full(n, value, float) if a is None else np.asarray(a, float).reshape(-1)
    side = spark.createDataFrame(pa.table({"px": pa.array(np.arange(n), pa.int64()), "dark": flat(corr.dark, 0.0), "gain": flat(corr.gain, 1.0), "excluded": pa.array([p in repairs and len(repairs[p]) > 0 for p in range(n)])}))
    plain = cube.pixels().join(small(side), "px").select("frame_id", "px", ((F.col("v").cast("double") - F.col("dark")) * F.col("gain")).alias("v"), "excluded")
    good = plain.filter(~F.col("excluded")).select("frame_id", "px", "v")
    pairs = [(px, int(p)) for px, around in repairs.items() for p in around]
    if not pairs:
        return good
    links = spark.createDataFrame(pairs, "repaired long, px long")
    mended = good.join(small(links), "px").groupBy("frame_id", F.col("repaired").alias("px")).agg(F.avg("v").alias("v"))
    return good.unionByName(mended)


def fold_into_masks(flat: np.ndarray, corr: CorrectionSet, shape: tuple[int, ...]) -> np.ndarray:
    """Masks that give, on uncorrected frames, the products of the gain-corrected and repaired frames (dark is not included).

    A repaired pixel's weight is shared out to the pixels it is averaged from; then every weight takes its gain.
    """
    out = np.array(flat, np.result_type(flat, np.float64), copy=True)
    for px, around in corr.repairs(shape).items():
        if len(around):
            out[:, around] += out[:, [px]] / len(around)
            out[:, px] = 0
    return out if corr.gain is None else out * np.asarray(corr.gain).reshape(-1)
