"""Products of frames with masks: one value per frame and mask.

Three plans with equal results. ``expr``: array expressions over the frame, a projection without shuffle, for small
stacks. ``kernel``: a matrix product per Arrow batch over the pixels that have weight in any mask, also without
shuffle; it serves sparse masks, dense ones and shifts by frame. ``auto`` takes it from ``EXPR_VALUES`` mask values on.
``join``: pixel form joined with the masks' coordinates form, where masks exist as a table only; the table is broadcast
if it has at most ``BROADCAST_ROWS`` rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.cube import Cube, constant
from gridloom.functions.masks import MaskStack, mask_table
from gridloom.operators.reduce import frames_of

EXPR_VALUES = 256
BROADCAST_ROWS = 1_000_000


def dot(frame: Column, weights: np.ndarray) -> Column:
    """Sum of frame * weights over the pixels with weight."""
    at = np.flatnonzero(weights)
    if not len(at):
        return F.lit(0.0)
    flat = constant(weights[at].astype(np.float64))
    if len(at) == len(weights):
        pairs = F.zip_with(frame, flat, lambda v, w: v.cast("double") * w)
    else:
        picked = F.transform(constant(at), lambda i: F.get(frame, i.cast("int")).cast("double"))
        pairs = F.zip_with(picked, flat, lambda v, w: v * w)
    return F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x)


def apply_masks(cube: Cube, masks, shifts=None, method: str = "auto", names: list[str] | None = None) -> DataFrame:  # noqa: ANN001
    """frame_id and one column per mask (mask_0 ..., with _im columns if masks or frames are complex).

    shifts: None; (dy, dx); or a DataFrame (frame_id, dy, dx): masks move by whole pixels, +y down, +x right (fractions
    are cut off). What leaves the frame is lost; without overlap the product is 0.
    """
    stack = masks if isinstance(masks, MaskStack) else MaskStack(masks if callable(masks) else list(masks))
    flat = stack.flat()
    if flat.shape[1] != cube.n_px:
        raise ValueError(f"masks of {flat.shape[1]} pixels for frames of {cube.n_px}")
    names = names or [f"mask_{k}" for k in range(len(flat))]
    is_complex = np.iscomplexobj(flat) or cube.complex
    if isinstance(shifts, DataFrame):
        return _shifted_by_frame(cube, stack.stack, shifts, names)
    if shifts is not None:
        flat = np.stack([_move(m, int(shifts[0]), int(shifts[1])) for m in stack.stack]).reshape(flat.shape)
    if method == "auto":
        method = "expr" if flat.size <= EXPR_VALUES else "kernel"
    if method == "expr":
        return cube.df.select("frame_id", *_expressions(cube, flat, names, is_complex))
    if method == "join":
        return _joined(cube, flat, names)
    return _multiplied(cube, flat, names, is_complex)


def _expressions(cube: Cube, flat: np.ndarray, names: list[str], is_complex: bool) -> list[Column]:
    re, im = F.col("frame"), F.col("frame_im") if cube.complex else None
    out = []
    for m, name in zip(flat, names, strict=True):
        real = dot(re, m.real) - (dot(im, m.imag) if im is not None and np.iscomplexobj(m) else F.lit(0.0))
        out.append(real.alias(name))
        if is_complex:
            part = dot(re, m.imag) if np.iscomplexobj(m) else F.lit(0.0)
            out.append((part + dot(im, m.real) if im is not None else part).alias(name + "_im"))
    return out


def _joined(cube: Cube, flat: np.ndarray, names: list[str]) -> DataFrame:
    if np.iscomplexobj(flat) or cube.complex:
        raise ValueError("complex products have no join plan")
    table = mask_table(cube.spark, flat)
    if np.count_nonzero(flat) <= BROADCAST_ROWS:
        table = F.broadcast(table)
    long = cube.pixels().join(table, "px").groupBy("frame_id").agg(*[F.sum(F.when(F.col("mask_id") == k, F.col("v").cast("double") * F.col("w"))).alias(n) for k, n in enumerate(names)])
    return cube.df.select("frame_id").join(long, "frame_id", "left").select("frame_id", *[F.coalesce(n, F.lit(0.0)).alias(n) for n in names])


def _multiplied(cube: Cube, flat: np.ndarray, names: list[str], is_complex: bool) -> DataFrame:
    at = np.flatnonzero(flat.any(axis=0))
    shared = cube.spark.sparkContext.broadcast((at, np.ascontiguousarray(flat[:, at].T)))  # a stack of frames that the caller has in memory
    both = cube.complex
    fields = [n for name in names for n in ((name, name + "_im") if is_complex else (name,))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, masks = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = frames_of(batch)
            x = x[:, at] if len(at) < x.shape[1] else x
            out = (x + 1j * frames_of(batch, "frame_im")[:, at] if both else x) @ masks
            columns = [part for k in range(out.shape[1]) for part in ((out[:, k].real, out[:, k].imag) if is_complex else (out[:, k],))]
            yield pa.record_batch([batch.column(0), *(pa.array(np.ascontiguousarray(c, np.float64)) for c in columns)], ["frame_id", *fields])

    return cube.mapped(run, "frame_id long, " + ", ".join(f"`{n}` double" for n in fields))


def _move(mask: np.ndarray, dy: int, dx: int) -> np.ndarray:
    height, width = mask.shape
    out = np.zeros_like(mask)
    if abs(dy) < height and abs(dx) < width:
        out[max(0, dy) : height + min(0, dy), max(0, dx) : width + min(0, dx)] = mask[max(0, -dy) : height + min(0, -dy), max(0, -dx) : width + min(0, -dx)]
    return out


def _shifted_by_frame(cube: Cube, stack: np.ndarray, shifts: DataFrame, names: list[str]) -> DataFrame:
    """Per-frame shifts: the pixel at (y, x) meets the mask at (y - dy, x - dx)."""
    shape = cube.sig_shape
    moved = shifts.select("frame_id", F.col("dy").cast("int").alias("dy"), F.col("dx").cast("int").alias("dx"))
    shared = cube.spark.sparkContext.broadcast(stack)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = frames_of(batch)
            by = np.stack([np.asarray(batch.column(k)) for k in (2, 3)], axis=1)
            out = np.zeros((len(x), len(names)))
            ways, of = np.unique(by, axis=0, return_inverse=True)
            for k, (dy, dx) in enumerate(ways.tolist()):
                mine = np.flatnonzero(of.reshape(-1) == k)
                flat = np.stack([_move(m, dy, dx) for m in shared.value]).reshape(len(names), -1)
                out[mine] = x[mine] @ flat.T
            yield pa.record_batch([batch.column(0), *(pa.array(np.ascontiguousarray(c)) for c in out.T)], ["frame_id", *names])

    if np.iscomplexobj(stack) or cube.complex or len(shape) != 2:
        raise ValueError("shifts by frame need real masks and frames of two axes")
    rows = cube.df.select("frame_id", "frame").join(moved, "frame_id")
    found = rows.select("frame_id", "frame", "dy", "dx").mapInArrow(run, "frame_id long, " + ", ".join(f"`{n}` double" for n in names))
    return cube.df.select("frame_id").join(found, "frame_id", "left").select("frame_id", *[F.coalesce(n, F.lit(0.0)).alias(n) for n in names])
