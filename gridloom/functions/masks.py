"""Mask generators over the signal axes, as arrays on the driver (one frame each), and their table form.

Conventions: coordinates are (y, x); generators take the centre x first.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def _offsets(center_x: float, center_y: float, width: int, height: int) -> tuple[np.ndarray, np.ndarray]:
    return np.arange(height)[:, None] - center_y, np.arange(width)[None, :] - center_x


def distance(center_x: float, center_y: float, width: int, height: int) -> np.ndarray:
    dy, dx = _offsets(center_x, center_y, width, height)
    return np.hypot(dy, dx)


def circular(center_x: float, center_y: float, width: int, height: int, radius: float, antialiased: bool = False) -> np.ndarray:
    """Pixels within ``radius``, border included."""
    if antialiased:
        return radial_bins(center_x, center_y, width, height, radius=radius, n_bins=1)[0]
    dy, dx = _offsets(center_x, center_y, width, height)
    return dy**2 + dx**2 <= radius**2


def ring(center_x: float, center_y: float, width: int, height: int, radius: float, radius_inner: float, antialiased: bool = False) -> np.ndarray:
    """Pixels beyond ``radius_inner`` and within ``radius``."""
    if antialiased:
        return radial_bins(center_x, center_y, width, height, radius=radius, radius_inner=radius_inner, n_bins=1)[0]
    return circular(center_x, center_y, width, height, radius) & ~circular(center_x, center_y, width, height, radius_inner)


def radial_gradient(center_x: float, center_y: float, width: int, height: int, radius: float, antialiased: bool = False) -> np.ndarray:
    """Distance as a share of ``radius`` inside it, zero outside."""
    if antialiased:
        return radial_gradient_background_subtraction(distance(center_x, center_y, width, height), radius, 0.0)
    r = distance(center_x, center_y, width, height)
    return np.where(circular(center_x, center_y, width, height, radius), r / radius, 0.0)


def radial_gradient_background_subtraction(r: np.ndarray, r0: float, r_outer: float, delta: float = 1.0) -> np.ndarray:
    """r / r0 inside r0, a linear step of width ``delta`` around r0, then -1 as far as ``r_outer``."""
    half = delta / 2
    out = np.zeros_like(r, dtype=float)
    inner, step = r < r0 - half, (r >= r0 - half) & (r < r0 + half)
    out[inner] = r[inner] / r0
    out[step] = (r0 - r[step]) / half
    out[(r >= r0 + half) & (r <= r_outer)] = -1.0
    return out


def polar_map(center_x: float, center_y: float, width: int, height: int, stretch_y: float = 1.0, angle: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Radius and angle of each pixel; optionally of an ellipse stretched along a direction."""
    dy, dx = _offsets(center_x, center_y, width, height)
    dy, dx = np.broadcast_arrays(dy.astype(float), dx.astype(float))
    if stretch_y != 1.0 or angle:
        c, s = np.cos(angle), np.sin(angle)
        dy, dx = (dy * c - dx * s) / stretch_y, dy * s + dx * c
    return np.hypot(dy, dx), np.arctan2(dy, dx)


def balance(template: np.ndarray) -> np.ndarray:
    """Negative values scaled so that the sum is zero."""
    negative = -template[template < 0].sum()
    if not negative:
        return template.astype(float)
    return np.where(template < 0, template * (template[template > 0].sum() / negative), template)


def bounding_radius(center_x: float, center_y: float, width: int, height: int) -> int:
    """A radius that reaches every pixel."""
    return int(np.ceil(np.hypot(max(center_y, height - center_y), max(center_x, width - center_x)))) + 1


def radial_bins(center_x: float, center_y: float, width: int, height: int, radius: float | None = None, radius_inner: float = 0.0, n_bins: int | None = None, normalize: bool = False) -> np.ndarray:
    """A stack of antialiased rings that share out the radii from ``radius_inner`` to ``radius``.

    normalize: the sum of each ring is one, before the pixel at the centre is set.
    """
    radius = bounding_radius(center_x, center_y, width, height) if radius is None else radius
    n_bins = int(np.round(radius - radius_inner)) if n_bins is None else n_bins
    r = distance(center_x, center_y, width, height)
    span = (radius - radius_inner) / n_bins
    middle = radius_inner + span * (np.arange(n_bins) + 0.5)
    out = np.clip(span / 2 + 0.5 - np.abs(r[None] - middle[:, None, None]), 0, 1)
    if normalize:
        total = out.sum(axis=(1, 2), keepdims=True)
        out = out / np.where(np.isclose(total, 0), 1, total)
    y, x = int(np.round(center_y)), int(np.round(center_x))
    if radius_inner < 0.5 and 0 <= y < height and 0 <= x < width:  # the innermost ring meets itself at the centre
        out[0, y, x] = 1 - radius_inner
    return out


def background_subtraction(center_x: float, center_y: float, width: int, height: int, radius: float, radius_inner: float, antialiased: bool = False) -> np.ndarray:
    """A disk minus the ring around it, weighted so that the sum is zero."""
    inside = circular(center_x, center_y, width, height, radius_inner, antialiased).astype(float)
    around = ring(center_x, center_y, width, height, radius, radius_inner, antialiased).astype(float)
    return inside - around * (inside.sum() / around.sum())


def rectangular(x: float, y: float, width: float, height: float, frame_width: int, frame_height: int) -> np.ndarray:
    """Pixels between two corners, both included; a negative extent goes the other way, a zero area is empty."""
    out = np.zeros((frame_height, frame_width), bool)
    if not width * height:
        return out
    (x0, x1), (y0, y1) = sorted((x, x + width)), sorted((y, y + height))
    out[max(0, int(y0)) : max(0, int(y1) + 1), max(0, int(x0)) : max(0, int(x1) + 1)] = True
    return out


def gradient_x(width: int, height: int) -> np.ndarray:
    return np.broadcast_to(np.arange(width, dtype=np.float32), (height, width)).copy()


def gradient_y(width: int, height: int) -> np.ndarray:
    return np.broadcast_to(np.arange(height, dtype=np.float32)[:, None], (height, width)).copy()


def template_stack(offsets_y: Sequence[int], offsets_x: Sequence[int], template: np.ndarray, width: int, height: int) -> np.ndarray:
    """The template stamped at each offset into a frame of its own, clipped at the borders."""
    out = np.zeros((len(offsets_y), height, width), np.result_type(template, np.float32))
    th, tw = template.shape
    for k, (oy, ox) in enumerate(zip(offsets_y, offsets_x, strict=True)):
        y0, y1, x0, x1 = max(0, oy), min(height, oy + th), max(0, ox), min(width, ox + tw)
        if y0 < y1 and x0 < x1:
            out[k, y0:y1, x0:x1] = template[y0 - oy : y1 - oy, x0 - ox : x1 - ox]
    return out


def circular_stack(centers_y: Sequence[float], centers_x: Sequence[float], width: int, height: int, radius: float) -> np.ndarray:
    """A disk at each centre (cut to whole pixels)."""
    half = int(np.ceil(radius))
    disk = circular(half, half, 2 * half + 1, 2 * half + 1, radius).astype(np.float32)
    return template_stack([int(y) - half for y in centers_y], [int(x) - half for x in centers_x], disk, width, height)


def binning_stack(height: int, width: int, size: int) -> np.ndarray:
    """Masks that average blocks of ``size`` x ``size`` pixels; blocks at the far edges may be smaller."""
    by, bx = np.arange(height) // size, np.arange(width) // size
    block = by[:, None] * (bx[-1] + 1) + bx[None, :]
    out = (block[None] == np.arange(block.max() + 1)[:, None, None]).astype(float)
    return out / out.sum(axis=(1, 2), keepdims=True)


class MaskStack:
    """A lazily computed stack of masks. Sparse only if every mask is mostly zero."""

    DENSITY = 0.1

    def __init__(self, factories: Callable | Sequence[Callable]) -> None:
        self.factories = factories
        self._stack: np.ndarray | None = None

    @property
    def stack(self) -> np.ndarray:
        if self._stack is None:
            made = self.factories() if callable(self.factories) else [np.asarray(f() if callable(f) else f) for f in self.factories]
            kind = np.result_type(*made) if not isinstance(made, np.ndarray) else made.dtype
            stack = np.asarray(made, np.float32 if kind == bool else kind)
            self._stack = stack if stack.ndim > 2 else stack[None]
        return self._stack

    def __len__(self) -> int:
        return len(self.stack)

    def sparse(self) -> bool:
        return all(np.count_nonzero(m) <= self.DENSITY * m.size for m in self.stack)

    def flat(self) -> np.ndarray:
        return self.stack.reshape(len(self.stack), -1)

    def table(self, spark: SparkSession) -> DataFrame:
        return mask_table(spark, self.stack)


def mask_table(spark: SparkSession, stack: np.ndarray) -> DataFrame:
    """Coordinates form of a stack: mask_id, px, w (and w_im for complex masks)."""
    flat = np.asarray(stack).reshape(len(stack), -1)
    k, px = np.nonzero(flat)
    w = flat[k, px]
    columns = {"mask_id": pa.array(k, pa.int32()), "px": pa.array(px, pa.int64()), "w": pa.array(np.ascontiguousarray(w.real, np.float64))}
    if np.iscomplexobj(flat):
        columns["w_im"] = pa.array(np.ascontiguousarray(w.imag, np.float64))
    return spark.createDataFrame(pa.table(columns))
