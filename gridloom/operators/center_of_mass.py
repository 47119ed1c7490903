"""Centre of mass of each frame, its vector field and the field's derivatives, and guesses of scan corrections.

The three mask products are one projection. A regression over the field needs one global aggregate of moments (a
single row). Divergence and curl are central differences over the navigation grid with one-sided ones at its borders,
by window functions along rows and along columns; a missing neighbour makes them NaN.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.cube import Cube
from gridloom.functions import geometry
from gridloom.functions.masks import circular, ring
from gridloom.operators.masked import apply_masks


@dataclass(frozen=True)
class ComParams:
    """cy, cx default to half the frame's size, cut to whole pixels; regression: -1 none, 0 the mean, 1 a plane, or (3, 2) coefficients."""

    cy: float | None = None
    cx: float | None = None
    r: float = float("inf")
    ri: float = 0.0
    scan_rotation: float = 0.0
    flip_y: bool = False
    regression: object = -1


def com_masks(sig_shape: tuple[int, int], cy: float, cx: float, r: float, ri: float) -> np.ndarray:
    """Sum, y and x masks over a disk or ring."""
    height, width = sig_shape
    if np.isinf(r) and not ri:
        base = np.ones(sig_shape)
    elif ri:
        base = ring(cx, cy, width, height, r, ri).astype(float) if not np.isinf(r) else 1.0 - circular(cx, cy, width, height, ri)
    else:
        base = circular(cx, cy, width, height, r).astype(float)
    y, x = np.indices(sig_shape)
    return np.stack((base, y * base, x * base))


def transform(scan_rotation: float, flip_y: bool, forward: bool = True) -> np.ndarray:
    """Matrix that corrects (y, x) vectors: flip first, then rotation."""
    m = geometry.rotate_deg(scan_rotation) @ (geometry.flip_y() if flip_y else geometry.identity())
    return m if forward else np.linalg.inv(m)


def raw_shifts(cube: Cube, p: ComParams) -> DataFrame:
    """frame_id, raw_y, raw_x: centre of mass relative to the reference, zero where the mass is zero; raw_com_y, raw_com_x absolute."""
    if len(cube.sig_shape) != 2:
        raise ValueError("the centre of mass needs two signal axes")
    if p.ri >= p.r:
        raise ValueError("the inner radius is not below the outer one")
    cy = cube.sig_shape[0] // 2 if p.cy is None else p.cy
    cx = cube.sig_shape[1] // 2 if p.cx is None else p.cx
    mass = apply_masks(cube, com_masks(cube.sig_shape, cy, cx, p.r, p.ri), names=["s", "sy", "sx"])
    shift = lambda part, ref: F.when(F.col("s") == 0, F.lit(0.0)).otherwise(F.col(part) / F.col("s") - F.lit(float(ref)))
    out = mass.select("frame_id", shift("sy", cy).alias("raw_y"), shift("sx", cx).alias("raw_x"))
    return out.select("*", (F.col("raw_y") + float(cy)).alias("raw_com_y"), (F.col("raw_x") + float(cx)).alias("raw_com_x"))


def corrected(field: DataFrame, matrix: np.ndarray, y: str = "raw_y", x: str = "raw_x") -> DataFrame:
    a, b = F.col(y), F.col(x)
    row = lambda k: F.lit(float(matrix[k, 0])) * a + F.lit(float(matrix[k, 1])) * b
    return field.withColumns({"field_y": row(0), "field_x": row(1)})


def _plane(field: DataFrame) -> np.ndarray:
    """Least squares of (field_y, field_x) on [1, nav_y, nav_x] from ten moments (one row)."""
    base = [F.lit(1.0), F.col("nav_y").cast("double"), F.col("nav_x").cast("double")]
    aggs = [F.sum(base[i] * base[j]) for i in range(3) for j in range(i, 3)] + [F.sum(b * F.col(t)) for t in ("field_y", "field_x") for b in base]
    row = field.agg(*[a.alias(f"c{k}") for k, a in enumerate(aggs)]).first()
    if row[0] is None:
        return np.zeros((3, 2))
    m = np.zeros((3, 3))
    m[np.triu_indices(3)] = row[:6]
    m = m + np.triu(m, 1).T
    return np.linalg.lstsq(m, np.array(row[6:]).reshape(2, 3).T, rcond=None)[0]


def regression_of(field: DataFrame, kind) -> np.ndarray:  # noqa: ANN001
    """(3, 2) coefficients: constant, per nav_y, per nav_x, for field_y and field_x."""
    if isinstance(kind, np.ndarray):
        if kind.shape != (3, 2):
            raise ValueError(f"regression coefficients of shape {kind.shape}, not (3, 2)")
        return kind
    if kind == -1:
        return np.zeros((3, 2))
    if kind == 0:
        mean = field.agg(F.avg("field_y"), F.avg("field_x")).first()
        return np.array([(mean[0] or 0.0, mean[1] or 0.0), (0.0, 0.0), (0.0, 0.0)])
    if kind == 1:
        return _plane(field)
    raise ValueError(f"unknown regression {kind!r}")


def gradient(column: Column, along: str, across: str, size: int) -> Column:
    """Central difference along an axis of the full grid, one-sided at its ends."""
    w = Window.partitionBy(across).orderBy(along)
    before, after = F.lag(column).over(w), F.lead(column).over(w)
    return F.when(F.col(along) == 0, after - column).when(F.col(along) == size - 1, column - before).otherwise((after - before) / 2)


def with_derivatives(grid: DataFrame, nav_shape: tuple[int, int]) -> DataFrame:
    """Adds divergence and curl of (field_y, field_x); ``grid`` has every navigation position."""
    fy, fx = F.col("field_y"), F.col("field_x")
    parts = {
        "_yy": gradient(fy, "nav_y", "nav_x", nav_shape[0]),
        "_xy": gradient(fx, "nav_y", "nav_x", nav_shape[0]),
        "_yx": gradient(fy, "nav_x", "nav_y", nav_shape[1]),
        "_xx": gradient(fx, "nav_x", "nav_y", nav_shape[1]),
    }
    return grid.withColumns(parts).withColumns({"divergence": F.col("_yy") + F.col("_xx"), "curl": F.col("_yx") - F.col("_xy")}).drop(*parts)


def center_of_mass(cube: Cube, params: ComParams | None = None, derivatives: bool = True) -> DataFrame:
    """frame_id, nav_y, nav_x, raw_y, raw_x, raw_com_y, raw_com_x, field_y, field_x, magnitude, divergence, curl."""
    p = params or ComParams()
    if len(cube.nav_shape) != 2:
        raise ValueError("the vector field needs two navigation axes")
    field = cube.with_nav(corrected(raw_shifts(cube, p), transform(p.scan_rotation, p.flip_y)))
    k = regression_of(field, p.regression)
    if k.any():
        fit = lambda c: F.lit(float(k[0, c])) + F.lit(float(k[1, c])) * F.col("nav_y") + F.lit(float(k[2, c])) * F.col("nav_x")
        field = field.withColumns({"field_y": F.col("field_y") - fit(0), "field_x": F.col("field_x") - fit(1)})
    if derivatives and min(cube.nav_shape) > 1:
        if cube.selected:
            field = with_derivatives(cube.embed(field), cube.nav_shape).filter("valid").drop("valid")
        else:
            field = with_derivatives(field, cube.nav_shape)
    return field.withColumn("magnitude", F.hypot("field_y", "field_x"))


def _derivative_moments(field: DataFrame, nav_shape: tuple[int, int], inner: bool) -> DataFrame:
    fy, fx = F.col("raw_y"), F.col("raw_x")
    parts = field.withColumns(
        {
            "yy": gradient(fy, "nav_y", "nav_x", nav_shape[0]),
            "xy": gradient(fx, "nav_y", "nav_x", nav_shape[0]),
            "yx": gradient(fy, "nav_x", "nav_y", nav_shape[1]),
            "xx": gradient(fx, "nav_x", "nav_y", nav_shape[1]),
        }
    )
    # the last row and column are left out
    return parts.filter((F.col("nav_y") < nav_shape[0] - 1) & (F.col("nav_x") < nav_shape[1] - 1)) if inner else parts


def coordinate_check(field: DataFrame, nav_shape: tuple[int, int], inner: bool = True) -> np.ndarray:
    """RMS curl for flip_y off and on (rows) and rotations of 0 .. 359 degrees (columns), from three moments each.

    With flip f in {1, -1} the curl at an angle t is cos t * A + sin t * B, where A = f * yx - xy and B = xx + f * yy,
    so the mean square is a quadratic form in (cos t, sin t).
    """
    parts = _derivative_moments(field, nav_shape, inner)
    aggs = []
    for f in (1.0, -1.0):
        a, b = f * F.col("yx") - F.col("xy"), F.col("xx") + f * F.col("yy")
        aggs += [F.avg(a * a), F.avg(a * b), F.avg(b * b)]
    m = np.array([x or 0.0 for x in parts.agg(*[c.alias(f"c{k}") for k, c in enumerate(aggs)]).first()]).reshape(2, 3)
    t = np.deg2rad(np.arange(360))
    c, s = np.cos(t), np.sin(t)
    return np.sqrt(np.maximum(m[:, :1] * c**2 + 2 * m[:, 1:2] * s * c + m[:, 2:] * s**2, 0.0))


@dataclass(frozen=True)
class Guess:
    scan_rotation: int
    flip_y: bool
    cy: float
    cx: float


def guess_corrections(cube: Cube, params: ComParams | None = None, inner: bool = True) -> Guess:
    """Rotation and flip of least RMS curl; the sign from the skew of the divergence's histogram; the mean centre."""
    p = params or ComParams()
    field = cube.with_nav(raw_shifts(cube, p))
    rms = coordinate_check(field, cube.nav_shape, inner)
    flip = bool(rms[1].min() < rms[0].min())
    angle = int(rms[int(flip)].argmin())
    turned = with_derivatives(corrected(field, transform(angle, flip)), cube.nav_shape)
    if inner:
        turned = turned.filter((F.col("nav_y") < cube.nav_shape[0] - 1) & (F.col("nav_x") < cube.nav_shape[1] - 1))
    top = turned.agg(F.max(F.abs("divergence"))).first()[0] or 0.0
    if top:
        # five equal bins over [-top, top]; atoms attract: the tail of the divergence is negative
        slot = F.least(F.floor((F.col("divergence") + top) / (2 * top / 5)).cast("int"), F.lit(4))
        bins = {r[0]: r[1] for r in turned.groupBy(slot.alias("slot")).count().collect()}
        if bins.get(0, 0) < bins.get(4, 0):
            angle += 180
    angle = (angle + 180) % 360 - 180
    mean = field.agg(F.avg("raw_com_y"), F.avg("raw_com_x")).first()
    return Guess(180 if angle == -180 else angle, flip, float(mean[0] or 0.0), float(mean[1] or 0.0))
