"""Coordinate helpers: polar and cartesian vectors, rotations, 2 x 2 transformations of (y, x), shapes, lattices."""

from __future__ import annotations

import numpy as np
import pandas as pd


def make_cartesian(polar: np.ndarray) -> np.ndarray:
    """(r, phi) to (y, x) along the last axis."""
    r, phi = polar[..., 0], polar[..., 1]
    return np.stack((r * np.sin(phi), r * np.cos(phi)), axis=-1)


def make_polar(cartesian: np.ndarray) -> np.ndarray:
    """(y, x) to (r, phi) along the last axis."""
    y, x = cartesian[..., 0], cartesian[..., 1]
    return np.stack((np.hypot(y, x), np.arctan2(y, x)), axis=-1)


def identity() -> np.ndarray:
    return np.eye(2)


def scale(factor: float) -> np.ndarray:
    return np.eye(2) * factor


def rotate(radians: float) -> np.ndarray:
    """Rotation of (y, x) vectors; y points down."""
    c, s = np.cos(radians), np.sin(radians)
    return np.array([(c, s), (-s, c)])


def rotate_deg(degrees: float) -> np.ndarray:
    return rotate(np.deg2rad(degrees))


def flip_y() -> np.ndarray:
    return np.diag((-1.0, 1.0))


def flip_x() -> np.ndarray:
    return np.diag((1.0, -1.0))


def scale_rotate_flip_y(matrix: np.ndarray) -> tuple[float, float, bool]:
    """Splits a matrix into scale(s) @ rotate(a) @ flip_y (or no flip); ValueError for shear or unequal scales."""
    lengths = np.linalg.norm(matrix, axis=0)
    if not np.allclose(*lengths):
        raise ValueError("the axes are scaled differently")
    if not np.isclose(matrix[:, 0] @ matrix[:, 1], 0, atol=1e-8 * lengths[0] ** 2):
        raise ValueError("the matrix shears")
    flipped = bool(np.linalg.det(matrix) < 0)
    turn = (matrix @ flip_y() if flipped else matrix) / lengths[0]
    return float(lengths[0]), float(np.arctan2(turn[0, 1], turn[0, 0])), flipped


def rotate_vectors(y: np.ndarray, x: np.ndarray, radians: float) -> tuple[np.ndarray, np.ndarray]:
    m = rotate(radians)
    return m[0, 0] * y + m[0, 1] * x, m[1, 0] * y + m[1, 1] * x


def prod(shape: tuple[int, ...]) -> int:
    return int(np.prod(shape, dtype=np.int64))


def count_nonzero(a: np.ndarray) -> int:
    return int(np.count_nonzero(a))


def flat_nonzero(a: np.ndarray) -> np.ndarray:
    return np.flatnonzero(a)


def make_2d_square(shape: tuple[int, ...]) -> tuple[int, ...]:
    """A flat shape as a square if its size is one."""
    size = prod(shape)
    side = int(round(size**0.5))
    return (side, side) if side * side == size else shape


def lattice(zero: np.ndarray, a: np.ndarray, b: np.ndarray, indices: np.ndarray) -> np.ndarray:
    """Points zero + i * a + j * b."""
    return np.asarray(zero) + np.asarray(indices) @ np.stack((a, b))


def lattice_table(shape: tuple[int, int], origin: tuple[float, float], a: tuple[float, float], b: tuple[float, float], border: float = 0.0) -> pd.DataFrame:
    """i, j, y, x of every lattice point of a frame that keeps ``border`` to its edges, by i and j.

    The frame's corners, written in the basis (a, b), bound the indices; nothing has to be guessed. Other selections
    are filters or joins of the table.
    """
    top = np.array(shape, float) - border
    corners = np.array([(y, x) for y in (border, top[0]) for x in (border, top[1])]) - origin
    reach = np.linalg.solve(np.array((a, b), float).T, corners.T)
    spans = [np.arange(np.floor(r.min()), np.ceil(r.max()) + 1, dtype=np.int64) for r in reach]
    table = pd.MultiIndex.from_product(spans, names=("i", "j")).to_frame(index=False)
    table[["y", "x"]] = lattice(origin, a, b, table[["i", "j"]].to_numpy())
    fits = table["y"].between(border, top[0], inclusive="left") & table["x"].between(border, top[1], inclusive="left")
    return table[fits].reset_index(drop=True)
