"""Statistics over rings of the frame and of its Fourier transform."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.cube import Cube, constant
from gridloom.functions.masks import circular, ring
from gridloom.operators.reduce import frames_of


def ring_std(cube: Cube, center: tuple[float, float], rad_in: float, rad_out: float) -> DataFrame:
    """frame_id, intensity: population standard deviation of the pixels with rad_in < distance <= rad_out; center is (y, x).

    A projection: the ring's pixels are picked by index, the mean first, then the squared deviations from it.
    """
    height, width = cube.sig_shape
    inside = np.flatnonzero(ring(center[1], center[0], width, height, rad_out, rad_in))
    if not len(inside):
        return cube.df.select("frame_id", F.lit(float("nan")).alias("intensity"))
    picked = F.transform(constant(inside), lambda i: F.get("frame", i.cast("int")).cast("double"))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    rows = cube.df.select("frame_id", picked.alias("p")).withColumn("m", total("p") / len(inside))
    return rows.select("frame_id", F.sqrt(total(F.transform("p", lambda x: F.pow(x - F.col("m"), F.lit(2.0)))) / len(inside)).alias("intensity"))


def half_spectrum_ring(sig_shape: tuple[int, int], rad_in: float, rad_out: float) -> np.ndarray:
    """The Fourier-space ring over the half spectrum of a real transform: made around the middle, moved to the corner by fftshift."""
    height, width = sig_shape
    whole = circular(width * 0.5, height * 0.5, width, height, rad_out).astype(float) - circular(width * 0.5, height * 0.5, width, height, rad_in)
    return np.fft.fftshift(whole)[:, : width // 2 + 1]


def real_mask(sig_shape: tuple[int, int], center: tuple[float, float] | None, radius: float | None) -> np.ndarray | None:
    """Everything but a disk around ``center`` (y, x); None without a centre or radius."""
    if center is None or radius is None:
        return None
    height, width = sig_shape
    return 1.0 - circular(center[1], center[0], width, height, radius)


def crystallinity(cube: Cube, rad_in: float, rad_out: float, real_center: tuple[float, float] | None = None, real_rad: float | None = None) -> DataFrame:
    """frame_id, intensity: sum of the spectrum's magnitude over a ring of the half spectrum. Runs by Arrow batch."""
    shape = cube.sig_shape
    spectrum, cover = half_spectrum_ring(shape, rad_in, rad_out), real_mask(shape, real_center, real_rad)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = frames_of(batch).reshape(-1, *shape)
                found = (np.abs(np.fft.rfft2(x if cover is None else x * cover)) * spectrum).sum(axis=(1, 2))
                yield pa.record_batch([batch.column(0), pa.array(found)], ["frame_id", "intensity"])

    return cube.mapped(run, "frame_id long, intensity double")


def fft_frames(cube: Cube, real_center: tuple[float, float] | None = None, real_rad: float | None = None) -> DataFrame:
    """frame_id, frame: magnitude of each frame's transform, zero frequency in the middle; complex frames' magnitude is taken as it is."""
    shape, cover = cube.sig_shape, real_mask(cube.sig_shape, real_center, real_rad)
    both = cube.complex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = frames_of(batch).reshape(-1, *shape)
            if both:
                out = np.abs(x + 1j * frames_of(batch, "frame_im").reshape(-1, *shape))
            else:
                out = np.abs(np.fft.fftshift(np.fft.fft2(x if cover is None else x * cover), axes=(1, 2)))
            flat = pa.array(out.reshape(-1))
            offsets = pa.array(np.arange(len(out) + 1) * out[0].size, pa.int32())
            yield pa.record_batch([batch.column(0), pa.ListArray.from_arrays(offsets, flat)], ["frame_id", "frame"])

    return cube.mapped(run, "frame_id long, frame array<double>")


def fft_of(image: np.ndarray, real_center: tuple[float, float] | None = None, real_rad: float | None = None) -> np.ndarray:
    """Magnitude of one image's transform, zero frequency in the middle."""
    cover = real_mask(image.shape, real_center, real_rad)
    return np.abs(np.fft.fftshift(np.fft.fft2(image if cover is None else image * cover)))
