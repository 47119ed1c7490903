"""Named analyses: parameters with defaults, one or more result channels.

An analysis is made by a factory of :class:`gridloom.api.Context` and run by ``Context.run``. Channels are DataFrames
(nav channels by frame_id, sig channels by px) or, where the result is one image, arrays.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.cube import Cube
from gridloom.functions import masks as M
from gridloom.operators import center_of_mass as com
from gridloom.operators import masked, reduce, ring_stats

REGISTRY: dict[str, type[Analysis]] = {}


class Analysis:
    """Base: ``id`` registers a class; ``channels`` gives the results by name."""

    id: str | None = None

    def __init_subclass__(cls) -> None:
        if cls.id:
            REGISTRY[cls.id] = cls

    def __init__(self, cube: Cube, **parameters) -> None:  # noqa: ANN003
        self.cube, self.given = cube, parameters
        self.parameters = {**self.defaults(), **{k: v for k, v in parameters.items() if v is not None}}

    def defaults(self) -> dict:
        return {}

    def selection(self):  # noqa: ANN201
        """A region of interest of the analysis's own."""
        return self.parameters.get("roi")

    def channels(self, cube: Cube) -> dict[str, object]:
        raise NotImplementedError

    def needs_rerun(self, old: dict) -> bool:
        """Whether results for the parameters ``old`` can't be reused."""
        return old != self.parameters


def region(kind: str, nav_shape: tuple[int, int], **p: float) -> np.ndarray:
    """A navigation mask: disk (cx, cy, r) or rect (x, y, width, height)."""
    height, width = nav_shape
    if kind == "disk":
        return M.circular(p["cx"], p["cy"], width, height, p["r"])
    if kind == "rect":
        return M.rectangular(p["x"], p["y"], p["width"], p["height"], width, height)
    raise NotImplementedError(f"no region {kind!r}")


def complex_channels(df: DataFrame, name: str) -> dict[str, Column]:
    """Magnitude, its logarithm, real and imaginary part and angle of a pair of columns."""
    re, im = F.col(name), F.col(name + "_im")
    size = F.hypot(re, im)
    return {"magn": size, "log_magn": F.log(size), "real": re, "imag": im, "angle": F.atan2(im, re)}


def _with_complex(df: DataFrame, name: str) -> DataFrame:
    return df.withColumns(complex_channels(df, name)) if name + "_im" in df.columns else df


class SumFrames(Analysis):
    id = "SUM_FRAMES"

    def channels(self, cube: Cube) -> dict[str, object]:
        return {"intensity": _with_complex(reduce.sum_frames(cube), "intensity")}


class SumSig(Analysis):
    id = "SUM_SIG"

    def channels(self, cube: Cube) -> dict[str, object]:
        return {"intensity": _with_complex(reduce.sum_sig(cube), "intensity")}


class SDFrames(Analysis):
    id = "SD_FRAMES"

    def channels(self, cube: Cube) -> dict[str, object]:
        out = reduce.stddev(cube)
        return {"std": out, "std_log": out.select("px", F.log("std").alias("std"))}


class Masks(Analysis):
    """factories: callables or arrays, one per mask; channels mask_0 and so on."""

    def stack(self) -> np.ndarray:
        made = [np.asarray(f() if callable(f) else f) for f in self.parameters["factories"]]
        count = self.parameters.get("mask_count")
        if count is not None and count != len(made):
            raise ValueError(f"{len(made)} masks, {count} announced")
        kind = self.parameters.get("mask_dtype") or self.parameters.get("dtype")
        return np.stack(made).astype(kind) if kind else np.stack(made)

    def channels(self, cube: Cube) -> dict[str, object]:
        method = {True: "join", False: "kernel"}.get(self.parameters.get("use_sparse"), "auto")
        stack = self.stack()
        out = masked.apply_masks(cube, stack if stack.dtype != bool else stack.astype(float), method=method)
        return {n: _with_complex(out.select("frame_id", *(c for c in out.columns if c in (n, n + "_im"))), n) for n in (f"mask_{k}" for k in range(len(stack)))}


class _OneMask(Analysis):
    def mask(self, cube: Cube) -> np.ndarray:
        raise NotImplementedError

    def channels(self, cube: Cube) -> dict[str, object]:
        out = _with_complex(masked.apply_masks(cube, self.mask(cube)[None].astype(float), names=["intensity"]), "intensity")
        return {"intensity": out, "intensity_log": out.select("frame_id", F.log1p("intensity").alias("intensity"))}


class DiskMask(_OneMask):
    id = "APPLY_DISK_MASK"

    def defaults(self) -> dict:
        height, width = self.cube.sig_shape
        return {"cx": width / 2, "cy": height / 2, "r": min(height, width) / 2 * 0.3}

    def mask(self, cube: Cube) -> np.ndarray:
        p, (height, width) = self.parameters, cube.sig_shape
        return M.circular(p["cx"], p["cy"], width, height, p["r"])


class RingMask(_OneMask):
    id = "APPLY_RING_MASK"

    def defaults(self) -> dict:
        height, width = self.cube.sig_shape
        outer = self.given.get("ro") or min(height, width) / 2
        return {"cx": width / 2, "cy": height / 2, "ro": outer, "ri": outer * 0.8}

    def mask(self, cube: Cube) -> np.ndarray:
        p, (height, width) = self.parameters, cube.sig_shape
        return M.ring(p["cx"], p["cy"], width, height, p["ro"], p["ri"])


class PointMask(_OneMask):
    id = "APPLY_POINT_SELECTOR"

    def defaults(self) -> dict:
        height, width = self.cube.sig_shape
        return {"x": width / 2, "y": height / 2}

    def channels(self, cube: Cube) -> dict[str, object]:
        out = reduce.pick_pixel(cube, int(self.parameters["y"]), int(self.parameters["x"]))
        return {"intensity": out, "intensity_log": out.select("frame_id", F.log1p("intensity").alias("intensity"))}


class CenterOfMass(Analysis):
    id = "CENTER_OF_MASS"

    def defaults(self) -> dict:
        height, width = self.cube.sig_shape
        return {"cx": width / 2, "cy": height / 2, "mask_radius": float("inf"), "mask_radius_inner": 0.0, "flip_y": False, "scan_rotation": 0.0}

    def params(self) -> com.ComParams:
        p = self.parameters
        return com.ComParams(cy=p["cy"], cx=p["cx"], r=p["mask_radius"], ri=p["mask_radius_inner"], scan_rotation=p["scan_rotation"], flip_y=p["flip_y"])

    def channels(self, cube: Cube) -> dict[str, object]:
        if cube.complex:
            mass = masked.apply_masks(cube, com.com_masks(cube.sig_shape, self.parameters["cy"], self.parameters["cx"], self.parameters["mask_radius"], self.parameters["mask_radius_inner"]), names=["s", "sy", "sx"])
            size = F.col("s") ** 2 + F.col("s_im") ** 2
            out = {}
            for axis, ref in (("y", self.parameters["cy"]), ("x", self.parameters["cx"])):
                re = (F.col(f"s{axis}") * F.col("s") + F.col(f"s{axis}_im") * F.col("s_im")) / size - F.lit(float(ref))
                im = (F.col(f"s{axis}_im") * F.col("s") - F.col(f"s{axis}") * F.col("s_im")) / size
                out[f"{axis}_real"] = mass.select("frame_id", F.when(size == 0, 0.0).otherwise(re).alias(f"{axis}_real"))
                out[f"{axis}_imag"] = mass.select("frame_id", F.when(size == 0, 0.0).otherwise(im).alias(f"{axis}_imag"))
            return out
        field = com.center_of_mass(cube, self.params())
        names = {"field": ("field_x", "field_y"), "magnitude": ("magnitude",), "x": ("field_x",), "y": ("field_y",)}
        if min(cube.nav_shape) > 1:
            names |= {"divergence": ("divergence",), "curl": ("curl",)}
        return {k: field.select("frame_id", *v) for k, v in names.items()}

    def needs_rerun(self, old: dict) -> bool:
        later = {"flip_y", "scan_rotation"}
        return {k: v for k, v in old.items() if k not in later} != {k: v for k, v in self.parameters.items() if k not in later}


class RadialFourier(Analysis):
    """Fourier coefficients over the angle, for each radial bin."""

    id = "RADIAL_FOURIER"

    def defaults(self) -> dict:
        height, width = self.cube.sig_shape
        cx, cy = self.given.get("cx", width / 2), self.given.get("cy", height / 2)
        return {"cx": cx, "cy": cy, "ri": 0, "ro": M.bounding_radius(cx, cy, width, height), "n_bins": 1, "max_order": 24}

    def stack(self, shape: tuple[int, int]) -> np.ndarray:
        p, (height, width) = self.parameters, shape
        rings = M.radial_bins(p["cx"], p["cy"], width, height, radius=p["ro"], radius_inner=p["ri"], n_bins=p["n_bins"])
        _, phi = M.polar_map(p["cx"], p["cy"], width, height)
        orders = np.exp(1j * phi[None] * np.arange(p["max_order"] + 1)[:, None, None])
        return (rings[:, None] * orders[None]).reshape(-1, *shape)

    def wide(self, cube: Cube) -> DataFrame:
        """frame_id, bins: for each bin an array over k of (re, im, absolute); one row a frame."""
        p, orders = self.parameters, self.parameters["max_order"] + 1
        names = [f"c_{b}_{k}" for b in range(p["n_bins"]) for k in range(orders)]
        products = masked.apply_masks(cube, self.stack(cube.sig_shape), names=names)

        def of(b: int) -> Column:  # the products are lambda variables, so each is made once
            re, im = (F.array(*[F.col(f"c_{b}_{k}{part}") for k in range(orders)]) for part in ("", "_im"))
            return F.zip_with(re, im, lambda x, y: F.struct(x.alias("re"), y.alias("im"), F.hypot(x, y).alias("absolute")))

        return products.select("frame_id", F.array(*[of(b) for b in range(p["n_bins"])]).alias("bins"))

    def channels(self, cube: Cube) -> dict[str, object]:
        by_bin = self.wide(cube).select("frame_id", F.posexplode("bins").alias("bin", "c"))
        # the largest higher order of a bin, of equals the lowest; found within the row
        ranked = F.transform(F.slice("c", F.lit(2), F.lit(max(1, self.parameters["max_order"]))), lambda c, i: F.struct(c["absolute"].alias("absolute"), (-(i + 1)).alias("k")))
        peaks = by_bin.select("frame_id", "bin", F.array_max(ranked).alias("best"))
        # the threshold of a bin is a share of the largest coefficient over all frames
        top = peaks.groupBy("bin").agg(F.max("best.absolute").alias("top"))
        dominant = peaks.join(F.broadcast(top), "bin").filter("best is not null").select("frame_id", "bin", F.when(F.col("best.absolute") < 0.2 * F.col("top"), 0).otherwise(-F.col("best.k")).alias("dominant"))
        norm = F.greatest(F.lit(1.0), F.element_at("c", 1)["absolute"])
        rows = by_bin.select("frame_id", "bin", norm.alias("norm"), F.posexplode("c").alias("k", "c"))
        by = F.when(F.col("k") >= 1, F.col("norm")).otherwise(1.0)
        return {
            "dominant": dominant,
            "absolute": rows.select("frame_id", "bin", "k", "c.absolute"),
            "phase": rows.select("frame_id", "bin", "k", F.atan2("c.im", "c.re").alias("phase")),
            "complex": rows.select("frame_id", "bin", "k", (F.col("c.re") / by).alias("re"), (F.col("c.im") / by).alias("im")),
        }


class PickFrame(Analysis):
    id = "PICK_FRAME"

    def selection(self):  # noqa: ANN201
        given = [k for k in ("z", "y", "x") if self.parameters.get(k) is not None]
        wanted = ["z", "y", "x"][3 - len(self.cube.nav_shape) :]
        if given != wanted:
            raise ValueError(f"coordinates {given} for navigation axes {wanted}")
        flat = int(np.ravel_multi_index([self.parameters[k] for k in wanted], self.cube.nav_shape))
        return F.col("frame_id") == flat

    def channels(self, cube: Cube) -> dict[str, object]:
        return {"intensity": reduce.pick(cube)}


class PickFFTFrame(PickFrame):
    id = "PICK_FFT_FRAME"

    def channels(self, cube: Cube) -> dict[str, object]:
        p = self.parameters
        center = None if p.get("real_centery") is None else (p["real_centery"], p["real_centerx"])
        return {"intensity": ring_stats.fft_frames(cube, center, p.get("real_rad"))}


class FFTSumFrames(Analysis):
    """The sum over frames, and the transform of that sum."""

    id = "FFTSUM_FRAMES"

    def channels(self, cube: Cube) -> dict[str, object]:
        p = self.parameters
        total = reduce.sum_frames(cube)
        image = np.zeros(cube.n_px)
        for px, v in total.select("px", "intensity").toLocalIterator():  # one frame
            image[px] = v
        center = None if p.get("real_centery") is None else (p["real_centery"], p["real_centerx"])
        return {"intensity": total, "fft": np.log(ring_stats.fft_of(image.reshape(cube.sig_shape), center, p.get("real_rad")) + 1)}


class ApplyFFTMask(Analysis):
    id = "APPLY_FFT_MASK"

    def channels(self, cube: Cube) -> dict[str, object]:
        p = self.parameters
        center = None if p.get("real_centery") is None else (p["real_centery"], p["real_centerx"])
        return {"intensity": ring_stats.crystallinity(cube, p["rad_in"], p["rad_out"], center, p.get("real_rad"))}


class FEM(Analysis):
    id = "FEM"

    def defaults(self) -> dict:
        height, width = self.cube.sig_shape
        return {"cx": width / 2, "cy": height / 2, "ri": 0.0, "ro": min(height, width) / 2}

    def channels(self, cube: Cube) -> dict[str, object]:
        p = self.parameters
        return {"intensity": ring_stats.ring_std(cube, (p["cy"], p["cx"]), p["ri"], p["ro"])}


@dataclass
class _Ward:
    """Agglomerative clustering by Ward's criterion where only neighbours on a grid may merge."""

    n_clusters: int

    def labels(self, x: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
        import heapq

        n = len(x)
        size, centre = np.ones(n), x.astype(float).copy()
        index = np.arange(n).reshape(shape)
        near: list[set[int]] = [set() for _ in range(n)]
        for a, b in [(index[1:].ravel(), index[:-1].ravel()), (index[:, 1:].ravel(), index[:, :-1].ravel())]:
            for i, j in zip(a.tolist(), b.tolist(), strict=True):
                near[i].add(j)
                near[j].add(i)

        def cost(i: int, j: int) -> float:
            return float(size[i] * size[j] / (size[i] + size[j]) * ((centre[i] - centre[j]) ** 2).sum())

        stamp = [0] * n
        heap = [(cost(i, j), j, i, 0, 0) for i in range(n) for j in near[i] if j < i]
        heapq.heapify(heap)
        parent, left = list(range(n)), n
        while left > self.n_clusters and heap:
            _, i, j, si, sj = heapq.heappop(heap)
            if stamp[i] != si or stamp[j] != sj or parent[i] != i or parent[j] != j:
                continue
            centre[i] = (size[i] * centre[i] + size[j] * centre[j]) / (size[i] + size[j])
            size[i] += size[j]
            parent[j] = i
            near[i] = (near[i] | near[j]) - {i, j}
            for k in near[j] - {i}:
                near[k].discard(j)
                near[k].add(i)
            stamp[i] += 1
            left -= 1
            for k in near[i]:
                heapq.heappush(heap, (cost(i, k), i, k, stamp[i], stamp[k]))

        def root(i: int) -> int:
            while parent[i] != i:
                i = parent[i]
            return i

        roots = [root(i) for i in range(n)]
        order = {r: k for k, r in enumerate(dict.fromkeys(roots))}
        return np.array([order[r] for r in roots])


def local_peaks(image: np.ndarray, min_dist: int, n_peaks: int) -> np.ndarray:
    """Coordinates of the largest local maxima within squares of 2 * min_dist + 1, off the border."""
    d = int(min_dist)
    padded = np.pad(image, d, constant_values=-np.inf)
    windows = np.lib.stride_tricks.sliding_window_view(padded, (2 * d + 1, 2 * d + 1))
    peak = (image == windows.max(axis=(2, 3))) & (image > image.min())
    if d:
        peak[:d], peak[-d:], peak[:, :d], peak[:, -d:] = False, False, False, False
    y, x = np.nonzero(peak)
    order = np.argsort(-image[y, x], kind="stable")[:n_peaks]
    return np.stack((y[order], x[order]), axis=1)


class Cluster(Analysis):
    """Navigation positions clustered by the intensity at peaks of the standard deviation.

    The peaks and the clustering of the (small) navigation grid run on the driver, all passes over frames on Spark.
    """

    id = "CLUST"

    def defaults(self) -> dict:
        height, width = self.cube.sig_shape
        outer = min(height, width) / 2
        return {"n_clust": 20, "n_peaks": 500, "min_dist": 1, "cx": width / 2, "cy": height / 2, "ri": 0.0, "ro": outer}

    def channels(self, cube: Cube) -> dict[str, object]:
        p, (height, width) = self.parameters, cube.sig_shape
        std = np.zeros(cube.n_px)
        for px, v in reduce.stddev(cube).select("px", "std").toLocalIterator():  # one frame
            std[px] = v
        image = std.reshape(cube.sig_shape) * M.ring(p["cx"], p["cy"], width, height, p["ro"], p["ri"])
        peaks = local_peaks(image, p["min_dist"], p["n_peaks"])
        stack = np.zeros((max(1, len(peaks)), height, width))
        for k, (y, x) in enumerate(peaks):
            stack[k, y, x] = 1
        names = [f"mask_{k}" for k in range(len(stack))]
        features = np.zeros((cube.n_frames, len(stack)))
        for row in masked.apply_masks(cube, stack, names=names).toLocalIterator():  # one row per navigation position
            features[row[0]] = row[1:]
        scale = np.abs(features).mean(axis=0)
        labels = _Ward(p["n_clust"]).labels(features / np.where(scale == 0, 1, scale), cube.nav_shape) + 1
        out = cube.spark.createDataFrame(list(enumerate(labels.tolist())), "frame_id long, label int")
        return {"intensity": out}


def stat_limits(df: DataFrame, column: str, quantile: float = 0.001, snip_factor: float = 10.0) -> tuple[float, float]:
    """Robust limits for display of a column's finite values.

    An end is moved in to the values within the quantiles (of all but zeros; zero is always within) only if it is an
    outlier: farther from them than ``snip_factor`` times their own size. Two aggregates of one row.
    """
    v = F.col(column).cast("double")
    fine = df.filter(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))).select(v.alias("v"))
    solid = F.when(F.col("v") != 0, F.col("v"))
    low, high, lower, upper, zeros = fine.agg(F.min("v"), F.max("v"), F.percentile(solid, F.lit(quantile)), F.percentile(solid, F.lit(1 - quantile)), F.max(F.col("v") == 0)).first()
    if low is None:
        return 1.0, math.nextafter(1.0, math.inf)
    if lower is not None:
        if zeros:
            lower, upper = min(lower, 0.0), max(upper, 0.0)
        near_low, near_high = fine.filter(F.col("v").between(lower, upper)).agg(F.min("v"), F.max("v")).first()
        if near_low is not None:
            if near_low and abs(near_low - low) > snip_factor * abs(near_low):
                low = near_low
            if near_high and abs(near_high - high) > snip_factor * abs(near_high):
                high = near_high
    return low, high if high != low else math.nextafter(low, math.inf)
