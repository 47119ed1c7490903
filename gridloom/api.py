"""The user's entry point: load cubes, make and run analyses, run operators, export."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from gridloom import analysis as A
from gridloom import sinks, sources, udf
from gridloom.cube import Cube
from gridloom.operators.corrections import CorrectionSet, correct
from gridloom.session import ship


class Context:
    def __init__(self, spark: SparkSession | None = None) -> None:
        self.spark = ship(spark or SparkSession.builder.getOrCreate())

    def load(self, filetype: str, path: str | None = None, **options) -> Cube:  # noqa: ANN003
        return sources.load(self.spark, filetype, path, **options)

    # analyses
    def create(self, name: str, cube: Cube, **parameters) -> A.Analysis:  # noqa: ANN003
        """An analysis by its registered id."""
        if name not in A.REGISTRY:
            raise ValueError(f"unknown analysis {name!r}; there are {sorted(A.REGISTRY)}")
        return A.REGISTRY[name](cube, **parameters)

    def create_sum_analysis(self, cube: Cube, **p) -> A.Analysis:  # noqa: ANN003
        return A.SumFrames(cube, **p)

    def create_sumsig_analysis(self, cube: Cube, **p) -> A.Analysis:  # noqa: ANN003
        return A.SumSig(cube, **p)

    def create_sd_analysis(self, cube: Cube, **p) -> A.Analysis:  # noqa: ANN003
        return A.SDFrames(cube, **p)

    def create_mask_analysis(self, factories, cube: Cube, **p) -> A.Analysis:  # noqa: ANN001, ANN003
        return A.Masks(cube, factories=factories if isinstance(factories, (list, tuple)) else [factories], **p)

    def create_disk_analysis(self, cube: Cube, **p) -> A.Analysis:  # noqa: ANN003
        return A.DiskMask(cube, **p)

    def create_ring_analysis(self, cube: Cube, **p) -> A.Analysis:  # noqa: ANN003
        return A.RingMask(cube, **p)

    def create_point_analysis(self, cube: Cube, **p) -> A.Analysis:  # noqa: ANN003
        return A.PointMask(cube, **p)

    def create_com_analysis(self, cube: Cube, **p) -> A.Analysis:  # noqa: ANN003
        if len(cube.nav_shape) != 2 or len(cube.sig_shape) != 2:
            raise ValueError("the centre of mass needs two navigation and two signal axes")
        if p.get("mask_radius_inner") is not None and p.get("mask_radius") is None:
            raise ValueError("an inner radius needs an outer one")
        return A.CenterOfMass(cube, **p)

    def create_radial_fourier_analysis(self, cube: Cube, **p) -> A.Analysis:  # noqa: ANN003
        return A.RadialFourier(cube, **p)

    def create_pick_analysis(self, cube: Cube, **p) -> A.Analysis:  # noqa: ANN003
        return A.PickFrame(cube, **p)

    def run(self, analysis: A.Analysis, roi=None, corrections: CorrectionSet | None = None) -> dict[str, object]:  # noqa: ANN001
        """The analysis's channels."""
        cube = analysis.cube.select(analysis.selection() if roi is None else roi)
        return analysis.channels(correct(cube, corrections or cube.corrections))

    # operators
    def run_udf(self, cube: Cube, operators: udf.FrameUDF | list[udf.FrameUDF], roi=None, corrections: CorrectionSet | None = None, aux: DataFrame | None = None):  # noqa: ANN001, ANN201
        return udf.run_udf(cube.select(roi), operators, aux, corrections)

    def run_udf_iter(self, cube: Cube, operators: udf.FrameUDF | list[udf.FrameUDF], parts: int = 4, roi=None, corrections: CorrectionSet | None = None, aux: DataFrame | None = None) -> Iterator[tuple[np.ndarray, udf.UDFResult | list[udf.UDFResult]]]:  # noqa: ANN001
        """Partial results after each of ``parts`` ranges of frames: which positions are done, and the result so far."""
        return udf.iterate(cube.select(roi), operators, parts, aux, corrections, cube.mask_of(roi))

    def inspect_udf(self, cube: Cube, operator: udf.FrameUDF) -> dict[str, tuple]:
        """Kind, shape and type of an operator's results, without running it."""
        return udf.declared(cube, operator)

    def map(self, cube: Cube, f: Callable, roi=None) -> DataFrame:  # noqa: ANN001
        return udf.map_frames(cube.select(roi), f)

    def inspect(self, result: DataFrame) -> list[tuple[str, str]]:
        """Names and types of a result, without running it."""
        return result.dtypes

    # sinks
    def export_dataset(self, cube: Cube, path: str, overwrite: bool = False, dtype: object = np.float32) -> None:
        sinks.write_npy(cube, path, dtype, overwrite)

    def write(self, cube: Cube, path: str, kind: str, dtype: object = np.float32, overwrite: bool = False) -> None:
        """All frames as one file of another format: raw, mib, mrc, blo, seq, tvips or raw_csr."""
        if kind == "raw_csr":
            sinks.write_csr(cube, path, dtype, overwrite)
        else:
            sinks.write_frames(cube, path, kind, dtype, overwrite)

    def close(self) -> None:
        """Leaves the session to its owner."""
