"""User-defined operators over cubes.

A ``FrameUDF`` declares result buffers (kind nav: one row per frame; sig: one per pixel; single: one in all) and
processes a frame, a batch of frames (tile) or a whole partition. The sig and single buffers of several operators
share one scan: each task emits its partial buffers, which are merged in a tree of tasks, so the driver receives one
merged set and never the partials. Nav buffers are a lazy DataFrame of their own with a row per frame.
"""

from __future__ import annotations

import pickle
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.cube import Cube
from gridloom.operators.reduce import frames_of


@dataclass(frozen=True)
class Buffer:
    """kind: nav, sig or single; use: None, private (not shown) or result_only (made by get_results)."""

    kind: str
    extra_shape: tuple[int, ...] = ()
    dtype: object = np.float32
    use: str | None = None

    def __post_init__(self) -> None:
        if self.kind not in ("nav", "sig", "single"):
            raise ValueError(f"unknown kind {self.kind!r}")


@dataclass
class Meta:
    """What an operator may know: shapes, type of the frames, the frames at hand, their range and their coordinates."""

    nav_shape: tuple[int, ...]
    sig_shape: tuple[int, ...]
    dtype: object = np.float64
    frame_ids: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    @property
    def slice(self) -> slice:
        """From the first to behind the last of the frames at hand."""
        return slice(int(self.frame_ids[0]), int(self.frame_ids[-1]) + 1) if len(self.frame_ids) else slice(0, 0)

    @property
    def coordinates(self) -> np.ndarray:
        return np.stack(np.unravel_index(self.frame_ids, self.nav_shape), axis=-1)


class UDFError(ValueError):
    """An operator breaks its contract."""


class FrameUDF:
    """Base of user-defined operators. Keyword arguments become ``self.params`` and must suffice to make the operator anew."""

    def __init__(self, **params) -> None:  # noqa: ANN003
        self.params = params
        self.meta: Meta | None = None
        self.aux: dict[str, np.ndarray] = {}
        self.task_data: dict[str, object] = {}

    # to be overridden
    def get_result_buffers(self) -> dict[str, Buffer]:
        raise NotImplementedError

    def get_task_data(self) -> dict[str, object]:
        return {}

    def preprocess(self) -> None:
        """Once per task, before the first frame."""

    def postprocess(self) -> None:
        """Once per task, after the last frame."""

    def cleanup(self) -> None:
        """Once per task, in the end, failed or not."""

    def merge(self, dest: dict[str, np.ndarray], src: dict[str, np.ndarray]) -> None:
        """Merges partial sig and single buffers into ``dest``, in no particular order of frames."""
        raise UDFError(f"{type(self).__name__} has sig or single buffers and needs a merge")

    #: Alternative to merge, if set: merge_all(parts) gets every task's sig and single buffers in the order of their
    #: first frames and returns the merged ones. All partial buffers meet in one task.
    merge_all = None

    def get_results(self, results: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        """Final projection of the merged sig and single buffers."""
        return results

    def valid_mask(self, results: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        """Validity of each element of sig and single results, where not everything is valid."""
        return {}

    # process_frame(frame), process_tile(tile) or process_partition(partition)

    def buffer(self, kind: str, extra_shape: tuple[int, ...] = (), dtype: object = np.float32, use: str | None = None) -> Buffer:
        return Buffer(kind, tuple(extra_shape), dtype, use)

    def method(self) -> str:
        """tile before frame before partition."""
        for name in ("tile", "frame", "partition"):
            if callable(getattr(self, f"process_{name}", None)):
                return name
        raise UDFError(f"{type(self).__name__} has none of process_tile, process_frame and process_partition")

    def copy(self) -> FrameUDF:
        return type(self)(**self.params)

    def requires_merge(self) -> bool:
        return any(b.kind != "nav" and b.use != "result_only" for b in self.get_result_buffers().values())


class _Run:
    """One operator within one task."""

    def __init__(self, udf: FrameUDF, nav: tuple[int, ...], sig: tuple[int, ...], both: bool = False) -> None:
        self.udf = udf.copy()
        self.udf.meta = Meta(nav, sig, np.complex128 if both else np.float64)
        self.udf.task_data = self.udf.get_task_data()
        self.buffers = {k: b for k, b in self.udf.get_result_buffers().items() if b.use != "result_only"}
        self.method = self.udf.method()
        self.merged = {k: np.zeros((sig if b.kind == "sig" else (1,)) + b.extra_shape, b.dtype) for k, b in self.buffers.items() if b.kind != "nav"}
        self.started = False

    def batch(self, ids: np.ndarray, x: np.ndarray, aux: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        if not self.started:
            self.udf.preprocess()
            self.started = True
        u, n = self.udf, len(ids)
        nav = {k: np.zeros((n, *b.extra_shape), b.dtype) for k, b in self.buffers.items() if b.kind == "nav"}
        if self.method == "frame":
            for i in range(n):
                u.meta.frame_ids = ids[i : i + 1]
                u.aux = {k: v[i] for k, v in aux.items()}
                u.results = _View({k: v[i] for k, v in nav.items()} | self.merged, nav, i)
                u.process_frame(x[i])
        else:
            u.meta.frame_ids, u.aux = ids, aux
            u.results = _View(nav | self.merged)
            (u.process_tile if self.method == "tile" else u.process_partition)(x)
        return nav


class _View:
    """``self.results.name[:] = ...`` (or += ...) on the buffers at hand; plain assignment works too."""

    def __init__(self, arrays: dict[str, np.ndarray], nav: dict[str, np.ndarray] | None = None, at: int | None = None) -> None:
        object.__setattr__(self, "_arrays", arrays)
        object.__setattr__(self, "_nav", nav or {})
        object.__setattr__(self, "_at", at)

    def __getattr__(self, name: str) -> np.ndarray:
        arrays, nav = object.__getattribute__(self, "_arrays"), object.__getattribute__(self, "_nav")
        if name in nav:
            return nav[name][self._at, ...] if nav[name].ndim > 1 else nav[name][self._at : self._at + 1]
        try:
            return arrays[name]
        except KeyError:
            raise AttributeError(name) from None

    def __setattr__(self, name: str, value) -> None:  # noqa: ANN001
        self.__getattr__(name)[...] = value


def _nav_type(b: Buffer) -> str:
    base = {"f": "double", "i": "long", "u": "long", "b": "boolean", "U": "string", "S": "string", "O": "binary", "c": "struct<re:double,im:double>"}[np.dtype(b.dtype).kind]
    return f"array<{base}>" if b.extra_shape else base


def _nav_values(b: Buffer, v: np.ndarray) -> list:
    flat = v.reshape(len(v), -1)
    kind = np.dtype(b.dtype).kind
    conv = {"c": lambda x: {"re": float(x.real), "im": float(x.imag)}, "O": pickle.dumps, "U": str, "S": lambda x: x.decode()}.get(kind)
    rows = [[conv(x) for x in r] if conv else r.tolist() for r in flat]
    return rows if b.extra_shape else [r[0] for r in rows]


def _carry(thing) -> None:  # noqa: ANN001
    """Lets a class or function of the user's own module travel to the workers, which need not have that module."""
    module = sys.modules.get(getattr(thing, "__module__", None) or "")
    if module is not None and module.__name__.partition(".")[0] not in ("gridloom", "__main__", "builtins", "numpy") and not hasattr(module, "__path__"):
        cloudpickle.register_pickle_by_value(module)


@dataclass
class UDFResult:
    """nav: DataFrame (frame_id and nav buffers) or None; merged: final sig and single results; valid: their validity."""

    nav: DataFrame | None
    merged: dict[str, np.ndarray]
    valid: dict[str, np.ndarray]

    def __getitem__(self, name: str):  # noqa: ANN204
        return self.merged[name] if name in self.merged else self.nav.select("frame_id", name)


def _ready(udf: FrameUDF | list[FrameUDF]) -> list[FrameUDF]:
    udfs = list(udf) if isinstance(udf, (list, tuple)) else [udf]
    if not udfs:
        raise ValueError("no operator to run")
    for u in udfs:
        _carry(type(u))
        u.method()
        if u.requires_merge() and type(u).merge is FrameUDF.merge and u.merge_all is None:
            raise UDFError(f"{type(u).__name__} has sig or single buffers and needs a merge")
    return udfs


def _has_nav(u: FrameUDF) -> bool:
    return any(b.kind == "nav" and b.use != "result_only" for b in u.get_result_buffers().values())


def _finished(cube: Cube, u: FrameUDF, own: dict[str, np.ndarray], nav: DataFrame | None) -> UDFResult:
    """The operator's own last step on merged buffers, checked against what it declared."""
    final = u.copy()
    final.meta = Meta(cube.nav_shape, cube.sig_shape)
    buffers = final.get_result_buffers()
    shown = final.get_results(own) if own or any(b.use == "result_only" for b in buffers.values()) else own
    for k, v in shown.items():
        if k not in buffers:
            raise UDFError(f"get_results returned {k!r}, which is not declared")
        if np.dtype(buffers[k].dtype).kind != np.asarray(v).dtype.kind and not np.can_cast(np.asarray(v).dtype, buffers[k].dtype, "same_kind"):
            raise UDFError(f"{k!r} is declared {np.dtype(buffers[k].dtype)} but is {np.asarray(v).dtype}")
    shown = {k: v for k, v in shown.items() if buffers[k].use != "private"}
    masks = final.valid_mask(shown)
    for k, m in masks.items():
        if np.asarray(m).dtype != bool or np.shape(m) != np.shape(shown[k]):
            raise UDFError(f"the validity of {k!r} has to be a bool array of the same shape")
    valid = {k: masks.get(k, np.ones(np.shape(v), bool)) for k, v in shown.items()}
    return UDFResult(nav, shown, valid)


def _input(cube: Cube, aux: DataFrame | None) -> tuple[DataFrame, list[str]]:
    frames = cube.df if aux is None else cube.df.join(aux, "frame_id")
    return frames, [] if aux is None else [c for c in aux.columns if c != "frame_id"]


def run_udf(cube: Cube, udf: FrameUDF | list[FrameUDF], aux: DataFrame | None = None, corrections=None) -> UDFResult | list[UDFResult]:  # noqa: ANN001
    """Runs one or several operators in one pass. aux: per-frame side input, a DataFrame (frame_id, arrays ...)."""
    from gridloom.operators.corrections import correct

    udfs = _ready(udf)
    cube = correct(cube, corrections or cube.corrections)
    frames, aux_names = _input(cube, aux)
    merged = _combined(cube, udfs, _parts(cube, frames, udfs, aux_names)) if any(u.requires_merge() for u in udfs) else [{} for _ in udfs]
    results = [_finished(cube, u, own, _nav_rows(cube, frames, u, aux_names) if _has_nav(u) else None) for u, own in zip(udfs, merged, strict=True)]
    return results if isinstance(udf, (list, tuple)) else results[0]


def iterate(cube: Cube, udf: FrameUDF | list[FrameUDF], parts: int = 4, aux: DataFrame | None = None, corrections=None, wanted: np.ndarray | None = None):  # noqa: ANN001, ANN201
    """(damage, result) after each of ``parts`` ranges of frames, each of which is read once.

    damage: which of the ``wanted`` navigation positions (default: all) are done. Mergeable buffers are merged step by
    step; those with merge_all are kept by the driver, a set for every task. The nav rows of a step are kept
    (persisted), so the rows of all steps so far cost nothing more.
    """
    from gridloom.operators.corrections import correct

    udfs = _ready(udf)
    cube = correct(cube, corrections or cube.corrections)
    frames, aux_names = _input(cube, aux)
    wanted = np.ones(cube.n_frames, bool) if wanted is None else np.asarray(wanted, bool).reshape(-1)
    cuts = np.linspace(0, cube.n_frames, parts + 1).astype(int)
    held: list[tuple[int, list]] = []
    nav: list[DataFrame | None] = [None for _ in udfs]
    damage = np.zeros(cube.n_frames, bool)
    for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
        own = frames.filter(F.col("frame_id").between(a, b - 1))
        if any(u.requires_merge() for u in udfs):
            held = _joined(cube, udfs, held + _parts(cube, own, udfs, aux_names))
        for k, u in enumerate(udfs):
            if _has_nav(u):
                rows = _nav_rows(cube, own, u, aux_names).persist(StorageLevel.DISK_ONLY)
                nav[k] = rows if nav[k] is None else nav[k].unionByName(rows)
        damage[a:b] = wanted[a:b]
        merged = _combined(cube, udfs, pickle.loads(pickle.dumps(held))) if held else _fresh(udfs, cube.nav_shape, cube.sig_shape)  # noqa: S301  operators may change what they get
        results = [_finished(cube, u, m if u.requires_merge() else {}, n) for u, m, n in zip(udfs, merged, nav, strict=True)]
        yield damage.reshape(cube.nav_shape).copy(), results if isinstance(udf, (list, tuple)) else results[0]


def declared(cube: Cube, udf: FrameUDF) -> dict[str, tuple[str, tuple[int, ...], np.dtype]]:
    """Kind, shape and type of each result that would be shown, without running the operator."""
    own = udf.copy()
    own.meta = Meta(cube.nav_shape, cube.sig_shape)
    first = {"nav": cube.nav_shape, "sig": cube.sig_shape, "single": (1,)}
    return {k: (b.kind, (*first[b.kind], *b.extra_shape), np.dtype(b.dtype)) for k, b in own.get_result_buffers().items() if b.use != "private"}


def _batches(it: Iterator[pa.RecordBatch], sig: tuple[int, ...], aux_names: list[str], both: bool, whole: bool) -> Iterator[tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]]:
    """(ids, frames, aux) of each batch, or of the whole partition at once."""
    held = []
    for batch in it:
        if not batch.num_rows:
            continue
        x = frames_of(batch)
        if both:
            x = x + 1j * frames_of(batch, "frame_im")
        aux = {n: np.array(batch.column(batch.schema.get_field_index(n)).to_pylist()) for n in aux_names}
        part = (np.asarray(batch.column(0)), x.reshape(-1, *sig), aux)
        if whole:
            held.append(part)
        else:
            yield part
    if held:
        yield np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), {n: np.concatenate([h[2][n] for h in held]) for n in aux_names}


def _nav_rows(cube: Cube, frames: DataFrame, udf: FrameUDF, aux_names: list[str]) -> DataFrame:
    nav, sig, both = cube.nav_shape, cube.sig_shape, cube.complex
    shown = {k: b for k, b in udf.get_result_buffers().items() if b.kind == "nav" and b.use is None}
    kinds = {k: _nav_type(b) for k, b in shown.items()}
    types = pa.schema([("frame_id", pa.int64()), *[(k, _arrow(t)) for k, t in kinds.items()]])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = _Run(udf, nav, sig, both)
        try:
            for ids, x, aux in _batches(it, sig, aux_names, both, task.method == "partition"):
                out = task.batch(ids, x, aux)
                yield pa.record_batch([pa.array(ids), *(pa.array(_nav_values(b, out[k]), types.field(k).type) for k, b in shown.items())], schema=types)
        finally:
            task.udf.cleanup()

    return replace(cube, df=frames).mapped(run, "frame_id long, " + ", ".join(f"`{k}` {t}" for k, t in kinds.items()), *aux_names)


def _arrow(kind: str) -> pa.DataType:
    if kind.startswith("array<"):
        return pa.list_(_arrow(kind[6:-1]))
    if kind.startswith("struct"):
        return pa.struct([("re", pa.float64()), ("im", pa.float64())])
    return {"double": pa.float64(), "long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}[kind]


#: Partial results merged by one task in a level of the tree.
FAN = 32


def _joined(cube: Cube, udfs: list[FrameUDF], parts: list[tuple[int, list]]) -> list[tuple[int, list]]:
    """Merges what can be merged in any order into the first part; buffers with merge_all stay apart, with their places.

    A part is (first frame, buffers of each operator); None stands for buffers that went into another part.
    """
    if not parts:
        return []
    first = min(at for at, _ in parts)
    total = [None if u.merge_all is not None else dest for u, dest in zip(udfs, _fresh(udfs, cube.nav_shape, cube.sig_shape), strict=True)]
    ordered = []
    for at, own in parts:
        for k, u in enumerate(udfs):
            if u.merge_all is None and own[k] and total[k]:
                merger = u.copy()
                merger.meta = Meta(cube.nav_shape, cube.sig_shape)
                merger.merge(total[k], own[k])
        kept = [p if u.merge_all is not None else None for u, p in zip(udfs, own, strict=True)]
        if any(p is not None for p in kept):
            ordered.append((at, kept))
    return [(first, total), *ordered]


def _combined(cube: Cube, udfs: list[FrameUDF], parts: list[tuple[int, list]]) -> list[dict[str, np.ndarray]]:
    """Merged buffers of each operator from all parts."""
    if not parts:
        return _fresh(udfs, cube.nav_shape, cube.sig_shape)
    (_, out), *ordered = _joined(cube, udfs, parts)
    for k, u in enumerate(udfs):
        if u.merge_all is not None:
            own = u.copy()
            own.meta = Meta(cube.nav_shape, cube.sig_shape)
            out[k] = own.merge_all([p[k] for _, p in sorted(ordered, key=lambda x: x[0]) if p[k] is not None])
    return out


def _parts(cube: Cube, frames: DataFrame, udfs: list[FrameUDF], aux_names: list[str]) -> list[tuple[int, list]]:
    """Partial buffers of all tasks: merged in a tree of tasks as far as they may be merged in any order."""
    nav, sig, both = cube.nav_shape, cube.sig_shape, cube.complex
    bare = replace(cube, df=None, corrections=None, origin=None)  # what the tasks need of it: its shapes

    def packed(parts: list[tuple[int, list]]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([parts[0][0]], pa.int64()), pa.array([pickle.dumps(parts)], pa.binary())], ["first", "data"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tasks = [_Run(u, nav, sig, both) for u in udfs]
        first = None
        try:
            for ids, x, aux in _batches(it, sig, aux_names, both, any(t.method == "partition" for t in tasks)):
                first = int(ids.min()) if first is None else min(first, int(ids.min()))
                for t in tasks:
                    t.batch(ids, x, aux)
            if first is not None:
                for t in tasks:
                    t.udf.results = _View(t.merged)
                    t.udf.postprocess()
                yield packed([(first, [t.merged for t in tasks])])
        finally:
            for t in tasks:
                t.udf.cleanup()

    def fold(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, list]] = []
        for batch in it:
            for data in batch.column(1).to_pylist():
                held = _joined(bare, udfs, held + pickle.loads(data))  # noqa: S301  written by our own tasks
        if held:
            yield packed(held)

    schema = "first long, data binary"
    parts = replace(cube, df=frames).mapped(run, schema, *aux_names)
    n = parts.rdd.getNumPartitions()
    while n > 1:  # a shuffle of one row a task in each level; the frames themselves are processed where they are
        n = -(-n // FAN)
        parts = parts.repartition(n, F.xxhash64("first")).mapInArrow(fold, schema)
    rows = parts.collect()
    return [part for row in rows for part in pickle.loads(row[1])]  # noqa: S301


def _fresh(udfs: list[FrameUDF], nav: tuple[int, ...], sig: tuple[int, ...]) -> list[dict[str, np.ndarray]]:
    return [_Run(u, nav, sig).merged for u in udfs]


def map_frames(cube: Cube, f) -> DataFrame:  # noqa: ANN001
    """frame_id, result: f of every frame."""
    _carry(f)
    made = np.asarray(f(np.ones(cube.sig_shape)))
    b = Buffer("nav", made.shape, made.dtype)
    kind, sig, both = _nav_type(b), cube.sig_shape, cube.complex

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x, _ in _batches(it, sig, [], both, False):
            out = np.empty((len(ids), *made.shape), made.dtype)
            for i, frame in enumerate(x):
                out[i] = f(frame)
            yield pa.record_batch([pa.array(ids), pa.array(_nav_values(b, out), _arrow(kind))], ["frame_id", "result"])

    return cube.mapped(run, f"frame_id long, result {kind}")


def monitor(mapped: DataFrame) -> DataFrame:
    """The result of the last frame."""
    return mapped.agg(F.max("frame_id").alias("frame_id"), F.max_by("result", "frame_id").alias("result"))
