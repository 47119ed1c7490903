"""Sinks: cubes as .npy, Parquet and detector formats of fixed records, results as .npz, raw, .tiff or .npy files.

A cube goes into one file: the driver writes the header into a file of full size, each task writes the frames
it has at their places, and the file gets its name when all are done. Executors must reach the path (a shared folder).
"""

from __future__ import annotations

import io
import os
import struct
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from gridloom.cube import Cube
from gridloom.operators.reduce import frames_of


@dataclass(frozen=True)
class FixedLayout:
    """A file with a header and records of one size: head, bytes before a frame, type of its pixels, bytes after it.

    ``spare`` records with blank frames follow those of the cube, where a header can't say its number of frames.
    """

    head: bytes
    before: bytes
    dtype: str
    after: int = 0
    spare: int = 0


def _npy(cube: Cube, dtype: str) -> FixedLayout:
    head = io.BytesIO()
    np.lib.format.write_array_header_1_0(head, {"descr": dtype, "fortran_order": False, "shape": (*cube.nav_shape, *cube.sig_shape)})
    return FixedLayout(head.getvalue(), b"", dtype)


def _plain(cube: Cube, dtype: str) -> FixedLayout:
    return FixedLayout(b"", b"", dtype)


def _mib(cube: Cube, dtype: str) -> FixedLayout:
    """Unpacked big-endian counters of one chip."""
    kind = np.dtype(dtype).newbyteorder(">")
    height, width = cube.sig_shape
    fields = ["MQ1", "000001", "00384", "01", f"{width:04d}", f"{height:04d}", f"U{8 * kind.itemsize:02d}", "1x1", "01"]
    return FixedLayout(b"", ",".join(fields).encode().ljust(384, b"\0"), kind.str)


def _mrc(cube: Cube, dtype: str) -> FixedLayout:
    modes = {"|i1": 0, "<i2": 1, "<f4": 2, "<c8": 4, "<u2": 6}
    height, width = cube.sig_shape
    return FixedLayout(struct.pack("<4i", width, height, cube.n_frames, modes[np.dtype(dtype).str]).ljust(1024, b"\0"), b"", dtype)


def _blo(cube: Cube, dtype: str) -> FixedLayout:
    """The header's scan is the cube's if its 16-bit sizes can hold it, else another grid of the same frames.

    Of those grids it is the one with the fewest spare frames, which is none unless the number has no such factors;
    readers give the navigation shape to have the cube's own.
    """
    from gridloom.sources.formats import Blo

    head = np.zeros(1, Blo.HEAD)
    n, most, (side, other) = cube.n_frames, np.iinfo(Blo.HEAD["nx"]).max, cube.sig_shape
    if side != other:
        raise ValueError("a blockfile has square frames")
    if n > most**2:
        raise ValueError(f"a blockfile has at most {most} x {most} frames")
    if len(cube.nav_shape) == 2 and max(cube.nav_shape) <= most:
        ny, nx = cube.nav_shape
    else:
        widths = np.arange(max(1, -(-n // most)), most + 1)
        nx = int(widths[np.argmin(-n % widths)])
        ny = -(-n // nx)
    head["magic"], head["data_2"], head["dp_sz"], head["nx"], head["ny"] = Blo.MAGIC, 256, side, nx, ny
    return FixedLayout(head.tobytes().ljust(256, b"\0"), b"\xaa\x55\0\0\0\0", dtype, spare=nx * ny - n)


def _seq(cube: Cube, dtype: str) -> FixedLayout:
    kind, head = np.dtype(dtype), bytearray(8192)
    height, width = cube.sig_shape
    size, after = cube.n_px * kind.itemsize, 16
    struct.pack_into("<I", head, 0, 0xFEED)
    struct.pack_into("<II", head, 28, 5, 1024)
    struct.pack_into("<5I", head, 548, width, height, 8 * kind.itemsize, 8 * kind.itemsize, size)
    struct.pack_into("<I", head, 572, cube.n_frames)
    struct.pack_into("<I", head, 580, size + after)
    return FixedLayout(bytes(head), b"", dtype, after)


def _tvips(cube: Cube, dtype: str) -> FixedLayout:
    height, width = cube.sig_shape
    head = struct.pack("<13i", 256, 2, width, height, 8 * np.dtype(dtype).itemsize, *[0] * 7, 24).ljust(256, b"\0")
    return FixedLayout(head, bytes(24), dtype)


LAYOUTS: dict[str, Callable[[Cube, str], FixedLayout]] = {"npy": _npy, "raw": _plain, "mib": _mib, "mrc": _mrc, "blo": _blo, "seq": _seq, "tvips": _tvips}


def write_frames(cube: Cube, path: str, kind: str = "npy", dtype: object = np.float32, overwrite: bool = False) -> None:
    """Writes all frames into one file of a format of fixed records; runs of neighbouring frames are one write.

    Selected cubes are refused, since their file would have holes. A task that runs again writes the same bytes.
    """
    if cube.selected:
        raise RuntimeError("a cube with a region of interest can't be written as a whole")
    if os.path.exists(path) and not overwrite:
        raise FileExistsError(path)
    layout = LAYOUTS[kind](cube, np.dtype(dtype).str)
    first, size = len(layout.head), cube.n_px * np.dtype(layout.dtype).itemsize
    stride = len(layout.before) + size + layout.after
    part = f"{path}.{uuid.uuid4().hex}.part"
    with open(part, "wb") as file:
        file.write(layout.head)
        file.truncate(first + (cube.n_frames + layout.spare) * stride)
        for k in range(cube.n_frames, cube.n_frames + layout.spare):
            file.seek(first + k * stride)
            file.write(layout.before)
    both = cube.complex

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, lead = 0, len(layout.before)
        with open(part, "r+b") as file:
            for batch in batches:
                if not batch.num_rows:
                    continue
                ids, x = np.asarray(batch.column(0)), frames_of(batch)
                x = np.ascontiguousarray((x + 1j * frames_of(batch, "frame_im") if both else x).astype(layout.dtype))
                records = np.zeros((len(ids), stride), np.uint8)
                records[:, :lead] = np.frombuffer(layout.before, np.uint8)
                records[:, lead : lead + size] = x.view(np.uint8).reshape(len(ids), size)
                for run in np.split(np.arange(len(ids)), np.flatnonzero(np.diff(ids) != 1) + 1):
                    file.seek(first + int(ids[run[0]]) * stride)
                    file.write(records[run[0] : run[-1] + 1].tobytes())
                n += len(ids)
        yield pa.record_batch([pa.array([n])], ["n"])

    try:
        cube.df.select("frame_id", "frame", *(["frame_im"] if both else [])).mapInArrow(put, "n long").agg({"n": "sum"}).collect()
        os.replace(part, path)
    finally:
        if os.path.exists(part):
            os.remove(part)


def write_npy(cube: Cube, path: str, dtype: object = np.float32, overwrite: bool = False) -> None:
    """All frames as one .npy file."""
    if not path.endswith(".npy"):
        raise ValueError(f"{path} does not end in .npy")
    write_frames(cube, path, "npy", dtype, overwrite)


def write_csr(cube: Cube, path: str, dtype: object = np.float32, overwrite: bool = False) -> None:
    """Frames as a sparse matrix: a TOML description and its three files.

    The driver keeps one count for each frame, which is what the index file holds.
    """
    if not path.endswith(".toml"):
        raise ValueError(f"{path} does not end in .toml")
    if os.path.exists(path) and not overwrite:
        raise FileExistsError(path)
    counts = np.zeros(cube.n_frames, np.int64)
    used = F.size(F.filter("frame", lambda v: v != 0))
    for frame_id, n in cube.df.select("frame_id", used).toLocalIterator():
        counts[frame_id] = n
    stem, kind = path[:-5], np.dtype(dtype)
    names = {k: f"{stem}.{k}" for k in ("indptr", "indices", "data")}
    starts = np.concatenate(([0], np.cumsum(counts)))
    starts.astype("<i8").tofile(names["indptr"])
    for key, size in (("indices", 4), ("data", kind.itemsize)):
        with open(names[key], "wb") as file:
            file.truncate(int(starts[-1]) * size)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.memmap(names["indptr"], "<i8", "r")
        with open(names["indices"], "r+b") as indices, open(names["data"], "r+b") as data:
            for batch in batches:
                for frame_id, frame in zip(batch.column(0).to_pylist(), frames_of(batch) if batch.num_rows else [], strict=True):
                    at = np.flatnonzero(frame)
                    indices.seek(4 * int(place[frame_id]))
                    indices.write(at.astype("<i4").tobytes())
                    data.seek(kind.itemsize * int(place[frame_id]))
                    data.write(frame[at].astype(kind).tobytes())
        yield pa.record_batch([pa.array([0])], ["n"])

    cube.df.select("frame_id", "frame").mapInArrow(put, "n long").agg({"n": "sum"}).collect()
    shapes = {k: "[" + ", ".join(map(str, v)) + "]" for k, v in (("nav", cube.nav_shape), ("sig", cube.sig_shape))}
    base = {k: os.path.basename(v) for k, v in names.items()}
    with open(path, "w") as file:
        file.write(f'[params]\nfiletype = "raw_csr"\nnav_shape = {shapes["nav"]}\nsig_shape = {shapes["sig"]}\n\n[raw_csr]\n')
        for key, type_ in (("indptr", "<i8"), ("indices", "<i4"), ("data", kind.str)):
            file.write(f'{key}_file = "{base[key]}"\n{key}_dtype = "{type_}"\n')


def write_parquet(cube: Cube, path: str, overwrite: bool = False) -> None:
    """Frames sorted by frame_id within range partitions, so that selections prune row groups."""
    cube.df.repartitionByRange("frame_id").sortWithinPartitions("frame_id").write.mode("overwrite" if overwrite else "errorifexists").parquet(path)


def _npz(path: str, channels: dict[str, np.ndarray]) -> None:
    np.savez(path, **channels)


def _npz_compressed(path: str, channels: dict[str, np.ndarray]) -> None:
    np.savez_compressed(path, **channels)


def _raw(path: str, channels: dict[str, np.ndarray]) -> None:
    np.stack([np.asarray(v) for v in channels.values()]).tofile(path)


def _tiff(path: str, channels: dict[str, np.ndarray]) -> None:
    """A page of float32 per channel, uncompressed, little-endian."""
    pages = [np.ascontiguousarray(np.asarray(v, np.float32)) for v in channels.values()]
    with open(path, "wb") as file:
        file.write(b"II*\0" + struct.pack("<I", 8))
        at = 8
        for k, page in enumerate(pages):
            height, width = page.shape
            data_at = at + 2 + 12 * 10 + 4
            after = data_at + page.nbytes
            after += after % 2
            tags = [(256, 4, width), (257, 4, height), (258, 3, 32), (259, 3, 1), (262, 3, 1), (273, 4, data_at), (277, 3, 1), (278, 4, height), (279, 4, page.nbytes), (339, 3, 3)]
            file.write(struct.pack("<H", len(tags)))
            for tag, kind, value in tags:
                file.write(struct.pack("<HHII", tag, kind, 1, value))
            file.write(struct.pack("<I", after if k < len(pages) - 1 else 0))
            file.write(page.tobytes().ljust(after - data_at, b"\0"))
            at = after


def _hdf5(path: str, channels: dict[str, np.ndarray]) -> None:
    import h5py  # optional

    with h5py.File(path, "w") as file:
        for name, value in channels.items():
            file[name] = value


FORMATS: dict[str, Callable[[str, dict[str, np.ndarray]], None]] = {"NPZ": _npz, "NPZ_COMPRESSED": _npz_compressed, "RAW": _raw, "TIFF": _tiff, "HDF5": _hdf5}


def write_results(path: str, channels: dict[str, np.ndarray], kind: str) -> None:
    """Result channels (small arrays) into one file of the given kind."""
    if kind not in FORMATS:
        raise ValueError(f"unknown kind {kind!r}; there are {sorted(FORMATS)}")
    FORMATS[kind](path, channels)
