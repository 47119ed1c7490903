"""Binary detector formats: header parsers and frame decoders.

Each format is a class with ``open(path, **options) -> Layout`` (header only, on the driver) and ``frames(layout,
start, stop)`` (on an executor: those frames alone, as a matrix). Layouts are plain values that travel to tasks.
"""

from __future__ import annotations

import glob
import os
import re
import struct
import tomllib
import xml.etree.ElementTree as ET
from dataclasses import dataclass, field

import numpy as np


class FormatError(ValueError):
    """A file isn't what its format says."""


@dataclass
class Layout:
    """format, paths, shapes, dtype of the decoded frames, number of frames in the files, and the format's own facts."""

    format: str
    paths: list[str]
    nav_shape: tuple[int, ...]
    sig_shape: tuple[int, ...]
    dtype: str
    n_frames: int
    facts: dict = field(default_factory=dict)

    @property
    def n_px(self) -> int:
        return int(np.prod(self.sig_shape))


REGISTRY: dict[str, type[Format]] = {}


class Format:
    name = ""
    extensions: tuple[str, ...] = ()

    def __init_subclass__(cls) -> None:
        if cls.name:
            REGISTRY[cls.name] = cls

    @classmethod
    def open(cls, path: str, **options) -> Layout:  # noqa: ANN003
        raise NotImplementedError

    @classmethod
    def frames(cls, layout: Layout, start: int, stop: int) -> np.ndarray:
        raise NotImplementedError

    @classmethod
    def found_corrections(cls, path: str):  # noqa: ANN206
        """Corrections that come with the file; they apply where a run names none of its own."""
        return None

    @classmethod
    def detect(cls, path: str) -> bool:
        """Whether the file looks like this format."""
        if os.path.splitext(path)[1].lstrip(".").lower() not in cls.extensions:
            return False
        try:
            cls.open(path)
        except Exception:  # noqa: BLE001  whatever is wrong, it is not of this format
            return False
        return True


def _shape(x) -> tuple[int, ...]:  # noqa: ANN001
    return tuple(int(v) for v in (x.split(",") if isinstance(x, str) else x))


def _nav(options: dict, n: int, found: tuple[int, ...] | None = None) -> tuple[int, ...]:
    """The navigation shape asked for, else the one in the header, else a square or a line."""
    if options.get("nav_shape"):
        return _shape(options["nav_shape"])
    if found and int(np.prod(found)) == n:
        return tuple(found)
    side = int(round(n**0.5))
    return (side, side) if side * side == n and n else (n,)


def _strided(path: str, dtype: str, first: int, stride: int, px: int, start: int, stop: int) -> np.ndarray:
    """Frames at first + i * stride bytes; reads only those."""
    kind = np.dtype(dtype)
    out = np.empty((max(0, stop - start), px), kind)
    with open(path, "rb") as file:
        if stride == px * kind.itemsize:
            file.seek(first + start * stride)
            data = np.frombuffer(file.read(out.nbytes), kind)
            if data.size != out.size:
                raise FormatError(f"{path} ends early")
            return data.reshape(out.shape)
        if not len(out):
            return out
        # one read of all frames and what lies between them
        size = px * kind.itemsize
        file.seek(first + start * stride)
        data = file.read((stop - start - 1) * stride + size)
        if len(data) < (stop - start - 1) * stride + size:
            raise FormatError(f"{path} ends early")
        view = np.lib.stride_tricks.as_strided(np.frombuffer(data, np.uint8), (stop - start, size), (stride, 1))
        out[:] = np.ascontiguousarray(view).view(kind)
    return out


class Raw(Format):
    """Headerless frames in C order."""

    name = "raw"

    @classmethod
    def open(cls, path: str, *, dtype: str, sig_shape, nav_shape=None, offset: int = 0, **_) -> Layout:  # noqa: ANN001, ANN003
        sig = _shape(sig_shape)
        size = int(np.prod(sig)) * np.dtype(dtype).itemsize
        n = (os.path.getsize(path) - int(offset)) // size
        return Layout("raw", [path], _nav({"nav_shape": nav_shape}, n), sig, np.dtype(dtype).str, n, {"offset": int(offset)})

    @classmethod
    def frames(cls, layout: Layout, start: int, stop: int) -> np.ndarray:
        return _strided(layout.paths[0], layout.dtype, layout.facts["offset"], layout.n_px * np.dtype(layout.dtype).itemsize, layout.n_px, start, stop)


class Npy(Raw):
    name = "npy"
    extensions = ("npy",)

    @classmethod
    def open(cls, path: str, *, sig_dims: int = 2, nav_shape=None, sig_shape=None, **_) -> Layout:  # noqa: ANN001, ANN003
        with open(path, "rb") as file:
            version = np.lib.format.read_magic(file)
            shape, fortran, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(file)
            offset = file.tell()
        if fortran:
            raise FormatError("Fortran order is not supported")
        cut = len(shape) - int(sig_dims)
        sig = _shape(sig_shape) if sig_shape else shape[cut:]
        n = int(np.prod(shape)) // int(np.prod(sig))
        return Layout("npy", [path], _nav({"nav_shape": nav_shape}, n, shape[:cut]), tuple(sig), dtype.str, n, {"offset": offset})


class RawCSR(Format):
    """A TOML file that names indptr, indices and data files of a sparse matrix of frames by pixels."""

    name = "raw_csr"
    extensions = ("toml",)

    @classmethod
    def open(cls, path: str, **options) -> Layout:  # noqa: ANN003
        with open(path, "rb") as file:
            conf = tomllib.load(file)
        if conf["params"]["filetype"].lower() != "raw_csr":
            raise FormatError("not a raw_csr description")
        here = os.path.dirname(os.path.abspath(path))
        raw = conf["raw_csr"]
        files = {k: (os.path.join(here, raw[k + "_file"]), raw[k + "_dtype"]) for k in ("indptr", "indices", "data")}
        n = os.path.getsize(files["indptr"][0]) // np.dtype(files["indptr"][1]).itemsize - 1
        nav = options.get("nav_shape") or conf["params"].get("nav_shape")
        sig = _shape(options.get("sig_shape") or conf["params"]["sig_shape"])
        return Layout("raw_csr", [f for f, _ in files.values()], _nav({"nav_shape": nav}, n), sig, np.dtype(files["data"][1]).str, n, {k: d for k, (_, d) in files.items()})

    @classmethod
    def rows(cls, layout: Layout, start: int, stop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(indptr from 0, indices, data) of some frames."""
        pieces = {k: np.dtype(layout.facts[k]) for k in ("indptr", "indices", "data")}
        ptr = np.fromfile(layout.paths[0], pieces["indptr"], stop - start + 1, offset=start * pieces["indptr"].itemsize).astype(np.int64)
        n = int(ptr[-1] - ptr[0])
        read = lambda k, path: np.fromfile(path, pieces[k], n, offset=int(ptr[0]) * pieces[k].itemsize)
        return ptr - ptr[0], read("indices", layout.paths[1]).astype(np.int64), read("data", layout.paths[2])

    @classmethod
    def frames(cls, layout: Layout, start: int, stop: int) -> np.ndarray:
        ptr, indices, data = cls.rows(layout, start, stop)
        out = np.zeros((stop - start, layout.n_px), np.dtype(layout.dtype).newbyteorder("="))
        out[np.repeat(np.arange(stop - start), np.diff(ptr)), indices] = data
        return out


def numbered(path: str) -> list[str]:
    """The files of a series that differ in trailing digits, in order."""
    base, ext = os.path.splitext(path)
    found = glob.glob(glob.escape(re.sub(r"\d+$", "", base)) + "*" + glob.escape(ext))
    stem = re.sub(r"\d+$", "", base)
    return sorted((f for f in found if re.fullmatch(re.escape(stem) + r"\d*" + re.escape(ext), f)), key=lambda f: int(re.search(r"(\d*)$", os.path.splitext(f)[0])[1] or 0))


class Mib(Format):
    """Merlin: an ASCII header before each frame; U08, U16, U32 big-endian, or packed R64 of 1, 6, 12 bits."""

    name = "mib"
    extensions = ("mib", "hdr")

    @classmethod
    def open(cls, path: str, **options) -> Layout:  # noqa: ANN003
        found = None
        if path.endswith(".hdr"):
            with open(path, errors="replace") as file:
                lines = dict(line.strip().split(":\t", 1) for line in file if ":\t" in line)
            n = int(lines.get("Frames in Acquisition (Number)", 0))
            if "ScanX" in lines:
                found = (int(lines["ScanY"]), int(lines["ScanX"]))
            elif int(lines.get("Frames per Trigger (Number)", 0) or 0):
                w = int(lines["Frames per Trigger (Number)"])
                found = (n // w, w)
            paths = sorted(glob.glob(glob.escape(path[:-4]) + "*.mib"))
        else:
            paths = numbered(path)
        if not paths:
            raise FormatError(f"no .mib files for {path}")
        with open(paths[0], "rb") as file:
            start = file.read(1024).decode("ascii", "replace").split(",")
        if start[0] != "MQ1":
            raise FormatError("not a Merlin frame")
        header, chips, width, height, kind = int(start[2]), int(start[3]), int(start[4]), int(start[5]), start[6].strip().lower()
        bits = 0
        if kind.startswith("r"):
            with open(paths[0], "rb") as file:
                fields = file.read(header).decode("ascii", "replace").split(",")
            bits = int([f for f in fields if "\0" not in f][-1])
            if bits not in (1, 6, 12, 24):
                raise FormatError(f"{bits} bits a pixel")
            if bits == 24:  # two images of 12 bits
                width //= 2
        px = width * height
        size = {1: px // 8, 6: px, 12: 2 * px, 24: 4 * px}[bits] if bits else px * int(kind[1:]) // 8
        counts = [os.path.getsize(p) // (header + size) for p in paths]
        dtype = {1: "|u1", 6: "|u1", 12: ">u2", 24: ">u4"}[bits] if bits else np.dtype(f">u{int(kind[1:]) // 8}").str
        quad = bool(bits) and chips > 1
        if quad and (chips != 4 or width != 4 * height):
            raise FormatError("only single chips and 2 x 2 layouts")
        sig = (2 * height, 2 * height) if quad else (height, width)
        return Layout("mib", paths, _nav(options, sum(counts), found), sig, dtype, sum(counts), {"header": header, "size": size, "counts": counts, "bits": bits, "quad": quad})

    @classmethod
    def frames(cls, layout: Layout, start: int, stop: int) -> np.ndarray:
        f = layout.facts
        out = np.empty((stop - start, layout.n_px), np.dtype(layout.dtype).newbyteorder("="))
        at = 0
        for path, n in zip(layout.paths, f["counts"], strict=True):
            a, b = max(start, at), min(stop, at + n)
            if a < b:
                raw = _strided(path, "u1", f["header"], f["header"] + f["size"], f["size"], a - at, b - at)
                out[a - start : b - start] = cls.decode(raw, layout)
            at += n
        return out

    @staticmethod
    def decode(raw: np.ndarray, layout: Layout) -> np.ndarray:
        f, n = layout.facts, len(raw)
        raw = np.ascontiguousarray(raw)
        if not f["bits"]:
            return raw.view(layout.dtype).reshape(n, layout.n_px)
        # packed pixels fill 64-bit words from their far end
        if f["bits"] == 1:
            flat = np.unpackbits(raw.reshape(n, -1, 8)[:, :, ::-1], axis=2, bitorder="little")
        elif f["bits"] == 6:
            flat = raw.reshape(n, -1, 8)[:, :, ::-1]
        elif f["bits"] == 12:
            flat = raw.view(">u2").reshape(n, -1, 4)[:, :, ::-1]
        else:  # the high halves of all pixels come first
            halves = raw.view(">u2").reshape(n, 2, -1, 4)[..., ::-1].astype(np.uint32)
            flat = (halves[:, 0] << 12) + halves[:, 1]
        flat = flat.reshape(n, layout.n_px)
        if not f["quad"]:
            return flat
        # a stored row holds the lower right, lower left, upper right and upper left chip; lower ones are upside down
        side = layout.sig_shape[0] // 2
        chip = flat.reshape(n, side, 4, side)
        upper = np.concatenate((chip[:, :, 3], chip[:, :, 2]), axis=2)
        lower = np.concatenate((chip[:, ::-1, 1, ::-1], chip[:, ::-1, 0, ::-1]), axis=2)
        return np.concatenate((upper, lower), axis=1).reshape(n, -1)


class Blo(Format):
    """Blockfile: little-endian header, then frames with a 6-byte mark each."""

    name = "blo"
    extensions = ("blo",)
    MAGIC = 0x0102
    HEAD = np.dtype([("id", "S6"), ("magic", "<u2"), ("data_1", "<u4"), ("data_2", "<u4"), ("unknown", "<u4"), ("dp_sz", "<u2"), ("rotation", "<u2"), ("nx", "<u2"), ("ny", "<u2")])

    @classmethod
    def open(cls, path: str, **options) -> Layout:  # noqa: ANN003
        head = np.fromfile(path, cls.HEAD, 1)[0]
        if head["magic"] != cls.MAGIC:
            raise FormatError("not a blockfile")
        side, n = int(head["dp_sz"]), int(head["nx"]) * int(head["ny"])
        room = os.path.getsize(path) - int(head["data_2"])
        dtype = "<u2" if room // max(1, n) >= 2 * side * side else "|u1"
        return Layout("blo", [path], _nav(options, n, (int(head["ny"]), int(head["nx"]))), (side, side), dtype, n, {"first": int(head["data_2"])})

    @classmethod
    def frames(cls, layout: Layout, start: int, stop: int) -> np.ndarray:
        stride = 6 + layout.n_px * np.dtype(layout.dtype).itemsize
        return _strided(layout.paths[0], layout.dtype, layout.facts["first"] + 6, stride, layout.n_px, start, stop)


class Empad(Format):
    """float32 frames of 128 x 128 followed by a footer of two lines; the XML file has the scan size."""

    name = "empad"
    extensions = ("xml", "raw")

    @classmethod
    def open(cls, path: str, **options) -> Layout:  # noqa: ANN003
        found = None
        if path.endswith(".xml"):
            root = ET.parse(path).getroot()
            raw = root.find("raw_file")
            mode = root.find("scan_parameters[@mode='acquire']")
            found = (int(mode.find("scan_resolution_y").text), int(mode.find("scan_resolution_x").text))
            path = os.path.join(os.path.dirname(path), os.path.basename(raw.get("filename")))
        frame = (128 + 2) * 128 * 4
        if os.path.getsize(path) % frame:
            raise FormatError("the file isn't a whole number of frames")
        n = os.path.getsize(path) // frame
        return Layout("empad", [path], _nav(options, n, found), (128, 128), "<f4", n)

    @classmethod
    def frames(cls, layout: Layout, start: int, stop: int) -> np.ndarray:
        return _strided(layout.paths[0], layout.dtype, 0, (128 + 2) * 128 * 4, 128 * 128, start, stop)


class Mrc(Format):
    name = "mrc"
    extensions = ("mrc",)
    MODES = {0: "i1", 1: "i2", 2: "f4", 4: "c8", 6: "u2"}

    @classmethod
    def open(cls, path: str, **options) -> Layout:  # noqa: ANN003
        with open(path, "rb") as file:
            head = file.read(1024)
        order = ">" if head[212:214] == b"\x11\x11" else "<"
        nx, ny, nz, mode = struct.unpack(order + "4i", head[:16])
        (extra,) = struct.unpack(order + "i", head[92:96])
        if mode not in cls.MODES or min(nx, ny, nz) < 1:
            raise FormatError("not an MRC file")
        return Layout("mrc", [path], _nav(options, nz), (ny, nx), np.dtype(order + cls.MODES[mode]).str, nz, {"first": 1024 + extra})

    @classmethod
    def frames(cls, layout: Layout, start: int, stop: int) -> np.ndarray:
        return _strided(layout.paths[0], layout.dtype, layout.facts["first"], layout.n_px * np.dtype(layout.dtype).itemsize, layout.n_px, start, stop)


class Tvips(Format):
    """A series header of 256 bytes in the first file, and a header before each image."""

    name = "tvips"
    extensions = ("tvips",)

    @classmethod
    def open(cls, path: str, **options) -> Layout:  # noqa: ANN003
        paths = numbered(path)
        with open(paths[0], "rb") as file:
            size, version, width, height, depth = struct.unpack("<5i", file.read(20))
            file.seek(48)
            (image_header,) = struct.unpack("<i", file.read(4))
        if size != 256 or version not in (1, 2) or depth not in (8, 16):
            raise FormatError("not a TVIPS series")
        image_header = image_header if version == 2 and image_header else 12
        stride = image_header + width * height * depth // 8
        counts = [(os.path.getsize(p) - (size if k == 0 else 0)) // stride for k, p in enumerate(paths)]
        return Layout("tvips", paths, _nav(options, sum(counts)), (height, width), "|u1" if depth == 8 else "<u2", sum(counts), {"series": size, "header": image_header, "counts": counts})

    @classmethod
    def frames(cls, layout: Layout, start: int, stop: int) -> np.ndarray:
        f, parts, at = layout.facts, [], 0
        stride = f["header"] + layout.n_px * np.dtype(layout.dtype).itemsize
        for k, (path, n) in enumerate(zip(layout.paths, f["counts"], strict=True)):
            a, b = max(start, at), min(stop, at + n)
            if a < b:
                parts.append(_strided(path, layout.dtype, (f["series"] if k == 0 else 0) + f["header"], stride, layout.n_px, a - at, b - at))
            at += n
        return np.concatenate(parts) if parts else np.zeros((0, layout.n_px), layout.dtype)


class Seq(Format):
    """Norpix sequence: header of 1024 bytes (8192 for newer versions), frames padded to a true image size."""

    name = "seq"
    extensions = ("seq",)

    @classmethod
    def open(cls, path: str, **options) -> Layout:  # noqa: ANN003
        with open(path, "rb") as file:
            head = file.read(1024)
        if struct.unpack("<I", head[:4])[0] != 0xFEED:
            raise FormatError("not a Norpix sequence")
        version, header = struct.unpack("<II", head[28:36])
        width, height, depth, _, _size = struct.unpack("<5I", head[548:568])
        (n,) = struct.unpack("<I", head[572:576])
        (true,) = struct.unpack("<I", head[580:584])
        first = 8192 if version >= 5 else header or 1024
        return Layout("seq", [path], _nav(options, n), (height, width), "|u1" if depth == 8 else "<u2", n, {"first": first, "stride": true})

    @classmethod
    def frames(cls, layout: Layout, start: int, stop: int) -> np.ndarray:
        return _strided(layout.paths[0], layout.dtype, layout.facts["first"], layout.facts["stride"], layout.n_px, start, stop)

    @classmethod
    def found_corrections(cls, path: str):  # noqa: ANN206
        found = cls.corrections(path)
        return found if found.have_corrections() else None

    @classmethod
    def corrections(cls, path: str):  # noqa: ANN206
        """Dark and gain references and bad pixels beside the file, as far as they are there."""
        from gridloom.operators.corrections import CorrectionSet

        def reference(ending: str) -> np.ndarray | None:
            name = path + ending
            if not os.path.exists(name):
                return None
            layout = Mrc.open(name)
            return Mrc.frames(layout, 0, 1).reshape(layout.sig_shape).astype(np.float64)

        listed, bad = os.path.splitext(path)[0] + ".Config.Metadata.xml", None
        if os.path.exists(listed):
            points = [(int(p.get("Row")), int(p.get("Column"))) for p in ET.parse(listed).getroot().iter("Defect") if p.get("Row") and p.get("Column")]
            bad = np.array(points).T if points else None
        return CorrectionSet(reference(".dark.mrc"), reference(".gain.mrc"), bad)


class Ser(Format):
    """FEI series of images: a table of offsets, an image header before each frame."""

    name = "ser"
    extensions = ("ser",)
    KINDS = {1: "u1", 2: "u2", 3: "u4", 4: "i1", 5: "i2", 6: "i4", 7: "f4", 8: "f8"}

    @classmethod
    def open(cls, path: str, **options) -> Layout:  # noqa: ANN003
        with open(path, "rb") as file:
            order, series, version, kind, _, total, valid = struct.unpack("<hhhiiii", file.read(22))
            if order != 0x4949 or series != 0x0197 or kind != 0x4122:
                raise FormatError("not an image series")
            wide = version >= 0x220
            (table, dims) = struct.unpack("<qi" if wide else "<ii", file.read(12 if wide else 8))
            sizes = []
            for _ in range(dims):
                (size,) = struct.unpack("<i", file.read(4))
                file.read(8 + 8 + 4)
                for _ in range(2):
                    (n,) = struct.unpack("<i", file.read(4))
                    file.read(n)
                sizes.append(size)
            file.seek(table)
            offsets = np.frombuffer(file.read((8 if wide else 4) * total), "<i8" if wide else "<i4")[:valid]
            file.seek(int(offsets[0]) + 40)
            code, width, height = struct.unpack("<hii", file.read(10))
        return Layout("ser", [path], _nav(options, valid, tuple(reversed(sizes))), (height, width), "<" + cls.KINDS[code], int(valid), {"offsets": [int(o) + 50 for o in offsets]})

    @classmethod
    def frames(cls, layout: Layout, start: int, stop: int) -> np.ndarray:
        kind = np.dtype(layout.dtype)
        out = np.empty((stop - start, layout.n_px), kind)
        with open(layout.paths[0], "rb") as file:
            for k, at in enumerate(layout.facts["offsets"][start:stop]):
                file.seek(at)
                out[k] = np.frombuffer(file.read(layout.n_px * kind.itemsize), kind)
        return out


class Frms6(Format):
    """pnCCD files: a 1024-byte header, frames with 64-byte headers; the two half-sensors lie side by side and are folded.

    The first file of a series holds dark frames.
    """

    name = "frms6"
    extensions = ("frms6", "hdr")
    HEAD = np.dtype([("length", "<u2"), ("frame_length", "<u2"), ("pad", "V3"), ("version", "u1"), ("comment", "S80"), ("columns", "<u2"), ("rows", "<u2")])

    @classmethod
    def open(cls, path: str, **options) -> Layout:  # noqa: ANN003
        paths = [p for p in sorted(glob.glob(re.sub(r"_\d+\.frms6$|\.hdr$", "", path) + "_*.frms6"))]
        if not paths:
            raise FormatError("no files")
        head = np.fromfile(paths[0], cls.HEAD, 1)[0]
        columns, rows = int(head["columns"]), int(head["rows"])
        if (head["length"], head["frame_length"], head["version"]) != (1024, 64, 6) or not columns or not rows:
            raise FormatError("not a pnCCD file")
        frame = 64 + columns * rows * 2
        counts = [max(0, os.path.getsize(p) - 1024) // frame for p in paths]
        factor = int(options.get("unbin", 1))
        n = sum(counts[1:])
        return Layout("frms6", paths, _nav(options, n), (2 * rows * factor, columns // 2), "<u2", n, {"columns": columns, "rows": rows, "counts": counts, "unbin": factor})

    @classmethod
    def _read(cls, layout: Layout, k: int, a: int, b: int) -> np.ndarray:
        f = layout.facts
        px = f["columns"] * f["rows"]
        raw = _strided(layout.paths[k], "<u2", 1024 + 64, 64 + 2 * px, px, a, b).reshape(b - a, f["rows"], f["columns"])
        half = f["columns"] // 2
        folded = np.concatenate((raw[:, :, :half], raw[:, ::-1, half:][:, :, ::-1]), axis=1)
        return np.repeat(folded, f["unbin"], axis=1).reshape(b - a, -1)

    @classmethod
    def frames(cls, layout: Layout, start: int, stop: int) -> np.ndarray:
        parts, at = [], 0
        for k, n in enumerate(layout.facts["counts"][1:], 1):
            a, b = max(start, at), min(stop, at + n)
            if a < b:
                parts.append(cls._read(layout, k, a - at, b - at))
            at += n
        return np.concatenate(parts) if parts else np.zeros((0, layout.n_px), layout.dtype)

    @classmethod
    def dark(cls, layout: Layout) -> np.ndarray:
        """Mean of the dark frames."""
        return cls._read(layout, 0, 0, layout.facts["counts"][0]).mean(axis=0).reshape(layout.sig_shape)


class Dm(Format):
    """DM3 and DM4: a stack of files with a frame each (``paths``), or one file with 3 or 4 dimensions."""

    name = "dm"
    extensions = ("dm3", "dm4")
    KINDS = {1: "i2", 2: "f4", 3: "c8", 6: "u1", 7: "i4", 9: "i1", 10: "u2", 11: "u4", 12: "f8", 13: "c16"}
    SIZES = {2: "h", 3: "i", 4: "H", 5: "I", 6: "f", 7: "d", 8: "b", 9: "b", 10: "b", 11: "q", 12: "Q"}

    @classmethod
    def images(cls, path: str) -> list[dict]:
        """Dimensions, type and place of every image in a file."""
        out: list[dict] = []
        with open(path, "rb") as file:
            (version,) = struct.unpack(">i", file.read(4))
            if version not in (3, 4):
                raise FormatError("not a DM3 or DM4 file")
            long = ">q" if version == 4 else ">i"
            width = struct.calcsize(long)
            num = lambda: struct.unpack(long, file.read(width))[0]
            num()
            order = "<" if struct.unpack(">i", file.read(4))[0] else ">"
            found: dict[tuple[str, ...], object] = {}

            def group(path: tuple[str, ...]) -> None:
                file.read(2)
                for k in range(num()):
                    kind = file.read(1)[0]
                    (n,) = struct.unpack(">H", file.read(2))
                    name = file.read(n).decode("latin-1") or str(k)
                    if version == 4:
                        num()
                    if kind == 20:
                        group((*path, name))
                    else:
                        file.read(4)
                        found[(*path, name)] = value([num() for _ in range(num())])

            def size_of(info: list[int]) -> int:
                if info[0] == 15:
                    return sum(struct.calcsize("<" + cls.SIZES[t]) for t in info[4::2])
                return struct.calcsize("<" + cls.SIZES[info[0]])

            def value(info: list[int]) -> object:
                if info[0] in cls.SIZES:
                    return struct.unpack(order + cls.SIZES[info[0]], file.read(size_of(info)))[0]
                n = info[-1] * size_of(info[1:-1]) if info[0] == 20 else info[1] * 2 if info[0] == 18 else size_of(info)
                at = file.tell()
                file.seek(n, 1)
                return (at, n)

            group(())
        k = 0
        while ("ImageList", str(k), "ImageData", "Data") in found:
            base = ("ImageList", str(k), "ImageData")
            dims = []
            while (*base, "Dimensions", str(len(dims))) in found:
                dims.append(int(found[(*base, "Dimensions", str(len(dims)))]))
            out.append({"shape": tuple(reversed(dims)), "dtype": np.dtype(order + cls.KINDS[found[(*base, "DataType")]]).str if found[(*base, "DataType")] in cls.KINDS else None, "at": found[(*base, "Data")][0]})
            k += 1
        return out

    @classmethod
    def open(cls, path: str, **options) -> Layout:  # noqa: ANN003
        paths = list(options.get("paths") or [path])
        image = cls.images(paths[0])[-1]
        if len(paths) > 1 or len(image["shape"]) == 2:
            if len(image["shape"]) != 2:
                raise FormatError("a stack needs a frame per file")
            places = [cls.images(p)[-1]["at"] for p in paths]
            return Layout("dm", paths, _nav(options, len(paths)), image["shape"], image["dtype"], len(paths), {"at": places})
        shape = image["shape"]
        if len(shape) not in (3, 4):
            raise FormatError(f"{len(shape)} dimensions")
        n = int(np.prod(shape[:-2]))
        return Layout("dm", paths, _nav(options, n, shape[:-2]), shape[-2:], image["dtype"], n, {"at": [image["at"]], "single": True})

    @classmethod
    def frames(cls, layout: Layout, start: int, stop: int) -> np.ndarray:
        size = layout.n_px * np.dtype(layout.dtype).itemsize
        if layout.facts.get("single"):
            return _strided(layout.paths[0], layout.dtype, layout.facts["at"][0], size, layout.n_px, start, stop)
        return np.concatenate([_strided(layout.paths[i], layout.dtype, layout.facts["at"][i], size, layout.n_px, 0, 1) for i in range(start, stop)])


class K2IS(Format):
    """Eight sector files of packed 12-bit blocks. A frame's blocks share a frame number; sectors stand side by side."""

    name = "k2is"
    extensions = ("gtg", "bin")
    BLOCK, HEADER, ROWS, COLUMNS = 0x5758, 40, 930, 16
    SECTORS, BLOCKS = 8, 32  # blocks of a frame in a sector

    @classmethod
    def open(cls, path: str, **options) -> Layout:  # noqa: ANN003
        base = re.sub(r"[1-8]\.bin$|\.gtg$", "", path)
        paths = sorted(glob.glob(glob.escape(base) + "[1-8].bin"))
        if len(paths) != cls.SECTORS:
            raise FormatError(f"{len(paths)} of {cls.SECTORS} sector files")
        starts = []
        for p in paths:
            head = cls.headers(p, 0, 2 * cls.BLOCKS)
            if (head["sync"] != 0xFFFF0055).any():
                raise FormatError("a block without its mark")
            starts.append(head["frame"])
        # the first frame number that begins, whole, in every sector
        first = max(int(h[0]) if (h == h[0]).sum() == cls.BLOCKS else int(h[0]) + 1 for h in starts)
        skip = [int(np.flatnonzero(h >= first)[0]) for h in starts]
        n = min((os.path.getsize(p) // cls.BLOCK - s) // cls.BLOCKS for p, s in zip(paths, skip, strict=True))
        return Layout("k2is", paths, _nav(options, n), (2 * cls.ROWS, cls.COLUMNS * cls.BLOCKS // 2 * cls.SECTORS), "<u2", n, {"skip": skip})

    @classmethod
    def headers(cls, path: str, first: int, n: int) -> np.ndarray:
        kind = np.dtype({"names": ["sync", "x0", "y0", "frame"], "formats": [">u4", ">u2", ">u2", ">u4"], "offsets": [0, 28, 30, 24], "itemsize": cls.BLOCK})
        n = min(n, os.path.getsize(path) // cls.BLOCK - first)
        return np.fromfile(path, kind, n, offset=first * cls.BLOCK)

    @staticmethod
    def unpack(data: np.ndarray) -> np.ndarray:
        """Pairs of 12-bit values from three bytes each, little-endian."""
        three = data.reshape(*data.shape[:-1], -1, 3).astype(np.uint16)
        low, high = three[..., 0] | (three[..., 1] & 0x0F) << 8, three[..., 1] >> 4 | three[..., 2] << 4
        return np.stack((low, high), axis=-1).reshape(*data.shape[:-1], -1)

    @classmethod
    def frames(cls, layout: Layout, start: int, stop: int) -> np.ndarray:
        height, width = layout.sig_shape
        out = np.zeros((stop - start, height, width), np.uint16)
        own = width // cls.SECTORS
        for s, (path, skip) in enumerate(zip(layout.paths, layout.facts["skip"], strict=True)):
            with open(path, "rb") as file:
                file.seek((skip + start * cls.BLOCKS) * cls.BLOCK)
                data = np.frombuffer(file.read((stop - start) * cls.BLOCKS * cls.BLOCK), np.uint8).reshape(stop - start, cls.BLOCKS, cls.BLOCK)
            head = cls.headers(path, skip + start * cls.BLOCKS, (stop - start) * cls.BLOCKS).reshape(stop - start, cls.BLOCKS)
            px = cls.unpack(data[..., cls.HEADER :]).reshape(stop - start, cls.BLOCKS, cls.ROWS, cls.COLUMNS)
            for i in range(stop - start):
                for b in range(cls.BLOCKS):
                    y, x = int(head["y0"][i, b]), s * own + int(head["x0"][i, b])
                    out[i, y : y + cls.ROWS, x : x + cls.COLUMNS] = px[i, b]
        return out.reshape(stop - start, -1)


class Hdf5(Format):
    """The largest array of three or more dimensions; needs h5py."""

    name = "hdf5"
    extensions = ("h5", "hdf5", "hspy", "nxs")

    @classmethod
    def open(cls, path: str, *, ds_path: str | None = None, sig_dims: int = 2, **options) -> Layout:  # noqa: ANN003
        import h5py

        with h5py.File(path, "r") as file:
            if ds_path is None:
                found: list[tuple[int, str]] = []
                file.visititems(lambda name, x: found.append((x.size, name)) if isinstance(x, h5py.Dataset) and x.ndim >= 3 else None)
                if not found:
                    raise FormatError("no array of three dimensions")
                ds_path = max(found)[1]
            shape, dtype = file[ds_path].shape, file[ds_path].dtype
        cut = len(shape) - int(sig_dims)
        n = int(np.prod(shape[:cut]))
        return Layout("hdf5", [path], _nav(options, n, shape[:cut]), tuple(shape[cut:]), dtype.str, n, {"ds_path": ds_path, "shape": tuple(shape[:cut])})

    @classmethod
    def frames(cls, layout: Layout, start: int, stop: int) -> np.ndarray:
        import h5py

        with h5py.File(layout.paths[0], "r") as file:
            data = file[layout.facts["ds_path"]]
            rows = [data[np.unravel_index(i, layout.facts["shape"])] for i in range(start, stop)]
        return np.stack(rows).reshape(stop - start, -1)
