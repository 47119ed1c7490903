"""Readers against files made here after the published layouts."""

import struct

import numpy as np
import pytest

from gridloom.sources import detect
from gridloom.sources import formats as f


def test_ser(tmp_path):
    x = np.random.default_rng(0).integers(0, 60000, (6, 5, 7)).astype("<u2")
    head = 22 + 12 + 2 * (4 + 8 + 8 + 4 + 4 + 4)
    dims = b"".join(struct.pack("<iddiii", n, 0.0, 1.0, 0, 0, 0) for n in (3, 2))
    frame = 50 + x[0].nbytes
    table = head
    first = table + 8 * 6
    offsets = np.array([first + k * frame for k in range(6)], "<i8").tobytes()
    body = b"".join(bytes(40) + struct.pack("<hii", 2, 7, 5) + v.tobytes() for v in x)
    data = struct.pack("<hhhiiii", 0x4949, 0x0197, 0x0220, 0x4122, 0x4152, 6, 6) + struct.pack("<qi", table, 2) + dims + offsets + body
    assert len(dims) + 34 == head
    path = tmp_path / "a.ser"
    path.write_bytes(data)
    layout = f.Ser.open(str(path))
    assert layout.nav_shape == (2, 3) and layout.sig_shape == (5, 7)
    assert (f.Ser.frames(layout, 2, 6).reshape(-1, 5, 7) == x[2:]).all() and detect(str(path)) == "ser"


def _dm(version, x, order="<"):
    wide = ">q" if version == 4 else ">i"
    num = lambda v: struct.pack(wide, v)

    def tag(name, info, data):
        out = b"%%%%" + num(len(info)) + b"".join(map(num, info)) + data
        return b"\x15" + struct.pack(">H", len(name)) + name.encode() + (num(len(out)) if version == 4 else b"") + out

    def group(name, *members):
        out = b"\1\0" + num(len(members)) + b"".join(members)
        return b"\x14" + struct.pack(">H", len(name)) + name.encode() + (num(len(out)) if version == 4 else b"") + out

    def image(a):
        code = {"u2": 10, "f4": 2}[a.dtype.str[1:]]
        array = {10: 4, 2: 6}[code]
        return group("", group("ImageData", tag("Data", [20, array, a.size], a.astype(order + a.dtype.str[1:]).tobytes()), tag("DataType", [3], struct.pack("<i", code)), group("Dimensions", *(tag("", [3], struct.pack("<i", n)) for n in reversed(a.shape)))))

    text = "abc".encode("utf-16-le")
    members = [tag("Note", [20, 4, 3], text), tag("Area", [15, 0, 2, 0, 6, 0, 6], struct.pack("<ff", 1, 2)), group("ImageList", image(np.zeros((3, 3), "<u2")), image(x))]
    root = b"\1\0" + num(len(members)) + b"".join(members)
    return struct.pack(">i", version) + num(len(root)) + struct.pack(">i", 1) + root


@pytest.mark.parametrize("version", [3, 4])
def test_dm(tmp_path, version):
    x = np.random.default_rng(0).integers(0, 60000, (2, 3, 4, 5)).astype("<u2")
    path = tmp_path / f"a.dm{version}"
    path.write_bytes(_dm(version, x))
    layout = f.Dm.open(str(path))
    assert layout.nav_shape == (2, 3) and (f.Dm.frames(layout, 1, 6).reshape(-1, 4, 5) == x.reshape(6, 4, 5)[1:]).all()
    stack = []
    for k in range(3):
        stack.append(str(tmp_path / f"s{k}.dm{version}"))
        (tmp_path / f"s{k}.dm{version}").write_bytes(_dm(version, x[0, k].astype("<f4")))
    layout = f.Dm.open(stack[0], paths=stack)
    assert layout.n_frames == 3 and (f.Dm.frames(layout, 0, 3).reshape(3, 4, 5) == x[0]).all()


def test_frms6(tmp_path):
    rng = np.random.default_rng(0)
    rows, columns = 3, 8
    stored = rng.integers(0, 60000, (5, rows, columns)).astype("<u2")
    head = np.zeros(1, f.Frms6.HEAD)
    head["length"], head["frame_length"], head["version"], head["columns"], head["rows"] = 1024, 64, 6, columns, rows
    for k, part in enumerate((stored[:2], stored[2:4], stored[4:])):
        (tmp_path / f"C_{k:03d}.frms6").write_bytes(head.tobytes().ljust(1024, b"\0") + b"".join(bytes(64) + v.tobytes() for v in part))
    layout = f.Frms6.open(str(tmp_path / "C_000.frms6"))
    assert layout.n_frames == 3 and layout.sig_shape == (6, 4)
    want = np.concatenate((stored[:, :, :4], stored[:, ::-1, 4:][:, :, ::-1]), axis=1)
    assert (f.Frms6.frames(layout, 0, 3).reshape(-1, 6, 4) == want[2:]).all()
    assert np.allclose(f.Frms6.dark(layout), want[:2].mean(0))
    assert f.Frms6.open(str(tmp_path / "C_000.frms6"), unbin=2).sig_shape == (12, 4)


def test_k2is(tmp_path):
    k, n = f.K2IS, 2
    x = np.random.default_rng(0).integers(0, 4096, (n, 1860, 2048)).astype(np.uint16)
    for s in range(8):
        blocks = []
        # the sectors start at different places: some see the end of an earlier frame
        blocks += [_block(np.zeros((930, 16), np.uint16), 6, 0, 0)] * (s % 3)
        for i in range(n):
            for y in (0, 930):
                for xx in range(0, 256, 16):
                    blocks.append(_block(x[i, y : y + 930, s * 256 + xx : s * 256 + xx + 16], 7 + i, xx, y))
        (tmp_path / f"Capture{s + 1}.bin").write_bytes(b"".join(blocks))
    layout = k.open(str(tmp_path / "Capture1.bin"))
    assert layout.n_frames == n and layout.sig_shape == (1860, 2048)
    assert (k.frames(layout, 0, n).reshape(x.shape) == x).all() and (k.frames(layout, 1, n).reshape(-1, 1860, 2048) == x[1:]).all()


def _block(px, frame, x0, y0):
    v = px.reshape(-1)
    packed = np.stack((v[::2] & 255, v[::2] >> 8 | (v[1::2] & 15) << 4, v[1::2] >> 4), 1).astype(np.uint8).tobytes()
    head = bytearray(f.K2IS.HEADER)
    struct.pack_into(">I", head, 0, 0xFFFF0055)
    struct.pack_into(">I", head, 24, frame)
    struct.pack_into(">HH", head, 28, x0, y0)
    return bytes(head) + packed


def test_seq_corrections_and_empad_xml(tmp_path):
    mrc = struct.pack("<4i", 4, 4, 1, 2).ljust(1024, b"\0") + np.full(16, 2, "<f4").tobytes()
    (tmp_path / "a.seq").write_bytes(b"")
    (tmp_path / "a.seq.dark.mrc").write_bytes(mrc)
    (tmp_path / "a.Config.Metadata.xml").write_text('<C><D><Defect Row="1" Column="2"/></D></C>')
    c = f.Seq.corrections(str(tmp_path / "a.seq"))
    assert (c.dark == 2).all() and c.gain is None and c.excluded.tolist() == [[1], [2]]
    e = np.random.default_rng(0).random((6, 130, 128)).astype("<f4")
    e.tofile(tmp_path / "scan.raw")
    (tmp_path / "scan.xml").write_text('<root><raw_file filename="scan.raw"/><scan_parameters mode="acquire"><scan_resolution_x>3</scan_resolution_x><scan_resolution_y>2</scan_resolution_y></scan_parameters></root>')
    assert f.Empad.open(str(tmp_path / "scan.xml")).nav_shape == (2, 3)


def test_detection_refuses_strangers(tmp_path):
    (tmp_path / "a.blo").write_bytes(bytes(400))
    (tmp_path / "a.txt").write_bytes(b"hello")
    assert detect(str(tmp_path / "a.blo")) is None and detect(str(tmp_path / "a.txt")) is None
