import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom import sinks, sources, udf
from gridloom.api import Context
from gridloom.cube import Cube
from gridloom.functions import geometry, masks
from gridloom.operators import center_of_mass as com
from gridloom.operators import corrections as corr
from gridloom.operators import masked, reduce, ring_stats


def by(df, key, value):
    return {r[key]: r[value] for r in df.collect()}


def vector(df, n, value, key="px"):
    out = np.full(n, np.nan)
    for k, v in by(df, key, value).items():
        out[k] = v
    return out


@pytest.fixture(scope="module")
def data():
    return np.random.default_rng(7).random((5, 6, 4, 7))


@pytest.fixture(scope="module")
def cube(spark, data):
    Context(spark)
    return Cube.from_numpy(spark, data)


def test_reductions(cube, data):
    flat = data.reshape(30, 28)
    for method in ("expr", "kernel"):
        assert np.allclose(vector(reduce.sum_frames(cube, method), 28, "intensity"), flat.sum(0))
        out = reduce.stddev(cube, method)
        assert np.allclose(vector(out, 28, "var"), flat.var(0)) and np.allclose(vector(out, 28, "mean"), flat.mean(0))
    assert np.allclose(vector(reduce.sum_sig(cube), 30, "intensity", "frame_id"), flat.sum(1))
    assert np.allclose(vector(reduce.logsum(cube), 28, "logsum"), np.log(flat - flat.min(1, keepdims=True) + 1).sum(0))
    assert (vector(reduce.max_frame(cube.select(np.zeros((5, 6), bool) | True)), 28, "intensity") == flat.max(0)).all()


@pytest.mark.parametrize("method", ["expr", "kernel"])
def test_other_reductions_over_frames(cube, data, method, monkeypatch):
    monkeypatch.setattr(reduce, "FAN", 2)
    flat = data.reshape(30, 28) - 0.5
    moved = Cube.from_numpy(cube.spark, data - 0.5)
    moved = Cube(moved.df.repartition(5), moved.nav_shape, moved.sig_shape)
    assert np.allclose(vector(reduce.logsum(moved, method), 28, "logsum"), np.log(flat - flat.min(1, keepdims=True) + 1).sum(0))
    assert np.allclose(vector(reduce.max_frame(moved, 0.0, method), 28, "intensity"), np.maximum(flat.max(0), 0))
    assert np.allclose(vector(reduce.max_frame(moved, None, method), 28, "intensity"), flat.max(0))
    high = np.where(flat > 0.49, flat, 0).sum(0)
    found = by(reduce.threshold_sum(moved, 0.49, method), "px", "intensity")
    assert set(found) == set(np.flatnonzero(high)) and np.allclose([found[k] for k in sorted(found)], high[high > 0])
    assert by(reduce.count_frames(moved.roi[2]), "px", "num_frames") == dict.fromkeys(range(28), 6)
    assert reduce.count_frames(moved.select(np.zeros((5, 6), bool))).count() == 0
    bins = {(r.frame_id, r.bin_y, r.bin_x): r.v for r in reduce.bin_pixels(moved, 3).collect()}
    x = data.reshape(30, 4, 7) - 0.5
    assert len(bins) == 30 * 2 * 3 and all(np.isclose(v, x[f, 3 * i : 3 * i + 3, 3 * j : 3 * j + 3].mean()) for (f, i, j), v in bins.items())


def test_partial_vectors_are_merged_in_a_tree(cube, data, monkeypatch):
    monkeypatch.setattr(reduce, "FAN", 3)
    wide = Cube(cube.df.repartition(11), cube.nav_shape, cube.sig_shape)
    out = reduce.stddev(wide, "kernel")
    assert np.allclose(vector(out, 28, "std"), data.reshape(30, 28).std(0)) and set(by(out, "px", "num_frames").values()) == {30}


def test_selections(cube, data):
    mask = np.random.default_rng(1).random((5, 6)) > 0.5
    assert np.allclose(vector(reduce.sum_frames(cube.select(mask)), 28, "intensity"), data[mask].sum(0).ravel())
    assert cube.select([(1, 2), (0, 0)]).df.count() == 2
    assert cube.select([((1, 2), False)]).df.count() == 29
    with pytest.raises(ValueError):
        cube.select([((1, 2), False), ((1, 3), True)])
    with pytest.raises(ValueError):
        cube.select(np.ones((2, 2), bool))
    assert cube.roi[1:3, ::2].df.count() == 6
    assert cube.select(np.zeros((5, 6), bool)).df.count() == 0
    full = cube.embed(reduce.sum_sig(cube.roi[2]))
    assert full.filter("isnan(intensity)").count() == 24 and full.filter("valid").count() == 6


def test_sync_offset_and_reshape(cube, data):
    assert np.allclose(vector(reduce.sum_sig(cube.synced(3)), 30, "intensity", "frame_id")[:27], data.reshape(30, -1).sum(1)[3:])
    assert cube.synced(-4).df.agg({"frame_id": "min"}).first()[0] == 4
    with pytest.raises(ValueError):
        cube.synced(30)
    assert cube.reshape((30,), (28,)).nav_shape == (30,)
    with pytest.raises(ValueError):
        cube.reshape((31,))
    assert np.allclose(cube.transposed().to_numpy(), data.transpose(2, 3, 0, 1))
    assert np.allclose(cube.to_numpy(), data)


@pytest.mark.parametrize("method", ["expr", "join", "kernel"])
def test_masks_agree(cube, data, method):
    stack = np.random.default_rng(2).random((3, 4, 7))
    out = masked.apply_masks(cube, stack, method=method)
    want = np.einsum("abcd,mcd->abm", data, stack).reshape(30, 3)
    for k in range(3):
        assert np.allclose(vector(out, 30, f"mask_{k}", "frame_id"), want[:, k])


def test_complex_masks_and_shifts(spark, cube, data):
    z = data[..., :4] + 1j * data[..., 3:]
    zc = Cube.from_numpy(spark, z)
    stack = np.random.default_rng(3).random((2, 4, 4)) * np.exp(1j)
    want = np.einsum("abcd,mcd->abm", z, stack).reshape(30, 2)
    for method in ("expr", "kernel"):
        out = masked.apply_masks(zc, stack, method=method)
        assert np.allclose(vector(out, 30, "mask_1", "frame_id") + 1j * vector(out, 30, "mask_1_im", "frame_id"), want[:, 1])
    one = np.zeros((1, 4, 7))
    one[0, 1, 1] = 1
    assert np.allclose(vector(masked.apply_masks(cube, one, shifts=(2, 3)), 30, "mask_0", "frame_id"), data[..., 3, 4].ravel())
    assert (vector(masked.apply_masks(cube, one, shifts=(9, 0)), 30, "mask_0", "frame_id") == 0).all()


def test_center_of_mass(cube, data):
    y, x = np.indices((4, 7))
    s = data.sum((2, 3))
    cy, cx = (data * y).sum((2, 3)) / s - 2, (data * x).sum((2, 3)) / s - 3
    out = com.center_of_mass(cube)
    assert np.allclose(vector(out, 30, "raw_y", "frame_id"), cy.ravel())
    div = np.gradient(cy, axis=0) + np.gradient(cx, axis=1)
    curl = np.gradient(cy, axis=1) - np.gradient(cx, axis=0)
    assert np.allclose(vector(out, 30, "divergence", "frame_id"), div.ravel())
    assert np.allclose(vector(out, 30, "curl", "frame_id"), curl.ravel())
    plane = com.center_of_mass(cube, com.ComParams(regression=1), derivatives=False)
    ny, nx = np.indices((5, 6))
    a = np.stack((np.ones(30), ny.ravel(), nx.ravel()), 1)
    k = np.linalg.lstsq(a, cy.ravel(), rcond=None)[0]
    assert np.allclose(vector(plane, 30, "field_y", "frame_id"), cy.ravel() - a @ k)
    rms = com.coordinate_check(cube.with_nav(com.raw_shifts(cube, com.ComParams())), (5, 6))
    for flip, angle in itertools.product((0, 1), (0, 77, 200)):
        m = com.transform(angle, bool(flip))
        fy, fx = m[0, 0] * cy + m[0, 1] * cx, m[1, 0] * cy + m[1, 1] * cx
        c = (np.gradient(fy, axis=1) - np.gradient(fx, axis=0))[:-1, :-1]
        assert np.isclose(rms[flip, angle], np.sqrt((c**2).mean()))
    assert -180 < com.guess_corrections(cube).scan_rotation <= 180
    with pytest.raises(ValueError):
        com.raw_shifts(cube, com.ComParams(r=1, ri=2))
    with pytest.raises(ValueError):
        com.regression_of(out, 5)


def test_com_roi_gradient_is_nan_beside_gaps(cube):
    mask = np.ones((5, 6), bool)
    mask[2, 2] = False
    out = by(com.center_of_mass(cube.select(mask)), "frame_id", "divergence")
    assert 14 not in out and np.isnan(out[13]) and not np.isnan(out[0])


def test_rings(spark, data):
    frame = np.array([[0, 1, 0], [3, 0, 3], [0, 1, 0]], float)
    frames = np.stack([frame] * 9)
    frames[8, 2, 2] += 9
    assert np.allclose(vector(ring_stats.ring_std(Cube.from_numpy(spark, frames), (1, 1), 0, 1), 9, "intensity", "frame_id"), 1)
    x = data.reshape(30, 4, 7)
    want = (np.abs(np.fft.rfft2(x)) * ring_stats.half_spectrum_ring((4, 7), 0.5, 2)).sum((1, 2))
    assert np.allclose(vector(ring_stats.crystallinity(Cube.from_numpy(spark, x), 0.5, 2), 30, "intensity", "frame_id"), want)


def test_corrections(spark, cube, data):
    dark, gain = np.random.default_rng(4).random((2, 4, 7))
    bad = np.array([(0, 1, 1), (0, 3, 4)])
    c = corr.CorrectionSet(dark, gain, bad)
    want = ((data - dark) * gain).reshape(30, -1)
    for px, around in c.repairs((4, 7)).items():
        want[:, px] = want[:, around].mean(1)
    assert np.allclose(corr.correct(cube, c).to_numpy().reshape(30, -1), want)
    got = {(r.frame_id, r.px): r.v for r in corr.correct_pixels(cube, c).collect()}
    assert len(got) == want.size and all(np.isclose(v, want[k]) for k, v in got.items())
    with pytest.raises(corr.RepairError):
        corr.CorrectionSet(excluded=np.ones((3, 3), bool)).repairs((3, 3))
    stack = np.random.default_rng(5).random((2, 28))
    folded = corr.fold_into_masks(stack, corr.CorrectionSet(gain=gain, excluded=bad), (4, 7))
    plain = corr.apply_to_frames(data.reshape(30, -1), corr.CorrectionSet(gain=gain, excluded=bad), (4, 7))
    assert np.allclose(data.reshape(30, -1) @ folded.T, plain @ stack.T)


class Stats(udf.FrameUDF):
    def get_result_buffers(self):
        return {"top": self.buffer("sig", dtype=np.float64), "n": self.buffer("single", dtype=np.int64), "pair": self.buffer("nav", (2,), np.float64), "mean": self.buffer("sig", dtype=np.float64, use="result_only"), "total": self.buffer("sig", dtype=np.float64, use="private")}

    def process_tile(self, tile):
        self.results.top[:] = np.maximum(self.results.top, tile.max(0))
        self.results.total[:] += tile.sum(0)
        self.results.n[:] += len(tile)
        self.results.pair[:] = np.stack((tile.min((1, 2)), tile.max((1, 2))), 1)

    def merge(self, dest, src):
        dest["top"][:] = np.maximum(dest["top"], src["top"])
        dest["total"][:] += src["total"]
        dest["n"][:] += src["n"]

    def get_results(self, results):
        return {**results, "mean": results["total"] / results["n"]}


class Bare(udf.FrameUDF):
    def get_result_buffers(self):
        return {"s": self.buffer("sig")}

    def process_frame(self, frame):
        self.results.s[:] += frame


class InOrder(udf.FrameUDF):
    """First frame of every task, in order."""

    def get_result_buffers(self):
        return {"seen": self.buffer("single", dtype=np.int64), "order": self.buffer("single", (40,), np.int64)}

    def process_frame(self, frame):
        if not self.results.seen[0]:
            self.results.order[0, 0] = self.meta.frame_ids[0] + 1
        self.results.seen[:] += 1

    def merge_all(self, parts):
        order = np.zeros((1, 40), np.int64)
        order[0, : len(parts)] = [p["order"][0, 0] for p in parts]
        return {"seen": sum(p["seen"] for p in parts), "order": order}


def test_merge_all_in_order(cube, data, monkeypatch):
    wide = Cube(cube.df.repartitionByRange(6, "frame_id"), cube.nav_shape, cube.sig_shape)
    for fan in (32, 2):
        monkeypatch.setattr(udf, "FAN", fan)
        ordered, stats = udf.run_udf(wide, [InOrder(), Stats()])
        got = ordered["order"][0]
        assert ordered["seen"][0] == 30 and got[0] == 1 and (np.diff(got[got > 0]) > 0).all() and (got > 0).sum() == 6
        assert stats["n"][0] == 30 and np.allclose(stats["mean"], data.mean((0, 1)))


def test_udf(cube, data):
    out = udf.run_udf(cube, Stats())
    assert np.allclose(out["mean"], data.mean((0, 1))) and out["n"][0] == 30 and "total" not in out.merged
    pairs = by(out.nav, "frame_id", "pair")
    assert np.allclose(pairs[7], (data[1, 1].min(), data[1, 1].max()))
    with pytest.raises(udf.UDFError):
        udf.run_udf(cube, Bare())
    with pytest.raises(ValueError):
        udf.run_udf(cube, [])
    assert np.allclose(vector(udf.map_frames(cube, lambda f: f.sum()), 30, "result", "frame_id"), data.sum((2, 3)).ravel())
    ctx = Context(cube.spark)
    steps = list(ctx.run_udf_iter(cube, Stats(), parts=3))
    assert [d.sum() for d, _ in steps] == [10, 20, 30] and np.allclose(steps[-1][1]["mean"], data.mean((0, 1)))


class Tasks(udf.FrameUDF):
    """Which tasks have seen frames, and in how many of them the operator was cleaned up."""

    def get_result_buffers(self):
        return {"tasks": self.buffer("single", (64,), np.int64), "span": self.buffer("nav", dtype=np.float64)}

    def process_frame(self, frame):
        from pyspark import TaskContext

        self.results.tasks[0, TaskContext.get().partitionId()] += 1
        self.results.span[:] = np.ptp(frame)

    def merge(self, dest, src):
        dest["tasks"][:] += src["tasks"]


def test_operators_run_where_the_frames_are(cube):
    wide = Cube(cube.df.repartitionByRange(16, "frame_id"), cube.nav_shape, cube.sig_shape)
    tasks = udf.run_udf(wide, Tasks())["tasks"][0]
    assert (tasks > 0).sum() == 16 and tasks.sum() == 30


def test_iterated_results_are_those_of_one_run(cube, data):
    ctx = Context(cube.spark)
    dark, gain = np.full((4, 7), 1.0), np.full((4, 7), 2.0)
    fix = corr.CorrectionSet(dark, gain)
    roi = np.zeros((5, 6), bool)
    roi[1:4, ::2] = True
    wide = Cube(cube.df.repartitionByRange(6, "frame_id"), cube.nav_shape, cube.sig_shape)
    steps = list(ctx.run_udf_iter(wide, [Stats(), InOrder(), Tasks()], parts=5, roi=roi, corrections=fix))
    assert [d.sum() for d, _ in steps] == [roi[:k].sum() for k in range(1, 6)]
    for k in range(2, 6):
        done = roi.copy()
        done[k:] = False
        stats, ordered, tasks = steps[k - 1][1]
        want = (data[done] - 1) * 2
        assert np.allclose(stats["mean"], want.mean(0)) and stats["n"][0] == done.sum() == ordered["seen"][0]
        order = ordered["order"][0]
        assert (np.diff(order[order > 0]) > 0).all()
        pairs = by(stats.nav, "frame_id", "pair")
        assert set(pairs) == set(np.flatnonzero(done)) == set(by(tasks.nav, "frame_id", "span"))
        assert all(np.allclose(pairs[i], (x.min(), x.max())) for i, x in zip(np.flatnonzero(done), want, strict=True))
    whole = ctx.run_udf(wide, Stats(), roi=roi, corrections=fix)
    assert np.allclose(whole["mean"], steps[-1][1][0]["mean"])
    held = Cube(cube.df, cube.nav_shape, cube.sig_shape, corrections=fix)
    assert np.allclose(list(ctx.run_udf_iter(held, Stats(), parts=2))[-1][1]["mean"], ((data - 1) * 2).mean((0, 1)))
    assert ctx.inspect_udf(cube, Stats())["pair"] == ("nav", (5, 6, 2), np.dtype(np.float64)) and "total" not in ctx.inspect_udf(cube, Stats())


def test_corrections_of_complex_frames(spark):
    rng = np.random.default_rng(3)
    x = rng.random((2, 3, 4, 5)) + 1j * rng.random((2, 3, 4, 5))
    dark = rng.random((4, 5)) + 1j * rng.random((4, 5))
    cube = Cube.from_numpy(spark, x)
    got = corr.correct(cube, corr.CorrectionSet(dark, excluded=np.array([[1], [2]])))
    want = x - dark
    around = [want[..., i, j] for i in range(3) for j in range(1, 4) if (i, j) != (1, 2)]
    want[..., 1, 2] = np.mean(around, axis=0)
    assert got.complex and np.allclose(got.to_numpy(), want)
    assert np.allclose(vector(reduce.sum_frames(got), 20, "intensity_im"), want.imag.sum((0, 1)).ravel())
    with pytest.raises(ValueError):
        corr.correct(Cube.from_numpy(spark, x.real), corr.CorrectionSet(dark))


def test_clusters_by_brute_force(spark):
    """Ward's criterion, always the cheapest pair of neighbouring groups, on a small grid."""
    from gridloom.analysis import _Ward

    rng = np.random.default_rng(5)
    for shape, k in (((5, 6), 4), ((4, 4), 2)):
        x = rng.random((shape[0] * shape[1], 3))
        groups = [{i} for i in range(len(x))]
        beside = lambda a, b: any(abs(i // shape[1] - j // shape[1]) + abs(i % shape[1] - j % shape[1]) == 1 for i in a for j in b)
        while len(groups) > k:
            costs = [(len(a) * len(b) / (len(a) + len(b)) * ((x[list(a)].mean(0) - x[list(b)].mean(0)) ** 2).sum(), m, n) for m, a in enumerate(groups) for n, b in enumerate(groups) if m < n and beside(a, b)]
            _, m, n = min(costs)
            groups[m] |= groups.pop(n)
        labels = _Ward(k).labels(x, shape)
        assert {frozenset(np.flatnonzero(labels == v).tolist()) for v in set(labels)} == {frozenset(g) for g in groups}


@pytest.mark.parametrize(("turn", "flip"), [(0, False), (37, False), (-120, True)])
def test_guessed_corrections(spark, turn, flip):
    """A field without curl, turned and flipped as the detector would: the guess undoes it."""
    y, x = np.mgrid[:9, :9] - 4.0
    bump = np.exp(-(y**2 + x**2) / 6)
    field = np.stack((-y * bump, -x * bump), axis=-1)  # towards the middle
    back = np.linalg.inv(com.transform(turn, flip))
    raw = field @ np.asarray(back).T
    sy, sx = np.mgrid[:32, :32]
    spots = np.exp(-((sy[None, None] - 15 - raw[..., 0, None, None]) ** 2 + (sx[None, None] - 15 - raw[..., 1, None, None]) ** 2) / 4)
    guess = com.guess_corrections(Cube.from_numpy(spark, spots), com.ComParams(cy=15, cx=15))
    apart = (guess.scan_rotation - turn + 180) % 360 - 180
    assert guess.flip_y == flip and abs(apart) <= 1 and abs(guess.cy - 15) < 0.1 and abs(guess.cx - 15) < 0.1


def test_analyses(cube, data):
    ctx = Context(cube.spark)
    assert np.allclose(vector(ctx.run(ctx.create_sum_analysis(cube))["intensity"], 28, "intensity"), data.sum((0, 1)).ravel())
    mask = masks.circular(3.5, 2, 7, 4, 2 * 0.3)
    assert np.allclose(vector(ctx.run(ctx.create_disk_analysis(cube))["intensity"], 30, "intensity", "frame_id"), (data * mask).sum((2, 3)).ravel())
    assert set(ctx.run(ctx.create_com_analysis(cube))) == {"field", "magnitude", "x", "y", "divergence", "curl"}
    row = ctx.run(ctx.create_pick_analysis(cube, y=1, x=2))["intensity"].first()
    assert row.frame_id == 8 and np.allclose(row.frame, data[1, 2].ravel())
    with pytest.raises(ValueError):
        ctx.run(ctx.create_pick_analysis(cube, x=2))
    with pytest.raises(ValueError):
        ctx.create_com_analysis(cube, mask_radius_inner=1)
    labels = ctx.run(ctx.create("CLUST", cube, n_clust=3, n_peaks=4, min_dist=1))["intensity"]
    assert labels.select("label").distinct().count() == 3
    fft = ctx.run(ctx.create("FFTSUM_FRAMES", cube))["fft"]
    assert np.allclose(fft, np.log(np.abs(np.fft.fftshift(np.fft.fft2(data.sum((0, 1))))) + 1))


def test_mask_generators():
    assert np.isclose(masks.background_subtraction(8, 8, 16, 16, 6, 4).sum(), 0)
    assert np.isclose(masks.balance(masks.radial_gradient_background_subtraction(masks.distance(8, 8, 16, 16), 4, 6)).sum(), 0)
    assert np.allclose(masks.radial_bins(8, 8, 16, 16, n_bins=4, normalize=True).sum((1, 2))[1:], 1)
    whole = masks.radial_bins(8, 8, 16, 16, radius=6, n_bins=3)
    assert whole[0, 8, 8] == 1 and np.allclose(whole.sum(0)[masks.circular(8, 8, 16, 16, 5)], 1)
    table = geometry.lattice_table((20, 30), (9.5, 11.0), (3.0, 1.0), (-1.0, 4.0), border=2)
    every = [(i, j, 9.5 + 3 * i - j, 11.0 + i + 4 * j) for i in range(-40, 41) for j in range(-40, 41)]
    assert list(table.itertuples(index=False, name=None)) == [p for p in every if 2 <= p[2] < 18 and 2 <= p[3] < 28]
    assert masks.rectangular(1, 1, 2, 3, 8, 8).sum() == 12 and masks.rectangular(3, 4, -2, -3, 8, 8).sum() == 12 and not masks.rectangular(1, 1, 0, 3, 8, 8).any()
    assert masks.binning_stack(5, 5, 2).shape == (9, 5, 5)
    assert masks.circular_stack([2], [2], 5, 5, 1).sum() == 5
    assert geometry.scale_rotate_flip_y(geometry.scale(2) @ geometry.rotate(0.3) @ geometry.flip_y()) == pytest.approx((2, 0.3, True))
    with pytest.raises(ValueError):
        geometry.scale_rotate_flip_y(np.array([(1, 1), (0, 1)]))
    v = np.array([(3.0, 4.0), (0.0, -1.0)])
    assert np.allclose(geometry.make_cartesian(geometry.make_polar(v)), v)


def test_sources_and_sinks(spark, cube, data, tmp_path):
    ctx = Context(spark)
    path = str(tmp_path / "x.npy")
    ctx.export_dataset(cube, path)
    assert np.allclose(np.load(path), data.astype(np.float32))
    with pytest.raises(FileExistsError):
        ctx.export_dataset(cube, path)
    with pytest.raises(RuntimeError):
        ctx.export_dataset(cube.roi[1], path, overwrite=True)
    loaded = ctx.load("auto", path, num_partitions=3)
    assert np.allclose(loaded.to_numpy(), data.astype(np.float32)) and loaded.roi[2].df.count() == 6
    raw = tmp_path / "x.raw"
    (data * 1000).astype(">u2").tofile(raw)
    big = ctx.load("raw", str(raw), dtype=">u2", nav_shape=(5, 6), sig_shape=(4, 7))
    assert np.allclose(big.to_numpy(), (data * 1000).astype(">u2"))
    sparse = np.where(data > 0.8, data, 0).reshape(30, 28)
    ptr, idx, val = np.concatenate(([0], np.cumsum((sparse > 0).sum(1)))), np.nonzero(sparse)[1], sparse[sparse > 0]
    for name, x, kind in (("p", ptr, "<i4"), ("i", idx, "<i4"), ("d", val, "<f8")):
        x.astype(kind).tofile(tmp_path / name)
    (tmp_path / "c.toml").write_text('[params]\nfiletype = "raw_csr"\nnav_shape = [5, 6]\nsig_shape = [4, 7]\n[raw_csr]\nindptr_file = "p"\nindptr_dtype = "<i4"\nindices_file = "i"\nindices_dtype = "<i4"\ndata_file = "d"\ndata_dtype = "<f8"\n')
    assert np.allclose(ctx.load("raw_csr", str(tmp_path / "c.toml")).to_numpy().reshape(30, 28), sparse)
    assert sources.csr_pixels(spark, str(tmp_path / "c.toml")).count() == len(val)
    with pytest.raises(sources.FormatError):
        ctx.load("nope", path)
    for kind in ("NPZ", "RAW", "TIFF"):
        sinks.write_results(str(tmp_path / f"r.{kind.lower()}"), {"a": data[0, 0], "b": data[0, 1]}, kind)
    assert np.allclose(np.load(tmp_path / "r.npz")["b"], data[0, 1])
    assert np.fromfile(tmp_path / "r.raw").size == 56


@pytest.mark.parametrize(("kind", "name", "dtype"), [("raw", "a.raw", "<f4"), ("mib", "a.mib", "<u2"), ("mib", "b.mib", "<u4"), ("mrc", "a.mrc", "<f4"), ("blo", "a.blo", "|u1"), ("seq", "a.seq", "<u2"), ("tvips", "a_000.tvips", "<u2"), ("raw_csr", "a.toml", "<f4")])
def test_formats_written_and_read(spark, tmp_path, kind, name, dtype):
    ctx = Context(spark)
    x = np.random.default_rng(0).integers(0, 200, (4, 5, 8, 8)).astype(float) * (np.random.default_rng(1).random((4, 5, 8, 8)) > 0.4)
    cube = Cube.from_numpy(spark, x)
    shuffled = Cube(cube.df.repartition(3), cube.nav_shape, cube.sig_shape)
    path = str(tmp_path / name)
    ctx.write(shuffled, path, kind, dtype)
    more = {"dtype": dtype, "sig_shape": (8, 8)} if kind == "raw" else {}
    back = ctx.load(kind, path, nav_shape=(4, 5), **more)
    assert (back.to_numpy() == x).all() and (back.roi[1:3, 2].df.count() == 2)
    with pytest.raises(FileExistsError):
        ctx.write(cube, path, kind, dtype)


@pytest.mark.parametrize(("n", "spare"), [(65540, 0), (65537, 1)])  # the second one is a prime
def test_blockfiles_of_more_frames_than_an_axis_can_say(spark, tmp_path, n, spare):
    ctx = Context(spark)
    frame = F.transform(F.sequence(F.lit(0), F.lit(8)), lambda k: ((F.col("id") * 7 + k) % 251).cast("double"))
    cube = Cube.from_dataframe(spark.range(n), "id", frame, (n, 1), (3, 3))
    path = str(tmp_path / "a.blo")
    ctx.write(cube, path, "blo", "|u1")
    own = ctx.load("blo", path)
    assert own.n_frames == n + spare and max(own.nav_shape) < 1 << 16
    want = (np.arange(n)[:, None] * 7 + np.arange(9)) % 251
    back = ctx.load("blo", path, nav_shape=cube.nav_shape)
    assert back.nav_shape == (n, 1) and back.df.count() == n
    got = own.to_numpy().reshape(-1, 9)
    assert (got[:n] == want).all() and not got[n:].any()


def test_corrections_beside_a_sequence_apply(spark, tmp_path):
    ctx = Context(spark)
    x = np.random.default_rng(0).integers(5, 200, (2, 3, 8, 8)).astype(float)
    path = str(tmp_path / "a.seq")
    ctx.write(Cube.from_numpy(spark, x), path, "seq", "<u2")
    ctx.write(Cube.from_numpy(spark, np.full((1, 1, 8, 8), 2.0)), path + ".dark.mrc", "mrc", "<f4")
    cube = ctx.load("seq", path, nav_shape=(2, 3))
    assert np.allclose(vector(ctx.run(ctx.create_sum_analysis(cube))["intensity"], 64, "intensity"), (x - 2).sum((0, 1)).ravel())
    none = corr.CorrectionSet(np.zeros((8, 8)))
    assert np.allclose(vector(ctx.run(ctx.create_sum_analysis(cube), corrections=none)["intensity"], 64, "intensity"), x.sum((0, 1)).ravel())


def _mib(tmp_path, frames, kind, bits, packed, chips=1, shape=None, layout="1x1"):
    h, w = shape or frames.shape[1:]
    out = b""
    for k, body in enumerate(packed):
        head = f"MQ1,{k + 1:06d},00384,{chips:02d},{w:04d},{h:04d},{kind},{layout:>6},0F,x,{bits}"
        out += (head + ",").encode().ljust(384, b"\0") + body
    path = tmp_path / f"{kind}-{bits}-{chips}" / "x.mib"
    path.parent.mkdir()
    path.write_bytes(out)
    return str(path)


def test_mib(tmp_path):
    from gridloom.sources.formats import Mib

    rng = np.random.default_rng(0)
    x = rng.integers(0, 4000, (3, 64, 64)).astype(np.uint16)
    layout = Mib.open(_mib(tmp_path, x, "U16", 12, [f.astype(">u2").tobytes() for f in x]))
    assert (Mib.frames(layout, 0, 3).reshape(x.shape) == x).all()
    r12 = [f.reshape(-1, 4)[:, ::-1].astype(">u2").tobytes() for f in x]
    assert (Mib.frames(Mib.open(_mib(tmp_path, x, "R64", 12, r12)), 1, 3).reshape(-1, 64, 64) == x[1:]).all()
    x6 = (x % 64).astype(np.uint8)
    r6 = [f.reshape(-1, 8)[:, ::-1].tobytes() for f in x6]
    assert (Mib.frames(Mib.open(_mib(tmp_path, x6, "R64", 6, r6)), 0, 3).reshape(x.shape) == x6).all()
    x1 = (x % 2).astype(np.uint8)
    r1 = [np.packbits(f.reshape(-1, 8, 8)[:, ::-1], axis=2, bitorder="little").tobytes() for f in x1]
    assert (Mib.frames(Mib.open(_mib(tmp_path, x1, "R64", 1, r1)), 0, 3).reshape(x.shape) == x1).all()
    q = rng.integers(0, 60, (2, 128, 128)).astype(np.uint8)
    rows = np.stack((q[:, 64:, 64:][:, ::-1, ::-1], q[:, 64:, :64][:, ::-1, ::-1], q[:, :64, 64:], q[:, :64, :64]), axis=2)
    quad = [f.reshape(-1, 8)[:, ::-1].tobytes() for f in rows]
    assert (Mib.frames(Mib.open(_mib(tmp_path, q, "R64", 6, quad, 4, (64, 256), "2x2")), 0, 2).reshape(q.shape) == q).all()
    wide = rng.integers(0, 1 << 24, (2, 64, 64)).astype(np.uint32)
    r24 = [(f >> 12).reshape(-1, 4)[:, ::-1].astype(">u2").tobytes() + (f & 4095).reshape(-1, 4)[:, ::-1].astype(">u2").tobytes() for f in wide]
    assert (Mib.frames(Mib.open(_mib(tmp_path, wide, "R64", 24, r24, 1, (64, 128))), 0, 2).reshape(wide.shape) == wide).all()


def test_small_formats(tmp_path):
    from gridloom.sources import formats as f

    rng = np.random.default_rng(0)
    x = rng.integers(0, 200, (6, 8, 8)).astype(np.uint8)
    head = np.zeros(1, f.Blo.HEAD)
    head["magic"], head["data_2"], head["dp_sz"], head["nx"], head["ny"] = f.Blo.MAGIC, 100, 8, 3, 2
    (tmp_path / "a.blo").write_bytes(head.tobytes().ljust(100, b"\0") + b"".join(b"\xaa\x55\0\0\0\0" + v.tobytes() for v in x))
    layout = f.Blo.open(str(tmp_path / "a.blo"))
    assert layout.nav_shape == (2, 3) and (f.Blo.frames(layout, 2, 5).reshape(-1, 8, 8) == x[2:5]).all()
    import struct

    mrc = struct.pack("<4i", 8, 8, 6, 0).ljust(1024, b"\0") + x.astype(np.int8).tobytes()
    (tmp_path / "a.mrc").write_bytes(mrc)
    assert (f.Mrc.frames(f.Mrc.open(str(tmp_path / "a.mrc")), 1, 6).reshape(-1, 8, 8) == x[1:].astype(np.int8)).all()
    seq = bytearray(8192)
    struct.pack_into("<I", seq, 0, 0xFEED)
    struct.pack_into("<II", seq, 28, 5, 1024)
    struct.pack_into("<5I", seq, 548, 8, 8, 8, 8, 64)
    struct.pack_into("<I", seq, 572, 6)
    struct.pack_into("<I", seq, 580, 80)
    (tmp_path / "a.seq").write_bytes(bytes(seq) + b"".join(v.tobytes().ljust(80, b"\0") for v in x))
    assert (f.Seq.frames(f.Seq.open(str(tmp_path / "a.seq")), 0, 6).reshape(x.shape) == x).all()
    tv = struct.pack("<13i", 256, 2, 8, 8, 8, *[0] * 7, 24).ljust(256, b"\0") + b"".join(b"\0" * 24 + v.tobytes() for v in x)
    (tmp_path / "a_000.tvips").write_bytes(tv)
    assert (f.Tvips.frames(f.Tvips.open(str(tmp_path / "a_000.tvips")), 0, 6).reshape(x.shape) == x).all()
    e = rng.random((4, 130, 128)).astype("<f4")
    e.tofile(tmp_path / "a.raw")
    assert (f.Empad.frames(f.Empad.open(str(tmp_path / "a.raw")), 1, 4).reshape(-1, 128, 128) == e[1:, :128]).all()
    values = np.arange(4096, dtype=np.uint16)
    packed = np.stack((values[::2] & 255, values[::2] >> 8 | (values[1::2] & 15) << 4, values[1::2] >> 4), 1).astype(np.uint8)
    assert (f.K2IS.unpack(packed.reshape(-1)) == values).all()


def test_snapshots_are_bounded():
    from gridloom.streaming import Snapshots

    held = Snapshots(keep=3)
    for k in range(3):
        held.add(k, [k])
    reader = iter(held)
    assert next(reader) == (0, [0])
    for k in range(3, 8):
        held.add(k, [k])
    assert next(reader) == (5, [5]) and next(reader) == (6, [6]) and held.latest() == [7]


def test_stream(spark, tmp_path):
    from gridloom import streaming as s

    x = np.random.default_rng(0).random((12, 2, 3))
    source = str(tmp_path / "in")
    for k in range(3):
        spark.createDataFrame([(i, x[i].ravel().tolist()) for i in range(4 * k, 4 * k + 4)], "frame_id long, frame array<double>").coalesce(1).write.mode("append").parquet(source)
    cube = s.stream_cube(s.read_frames(spark, source), (3, 4), (2, 3))
    got = list(s.snapshots(reduce.sum_frames(cube)))
    assert len(got) == 3
    last = {r.px: r.intensity for r in got[-1][1]}
    assert np.allclose([last[p] for p in range(6)], x.reshape(12, -1).sum(0))
    params, seen = s.Adjustable(px=0), []
    query = s.per_batch(cube, lambda c, p: reduce.pick_pixel(c, 0, p["px"]), params, lambda df, n: seen.append(df.count()))
    query.awaitTermination(60)
    assert sum(seen) == 12
    assert s.in_background(lambda: 5).result(5) == 5


def test_follow_a_growing_file(spark, tmp_path):
    from gridloom import streaming as s

    x = np.random.default_rng(0).random((12, 2, 3)).astype("<f8")
    path = tmp_path / "live.raw"
    x.tofile(path)
    cube = sources.follow(spark, "raw", str(path), (3, 4), (2, 3), frames_per_trigger=5, dtype="<f8")
    run = s.snapshots(reduce.sum_frames(cube), once=False, checkpoint=str(tmp_path / "ck"))
    try:
        run.query.processAllAvailable()
        assert np.allclose([v for _, v in sorted((r.px, r.intensity) for r in run.latest())], x.reshape(12, -1).sum(0))
        assert run.progress()["batch"] >= 2
    finally:
        run.cancel()


def test_generators(spark):
    from gridloom.functions import generate as g

    frame = g.rosette(64, 4, 16, 3)
    assert frame.shape == (64, 64) and np.allclose(frame[1:, 1:], np.rot90(frame[1:, 1:]), atol=0.3) and frame[48, 32] == 1 and frame[32, 32] == 0
    bad = g.repairable_pixels((16, 16), 9, np.random.default_rng(0))
    cube_of = Cube(g.gradient_frames(spark, (3, 4), (16, 16), 3), (3, 4), (16, 16))
    data = g.gradient_cube((3, 4), (16, 16))
    assert np.allclose(cube_of.to_numpy(), data, rtol=1e-5)
    broken = data.copy()
    broken[..., bad[0], bad[1]] = 1e6
    mended = corr.correct(Cube.from_numpy(spark, broken), corr.CorrectionSet(excluded=bad)).to_numpy()
    assert np.allclose(mended, data, rtol=1e-5)
    amp, phi = np.ones((32, 32)), np.zeros((32, 32))
    holo = g.smoothed(g.hologram(amp, phi), 1.0)
    noisy = g.counted(holo, 50.0, np.random.default_rng(0))
    assert abs(noisy.mean() / holo.mean() - 1) < 0.02 and 0 < (noisy - holo).std() < 0.3 * holo.mean()
    assert holo.shape == (32, 32) and abs(holo.mean() - 1000) < 60
    with pytest.raises(ValueError):
        g.hologram(amp, phi[:4])


def test_radial_symmetry(spark):
    """Disks of 1-, 2- and 4-fold symmetry around the centre have their first strong order there."""
    from gridloom.functions import generate as g

    frames = np.stack([g.rosette(64, fold, 16, 4) for fold in (1, 2, 4)])
    cube = Cube.from_numpy(spark, frames.reshape(3, 1, 64, 64))
    ctx = Context(spark)
    out = ctx.run(ctx.create_radial_fourier_analysis(cube, cx=32, cy=32, ri=10, ro=22, n_bins=1, max_order=8))
    assert [v for _, v in sorted(by(out["dominant"], "frame_id", "dominant").items())] == [1, 2, 4]
