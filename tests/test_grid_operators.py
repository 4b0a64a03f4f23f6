import hashlib
"""Hand-made cases with known answers, properties, and numpy versions of the vectorised helpers."""

import math
from pathlib import Path

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from floodgrid.functions import columns as C
from floodgrid.operators import cells as M
from floodgrid.operators import checks as U
from floodgrid.operators import hydro as H
from floodgrid.operators import joins as J
from floodgrid.operators import patchwise as V
from floodgrid.operators import resample as R
from floodgrid.operators import sampling as W
from floodgrid.operators import score as S
from floodgrid.operators import series as T
from floodgrid.operators import stats as A
from floodgrid.sources import io
from floodgrid.streaming import streams as X


def pairs(spark, pred, target, mask=None):
    rows = [("s", "t0", 0, 0, 0, i, float(p) if p is not None else None, float(t) if t is not None else None, 1 if mask is None else mask[i]) for i, (p, t) in enumerate(zip(pred, target, strict=True))]
    return spark.createDataFrame(rows, "scenario string, t string, patch_row int, patch_col int, y int, x int, pred double, target double, mask int")


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("v")).first()["v"]


# cells


def test_mask_fill(spark):
    rows = [(float("nan"),), (float("inf"),), (-9999.0,), (9999.0,), (2e30,), (1.5,), (None,)]
    out = [r["v"] for r in M.mask_fill(spark.createDataFrame(rows, "v double"), "v", fill=-9999.0).collect()]
    assert out == [None, None, None, None, None, 1.5, None]


def test_clean_depth_and_velocity(spark):
    d = spark.createDataFrame([(float("nan"),), (-1.0,), (1e-6,), (0.2,), (9.0,), (None,)], "v double")
    assert [r["v"] for r in M.clean_depth(d, "v").collect()] == [0.0, 0.0, 0.0, 0.2, 5.0, 0.0]
    v = spark.createDataFrame([(-9.0,), (1e-7,), (0.5,)], "v double")
    assert [r["v"] for r in M.clean_velocity(v, "v").collect()] == [-5.0, 0.0, 0.5]


def test_select_patch_guards(spark):
    index = spark.createDataFrame([("s", "h", "t0001", 1, 0, 0, 0), ("s", "h", "t0002", 2, 0, 0, 1), ("s", "h", "t0003", 3, 0, 0, 0), ("s", "h", "t0003", 3, 0, 0, 0)], "scenario string, var string, t string, time_index int, patch_row int, patch_col int, filtered_out int")
    assert M.select_patch(index, "s", "H", 1, 0, 0).count() == 1
    for step in (2, "t0003", 9):
        with pytest.raises(ValueError):
            M.select_patch(index, "s", "h", step, 0, 0)


def test_limits_and_tiles(spark):
    assert M.parse_limits(["a", "b:3", "c:x"]) == [("a", None), ("b", 3), ("c:x", None)]
    grid = spark.range(70).select(F.floor(F.col("id") / 7).cast("int").alias("y"), (F.col("id") % 7).cast("int").alias("x"))
    tiles = {(r["patch_row"], r["patch_col"]): r["n"] for r in M.tile_extents(M.tile_grid(grid, 4)).collect()}
    assert tiles == {(0, 0): 16, (0, 1): 12, (1, 0): 16, (1, 1): 12, (2, 0): 8, (2, 1): 6}


def test_patch_and_cell_forms(spark):
    p = spark.createDataFrame([(1, 2, 3, [1.0, 2.0, 3.0, 4.0, None, 6.0])], "k int, h int, w int, values array<double>")
    back = M.cells_to_patches(M.patches_to_cells(p), ["k"], 2, 3).first()
    assert back["values"] == [1.0, 2.0, 3.0, 4.0, None, 6.0]
    assert M.fit_shape(p, 3, 2).first()["values"] == [1.0, 2.0, 4.0, None, 0.0, 0.0]
    assert M.pad_patches(p, 3).first()["values"] == [1.0, 2.0, 3.0, 4.0, None, 6.0, None, None, None]


# rasters


def grid(spark, a, key=0):
    rows = [(key, i, j, None if a[i][j] is None else float(a[i][j])) for i in range(len(a)) for j in range(len(a[0]))]
    return spark.createDataFrame(rows, "k int, y int, x int, value double")


def array_of(df, h, w, value="value"):
    out = np.full((h, w), np.nan)
    for r in df.collect():
        if r[value] is not None:
            out[r["y"], r["x"]] = r[value]
    return out


def test_block_mean_undoes_nearest(spark):
    a = np.arange(6.0).reshape(2, 3)
    up = R.upsample_nearest(grid(spark, a), 3)
    assert up.count() == 54 and (array_of(R.block_mean(up, ["k"], 3), 2, 3) == a).all()


def test_bilinear_matches_numpy(spark):
    a = np.random.default_rng(0).random((3, 4))
    got = array_of(R.upsample_bilinear(grid(spark, a), ["k"], 4, 3, 4), 12, 16)

    def axis(n):
        p = np.clip((np.arange(n * 4) + 0.5) / 4 - 0.5, 0, None)
        low = np.minimum(np.floor(p).astype(int), n - 1)
        w = np.zeros((n * 4, n))
        for i, (lo, part) in enumerate(zip(low, p - low, strict=True)):
            w[i, lo] += 1 - part
            w[i, min(lo + 1, n - 1)] += part
        return w

    assert np.allclose(got, axis(3) @ a @ axis(4).T)


def test_bicubic_keeps_constants_and_matches_rows():
    for scale in (0.5, 2.0, 0.37):
        w = V.bicubic_weights(11, scale)
        assert np.allclose(w.sum(axis=1), 1)
    line = np.arange(20.0)
    mid = V.bicubic_weights(20, 2.0) @ line
    assert np.allclose(mid[8:-8], (np.arange(40)[8:-8] + 0.5) / 2 - 0.5)


def test_gradient_and_shift(spark):
    a = np.add.outer(np.arange(4.0) * 2, np.arange(5.0) * 3)
    out = R.gradient(grid(spark, a), ["k"]).collect()
    assert all(r["gy"] == 2.0 and r["gx"] == 3.0 for r in out)
    moved = array_of(R.shift_grid(grid(spark, a), 1, -2, 4, 5), 4, 5)
    assert (moved[1:, :3] == a[:-1, 2:]).all() and np.isnan(moved[0]).all()


def test_collapse_levels(spark):
    rows = [(0, 0, 1, 1, 5.0), (0, 1, 1, 1, None), (0, 1, 1, 2, 2.0), (0, 1, 2, 1, 3.0), (0, 1, 2, 2, 4.0)]
    lv = spark.createDataFrame(rows, "k int, level int, i int, j int, value double")
    fine = {(r["i"], r["j"]): r["value"] for r in R.collapse_inject(lv, ["k"], 1).where("level = 1").collect()}
    assert fine == {(1, 1): 5.0, (1, 2): 2.0, (2, 1): 3.0, (2, 2): 4.0}
    whole = spark.createDataFrame([(0, 1, i, j, 2.0 * i + j) for i in (1, 2) for j in (1, 2)], "k int, level int, i int, j int, value double")
    assert R.collapse_average(whole, ["k"], 1).where("level = 0").first()["value"] == 4.5
    gap = whole.withColumn("value", F.when(F.col("i") > 1, F.col("value")))
    assert R.collapse_average(gap, ["k"], 1).where("level = 0").first()["value"] is None


def test_lakes(spark):
    outline = spark.createDataFrame([(1, 2.01), (1, 2.04), (1, 3.0), (2, None)], "lake int, z double")
    assert [tuple(r) for r in R.lake_levels(outline).collect()] == [(1, 2.0)]
    cells = spark.createDataFrame([(1, 1.5), (1, 3.0), (1, -60.0), (None, 0.0)], "lake int, z double")
    got = [(r["z"], r["level"], r["depth"]) for r in R.fill_lakes(cells, R.lake_levels(outline)).collect()]
    assert sorted(got) == [(-48.0, 2.0, 50.0), (0.0, -1.0, 0.0), (1.5, 2.0, 0.5), (3.0, 2.0, 0.0)]


# functions


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(x=st.floats(0, 50), mean=st.floats(-2, 2), std=st.floats(0.1, 5))
def test_physical_inverts_normalise(spark, x, mean, std):
    stats = {"mean": mean, "std": std, "s": 1.5, "min": 0.0, "max": 60.0}
    for transform in ("none", "log1p", "asinh"):
        for norm in ("zscore", "minmax"):
            z = C.normalise(F.col("x"), stats, transform, norm)
            assert one(spark, C.to_physical(z, stats, transform, norm), x=x) == pytest.approx(x, abs=1e-6, rel=1e-6)


def test_keys_and_paths(spark):
    key = one(spark, C.parse_core_key("k"), k="u_100y_48h_2c_t0012_r003_c104_s8_pred.npy")
    assert key.asDict() == {"var": "u", "scenario": "100y_48h_2c", "t": "t0012", "patch_row": 3, "patch_col": 104, "scale": 8}
    assert one(spark, C.parse_core_key("k"), k="nothing") is None
    assert one(spark, C.natural_key("k"), k="/a/9/f10_b2.nc") == [10, 2]
    assert one(spark, C.rewrite_prefix("k", [("/a/", "/z/"), ("/a", "/q")]), k="/a/b") == "/z/b"
    assert one(spark, C.parse_list("k"), k="1, NULL,,x") == [1.0, -999.0, -999.9, None]
    assert one(spark, C.parse_scenario("k"), k="20y_6h_1c").asDict() == {"ari": 20, "duration_h": 6, "warming_c": 1}


def test_bands_at_their_edges(spark):
    got = [one(spark, C.depth_band("v", 0.1, 0.5, 1.0), v=v) for v in (0.1 - 1e-9, 0.1, 0.5, 1.0)]
    assert got == ["nonflood", "slight", "severe", "extreme"] and one(spark, C.depth_band("v", 0.1, 0.5, 1.0, 0.0), v=-1.0) is None
    assert [one(spark, C.mismatch_class(F.lit(a), F.lit(b), F.lit(m))) for a, b, m in ((True, True, True), (True, False, True), (False, True, True), (True, True, False))] == [1, 2, 3, 0]


# scores


def test_scores_of_edge_cases(spark):
    dry, wet = pairs(spark, [0, 0], [0, 0]), pairs(spark, [1, 2], [1, 2])
    config = {k: {"type": "event", "kind": k, "threshold": 0.1} for k in ("csi", "precision", "recall")}
    assert S.score(dry, config, []).first().asDict() == {"csi": 0.0, "precision": 0.0, "recall": 0.0}
    assert all(v == pytest.approx(1) for v in S.score(wet, config, []).first())
    null = {k: v | {"empty": "null"} for k, v in config.items()}
    assert list(S.score(dry, null, []).first()) == [None] * 3
    flat = {"a": {"type": "nse", "safe": True}}
    assert S.score(pairs(spark, [1, 1], [1, 1]), flat, []).first()["a"] == 1.0
    assert S.score(pairs(spark, [5, 5], [1, 1]), flat, []).first()["a"] == -1.0
    assert S.patch_global_stats(pairs(spark, [1], [1], [0]), ["scenario"]).count() == 0


def test_scores_match_numpy(spark):
    rng = np.random.default_rng(4)
    p, t, m = rng.random(60) * 2, rng.random(60) * 2, rng.integers(0, 2, 60)
    got = S.score(pairs(spark, p, t, m.tolist()), {"rmse": {"type": "rmse"}, "nse": {"type": "nse"}, "csi": {"type": "event", "kind": "csi", "threshold": 0.5}, "soft": {"type": "event", "kind": "csi", "threshold": 0.5, "tolerance": 0.3}}, []).first()
    a, b = p[m == 1], t[m == 1]
    assert got["rmse"] == pytest.approx(np.sqrt(((a - b) ** 2).mean()))
    assert got["nse"] == pytest.approx(1 - ((a - b) ** 2).sum() / ((b - b.mean()) ** 2).sum())
    x, y = a >= 0.5, b >= 0.5
    assert got["csi"] == pytest.approx((x & y).sum() / (x | y).sum())
    x = np.where(np.abs(a - b) <= 0.3, y, x)
    assert got["soft"] == pytest.approx((x & y).sum() / (x | y).sum())


def test_levels_add_up(spark):
    rng = np.random.default_rng(1)
    rows = [("ab"[i % 2], f"t{i % 3}", i % 5, 0, 0, i, float(rng.random()), float(rng.random()), 1) for i in range(200)]
    c = spark.createDataFrame(rows, "scenario string, t string, patch_row int, patch_col int, y int, x int, pred double, target double, mask int")
    stats = S.patch_global_stats(c, S.LEVELS["patch"])
    whole = S.metrics_of_sums(S.patch_global_stats(c, []), []).first()
    total = S.global_metrics(stats).where("level = 'dataset'").first()
    assert all(total[k] == pytest.approx(whole[k]) for k in ("n", "rmse", "nse", "csi", "severe_rmse"))
    assert S.global_metrics(stats, ("patch", "time", "scenario", "dataset")).count() == stats.count() + 6 + 2 + 1


def test_ssim_and_psnr(spark):
    rng = np.random.default_rng(2)
    a = rng.random((16, 16)) * 255
    rows = [("same", 16, 16, a.ravel().tolist(), a.ravel().tolist()), ("noisy", 16, 16, a.ravel().tolist(), (a + rng.normal(0, 20, a.shape)).ravel().tolist())]
    got = {r["k"]: r["ssim"] for r in V.ssim(spark.createDataFrame(rows, "k string, h int, w int, a array<double>, b array<double>"), ["k"]).collect()}
    assert got["same"] == pytest.approx(1) and 0.5 < got["noisy"] < 1
    p = spark.createDataFrame([("x", 1.0, 1.0), ("y", 0.0, 255.0)], "k string, a double, b double")
    out = {r["k"]: (r["equal"], r["psnr"]) for r in S.psnr(p, ["k"]).collect()}
    assert out == {"x": (True, None), "y": (False, 0.0)}


def test_best_shift_finds_the_move(spark):
    a = (np.random.default_rng(3).random((12, 12)) > 0.6).astype(float)
    b = np.zeros_like(a)
    b[:-1, 2:] = a[1:, :-2]  # b is a moved by (-1, 2)
    df = spark.createDataFrame([(1, 12, 12, a.ravel().tolist(), b.ravel().tolist())], "k int, h int, w int, fine array<double>, coarse array<double>")
    r = V.best_shift(df, 0.5, 3, mask=None).first()
    assert (r["dy"], r["dx"], r["csi"]) == (-1, 2, 1.0)


def test_best_shift_with_masks_and_gaps(spark):
    """Against every shift of the fine array, done the plain way."""
    rng = np.random.default_rng(13)
    rows, want = [], {}
    for i in range(12):
        fine, coarse, mask = rng.random((7, 6)), rng.random((7, 6)), (rng.random((7, 6)) > 0.3).astype(int)
        fine[rng.random((7, 6)) > 0.8] = np.nan
        if i == 0:
            mask[:] = 0
        best = None
        for dy in range(-2, 3):
            for dx in range(-2, 3):
                moved = np.full((7, 6), np.nan)
                for y in range(7):
                    for x in range(6):
                        if 0 <= y - dy < 7 and 0 <= x - dx < 6:
                            moved[y, x] = fine[y - dy, x - dx]
                ok = (mask == 1) & np.isfinite(moved)
                p, t = (coarse >= 0.5) & ok, (moved >= 0.5) & ok
                csi = (p & t).sum() / max((p | t).sum(), 1)
                if ok.any() and (best is None or csi > best[0]):
                    best = (csi, dy, dx)
        want[i] = best or (None, None, None)
        rows.append((i, 7, 6, fine.ravel().tolist(), coarse.ravel().tolist(), mask.ravel().tolist()))
    df = spark.createDataFrame(rows, "k int, h int, w int, fine array<double>, coarse array<double>, mask array<int>")
    assert {r["k"]: (r["csi"], r["dy"], r["dx"]) for r in V.best_shift(df, 0.5, 2).collect()} == want


def test_hillshade_is_the_light_on_the_surface(spark):
    z = np.random.default_rng(14).random((6, 9)) * 3
    gy, gx = np.gradient(z)
    df = spark.createDataFrame([(1, y, x, float(z[y, x])) for y in range(6) for x in range(9)], "k int, y int, x int, value double")
    for azimuth, altitude in ((0, 45), (90, 30), (315, 45), (200, 80)):
        light = np.array([np.sin(np.radians(azimuth)), np.cos(np.radians(azimuth)), 0]) * np.cos(np.radians(altitude)) + np.array([0, 0, np.sin(np.radians(altitude))])
        normal = np.stack([-gx, gy, np.ones_like(z)], -1) / np.sqrt(1 + gx**2 + gy**2)[..., None]
        want = np.clip((normal @ light + 1) / 2, 0, 1)
        got = {(r["y"], r["x"]): r["shade"] for r in R.hillshade(df, ["k"], azimuth, altitude).collect()}
        assert all(got[y, x] == pytest.approx(want[y, x]) for y in range(6) for x in range(9))


def test_augment_turns_as_numpy(spark):
    rng = np.random.default_rng(15)
    n, rows, layers = 5, [], {}
    for i in range(24):
        layers[i] = rng.random((3, n, n))
        rows += [(i, y, x, *(float(v) for v in layers[i][:, y, x])) for y in range(n) for x in range(n)]
    df = spark.createDataFrame(rows, "row_id int, y int, x int, value double, aspect_sin double, aspect_cos double")
    got = {k: np.zeros((3, n, n)) for k in layers}
    for r in R.augment(df, n, 3).collect():
        got[r["row_id"]][:, r["y"], r["x"]] = r["value"], r["aspect_sin"], r["aspect_cos"]
    seen = set()
    for i, (value, s, c) in layers.items():
        for flips in range(8):
            a, b, d = value, s, c
            if flips & 1:
                a, b, d = a[:, ::-1], -b[:, ::-1], d[:, ::-1]
            if flips & 2:
                a, b, d = a[::-1], b[::-1], -d[::-1]
            if flips & 4:
                a, b, d = np.rot90(a), -np.rot90(d), np.rot90(b)
            if np.array_equal(got[i][0], a):
                assert np.array_equal(got[i][1], b) and np.array_equal(got[i][2], d)
                seen.add(flips)
                break
        else:
            raise AssertionError(i)
    assert len(seen) > 4


def test_canvas_of_two_axes(spark):
    static = spark.createDataFrame([(y, x, float(10 * y + x)) for y in range(3) for x in range(4)], "y int, x int, z double")
    # whole cells apart: a shift; y runs the other way
    got = {(r["y"], r["x"]): r["z"] for r in J.place_on_axes(static, [1.0, 2.0, 3.0, 4.0, 5.0], [30.0, 20.0, 10.0], [2.0, 3.0, 4.0, 5.0], [10.0, 20.0, 30.0]).collect()}
    assert got == {(i, j): float(10 * (2 - i) + j - 1) if j else None for i in range(3) for j in range(5)}
    # irregular: the nearest along each axis, the lower of two, nothing outside
    assert J.nearest_on_axis([-0.1, 0.0, 0.5, 0.51, 2.4, 3.0, 3.1], [0.0, 1.0, 3.0]) == [None, 0, 0, 1, 2, 2, None]
    assert J.nearest_on_axis([4.0, 5.0], [5.0]) == [None, 0]


def test_losses_of_patches(spark):
    """Each loss is the mean over patches of a patch's own ratio."""
    rng = np.random.default_rng(16)
    pred, target, logit, mask = rng.random((4, 30)) * 2, rng.random((4, 30)) * 2, rng.normal(0, 2, (4, 30)), rng.random((4, 30)) > 0.4
    mask[3] = False
    rows = [(k, i, float(pred[k, i]), float(target[k, i]), int(mask[k, i]), float(logit[k, i])) for k in range(4) for i in range(30)]
    df = spark.createDataFrame(rows, "k int, x int, pred double, target double, mask int, l1 double").withColumns({"l2": F.col("l1") - 1, "l3": F.col("l1") - 2})

    def total(loss):
        found = {r["k"]: r["loss"] for r in loss.collect()}
        assert 3 not in found
        return np.mean(list(found.values()))

    def mean(value, chosen=True):
        num, den = (value * mask).sum(1), (np.broadcast_to(chosen, mask.shape) & mask).sum(1)
        return np.mean(num[den > 0] / den[den > 0])

    d, excess, wet = np.abs(pred - target), np.maximum(target - 0.4, 0), target >= 0.4
    for mode, g in {"none": 0 * excess, "linear": excess, "power": (excess / 0.3) ** 1.7, "exp": 1 - np.exp(-excess / 0.3)}.items():
        w = np.clip(1 + 0.5 * wet + 2 * g, 1.1, 4)
        got = S.weighted_loss(df, ["k"], 0.4, 0.5, 2.0, mode, scale=0.3, gamma=1.7, least=1.1, most=4.0)
        assert total(got) == pytest.approx(mean(d * w))
    assert total(S.weighted_loss(df, ["k"], 0.4, mode="linear", power=2, minmax=True)) == pytest.approx(mean(d**2 * np.clip(1 + 2 * wet + excess / 0.6, 0, 20)))
    inside = (target >= 0) & (target <= 0.9)
    bell = np.exp(-0.5 * ((target - 0.4) / (0.5 * 0.45)) ** 2)
    assert total(S.band_loss(df, ["k"], 0.4, 0.5)) == pytest.approx(mean(d * inside, inside))
    assert total(S.band_loss(df, ["k"], 0.4, 0.5, "gaussian")) == pytest.approx(mean(d * bell * inside, inside))
    assert total(S.band_loss(df, ["k"], 0.4, 0.5, "gaussian", truncate=False)) == pytest.approx(mean(d * bell, inside))
    low = (target > 0.5) & (target <= 1.2)
    assert total(S.range_loss(df, ["k"], 0.5, 1.2, "l2", low_in=False, high_in=True)) == pytest.approx(mean(d**2 * low, low))
    p = 1 / (1 + np.exp(-logit))
    plain = -np.where(wet, 3 * np.log(p), np.log(1 - p))
    assert total(S.bce_loss(df, ["k"], "l1", 0.4, pos_weight=3.0)) == pytest.approx(mean(plain))
    focal = plain * np.where(wet, 0.7 * (1 - p) ** 2, 0.3 * p**2)
    assert total(S.bce_loss(df, ["k"], "l1", 0.4, 3.0, focal=2.0, alpha=0.7)) == pytest.approx(mean(focal))
    parts = [(logit, target >= 0.4, 1.0), (logit - 1, target >= 0.8, 2.0), (logit - 2, target >= 1.0, 0.5)]
    ordered = sum(w * -np.where(t, -np.log1p(np.exp(-z)), -np.log1p(np.exp(z))) for z, t, w in parts)
    assert total(S.ordinal_bce_loss(df, ["k"], (0.4, 0.8, 1.0), weights=(1.0, 2.0, 0.5))) == pytest.approx(mean(ordered))
    gap = [((p[k] - wet[k]) * mask[k]).sum() / mask[k].sum() for k in range(3)]
    assert total(S.prevalence_loss(df, ["k"], "l1", 0.4)) == pytest.approx(np.mean(np.square(gap)))


def test_event_duration_drops_bad_names(spark):
    rows = [(n, [1.0], [2.0], [7]) for n in ("12", "-3", " 4 ", "1.5", "missing", "Is missing here", "Fine")]
    b = spark.createDataFrame(rows, "name string, tocs array<double>, flows array<double>, reaches array<long>")
    assert sorted(r["name"] for r in H.event_duration(b, [6]).collect()) == ["1.5", "Fine"]


def test_losses(spark):
    c = pairs(spark, [1.0, 0.0], [0.5, 0.0]).withColumn("l1", (F.col("pred") - 0.1) * 4)
    assert S.masked_l1(c, ["scenario"]).first()["loss"] == pytest.approx(0.25)
    assert S.masked_l2(c, ["scenario"]).first()["loss"] == pytest.approx(0.125)
    assert S.band_loss(c, ["scenario"], 0.5, 0.1).first()["loss"] == pytest.approx(0.5)
    want = np.mean([np.log1p(np.exp(-3.6)), np.log1p(np.exp(-0.4))])
    assert S.bce_loss(c, ["scenario"], "l1", 0.1).first()["loss"] == pytest.approx(want)


# statistics


def test_stats_merge_exactly(spark):
    v = np.random.default_rng(5).normal(3, 2, 300)
    df = spark.createDataFrame([(int(i % 2), float(x)) for i, x in enumerate(v)], "g int, value double")
    parts = [A.masked_stats(df.where(f"g = {g}"), [], mask=None).withColumn("k", F.lit(1)) for g in (0, 1)]
    got = A.merge_stats(parts, ["k"]).first()
    assert (got["n"], got["mean"], got["std"]) == (300, pytest.approx(v.mean()), pytest.approx(v.std()))


def test_histogram_percentile_is_near(spark):
    v = np.random.default_rng(6).gamma(2, 1, 5000)
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    got = {r["q"]: r["value"] for r in A.histogram_percentile(df, "v", [1, 50, 99]).collect()}
    assert all(abs(got[float(q)] - np.percentile(v, q)) < 2 * (v.max() - v.min()) / 8192 + 0.01 for q in (1, 50, 99))
    same = A.histogram_percentile(spark.createDataFrame([(2.0,)] * 3, "v double"), "v", [50]).first()
    assert same["value"] == 2.0


def test_histogram_edges(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (0.5,), (9.0,)], "v double")
    assert [r["n"] for r in A.histogram(df, "v", 2, 0.0, 1.0).orderBy("bin").collect()] == [1, 2]


# joins


def test_nearest_time_ties_go_back(spark):
    s = spark.createDataFrame([("a", 0, 1.0), ("a", 10, 2.0)], "k string, u long, value double").withColumn("ts", F.timestamp_seconds("u"))
    q = spark.createDataFrame([("a", 5), ("a", 6), ("a", -3), ("a", 99)], "k string, u long").withColumn("ts", F.timestamp_seconds("u"))
    got = [r["value"] for r in J.nearest_time(s, q, ["k"]).orderBy("ts").collect()]
    assert got == [1.0, 1.0, 2.0, 2.0]


def test_snap_is_half_even(spark):
    tiles = spark.createDataFrame([(1.0, 2.0, 0.0, 1.0), (2.0, 3.0, 0.0, 1.0), (9.0, 9.0, -5.0, -5.0)], "x_min double, x_max double, y_min double, y_max double")
    got = [(r["ci"], r["cj"]) for r in J.snap_coarse_window(tiles, 0.0, 0.0, 1.0, 6, 6, 4).collect()]
    assert got == [(0, 0), (0, 0), (2, 0)]


@pytest.mark.parametrize("padding,want", [("replicate", [0, 0, 0, 1, 2]), ("reflection", [2, 1, 0, 1, 2]), ("reflection_circle", [4, 3, 0, 1, 2]), ("circle", [3, 4, 0, 1, 2])])
def test_frame_padding(spark, padding, want):
    df = spark.createDataFrame([(0, 100)], "frame int, max_frame int")
    assert [r["neighbour"] for r in J.frame_neighbours(df, 5, padding).orderBy("slot").collect()] == want


@pytest.mark.parametrize("padding,want", [("replicate", [98, 99, 100, 100, 100]), ("reflection", [98, 99, 100, 99, 98]), ("reflection_circle", [98, 99, 100, 97, 96]), ("circle", [98, 99, 100, 96, 97])])
def test_frame_padding_at_the_end(spark, padding, want):
    df = spark.createDataFrame([(100, 100)], "frame int, max_frame int")
    assert [r["neighbour"] for r in J.frame_neighbours(df, 5, padding).orderBy("slot").collect()] == want


def test_polygons(spark):
    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
    df = spark.createDataFrame([(1.0, 1.0), (5.0, 1.0), (3.9, 3.9), (-1.0, 2.0)], "x double, y double")
    assert [r["inside"] for r in J.cells_in_polygon(df, square).collect()] == [True, False, True, False]
    polys = spark.createDataFrame([(1, square), (2, [(9.0, 9.0), (10.0, 9.0), (10.0, 10.0)]), (3, [(-50.0, -50.0), (50.0, -50.0), (0.0, 80.0)])], "poly_id int, vertices array<struct<x:double,y:double>>")
    assert sorted(r["poly_id"] for r in J.polygons_in_region(polys, (1.0, 2.0, 1.0, 2.0)).collect()) == [1, 3]
    assert {r["poly_id"]: r["area"] for r in H.polygon_areas(polys).collect()}[1] == 16.0


def test_boundary_points_stop_at_a_gap(spark):
    polys = spark.createDataFrame([(1, [(0.0, 0.0), (3.0, 0.0), (3.0, 3.0), (0.0, 3.0)])], "poly_id int, vertices array<struct<x:double,y:double>>")
    dem = spark.createDataFrame([(0, 0, -2.0), (0, 1, 0.0), (0, 2, -3.0), (1, 3, -9.0)], "y int, x int, z double")
    got = [r["point"] for r in J.open_boundary_points(polys, dem, 0.0, 0.0, 1.0, step=1.0).orderBy("point").collect()]
    assert got == [0, 2]


def test_nearest_far_from_all(spark):
    places = spark.createDataFrame([(1, 0.0, 0.0), (2, 1000.0, 0.0)], "reach_id int, x double, y double")
    points = spark.createDataFrame([(7, -300.0, 4.0), (8, 999.0, 1.0)], "point_id int, x double, y double")
    got = {(r["point_id"], r["rank"]): r["reach_id"] for r in J.nearest_k(points, places, 2, "point_id", "reach_id").collect()}
    assert got == {(7, 1): 1, (7, 2): 2, (8, 1): 2, (8, 2): 1}


def test_nearest_equals_brute_force_where_places_crowd(spark):
    """A third of all places at one spot, a dense cluster beside a sparse plain, ties, points far out, null and repeated ones."""
    rng = np.random.default_rng(7)
    xy = [(0.0, 0.0)] * 200 + [(5 + float(a), 5 + float(b)) for a, b in rng.normal(0, 1e-4, (200, 2))] + [tuple(map(float, v)) for v in rng.integers(-50, 50, (150, 2))]
    places = [(int(i), x, y) for i, (x, y) in zip(rng.permutation(len(xy)), xy, strict=True)]
    asked = [(i, float(x), float(y)) for i, (x, y) in enumerate([(0, 0), (5, 5), (5.1, 5), (1e6, -3), (-70, 20), *rng.uniform(-60, 60, (60, 2)), *rng.normal(5, 1e-4, (30, 2))])]
    asked += [asked[3], (900, None, 1.0)]
    p = spark.createDataFrame([*places, (9999, None, 0.0)], "reach_id int, x double, y double").repartition(3)
    q = spark.createDataFrame(asked, "point_id int, x double, y double")
    ids, at = np.array([r[0] for r in places]), np.array([r[1:] for r in places])
    for k, most in ((1, 8), (7, 20), (600, None)):
        want = set()
        for i, x, y in asked:
            if x is not None:
                d = np.sqrt((x - at[:, 0]) ** 2 + (y - at[:, 1]) ** 2)
                want |= {(i, int(ids[j]), n + 1) for n, j in enumerate(np.lexsort((ids, d))[:k])}
        got = J.nearest_k(q, p, k, "point_id", "reach_id", most=most).collect()
        assert len(got) == len(want) and {(r["point_id"], r["reach_id"], r["rank"]) for r in got} == want
    cells, depth = J.cell_tree(p.select(F.col("x").alias("_px"), F.col("y").alias("_py")).where("x IS NOT NULL"), 101.0, -50.0, -50.0, 20)
    assert depth > 4 and cells.where("NOT _inner AND _l < 12").agg(F.max("_n")).first()[0] <= 20
    none = p.limit(0)
    assert J.nearest_k(q, none, 3, "point_id", "reach_id").collect() == []
    one = J.nearest_k(q.where("point_id = 0"), p.where("reach_id = 3"), 3, "point_id", "reach_id").collect()
    assert [(r["reach_id"], r["rank"]) for r in one] == [(3, 1)]


# sampling


def test_split_is_whole(spark):
    idx = spark.createDataFrame([(i, "ab"[i > 4]) for i in range(40)], "row_id long, scenario string")
    out = W.train_val_split(idx, ratio=0.1)
    n = {(r["scenario"], r["split"]): r["count"] for r in out.groupBy("scenario", "split").count().collect()}
    assert n == {("a", "train"): 4, ("a", "val"): 1, ("b", "train"): 31, ("b", "val"): 4}


def test_weighted_sample_follows_weights(spark):
    df = spark.createDataFrame([(i, float(i % 4)) for i in range(2000)], "row_id long, w double")
    out = W.weighted_sample(df, "w", 2.0, 3, 1).cache()
    assert out.count() == 4002 and out.select("draw_id").distinct().count() == 4002 and {r[0] for r in out.select("replica").distinct().collect()} == {0, 1, 2}
    n = {r["m"]: r["count"] for r in out.groupBy((F.col("row_id") % 4).alias("m")).count().collect()}
    assert 0 not in n and abs(n[3] / n[1] - 3) < 0.5


def test_shuffle_is_a_permutation(spark):
    df = spark.range(500).withColumnRenamed("id", "row_id")
    out = W.enlarged_shuffle(df, 2, 3, 0)
    rows = out.collect()
    assert sorted(r["position"] for r in rows) == list(range(1002)) and len({r["row_id"] for r in rows}) == 500


def test_best_worst_ties(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", None), ("d", 0.5)], "id string, m double")
    r = W.best_worst(df, {"m": "higher"}, ["id"]).first()
    assert (r["best_ids"]["id"], r["worst_ids"]["id"]) == ("a", "d")


def test_weights_are_checked(spark):
    df = spark.createDataFrame([(0.5,)], "r double")
    for bad in ([{"column": "r", "alpha": -1.0, "mode": "hard", "threshold": 1}], [{"column": "r", "alpha": 1.0, "mode": "percentile", "lo": 1.0, "hi": 1.0}]):
        with pytest.raises(ValueError):
            W.sample_weights(df, bad)


# series


def hourly(spark, values, start=0):
    return spark.createDataFrame([("s", start + i * 3600, float(v)) for i, v in enumerate(values)], "k string, u long, value double").withColumn("ts", F.timestamp_seconds("u"))


def test_downcrossings_of_a_tide(spark):
    v = [math.sin(2 * math.pi * h / 12.4 + 0.3) for h in range(96)]
    r = T.zero_downcrossing(hourly(spark, v), ["k"]).first()
    assert abs(r["mean_period_h"] - 12.4) < 0.3 and r["rms"] == pytest.approx(math.sqrt(0.5), abs=0.02)
    kinds = [x["kind"] for x in T.local_extrema(hourly(spark, [1, 3, 2, 2, 5]), ["k"]).orderBy("u").collect()]
    assert kinds == ["low", "high", "high"]


def test_one_constituent(spark):
    c = spark.createDataFrame([(1, "M2", 1 / 12.42, 1.5, 40.0)], "node_id int, name string, freq double, amp double, phase double")
    times = spark.createDataFrame([(0,), (7,)], "h int").select(F.timestamp_seconds(F.unix_timestamp(F.lit("2000-01-01 00:00:00").cast("timestamp")) + F.col("h") * 3600).alias("ts"))
    got = [r["level"] for r in T.predict_tide(c, times).orderBy("ts").collect()]
    assert got == pytest.approx([1.5 * math.cos(-math.radians(40)), 1.5 * math.cos(2 * math.pi * 7 / 12.42 - math.radians(40))])


def test_smooth_and_history(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([1.0, 3.0, 3.0, 2.0])], "k string, step int, value double")
    got = [r["smoothed"] for r in T.smooth(df, ["k"], 0.5).orderBy("step").collect()]
    assert got == [1.0, 2.0, 2.5, 2.25]
    out = T.best_metric_history(df, by=("k",), step="step").orderBy("step").collect()
    assert [(r["best_value"], r["best_step"]) for r in out] == [(1.0, 0), (3.0, 1), (3.0, 2), (3.0, 2)]


def test_event_selection(spark):
    b = spark.createDataFrame([("x", [2.0, 4.0], [1.0, 9.0], [11, 12]), ("7", [1.0], [5.0], [1]), ("y", [30.0], [3.0], [5]), ("z", [1.0], [0.0], [6])], "name string, tocs array<double>, flows array<double>, reaches array<int>")
    got = {r["name"]: (r["duration"], r["reach_id"]) for r in H.event_duration(b, [6, 12, 24]).collect()}
    assert got == {"x": (12, 12), "y": (24, 5)}


# checks, files, streams


def test_checks(spark):
    a, b = spark.range(3), spark.range(1, 4)
    assert sorted((r["id"], r["side"]) for r in U.same_keys(a, b, ["id"]).collect()) == [(0, "a"), (3, "b")]
    with pytest.raises(ValueError):
        U.require_columns(a, ["id", "x"])
    assert U.require_columns(a, ["key"], {"id": "key"}).columns == ["key"]


def test_npy_and_text_sources(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.asfortranarray(np.arange(6, dtype=np.float64).reshape(2, 3)))
    r = io.read_npy(spark, str(tmp_path)).first()
    assert (r["h"], r["w"], r["values"]) == (2, 3, [0.0, 1.0, 2.0, 3.0, 4.0, 5.0])
    (tmp_path / "s.txt").write_text("# time zs\n 0  1.5\n\n10\t2.5 9\n")
    assert [tuple(x) for x in io.read_point_series(spark, str(tmp_path / "s.txt"), ["time", "zs", "h"]).collect()] == [(0.0, 1.5, None), (10.0, 2.5, 9.0)]


def test_other_sinks_and_sources(spark, tmp_path):
    one = "struct<n:bigint,min:double,max:double,mean:double,std:double>"
    doc = spark.sql(f"SELECT 7 AS seed, map('elevation', CAST(named_struct('n', 3, 'min', 0.0, 'max', 2.0, 'mean', 1.0, 'std', 0.5) AS {one})) AS stats")
    io.write_stats_json(doc, str(tmp_path / "stats"))
    back = io.read_stats_json(spark, str(tmp_path / "stats"), ("elevation",)).first()
    assert back["seed"] == 7 and back["stats"]["elevation"]["mean"] == 1.0
    with pytest.raises(ValueError):
        io.read_stats_json(spark, str(tmp_path / "stats"), ("twi",))
    io.write_metric_tables({"scenario": spark.createDataFrame([("s", 0.5)], "scenario string, csi double")}, str(tmp_path / "metrics"))
    assert spark.read.option("header", True).csv(str(tmp_path / "metrics/scenario")).first()["csi"] == "0.5"
    (tmp_path / "run.txt").write_text("step 1\nFailed twice\n")
    lines = io.read_log_lines(spark, str(tmp_path / "run.txt"))
    assert [r["value"] for r in lines.collect()] == ["step 1", "Failed twice"] and lines.first()["file"].endswith("run.txt")
    p = spark.sql("SELECT 's' AS scenario, 'h' AS var, 't0' AS t, 0 AS time_index, 1 AS patch_row, 2 AS patch_col, 8 AS downscale, 'fine' AS grid, 1 AS h, 2 AS w, array(1f, 2f) AS values, array(1Y, 0Y) AS mask")
    io.write_patches(p, str(tmp_path / "patches"))
    assert io.read_patches(spark, str(tmp_path / "patches")).first()["values"] == [1.0, 2.0]


def test_prefix_counters(spark):
    df = spark.createDataFrame([("/a/x", "/a/y"), ("/b/x", None), ("/a/z", "/c")], "p string, q string")
    out, n = U.rewrite_prefixes(df, [("/a/", "/z/"), ("/b", "/b")], ["p", "q"])
    assert n.first().asDict() == {"rows": 3, "rows_changed": 2, "cells_changed": 3}
    assert [tuple(r) for r in out.collect()] == [("/z/x", "/z/y"), ("/b/x", None), ("/z/z", "/c")]


def test_index_round_trip(spark, tmp_path):
    (tmp_path / "index.csv").write_text("scenario,var,t,time_index,patch_row,patch_col,elev_path,aoi_ratio,filtered_out\ns,h,t0000,0,1,2,,0.5,0\ns,h,t0001,1,1,2,/e,0.6,1\n")
    idx = io.read_patch_index(spark, str(tmp_path / "index.csv"))
    rows = idx.orderBy("row_id").collect()
    assert [(r["row_id"], r["time_index"], r["elev_fine_path"]) for r in rows] == [(0, 0, None), (1, 1, "/e")]
    io.write_patch_index(idx, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_streams_equal_batches(spark, tmp_path):
    rows = [("a", 1.0, 1), ("a", 3.0, 1), ("b", 2.0, 0), ("b", 5.0, 1)]
    df = spark.createDataFrame(rows, "k string, value double, mask int")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = X.stream_masked_stats(stream, ["k"]).writeStream.format("memory").queryName("running").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("running").collect())) == sorted(map(tuple, A.masked_stats(df, ["k"]).collect()))


def test_scores_stream(spark, tmp_path):
    c = pairs(spark, [1.0, 0.0, 0.5], [0.5, 0.0, 0.5])
    stats = S.patch_global_stats(c, ["scenario", "var", "t", "patch_row", "patch_col"][:1] + ["t", "patch_row", "patch_col"])
    stats.write.parquet(str(tmp_path / "in"))
    got = []
    q = X.stream_scores(spark.readStream.schema(stats.schema).parquet(str(tmp_path / "in")), lambda b, n: got.extend(b.collect()), str(tmp_path / "c"))
    q.processAllAvailable()
    q.stop()
    assert got[0]["rmse"] == pytest.approx(S.metrics_of_sums(stats, []).first()["rmse"])


def test_registered_queries_have_unique_names_and_run(spark):
    import __spark_entry__ as entry

    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names) and len(names) > 100
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["p20_best_shift", "j7_nearest_reach", "a3_histogram_percentile"])
def test_queries_of_full_width_match_their_sql(spark, name):
    import __spark_entry__ as entry

    duckdb = pytest.importorskip("duckdb")
    folder = Path("/root/testdata/sf0.001")
    con = duckdb.connect()
    for table in folder.glob("*.parquet"):
        con.execute(f"CREATE VIEW {table.stem} AS SELECT * FROM '{table}'")
    full = entry.queries()[name](spark, str(folder))
    said = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in said.description]
    # the key columns come first, so that rounded values don't decide the order
    keys = [c for c in names if c not in ("csi", "dy", "dx", "reach_id", "uparea", "value")]
    order = keys + [c for c in names if c not in keys]
    got = sorted(([r[c] for c in order] for r in full.collect()), key=lambda r: str(r[: len(keys)]))
    wanted = sorted(([r[names.index(c)] for c in order] for r in said.fetchall()), key=lambda r: str(r[: len(keys)]))
    assert len(got) == len(wanted) > 0
    for g, w in zip(got, wanted, strict=True):
        assert g[: len(keys)] == w[: len(keys)] and list(map(float, g[len(keys) :])) == pytest.approx(list(map(float, w[len(keys) :])), abs=2e-6)


def test_best_shift_query_finds_a_move_of_three(spark, monkeypatch):
    from floodgrid.plans import scores

    target, pred = np.zeros((8, 8)), np.zeros((8, 8))
    target[[4, 5, 5], [2, 2, 3]] = 1.0
    pred[[1, 2, 2], [4, 4, 5]] = 1.0
    row = (*["k"] * len(scores.KEYS), target.ravel().tolist(), pred.ravel().tolist(), [1] * 64)
    moved = spark.createDataFrame([row], [*scores.KEYS, "target", "pred", "mask"])
    monkeypatch.setattr(scores, "vectors", lambda spark, sf: moved)
    r = scores.p20_best_shift(spark, "").first()
    assert (r["csi"], r["dy"], r["dx"]) == (1.0, -3, 2)


def test_split_counts_by_hash_prefix(spark):
    """The same rows as a rank over the whole group gives, also for a null group."""
    rows = [(i, "a" if i % 3 else None) for i in range(400)] + [(1000, "one")]
    df = spark.createDataFrame(rows, "row_id int, scenario string")
    got = {r["row_id"]: r["split"] for r in W.train_val_split(df, ratio=0.13, seed=5).collect()}
    for group in {s for _, s in rows}:
        own = sorted((i for i, s in rows if s == group), key=lambda i: (hashlib.md5(f"5:{i}".encode()).hexdigest(), i))
        n = max(1, round(len(own) * 0.13))
        assert [got[i] for i in own] == ["val"] * n + ["train"] * (len(own) - n)


def test_index_rows_are_numbered_without_gaps(spark, tmp_path):
    spark.range(250).selectExpr("CAST(id AS STRING) scenario", "'h' AS var", "'' AS coarse_path").repartition(4).write.option("header", True).csv(str(tmp_path / "m"))
    back = io.read_patch_index(spark, str(tmp_path / "m"))
    assert sorted(r["row_id"] for r in back.collect()) == list(range(250)) and back.where("coarse_path IS NULL").count() == 250


def test_limits_keep_the_first_steps(spark):
    df = spark.createDataFrame([("a", t) for t in (5, 3, 3, 9)] + [("b", t) for t in (1, 2)] + [("c", 1)], "scenario string, time_index int")
    got = sorted(map(tuple, M.limit_scenarios(df, ["a:2", "b"]).collect()))
    assert got == [("a", 3), ("a", 3), ("a", 5), ("b", 1), ("b", 2)]


def test_streams_drain_to_files(spark, tmp_path):
    spark.createDataFrame([("k", float(i), 1) for i in range(6)], "k string, value double, mask int").repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, value double, mask int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    r = X.drain(X.stream_masked_stats(stream, ["k"]), "complete").first()
    assert (r["n"], r["max"]) == (6, 5.0)
    assert X.drain(stream.where("value > 2"), "append").count() == 3


def test_weighted_sample_draws_every_time(spark):
    df = spark.createDataFrame([(i, 0.1 + (i % 7) / 3) for i in range(300)], "row_id long, weight double")
    for epoch in range(3):
        out = W.weighted_sample(df, "weight", 5.0, 1, epoch)
        assert out.select("draw_id").distinct().count() == out.count() == 1500


def test_exact_percentiles_in_bins(spark):
    """Ties, a NULL group, heavy tails, single values and empty groups, with few bins and many."""
    rng = np.random.default_rng(1)
    rows = []
    for g, n in (("a", 400), (None, 300), ("c", 1)):
        rows += [(g, float(x)) for x in np.where(rng.random(n) < 0.4, 0.0, rng.lognormal(0, 4, n))]
    df = spark.createDataFrame([*rows, ("d", None), ("a", float("nan"))], "g string, v double")
    qs = [0, 1, 33.3, 50, 99.9, 100]
    for bins in (3, 4096):
        got = {r["g"]: r["percentiles"] for r in A.exact_percentiles(df, "v", qs, ["g"], bins=bins).collect()}
        assert got.pop("d") is None and len(got) == 3
        assert all(np.allclose(p, np.percentile([x for k, x in rows if k == g], qs), rtol=1e-12) for g, p in got.items())
    assert A.exact_percentiles(df.where("g = 'd'"), "v", [50]).first()["percentiles"] is None
