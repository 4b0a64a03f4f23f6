"""Maps in patch form against numpy on the whole map; polygon covers against testing every edge."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from floodgrid.operators import maps, polygons
from floodgrid.operators.joins import inside_polygon

H = W = 4
ROWS, COLS = 3, 2


def tiles_of(spark, whole, missing=()):
    rows = []
    for r in range(ROWS):
        for c in range(COLS):
            if (r, c) not in missing:
                part = whole[r * H : (r + 1) * H, c * W : (c + 1) * W]
                rows.append(("k", r, c, [None if np.isnan(v) else float(v) for v in part.ravel()]))
    return spark.createDataFrame(rows, "k string, patch_row int, patch_col int, values array<double>").repartition(3)


def whole_of(rows, column):
    out = np.full((ROWS * H, COLS * W), np.nan)
    for r in rows:
        if r[column] is not None:
            a = np.array([np.nan if v is None else v for v in r[column]]).reshape(H, W)
            out[r["patch_row"] * H : (r["patch_row"] + 1) * H, r["patch_col"] * W : (r["patch_col"] + 1) * W] = a
    return out


def shade_of(z, azimuth, altitude):
    """By the angle between the light's direction and the surface's normal."""
    gy, gx = np.gradient(z)
    az, alt = math.radians(azimuth), math.radians(altitude)
    normal = np.stack([-gx, -gy, np.ones_like(gx)]) / np.sqrt(1 + gx**2 + gy**2)
    toward = np.array([math.sin(az) * math.cos(alt), -math.cos(az) * math.cos(alt), math.sin(alt)])
    return np.clip((np.tensordot(toward, normal, 1) + 1) / 2, 0, 1)


@pytest.mark.parametrize("missing", [(), ((1, 0), (2, 1))])
def test_map_hillshade_is_that_of_the_whole_map(spark, missing):
    z = np.random.default_rng(3).normal(size=(ROWS * H, COLS * W))
    z[6, 5] = np.nan
    known = whole_of(tiles_of(spark, z, missing).collect(), "values")
    got = whole_of(maps.map_hillshade(tiles_of(spark, z, missing), ["k"], ROWS, COLS, H, W, 300.0, 30.0).collect(), "shade")
    want = np.where(np.isnan(known), np.nan, shade_of(known, 300.0, 30.0))
    own = ~np.isnan(want)
    assert own.any() and np.allclose(got[own], want[own])
    assert np.isnan(got[np.isnan(want) & ~np.isnan(known)]).all()


def test_whole_map_has_missing_tiles(spark):
    z = np.arange(ROWS * H * COLS * W, dtype=float).reshape(ROWS * H, -1)
    out = maps.whole_map(tiles_of(spark, z, ((0, 1),)), ["k"], ROWS, COLS, ["values"]).collect()
    assert len(out) == ROWS * COLS and [(r["patch_row"], r["patch_col"], r["values"]) for r in out if not r["mask"]] == [(0, 1, None)]
    assert maps.whole_map(tiles_of(spark, z).limit(0), ["k"], ROWS, COLS, ["values"]).count() == 0


def test_edges_come_from_the_four_neighbours(spark):
    z = np.arange(ROWS * H * COLS * W, dtype=float).reshape(ROWS * H, -1)
    out = maps.with_edges(tiles_of(spark, z), ["k"], H, W).where("patch_row = 1 AND patch_col = 0").first()
    assert (out["above"], out["below"]) == (z[3, :4].tolist(), z[8, :4].tolist())
    assert (out["before"], out["behind"]) == (None, z[4:8, 4].tolist())


def test_patches_resized_and_their_variation(spark):
    rng = np.random.default_rng(5)
    a = rng.random((4, 4))
    a[0, 0] = np.nan
    df = tiles_of(spark, np.tile(a, (3, 2))).limit(1)
    def row(mode):
        return np.array([np.nan if v is None else v for v in maps.resize_patches(df, 4, 4, 2, mode).first()["resized"]])
    mean = row("mean").reshape(2, 2)
    assert np.allclose(mean, [[np.nanmean(a[i : i + 2, j : j + 2]) for j in (0, 2)] for i in (0, 2)])
    assert np.allclose(row("nearest").reshape(8, 8)[2:, 2:], np.kron(a, np.ones((2, 2)))[2:, 2:])
    up = row("bilinear").reshape(8, 8)
    assert np.isnan(up[:3, :3]).all() and up[7, 7] == pytest.approx(a[3, 3])
    assert up[4, 5] == pytest.approx(0.75 * (0.75 * a[2, 2] + 0.25 * a[2, 3]) + 0.25 * (0.75 * a[1, 2] + 0.25 * a[1, 3]))
    tv = maps.tv_of_patches(df, 4, 4).first()["tv"]
    assert tv == pytest.approx(np.nanmean(np.abs(np.diff(a, axis=0))) + np.nanmean(np.abs(np.diff(a, axis=1))))


# polygons


def outlines():
    rng = np.random.default_rng(8)
    turn = np.linspace(0, 2 * math.pi, 200, endpoint=False)
    wavy = [(10 + (6 + math.sin(9 * t)) * math.cos(t), 10 + (6 + math.sin(9 * t)) * math.sin(t)) for t in turn]
    return {
        1: [(0.0, 0.0), (8.0, 0.0), (8.0, 8.0), (0.0, 8.0)],
        2: wavy,
        3: [(2.0, 2.0), (14.0, 3.0), (5.0, 5.0), (15.0, 15.0), (3.0, 12.0)],
        4: [(float(x), float(y)) for x, y in rng.uniform(-3, 18, (40, 2))],  # crosses itself
        5: [(-1000.0, -1000.0), (1000.0, -1000.0), (0.0, 1000.0)],
        6: [(1.0, 1.0), (2.0, 2.0)],
        7: [(5.0, 5.0), (5.0, 5.0), (9.0, 5.0), (9.0, 5.0)],
    }


@pytest.mark.parametrize("size", [0.5, 3.0, 5000.0])
def test_many_polygons_equal_every_edge(spark, size):
    rng = np.random.default_rng(9)
    xy = np.concatenate([rng.uniform(-5, 20, (500, 2)), rng.integers(-2, 16, (300, 2)), [[8.0, 8.0], [0.0, 0.0], [5.0, 5.0], [1e7, 3.0]]]).astype(float)
    points = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)] + [(9000, None, 1.0), (0, float(xy[0, 0]), float(xy[0, 1]))], "id int, x double, y double").repartition(3)
    shapes = spark.createDataFrame([*outlines().items(), (8, None)], "poly_id int, vertices array<struct<x:double,y:double>>")
    want = []
    for p, v in outlines().items():
        px, py = np.array(v).T
        want += [(i, p) for i in np.flatnonzero(inside_polygon(xy[:, 0], xy[:, 1], px, py)).tolist() if len(v) > 2]
    want += [(0, p) for i, p in want if i == 0]
    got = [(r["id"], r["poly_id"]) for r in polygons.in_polygons(points, shapes, size).collect()]
    assert sorted(got) == sorted(want)
    mask = {r["id"]: r["mask"] for r in polygons.mask_by_polygons(points, shapes, size, ["id"]).collect()}
    assert mask == {i: int(i in {a for a, _ in want}) for i in [*range(len(xy)), 9000]}


def test_tiles_inside_have_no_edges_and_few_meet_the_outline():
    px, py = np.array(outlines()[2]).T
    tiles = polygons.cover_of(px, py, 0.25)
    inner, rim = [t for t in tiles if t[4] is None], [t for t in tiles if t[4] is not None]
    assert {t[0] for t in inner} >= {0, 1, 2} and sum((0.25 * 2 ** t[0]) ** 2 for t in inner) > 0.8 * math.pi * 36
    assert max(len(t[4]) for t in rim) < 40


def test_no_polygons(spark):
    points = spark.createDataFrame([(1, 0.5, 0.5)], "id int, x double, y double")
    none = spark.createDataFrame([], "poly_id int, vertices array<struct<x:double,y:double>>")
    assert polygons.in_polygons(points, none, 1.0).collect() == []
    assert polygons.mask_by_polygons(points, none, 1.0, ["id"]).first()["mask"] == 0


def test_lakes_are_filled_to_their_level(spark):
    cells = spark.createDataFrame([(1, 1.0, 1.0, -3.0), (2, 1.0, 2.0, -70.0), (3, 1.0, 3.0, 4.0), (4, 9.0, 9.0, -5.0)], "id int, x double, y double, z double")
    lakes = spark.createDataFrame([(7, [(0.0, 0.0), (5.0, 0.0), (5.0, 5.0), (0.0, 5.0)]), (9, [(0.0, 0.0), (5.0, 0.0), (5.0, 5.0), (0.0, 5.0)])], "lake int, vertices array<struct<x:double,y:double>>")
    levels = spark.createDataFrame([(7, 2.0), (9, 100.0)], "lake int, level double")
    got = {r["id"]: (r["lake"], r["level"], r["depth"], r["z"]) for r in polygons.fill_lakes_in(cells, lakes, levels, 1.0, ["id"]).collect()}
    assert got == {1: (7, 2.0, 5.0, -3.0), 2: (7, 2.0, 50.0, -48.0), 3: (7, 2.0, 0.0, 4.0), 4: (None, -1.0, 0.0, -5.0)}
