"""Joins (J1-J16): keys, nearest time, nearest place, polygons."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import natural_key
from .blocks import ROWS, Blocks, written


def join_predictions(predictions: DataFrame, index: DataFrame, keys: list[str], row_id: str = "row_id") -> tuple[DataFrame, DataFrame]:
    """(joined, skipped): the index row of each key with the greatest row_id; predictions without one."""
    other = [c for c in index.columns if c not in keys]
    last = index.groupBy(*keys).agg(F.max_by(F.struct(*other), F.col(row_id)).alias("_r")).select(*keys, "_r.*")
    return predictions.join(last, keys), predictions.join(last.select(*keys), keys, "left_anti")


def join_static(cells: DataFrame, static: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Static layers by tile (and cell, where both have y and x); shared by all scenarios and times."""
    on = on or [c for c in ("patch_row", "patch_col", "y", "x") if c in static.columns and c in cells.columns]
    return cells.join(static, on, "left")


def align_timesteps(files: DataFrame, times: DataFrame, keys: list[str], path: str = "path", time_index: str = "time_index") -> DataFrame:
    """Files in natural order joined with times in order, by place; the longer list is cut."""
    f = files.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(natural_key(path), path)))
    t = times.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(time_index)))
    return f.join(t, [*keys, "_n"]).drop("_n")


def nearest_time(series: DataFrame, targets: DataFrame, by: list[str], ts: str = "ts", value: str = "value", rows: int = ROWS) -> DataFrame:
    """Each target with the value of the nearest time of its series; of two, the earlier one.

    Of several values of one time the least counts. Targets stay as often as they come, without a
    value where their series has none; those without a time are left out. The samples before and
    after a target are running last values, so that the work is that of sorting, and series of more
    than ``rows`` rows (samples and targets) are cut into blocks.
    """
    sample = F.struct(F.col(ts).alias("t"), F.col(value).alias("v"))
    samples = series.where(F.col(ts).isNotNull()).groupBy(*by, ts).agg(F.min(value).alias(value)).select(*by, F.unix_micros(ts).alias("_u"), F.lit(0).alias("_ask"), sample.alias("_s"), F.lit(None).cast("timestamp").alias("_q"))
    asks = targets.where(F.col(ts).isNotNull()).select(*by, F.unix_micros(ts).alias("_u"), F.lit(1).alias("_ask"), F.lit(None).cast(samples.schema["_s"].dataType).alias("_s"), F.col(ts).cast("timestamp").alias("_q"))
    blocks = Blocks(samples.unionByName(asks), by, "_u", rows)
    both = blocks.running({"_b": ("_s", False), "_a": ("_s", True)}, "last", ties=(F.col("_ask"),)).where("_ask = 1")
    back, ahead = F.col("_u") - F.unix_micros("_b.t"), F.unix_micros("_a.t") - F.col("_u")
    pick = F.when(F.col("_a").isNull() | (back <= ahead), F.col("_b")).otherwise(F.col("_a"))
    return both.withColumn("_p", pick).select(*by, F.col("_q").alias(ts), F.col("_p.t").alias("nearest_ts"), F.col("_p.v").alias(value))


def snap_coarse_window(tiles: DataFrame, x0: float, y0: float, dx: float, nx: int, ny: int, pc: int, mode: str = "center") -> DataFrame:
    """Adds ci and cj, the first coarse column and row of the window of ``pc`` cells over a fine tile.

    The coarse axis is regular: cell i has its centre at x0 + i * dx. ``center``: the coarse cell
    nearest to the tile's middle (the lower of two), minus (pc / 2 - 0.5), rounded half to even;
    ``ll``: the cell nearest to its lower left cell. Both are clamped. ``tiles``: x_min, x_max,
    y_min, y_max.
    """
    def near(v: Column, start: float, n: int) -> Column:
        return F.greatest(F.least(F.ceil((v - start) / dx - 0.5), F.lit(n - 1)), F.lit(0))
    def first(low: str, high: str, start: float, n: int) -> Column:
        if mode == "ll":
            at = near(F.col(low), start, n)
        else:
            at = F.bround(near((F.col(low) + F.col(high)) / 2, start, n) - (pc / 2 - 0.5), 0)
        return F.greatest(F.least(at, F.lit(n - pc)), F.lit(0)).cast("int")
    return tiles.withColumns({"ci": first("x_min", "x_max", x0, nx), "cj": first("y_min", "y_max", y0, ny)})


def place_on_canvas(static: DataFrame, dx_cells: float, dy_cells: float, h: int, w: int) -> DataFrame:
    """Static cells on a canvas whose origin is (dx, dy) static cells away: shifted by whole cells, else
    each canvas cell takes the nearest static one. Uncovered cells are NULL."""
    canvas = static.sparkSession.range(h * w).select(F.floor(F.col("id") / w).cast("int").alias("y"), (F.col("id") % w).cast("int").alias("x"))
    near = lambda c, d: F.ceil(F.col(c) + d - 0.5).cast("int")  # noqa: E731  whole shifts are exact
    asked = canvas.withColumns({"_y": near("y", dy_cells), "_x": near("x", dx_cells)})
    return asked.join(static.withColumnsRenamed({"y": "_y", "x": "_x"}), ["_y", "_x"], "left").drop("_y", "_x")


def nearest_on_axis(canvas: list[float], static: list[float]) -> list[int | None]:
    """For each coordinate of a canvas's axis the index of the nearest static one (the lower of two); None outside.

    Both axes may rise or fall, and need not be regular.
    """
    order = np.argsort(static)
    known, asked = np.asarray(static, float)[order], np.asarray(canvas, float)
    slack = 1e-9 * np.abs(np.diff(known)).mean() if len(known) > 1 else 0.0
    right = np.clip(np.searchsorted(known, asked), 1, max(len(known) - 1, 1))
    near = np.where(len(known) > 1, right - (asked - known[right - 1] <= known[np.minimum(right, len(known) - 1)] - asked + slack), 0)
    inside = (asked >= known[0] - slack) & (asked <= known[-1] + slack)
    return [int(order[i]) if ok else None for i, ok in zip(near, inside, strict=True)]


def place_on_axes(static: DataFrame, x_canvas: list[float], y_canvas: list[float], x_static: list[float], y_static: list[float]) -> DataFrame:
    """Static cells (y, x by index) on the canvas of two coordinate axes: each canvas cell takes the static
    one that is nearest along both, which is a shift where the axes are whole cells apart. Cells
    outside of the static grid are NULL."""
    spark = static.sparkSession
    def axis(name: str, canvas: list[float], known: list[float]) -> DataFrame:
        return spark.createDataFrame(list(enumerate(nearest_on_axis(canvas, known))), f"{name} int, _{name} int")
    asked = axis("y", y_canvas, y_static).crossJoin(axis("x", x_canvas, x_static))  # the canvas's cells
    return asked.join(static.withColumnsRenamed({"y": "_y", "x": "_x"}), ["_y", "_x"], "left").drop("_y", "_x")


#: Bits of a place's coordinate in the tree of cells, and of one level: a cell has up to 16 children.
_BITS, _STEP = 24, 2


def cell_tree(places: DataFrame, side: float, left: float, low: float, most: int) -> tuple[DataFrame, int]:
    """(cells, depth) of the places (_px, _py): ``_l``, ``_cx``, ``_cy``, their number ``_n``, and whether ``_inner``.

    A cell of more than ``most`` places has children, down to cells of side / 2^24; so cells are small
    where places are dense, and all others hold ``most`` at most. There are about 16 cells for each
    ``most`` places.
    """
    levels = F.explode(F.sequence(F.lit(0), F.lit(_BITS // _STEP)))
    at = lambda v, start: F.least(F.floor((F.col(v) - start) / side * (1 << _BITS)), F.lit((1 << _BITS) - 1)).cast("int")
    spread = places.select(at("_px", left).alias("_x"), at("_py", low).alias("_y")).groupBy("_x", "_y").agg(F.count("*").alias("_n"))
    every = spread.withColumn("_l", levels).withColumn("_s", _BITS - _STEP * F.col("_l"))
    counts = every.groupBy("_l", F.expr("shiftright(_x, _s)").alias("_cx"), F.expr("shiftright(_y, _s)").alias("_cy")).agg(F.sum("_n").alias("_n"))
    inner = (F.col("_n") > most) & (F.col("_l") < _BITS // _STEP)
    counts = counts.withColumn("_inner", inner)
    above = counts.where("_inner").select((F.col("_l") + 1).alias("_l"), F.col("_cx").alias("_ux"), F.col("_cy").alias("_uy"))
    below = counts.where("_l > 0").withColumns({"_ux": F.shiftright("_cx", _STEP), "_uy": F.shiftright("_cy", _STEP)})
    cells = written(counts.where("_l = 0").unionByName(below.join(above, ["_l", "_ux", "_uy"], "left_semi").drop("_ux", "_uy")), "cells")
    return cells, cells.agg(F.max("_l")).first()[0]


def nearest_k(points: DataFrame, places: DataFrame, k: int, point_id: str, place_id: str, x: str = "x", y: str = "y", most: int | None = None) -> DataFrame:
    """The k nearest places of each point with ``distance`` and ``rank``; ties by place_id.

    A tree of cells follows the places' density (:func:`cell_tree`). From its root down each point keeps
    the cells that may hold one of its k nearest places: those that begin no further away than where
    the nearest cells that hold k places together end. Only at the end does it meet places, those of
    the leaves left, at most ``most`` a leaf; the k best of each task go on. Of places at one spot only
    the k least ids can count. Points and places without coordinates are left out.
    """
    most = most or max(64, 2 * k)
    near = places.select(F.col(place_id).alias("_id"), F.col(x).cast("double").alias("_px"), F.col(y).cast("double").alias("_py")).where("_px IS NOT NULL AND _py IS NOT NULL")
    near = near.withColumn("_r", F.row_number().over(Window.partitionBy("_px", "_py").orderBy("_id"))).where(F.col("_r") <= k).drop("_r")
    ends = near.agg(F.min("_px"), F.max("_px"), F.min("_py"), F.max("_py")).first()
    asked = points.select(point_id, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).where("_x IS NOT NULL AND _y IS NOT NULL").distinct()
    if ends[0] is None:
        return points.select(point_id).limit(0).crossJoin(places.select(place_id, F.lit(0.0).alias("distance"), F.lit(1).alias("rank")).limit(0))
    left, low = ends[0], ends[2]
    side = max(ends[1] - left, ends[3] - low) * (1 + 1e-9) or 1.0
    cells, depth = cell_tree(near, side, left, low, most)
    size = F.lit(side) / F.expr(f"shiftleft(1L, {_STEP} * _l)")
    slack = 1e-12 * (abs(left) + abs(low) + side)  # of places at a cell's edge
    box = {"_x0": left + F.col("_cx") * size - slack, "_y0": low + F.col("_cy") * size - slack, "_w": size + 2 * slack}
    cells = cells.withColumns(box)

    def reach(least: bool) -> Column:
        def axis(p: str, c: str) -> Column:
            before, behind = F.col(c) - F.col(p), F.col(p) - F.col(c) - F.col("_w")
            return F.greatest(before, behind, F.lit(0.0)) if least else F.greatest(before + F.col("_w"), F.col(p) - F.col(c))
        return F.hypot(axis("_x", "_x0"), axis("_y", "_y0"))

    own = [point_id, "_x", "_y"]
    front = asked.crossJoin(cells.where("_l = 0"))  # the root
    for level in range(depth):
        here = (F.col("_l") == level) & F.col("_inner")
        children = cells.where(F.col("_l") == level + 1).withColumns({"_ux": F.shiftright("_cx", _STEP), "_uy": F.shiftright("_cy", _STEP)})
        opened = front.where(here).select(*own, F.col("_cx").alias("_ux"), F.col("_cy").alias("_uy")).join(children, ["_ux", "_uy"]).drop("_ux", "_uy")
        front = front.where(~here).select(*own, *cells.columns).unionByName(opened).withColumns({"_near": reach(True), "_far": reach(False)})
        held = F.sum("_n").over(Window.partitionBy(point_id, "_x", "_y").orderBy("_far"))
        front = front.withColumn("_held", held).withColumn("_end", F.min(F.when(F.col("_held") >= k, F.col("_far"))).over(Window.partitionBy(point_id, "_x", "_y")))
        front = front.where(F.col("_end").isNull() | (F.col("_near") <= F.col("_end"))).select(*own, *cells.columns)
        if level % 4 == 3:  # so that the plan stays short
            front = written(front, "front")
    at = lambda v, start: F.least(F.floor((F.col(v) - start) / side * (1 << _BITS)), F.lit((1 << _BITS) - 1)).cast("int")
    leaves = cells.where("NOT _inner").select("_l", "_cx", "_cy")
    levels = F.explode(F.sequence(F.lit(0), F.lit(depth)))
    dealt = near.withColumns({"_ix": at("_px", left), "_iy": at("_py", low)}).withColumn("_l", levels)
    shift = f"{_BITS} - {_STEP} * _l"
    dealt = dealt.select("_id", "_px", "_py", "_l", F.expr(f"shiftright(_ix, {shift})").alias("_cx"), F.expr(f"shiftright(_iy, {shift})").alias("_cy")).join(leaves, ["_l", "_cx", "_cy"], "left_semi")
    met = front.select(*own, "_l", "_cx", "_cy").join(dealt, ["_l", "_cx", "_cy"])
    met = met.select(point_id, F.col("_id").alias(place_id), F.sqrt(F.pow(F.col("_x") - F.col("_px"), 2) + F.pow(F.col("_y") - F.col("_py"), 2)).alias("distance"))
    # Spark keeps the k best of each task before it shuffles
    rank = F.row_number().over(Window.partitionBy(point_id).orderBy("distance", place_id))
    return met.withColumn("rank", rank).where(F.col("rank") <= k)


def nearest_reach(points: DataFrame, reaches: DataFrame, k: int = 20, point_id: str = "point_id", reach_id: str = "reach_id", area: str = "uparea") -> DataFrame:
    """Of the k nearest reaches of a point, that with the largest upstream area (then the nearest)."""
    near = nearest_k(points, reaches, k, point_id, reach_id).join(reaches.select(reach_id, area), reach_id)
    return near.groupBy(point_id).agg(F.max_by(reach_id, F.struct(F.col(area), -F.col("rank"))).alias(reach_id), F.max(area).alias(area))


def nearest_node(grid: DataFrame, nodes: DataFrame, point_id: str, node_id: str, bbox: tuple | None = None) -> DataFrame:
    """Nearest node of each grid point, among those in ``bbox`` (xmin, xmax, ymin, ymax)."""
    if bbox:
        nodes = nodes.where(F.col("x").between(*bbox[:2]) & F.col("y").between(*bbox[2:]))
    return nearest_k(grid, nodes, 1, point_id, node_id).drop("rank")


def inside_polygon(x: np.ndarray, y: np.ndarray, px: np.ndarray, py: np.ndarray) -> np.ndarray:
    """Even-odd rule for points against one closed outline; vectorised over the points."""
    qx, qy = np.roll(px, -1), np.roll(py, -1)
    out = np.zeros(len(x), bool)
    for ax, ay, bx, by in zip(px, py, qx, qy, strict=True):
        if ay != by:
            crosses = (ay > y) != (by > y)
            out ^= crosses & (x < (bx - ax) * (y - ay) / (by - ay) + ax)
    return out


def cells_in_polygon(cells: DataFrame, vertices: list[tuple[float, float]], into: str = "inside", x: str = "x", y: str = "y") -> DataFrame:
    """``into``: whether a cell's centre lies in the polygon; centres out of its box are not tested."""
    px, py = (np.array(v, float) for v in zip(*vertices, strict=True))

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            cx, cy = (batch.column(names.index(c)).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in (x, y))
            hit = (cx >= px.min()) & (cx <= px.max()) & (cy >= py.min()) & (cy <= py.max())
            hit[hit] = inside_polygon(cx[hit], cy[hit], px, py)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hit)], names=[*names, into])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in cells.schema), f"`{into}` boolean"])
    return cells.mapInArrow(test, schema)


def polygons_in_region(polygons: DataFrame, region: tuple[float, float, float, float], poly_id: str = "poly_id", vertices: str = "vertices") -> DataFrame:
    """Polygons that meet the box (xmin, xmax, ymin, ymax): a corner inside, an edge across, or the box within."""
    xmin, xmax, ymin, ymax = region
    v = F.col(vertices)
    axis = {"x": F.transform(v, lambda p: p["x"]), "y": F.transform(v, lambda p: p["y"])}
    ends = {f"_{f.__name__}{k}": f(axis[k]) for k in axis for f in (F.array_min, F.array_max)}
    near = polygons.withColumns(ends).where(
        (F.col("_array_maxx") >= xmin) & (F.col("_array_minx") <= xmax) & (F.col("_array_maxy") >= ymin) & (F.col("_array_miny") <= ymax)
    )
    n = F.size(v)
    edges = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get(v, i).alias("a"), F.get(v, (i + 1) % n).alias("b")))

    def meets(e: Column) -> Column:
        """Liang-Barsky: whether the segment has a part in the box."""
        ax, ay, dx, dy = e["a"]["x"], e["a"]["y"], e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]
        low, high, ok = F.lit(0.0), F.lit(1.0), F.lit(True)
        for p, q in ((-dx, ax - xmin), (dx, xmax - ax), (-dy, ay - ymin), (dy, ymax - ay)):
            r = F.try_divide(q, p)
            ok &= ~((p == 0) & (q < 0))
            low = F.when(p < 0, F.greatest(low, r)).otherwise(low)
            high = F.when(p > 0, F.least(high, r)).otherwise(high)
        return ok & (low <= high)

    cx, cy = (xmin + xmax) / 2, (ymin + ymax) / 2
    def crosses(e: Column) -> Column:
        ax, ay, bx, by = e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"]
        return ((ay > cy) != (by > cy)) & (F.lit(cx) < F.try_divide((bx - ax) * (cy - ay), by - ay) + ax)
    around = F.size(F.filter(edges, crosses)) % 2 == 1
    return near.where(F.exists(edges, meets) | around).select(*polygons.columns)


def sample_at_points(cells: DataFrame, points: DataFrame, x0: float, y0: float, dx: float, keys: list[str] | None = None) -> DataFrame:
    """Cells (grid places y, x) nearest to points (px, py): all rows of the cell, so a series where there are times."""
    near = lambda c, start: F.floor((F.col(c) - start) / dx + 0.5).cast("int")
    return points.withColumns({"x": near("px", x0), "y": near("py", y0)}).join(cells, [*(keys or []), "y", "x"])


def pair_manifests(low: DataFrame, truth: DataFrame, template: str = "{}", path: str = "path") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs, only low, only truth) of files whose base name of ``low`` is ``template`` of that of ``truth``."""
    base = F.regexp_extract(F.col(path), r"([^/]+?)(?:\.[^./]*)?$", 1)
    left, right = template.split("{}", 1)
    a = low.select(F.col(path).alias("lq_path"), base.alias("name"))
    b = truth.select(F.col(path).alias("gt_path"), F.concat(F.lit(left), base, F.lit(right)).alias("name"))
    return a.join(b, "name"), a.join(b, "name", "left_anti"), b.join(a, "name", "left_anti")


def find_reach_file(listing: DataFrame, wanted: DataFrame, order: str = "position", reach: str = "reach_id") -> DataFrame:
    """The first file, in listing order, that holds each reach; ``listing``: file, position, reach_ids."""
    one = listing.withColumn(reach, F.explode("reach_ids")).groupBy(reach).agg(F.min_by("file", order).alias("file"))
    return wanted.select(reach).distinct().join(one, reach, "left")


def pair_velocity_depth(index: DataFrame, threshold: float = 0.05) -> DataFrame:
    """Velocity patches (u, v) with the depth patch of the same place and time, and its wet mask."""
    keys = ["scenario", "t", "patch_row", "patch_col"]
    depth = index.where(F.lower("var") == "h").select(*keys, F.col("values").alias("h_values"))
    out = index.where(F.lower("var").isin("u", "v")).join(depth, keys, "left")
    return out.withColumn("wet_mask", F.transform("h_values", lambda v: F.coalesce(v >= threshold, F.lit(False)).cast("int")))


def frame_neighbours(sequence: DataFrame, n: int, padding: str, index: str = "frame", last: str = "max_frame") -> DataFrame:
    """The n (odd) frames around each: ``slot`` and ``neighbour``, padded at the ends.

    A place that is ``over`` frames beyond an end (negative at the first one) is moved back by as
    much (replicate), by twice as much (reflection), by the window's length (circle), or to the
    same distance beyond the window's other end (reflection_circle).
    """
    half = n // 2
    out = sequence.withColumn("_o", F.explode(F.sequence(F.lit(-half), F.lit(half))))
    frame, at = F.col(index), F.col(index) + F.col("_o")
    over = at - F.greatest(F.least(at, F.col(last)), F.lit(0))
    side = F.signum(over.cast("double")).cast("int")
    moved = {"replicate": at - over, "reflection": at - over * 2, "circle": at - side * n, "reflection_circle": frame - side * half - over}
    if n % 2 == 0 or padding not in moved:
        raise ValueError("n must be odd and padding a known one")
    return out.withColumns({"slot": F.col("_o") + half, "neighbour": F.when(over == 0, at).otherwise(moved[padding])}).drop("_o")


def resample_outline(polygons: DataFrame, step: float, poly_id: str = "poly_id", vertices: str = "vertices") -> DataFrame:
    """Points (px, py) every ``step`` along each closed outline, numbered by ``point``."""
    v, n = F.col(vertices), F.size(vertices)
    edges = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("i"), F.get(v, i).alias("a"), F.get(v, (i + 1) % n).alias("b")))
    out = polygons.select(poly_id, F.explode(edges).alias("e"))
    dx, dy = F.col("e.b.x") - F.col("e.a.x"), F.col("e.b.y") - F.col("e.a.y")
    out = out.withColumn("_n", F.greatest(F.ceil(F.sqrt(dx * dx + dy * dy) / step), F.lit(1)).cast("int"))
    out = out.withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    share = F.col("_k") / F.col("_n")
    out = out.select(poly_id, F.col("e.i").alias("_i"), "_k", (F.col("e.a.x") + dx * share).alias("px"), (F.col("e.a.y") + dy * share).alias("py"))
    return out.withColumn("point", F.row_number().over(Window.partitionBy(poly_id).orderBy("_i", "_k")) - 1).drop("_i", "_k")


def open_boundary_points(polygons: DataFrame, dem: DataFrame, x0: float, y0: float, dx: float, step: float = 100.0, below: float = -1.0, poly_id: str = "poly_id", z: str = "z") -> DataFrame:
    """Outline points with a bed below ``below``, up to the first point without a bed."""
    points = resample_outline(polygons, step, poly_id)
    near = lambda c, start: F.floor((F.col(c) - start) / dx + 0.5).cast("int")
    sampled = points.withColumns({"x": near("px", x0), "y": near("py", y0)}).join(dem, ["y", "x"], "left")
    gone = F.max(F.col(z).isNull()).over(Window.partitionBy(poly_id).orderBy("point").rowsBetween(Window.unboundedPreceding, 0))
    return sampled.withColumn("_gone", gone).where(~F.col("_gone") & (F.col(z) < below)).select(poly_id, "point", "px", "py", z)
