"""Points in many polygons (J8, M14, R20): a cover of tiles at several sizes, edges only where they matter."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import written
from .joins import inside_polygon
from .resample import fill_lakes

_EDGES = "array<struct<ax: double, ay: double, bx: double, by: double>>"
#: Tiles along the longer side of a polygon's box at the coarsest size.
_COARSE = 4


def _hits(x0: np.ndarray, y0: np.ndarray, side: float, e: np.ndarray) -> np.ndarray:
    """(tiles, edges): whether an edge may touch a tile; a little generous, never the other way."""
    slack = 1e-9 * (side + np.abs(e).max(initial=0.0))
    x0, y0 = x0[:, None] - slack, y0[:, None] - slack
    x1, y1 = x0 + side + 2 * slack, y0 + side + 2 * slack
    ax, ay, bx, by = e.T
    near = (np.minimum(ax, bx) <= x1) & (np.maximum(ax, bx) >= x0) & (np.minimum(ay, by) <= y1) & (np.maximum(ay, by) >= y0)
    # the corners all lie on one side of the edge's line
    dx, dy = bx - ax, by - ay
    offset = np.stack([dx * (y - ay) - dy * (x - ax) for x in (x0, x1) for y in (y0, y1)])
    loose = slack * (np.abs(dx) + np.abs(dy))
    return near & ~((offset > loose).all(axis=0) | (offset < -loose).all(axis=0))


def cover_of(px: np.ndarray, py: np.ndarray, size: float) -> list[tuple[int, int, int, bool, np.ndarray | None]]:
    """Tiles (level, tx, ty, parity, edges) of a closed outline; a tile of level l has the side size * 2^l.

    Without edges a tile lies within (parity is true). One of the finest tiles that the outline meets
    has the edges that a ray to the right may cross, and the parity of those that every such ray from
    the tile crosses.
    """
    e = np.stack([px, py, np.roll(px, -1), np.roll(py, -1)], axis=1)
    extent = max(np.ptp(px), np.ptp(py))
    level = max(0, math.ceil(math.log2(max(extent / (_COARSE * size), 1.0))))
    side = size * 2.0**level
    xs = np.arange(math.floor(px.min() / side), math.floor(px.max() / side) + 1)
    ys = np.arange(math.floor(py.min() / side), math.floor(py.max() / side) + 1)
    todo = [(level, int(x), int(y), np.arange(len(e))) for x in xs for y in ys]
    low, high = np.minimum(e[:, 1], e[:, 3]), np.maximum(e[:, 1], e[:, 3])
    left, right = np.minimum(e[:, 0], e[:, 2]), np.maximum(e[:, 0], e[:, 2])
    out: list[tuple[int, int, int, bool, np.ndarray | None]] = []
    while todo:
        level, tx, ty, some = todo.pop()
        side = size * 2.0**level
        x0, y0 = tx * side, ty * side
        some = some[_hits(np.array([x0]), np.array([y0]), side, e[some])[0]]
        if not len(some):
            if inside_polygon(np.array([x0 + side / 2]), np.array([y0 + side / 2]), px, py)[0]:
                out.append((level, tx, ty, True, None))
        elif level:
            todo += [(level - 1, 2 * tx + i, 2 * ty + j, some) for i in (0, 1) for j in (0, 1)]
        else:
            slack = 1e-9 * (side + abs(x0) + abs(y0))
            band = (low <= y0 + side + slack) & (high >= y0 - slack) & (right >= x0 - slack)
            always = band & (low <= y0 - slack) & (high > y0 + side + slack) & (left > x0 + side + slack)
            out.append((0, tx, ty, bool(always.sum() % 2), e[band & ~always]))
    return out


def cover(polygons: DataFrame, size: float, poly_id: str = "poly_id", vertices: str = "vertices") -> DataFrame:
    """``poly_id, level, tx, ty, parity, edges``: see :func:`cover_of`. Polygons of fewer than 3 vertices have no tiles."""
    kind = polygons.schema[poly_id].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i, vs in zip(frame[poly_id], frame[vertices], strict=True):
                if vs is None or len(vs) < 3:
                    continue
                px, py = (np.array([v[c] for v in vs], float) for c in ("x", "y"))
                tiles = cover_of(px, py, size)
                for at in range(0, len(tiles), 1000):
                    part = tiles[at : at + 1000]
                    edges = [None if t[4] is None else [dict(zip(("ax", "ay", "bx", "by"), row, strict=True)) for row in t[4].tolist()] for t in part]
                    yield pd.DataFrame({poly_id: [i] * len(part), "level": [t[0] for t in part], "tx": [t[1] for t in part], "ty": [t[2] for t in part], "parity": [t[3] for t in part], "edges": edges})

    return polygons.select(poly_id, vertices).mapInPandas(run, f"`{poly_id}` {kind}, level int, tx long, ty long, parity boolean, edges {_EDGES}")


def in_polygons(points: DataFrame, polygons: DataFrame, size: float, poly_id: str = "poly_id", vertices: str = "vertices", x: str = "x", y: str = "y") -> DataFrame:
    """Each point with each polygon that it lies in, by the even-odd rule; points in none are left out.

    ``size`` is the side of the finest tiles, about the length of an edge. Points and tiles are joined by
    tile at the few levels there are; edges are tested only in tiles that an outline meets.
    """
    tiles = written(cover(polygons, size, poly_id, vertices), "cover")
    levels = [r["level"] for r in tiles.select("level").distinct().collect()]  # no more than a double has bits
    if not levels:
        return points.crossJoin(polygons.select(poly_id)).limit(0)
    spread = points.withColumn("_l", F.explode(F.array(*map(F.lit, sorted(levels)))))
    at = lambda c: F.floor(F.col(c) / (F.lit(size) * F.pow(F.lit(2.0), F.col("_l")))).cast("bigint")
    spread = spread.withColumns({"_tx": at(x), "_ty": at(y)})
    tiles = tiles.withColumnsRenamed({"level": "_l", "tx": "_tx", "ty": "_ty", "parity": "_parity", "edges": "_edges"})
    met = spread.join(tiles, ["_l", "_tx", "_ty"])

    def crosses(e: Column) -> Column:
        above = (e["ay"] > F.col(y)) != (e["by"] > F.col(y))
        return above & (F.col(x) < F.try_divide((e["bx"] - e["ax"]) * (F.col(y) - e["ay"]), e["by"] - e["ay"]) + e["ax"])

    odd = F.aggregate("_edges", F.col("_parity"), lambda a, e: a != crosses(e))
    return met.where(F.when(F.col("_edges").isNull(), F.col("_parity")).otherwise(odd)).select(*points.columns, poly_id)


def mask_by_polygons(cells: DataFrame, polygons: DataFrame, size: float, keys: list[str], into: str = "mask", x: str = "x", y: str = "y") -> DataFrame:
    """``into``: 1 for cells whose centre lies in any polygon, else 0. ``keys`` name a cell's row."""
    inside = in_polygons(cells.select(*keys, x, y), polygons, size, x=x, y=y).select(*keys).distinct().withColumn(into, F.lit(1))
    return cells.join(inside, keys, "left").withColumn(into, F.coalesce(into, F.lit(0)))


def fill_lakes_in(cells: DataFrame, lakes: DataFrame, levels: DataFrame, size: float, keys: list[str], lake: str = "lake", z: str = "z", deepest: float = 50.0) -> DataFrame:
    """Cells within lakes (polygons; of several the one of the least id) filled to their lake's level."""
    own = in_polygons(cells.select(*keys, "x", "y"), lakes, size, poly_id=lake).groupBy(*keys).agg(F.min(lake).alias(lake))
    return fill_lakes(cells.join(own, keys, "left"), levels, lake, z, deepest)
