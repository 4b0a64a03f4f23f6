"""Resampling, stencils and raster assembly (R6-R21) over the cell form (keys..., y, x, value)."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _div(c: str, s: int) -> Column:
    return F.floor(F.col(c) / F.lit(s)).cast("int")


def block_mean(cells: DataFrame, keys: list[str], s: int, value: str = "value") -> DataFrame:
    """Mean of each s x s block, without missing cells; a block without any is NULL."""
    return cells.groupBy(*keys, _div("y", s).alias("y"), _div("x", s).alias("x")).agg(F.avg(value).alias(value))


def block_max_mask(cells: DataFrame, keys: list[str], s: int, mask: str = "mask") -> DataFrame:
    """Maximum of each block; every block must be whole (its ``n`` is s * s), which ``whole`` says."""
    out = cells.groupBy(*keys, _div("y", s).alias("y"), _div("x", s).alias("x")).agg(F.max(mask).alias(mask), F.count("*").alias("n"))
    return out.withColumn("whole", F.col("n") == s * s).drop("n")


def upsample_nearest(cells: DataFrame, s: int) -> DataFrame:
    """Each cell s x s times; no shuffle."""
    i = F.explode(F.sequence(F.lit(0), F.lit(s * s - 1)))
    out = cells.withColumn("_i", i)
    return out.withColumns({"y": (F.col("y") * s + F.floor(F.col("_i") / s)).cast("int"), "x": (F.col("x") * s + F.col("_i") % s).cast("int")}).drop("_i")


def upsample_bilinear(cells: DataFrame, keys: list[str], s: int, h: int, w: int, value: str = "value") -> DataFrame:
    """Half-pixel centres, edges clamped: each coarse cell sends its weighted share to the fine cells around it.

    ``h`` and ``w`` are the coarse shape. A fine cell with a missing neighbour is NULL.
    """
    def shares(c: str, n: int) -> Column:
        """Fine places to which coarse place c gives weight, with the weight."""
        at = F.col(c)
        fine = F.sequence(F.greatest(at * s - s, F.lit(0)), F.least(at * s + 2 * s - 1, F.lit(n * s - 1)))
        def share(f: Column) -> Column:
            src = F.greatest((f + 0.5) / s - 0.5, F.lit(0.0))
            low = F.least(F.floor(src), F.lit(n - 1))
            part = src - low
            high = F.least(low + 1, F.lit(n - 1))
            weight = F.when(low == at, 1 - part).otherwise(0.0) + F.when(high == at, part).otherwise(0.0)
            return F.struct(f.cast("int").alias("f"), weight.alias("w"))
        return F.filter(F.transform(fine, share), lambda p: p["w"] > 0)

    spread = cells.withColumn("_y", F.explode(shares("y", h))).withColumn("_x", F.explode(shares("x", w)))
    weight = F.col("_y.w") * F.col("_x.w")
    out = spread.groupBy(*keys, F.col("_y.f").alias("y"), F.col("_x.f").alias("x")).agg(
        F.sum(F.col(value) * weight).alias(value), F.sum(F.when(F.col(value).isNotNull(), weight)).alias("_w")
    )
    return out.withColumn(value, F.when(F.col("_w") > 1 - 1e-9, F.col(value))).drop("_w")


def mosaic(cells: DataFrame, patch: int) -> DataFrame:
    """Map coordinates map_y, map_x of patch cells; no shuffle."""
    return cells.withColumns({"map_y": F.col("patch_row") * patch + F.col("y"), "map_x": F.col("patch_col") * patch + F.col("x")})


def mosaic_full(cells: DataFrame, keys: list[str], patch: int, rows: int, cols: int, value: str = "value") -> DataFrame:
    """The whole map of each key: cells of missing tiles are NULL with mask 0."""
    placed = mosaic(cells, patch).select(*keys, "map_y", "map_x", value, F.lit(1).alias("mask"))
    grid = cells.select(*keys).distinct().withColumn("map_y", F.explode(F.sequence(F.lit(0), F.lit(rows * patch - 1)))).withColumn("map_x", F.explode(F.sequence(F.lit(0), F.lit(cols * patch - 1))))
    return grid.join(placed, [*keys, "map_y", "map_x"], "left").withColumn("mask", F.coalesce("mask", F.lit(0)))


def shift_grid(cells: DataFrame, dy: int, dx: int, h: int, w: int) -> DataFrame:
    """Cells moved by (dy, dx); what leaves the grid is dropped, what is uncovered has no row."""
    out = cells.withColumns({"y": F.col("y") + dy, "x": F.col("x") + dx})
    return out.where(F.col("y").between(0, h - 1) & F.col("x").between(0, w - 1))


def gradient(cells: DataFrame, keys: list[str], value: str = "value", dx: float = 1.0) -> DataFrame:
    """Adds gy and gx: central differences, one-sided at the edges; windows of one row or column each."""
    def along(a: str, b: str) -> Column:
        win = Window.partitionBy(*keys, a).orderBy(b)
        before, after = F.lag(value).over(win), F.lead(value).over(win)
        v = F.col(value)
        first, last = F.lag(F.lit(1)).over(win).isNull(), F.lead(F.lit(1)).over(win).isNull()
        return F.when(first & last, F.lit(0.0)).when(first, (after - v) / dx).when(last, (v - before) / dx).otherwise((after - before) / (2 * dx))
    return cells.withColumns({"gy": along("x", "y"), "gx": along("y", "x")})


def light(azimuth: float, altitude: float) -> tuple[float, float, float]:
    """The direction to a light, along x, y (which grows southwards) and upwards; angles in degrees."""
    az, alt = math.radians(azimuth), math.radians(altitude)
    return math.cos(alt) * math.sin(az), -math.cos(alt) * math.cos(az), math.sin(alt)


def hillshade(cells: DataFrame, keys: list[str], azimuth: float = 315.0, altitude: float = 45.0, value: str = "value", dx: float = 1.0) -> DataFrame:
    """Shade in [0, 1] of the surface, lit from ``azimuth`` (degrees) at ``altitude``: the cosine of the
    angle between the light and the surface's normal (-gx, -gy, 1), from [-1, 1] to [0, 1]."""
    out = gradient(cells, keys, value, dx)
    east, south, up = light(azimuth, altitude)
    gx, gy = F.col("gx"), F.col("gy")
    cosine = (F.lit(up) - gx * east - gy * south) / F.sqrt(gx * gx + gy * gy + 1)
    return out.withColumn("shade", F.least(F.greatest((cosine + 1) / 2, F.lit(0.0)), F.lit(1.0)))


def decision(seed: int, what: str, row_id: Column) -> Column:
    """A fair coin of the seed, the question and the row."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(what), row_id.cast("string"))), 1, 1), 16, 10).cast("int") >= 8


def augment(cells: DataFrame, size: int, seed: int, row_id: str = "row_id", hflip: bool = True, rotate: bool = True) -> DataFrame:
    """Flips and rotations of square patches, the same for all layers of a row.

    Columns, where present: value, u, v, aspect_sin, aspect_cos. A horizontal flip negates u and
    aspect_sin, a vertical one v and aspect_cos. A quarter turn, which comes last, is against the
    clock: cell (y, x) goes to (size - 1 - x, y), and aspect (sin, cos) becomes (-cos, sin). Patches
    with velocities (u, v) are not turned.
    """
    cols = set(cells.columns)
    r = F.col(row_id)
    fh, fv = (decision(seed, k, r) if hflip or k == "v" and rotate else F.lit(False) for k in ("h", "v"))
    turn = decision(seed, "r", r) if rotate and not {"u", "v"} & cols else F.lit(False)
    x = F.when(fh, size - 1 - F.col("x")).otherwise(F.col("x"))
    y = F.when(fv, size - 1 - F.col("y")).otherwise(F.col("y"))
    sign = {"u": fh, "aspect_sin": fh, "v": fv, "aspect_cos": fv}
    out = cells.withColumns({"y": y, "x": x} | {c: F.when(f, -F.col(c)).otherwise(F.col(c)) for c, f in sign.items() if c in cols})
    moved = {"y": F.when(turn, size - 1 - F.col("x")).otherwise(F.col("y")), "x": F.when(turn, F.col("y")).otherwise(F.col("x"))}
    if {"aspect_sin", "aspect_cos"} <= cols:
        moved |= {"aspect_sin": F.when(turn, -F.col("aspect_cos")).otherwise(F.col("aspect_sin")), "aspect_cos": F.when(turn, F.col("aspect_sin")).otherwise(F.col("aspect_cos"))}
    return out.withColumns(moved)


def paired_crop(coarse: DataFrame, fine: DataFrame, size: int, scale: int, full: int, seed: int, row_id: str = "row_id") -> tuple[DataFrame, DataFrame]:
    """The same random window of both grids; the fine one's offset and size are ``scale`` times the coarse one's."""
    def offset(what: str) -> Column:
        h = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(what), F.col(row_id).cast("string"))), 1, 8), 16, 10).cast("bigint")
        return (h % (full - size + 1)).cast("int")
    def cut(d: DataFrame, k: int) -> DataFrame:
        out = d.withColumns({"y": F.col("y") - offset("y") * k, "x": F.col("x") - offset("x") * k})
        return out.where(F.col("y").between(0, size * k - 1) & F.col("x").between(0, size * k - 1))
    return cut(coarse, 1), cut(fine, scale)


def mod_crop(cells: DataFrame, h: int, w: int, scale: int) -> DataFrame:
    """Shape cut down to multiples of ``scale``."""
    return cells.where((F.col("y") < h - h % scale) & (F.col("x") < w - w % scale))


def crop_border(cells: DataFrame, h: int, w: int, border: int) -> DataFrame:
    out = cells.where(F.col("y").between(border, h - border - 1) & F.col("x").between(border, w - border - 1))
    return out.withColumns({"y": F.col("y") - border, "x": F.col("x") - border})


def collapse_inject(levels: DataFrame, keys: list[str], top: int, value: str = "value") -> DataFrame:
    """Every level from its own cells, else from the parent's: cells (keys, level, i, j) from coarse to fine.

    i and j count from 1; the parent of (i, j) is (ceil(i/2), ceil(j/2)) one level below. Rows of
    all levels up to ``top`` are returned. One join per level, on the parent's place.
    """
    done = levels.where(F.col("level") == F.lit(0)).select(*keys, "level", "i", "j", value)
    out = [done]
    for level in range(1, top + 1):
        own = levels.where(F.col("level") == level).select(*keys, "i", "j", F.col(value).alias("_own"))
        child = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (1, 0) for b in (1, 0)]))
        sent = done.withColumn("_c", child).select(*keys, (F.col("i") * 2 - F.col("_c.a")).alias("i"), (F.col("j") * 2 - F.col("_c.b")).alias("j"), F.col(value).alias("_up"))
        done = sent.join(own, [*keys, "i", "j"], "full").select(*keys, F.lit(level).alias("level"), "i", "j", F.coalesce("_own", "_up").alias(value))
        out.append(done)
    return reduce(DataFrame.unionByName, out)


def collapse_average(levels: DataFrame, keys: list[str], top: int, value: str = "value") -> DataFrame:
    """Every level from its own cells, else from the mean of its four children, from fine to coarse.

    A missing child leaves the parent missing.
    """
    done = levels.where(F.col("level") == top).select(*keys, "level", "i", "j", value)
    out = [done]
    for level in range(top - 1, -1, -1):
        up = done.groupBy(*keys, F.ceil(F.col("i") / 2).cast("int").alias("i"), F.ceil(F.col("j") / 2).cast("int").alias("j"))
        mean = up.agg(F.when(F.count(value) == 4, F.avg(value)).alias("_mean"))
        own = levels.where(F.col("level") == level).select(*keys, "i", "j", F.col(value).alias("_own"))
        done = own.join(mean, [*keys, "i", "j"], "full").select(*keys, F.lit(level).alias("level"), "i", "j", F.coalesce("_own", "_mean").alias(value))
        out.append(done)
    return reduce(DataFrame.unionByName, out)


def volume_average(cells: DataFrame, keys: list[str], value: str, depth: str) -> DataFrame:
    """Depth-weighted mean of each 2 x 2 block; NULL where it is dry."""
    g = cells.groupBy(*keys, _div("y", 2).alias("y"), _div("x", 2).alias("x"))
    return g.agg(F.try_divide(F.sum(F.col(value) * F.col(depth)), F.sum(depth)).alias(value), F.avg(depth).alias(depth))


def refine_target(cells: DataFrame, bed: str = "bed", fine_bed: str = "fine_bed", depth: str = "depth", slope: str = "slope") -> DataFrame:
    """``level``: 3 where the relative bed error is over .3, depth over .1, bed over .7 and slope under .2; else 0."""
    error = F.abs(F.try_divide(F.col(bed) - F.col(fine_bed), F.col(bed)))
    hit = (error > 0.3) & (F.col(depth) > 0.1) & (F.col(bed) > 0.7) & (F.col(slope) < 0.2)
    return cells.withColumn("level", F.when(hit, 3).otherwise(0))


def lake_levels(outline: DataFrame, lake: str = "lake", z: str = "z") -> DataFrame:
    """Most frequent bed level, to a decimal, on each lake's outline; the lowest of several."""
    counts = outline.where(F.col(z).isNotNull()).groupBy(lake, F.round(F.col(z), 1).alias("level")).agg(F.count("*").alias("n"))
    return counts.groupBy(lake).agg(F.max_by("level", F.struct("n", -F.col("level"))).alias("level"))


def fill_lakes(cells: DataFrame, levels: DataFrame, lake: str = "lake", z: str = "z", deepest: float = 50.0) -> DataFrame:
    """Lake cells get their level and a depth of at most ``deepest`` (the bed is raised); others level -1, depth 0."""
    out = cells.join(levels.select(lake, F.col("level").alias("_level")), lake, "left")
    depth = F.greatest(F.col("_level") - F.col(z), F.lit(0.0))
    inside = F.col("_level").isNotNull()
    return out.withColumns(
        {
            "level": F.when(inside, F.col("_level")).otherwise(F.lit(-1.0)), "depth": F.when(inside, F.least(depth, F.lit(deepest))).otherwise(F.lit(0.0)),
            z: F.when(inside & (depth > deepest), F.col(z) + depth - deepest).otherwise(F.col(z)),
        }
    ).drop("_level")


#: BT.601 rows for values in [0, 1] (fixed values): y, cb, cr from r, g, b, with their offsets.
YCBCR = {"luma": (65.481, 128.553, 24.966, 16.0), "cb": (-37.797, -74.203, 112.0, 128.0), "cr": (112.0, -93.786, -18.214, 128.0)}


def rgb_ycbcr(df: DataFrame, channels: tuple[str, ...] = ("luma", "cb", "cr")) -> DataFrame:
    """Adds BT.601 channels of columns r, g, b in [0, 1]."""
    def of(k: tuple) -> Column:
        return F.col("r") * k[0] + F.col("g") * k[1] + F.col("b") * k[2] + k[3]
    return df.withColumns({c: of(YCBCR[c]) for c in channels})


def rgb_to_y(df: DataFrame) -> DataFrame:
    return rgb_ycbcr(df, ("luma",))
