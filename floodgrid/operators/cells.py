"""Cell-wise cleaning, masks and selections (M), and the cell and patch forms.

Cell form: one row per pixel (key..., y, x, value). Patch form: one row per patch with ``h``, ``w``
and a row-major ``values`` array. Work inside a patch keeps the patch form; cells are exploded only
where patches meet, and are aggregated by patch before any shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PATCH = ["scenario", "var", "t", "patch_row", "patch_col"]


def mask_fill(df: DataFrame, col: str, fill: float | None = None, limit: float = 1e30) -> DataFrame:
    """NULL for NaN, infinities, values of magnitude ``limit`` or more, and about +-``fill``."""
    c = F.col(col).cast("double")
    good = F.abs(c) < F.lit(limit)
    if fill is not None:
        near = 1e-8 + 1e-5 * abs(fill)
        good &= (F.abs(c - F.lit(float(fill))) > near) & (F.abs(c + F.lit(float(fill))) > near)
    return df.withColumn(col, F.when(~F.isnan(c) & good, c))


def active_patches(index: DataFrame, var: str) -> DataFrame:
    return index.where((F.col("filtered_out") == 0) & (F.lower("var") == var.lower()))


def select_patch(index: DataFrame, scenario: str, var: str, timestep: str | int, row: int, col: int) -> DataFrame:
    """The one active patch whose ``t`` or ``time_index`` is ``timestep``; ValueError for 0, several or a filtered one."""
    step = str(timestep)
    at = F.col("t") == step
    if step.lstrip("t").isdigit():
        at |= F.col("time_index") == int(step.lstrip("t"))
    found = index.where((F.col("scenario") == scenario) & (F.lower("var") == var.lower()) & at & (F.col("patch_row") == row) & (F.col("patch_col") == col))
    rows = found.select("filtered_out").take(2)
    if len(rows) != 1 or rows[0][0] != 0:
        raise ValueError("no such patch" if not rows else "several patches" if len(rows) > 1 else "the patch is filtered out")
    return found


def clean_depth(df: DataFrame, col: str, eps: float = 5e-5, max_depth: float = 5.0) -> DataFrame:
    """Missing, negative and tiny depths are 0; a positive ``max_depth`` caps."""
    c = F.coalesce(F.when(~F.isnan(F.col(col).cast("double")) & (F.abs(F.col(col)) < float("inf")), F.col(col).cast("double")), F.lit(0.0))
    c = F.when(c < eps, F.lit(0.0)).otherwise(c)
    return df.withColumn(col, F.least(c, F.lit(float(max_depth))) if max_depth > 0 else c)


def clean_velocity(df: DataFrame, col: str, eps: float = 1e-5, max_abs: float = 5.0) -> DataFrame:
    c = F.when(F.abs(F.col(col)) < eps, F.lit(0.0)).otherwise(F.col(col).cast("double"))
    return df.withColumn(col, F.greatest(F.lit(-float(max_abs)), F.least(c, F.lit(float(max_abs)))) + F.col(col) * 0)


def joint_valid(df: DataFrame, cols: list[str], mask: str) -> DataFrame:
    """``valid``: the mask is 1 and all columns are there; elsewhere every column is 0."""
    ok = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols], F.coalesce(F.col(mask) == 1, F.lit(False)))
    return df.withColumn("valid", ok).withColumns({c: F.when(F.col("valid"), F.col(c)).otherwise(F.lit(0.0)) for c in cols})


def mask_coarse(df: DataFrame, cols: list[str], mask: str) -> DataFrame:
    """Values where the coarse mask is 1, else 0."""
    return df.withColumns({c: F.when((F.col(mask) == 1) & F.col(c).isNotNull(), F.col(c)).otherwise(F.lit(0.0)) for c in cols})


def aoi_filter(cells: DataFrame, keys: list[str], mask: str = "mask", threshold: float = 0.2) -> DataFrame:
    """Per patch ``aoi_ratio`` (share of cells with mask 1) and ``filtered_out``."""
    share = F.avg(F.when(F.col(mask) == 1, 1.0).otherwise(0.0))
    return cells.groupBy(*keys).agg(share.alias("aoi_ratio")).withColumn("filtered_out", (F.col("aoi_ratio") < threshold).cast("int"))


def blank_filtered_paths(index: DataFrame, cols: list[str]) -> DataFrame:
    return index.withColumns({c: F.when(F.col("filtered_out") == 1, F.lit("")).otherwise(F.col(c)) for c in cols})


def threshold_zero(df: DataFrame, col: str, threshold: float) -> DataFrame:
    return df.withColumn(col, F.when(F.col(col) < threshold, F.lit(0.0)).otherwise(F.col(col)))


def tolerance_zero(df: DataFrame, col: str, tolerance: float) -> DataFrame:
    return df.withColumn(col, F.when(F.abs(F.col(col)) < tolerance, F.lit(0.0)).otherwise(F.col(col)))


def wet_dry_mask(df: DataFrame, cols: list[str], h: str = "hmax", eps: float = 0.03) -> DataFrame:
    """Columns are NULL where ``h`` is below ``eps`` or missing."""
    ok = F.col(h) >= eps
    return df.withColumns({c: F.when(ok, F.col(c)) for c in cols})


def fill_floor(df: DataFrame, col: str, fill: float, floor: float) -> DataFrame:
    return df.withColumn(col, F.greatest(F.coalesce(F.col(col).cast("double"), F.lit(float(fill))), F.lit(float(floor))))


def clip_region(df: DataFrame, xmin=None, xmax=None, ymin=None, ymax=None) -> DataFrame:
    """Rows strictly inside the box; a missing bound is open. The comparisons reach the scan."""
    tests = [(xmin, lambda v: F.col("x") > v), (xmax, lambda v: F.col("x") < v), (ymin, lambda v: F.col("y") > v), (ymax, lambda v: F.col("y") < v)]
    for bound, test in tests:
        if bound is not None and bound == bound:
            df = df.where(test(bound))
    return df


def unpack_scaled(df: DataFrame, col: str, scale: float = 1.0, offset: float = 0.0, fill=None) -> DataFrame:
    """packed * scale + offset; the fill value is compared with the packed number."""
    c = F.col(col)
    value = c.cast("double") * scale + offset
    return df.withColumn(col, value if fill is None else F.when(c != fill, value))


def domain_mask_rain(df: DataFrame, inside: str, col: str = "depth", time: str = "hours") -> DataFrame:
    """Rain outside the domain or missing is 0; time counts seconds from the first step of all."""
    first = df.agg(F.min(time).alias("_first"))
    out = df.crossJoin(F.broadcast(first))  # one row
    value = F.coalesce(F.when(F.col(inside), F.col(col).cast("double")), F.lit(0.0))
    return out.withColumns({col: value, "seconds": (F.col(time) - F.col("_first")) * 3600.0}).drop("_first")


def parse_limits(names: list[str]) -> list[tuple[str, int | None]]:
    """``["a", "b:3"]``: names with how many first time steps to keep (None: all)."""
    out = []
    for n in names:
        name, colon, most = n.rpartition(":")
        out.append((name, int(most)) if colon and most.isdigit() else (n, None))
    return out


def limit_scenarios(index: DataFrame, names: list[str]) -> DataFrame:
    """Rows of the named scenarios, each with its first n time steps."""
    limits = index.sparkSession.createDataFrame(parse_limits(names), "scenario string, _most int")
    # as many rows as names were given; only their distinct time steps are ranked
    named = index.join(F.broadcast(limits), "scenario")
    rank = F.row_number().over(Window.partitionBy("scenario").orderBy("time_index"))
    first = named.where("_most IS NOT NULL").select("scenario", "time_index", "_most").distinct().withColumn("_step", rank).where("_step <= _most")
    last = first.groupBy("scenario").agg(F.max(F.struct("_step", "time_index")).alias("_end")).select("scenario", "_end.time_index")
    ends = F.broadcast(last.withColumnRenamed("time_index", "_end"))
    return named.join(ends, "scenario", "left").where("_most IS NULL OR time_index <= _end").drop("_most", "_end")


def tile_grid(cells: DataFrame, patch: int, y: str = "y", x: str = "x") -> DataFrame:
    """Adds patch_row, patch_col and the cell's place in its tile; no shuffle."""
    size = F.lit(patch)
    return cells.withColumns(
        {
            "patch_row": F.floor(F.col(y) / size).cast("int"), "patch_col": F.floor(F.col(x) / size).cast("int"),
            "ty": F.pmod(F.col(y), size).cast("int"), "tx": F.pmod(F.col(x), size).cast("int"),
        }
    )


def tile_extents(tiled: DataFrame, y: str = "y", x: str = "x") -> DataFrame:
    """Corner coordinates and number of cells of each tile."""
    return tiled.groupBy("patch_row", "patch_col").agg(F.min(x).alias("x0"), F.min(y).alias("y0"), F.max(x).alias("x1"), F.max(y).alias("y1"), F.count("*").alias("n"))


def patches_to_cells(patches: DataFrame, arrays: dict[str, str] | None = None) -> DataFrame:
    """One row per cell: ``y``, ``x`` and a column for each array (array name -> cell name)."""
    arrays = arrays or {"values": "value"}
    keys = [c for c in patches.columns if c not in arrays and c not in ("h", "w")]
    zipped = F.arrays_zip(*[F.col(a) for a in arrays])
    out = patches.select(*keys, "w", F.posexplode(zipped).alias("pos", "_cell"))
    return out.select(*keys, F.floor(F.col("pos") / F.col("w")).cast("int").alias("y"), (F.col("pos") % F.col("w")).cast("int").alias("x"), *[F.col("_cell")[a].alias(n) for a, n in arrays.items()])


def cells_to_patches(cells: DataFrame, keys: list[str], h: int, w: int, value: str = "value", fill=None) -> DataFrame:
    """Row-major arrays of h * w values; cells that are not there are ``fill``."""
    at = F.map_from_entries(F.collect_list(F.struct((F.col("y") * w + F.col("x")).cast("int"), F.col(value))))
    grouped = cells.where((F.col("y") < h) & (F.col("x") < w)).groupBy(*keys).agg(at.alias("_at"))
    values = F.transform(F.sequence(F.lit(0), F.lit(h * w - 1)), lambda i: F.coalesce(F.col("_at")[i], F.lit(fill)))
    return grouped.select(*keys, F.lit(h).alias("h"), F.lit(w).alias("w"), values.alias("values"))


def fit_shape(patches: DataFrame, h: int, w: int, value: str = "values", fill=0.0) -> DataFrame:
    """Arrays cropped to the common part and padded with ``fill`` at the bottom and right to h * w."""
    v, old_w, old_h = F.col(value), F.col("w"), F.col("h")
    def cell(i: Column) -> Column:
        y, x = F.floor(i / F.lit(w)), i % w
        return F.when((y < old_h) & (x < old_w), F.get(v, (y * old_w + x).cast("int"))).otherwise(F.lit(fill))
    return patches.withColumn(value, F.transform(F.sequence(F.lit(0), F.lit(h * w - 1)), cell)).withColumns({"h": F.lit(h), "w": F.lit(w)})


def pad_patches(patches: DataFrame, size: int, value: str = "values", fill=None) -> DataFrame:
    """``fit_shape`` to a square, with NULL (values) or 0 (masks) as fill."""
    return fit_shape(patches, size, size, value, fill)


def crop_overlap(a: DataFrame, b: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Cells of both tables inside the shape that both have, per key."""
    def shape(d: DataFrame, n: str) -> DataFrame:
        return d.groupBy(*keys).agg((F.max("y") + 1).alias(f"h{n}"), (F.max("x") + 1).alias(f"w{n}"))
    common = shape(a, "a").join(shape(b, "b"), keys).select(*keys, F.least("ha", "hb").alias("_h"), F.least("wa", "wb").alias("_w"))
    cut = lambda d: d.join(common, keys).where((F.col("y") < F.col("_h")) & (F.col("x") < F.col("_w"))).drop("_h", "_w")
    return cut(a), cut(b)
