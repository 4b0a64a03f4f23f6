"""Queries of the cell, raster, function and statistics operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import cells as M
from ..operators import joins as J
from ..operators import patchwise
from ..operators import resample as R
from ..operators import stats as A
from ..operators.maps import map_hillshade, whole_map
from ..operators.polygons import fill_lakes_in, in_polygons, mask_by_polygons
from ..sources.adapters import CELLS_SQL, INDEX_SQL, WIDE_SQL, cells, patch_index, table, vectors, wide_cells
from .registry import SQL, query, rounded

KEYS = ["scenario", "t", "patch_row", "patch_col"]
_K = ", ".join(KEYS)
_CK = ", ".join(f"c.{k}" for k in KEYS)
_EPS = "1e-12::DOUBLE"
_MOMENTS = f"count(v) AS n, round(min(v), 6) AS min, round(max(v), 6) AS max, round(avg(v), 6) AS mean, round(stddev_pop(v) + {_EPS}, 6) AS std"

# cells --------------------------------------------------------------------------------------------


@query(f"{CELLS_SQL} SELECT {_K}, y, x, round(CASE WHEN abs(u * 1e31::DOUBLE) < 1e30::DOUBLE THEN u * 1e31::DOUBLE END / 1e31::DOUBLE, 6) AS v FROM cells WHERE abs(u * 1e31::DOUBLE) < 1e30::DOUBLE")
def m1_mask_fill(spark: SparkSession, sf: str) -> DataFrame:
    d = cells(spark, sf).withColumn("v", F.col("u") * 1e31).select(*KEYS, "y", "x", "v")
    return rounded(M.mask_fill(d, "v").where("v IS NOT NULL").withColumn("v", F.col("v") / 1e31))


@query(f"{INDEX_SQL} SELECT row_id, scenario, t, patch_row, patch_col FROM idx WHERE filtered_out = 0 AND var = 'h'")
def m2_active_patches(spark: SparkSession, sf: str) -> DataFrame:
    return M.active_patches(patch_index(spark, sf), "H").select("row_id", *KEYS)


@query(f"{CELLS_SQL} SELECT {_K}, y, x, round(least(CASE WHEN u < 0.01::DOUBLE THEN 0 ELSE u END, 0.2::DOUBLE), 6) AS depth, round(greatest(-0.1::DOUBLE, least(CASE WHEN abs(u) < 0.01::DOUBLE THEN 0 ELSE u END, 0.1::DOUBLE)), 6) AS speed FROM cells")
def m4_m5_clean(spark: SparkSession, sf: str) -> DataFrame:
    d = cells(spark, sf).select(*KEYS, "y", "x", F.col("u").alias("depth"), F.col("u").alias("speed"))
    return rounded(M.clean_velocity(M.clean_depth(d, "depth", 0.01, 0.2), "speed", 0.01, 0.1))


_VALID = "mask = 1 AND target >= 0.05::DOUBLE"


@query(f"{CELLS_SQL} SELECT {_K}, y, x, {_VALID} AS valid, round(CASE WHEN {_VALID} THEN target ELSE 0 END, 6) AS target, round(CASE WHEN {_VALID} THEN pred ELSE 0 END, 6) AS pred FROM cells")
def m6_joint_valid(spark: SparkSession, sf: str) -> DataFrame:
    d = cells(spark, sf).withColumn("target", F.when(F.col("target") >= 0.05, F.col("target"))).select(*KEYS, "y", "x", "target", "pred", "mask")
    return rounded(M.joint_valid(d, ["target", "pred"], "mask").drop("mask"))


@query(f"{CELLS_SQL} SELECT {_K}, y, x, round(CASE WHEN mask = 1 THEN pred ELSE 0 END, 6) AS pred FROM cells")
def m7_mask_coarse(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(M.mask_coarse(cells(spark, sf), ["pred"], "mask").select(*KEYS, "y", "x", "pred"))


@query(f"{CELLS_SQL} SELECT {_K}, round(avg(mask), 6) AS aoi_ratio, CAST(avg(mask) < 0.8::DOUBLE AS INT) AS filtered_out FROM cells GROUP BY ALL")
def m8_aoi_filter(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(M.aoi_filter(cells(spark, sf), KEYS, threshold=0.8))


@query(f"{CELLS_SQL} SELECT {_K}, y, x, round(CASE WHEN target < 0.05::DOUBLE THEN 0 ELSE target END, 6) AS target, round(CASE WHEN abs(u) < 0.02::DOUBLE THEN 0 ELSE u END, 6) AS u, round(CASE WHEN target >= 0.03::DOUBLE THEN pred END, 6) AS pred FROM cells")
def m9_m10_zero_and_wet_mask(spark: SparkSession, sf: str) -> DataFrame:
    d = M.wet_dry_mask(cells(spark, sf), ["pred"], "target")
    return rounded(M.tolerance_zero(M.threshold_zero(d, "target", 0.05), "u", 0.02).select(*KEYS, "y", "x", "target", "u", "pred"))


@query(f"{CELLS_SQL} SELECT {_K}, y, x, round(greatest(coalesce(CASE WHEN u > 0 THEN u END, 0.04::DOUBLE), 0.01::DOUBLE), 6) AS rough FROM cells WHERE x > 1 AND x < 6 AND y > 0")
def m11_m12_floor_and_clip(spark: SparkSession, sf: str) -> DataFrame:
    d = cells(spark, sf).withColumn("rough", F.when(F.col("u") > 0, F.col("u")))
    return rounded(M.fill_floor(M.clip_region(d, xmin=1, xmax=6, ymin=0), "rough", 0.04, 0.01).select(*KEYS, "y", "x", "rough"))


@query("SELECT l_orderkey, l_linenumber, round(CASE WHEN l_linenumber <> 7 THEN l_linenumber * 0.5::DOUBLE + 2 END, 6) AS v FROM lineitem")
def m13_unpack_scaled(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_linenumber").alias("v"))
    return rounded(M.unpack_scaled(d, "v", 0.5, 2.0, 7))


@query(f"{CELLS_SQL} SELECT {_K}, y, x, round(CASE WHEN mask = 1 THEN target ELSE 0 END, 6) AS depth, round((time_index - (SELECT min(time_index) FROM cells)) * 3600::DOUBLE, 6) AS seconds FROM cells")
def m14_domain_mask_rain(spark: SparkSession, sf: str) -> DataFrame:
    d = cells(spark, sf).select(*KEYS, "y", "x", (F.col("mask") == 1).alias("inside"), F.col("target").alias("depth"), F.col("time_index").alias("hours"))
    return rounded(M.domain_mask_rain(d, "inside").drop("inside", "hours"))


@query(f"{INDEX_SQL}, r AS (SELECT *, dense_rank() OVER (PARTITION BY scenario ORDER BY time_index) AS k FROM idx WHERE scenario IN ('1-URGENT', '5-LOW')) SELECT row_id, scenario, time_index FROM r WHERE scenario = '1-URGENT' OR k <= 3")
def m15_limit_scenarios(spark: SparkSession, sf: str) -> DataFrame:
    return M.limit_scenarios(patch_index(spark, sf), ["1-URGENT", "5-LOW:3"]).select("row_id", "scenario", "time_index")


# rasters ------------------------------------------------------------------------------------------


@query(f"{CELLS_SQL} SELECT vec_id, y // 4 AS tile_row, x // 4 AS tile_col, y % 4 AS ty, x % 4 AS tx, round(target, 6) AS target FROM cells")
def r1_tile_grid(spark: SparkSession, sf: str) -> DataFrame:
    d = cells(spark, sf).select("vec_id", "y", "x", "target")
    return rounded(M.tile_grid(d, 4).select("vec_id", F.col("patch_row").alias("tile_row"), F.col("patch_col").alias("tile_col"), "ty", "tx", "target"))


@query(f"{CELLS_SQL} SELECT vec_id, [round(v, 6) FOR v IN list(target ORDER BY y, x)] AS values FROM cells GROUP BY vec_id")
def r2_cells_to_patches(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(M.cells_to_patches(cells(spark, sf), ["vec_id"], 8, 8, "target").select("vec_id", "values"))


@query(f"{CELLS_SQL}, g AS (SELECT vec_id, unnest(range(36)) AS p FROM embeddings) SELECT g.vec_id, [round(v, 6) FOR v IN list(coalesce(c.target, 0) ORDER BY p)] AS values FROM g LEFT JOIN cells c ON c.vec_id = g.vec_id AND c.y = p // 12 AND c.x = p % 12 GROUP BY g.vec_id")
def r3_r4_fit_shape(spark: SparkSession, sf: str) -> DataFrame:
    v = vectors(spark, sf).select("vec_id", F.lit(8).alias("h"), F.lit(8).alias("w"), F.col("target").alias("values"))
    return rounded(M.fit_shape(v, 3, 12).select("vec_id", "values"))


@query(f"{CELLS_SQL} SELECT {_K}, CAST(y // 2 AS INT) AS y, CAST(x // 2 AS INT) AS x, round(avg(CASE WHEN mask = 1 THEN target END), 6) AS target FROM cells GROUP BY {_K}, y // 2, x // 2")
def r6_block_mean(spark: SparkSession, sf: str) -> DataFrame:
    d = cells(spark, sf).withColumn("target", F.when(F.col("mask") == 1, F.col("target")))
    return rounded(R.block_mean(d, KEYS, 2, "target"))


@query(f"{CELLS_SQL} SELECT {_K}, CAST(y // 3 AS INT) AS y, CAST(x // 3 AS INT) AS x, max(mask) AS mask, count(*) = 9 AS whole FROM cells GROUP BY {_K}, y // 3, x // 3")
def r7_block_max_mask(spark: SparkSession, sf: str) -> DataFrame:
    return R.block_max_mask(cells(spark, sf), KEYS, 3)


@query(f"{CELLS_SQL}, o AS (SELECT unnest(range(4)) AS i) SELECT vec_id, CAST(y * 2 + i // 2 AS INT) AS y, CAST(x * 2 + i % 2 AS INT) AS x, round(target, 6) AS target FROM cells, o")
def r8_upsample_nearest(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(R.upsample_nearest(cells(spark, sf).select("vec_id", "y", "x", "target"), 2))


@query(f"{CELLS_SQL} SELECT scenario, t, patch_row * 8 + y AS map_y, patch_col * 8 + x AS map_x, round(target, 6) AS target FROM cells")
def r11_mosaic(spark: SparkSession, sf: str) -> DataFrame:
    placed = R.mosaic(cells(spark, sf), 8)
    return rounded(placed.select("scenario", "t", "map_y", "map_x", "target"))


_MAP = "gr AS (SELECT t, a AS map_y, b AS map_x FROM (SELECT DISTINCT t FROM cells), range(64) y(a), range(8 * (SELECT max(patch_col) + 1 FROM cells)) x(b)), mp AS (SELECT g.t, map_y, map_x, c.target, c.vec_id FROM gr g LEFT JOIN cells c ON c.t = g.t AND c.patch_row * 8 + c.y = map_y AND c.patch_col * 8 + c.x = map_x)"


def _map_of_patches(spark: SparkSession, sf: str) -> tuple[DataFrame, int]:
    """The patches of each time step's map, of 8 rows of tiles, and the number of columns."""
    v = vectors(spark, sf).select("t", "patch_row", "patch_col", F.col("target").alias("values"))
    return v, (v.agg(F.max("patch_col")).first()[0] or 0) + 1


@query(f"{CELLS_SQL}, {_MAP} SELECT t, CAST(map_y AS INT) AS map_y, CAST(map_x AS INT) AS map_x, round(target, 6) AS target, (vec_id IS NOT NULL)::INT AS mask FROM mp")
def r11_mosaic_full(spark: SparkSession, sf: str) -> DataFrame:
    """The whole map of each time step; missing tiles are NULL with mask 0."""
    cols = _map_of_patches(spark, sf)[1]
    return rounded(R.mosaic_full(cells(spark, sf).select("t", "patch_row", "patch_col", "y", "x", "target"), ["t"], 8, 8, cols, "target"))


@query(f"{CELLS_SQL}, {_MAP} SELECT t, CAST(map_y // 8 AS INT) AS patch_row, CAST(map_x // 8 AS INT) AS patch_col, max((vec_id IS NOT NULL)::INT) AS mask, round(sum(target), 6) AS total FROM mp GROUP BY ALL")
def r11_whole_map(spark: SparkSession, sf: str) -> DataFrame:
    """The same in patch form."""
    v, cols = _map_of_patches(spark, sf)
    out = whole_map(v, ["t"], 8, cols, ["values"])
    return rounded(out.select("t", "patch_row", "patch_col", "mask", F.aggregate("values", F.lit(0.0), lambda a, x: a + x).alias("total")))


@query(f"{CELLS_SQL} SELECT vec_id, y + 1 AS y, x - 2 AS x, round(target, 6) AS target FROM cells WHERE y + 1 < 8 AND x - 2 >= 0")
def r12_shift_grid(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(R.shift_grid(cells(spark, sf).select("vec_id", "y", "x", "target"), 1, -2, 8, 8))


def _grad(a: str, b: str) -> str:
    w = f"OVER (PARTITION BY vec_id, {a} ORDER BY {b})"
    return f"CASE WHEN {b} = 0 THEN lead(target) {w} - target WHEN {b} = 7 THEN target - lag(target) {w} ELSE (lead(target) {w} - lag(target) {w}) / 2 END"


def _shade(azimuth: int) -> str:
    slope = "(pi() / 2 - atan(sqrt(gx * gx + gy * gy)))"
    return f"round(least(greatest((sin(radians(45)) * sin{slope} + cos(radians(45)) * cos{slope} * cos(radians({azimuth}) - atan2(-gx, gy)) + 1) / 2, 0), 1), 6)"


@query(f"{CELLS_SQL}, g AS (SELECT vec_id, y, x, {_grad('x', 'y')} AS gy, {_grad('y', 'x')} AS gx FROM cells) SELECT vec_id, y, x, {_shade(315)} AS shade, {_shade(20)} AS shade_20 FROM g")
def r13_hillshade(spark: SparkSession, sf: str) -> DataFrame:
    """Lit from the north-west, and from just east of north."""
    out = R.hillshade(cells(spark, sf), ["vec_id"], value="target").select("vec_id", "y", "x", "target", F.col("shade").alias("first"))
    out = R.hillshade(out, ["vec_id"], 20.0, value="target")
    return rounded(out.select("vec_id", "y", "x", F.col("first").alias("shade"), F.col("shade").alias("shade_20")))


def _along(a: str, b: str, last: str) -> str:
    w = f"OVER (PARTITION BY t, {a} ORDER BY {b})"
    return f"CASE WHEN {b} = 0 THEN lead(target) {w} - target WHEN {b} = {last} THEN target - lag(target) {w} ELSE (lead(target) {w} - lag(target) {w}) / 2 END"


@query(f"""{CELLS_SQL}, {_MAP}, g AS (SELECT t, map_y, map_x, vec_id, {_along('map_x', 'map_y', '63')} AS gy, {_along('map_y', 'map_x', '(SELECT max(map_x) FROM gr)')} AS gx FROM mp)
SELECT t, CAST(map_y AS INT) AS map_y, CAST(map_x AS INT) AS map_x, CASE WHEN gx IS NOT NULL AND gy IS NOT NULL THEN {_shade(315)} END AS shade FROM g WHERE vec_id IS NOT NULL""")
def r13_map_hillshade(spark: SparkSession, sf: str) -> DataFrame:
    """Of each time step's whole map: patches get their neighbours' edges; beside missing tiles there is none."""
    v, cols = _map_of_patches(spark, sf)
    out = map_hillshade(v, ["t"], 8, cols, 8, 8).withColumn("w", F.lit(8)).drop("values")
    placed = R.mosaic(M.patches_to_cells(out, {"shade": "shade"}), 8)
    return rounded(placed.select("t", "map_y", "map_x", "shade"))


def _coin(what: str) -> str:
    return f"(md5('7:{what}:' || vec_id)[1] >= '8')"


@query(f"""{CELLS_SQL}, f AS (SELECT vec_id, target, CASE WHEN {_coin('v')} THEN 7 - y ELSE y END AS y, CASE WHEN {_coin('h')} THEN 7 - x ELSE x END AS x, {_coin('r')} AS r,
CASE WHEN {_coin('h')} THEN -u ELSE u END AS s, CASE WHEN {_coin('v')} THEN -pred ELSE pred END AS c FROM cells)
SELECT vec_id, CASE WHEN r THEN 7 - x ELSE y END AS y, CASE WHEN r THEN y ELSE x END AS x, round(target, 6) AS target,
round(CASE WHEN r THEN -c ELSE s END, 6) + 0 AS aspect_sin, round(CASE WHEN r THEN s ELSE c END, 6) + 0 AS aspect_cos FROM f""")
def r14_augment(spark: SparkSession, sf: str) -> DataFrame:
    c = cells(spark, sf).select("vec_id", "y", "x", "target", F.col("u").alias("aspect_sin"), F.col("pred").alias("aspect_cos"))
    return rounded(R.augment(c, 8, 7, "vec_id"))


@query(f"{CELLS_SQL} SELECT vec_id, y - 2 AS y, x - 2 AS x, round(target, 6) AS target FROM cells WHERE y BETWEEN 2 AND 5 AND x BETWEEN 2 AND 5")
def r15_crop_border(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(R.crop_border(R.mod_crop(cells(spark, sf).select("vec_id", "y", "x", "target"), 8, 8, 2), 8, 8, 2))


_LEVELS = f"{CELLS_SQL}, lv AS (SELECT vec_id, 1 AS level, y + 1 AS i, x + 1 AS j, CASE WHEN mask = 1 THEN target END AS value FROM cells UNION ALL SELECT vec_id, 0, y // 2 + 1, x // 2 + 1, avg(pred) FROM cells WHERE (y // 2 + x // 2) % 3 <> 0 GROUP BY vec_id, y // 2, x // 2)"


def _levels(spark: SparkSession, sf: str) -> DataFrame:
    c = cells(spark, sf)
    fine = c.select("vec_id", F.lit(1).alias("level"), (F.col("y") + 1).alias("i"), (F.col("x") + 1).alias("j"), F.when(F.col("mask") == 1, F.col("target")).alias("value"))
    by = R.block_mean(c, ["vec_id"], 2, "pred").where((F.col("y") + F.col("x")) % 3 != 0)
    return fine.unionByName(by.select("vec_id", F.lit(0).alias("level"), (F.col("y") + 1).alias("i"), (F.col("x") + 1).alias("j"), F.col("pred").alias("value")))


@query(f"{_LEVELS} SELECT f.level::INT AS level, f.vec_id, CAST(f.i AS INT) AS i, CAST(f.j AS INT) AS j, round(CASE WHEN f.level = 0 THEN f.value ELSE coalesce(f.value, p.value) END, 6) AS value FROM lv f LEFT JOIN lv p ON p.vec_id = f.vec_id AND p.level = 0 AND p.i = (f.i + 1) // 2 AND p.j = (f.j + 1) // 2")
def r16_collapse_inject(spark: SparkSession, sf: str) -> DataFrame:
    out = R.collapse_inject(_levels(spark, sf), ["vec_id"], 1)
    return rounded(out.select(F.col("level").cast("int").alias("level"), "vec_id", F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), "value"))


@query(f"{_LEVELS}, m AS (SELECT vec_id, (i + 1) // 2 AS i, (j + 1) // 2 AS j, CASE WHEN count(value) = 4 THEN avg(value) END AS value FROM lv WHERE level = 1 GROUP BY ALL) SELECT m.vec_id, CAST(m.i AS INT) AS i, CAST(m.j AS INT) AS j, round(coalesce(c.value, m.value), 6) AS value FROM m LEFT JOIN lv c ON c.level = 0 AND c.vec_id = m.vec_id AND c.i = m.i AND c.j = m.j")
def r17_collapse_average(spark: SparkSession, sf: str) -> DataFrame:
    out = R.collapse_average(_levels(spark, sf), ["vec_id"], 1).where("level = 0")
    return rounded(out.select("vec_id", F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), "value"))


@query(f"{CELLS_SQL} SELECT vec_id, CAST(y // 2 AS INT) AS y, CAST(x // 2 AS INT) AS x, round(sum(u * target) / nullif(sum(target), 0), 6) AS u, round(avg(target), 6) AS target FROM cells GROUP BY vec_id, y // 2, x // 2")
def r18_volume_average(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(R.volume_average(cells(spark, sf), ["vec_id"], "u", "target"))


@query(f"{CELLS_SQL} SELECT vec_id, y, x, CASE WHEN abs((pred - target) / nullif(pred, 0)) > 0.3::DOUBLE AND target > 0.1::DOUBLE AND pred > 0.7::DOUBLE AND abs(u) < 0.9::DOUBLE THEN 3 ELSE 0 END AS level FROM cells")
def r19_refine_target(spark: SparkSession, sf: str) -> DataFrame:
    c = cells(spark, sf).withColumns({"slope": F.abs("u") * (0.2 / 0.9)})
    return R.refine_target(c, "pred", "target", "target").select("vec_id", "y", "x", "level")


@query(f"{CELLS_SQL}, n AS (SELECT patch_row AS lake, round(target, 1) AS level, count(*) AS n FROM cells WHERE y = 0 GROUP BY ALL) SELECT lake, level FROM (SELECT *, row_number() OVER (PARTITION BY lake ORDER BY n DESC, level) AS k FROM n) WHERE k = 1")
def r20_lake_levels(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(R.lake_levels(cells(spark, sf).where("y = 0").select(F.col("patch_row").alias("lake"), F.col("target").alias("z"))))


@query(f"{CELLS_SQL} SELECT vec_id, y, x, round(65.481::DOUBLE * target + 128.553::DOUBLE * pred + 24.966::DOUBLE * u + 16, 6) AS luma, round(-37.797::DOUBLE * target - 74.203::DOUBLE * pred + 112::DOUBLE * u + 128, 6) AS cb, round(112::DOUBLE * target - 93.786::DOUBLE * pred - 18.214::DOUBLE * u + 128, 6) AS cr FROM cells")
def r21_rgb_ycbcr(spark: SparkSession, sf: str) -> DataFrame:
    d = cells(spark, sf).select("vec_id", "y", "x", F.col("target").alias("r"), F.col("pred").alias("g"), F.col("u").alias("b"))
    return rounded(R.rgb_ycbcr(d).drop("r", "g", "b"))


@query(f"""{CELLS_SQL}, tap AS (SELECT o, a, abs(2 * o + 0.5::DOUBLE - a) * 0.5::DOUBLE AS d FROM range(4) t(o), range(-8, 17) s(a)),
k AS (SELECT o, a, CASE WHEN d <= 1 THEN 1.5::DOUBLE * d * d * d - 2.5::DOUBLE * d * d + 1 WHEN d <= 2 THEN -0.5::DOUBLE * d * d * d + 2.5::DOUBLE * d * d - 4 * d + 2 ELSE 0 END AS k FROM tap),
n AS (SELECT o, sum(k) AS total FROM k GROUP BY o),
m AS (SELECT k.o, CASE WHEN (a + 16) % 16 < 8 THEN (a + 16) % 16 ELSE 15 - (a + 16) % 16 END AS i, sum(k / total) AS wt FROM k JOIN n ON n.o = k.o GROUP BY ALL),
z AS (SELECT vec_id, p.o AS oy, q.o AS ox, sum(p.wt * q.wt * target) AS v FROM cells JOIN m p ON p.i = y JOIN m q ON q.i = x GROUP BY ALL)
SELECT vec_id, 4 AS h, 4 AS w, list(round(v, 6) + 0 ORDER BY oy, ox) AS values FROM z GROUP BY vec_id""")
def r10_resize_bicubic(spark: SparkSession, sf: str) -> DataFrame:
    v = vectors(spark, sf).select("vec_id", F.lit(8).alias("h"), F.lit(8).alias("w"), F.col("target").alias("values"))
    return rounded(patchwise.resize_bicubic(v, 0.5))


# functions ----------------------------------------------------------------------------------------


@query(f"{CELLS_SQL} SELECT vec_id, y, x, round(ln(1 + greatest(u, 0)), 6) AS f1, round(asinh(u / 0.3::DOUBLE), 6) AS f2, round((u - 0.1::DOUBLE) / (0.5::DOUBLE + {_EPS}), 6) AS f3, round(least(greatest(u, -0.1::DOUBLE), 0.1::DOUBLE), 6) AS f4, round(sinh(u * (0.5::DOUBLE + {_EPS}) + 0.1::DOUBLE) * 2, 6) AS f5 FROM cells")
def f1_f5_scaling(spark: SparkSession, sf: str) -> DataFrame:
    stats = {"mean": 0.1, "std": 0.5, "s": 2.0}
    return rounded(cells(spark, sf).select("vec_id", "y", "x", C.log1p_nonneg("u").alias("f1"), C.asinh_scale("u", 0.3).alias("f2"), C.zscore("u", 0.1, 0.5).alias("f3"), C.percentile_clip("u", -0.1, 0.1).alias("f4"), C.to_physical("u", stats, "asinh").alias("f5")))


@query(f"{CELLS_SQL}, k AS (SELECT vec_id, y, x, 'h_' || scenario || '_' || t || '_r' || lpad(CAST(patch_row AS VARCHAR), 3, '0') || '_c' || lpad(CAST(patch_col AS VARCHAR), 3, '0') || '_s8' AS key, patch_row, scenario, time_index FROM cells) SELECT vec_id, y, x, key, patch_row AS row_back, scenario AS scenario_back, CAST(time_index AS BIGINT) AS t_key FROM k")
def f7_f8_core_key(spark: SparkSession, sf: str) -> DataFrame:
    out = cells(spark, sf).withColumn("key", C.core_key("var", "scenario", "t", "patch_row", "patch_col", F.lit(8)))
    p = C.parse_core_key("key")
    return out.select("vec_id", "y", "x", "key", p["patch_row"].alias("row_back"), C.infer_scenario("key").alias("scenario_back"), C.time_sort_key(p["t"]).alias("t_key"))


@query("SELECT page_id, [CAST(x AS BIGINT) FOR x IN regexp_extract_all(regexp_extract(url, '([^/]*)/*$', 1), '\\d+')] AS key FROM pages")
def f9_natural_key(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", C.natural_key("url").alias("key"))


@query("SELECT page_id, CASE WHEN starts_with(url, 'https://www.') THEN 's3://' || substr(url, 13) WHEN starts_with(url, 'https://') THEN '/mnt/' || substr(url, 9) ELSE url END AS path FROM pages")
def f10_rewrite_prefix(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", C.rewrite_prefix("url", [("https://www.", "s3://"), ("https://", "/mnt/")]).alias("path"))


@query("SELECT page_id, CASE WHEN trim(p) = '' OR starts_with(p, '/') THEN p ELSE '/data/' || p END AS path FROM (SELECT page_id, substr(url, 6 + CAST(page_id % 3 AS INT)) AS p FROM pages)")
def f11_resolve_path(spark: SparkSession, sf: str) -> DataFrame:
    p = F.expr("substring(url, cast(6 + page_id % 3 as int))")
    return table(spark, sf, "pages").select("page_id", p.alias("p")).select("page_id", C.resolve_path("p", "/data").alias("path"))


@query(f"{CELLS_SQL} SELECT DISTINCT vec_id, '/in/{{scenario}}/' || t AS path FROM cells")
def f12_scenario_template(spark: SparkSession, sf: str) -> DataFrame:
    return vectors(spark, sf).select("vec_id", C.scenario_template(F.concat(F.lit("/in/"), "scenario", F.lit("/"), "t")).alias("path"))


@query("SELECT event_id, strftime(TIMESTAMP '2020-01-01' + to_hours(CAST(event_id % 1000 AS INT)), '%Y-%m-%d %H') AS at FROM events")
def f13_decode_time(spark: SparkSession, sf: str) -> DataFrame:
    at = C.decode_time(F.col("event_id") % 1000, "hours", F.lit("2020-01-01").cast("timestamp"))
    return table(spark, sf, "events").select("event_id", F.date_format(at, "yyyy-MM-dd HH").alias("at"))


def _sig(i: int) -> str:
    return f"(1 / (1 + exp(-l{i})) >= 0.5::DOUBLE)"


@query(f"{CELLS_SQL} SELECT vec_id, y, x, {_sig(1)} AS event, NOT {_sig(1)} AS nonflood, {_sig(2)} AND NOT {_sig(3)} AS severe, CASE WHEN target < 0.1::DOUBLE THEN 'nonflood' WHEN target < 0.5::DOUBLE THEN 'slight' WHEN target < 1 THEN 'severe' ELSE 'extreme' END AS band, CASE WHEN mask = 0 THEN 0 WHEN pred >= 0.1::DOUBLE AND target >= 0.1::DOUBLE THEN 1 WHEN pred >= 0.1::DOUBLE THEN 2 WHEN target >= 0.1::DOUBLE THEN 3 ELSE 0 END AS mismatch FROM cells")
def f14_f16_labels(spark: SparkSession, sf: str) -> DataFrame:
    band = C.ordinal_band("l1", "l2", "l3")
    mismatch = C.mismatch_class(C.wet("pred", 0.1), C.wet("target", 0.1), F.col("mask") == 1)
    return cells(spark, sf).select("vec_id", "y", "x", C.sigmoid_event("l1").alias("event"), band["nonflood"].alias("nonflood"), band["severe"].alias("severe"), C.depth_band("target", 0.1, 0.5, 1.0).alias("band"), mismatch.alias("mismatch"))


_Q = "least(CAST(floor((least(greatest(u, -0.5::DOUBLE), 0.5::DOUBLE) + 0.5::DOUBLE) / 0.0625::DOUBLE) AS BIGINT), 15)"


@query(f"{CELLS_SQL} SELECT vec_id, y, x, {_Q} AS level, round(({_Q} + 0.5::DOUBLE) * 0.0625::DOUBLE - 0.5::DOUBLE, 6) AS centre FROM cells")
def f17_quantize(spark: SparkSession, sf: str) -> DataFrame:
    q = C.quantize("u", -0.5, 0.5, 16)
    return rounded(cells(spark, sf).select("vec_id", "y", "x", q.alias("level")).withColumn("centre", C.dequantize("level", -0.5, 0.5, 16)))


@query("SELECT event_id, [round(CASE WHEN x = 'NULL' THEN -999 WHEN x = '' THEN -999.9 ELSE CAST(x AS DOUBLE) END, 6) FOR x IN string_split(event_id || ',NULL,,' || (user_id % 7), ',')] AS v FROM events")
def f18_parse_list(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(F.col("event_id").cast("string"), F.lit(",NULL,,"), (F.col("user_id") % 7).cast("string"))
    return rounded(table(spark, sf, "events").select("event_id", C.parse_list(text).alias("v")))


# statistics ---------------------------------------------------------------------------------------


@query(f"{WIDE_SQL}, m AS (SELECT scenario, CASE WHEN mask = 1 THEN pred END AS v FROM cells) SELECT scenario, {_MOMENTS} FROM m GROUP BY scenario")
def a1_masked_stats(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(A.masked_stats(wide_cells(spark, sf), ["scenario"], "pred"))


_LV = "CASE WHEN grouping(scenario) = 1 THEN 'dataset' WHEN grouping(t) = 1 THEN 'scenario' WHEN grouping(patch_row) = 1 THEN 'time' ELSE 'patch' END"


@query(f"{CELLS_SQL}, m AS (SELECT {_K}, CASE WHEN mask = 1 THEN pred END AS v FROM cells) SELECT {_LV} AS level, scenario, t, CAST(patch_row AS VARCHAR) AS patch_row, CAST(patch_col AS VARCHAR) AS patch_col, {_MOMENTS}, count(DISTINCT ({_K})) AS num_patches, count(DISTINCT (scenario, t)) AS num_t FROM m GROUP BY GROUPING SETS (({_K}), (scenario, t), (scenario), ())")
def a2_dataset_stats_levels(spark: SparkSession, sf: str) -> DataFrame:
    out = A.dataset_stats_levels(cells(spark, sf), "pred")
    return rounded(out.withColumns({c: F.col(c).cast("string") for c in ("patch_row", "patch_col")}))


@query(f"""{WIDE_SQL}, e AS (SELECT scenario, min(pred) AS lo, max(pred) AS hi, count(*) AS n FROM cells GROUP BY scenario),
b AS (SELECT c.scenario, CAST(floor((pred - lo) * 8191 / (hi - lo + {_EPS})) AS INT) AS bin, lo, hi, n FROM cells c JOIN e ON c.scenario = e.scenario),
r AS (SELECT scenario, bin, lo, hi, n, sum(count(*)) OVER (PARTITION BY scenario ORDER BY bin) AS cdf FROM b GROUP BY scenario, bin, lo, hi, n),
q AS (SELECT unnest([50.0::DOUBLE, 90.0::DOUBLE, 99.0::DOUBLE]) AS q)
SELECT scenario, q, round(min(lo + (hi - lo) * bin / 8191), 6) AS value FROM r, q WHERE cdf >= q / 100 * (n - 1) GROUP BY scenario, q""")
def a3_histogram_percentile(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(A.histogram_percentile(wide_cells(spark, sf), "pred", [50, 90, 99], ["scenario"]))


@query(f"{WIDE_SQL} SELECT scenario, [round(v, 6) FOR v IN quantile_cont(CASE WHEN pred > 0 THEN pred END, [0.25, 0.5, 0.95])] AS percentiles FROM cells GROUP BY scenario")
def a4_exact_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(A.exact_percentiles(wide_cells(spark, sf), "pred", [25, 50, 95], ["scenario"], True))


@query(f"{CELLS_SQL} SELECT round(greatest(quantile_cont(CASE WHEN target > 0 THEN target END, 0.99), 0.001::DOUBLE), 6) AS lim, round(quantile_cont(abs(u), 0.9) FILTER (WHERE u <> 0), 6) AS speed, round(quantile_cont(u, 0.02), 6) AS low, round(quantile_cont(u, 0.98), 6) AS high FROM cells")
def a5_display_limits(spark: SparkSession, sf: str) -> DataFrame:
    c = cells(spark, sf)
    parts = [A.auto_limits(c, "target").withColumnRenamed("limit", "lim"), A.percentile_abs_nonzero(c, "u", 90).withColumnRenamed("value", "speed"), A.percentile_range(c, "u", 2, 98)]
    return rounded(parts[0].crossJoin(parts[1]).crossJoin(parts[2]))  # one row each


@query(f"{CELLS_SQL}, g AS (SELECT DISTINCT scenario, unnest(range(20)) AS bin FROM cells), h AS (SELECT scenario, least(CAST(floor((target - 0) / 0.15::DOUBLE) AS INT), 19) AS bin, count(*) AS n FROM cells WHERE target BETWEEN 0 AND 3 GROUP BY 1, 2) SELECT g.scenario, CAST(g.bin AS INT) AS bin, round(g.bin * 0.15::DOUBLE, 6) AS left, coalesce(n, 0) AS n FROM g LEFT JOIN h ON g.scenario = h.scenario AND g.bin = h.bin")
def a6_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(A.histogram(cells(spark, sf), "target", 20, 0.0, 3.0, ["scenario"]))


@query("SELECT l_returnflag, l_quantity AS value, count(*) AS n FROM lineitem GROUP BY ALL")
def a7_value_counts(spark: SparkSession, sf: str) -> DataFrame:
    return A.value_counts(table(spark, sf, "lineitem"), "l_quantity", ["l_returnflag"])


@query(f"""{CELLS_SQL}, tr AS (SELECT patch_row, patch_col, count(*) AS w FROM (SELECT DISTINCT vec_id, patch_row, patch_col FROM cells) GROUP BY ALL),
st AS (SELECT patch_row, patch_col, y, x, max(mask) AS mask, max(u) AS slope, max(target) AS elevation FROM cells GROUP BY ALL),
lg AS (SELECT w, feature, v FROM (SELECT w, mask, unnest(['elevation', 'slope']) AS feature, unnest([elevation, slope]) AS v FROM st JOIN tr USING (patch_row, patch_col)) WHERE mask = 1)
SELECT feature, CAST(sum(w) AS BIGINT) AS n, round(min(v), 6) AS min, round(max(v), 6) AS max, round(sum(w * v) / sum(w), 6) AS mean, round(sqrt(sum(w * v * v) / sum(w) - pow(sum(w * v) / sum(w), 2)), 6) AS std FROM lg GROUP BY feature""")
def a8_static_feature_stats(spark: SparkSession, sf: str) -> DataFrame:
    static = cells(spark, sf).groupBy("patch_row", "patch_col", "y", "x").agg(F.max("mask").alias("mask"), F.max("u").alias("slope"), F.max("target").alias("elevation"))
    return rounded(A.static_feature_stats(vectors(spark, sf), static, ["elevation", "slope"]))


_GRIDS = f"{CELLS_SQL}, gr AS (SELECT 'fine' AS grid, target AS value, mask FROM cells UNION ALL SELECT 'coarse', pred, mask FROM cells)"


def _grids(spark: SparkSession, sf: str) -> DataFrame:
    c = cells(spark, sf)
    return c.select(F.lit("fine").alias("grid"), F.col("target").alias("value"), "mask").unionByName(c.select(F.lit("coarse").alias("grid"), F.col("pred").alias("value"), "mask"))


@query(f"{_GRIDS}, al AS (SELECT grid, value, mask FROM gr UNION ALL SELECT 'shared', value, mask FROM gr), m AS (SELECT grid, CASE WHEN mask = 1 THEN value END AS v FROM al) SELECT grid, {_MOMENTS} FROM m GROUP BY grid")
def a9_aux_level_stats(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(A.aux_level_stats(_grids(spark, sf)))


@query(f"{_GRIDS}, al AS (SELECT grid, value, mask FROM gr UNION ALL SELECT 'shared', value, mask FROM gr), m AS (SELECT grid, CASE WHEN mask = 1 THEN ln(1 + value) END AS v FROM al) SELECT grid, {_MOMENTS} FROM m GROUP BY grid")
def a10_depth_log1p_stats(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(A.depth_log1p_stats(_grids(spark, sf)))


def _hist_scale(qs: str, where: str, value: str = "value") -> str:
    return f"""w AS (SELECT {value} AS v FROM gr WHERE grid = 'fine' AND mask = 1 AND {where}), e AS (SELECT min(v) AS lo, max(v) AS hi, count(*) AS n FROM w),
r AS (SELECT bin, sum(c) OVER (ORDER BY bin) AS cdf FROM (SELECT CAST(floor((v - lo) * 8191 / (hi - lo + {_EPS})) AS INT) AS bin, count(*) AS c FROM w, e GROUP BY 1)),
q AS (SELECT unnest([{qs}]) AS q), sc AS (SELECT q, min(lo + (hi - lo) * bin / 8191) AS s FROM r, q, e WHERE cdf >= q / 100 * (n - 1) GROUP BY q)"""


@query(f"{_GRIDS}, {_hist_scale('50.0::DOUBLE, 90.0::DOUBLE', 'value >= 0.05::DOUBLE')}, m AS (SELECT q, s, grid, CASE WHEN mask = 1 THEN asinh(value / (s + {_EPS})) END AS v FROM gr, sc) SELECT q, round(s, 6) AS s, grid, {_MOMENTS} FROM m GROUP BY q, s, grid")
def a11_depth_asinh_stats(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(A.depth_asinh_stats(_grids(spark, sf), [50, 90]))


@query(f"{_GRIDS}, {_hist_scale('90.0::DOUBLE', 'true', 'abs(value)')}, m AS (SELECT q, s, grid, CASE WHEN mask = 1 THEN asinh(value / (s + {_EPS})) END AS v FROM gr, sc) SELECT q, round(s, 6) AS s, grid, {_MOMENTS} FROM m GROUP BY q, s, grid")
def a12_velocity_asinh_stats(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(A.velocity_asinh_stats(_grids(spark, sf)))


@query(f"{WIDE_SQL}, m AS (SELECT scenario, CASE WHEN mask = 1 THEN pred END AS v FROM cells) SELECT scenario, count(v) AS n, count(*) FILTER (WHERE v >= 0.5::DOUBLE) AS wet, round((count(*) FILTER (WHERE v >= 0.5::DOUBLE)) / (count(v) + {_EPS}), 6) AS wet_ratio, round((count(v) - count(*) FILTER (WHERE v >= 0.5::DOUBLE)) / greatest(count(*) FILTER (WHERE v >= 0.5::DOUBLE), 1), 6) AS pos_weight FROM m GROUP BY scenario")
def a13_wet_ratio_pos_weight(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(A.wet_ratio_pos_weight(wide_cells(spark, sf), ["scenario"], 0.5, "pred"))


_BANDS = {"nonflood": "v < 0.1::DOUBLE", "slight": "v >= 0.1::DOUBLE AND v < 0.5::DOUBLE", "severe": "v >= 0.5::DOUBLE AND v < 1", "extreme": "v >= 1", "wet": "v >= 0.05::DOUBLE"}
_COUNTS = ", ".join(f"count(*) FILTER (WHERE {e}) AS {b}_count" for b, e in _BANDS.items())
_SHARES = ", ".join(f"round((count(*) FILTER (WHERE {e})) / (count(v) + {_EPS}), 6) AS {b}_ratio" for b, e in _BANDS.items())


@query(f"{WIDE_SQL}, m AS (SELECT scenario, CASE WHEN mask = 1 AND pred >= 0 THEN pred END AS v FROM cells) SELECT scenario, count(v) AS valid_count, {_COUNTS}, {_SHARES} FROM m GROUP BY scenario")
def a14_interval_stats(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(A.interval_stats(wide_cells(spark, sf), ["scenario"], (0.1, 0.5, 1.0), "pred", lower=0.0, wet_from=0.05))


_PI = f"{CELLS_SQL}, m AS (SELECT vec_id, CASE WHEN mask = 1 AND target >= 0 THEN target END AS v FROM cells), pi AS (SELECT vec_id, count(v) AS valid_count, {_COUNTS}, {_SHARES} FROM m GROUP BY vec_id)"


def _patch_intervals(spark: SparkSession, sf: str) -> DataFrame:
    index = vectors(spark, sf).select("vec_id", "var", (F.col("vec_id") % 7 == 0).cast("int").alias("filtered_out"))
    c = cells(spark, sf).select("vec_id", F.col("target").alias("value"), "mask")
    return A.patch_interval_stats(index, c, ["vec_id"], (0.1, 0.5, 1.0))


@query(f"{_PI} SELECT vec_id, CASE WHEN vec_id % 7 <> 0 THEN valid_count END::DOUBLE AS valid_count, CASE WHEN vec_id % 7 <> 0 THEN slight_count END::DOUBLE AS slight_count, CASE WHEN vec_id % 7 <> 0 THEN extreme_ratio END AS extreme_ratio FROM pi")
def a15_patch_interval_stats(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_patch_intervals(spark, sf).select("vec_id", F.col("valid_count").cast("double").alias("valid_count"), F.col("slight_count").cast("double").alias("slight_count"), "extreme_ratio"))


@query(f"""{_PI}, lg AS (SELECT valid_count, unnest(['nonflood', 'slight', 'severe', 'extreme', 'wet']) AS band, unnest([nonflood_count, slight_count, severe_count, extreme_count, wet_count]) AS n,
unnest([nonflood_count, slight_count, severe_count, extreme_count, wet_count]) / (valid_count + {_EPS}) AS r FROM pi WHERE vec_id % 7 <> 0 AND vec_id % 2 = 0)
SELECT band, CAST(sum(n) AS BIGINT) AS count, round(sum(n) / (sum(valid_count) + {_EPS}), 6) AS ratio, count(*) FILTER (WHERE r > 0) AS patches_positive, count(*) FILTER (WHERE r >= 0.01::DOUBLE) AS patches_001, [round(v, 6) FOR v IN quantile_cont(r, [0.5, 0.75, 0.9, 0.95, 0.99])] AS percentiles FROM lg GROUP BY band""")
def a16_interval_summary(spark: SparkSession, sf: str) -> DataFrame:
    rows = _patch_intervals(spark, sf).withColumnRenamed("vec_id", "row_id")
    out = A.interval_summary(rows, rows.where("row_id % 2 = 0"))
    return rounded(out.select("band", "count", "ratio", "patches_positive", "patches_001", "percentiles"))


@query("SELECT l_returnflag, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS l_discount FROM lineitem WHERE l_quantity > 0 GROUP BY l_returnflag")
def a17_weighted_mean(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(A.weighted_mean(table(spark, sf, "lineitem"), ["l_returnflag"], "l_discount", "l_quantity"))


# joins --------------------------------------------------------------------------------------------


@query(f"{INDEX_SQL}, l AS (SELECT scenario, t, patch_row, patch_col, max_by(price, row_id) AS price, max(row_id) AS row_id FROM idx GROUP BY ALL), p AS (SELECT DISTINCT scenario, '1995-' || lpad(CAST(patch_row + 1 AS VARCHAR), 2, '0') AS t, patch_row, patch_col FROM idx) SELECT p.scenario, p.t, p.patch_row, p.patch_col, l.row_id, round(l.price, 6) AS price FROM p JOIN l USING (scenario, t, patch_row, patch_col)")
def j1_join_predictions(spark: SparkSession, sf: str) -> DataFrame:
    idx = patch_index(spark, sf)
    p = idx.select("scenario", F.concat(F.lit("1995-"), F.lpad((F.col("patch_row") + 1).cast("string"), 2, "0")).alias("t"), "patch_row", "patch_col").distinct()
    return rounded(J.join_predictions(p, idx.select("row_id", *KEYS, "price"), KEYS)[0])


@query("""WITH a AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'view'), q AS (SELECT user_id, ts, event_id FROM events WHERE event_type <> 'view'),
b AS (SELECT q.event_id, a.event_id AS k, q.ts - a.ts AS d FROM q ASOF JOIN a ON q.user_id = a.user_id AND q.ts >= a.ts), f AS (SELECT q.event_id, a.event_id AS k, a.ts - q.ts AS d FROM q ASOF JOIN a ON q.user_id = a.user_id AND q.ts <= a.ts)
SELECT coalesce(b.event_id, f.event_id) AS event_id, CASE WHEN f.k IS NULL OR b.d <= f.d THEN b.k ELSE f.k END AS nearest FROM b FULL JOIN f ON b.event_id = f.event_id""")
def j4_nearest_time(spark: SparkSession, sf: str) -> DataFrame:
    """For each other event, the user's view nearest in time."""
    e = table(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", "event_type")
    views = e.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("value"))
    asks = e.where("event_type <> 'view'").select("user_id", "ts", "event_id")
    near = J.nearest_time(views, asks, ["user_id"])
    return asks.join(near, ["user_id", "ts"]).where("value IS NOT NULL").select("event_id", F.col("value").alias("nearest"))


_NODES = "n AS (SELECT s_suppkey AS id, (s_suppkey * 37 % 101)::DOUBLE AS x, (s_suppkey * 53 % 97)::DOUBLE AS y, s_acctbal AS area FROM supplier), p AS (SELECT c_custkey AS point_id, (c_custkey * 17 % 103) + 0.5::DOUBLE AS x, (c_custkey * 29 % 89) + 0.25::DOUBLE AS y FROM customer)"


def _places(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    s, c = table(spark, sf, "supplier"), table(spark, sf, "customer")
    nodes = s.select(F.col("s_suppkey").alias("reach_id"), (F.col("s_suppkey") * 37 % 101).cast("double").alias("x"), (F.col("s_suppkey") * 53 % 97).cast("double").alias("y"), F.col("s_acctbal").alias("uparea"))
    points = c.select(F.col("c_custkey").alias("point_id"), ((F.col("c_custkey") * 17 % 103) + 0.5).alias("x"), ((F.col("c_custkey") * 29 % 89) + 0.25).alias("y"))
    return points, nodes


@query(f"WITH {_NODES}, r AS (SELECT point_id, id, area, row_number() OVER (PARTITION BY point_id ORDER BY sqrt(pow(p.x - n.x, 2) + pow(p.y - n.y, 2)), id) AS k FROM p, n), b AS (SELECT point_id, id, area, row_number() OVER (PARTITION BY point_id ORDER BY area DESC, k) AS o FROM r WHERE k <= 20) SELECT point_id, id AS reach_id, round(area, 6) AS uparea FROM b WHERE o = 1")
def j7_nearest_reach(spark: SparkSession, sf: str) -> DataFrame:
    points, nodes = _places(spark, sf)
    return rounded(J.nearest_reach(points, nodes))


@query(f"WITH {_NODES}, r AS (SELECT point_id, id, sqrt(pow(p.x - n.x, 2) + pow(p.y - n.y, 2)) AS d FROM p, n), k AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY d, id) AS o FROM r) SELECT point_id, id AS node_id, round(d, 6) AS distance FROM k WHERE o = 1")
def j10_nearest_node(spark: SparkSession, sf: str) -> DataFrame:
    points, nodes = _places(spark, sf)
    return rounded(J.nearest_node(points, nodes.withColumnRenamed("reach_id", "node_id"), "point_id", "node_id"))


@query("WITH p AS (SELECT c_custkey AS id, (c_custkey * 17 % 103)::DOUBLE AS x, (c_custkey * 29 % 89)::DOUBLE AS y FROM customer) SELECT id, x > 10.5 AND x < 60.5 AND y > 20.5 AND y < 70.5 AND NOT (x - 10.5 < y - 20.5 AND x < 10.5) AS inside FROM p")
def j8_cells_in_polygon(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") * 17 % 103).cast("double").alias("x"), (F.col("c_custkey") * 29 % 89).cast("double").alias("y"))
    return J.cells_in_polygon(d, [(10.5, 20.5), (60.5, 20.5), (60.5, 70.5), (10.5, 70.5)]).select("id", "inside")


#: A polygon of six corners for each nation, some of them over others.
_CORNERS = ((0, 0), (20, 5), (12, 12), (25, 25), (5, 18), (-6, 9))
_POLYGONS = f"""po AS (SELECT n_nationkey AS poly_id, (n_nationkey * 7 % 83) + 0.5::DOUBLE AS cx, (n_nationkey * 11 % 71) + 0.5::DOUBLE AS cy FROM nation),
eg AS (SELECT poly_id, cx + e[1] AS ax, cy + e[2] AS ay, cx + e[3] AS qx, cy + e[4] AS qy FROM po, (SELECT unnest({[[*a, *b] for a, b in zip(_CORNERS, (*_CORNERS[1:], _CORNERS[0]), strict=True)]}) AS e)),
pt AS (SELECT c_custkey AS id, (c_custkey * 17 % 1030) / 10.0::DOUBLE AS x, (c_custkey * 29 % 890) / 10.0::DOUBLE AS y, c_acctbal / 1000 AS z FROM customer),
ins AS (SELECT id, poly_id FROM pt JOIN eg ON (ay > y) <> (qy > y) AND x < (qx - ax) * (y - ay) / (qy - ay) + ax GROUP BY id, poly_id HAVING count(*) % 2 = 1)"""


def _polygons(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    n, c = F.col("n_nationkey"), F.col("c_custkey")
    corners = F.array(*(F.struct((n * 7 % 83 + 0.5 + x).alias("x"), (n * 11 % 71 + 0.5 + y).alias("y")) for x, y in _CORNERS))
    points = table(spark, sf, "customer").select(c.alias("id"), (c * 17 % 1030 / 10).alias("x"), (c * 29 % 890 / 10).alias("y"), (F.col("c_acctbal").cast("double") / 1000).alias("z"))
    return points, table(spark, sf, "nation").select(n.alias("poly_id"), corners.alias("vertices"))


@query(f"WITH {_POLYGONS} SELECT id, poly_id FROM ins")
def j8_many_polygons(spark: SparkSession, sf: str) -> DataFrame:
    points, polygons = _polygons(spark, sf)
    return in_polygons(points, polygons, 2.0).select("id", "poly_id")


@query(f"WITH {_POLYGONS} SELECT id, (id IN (SELECT id FROM ins))::INT AS mask FROM pt")
def m14_polygon_mask(spark: SparkSession, sf: str) -> DataFrame:
    """A mask rasterised from all polygons."""
    points, polygons = _polygons(spark, sf)
    return mask_by_polygons(points, polygons, 2.0, ["id"]).select("id", "mask")


@query(f"""WITH {_POLYGONS}, lk AS (SELECT id, min(poly_id) AS lake FROM ins GROUP BY id), f AS (SELECT pt.id, z, lake, lake * 0.5::DOUBLE AS l FROM pt LEFT JOIN lk USING (id))
SELECT id, lake, round(CASE WHEN lake IS NULL THEN -1 ELSE l END, 6) AS level, round(CASE WHEN lake IS NULL THEN 0 ELSE least(greatest(l - z, 0), 2) END, 6) AS depth, round(CASE WHEN lake IS NOT NULL AND l - z > 2 THEN l - 2 ELSE z END, 6) AS z FROM f""")
def r20_fill_lakes(spark: SparkSession, sf: str) -> DataFrame:
    """Cells in lakes get their level; no deeper than 2."""
    points, polygons = _polygons(spark, sf)
    levels = polygons.select(F.col("poly_id").alias("lake"), (F.col("poly_id") * 0.5).alias("level"))
    out = fill_lakes_in(points, polygons.withColumnRenamed("poly_id", "lake"), levels, 2.0, ["id"], deepest=2.0)
    return rounded(out.select("id", "lake", "level", "depth", "z"))


@query("SELECT conv_id, CAST(s AS INT) AS slot, CASE WHEN turn + s - 1 < 0 THEN 0 WHEN turn + s - 1 > m THEN m ELSE turn + s - 1 END AS neighbour, turn FROM (SELECT conv_id, turn, max(turn) OVER (PARTITION BY conv_id) AS m, unnest(range(3)) AS s FROM conversations)")
def j15_frame_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    c = table(spark, sf, "conversations").select("conv_id", "turn", F.max("turn").over(Window.partitionBy("conv_id")).alias("max_frame"))
    return J.frame_neighbours(c, 3, "replicate", "turn").select("conv_id", "turn", "slot", "neighbour")


@query(f"{CELLS_SQL} SELECT vec_id, y, x, round(c.target, 6) AS target, s.n_name AS name FROM cells c LEFT JOIN nation s ON s.n_nationkey = c.patch_row")
def j2_join_static(spark: SparkSession, sf: str) -> DataFrame:
    static = table(spark, sf, "nation").select(F.col("n_nationkey").alias("patch_row"), F.col("n_name").alias("name"))
    return rounded(J.join_static(cells(spark, sf), static, ["patch_row"]).select("vec_id", "y", "x", "target", "name"))
