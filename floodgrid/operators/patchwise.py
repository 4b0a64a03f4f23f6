"""Per-patch helpers in numpy (R10, P20, P28) and compositions over patches.

A patch is one row, so a helper sees a few bounded arrays at a time and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .resample import block_mean, upsample_bilinear, upsample_nearest
from .score import confusion_full, score
from .stats import exact_percentiles, masked_stats


@lru_cache(maxsize=64)
def bicubic_weights(n: int, scale: float, antialias: bool = True) -> np.ndarray:
    """(ceil(n * scale), n) weights of a cubic kernel (a = -0.5), widened when shrinking, rows summing
    to 1; places beyond the edges are mirrored."""
    out = int(np.ceil(n * scale))
    wide = min(scale, 1.0) if antialias else 1.0
    centre = (np.arange(out) + 0.5) / scale - 0.5
    half = int(np.ceil(2 / wide)) + 1
    at = np.floor(centre).astype(int)[:, None] + np.arange(-half, half + 1)
    x = np.abs(centre[:, None] - at) * wide
    k = np.where(x <= 1, 1.5 * x**3 - 2.5 * x**2 + 1, np.where(x <= 2, -0.5 * x**3 + 2.5 * x**2 - 4 * x + 2, 0.0))
    k /= k.sum(axis=1, keepdims=True)
    mirrored = np.mod(at, 2 * n)
    mirrored = np.where(mirrored < n, mirrored, 2 * n - 1 - mirrored)
    weights = np.zeros((out, n))
    np.add.at(weights, (np.arange(out)[:, None], mirrored), k)
    return weights


def resize_bicubic(patches: DataFrame, scale: float, antialias: bool = True, value: str = "values") -> DataFrame:
    """Arrays resized by ``scale`` in both directions; a missing value spreads to the cells it reaches."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out, hs, ws = [], [], []
            for v, h, w in zip(frame[value], frame["h"], frame["w"], strict=True):
                grid = np.asarray(v, dtype=float).reshape(h, w)
                new = bicubic_weights(h, scale, antialias) @ grid @ bicubic_weights(w, scale, antialias).T
                out.append(new.ravel())
                hs.append(new.shape[0])
                ws.append(new.shape[1])
            yield frame.assign(**{value: out, "h": hs, "w": ws})

    fields = [f"`{f.name}` {'array<double>' if f.name == value else f.dataType.simpleString()}" for f in patches.schema]
    return patches.mapInPandas(run, ", ".join(fields))


def _ssim(a: np.ndarray, b: np.ndarray, most: float) -> float:
    """Mean over the valid area of an 11-tap Gaussian (sigma 1.5) window."""
    g = np.exp(-((np.arange(11) - 5.0) ** 2) / (2 * 1.5**2))
    g /= g.sum()

    def blur(x: np.ndarray) -> np.ndarray:
        x = np.lib.stride_tricks.sliding_window_view(x, len(g), axis=0) @ g
        return np.lib.stride_tricks.sliding_window_view(x, len(g), axis=1) @ g

    c1, c2 = (0.01 * most) ** 2, (0.03 * most) ** 2
    ma, mb = blur(a), blur(b)
    va, vb, cov = blur(a * a) - ma * ma, blur(b * b) - mb * mb, blur(a * b) - ma * mb
    return float((((2 * ma * mb + c1) * (2 * cov + c2)) / ((ma * ma + mb * mb + c1) * (va + vb + c2))).mean())


def ssim(pairs: DataFrame, by: list[str], crop: int = 0, most: float = 255.0) -> DataFrame:
    """Structural similarity of arrays a and b (h, w), averaged over the rows (bands) of each key."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            values = []
            for a, b, h, w in zip(frame["a"], frame["b"], frame["h"], frame["w"], strict=True):
                x, y = (np.asarray(v, float).reshape(h, w)[crop : h - crop or None, crop : w - crop or None] for v in (a, b))
                values.append(_ssim(x, y, most) if min(x.shape) >= 11 else None)
            yield frame[by].assign(ssim=values)

    keys = ", ".join(f"`{c}` {pairs.schema[c].dataType.simpleString()}" for c in by)
    rows = pairs.select(*by, "a", "b", "h", "w").mapInPandas(run, f"{keys}, ssim double")
    return rows.groupBy(*by).agg(F.avg("ssim").alias("ssim"))


#: Cells of the patches that are shifted together.
_STACK = 1 << 18


def best_shift(patches: DataFrame, threshold: float, max_shift: int = 3, fine: str = "fine", coarse: str = "coarse", mask: str | None = "mask") -> DataFrame:
    """CSI of the wet areas of two arrays on one grid for every shift of the fine one by (dy, dx) cells; the
    first best in (dy, dx) order.

    Cells count where the mask holds and both values are there; shifts without such cells are left
    out, and a patch without any has NULL. ``mask`` may be None.
    """
    span = range(-max_shift, max_shift + 1)

    def best_of(a: np.ndarray, b: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """CSI (NaN for none), dy and dx of a stack of patches of one shape."""
        h, w = a.shape[1:]
        known, wet_a, wet_b = np.isfinite(a), a >= threshold, b >= threshold
        inside = inside & np.isfinite(b)
        best, place = np.full(len(a), np.nan), np.zeros((2, len(a)), int)
        for dy in span:
            for dx in span:
                # the cells of the coarse array that the shifted one covers, and where they come from
                at = (slice(None), slice(max(dy, 0), h + min(dy, 0)), slice(max(dx, 0), w + min(dx, 0)))
                source = (slice(None), slice(max(-dy, 0), h + min(-dy, 0)), slice(max(-dx, 0), w + min(-dx, 0)))
                ok = inside[at] & known[source]
                x, y = wet_a[source] & ok, wet_b[at] & ok
                some = ok.any(axis=(1, 2))
                csi = (x & y).sum(axis=(1, 2)) / np.maximum((x | y).sum(axis=(1, 2)), 1)
                better = some & ~(csi <= best)
                best[better] = csi[better]
                place[:, better] = [[dy], [dx]]
        return best, place[0], place[1]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame = frame.reset_index(drop=True)
            csi, dy, dx = np.full(len(frame), np.nan), np.zeros(len(frame), int), np.zeros(len(frame), int)
            for (h, w), own in frame.groupby(["h", "w"]).groups.items():
                each = max(1, _STACK // (h * w))
                for i in range(0, len(own), each):
                    rows = own[i : i + each]
                    def stack(c: str) -> np.ndarray:
                        return np.stack([np.asarray(v, float) for v in frame.loc[rows, c]]).reshape(-1, h, w)
                    inside = stack(mask) > 0.5 if mask else np.ones((len(rows), h, w), bool)
                    csi[rows], dy[rows], dx[rows] = best_of(stack(fine), stack(coarse), inside)
            keep = [c for c in frame.columns if c not in (fine, coarse, mask)]
            none = np.isnan(csi)
            found = {"csi": pd.array(np.where(none, None, csi), "Float64"), "dy": pd.array(np.where(none, None, dy), "Int32"), "dx": pd.array(np.where(none, None, dx), "Int32")}
            yield frame[keep].assign(**found)

    keep = [f"`{f.name}` {f.dataType.simpleString()}" for f in patches.schema if f.name not in (fine, coarse, mask)]
    return patches.mapInPandas(run, ", ".join([*keep, "csi double, dy int, dx int"]))


def coarse_baseline_scores(coarse: DataFrame, fine: DataFrame, keys: list[str], s: int, config: dict[str, dict], by: list[str], mode: str = "nearest", shape: tuple[int, int] | None = None) -> DataFrame:
    """Scores of the upsampled coarse grid (``value``) against fine cells (``target``, ``mask``)."""
    if mode == "nearest":
        up = upsample_nearest(coarse.select(*keys, "y", "x", "value"), s)
    else:
        up = upsample_bilinear(coarse, keys, s, *shape)
    pairs = fine.join(up.withColumnRenamed("value", "pred"), [*keys, "y", "x"])
    return score(pairs, config, by)


def distribution_report(cells: DataFrame, by: list[str], values: list[str], bins: int = 50, mask: str | None = "mask") -> tuple[DataFrame, DataFrame]:
    """Moments and quantiles, and a histogram from least to largest value, of each named column (as ``layer``).

    The last bin holds the largest value; a layer of one value has one bin. Empty bins have no row.
    """
    pairs = ", ".join(f"'{v}', CAST(`{v}` AS DOUBLE)" for v in values)
    rows = cells.where(F.col(mask) > 0.5) if mask else cells
    long = rows.select(*by, F.expr(f"stack({len(values)}, {pairs}) AS (layer, value)"))
    keys = [*by, "layer"]
    moments = masked_stats(long, keys, "value", None).join(exact_percentiles(long, "value", [0, 1, 5, 25, 50, 75, 95, 99, 100], keys), keys)
    ends = long.groupBy(*keys).agg(F.min("value").alias("low"), F.max("value").alias("high"))
    place = F.floor((F.col("value") - F.col("low")) / (F.col("high") - F.col("low")) * bins)
    binned = long.where("value IS NOT NULL").join(ends, keys).withColumn("bin", F.when(F.col("high") > F.col("low"), F.least(place, F.lit(bins - 1))).otherwise(F.lit(0)).cast("int"))
    return moments, binned.groupBy(*keys, "low", "high", "bin").agg(F.count("*").alias("n"))


def alignment_scores(fine: DataFrame, coarse: DataFrame, keys: list[str], s: int, threshold: float, most_per_time: int | None = None, least_wet: float = 0.01) -> DataFrame:
    """Block-mean of the fine grid against the coarse one: MAE, RMSE, wet scores and shares.

    Patches whose larger wet share is under ``least_wet`` are dropped; with ``most_per_time`` only
    the wettest of each time stay (a display limit).
    """
    mean = block_mean(fine, keys, s).withColumnRenamed("value", "target")
    pairs = mean.join(coarse.withColumnRenamed("value", "pred"), [*keys, "y", "x"]).withColumn("mask", (F.col("target").isNotNull() & F.col("pred").isNotNull()).cast("int"))
    errors = pairs.where("mask = 1").groupBy(*keys).agg(F.avg(F.abs(F.col("pred") - F.col("target"))).alias("mae"), F.sqrt(F.avg(F.pow(F.col("pred") - F.col("target"), 2))).alias("rmse"))
    out = confusion_full(pairs, keys, threshold).join(errors, keys).withColumn("wet", F.greatest("pred_prevalence", "target_prevalence")).where(F.col("wet") >= least_wet)
    if most_per_time is None:
        return out
    time = [k for k in keys if k in ("scenario", "t")]
    rank = F.row_number().over(Window.partitionBy(*time).orderBy(F.desc("wet"), *keys))
    return out.withColumn("rank", rank).where(F.col("rank") <= most_per_time).drop("rank")


def tv_score(cells: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Mean absolute difference of neighbours along y plus that along x."""
    down = F.lead(value).over(Window.partitionBy(*keys, "x").orderBy("y"))
    right = F.lead(value).over(Window.partitionBy(*keys, "y").orderBy("x"))
    return cells.withColumns({"_d": F.abs(down - F.col(value)), "_r": F.abs(right - F.col(value))}).groupBy(*keys).agg((F.avg("_d") + F.avg("_r")).alias("tv"))


def assemble_samples(index: DataFrame, patches: DataFrame, static: DataFrame, stats: dict, aux: dict[str, DataFrame] | None = None, phase: str = "train", transform: str = "asinh", norm: str = "zscore") -> DataFrame:
    """One row per patch: normalised ``coarse`` channels, 7 ``static`` channels, ``fine`` target and mask.

    ``patches``: PATCH keys, coarse_values, fine_values, mask; ``static``: patch_row, patch_col and
    arrays elevation, roughness, slope, twi, aspect_sin, aspect_cos, mask. ``stats``: {"target",
    "elevation", "roughness", "twi", "zs"} of constants. Train and val take their split's rows; test
    keeps all and fills a missing fine map with 0. Velocity rows for training are masked by where
    the depth patch is wet, if ``patches`` has ``wet_mask``.
    """
    from ..functions.columns import normalise

    rows = index if phase == "test" else index.where(F.col("split") == phase)
    keys = ["scenario", "var", "t", "patch_row", "patch_col"]
    out = rows.join(patches, keys, "left" if phase == "test" else "inner").join(static, ["patch_row", "patch_col"], "left")
    scaled = lambda c, k, t="none", n="zscore": F.transform(c, lambda v: F.coalesce(normalise(v, stats[k], t, n), F.lit(0.0)))
    channels = [scaled("coarse_values", "target", transform, norm)]
    if aux and "zs" in aux:
        out = out.join(aux["zs"], keys, "left")
        channels.append(scaled("zs_values", "zs"))
    if aux and "dem" in aux:
        out = out.join(aux["dem"], ["patch_row", "patch_col"], "left")
        channels.append(scaled("dem_values", "elevation"))
    plain = lambda c: F.transform(c, lambda v: F.coalesce(v.cast("double"), F.lit(0.0)))
    statics = [scaled("elevation", "elevation"), scaled("roughness", "roughness"), F.transform("slope", lambda v: F.coalesce(v / 90.0, F.lit(0.0))), scaled("twi", "twi"), plain("aspect_sin"), plain("aspect_cos"), plain("static_mask")]
    zeros = F.transform("static_mask", lambda v: F.lit(0.0))
    fine = scaled("fine_values", "target", transform, norm)
    mask = F.transform(F.coalesce("mask", F.col("static_mask")), lambda v: v.cast("int"))
    if phase == "train" and "wet_mask" in out.columns:
        mask = F.when(F.lower("var").isin("u", "v"), F.zip_with(mask, "wet_mask", lambda a, b: a * b)).otherwise(mask)
    return out.select(*keys, F.array(*channels).alias("coarse"), F.array(*statics).alias("static"), F.coalesce(fine, zeros).alias("fine"), mask.alias("mask"))
