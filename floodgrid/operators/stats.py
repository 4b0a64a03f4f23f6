"""Dataset statistics (A1-A17): partial aggregates that merge, and fixed-size histograms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import BANDS, EPS, asinh_scale, depth_band, finite, log1p_nonneg, ratio
from .blocks import join_same, written

#: Groups whose extremes are broadcast.
MOST_GROUPS = 10_000


def _masked(value: str, mask: str | None) -> Column:
    v = finite(value)
    return v if mask is None else F.when(F.col(mask) == 1, v)


def masked_stats(cells: DataFrame, by: list[str], value: str = "value", mask: str | None = "mask") -> DataFrame:
    """n, min, max, mean and population std (+ 1e-12) of the finite masked cells; an empty group has n = 0 and NULLs."""
    v = _masked(value, mask)
    return cells.groupBy(*by).agg(
        F.count(v).alias("n"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), (F.stddev_pop(v) + EPS).alias("std")
    )


def merge_stats(parts: list[DataFrame], by: list[str]) -> DataFrame:
    """Stats tables (n, min, max, mean, std) combined exactly, by means and squared deviations."""
    rows = reduce(DataFrame.unionByName, parts).where("n > 0")
    var = F.pow(F.col("std") - EPS, 2)
    first = rows.groupBy(*by).agg(
        F.sum("n").alias("n"), F.min("min").alias("min"), F.max("max").alias("max"),
        (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean"),
        (F.sum(F.col("n") * var) / F.sum("n")).alias("within"),
        F.collect_list(F.struct("n", "mean")).alias("_parts"),
    )
    between = F.aggregate("_parts", F.lit(0.0), lambda a, x: a + x["n"] * F.pow(x["mean"] - F.col("mean"), 2)) / F.col("n")
    return first.select(*by, "n", "min", "max", "mean", (F.sqrt(F.col("within") + between) + EPS).alias("std"))


def dataset_stats_levels(cells: DataFrame, value: str = "value", mask: str | None = "mask") -> DataFrame:
    """``masked_stats`` of patches, time steps, scenarios and the data set, with numbers of patches and times.

    Cells are summed up per patch; only those rows are grouped again. Empty patches count as patches.
    """
    keys = ["scenario", "t", "patch_row", "patch_col"]
    v = _masked(value, mask)
    patch = cells.groupBy(*keys).agg(
        F.count(v).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi"), F.coalesce(F.sum(v), F.lit(0.0)).alias("s"),
        F.coalesce(F.var_pop(v) * F.count(v), F.lit(0.0)).alias("m2"),
    )
    mean = F.try_divide(F.col("s"), F.col("n"))
    sets = [[F.col(k) for k in keys[:i]] for i in (4, 2, 1, 0)]
    summed = patch.groupingSets(sets, *[F.col(k) for k in keys]).agg(
        F.grouping_id().alias("_id"), F.sum("n").alias("n_cells"), F.min("lo").alias("min"), F.max("hi").alias("max"), F.sum("s").alias("_s"),
        F.sum("m2").alias("_m2"), F.sum(F.coalesce(F.col("n") * mean * mean, F.lit(0.0))).alias("_nm2"), F.count("*").alias("num_patches"),
        F.count_distinct(F.struct("scenario", "t")).alias("num_t"),
    )
    level = F.when(F.col("_id") == 0, "patch").when(F.col("_id") == 3, "time").when(F.col("_id") == 7, "scenario").otherwise("dataset")
    n = F.col("n_cells")
    total = F.try_divide(F.col("_s"), n)
    var = F.try_divide(F.col("_m2") + F.col("_nm2") - n * total * total, n)
    return summed.select(level.alias("level"), *keys, n.alias("n"), "min", "max", total.alias("mean"), (F.sqrt(F.greatest(var, F.lit(0.0))) + EPS).alias("std"), "num_patches", "num_t")


def histogram_percentile(df: DataFrame, col: str, qs: list[float], by: list[str] | None = None, bins: int = 8192) -> DataFrame:
    """Percentiles of a fixed-bin histogram over [min, max], one row per group and q.

    Two passes: extremes, then counts by bin; at most ``bins`` rows per group are shuffled. The
    extremes of up to MOST_GROUPS groups go through the driver to all tasks, those of more groups
    are joined. The value is that of the first bin whose running count reaches q / 100 * (n - 1); the error is at
    most one bin's width.
    """
    by = by or []
    values = df.select(*by, finite(col).alias("v")).where("v IS NOT NULL")
    ends = values.groupBy(*by).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    few = ends.take(MOST_GROUPS + 1)
    if len(few) <= MOST_GROUPS:
        ends = F.broadcast(df.sparkSession.createDataFrame(few, ends.schema))
    joined = values.join(ends, by) if by else values.crossJoin(ends)
    index = F.floor((F.col("v") - F.col("lo")) * (bins - 1) / (F.col("hi") - F.col("lo") + EPS)).cast("int")
    counts = joined.groupBy(*by, index.alias("bin")).agg(F.count("*").alias("n"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    group = Window.partitionBy(*by)
    run = counts.withColumns(
        {"cdf": F.sum("n").over(group.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum("n").over(group)}
    )
    out = run.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in qs])))
    hit = out.where(F.col("cdf") >= F.col("q") / 100 * (F.col("total") - 1))
    first = hit.groupBy(*by, "q").agg(F.min(F.struct("bin", "lo", "hi")).alias("m"))
    return first.select(*by, "q", (F.col("m.lo") + (F.col("m.hi") - F.col("m.lo")) * F.col("m.bin") / (bins - 1)).alias("value"))


#: Rows that one window ranks at most, unless they are equal.
RANKED = 1_000_000


def exact_percentiles(
    df: DataFrame, col: str, qs: list[float], by: list[str] | None = None, positive_only: bool = False, bins: int = 4096, ranked: int = RANKED
) -> DataFrame:
    """Linearly interpolated percentiles, q in 0..100; an array in the order of ``qs``, NULL for a group without values.

    Counts by bin between a group's extremes tell in which bins the wanted ranks lie. A wanted bin of more
    than ``ranked`` values that aren't all equal is cut into bins again, between its own extremes, all
    groups at once, until none is left: so outliers only cost another pass over the values of such bins,
    which are written between. Then only the values of wanted bins are counted one by one and ranked, and
    no task holds a group's. Up to MOST_GROUPS rows of extremes are broadcast, more are joined.
    """
    by = by or []
    own = [f"_by{i}" for i in range(len(by))]
    seg = [*own, "_seg"]
    v = finite(col).cast("double")
    rows = df.select(*[F.col(b).alias(k) for b, k in zip(by, own, strict=True)], (F.when(v > 0, v) if positive_only else v).alias("_v"))

    def settled(small: DataFrame) -> DataFrame:
        """A table of a few rows a group: through the driver if it is little, else written."""
        few = small.take(MOST_GROUPS + 1)
        return F.broadcast(df.sparkSession.createDataFrame(few, small.schema)) if len(few) <= MOST_GROUPS else written(small, "percentiles")

    groups = settled(rows.groupBy(*own).agg(F.count("_v").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")))
    shares = F.array(*[F.lit(q / 100) for q in qs])
    spot = lambda q: q * (F.col("_n") - 1)
    low = lambda q: F.floor(spot(q)).cast("bigint")
    ends = lambda q, i: F.array(F.struct((2 * i).alias("k"), low(q).alias("rank")), F.struct((2 * i + 1).alias("k"), F.least(low(q) + 1, F.col("_n") - 1).alias("rank")))
    wanted = F.flatten(F.transform(shares, ends))
    segments = groups.where("_n > 0").select(*own, F.lit("").alias("_seg"), "_lo", "_hi", wanted.alias("_hits"))
    within = lambda at: F.filter("_hits", lambda h: (h["rank"] >= at) & (h["rank"] < at + F.col("_c")))
    rows, done = rows.where("_v IS NOT NULL").withColumn("_seg", F.lit("")), None
    while True:
        span = F.col("_hi") / 2 - F.col("_lo") / 2  # halves, so that no difference is too large
        place = F.least(F.floor((F.col("_v") / 2 - F.col("_lo") / 2) / span * bins), F.lit(bins - 1))
        binned = join_same(rows, segments, seg).withColumn("_bin", F.when(span > 0, place).otherwise(F.lit(0)).cast("int"))
        counts = binned.groupBy(*seg, "_bin").agg(F.count("*").alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.first("_hits").alias("_hits"))
        at = F.sum("_c").over(Window.partitionBy(*seg).orderBy("_bin")) - F.col("_c")  # at most `bins` rows a segment
        found = counts.withColumn("_at", at).withColumn("_hits", within(F.col("_at"))).where(F.size("_hits") > 0)
        inner = F.transform("_hits", lambda h: F.struct(h["k"].alias("k"), (h["rank"] - F.col("_at")).alias("rank")))
        name = F.concat_ws(".", "_seg", F.col("_bin").cast("string")).alias("_seg")
        found = settled(found.select(*own, name, "_lo", "_hi", inner.alias("_hits"), "_c"))
        again = (F.col("_c") > ranked) & (F.col("_lo") < F.col("_hi"))
        inside = join_same(binned.select(*own, name, "_v"), found.select(*seg, "_hits", again.alias("_again")), seg)
        more = found.where(again).select(*own, "_seg", "_lo", "_hi", "_hits")
        last = more.isEmpty()
        if not last:
            inside = written(inside, "wanted")
        part = inside.where("NOT _again").drop("_again")
        done = part if done is None else done.unionByName(part)
        if last:
            break
        rows, segments = inside.where("_again").select(*seg, "_v"), more
    single = done.groupBy(*seg, "_v").agg(F.count("*").alias("_c"), F.first("_hits").alias("_hits"))
    before = F.sum("_c").over(Window.partitionBy(*seg).orderBy("_v")) - F.col("_c")
    picked = single.withColumn("_at", before).select(*own, "_v", F.explode(within(F.col("_at"))).alias("_h"))
    values = picked.groupBy(*own).agg(F.map_from_entries(F.collect_list(F.struct("_h.k", "_v"))).alias("_m"))
    part = lambda q, i: F.col("_m")[2 * i] + (F.col("_m")[2 * i + 1] - F.col("_m")[2 * i]) * (spot(q) - F.floor(spot(q)))
    out = join_same(groups, values, own, "left")
    return out.select(*[F.col(k).alias(b) for b, k in zip(by, own, strict=True)], F.when(F.col("_n") > 0, F.transform(shares, part)).alias("percentiles"))


def percentile_positive(df: DataFrame, col: str, q: float, fallback: float = 1.0) -> DataFrame:
    """Percentile of the positive values, ``fallback`` if there is none."""
    return exact_percentiles(df, col, [q], positive_only=True).select(F.coalesce(F.col("percentiles")[0], F.lit(fallback)).alias("value"))


def percentile_abs_nonzero(df: DataFrame, col: str, q: float, fallback: float = 1.0) -> DataFrame:
    return percentile_positive(df.select(F.abs(F.col(col)).alias(col)), col, q, fallback)


def percentile_range(df: DataFrame, col: str, low: float, high: float, min_width: float = 1e-6) -> DataFrame:
    """(low, high) percentiles, at least ``min_width`` apart."""
    p = F.col("percentiles")
    return exact_percentiles(df, col, [low, high]).select(p[0].alias("low"), F.greatest(p[1], p[0] + min_width).alias("high"))


def auto_limits(df: DataFrame, col: str, q: float = 99.0, floor: float = 1e-3) -> DataFrame:
    """Display limit: the percentile of positive values, else the maximum, at least ``floor``."""
    both = exact_percentiles(df, col, [q], positive_only=True).crossJoin(df.agg(F.max(finite(col)).alias("_max")))  # one row each
    return both.select(F.greatest(F.coalesce(F.col("percentiles")[0], F.col("_max"), F.lit(floor)), F.lit(floor)).alias("limit"))


def histogram(df: DataFrame, col: str, bins: int, low: float, high: float, by: list[str] | None = None) -> DataFrame:
    """Counts of equal-width bins of [low, high], the last one closed; bins without values have 0."""
    by = by or []
    v = finite(col)
    width = (high - low) / bins
    index = F.lit(0) if high <= low else F.least(F.floor((v - low) / F.lit(width)), F.lit(bins - 1)).cast("int")
    counted = df.where((v >= low) & (v <= high)).groupBy(*by, index.alias("bin")).agg(F.count("*").alias("n"))
    every = df.select(*by).distinct() if by else df.sparkSession.range(1).select()
    grid = every.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit((bins if high > low else 1) - 1))))
    return grid.join(counted, [*by, "bin"], "left").select(*by, "bin", (low + F.col("bin") * width).alias("left"), F.coalesce("n", F.lit(0)).alias("n"))


def value_counts(df: DataFrame, col: str, by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or []), F.col(col).alias("value")).agg(F.count("*").alias("n"))


def zero_count(df: DataFrame, col: str, by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or [])).agg(F.count_if(F.col(col) == 0).alias("zeros"), F.count(col).alias("n"))


def static_feature_stats(train: DataFrame, static: DataFrame, features: list[str]) -> DataFrame:
    """``masked_stats`` of static layers as the training rows see them, by feature.

    A layer is the same at every step, so its cells are counted with the number of training rows
    of their patch rather than joined to each of them. ``static``: patch_row, patch_col, mask and a
    column per feature, one row per cell.
    """
    times = train.groupBy("patch_row", "patch_col").agg(F.count("*").alias("w"))
    pairs = ", ".join(f"'{f}', CAST(`{f}` AS DOUBLE)" for f in features)
    long = static.join(times, ["patch_row", "patch_col"]).select("w", "mask", F.expr(f"stack({len(features)}, {pairs}) AS (feature, v)"))
    rows = long.where((F.col("mask") == 1) & finite("v").isNotNull())
    sums = rows.groupBy("feature").agg(
        F.sum("w").alias("n"), F.min("v").alias("min"), F.max("v").alias("max"), (F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("mean"),
        (F.sum(F.col("w") * F.col("v") * F.col("v")) / F.sum("w")).alias("_sq"),
    )
    return sums.select("feature", "n", "min", "max", "mean", (F.sqrt(F.greatest(F.col("_sq") - F.col("mean") * F.col("mean"), F.lit(0.0))) + EPS).alias("std"))


def aux_level_stats(cells: DataFrame, value: str = "value", grid: str = "grid") -> DataFrame:
    """Stats of the coarse grid, of the fine one, and of both together (``shared``)."""
    one = masked_stats(cells, [grid], value)
    both = masked_stats(cells.withColumn(grid, F.lit("shared")), [grid], value)
    return one.unionByName(both)


def depth_log1p_stats(cells: DataFrame, value: str = "value", grid: str = "grid") -> DataFrame:
    return aux_level_stats(cells.withColumn(value, log1p_nonneg(finite(value))), value, grid)


def _by_scale(cells: DataFrame, scales: DataFrame, value: Column, grid: str) -> DataFrame:
    """Stats of asinh(value / s) for each row (q, s) of ``scales`` and each grid."""
    rows = cells.crossJoin(F.broadcast(scales))  # one row per asked percentile
    return masked_stats(rows.withColumn("_a", asinh_scale(value, F.col("s") + EPS)), ["q", "s", grid], "_a")


def depth_asinh_stats(cells: DataFrame, qs: list[float], tau: float = 0.05, scope: str = "wet", value: str = "value", grid: str = "grid", bins: int = 8192) -> DataFrame:
    """Scales are percentiles of the fine grid's wet (or all) depths; a bad one is 1."""
    v = finite(value)
    fine = cells.where((F.col(grid) == "fine") & (F.col("mask") == 1))
    fine = fine.where(v >= tau) if scope == "wet" else fine
    found = histogram_percentile(fine, value, qs, bins=bins)
    asked = cells.sparkSession.createDataFrame([(float(q),) for q in qs], "q double")
    scales = asked.join(found, "q", "left").select("q", F.when(F.col("value") > 0, F.col("value")).otherwise(F.lit(1.0)).alias("s"))
    return _by_scale(cells, scales, F.when(v < 0, 0.0).otherwise(v), grid)


def velocity_asinh_stats(cells: DataFrame, qs: tuple[float, ...] = (90.0, 99.0), value: str = "value", grid: str = "grid", bins: int = 8192) -> DataFrame:
    """Percentiles of |v| by grid, and stats of asinh(v / s) with s the fine grid's first percentile."""
    inside = cells.where(F.col("mask") == 1).withColumn("_abs", F.abs(finite(value)))
    scale = histogram_percentile(inside.where(F.col(grid) == "fine"), "_abs", [qs[0]], bins=bins)
    scales = scale.select("q", F.when(F.col("value") > 0, F.col("value")).otherwise(F.lit(1.0)).alias("s"))
    return _by_scale(cells, scales, finite(value), grid)


def wet_ratio_pos_weight(cells: DataFrame, by: list[str], tau: float, value: str = "value", absolute: bool = False) -> DataFrame:
    """Wet share of the masked cells and dry / max(wet, 1)."""
    v = _masked(value, "mask")
    v = F.abs(v) if absolute else v
    n, wet = F.count(v), F.count_if(v >= tau)
    return cells.groupBy(*by).agg(n.alias("n"), wet.alias("wet"), ratio(wet, n).alias("wet_ratio"), ((n - wet) / F.greatest(wet, F.lit(1))).alias("pos_weight"))


def interval_stats(cells: DataFrame, by: list[str], limits: tuple[float, float, float], value: str = "value", absolute: bool = False, lower: float | None = None, wet_from: float | None = None) -> DataFrame:
    """Counts and shares of the four bands among the masked finite cells (from ``lower`` on, if given)."""
    v = _masked(value, "mask")
    v = F.abs(v) if absolute else v
    v = v if lower is None else F.when(v >= lower, v)
    band, n = depth_band(v, *limits), F.count(v)
    counts = {b: F.count_if(band == b) for b in BANDS} | {"wet": F.count_if(v >= (limits[0] if wet_from is None else wet_from))}
    return cells.groupBy(*by).agg(n.alias("valid_count"), *[c.alias(f"{b}_count") for b, c in counts.items()], *[ratio(c, n).alias(f"{b}_ratio") for b, c in counts.items()])


def patch_interval_stats(index: DataFrame, cells: DataFrame, keys: list[str], limits: tuple[float, float, float], var: str = "h", wet_from: float = 0.05) -> DataFrame:
    """``interval_stats`` (h >= 0) joined to the index; NULL for rows of other variables or filtered out."""
    stats = interval_stats(cells, keys, limits, lower=0.0, wet_from=wet_from)
    wanted = index.join(stats, keys, "left")
    ok = (F.lower("var") == var) & (F.col("filtered_out") == 0)
    return wanted.withColumns({c: F.when(ok, F.col(c)) for c in stats.columns if c not in keys})


def interval_summary(patches: DataFrame, split: DataFrame | None = None, qs: tuple[float, ...] = (50, 75, 90, 95, 99), row_id: str = "row_id") -> DataFrame:
    """One row per band: counts, share, patches above four shares, percentiles of all and of positive patches."""
    rows = patches if split is None else patches.join(split.select(row_id), row_id, "left_semi")
    names = [*BANDS, "wet"]
    pairs = ", ".join(f"'{b}', {b}_count, {b}_ratio" for b in names)
    long = rows.where("valid_count IS NOT NULL").select("valid_count", F.expr(f"stack({len(names)}, {pairs}) AS (band, n, r)"))
    out = long.groupBy("band").agg(
        F.sum("n").alias("count"), ratio(F.sum("n"), F.sum("valid_count")).alias("ratio"),
        F.count_if(F.col("r") > 0).alias("patches_positive"), *[F.count_if(F.col("r") >= x).alias(f"patches_{n}") for x, n in ((0.001, "0001"), (0.005, "0005"), (0.01, "001"))],
    )
    positive = exact_percentiles(long, "r", list(qs), ["band"], True).withColumnRenamed("percentiles", "percentiles_positive")
    return out.join(exact_percentiles(long, "r", list(qs), ["band"]), "band").join(positive, "band")


def finite_mean(df: DataFrame, by: list[str], cols: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(*[F.avg(finite(c)).alias(c) for c in cols])


def weighted_mean(df: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    """Mean of finite values with positive finite weights; NULL if there is none."""
    v, w = finite(value), finite(weight)
    ok = v.isNotNull() & (w > 0)
    return df.groupBy(*by).agg(F.try_divide(F.sum(F.when(ok, v * w)), F.sum(F.when(ok, w))).alias(value))
