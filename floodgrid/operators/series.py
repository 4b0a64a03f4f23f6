"""Time series and tides."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import ROWS, Blocks, join_same, written
from .joins import nearest_node
from .stats import exact_percentiles
from .tides import predict_tide


def local_extrema(series: DataFrame, by: list[str], ts: str = "ts", value: str = "value", rows: int = ROWS) -> DataFrame:
    """Rows that are strict maxima or minima (``kind`` high or low); an end counts if it beats its neighbour."""
    out = Blocks(series, by, ts, rows).neighbours(F.col(value), "_before", "_after")
    v, a, b = F.col(value), F.col("_before"), F.col("_after")
    beats = lambda up: (F.coalesce(v > a if up else v < a, F.lit(True)) & F.coalesce(v > b if up else v < b, F.lit(True)) & (a.isNotNull() | b.isNotNull()))
    return out.withColumn("kind", F.when(beats(True), "high").when(beats(False), "low")).drop("_before", "_after").where("kind IS NOT NULL")


def zero_downcrossing(series: DataFrame, by: list[str], ts: str = "ts", value: str = "value", rows: int = ROWS) -> DataFrame:
    """Per series: number of falls through 0 (v > 0, next <= 0), mean period in hours, and RMS."""
    at = F.unix_micros(ts) / F.lit(3.6e9)
    out = Blocks(series, by, ts, rows).neighbours(F.col(value), after="_after").withColumn("_at", F.when((F.col(value) > 0) & (F.col("_after") <= 0), at))
    period = F.try_divide(F.max("_at") - F.min("_at"), F.count("_at") - 1)
    return out.groupBy(*by).agg(F.count("_at").alias("crossings"), period.alias("mean_period_h"), F.sqrt(F.avg(F.col(value) * F.col(value))).alias("rms"))


def tide_check(cells: DataFrame, by: list[str], ts: str = "ts", z: str = "zs", h: str = "h", rows: int = ROWS) -> DataFrame:
    """The deepest cell's water level, less its mean, must swing like a tide: 10 < Tz < 16 h, 0.2 < Hrms < 1.5."""
    first = cells.groupBy(*by).agg(F.min(ts).alias("_first"))
    start = cells.join(first, by).where(F.col(ts) == F.col("_first"))
    deepest = start.groupBy(*by).agg(F.max_by(F.struct("y", "x"), F.struct(F.col(h), -F.col("y"), -F.col("x"))).alias("c")).select(*by, "c.y", "c.x")
    series = cells.join(deepest, [*by, "y", "x"], "left_semi").select(*by, ts, z)
    level = series.join(series.groupBy(*by).agg(F.avg(z).alias("_mean")), by).withColumn("_v", F.col(z) - F.col("_mean"))
    out = zero_downcrossing(level, by, ts, "_v", rows)
    ok = (F.col("mean_period_h") > 10) & (F.col("mean_period_h") < 16) & (F.col("rms") > 0.2) & (F.col("rms") < 1.5)
    return out.withColumn("passed", F.coalesce(ok, F.lit(False)))


def smooth(series: DataFrame, by: list[str], weight: float, order: str = "step", value: str = "value", rows: int = ROWS) -> DataFrame:
    """``smoothed``: weight * previous + (1 - weight) * value, from the first value on; a null repeats what was before."""
    return Blocks(series, by, order, rows).smoothed(value, weight, "smoothed")


def best_metric_history(df: DataFrame, better: str = "higher", by: tuple[str, ...] = ("dataset", "metric"), step: str = "iter", value: str = "value", rows: int = ROWS) -> DataFrame:
    """Best value so far and its step, for each step; the latest of equals; non-finite values are left out."""
    sign = 1 if better == "higher" else -1
    known = df.where(F.col(value).isNotNull() & (F.abs(value) < float("inf")) & ~F.isnan(value))
    best = F.struct((F.col(value) * sign).alias("v"), F.col(step).alias("i"))
    out = Blocks(known, list(by), step, rows).running({"_b": best})
    return out.withColumns({"best_value": F.col("_b.v") * sign, "best_step": F.col("_b.i")}).drop("_b")


def daily_totals(rain: DataFrame, by: list[str], ts: str = "ts", value: str = "depth", overlapping: bool = False) -> DataFrame:
    """Sums by calendar day; ``overlapping`` uses windows of 25 hours that begin every 24."""
    frame = F.window(ts, "25 hours", "24 hours") if overlapping else F.window(ts, "1 day")
    return rain.groupBy(*by, frame.alias("w")).agg(F.sum(value).alias("total"), F.count(value).alias("n")).select(*by, F.col("w.start").alias("day"), "total", "n")


def rising_series(flows: DataFrame, by: list[str], ts: str = "ts", value: str = "flow") -> DataFrame:
    """``seconds`` since the series' first time, and flow not under 0."""
    out = join_same(flows, flows.groupBy(*by).agg(F.min(F.unix_micros(ts)).alias("_first")), by)
    return out.withColumns({"seconds": (F.unix_micros(ts) - F.col("_first")) / F.lit(1e6), value: F.greatest(F.col(value), F.lit(0.0))}).drop("_first")


def hydrograph_blocks(flows: DataFrame, by: list[str], ts: str = "ts", value: str = "flow", size: int = 10_000, rows: int = ROWS) -> DataFrame:
    """``block`` (from 0), ``values``, ``n``: each series' values in order of time, ``size`` in a row (the last has what is left).

    Values of one time go by size, nulls first. Neither a series nor its row has to fit a task.
    """
    numbered = Blocks(flows, by, ts, rows).running({"_n": F.lit(1)}, "sum", ties=(F.col(value),))
    pairs = F.array_sort(F.collect_list(F.struct("_n", F.col(value).alias("v"))))
    block = F.floor((F.col("_n") - 1) / size).cast("int").alias("block")
    return numbered.groupBy(*by, block).agg(F.transform(pairs, lambda p: p["v"]).alias("values"), F.count(F.lit(1)).alias("n"))


def hydrograph_matrix(flows: DataFrame, by: list[str], ts: str = "ts", value: str = "flow", rows: int = ROWS) -> DataFrame:
    """One row per series: its values in order of time, for events that fit a row; others stay :func:`hydrograph_blocks`."""
    blocks = F.array_sort(F.collect_list(F.struct("block", "values")))
    return hydrograph_blocks(flows, by, ts, value, rows=rows).groupBy(*by).agg(F.flatten(F.transform(blocks, lambda b: b["values"])).alias("values"), F.sum("n").alias("n"))


def high_low_tides(series: DataFrame, by: list[str], begin: str, end: str, ts: str = "ts", value: str = "level", rows: int = ROWS) -> DataFrame:
    """Extrema of the series whose time lies in [begin, end]."""
    return local_extrema(series, by, ts, value, rows).where(F.col(ts).between(F.lit(begin).cast("timestamp"), F.lit(end).cast("timestamp")))


def exceedance_curve(tides: DataFrame, by: list[str], value: str = "level", kind: str = "kind") -> DataFrame:
    """Minimum, percentiles 1 to 99 and maximum of the highs and of the lows: ``levels`` has 101 values."""
    levels = exact_percentiles(tides, value, list(range(101)), [*by, kind]).withColumnRenamed("percentiles", "levels")
    return tides.groupBy(*by, kind).agg(F.count("*").alias("n")).join(levels, [*by, kind])


def similar_tide(highs: DataFrame, series: DataFrame, by: list[str], q: float = 99.0, days: int = 4, ts: str = "ts", value: str = "level", minutes: int = 30) -> DataFrame:
    """The series within ``days`` of the high tide nearest to the q-th percentile of highs, every ``minutes``."""
    highs = highs.where(F.col("kind") == "high")
    target = exact_percentiles(highs, value, [q], by).select(*by, F.col("percentiles")[0].alias("_q"))
    near = highs.join(target, by).groupBy(*by).agg(F.min_by(ts, F.struct(F.abs(F.col(value) - F.col("_q")), F.col(ts))).alias("peak"))
    out = series.join(near, by)
    inside = F.abs(F.unix_micros(ts) - F.unix_micros("peak")) <= days * 86_400_000_000
    return out.where(inside & (F.unix_micros(ts) % (minutes * 60_000_000) == 0))


def map_tide(
    spark, region: tuple[float, float, float, float], resolution: float, nodes: DataFrame, constituents: DataFrame, times: DataFrame, datum: float = 0.0,
    at_once: int = 1000, crowd: int = 100_000,
) -> DataFrame:
    """Levels on a regular grid: each point takes its nearest node's constituents.

    A node's levels are made once and packed, about ``at_once`` times a row; points meet the packed rows, and
    the result's rows are made behind the join. The points of a node that has over ``crowd`` of them (or
    over a ten-thousandth of all, so that such nodes are few) are dealt over several copies of its rows.
    """
    xmin, xmax, ymin, ymax = region
    nx, ny = (int(math.floor((b - a) / resolution + 1e-9)) + 1 for a, b in ((xmin, xmax), (ymin, ymax)))
    ids = spark.range(nx * ny).select(F.col("id").alias("point_id"), (xmin + (F.col("id") % nx) * resolution).alias("x"), (ymin + F.floor(F.col("id") / nx) * resolution).alias("y"))
    near = written(nearest_node(ids, nodes, "point_id", "node_id").select("point_id", "node_id"), "nearest-node")
    most = max(crowd, nx * ny // 10_000)
    counts = near.groupBy("node_id").agg(F.count(F.lit(1)).alias("_n"))
    crowded = F.broadcast(counts.where(F.col("_n") > most).select("node_id", F.ceil(F.col("_n") / most).alias("_copies")))  # at most 10,000 rows
    copies = F.coalesce("_copies", F.lit(1))
    chunks = max(1, math.ceil(times.select("ts").distinct().count() / at_once))
    levels = predict_tide(constituents.join(counts.select("node_id"), "node_id", "left_semi"), times)
    packed = levels.groupBy("node_id", F.pmod(F.xxhash64("ts"), F.lit(chunks)).alias("_chunk")).agg(F.collect_list(F.struct("ts", "level")).alias("_levels"))
    dealt = packed.join(crowded, "node_id", "left").withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("bigint"), copies - 1))).drop("_copies", "_chunk")
    # x and y are the rule's, so that they need not be carried along
    points = near.join(crowded, "node_id", "left").select("point_id", "node_id", F.pmod(F.xxhash64("point_id"), copies).alias("_copy"))
    points = points.withColumns({"x": xmin + (F.col("point_id") % nx) * resolution, "y": ymin + F.floor(F.col("point_id") / nx) * resolution})
    rows = points.join(dealt, ["node_id", "_copy"]).select("node_id", "point_id", "x", "y", F.inline("_levels"))
    return rows.withColumn("level", F.col("level") + datum)
