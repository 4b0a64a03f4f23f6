"""Rain, flow and inundation summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import finite
from .blocks import ROWS, Blocks
from .stats import exact_percentiles, histogram, masked_stats


def rain_mean_by_time(cells: DataFrame, ts: str = "ts", value: str = "depth") -> DataFrame:
    return cells.groupBy(ts).agg(F.avg(finite(value)).alias("mean"), F.max(finite(value)).alias("max"))


def rain_total_by_cell(cells: DataFrame, value: str = "depth") -> DataFrame:
    return cells.groupBy("y", "x").agg(F.sum(finite(value)).alias("total"))


def rain_summary(cells: DataFrame, value: str = "depth") -> DataFrame:
    """Overall extremes, mean, missing and total counts, and whether all rain is 0."""
    v = finite(value)
    return cells.agg(
        F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.count_if(v.isNull()).alias("missing"), F.count("*").alias("n"),
        F.coalesce(F.bool_and(v == 0), F.lit(False)).alias("all_zero"),
    )


def extreme_times(cells: DataFrame, threshold: float = 25.0, ts: str = "ts", value: str = "depth") -> DataFrame:
    """Times at which some cell is over the threshold."""
    return cells.groupBy(ts).agg(F.max(finite(value)).alias("max")).where(F.col("max") > threshold)


def flooded_area_volume(cells: DataFrame, by: list[str], thresholds: list[float], dx: float, h: str = "h", z: str | None = "zs") -> DataFrame:
    """Per threshold: area of cells deeper than it, and their water volume in all; beds under -1 are left out."""
    rows = cells if z is None else cells.where(~(F.col(z) - F.col(h) < -1))
    sums = [F.count_if(F.col(h) > t).alias(f"_{i}") for i, t in enumerate(thresholds)]
    out = rows.groupBy(*by).agg(*sums, (F.sum(h) * dx * dx).alias("volume"))
    each = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), (F.col(f"_{i}") * (dx * dx)).alias("area")) for i, t in enumerate(thresholds)])
    return out.select(*by, F.explode(each).alias("e"), "volume").select(*by, "e.threshold", "e.area", "volume")


def warming_change(area: DataFrame, by: list[str], value: str = "area", warming: str = "warming") -> DataFrame:
    """Percent change of each warming against warming 0."""
    base = area.where(F.col(warming) == 0).select(*by, F.col(value).alias("_base"))
    out = area.where(F.col(warming) > 0).join(base, by, "left")
    return out.select(*by, warming, value, (100 * F.try_divide(F.col(value) - F.col("_base"), F.col("_base"))).alias("percent"))


def peak_by_duration(flows: DataFrame, location: str = "location", reach: str = "reach_id") -> DataFrame:
    """Largest flow (not under 0) of each location, return period, duration and reach."""
    return flows.groupBy(location, "ari", "duration", reach).agg(F.max(F.greatest(F.col("flow"), F.lit(0.0))).alias("peak"))


def worst_duration(peaks: DataFrame, by: list[str], ari: int = 100) -> DataFrame:
    """The duration with the largest peak of one return period; the shortest of equals."""
    rows = peaks.where(F.col("ari") == ari)
    return rows.groupBy(*by).agg(F.max_by("duration", F.struct(F.col("peak"), -F.col("duration"))).alias("duration"), F.max("peak").alias("peak"))


def peak_table_pivot(peaks: DataFrame, by: list[str], durations: list[int]) -> DataFrame:
    """One column per duration (named, so no pass is spent on finding them)."""
    return peaks.groupBy(*by).pivot("duration", durations).agg(F.max("peak"))


def rain_ari_for_flow(peaks: DataFrame, by: list[str], target: str = "target", q: str = "peak", low: float = 2.0, high: float = 250.0) -> DataFrame:
    """10 ^ (least-squares line of log10(ari) on flow, at the target flow), clipped to [2, 250]."""
    y, x = F.log10(F.col("ari").cast("double")), F.col(q)
    fit = peaks.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.max(target).alias(target))
    return fit.withColumn("ari", F.greatest(F.least(F.pow(F.lit(10.0), F.col("intercept") + F.col("slope") * F.col(target)), F.lit(high)), F.lit(low)))


def event_duration(basins: DataFrame, durations: list[int], factor: float = 2.0) -> DataFrame:
    """Shortest duration over ``factor`` * the longest time of concentration, else the longest; the
    reach with the largest flow. Basins without a positive flow or with a bad name are dropped: one
    that is a whole number or contains "missing".

    ``basins``: name, tocs array<double>, flows array<double>, reaches array<long>.
    """
    ds = F.array(*[F.lit(d) for d in sorted(durations)])
    fits = F.filter(ds, lambda d: d > factor * F.array_max("tocs"))
    peak = F.array_max("flows")
    bad = F.col("name").rlike(r"^\s*[+-]?\d+\s*$") | F.col("name").contains("missing")
    out = basins.where(~bad & (peak > 0))
    return out.select("name", F.coalesce(F.get(fits, F.lit(0)), F.lit(max(durations))).alias("duration"), F.get("reaches", F.array_position("flows", peak).cast("int") - 1).alias("reach_id"), peak.alias("flow"))


def select_event(peaks: DataFrame, basins: DataFrame, by: str = "location", aris: tuple[int, ...] = (20, 50, 100), toc: str = "toc") -> DataFrame:
    """Among durations in [2, 4] times of concentration that have all return periods, the one with the largest peak."""
    whole = peaks.where(F.col("ari").isin(*aris)).groupBy(by, "duration").agg(F.count_distinct("ari").alias("n"), F.max("peak").alias("peak"))
    rows = whole.where(F.col("n") == len(aris)).join(basins.select(by, toc), by).where(F.col("duration").between(2 * F.col(toc), 4 * F.col(toc)))
    return rows.groupBy(by).agg(F.max_by("duration", F.struct(F.col("peak"), -F.col("duration"))).alias("duration"), F.max("peak").alias("peak"))


def run_completeness(outputs: DataFrame, locations: DataFrame, runs: int = 4, by: str = "location") -> DataFrame:
    """Percent of the warming runs that are there, for the duration with most of them (the shortest of equals)."""
    found = outputs.groupBy(by, "duration").agg(F.count_distinct("warming").alias("n"))
    best = found.groupBy(by).agg(F.max(F.struct(F.col("n"), (-F.col("duration")).alias("d"))).alias("b"))
    out = locations.select(by).distinct().join(best, by, "left")
    return out.select(by, (100.0 * F.coalesce("b.n", F.lit(0)) / runs).alias("percent"), (-F.col("b.d")).alias("duration"))


def river_footprint(flows: DataFrame, points: DataFrame, reach: str = "reach_id") -> DataFrame:
    """Box around each injection point, with half a side of max(sqrt(peak / 0.5) / 2, 10)."""
    peak = flows.groupBy(reach).agg(F.max(F.greatest(F.col("flow"), F.lit(0.0))).alias("peak"))
    out = points.join(peak, reach).withColumn("half", F.greatest(F.sqrt(F.col("peak") / 0.5) / 2, F.lit(10.0)))
    return out.withColumns({"xmin": F.col("x") - F.col("half"), "xmax": F.col("x") + F.col("half"), "ymin": F.col("y") - F.col("half"), "ymax": F.col("y") + F.col("half")})


def peak_time(flows: DataFrame, by: list[str], ts: str = "ts", value: str = "flow") -> DataFrame:
    """The first time of the largest flow; rows without a time or a flow are passed over, NULL where none is left."""
    order = F.when(F.col(ts).isNotNull() & F.col(value).isNotNull(), F.struct(F.col(value), -F.unix_micros(ts)))
    return flows.groupBy(*by).agg(F.max_by(ts, order).alias(ts))


def simulation_end(peak: DataFrame, forcings: list[DataFrame], by: list[str], ts: str = "ts", hours: int = 24) -> DataFrame:
    """The least of the peak time + 24 h and the last time of each forcing."""
    ends = peak.select(*by, (F.col(ts) + F.expr(f"INTERVAL {hours} HOURS")).alias("end"))
    for f in forcings:
        ends = ends.unionByName(f.groupBy(*by).agg(F.max(ts).alias("end")))
    return ends.groupBy(*by).agg(F.min("end").alias("end"))


def peak_reference_time(flows: DataFrame, by: list[str], reach: str = "reach_id", ts: str = "ts") -> DataFrame:
    """The reach with the largest peak, the first time of that peak, and the first time of all less an hour."""
    top = flows.groupBy(*by).agg(F.max_by(F.struct(reach, ts), F.struct(F.col("flow"), -F.unix_micros(ts), -F.col(reach))).alias("p"), F.min(ts).alias("first"))
    return top.select(*by, F.col(f"p.{reach}").alias(reach), F.col(f"p.{ts}").alias("peak_ts"), (F.col("first") - F.expr("INTERVAL 1 HOUR")).alias("start"))


def cell_max_over_time(cells: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """``<v>max`` of each value and cell."""
    return cells.groupBy(*keys).agg(*[F.max(v).alias(f"{v}max") for v in values])


def running_max(cells: DataFrame, keys: list[str], values: list[str], ts: str = "ts", rows: int = ROWS) -> DataFrame:
    """The maxima since the start, at every step; nulls are passed over."""
    return Blocks(cells, keys, ts, rows).running({f"{v}max": v for v in values})


def extent_report(layers: DataFrame, layer: str = "layer", ts: str = "ts", value: str = "value") -> DataFrame:
    """Ranges of x, y and time, and counts, of each layer."""
    ends = [f(c).alias(f"{c}_{n}") for c in ("x", "y", ts) for n, f in (("min", F.min), ("max", F.max))]
    return layers.groupBy(layer).agg(*ends, F.count_if(finite(value).isNull()).alias("missing"), F.count("*").alias("n"))


def ensemble_flow(flows: DataFrame, how: str = "mean", reach: str = "reach_id", ts: str = "ts") -> DataFrame:
    """Mean or max over all members at each reach and time; negative flows are 0."""
    v = F.greatest(F.col("flow"), F.lit(0.0))
    return flows.groupBy(reach, ts).agg((F.avg(v) if how == "mean" else F.max(v)).alias("flow"), F.count("*").alias("members"))


def outliers(cells: DataFrame, limits: dict[str, float]) -> DataFrame:
    """Cells over the limit of their variable."""
    table = F.create_map(*[x for k, v in limits.items() for x in (F.lit(k), F.lit(float(v)))])
    return cells.withColumn("limit", table[F.col("var")]).where(F.col("value") > F.col("limit"))


def outlier_report(cells: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Moments and the five box numbers of each group."""
    box = exact_percentiles(cells, value, [0, 25, 50, 75, 100], by)
    return masked_stats(cells, by, value, None).join(box, by)


def outlier_histogram(cells: DataFrame, bins: int, low: float, high: float, value: str = "value") -> DataFrame:
    return histogram(cells, value, bins, low, high)


def polygon_areas(polygons: DataFrame, poly_id: str = "poly_id", vertices: str = "vertices") -> DataFrame:
    """Shoelace area of each outline; no shuffle."""
    v, n = F.col(vertices), F.size(vertices)
    cross = lambda i: F.get(v, i)["x"] * F.get(v, (i + 1) % n)["y"] - F.get(v, (i + 1) % n)["x"] * F.get(v, i)["y"]
    return polygons.withColumn("area", F.abs(F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda a, i: a + cross(i))) / 2)


def largest_polygon(polygons: DataFrame, by: list[str], poly_id: str = "poly_id") -> DataFrame:
    """The polygon with the largest area; the least id of equals."""
    rows = polygon_areas(polygons, poly_id)
    return rows.groupBy(*by).agg(F.max_by(poly_id, F.struct(F.col("area"), -F.col(poly_id))).alias(poly_id), F.max("area").alias("area"))


def deepest_corner(corners: DataFrame, poly_id: str = "poly_id", z: str = "z") -> DataFrame:
    """The outline corner with the lowest bed."""
    return corners.groupBy(poly_id).agg(F.min_by(F.struct("x", "y"), F.struct(z, "x", "y")).alias("c"), F.min(z).alias(z)).select(poly_id, "c.x", "c.y", z)


def domain_region(points: DataFrame, by: list[str], origin: tuple[float, float], cell: float, step: float) -> DataFrame:
    """Box of the points, snapped to the DEM's cells and a whole number of steps.

    min = origin + trunc((min - origin) / cell) * cell - cell / 2; max = min + (trunc((max - min) / step) + 1) * step.
    """
    trunc = lambda c: F.when(c < 0, F.ceil(c)).otherwise(F.floor(c))
    out = points.groupBy(*by).agg(*[f(c).alias(f"_{n}{c}") for c in ("x", "y") for n, f in (("lo", F.min), ("hi", F.max))])
    low = {c: o + trunc((F.col(f"_lo{c}") - o) / cell) * cell - cell / 2 for c, o in zip(("x", "y"), origin, strict=True)}
    return out.select(*by, *[low[c].alias(f"{c}min") for c in low], *[(low[c] + (trunc((F.col(f"_hi{c}") - low[c]) / step) + 1) * step).alias(f"{c}max") for c in low])
