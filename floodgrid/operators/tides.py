"""Tide levels from constituents: selection, astronomical arguments, nodal corrections.

What depends on time alone (arguments, and the satellites' sums by the way that latitude weighs them)
is one array a time; what depends on the node alone (amplitudes, phases, latitude) is one array a
node. A (node, time) row meets both, so that nothing is shuffled by time and rows stay small.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Mean longitudes in degrees of the moon (s), the sun (h), the lunar perigee (p), the
#: lunar node, taken negative (np), and the solar perigee (pp). Terms of d, (d / 10000)^2 and
#: (d / 10000)^3 behind the constant; d is in days since 1899-12-31 12:00.
LONGITUDES = {
    "s": (270.434164, 13.1763965268, -0.0000850, 0.000000039),
    "h": (279.696678, 0.9856473354, 0.00002267, 0.000000000),
    "p": (334.329556, 0.1114040803, -0.0007739, -0.00000026),
    "np": (-259.183275, 0.0529539222, -0.0001557, -0.000000050),
    "pp": (281.220844, 0.0000470684, 0.0000339, 0.000000070),
}
#: How latitude weighs satellites of kind 1 (diurnal) and 2 (semidiurnal); under 5 degrees counts as 5.
DIURNAL, SEMIDIURNAL, LEAST_LATITUDE = 0.36309, 2.59808, 5.0
_EPOCH_DAYS = 25567.5  # from 1899-12-31 12:00 to 1970-01-01


def astronomy(ts: str | Column) -> dict[str, Column]:
    """tau, s, h, p, np and pp of a time, in cycles; their remainders have their own signs."""
    days = F.unix_micros(ts) / F.lit(8.64e10)
    d = days + F.lit(_EPOCH_DAYS)
    k = d / 10000
    out = {n: ((c0 + c1 * d + c2 * k * k + c3 * k * k * k) / 360) % 1 for n, (c0, c1, c2, c3) in LONGITUDES.items()}
    return {"tau": days % 1 + out["h"] - out["s"], **out}


def select_constituents(constituents: DataFrame, min_snr: float | None = None, min_energy: float | None = None, node: str = "node_id") -> DataFrame:
    """Those with signal to noise of ``min_snr`` and ``min_energy`` percent of the energy at least; adds ``snr`` and ``energy``.

    Signal to noise is amp^2 / (amp_ci / 1.96)^2 where the 95 % interval ``amp_ci`` is given, else the
    column ``snr`` as it is. Energy is the share of amp^2 in that of all of the node's constituents.
    """
    square = F.col("amp") * F.col("amp")
    out = constituents
    if "amp_ci" in out.columns:
        out = out.withColumn("snr", F.try_divide(square, F.pow(F.col("amp_ci") / 1.96, 2)))
    out = out.withColumn("energy", 100 * square / F.sum(square).over(Window.partitionBy(node)))
    if min_snr is not None:
        out = out.where(F.col("snr") >= min_snr)
    return out if min_energy is None else out.where(F.col("energy") >= min_energy)


def _dot(numbers: Column, astro: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [numbers[i] * F.col(c) for i, c in enumerate(astro)])


def _spread(times: DataFrame, ts: str) -> DataFrame:
    """The distinct times over all cores: few bytes of them make many rows."""
    spark = times.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return times.select(ts).distinct().repartition(tasks, ts)


def tide_waves(times: DataFrame, primaries: DataFrame, satellites: DataFrame, ts: str = "ts") -> DataFrame:
    """``ts``, ``waves``: for each primary constituent, by name, its argument ``v`` and its satellites' sums.

    ``primaries``: name, doodson array<double> (of tau, s, h, p, np, pp), semi (cycles). ``satellites``:
    name, deldood array<double> (of p, np, pp), phcorr (cycles), amprat, ilatfac (0, or how latitude
    weighs it). ``re`` and ``im`` hold a sum for each ilatfac.
    """
    own = satellites.groupBy("name").agg(F.collect_list(F.struct("deldood", "phcorr", "amprat", "ilatfac")).alias("satellites"))
    packed = primaries.select("name", "doodson", "semi").join(own, "name", "left")
    packed = packed.agg(F.array_sort(F.collect_list(F.struct("name", "doodson", "semi", F.coalesce("satellites", F.array()).alias("satellites")))).alias("_p"))
    astro = ["tau", *LONGITUDES]
    rows = _spread(times, ts).withColumns(astronomy(ts)).crossJoin(packed)  # one row

    def turned(c: Column) -> Column:
        angle = F.transform(c["satellites"], lambda s: F.struct(s["amprat"].alias("r"), s["ilatfac"].alias("k"), (2 * math.pi * ((_dot(s["deldood"], astro[3:]) + s["phcorr"]) % 1)).alias("a")))
        def of_kind(k: int) -> Column:
            return F.filter(angle, lambda s: s["k"] == k)
        def sums(f) -> Column:
            return F.array(*(F.aggregate(of_kind(k), F.lit(0.0), lambda t, s: t + s["r"] * f(s["a"])) for k in range(3)))
        return F.struct(c["name"].alias("name"), ((_dot(c["doodson"], astro) + c["semi"]) % 1).alias("v"), sums(F.cos).alias("re"), sums(F.sin).alias("im"))

    return rows.select(ts, F.transform("_p", turned).alias("waves"))


def _terms(constituents: DataFrame) -> DataFrame:
    """``name``, ``terms``: the primary constituents that each is made of, by place, and how often."""
    primary = F.col("shallow").isNull() | (F.size("shallow") == 0)
    places = constituents.where(primary).agg(F.array_sort(F.collect_list("name")).alias("_names"))  # one row
    parts = F.when(primary, F.array(F.struct("name", F.lit(1.0).alias("coef")))).otherwise(F.col("shallow"))
    place = lambda t: F.struct((F.array_position("_names", t["name"]) - 1).cast("int").alias("i"), t["coef"].cast("double").alias("coef"))
    return constituents.crossJoin(places).select("name", F.transform(parts, place).alias("terms"))


def predict_tide(
    coefficients: DataFrame, times: DataFrame, node: str = "node_id", ts: str = "ts", reference: str = "2000-01-01 00:00:00", constituents: DataFrame | None = None,
    satellites: DataFrame | None = None, min_snr: float | None = None, min_energy: float | None = None, trend: str | None = None,
) -> DataFrame:
    """Level of each node and time: mean + trend + the sum of A F cos(2 pi (U + V) - g).

    ``coefficients``: node, name, amp, phase (degrees) and where used mean, ``trend`` (per day since
    ``reference``), amp_ci or snr; without ``constituents`` also freq (cycles per hour), and then F = 1,
    U = 0 and V = freq * hours since the reference. Selection: see :func:`select_constituents`.

    ``constituents`` (name, doodson, semi, shallow array<struct<name, coef>>; see :func:`tide_waves`) and
    ``satellites`` give V and the nodal corrections F and U of the exact time at the node's ``lat``. One
    with ``shallow`` is a product of primary ones: F is the product of their F^abs(coef), U and V the
    sums of coef * U and coef * V. All are small tables; each (node, time) is one row.
    """
    c = coefficients if min_snr is None and min_energy is None else select_constituents(coefficients, min_snr, min_energy, node)
    mean = F.max("mean") if "mean" in c.columns else F.lit(0.0)
    slope = F.max(trend) if trend else F.lit(0.0)
    hours = (F.unix_micros(ts) - F.unix_micros(F.lit(reference).cast("timestamp"))) / F.lit(3.6e9)
    if constituents is None:
        packed = c.groupBy(node).agg(F.array_sort(F.collect_list(F.struct("name", "freq", "amp", "phase"))).alias("_c"), mean.alias("_m"), slope.alias("_s"))
        rows = _spread(times, ts).withColumn("_h", hours).crossJoin(packed)  # the result's rows
        turn = lambda x: x["amp"] * F.cos(2 * math.pi * x["freq"] * F.col("_h") - F.radians(x["phase"]))
    else:
        known = c.join(_terms(constituents), "name")
        packed = known.groupBy(node).agg(F.array_sort(F.collect_list(F.struct("name", "amp", "phase", "terms"))).alias("_c"), mean.alias("_m"), slope.alias("_s"), F.max("lat").alias("_lat"))
        lat = F.when(F.abs("_lat") < LEAST_LATITUDE, F.when(F.col("_lat") < 0, -LEAST_LATITUDE).otherwise(LEAST_LATITUDE)).otherwise(F.col("_lat"))
        packed = packed.withColumn("_sin", F.sin(F.radians(lat)))
        packed = packed.withColumn("_w", F.array(F.lit(1.0), DIURNAL * (1 - 5 * F.col("_sin") * F.col("_sin")) / F.col("_sin"), SEMIDIURNAL * F.col("_sin")))
        waves = tide_waves(times, constituents.where("shallow IS NULL OR size(shallow) = 0"), satellites, ts)
        rows = waves.withColumn("_h", hours).crossJoin(packed.drop("_lat", "_sin"))  # the result's rows

        def weighed(sums: Column) -> Column:
            return sums[0] + F.col("_w")[1] * sums[1] + F.col("_w")[2] * sums[2]

        def corrected(x: Column) -> Column:
            found = F.transform(x["terms"], lambda t: F.struct(t["coef"].alias("k"), F.get("waves", t["i"])["v"].alias("v"), (1 + weighed(F.get("waves", t["i"])["re"])).alias("re"), weighed(F.get("waves", t["i"])["im"]).alias("im")))
            start = F.struct(F.lit(1.0).alias("f"), F.lit(0.0).alias("a"))
            more = lambda s, t: F.struct((s["f"] * F.pow(F.hypot(t["re"], t["im"]), F.abs(t["k"]))).alias("f"), (s["a"] + t["k"] * (F.atan2(t["im"], t["re"]) / (2 * math.pi) + t["v"])).alias("a"))
            return F.struct(x["amp"].alias("amp"), x["phase"].alias("phase"), F.aggregate(found, start, more).alias("z"))

        rows = rows.withColumn("_c", F.transform("_c", corrected))
        turn = lambda x: x["amp"] * x["z"]["f"] * F.cos(2 * math.pi * x["z"]["a"] - F.radians(x["phase"]))
    level = F.aggregate("_c", F.lit(0.0), lambda a, x: a + turn(x))
    return rows.select(node, ts, (F.col("_m") + F.col("_s") * F.col("_h") / 24 + level).alias("level"))
