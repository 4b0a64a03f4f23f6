"""Queries of the remaining joins, series, assembly and streaming operators."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import cells as M
from ..operators import joins as J
from ..operators import patchwise as V
from ..operators import sampling as W
from ..operators import score as S
from ..operators import series as T
from ..operators import stats as A
from ..sources.adapters import CELLS_SQL, FLOWS_SQL, INDEX_SQL, cells, flows, patch_index, scenario_of, table, vectors
from ..streaming.streams import checkpoint_path, drain, stream_best_metric, stream_cell_scores, stream_daily_rain
from .registry import query, rounded

KEYS = ["scenario", "t", "patch_row", "patch_col"]


@query(f"{INDEX_SQL} SELECT row_id, scenario, var, t, patch_row, patch_col FROM idx WHERE row_id = (SELECT min(row_id) FROM idx WHERE filtered_out = 0)")
def m3_select_patch(spark: SparkSession, sf: str) -> DataFrame:
    """The patch of the first active row, looked up by its key (which only that row has: its row_id is the column)."""
    idx = patch_index(spark, sf)
    r = idx.where("filtered_out = 0").orderBy("row_id").first()
    one = idx.withColumn("patch_col", F.col("row_id").cast("int"))
    return M.select_patch(one, r["scenario"], r["var"], r["t"], r["patch_row"], r["row_id"]).select("row_id", "scenario", "var", "t", "patch_row", F.lit(r["patch_col"]).alias("patch_col"))


@query("""WITH f AS (SELECT conv_id, 'out_' || (turn * 7 % 13) || '_' || turn || '.nc' AS path, turn FROM conversations),
a AS (SELECT conv_id, path, row_number() OVER (PARTITION BY conv_id ORDER BY turn * 7 % 13, turn) AS n FROM f), b AS (SELECT conv_id, turn AS time_index, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE role <> 'user')
SELECT a.conv_id, path, time_index FROM a JOIN b ON a.conv_id = b.conv_id AND a.n = b.n""")
def j3_align_timesteps(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    files = c.select("conv_id", F.concat(F.lit("out_"), (F.col("turn") * 7 % 13).cast("string"), F.lit("_"), F.col("turn").cast("string"), F.lit(".nc")).alias("path"))
    times = c.where("role <> 'user'").select("conv_id", F.col("turn").alias("time_index"))
    return J.align_timesteps(files, times, ["conv_id"]).select("conv_id", "path", "time_index")


_NEAR = "greatest(least(ceil({v} - 0.5::DOUBLE), 63), 0)"


@query(f"WITH tl AS (SELECT c_custkey AS id, (c_custkey % 60)::DOUBLE AS x, (c_custkey * 7 % 53)::DOUBLE AS y FROM customer) SELECT id, greatest(least(round_even({_NEAR.format(v='(x + x + 3) / 2')} - 1.5::DOUBLE, 0), 60), 0)::INT AS ci, greatest(least(round_even({_NEAR.format(v='(y + y + 3) / 2')} - 1.5::DOUBLE, 0), 60), 0)::INT AS cj FROM tl")
def j5_snap_coarse_window(spark: SparkSession, sf: str) -> DataFrame:
    x, y = (F.col("c_custkey") % 60).cast("double"), (F.col("c_custkey") * 7 % 53).cast("double")
    tiles = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), x.alias("x_min"), (x + 3).alias("x_max"), y.alias("y_min"), (y + 3).alias("y_max"))
    return J.snap_coarse_window(tiles, 0.0, 0.0, 1.0, 64, 64, 4).select("id", "ci", "cj")


@query("WITH s AS (SELECT CAST(s_suppkey // 10 AS INT) AS y, CAST(s_suppkey % 10 AS INT) AS x, s_acctbal AS z FROM supplier), g AS (SELECT unnest(range(12)) AS y), c AS (SELECT y, unnest(range(9)) AS x FROM g) SELECT CAST(c.y AS INT) AS y, CAST(c.x AS INT) AS x, round(s.z, 6) AS z FROM c LEFT JOIN s ON s.y = c.y - 1 AND s.x = c.x + 2")
def j6_place_on_canvas(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    static = table(spark, sf, "supplier").select(F.floor(k / 10).cast("int").alias("y"), (k % 10).cast("int").alias("x"), F.col("s_acctbal").alias("z"))
    return rounded(J.place_on_canvas(static, 2.0, -1.0, 12, 9).select("y", "x", "z"))


@query("""WITH s AS (SELECT CAST(s_suppkey // 10 AS INT) AS y, CAST(s_suppkey % 10 AS INT) AS x, s_acctbal AS z FROM supplier),
ax AS (SELECT unnest(range(12)) AS i), ks AS (SELECT unnest(range(10)) AS j),
near AS (SELECT i, j, abs(3.1::DOUBLE + 0.6::DOUBLE * i - j) AS d FROM ax, ks),
xs AS (SELECT i AS x, CASE WHEN 3.1::DOUBLE + 0.6::DOUBLE * i BETWEEN 0 AND 9 THEN (array_agg(j ORDER BY round(d, 9), j))[1] END AS sx FROM near GROUP BY i),
c AS (SELECT ys.x AS y, xs.x AS x, CASE WHEN ys.x < 10 THEN 9 - ys.x END AS sy, xs.sx AS sx FROM xs ys, xs)
SELECT CAST(c.y AS INT) AS y, CAST(c.x AS INT) AS x, round(s.z, 6) AS z FROM c LEFT JOIN s ON s.y = c.sy AND s.x = c.sx""")
def j6_place_on_axes(spark: SparkSession, sf: str) -> DataFrame:
    """A finer axis beside the static one, and one that runs the other way."""
    k = F.col("s_suppkey")
    static = table(spark, sf, "supplier").select(F.floor(k / 10).cast("int").alias("y"), (k % 10).cast("int").alias("x"), F.col("s_acctbal").alias("z"))
    ten = [float(i) for i in range(10)]
    return rounded(J.place_on_axes(static, [3.1 + 0.6 * i for i in range(12)], [9.0 - i for i in range(12)], ten, ten).select("y", "x", "z"))


@query(f"{CELLS_SQL}, p AS (SELECT c_custkey AS id, CAST(floor((c_custkey % 70) / 10.0::DOUBLE + 0.5::DOUBLE) AS INT) AS x, CAST(floor((c_custkey * 3 % 70) / 10.0::DOUBLE + 0.5::DOUBLE) AS INT) AS y FROM customer), s AS (SELECT x, y, count(*) AS n, avg(target) AS mean FROM cells GROUP BY x, y) SELECT id, n, round(mean, 6) AS mean FROM p JOIN s USING (x, y)")
def j11_sample_at_points(spark: SparkSession, sf: str) -> DataFrame:
    """Each gauge with the size and mean of its nearest cell's series."""
    k = F.col("c_custkey")
    points = table(spark, sf, "customer").select(k.alias("id"), ((k % 70) / 10.0).alias("px"), ((k * 3 % 70) / 10.0).alias("py"))
    series = cells(spark, sf).groupBy("y", "x").agg(F.count("*").alias("n"), F.avg("target").alias("mean"))
    return rounded(J.sample_at_points(series, points, 0.0, 0.0, 1.0).select("id", "n", "mean"))


@query("SELECT '/lq/p' || a.page_id || 'x4.png' AS lq_path, '/gt/p' || b.page_id || '.npy' AS gt_path FROM pages a JOIN pages b ON a.page_id = b.page_id AND a.url LIKE 'https:%' AND b.url LIKE '%/en/%'")
def j12_pair_manifests(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages")
    name = lambda a, b: F.concat(F.lit(a), F.col("page_id").cast("string"), F.lit(b)).alias("path")
    return J.pair_manifests(p.where("url LIKE 'https:%'").select(name("/lq/p", "x4.png")), p.where("url LIKE '%/en/%'").select(name("/gt/p", ".npy")), "{}x4")[0].select("lq_path", "gt_path")


@query("WITH l AS (SELECT l_orderkey AS position, 'f' || l_orderkey AS file, l_suppkey AS reach_id FROM lineitem) SELECT s_suppkey AS reach_id, arg_min(file, position) AS file FROM supplier LEFT JOIN l ON reach_id = s_suppkey GROUP BY s_suppkey")
def j13_find_reach_file(spark: SparkSession, sf: str) -> DataFrame:
    l = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("position")).agg(F.collect_set("l_suppkey").alias("reach_ids"))
    listing = l.withColumn("file", F.concat(F.lit("f"), F.col("position").cast("string")))
    return J.find_reach_file(listing, table(spark, sf, "supplier").select(F.col("s_suppkey").alias("reach_id"))).select("reach_id", "file")


@query(f"{CELLS_SQL} SELECT vec_id, CAST(sum((target >= 0.05::DOUBLE)::INT) AS BIGINT) AS wet FROM cells GROUP BY vec_id")
def j14_pair_velocity_depth(spark: SparkSession, sf: str) -> DataFrame:
    v = vectors(spark, sf)
    both = v.select("vec_id", *KEYS, F.lit("h").alias("var"), F.col("target").alias("values")).unionByName(v.select("vec_id", *KEYS, F.lit("u").alias("var"), F.col("u").alias("values")))
    out = J.pair_velocity_depth(both)
    return out.select("vec_id", F.aggregate("wet_mask", F.lit(0), lambda a, x: a + x).cast("long").alias("wet"))


@query("""WITH p AS (SELECT c_custkey AS poly_id, (c_custkey % 6)::DOUBLE AS x, (c_custkey % 5)::DOUBLE AS y FROM customer), i AS (SELECT unnest(range(12)) AS point),
o AS (SELECT poly_id, point, x + CASE WHEN point < 3 THEN point WHEN point < 6 THEN 3 WHEN point < 9 THEN 9 - point ELSE 0 END AS px, y + CASE WHEN point < 3 THEN 0 WHEN point < 6 THEN point - 3 WHEN point < 9 THEN 3 ELSE 12 - point END AS py FROM p, i),
d AS (SELECT s_suppkey // 10 AS y, s_suppkey % 10 AS x, s_acctbal / 1000 AS z FROM supplier),
s AS (SELECT o.*, z, bool_or(z IS NULL) OVER (PARTITION BY poly_id ORDER BY point) AS gone FROM o LEFT JOIN d ON d.x = o.px AND d.y = o.py)
SELECT poly_id, CAST(point AS INT) AS point, px, py, round(z, 6) AS z FROM s WHERE NOT gone AND z < 5""")
def j16_open_boundary_points(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    x, y = (k % 6).cast("double"), (k % 5).cast("double")
    at = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    polygons = table(spark, sf, "customer").select(k.alias("poly_id"), F.array(at(x, y), at(x + 3, y), at(x + 3, y + 3), at(x, y + 3)).alias("vertices"))
    n = F.col("s_suppkey")
    dem = table(spark, sf, "supplier").select(F.floor(n / 10).cast("int").alias("y"), (n % 10).cast("int").alias("x"), (F.col("s_acctbal") / 1000).alias("z"))
    return rounded(J.open_boundary_points(polygons, dem, 0.0, 0.0, 1.0, step=1.0, below=5.0))


@query(f"{CELLS_SQL} SELECT vec_id, y, x, round(target, 6) AS target FROM cells WHERE y < 6 AND x < 5")
def r5_crop_overlap(spark: SparkSession, sf: str) -> DataFrame:
    c = cells(spark, sf).select("vec_id", "y", "x", "target")
    return rounded(M.crop_overlap(c.where("x < 5"), c.where("y < 6"), ["vec_id"])[0].select("vec_id", "y", "x", "target"))


_LIST = "list({v} ORDER BY y, x)"


@query(f"""{CELLS_SQL}, p AS (
  SELECT vec_id, {_LIST.format(v="round((asinh(pred / 0.5::DOUBLE) - 0.2::DOUBLE) / (0.4::DOUBLE + 1e-12::DOUBLE), 4)")} AS coarse,
         {_LIST.format(v="round((asinh(target / 0.5::DOUBLE) - 0.2::DOUBLE) / (0.4::DOUBLE + 1e-12::DOUBLE), 4)")} AS fine, {_LIST.format(v="mask")} AS mask,
         {_LIST.format(v="round((patch_row + 0.1::DOUBLE * (y * 8 + x) - 1) / (2 + 1e-12::DOUBLE), 4)")} AS elevation,
         {_LIST.format(v="round((y * 8 + x) / 90.0::DOUBLE, 4)")} AS slope, {_LIST.format(v="round(0.01::DOUBLE * (patch_col + y * 8 + x), 4)")} AS aspect_cos
  FROM cells WHERE vec_id % 10 <> 0 GROUP BY vec_id)
SELECT * FROM p""")
def r22_assemble_samples(spark: SparkSession, sf: str) -> DataFrame:
    """The coarse channel, three of the static ones, and the fine target of every training patch, whole."""
    v = vectors(spark, sf)
    keys = ["scenario", "var", "t", "patch_row", "patch_col"]
    v = v.withColumn("t", F.concat("t", F.lit("_"), F.col("vec_id").cast("string")))
    index = v.select("vec_id", *keys, F.when(F.col("vec_id") % 10 == 0, "val").otherwise("train").alias("split"))
    patches = v.select(*keys, F.col("pred").alias("coarse_values"), F.col("target").alias("fine_values"), "mask")
    of = lambda f: F.transform(F.sequence(F.lit(0), F.lit(63)), f)
    layers = {
        "elevation": lambda i: F.col("patch_row") + 0.1 * i, "slope": lambda i: i.cast("double"), "aspect_cos": lambda i: 0.01 * (F.col("patch_col") + i),
        "roughness": lambda i: F.lit(0.0), "twi": lambda i: F.lit(0.0), "aspect_sin": lambda i: F.lit(0.0), "static_mask": lambda i: F.lit(1),
    }
    static = v.select("patch_row", "patch_col").distinct().select("patch_row", "patch_col", *[of(f).alias(c) for c, f in layers.items()])
    one = {"mean": 0.0, "std": 1.0}
    stats = {"target": {"mean": 0.2, "std": 0.4, "s": 0.5}, "elevation": {"mean": 1.0, "std": 2.0}, "roughness": one, "twi": one}
    out = V.assemble_samples(index, patches, static, stats, phase="train")
    chosen = {"coarse": F.col("coarse")[0], "fine": F.col("fine"), "elevation": F.col("static")[0], "slope": F.col("static")[2], "aspect_cos": F.col("static")[5]}
    return rounded(out.select(F.element_at(F.split("t", "_"), -1).cast("bigint").alias("vec_id"), "mask", *(c.alias(k) for k, c in chosen.items())), 4, signed=True)


@query(f"{INDEX_SQL} SELECT scenario, time_index, row_number() OVER (ORDER BY scenario, time_index) AS place FROM (SELECT DISTINCT scenario, time_index FROM idx)")
def w4_ordered_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Scenario and time levels in order; their number does not grow with the rows."""
    from pyspark.sql import Window

    levels = patch_index(spark, sf).select("scenario", "time_index", F.concat(F.lit("t"), F.col("time_index").cast("string")).alias("t")).distinct()
    place = F.row_number().over(Window.orderBy("scenario", C.time_sort_key("t"))).cast("bigint")
    return W.ordered_levels(levels).select("scenario", "time_index", place.alias("place"))


@query(f"""{CELLS_SQL}, s AS (SELECT scenario, y, x, (1700000000 + time_index::BIGINT * 3600) * 1000000 + vec_id AS ts, u AS z, target AS h FROM cells),
f AS (SELECT scenario, min(ts) AS ts FROM s GROUP BY scenario), d AS (SELECT s.scenario, y, x, row_number() OVER (PARTITION BY s.scenario ORDER BY h DESC, y, x) AS k FROM s JOIN f ON s.scenario = f.scenario AND s.ts = f.ts),
c AS (SELECT s.scenario, s.ts, z - avg(z) OVER (PARTITION BY s.scenario) AS v FROM s JOIN d ON s.scenario = d.scenario AND s.y = d.y AND s.x = d.x AND k = 1),
w AS (SELECT scenario, v, CASE WHEN v > 0 AND lead(v) OVER (PARTITION BY scenario ORDER BY ts) <= 0 THEN ts / 3.6e9::DOUBLE END AS hour FROM c),
o AS (SELECT scenario, count(hour) AS crossings, (max(hour) - min(hour)) / nullif(count(hour) - 1, 0) AS period, sqrt(avg(v * v)) AS rms FROM w GROUP BY scenario)
SELECT scenario, crossings, round(period, 6) AS mean_period_h, round(rms, 6) AS rms, coalesce(period > 10 AND period < 16 AND rms > 0.2::DOUBLE AND rms < 1.5::DOUBLE, false) AS passed FROM o""")
def w10_tide_check(spark: SparkSession, sf: str) -> DataFrame:
    # rows of one hour are a microsecond apart, so that the series has an order
    c = cells(spark, sf).withColumn("ts", F.timestamp_micros((F.lit(1_700_000_000) + F.col("time_index").cast("bigint") * 3600) * 1_000_000 + F.col("vec_id")))
    out = T.tide_check(c.select("scenario", "y", "x", "ts", F.col("u").alias("zs"), F.col("target").alias("h")), ["scenario"])
    return rounded(out)


_HIGH, _LOW = (f"(coalesce(flow {c} a, true) AND coalesce(flow {c} b, true))" for c in "><")


@query(f"{FLOWS_SQL[:-1]}, x AS (SELECT *, lag(flow) OVER w AS a, lead(flow) OVER w AS b FROM flows WINDOW w AS (PARTITION BY reach_id ORDER BY ts)) SELECT reach_id, CASE WHEN {_HIGH} THEN 'high' ELSE 'low' END AS kind, round(flow, 6) AS flow FROM x WHERE (a IS NOT NULL OR b IS NOT NULL) AND ({_HIGH} OR {_LOW}) AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12'")
def t2_high_low_tides(spark: SparkSession, sf: str) -> DataFrame:
    out = T.high_low_tides(flows(spark, sf), ["reach_id"], "2024-01-05", "2024-01-12", value="flow")
    return rounded(out.select("reach_id", "kind", "flow"))


@query(f"""{FLOWS_SQL[:-1]}, x AS (SELECT *, lag(flow) OVER w AS a, lead(flow) OVER w AS b FROM flows WINDOW w AS (PARTITION BY reach_id ORDER BY ts)),
h AS (SELECT reach_id, ts, flow FROM x WHERE (a IS NOT NULL OR b IS NOT NULL) AND coalesce(flow > a, true) AND coalesce(flow > b, true)),
q AS (SELECT reach_id, quantile_cont(flow, 0.99) AS q FROM h GROUP BY reach_id), n AS (SELECT h.reach_id, ts, row_number() OVER (PARTITION BY h.reach_id ORDER BY abs(flow - q), ts) AS k FROM h JOIN q ON h.reach_id = q.reach_id),
m AS (SELECT reach_id, flow, epoch_us(ts) // 1800000000 * 1800000000 AS slot FROM flows)
SELECT m.reach_id, count(*) AS n, round(avg(flow), 6) AS mean FROM m JOIN n ON n.reach_id = m.reach_id AND k = 1 AND abs(slot - epoch_us(n.ts)) <= 345600000000 GROUP BY m.reach_id""")
def t4_similar_tide(spark: SparkSession, sf: str) -> DataFrame:
    f = flows(spark, sf)
    highs = T.local_extrema(f, ["reach_id"], value="flow")
    minute = F.timestamp_micros(F.floor(F.unix_micros("ts") / 1_800_000_000).cast("bigint") * 1_800_000_000)
    return rounded(T.similar_tide(highs, f.withColumn("ts", minute), ["reach_id"], value="flow").groupBy("reach_id").agg(F.count("*").alias("n"), F.avg("flow").alias("mean")))


@query("""WITH cs AS (SELECT s_suppkey % 5 AS node_id, 0.03::DOUBLE + (s_suppkey % 11) * 0.005::DOUBLE AS freq, (s_suppkey % 7 + 1) / 10.0::DOUBLE AS amp, (s_suppkey * 31 % 360)::DOUBLE AS phase FROM supplier),
h AS (SELECT DISTINCT CAST(n_nationkey AS DOUBLE) AS hours FROM nation), nd AS (SELECT unnest(range(5)) AS node_id), g AS (SELECT unnest(range(12)) AS p),
d AS (SELECT p, node_id, row_number() OVER (PARTITION BY p ORDER BY sqrt(pow(p % 4 - node_id, 2) + pow(p // 4 - node_id * 0.5::DOUBLE, 2)), node_id) AS k FROM g, nd)
SELECT p AS point_id, d.node_id, hours, round(1 + sum(amp * cos(2 * pi() * freq * hours - radians(phase))), 4) AS level FROM d JOIN cs ON cs.node_id = d.node_id AND k = 1, h GROUP BY p, d.node_id, hours""")
def t5_map_tide(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    c = table(spark, sf, "supplier").select((k % 5).alias("node_id"), F.concat(F.lit("c"), k.cast("string")).alias("name"), (0.03 + (k % 11) * 0.005).alias("freq"), ((k % 7 + 1) / 10.0).alias("amp"), (k * 31 % 360).cast("double").alias("phase"))
    nodes = spark.range(5).select(F.col("id").alias("node_id"), F.col("id").cast("double").alias("x"), (F.col("id") * 0.5).alias("y"))
    start = F.lit("2000-01-01").cast("timestamp")
    times = table(spark, sf, "nation").select(F.timestamp_micros(F.unix_micros(start) + F.col("n_nationkey").cast("bigint") * 3_600_000_000).alias("ts"))
    out = T.map_tide(spark, (0.0, 3.0, 0.0, 2.0), 1.0, nodes, c, times, 1.0)
    return rounded(out.select("point_id", "node_id", ((F.unix_micros("ts") - F.unix_micros(start)) / 3.6e9).alias("hours"), "level"), 4)


@query(f"{CELLS_SQL} SELECT scenario, round((asinh(0.1::DOUBLE / 2) - avg(target)) / (stddev_pop(target) + 1e-12::DOUBLE + 1e-12::DOUBLE), 6) AS tau FROM cells GROUP BY scenario")
def f6_threshold_to_label_space(spark: SparkSession, sf: str) -> DataFrame:
    s = A.masked_stats(cells(spark, sf), ["scenario"], "target", None)
    tau = C.threshold_to_label_space(0.1, {"mean": F.col("mean"), "std": F.col("std"), "s": 2.0}, "asinh")
    return rounded(s.select("scenario", tau.alias("tau")))


def _event_stream(spark: SparkSession, sf: str) -> DataFrame:
    return spark.readStream.schema(table(spark, sf, "events").schema).parquet(f"{sf}/events.parquet*")


@query("SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, round(sum(value), 6) AS total, count(value) AS n FROM events WHERE ts < (SELECT date_trunc('day', max(ts) - INTERVAL 1 DAY) FROM events) GROUP BY ALL")
def x2_stream_daily_rain(spark: SparkSession, sf: str) -> DataFrame:
    """Days that the watermark has passed when the input ends."""
    e = _event_stream(spark, sf).select("event_type", F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("depth"))
    out = drain(stream_daily_rain(e, ["event_type"], "1 day"), "append")
    return rounded(out.select("event_type", F.date_format("day", "yyyy-MM-dd").alias("day"), "total", "n"))


@query("SELECT user_id, round(max(value), 6) AS best_value, arg_max(event_id, (value, event_id)) AS best_step FROM events GROUP BY user_id")
def x3_stream_best_metric(spark: SparkSession, sf: str) -> DataFrame:
    e = _event_stream(spark, sf).select("user_id", "event_id", "value")
    return rounded(drain(stream_best_metric(e, by=("user_id",), step="event_id"), "complete"))


@query(f"{CELLS_SQL} SELECT scenario, CAST(sum(mask) AS BIGINT) AS n, round(sqrt(sum(CASE WHEN mask = 1 THEN (pred - target) * (pred - target) ELSE 0 END) / (sum(mask) + 1e-12::DOUBLE)), 6) AS rmse FROM cells GROUP BY scenario")
def x4_stream_scores(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.readStream.schema(table(spark, sf, "embeddings").schema).option("maxFilesPerTrigger", 1000).parquet(f"{sf}/embeddings.parquet*")
    v = F.col("vec_id")
    rows = e.select(v, scenario_of(F.col("label")).alias("scenario"), F.posexplode("embedding").alias("pos", "e"))
    target = F.greatest(F.col("e").cast("double"), F.lit(0.0)) * 5.0
    c = rows.select("scenario", target.alias("target"), (target * (F.lit(0.8) + F.lit(0.02) * (v % 21))).alias("pred"), ((F.col("pos") + v) % 5 != 0).cast("int").alias("mask"))
    path = checkpoint_path(spark, f"scores-{uuid.uuid4().hex}")
    batches = []

    def sink(metrics: DataFrame, number: int) -> None:
        metrics.write.mode("overwrite").parquet(f"{path}/rows/{number}")
        batches.append(number)

    stream_cell_scores(c, sink, f"{path}/state", ("scenario",), once=True).awaitTermination()
    # each batch has the keys that changed: the latest of each counts
    rows = [spark.read.parquet(f"{path}/rows/{n}").withColumn("batch", F.lit(n)) for n in batches]
    every = reduce(DataFrame.unionByName, rows)
    latest = every.groupBy("scenario").agg(F.max("batch").alias("batch"))
    return rounded(every.join(latest, ["scenario", "batch"]).select("scenario", "n", "rmse"))
