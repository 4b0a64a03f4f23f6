"""Queries of the series, tide, hydrology, sampling, log and check operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import checks as U
from ..operators import hydro as H
from ..operators import joins as J
from ..operators import logs as L
from ..operators import sampling as W
from ..operators import series as T
from ..operators.stats import masked_stats, merge_stats
from ..operators.tides import LONGITUDES, predict_tide, select_constituents
from ..sources.adapters import CELLS_SQL, FLOWS_SQL, INDEX_SQL, PEAKS_SQL, cells, flows, patch_index, peaks, scenario_of, table
from ..streaming.streams import drain, stream_masked_stats
from .registry import query, rounded

_HOURS = "epoch_us(ts) / 3600000000.0::DOUBLE"
_EPS = "1e-12::DOUBLE"


# sampling -----------------------------------------------------------------------------------------


@query(f"{INDEX_SQL}, r AS (SELECT row_id, scenario, row_number() OVER (PARTITION BY scenario ORDER BY md5('61:' || row_id), row_id) AS k, count(*) OVER (PARTITION BY scenario) AS n FROM idx) SELECT row_id, scenario, CASE WHEN k <= greatest(1, round_even(n * 0.1::DOUBLE, 0)) THEN 'val' ELSE 'train' END AS split FROM r")
def w1_train_val_split(spark: SparkSession, sf: str) -> DataFrame:
    return W.train_val_split(patch_index(spark, sf), seed=61).select("row_id", "scenario", "split")


@query(f"{INDEX_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY scenario, t ORDER BY price DESC, row_id) AS rank FROM idx) SELECT row_id, scenario, t, CAST(rank AS INT) AS rank FROM r WHERE rank <= 3")
def w3_top_k(spark: SparkSession, sf: str) -> DataFrame:
    return W.top_k(patch_index(spark, sf), "price", 3, ["scenario", "t"], ["row_id"]).select("row_id", "scenario", "t", "rank")


_P = "ps AS (SELECT vec_id, avg((target >= 0.1::DOUBLE)::INT) AS wet, avg((target >= 1)::INT) AS extreme FROM cells GROUP BY vec_id)"


def _patch_shares(spark: SparkSession, sf: str) -> DataFrame:
    c = cells(spark, sf)
    return c.groupBy("vec_id").agg(F.avg((F.col("target") >= 0.1).cast("int")).alias("wet"), F.avg((F.col("target") >= 1.0).cast("int")).alias("extreme"))


_WEIGHT = "least(0.5::DOUBLE + 2 * least(greatest((wet - 0.2::DOUBLE) / (0.6::DOUBLE - 0.2::DOUBLE), 0), 1) + 1.5::DOUBLE * least(extreme / 0.1::DOUBLE, 1) + (wet >= 0.5::DOUBLE)::INT, 4)"


@query(f"{CELLS_SQL}, {_P} SELECT vec_id, round({_WEIGHT}, 6) AS weight FROM ps")
def w5_sample_weights(spark: SparkSession, sf: str) -> DataFrame:
    scores = [
        {"column": "wet", "alpha": 2.0, "mode": "percentile", "lo": 0.2, "hi": 0.6},
        {"column": "extreme", "alpha": 1.5, "mode": "ratio", "reference": 0.1},
        {"column": "wet", "alpha": 1.0, "mode": "hard", "threshold": 0.5},
    ]
    return rounded(W.sample_weights(_patch_shares(spark, sf), scores, 0.5, 4.0).select("vec_id", "weight"))


@query(f"""{INDEX_SQL}, r AS (SELECT row_id, price AS w, CAST('0x' || substr(md5(CAST(row_id AS VARCHAR)), 1, 8) AS BIGINT) % 64 AS b FROM idx WHERE price > 0),
c AS (SELECT row_id, sum(w) OVER (ORDER BY b, row_id) AS hi FROM r), n AS (SELECT unnest(range((SELECT (count(*) + 3) // 4 * 4 FROM idx))) AS draw_id),
d AS (SELECT draw_id, CAST('0x' || substr(md5('draw:1:' || draw_id), 1, 13) AS BIGINT) / 4503599627370496::DOUBLE * (SELECT sum(w) FROM r) AS spot FROM n)
SELECT draw_id, draw_id % 4 AS replica, row_id FROM d ASOF JOIN c ON d.spot < c.hi""")
def w6_weighted_sample(spark: SparkSession, sf: str) -> DataFrame:
    rows = patch_index(spark, sf).select("row_id", "price")
    return W.weighted_sample(rows, "price", 1.0, 4, 1).select("draw_id", "replica", "row_id")


@query(f"{INDEX_SQL}, c AS (SELECT row_id, unnest(range(2)) AS copy FROM idx) SELECT row_id, copy::INT AS copy, row_number() OVER (ORDER BY md5('shuffle:3:' || copy || ':' || row_id), copy, row_id) - 1 AS position FROM c")
def w7_enlarged_shuffle(spark: SparkSession, sf: str) -> DataFrame:
    return W.enlarged_shuffle(patch_index(spark, sf).select("row_id"), 2, 1, 3).select("row_id", "copy", "position")


# series -------------------------------------------------------------------------------------------

_EX = "x AS (SELECT *, lag(flow) OVER w AS a, lead(flow) OVER w AS b FROM flows WINDOW w AS (PARTITION BY reach_id ORDER BY ts))"


@query(f"{FLOWS_SQL[:-1]}, {_EX} SELECT reach_id, round(flow, 6) AS flow, CASE WHEN coalesce(flow > a, true) AND coalesce(flow > b, true) THEN 'high' ELSE 'low' END AS kind FROM x WHERE (a IS NOT NULL OR b IS NOT NULL) AND ((coalesce(flow > a, true) AND coalesce(flow > b, true)) OR (coalesce(flow < a, true) AND coalesce(flow < b, true)))")
def w8_local_extrema(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(T.local_extrema(flows(spark, sf), ["reach_id"], value="flow").select("reach_id", "flow", "kind"))


@query(f"{FLOWS_SQL[:-1]}, v AS (SELECT reach_id, ts, flow - 50 AS v FROM flows), x AS (SELECT *, CASE WHEN v > 0 AND lead(v) OVER (PARTITION BY reach_id ORDER BY ts) <= 0 THEN {_HOURS} END AS hit FROM v) SELECT reach_id, count(hit) AS crossings, round((max(hit) - min(hit)) / nullif(count(hit) - 1, 0), 6) AS mean_period_h, round(sqrt(avg(v * v)), 6) AS rms FROM x GROUP BY reach_id")
def w9_zero_downcrossing(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(T.zero_downcrossing(flows(spark, sf).withColumn("v", F.col("flow") - 50), ["reach_id"], value="v"))


@query("WITH r AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n FROM events) SELECT a.event_id, round(sum(b.value * CASE WHEN b.n = 0 THEN pow(0.9::DOUBLE, a.n) ELSE (1 - 0.9::DOUBLE) * pow(0.9::DOUBLE, a.n - b.n) END), 6) AS smoothed FROM r a JOIN r b ON a.user_id = b.user_id AND b.n <= a.n GROUP BY a.event_id")
def w11_smooth(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("event_id", F.col("user_id").alias("series"), F.col("value").cast("double").alias("value"))
    return rounded(T.smooth(rows, ["series"], 0.9, "event_id").select("event_id", "smoothed"))


@query("WITH m AS (SELECT user_id, event_id, value, max(value) OVER (PARTITION BY user_id ORDER BY event_id) AS best FROM events) SELECT user_id, event_id, round(best, 6) AS best_value, (SELECT max(e.event_id) FROM events e WHERE e.user_id = m.user_id AND e.event_id <= m.event_id AND e.value = m.best) AS best_step FROM m")
def w12_best_metric_history(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("user_id", "event_id", F.col("value").cast("double").alias("value"))
    out = T.best_metric_history(rows, by=("user_id",), step="event_id")
    return rounded(out.select("user_id", "event_id", "best_value", "best_step"))


@query("SELECT event_type AS kind, strftime(ts, '%Y-%m-%d') AS day, round(sum(value), 6) AS total, count(value) AS n FROM events GROUP BY ALL")
def w13_daily_totals(spark: SparkSession, sf: str) -> DataFrame:
    out = T.daily_totals(flows(spark, sf), ["kind"], value="flow")
    return rounded(out.select("kind", F.date_format("day", "yyyy-MM-dd").alias("day"), "total", "n"))


@query(f"{FLOWS_SQL} SELECT reach_id, round((epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY reach_id)) / 1e6::DOUBLE, 3) AS seconds, round(greatest(flow, 0), 6) AS flow FROM flows")
def w14_rising_series(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(T.rising_series(flows(spark, sf), ["reach_id"]).select("reach_id", F.round("seconds", 3).alias("seconds"), "flow"))


@query(f"{FLOWS_SQL} SELECT reach_id, kind, [round(v, 6) FOR v IN list(flow ORDER BY ts, flow)] AS values, count(*) AS n FROM flows GROUP BY ALL")
def w15_hydrograph_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(T.hydrograph_matrix(flows(spark, sf), ["reach_id", "kind"]))


@query(f"{FLOWS_SQL}, k AS (SELECT reach_id, kind, flow, row_number() OVER (PARTITION BY reach_id, kind ORDER BY ts, flow) - 1 AS k FROM flows) SELECT reach_id, kind, CAST(k // 16 AS INT) AS block, [round(v, 6) FOR v IN list(flow ORDER BY k)] AS values, count(*) AS n FROM k GROUP BY ALL")
def w15_hydrograph_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(T.hydrograph_blocks(flows(spark, sf), ["reach_id", "kind"], size=16))


# tides --------------------------------------------------------------------------------------------

_TIDE = """WITH cs AS (SELECT s_suppkey % 5 AS node_id, 'c' || s_suppkey AS name, 0.03::DOUBLE + (s_suppkey % 11) * 0.005::DOUBLE AS freq, (s_suppkey % 7 + 1) / 10.0::DOUBLE AS amp, (s_suppkey * 31 % 360)::DOUBLE AS phase FROM supplier),
tm AS (SELECT DISTINCT o_orderdate AS ts FROM orders), h AS (SELECT ts, date_diff('microsecond', TIMESTAMP '2000-01-01', ts) / 3600000000.0::DOUBLE AS hours FROM tm)"""


def _tide(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("s_suppkey")
    c = table(spark, sf, "supplier").select((k % 5).alias("node_id"), F.concat(F.lit("c"), k.cast("string")).alias("name"), (0.03 + (k % 11) * 0.005).alias("freq"), ((k % 7 + 1) / 10.0).alias("amp"), (k * 31 % 360).cast("double").alias("phase"))
    return c, table(spark, sf, "orders").select(F.col("o_orderdate").cast("timestamp").alias("ts"))


@query(f"{_TIDE} SELECT node_id, strftime(ts, '%Y-%m-%d') AS day, round(sum(amp * cos(2 * pi() * freq * hours - radians(phase))), 4) AS level FROM cs, h GROUP BY node_id, ts")
def t1_predict_tide(spark: SparkSession, sf: str) -> DataFrame:
    out = T.predict_tide(*_tide(spark, sf))
    return rounded(out.select("node_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "level"), 4)


#: 37 constituents, the last 7 products of two others; satellites of the nations; nodes of 37 suppliers each.
_NODAL = """WITH co AS (SELECT k // 37 AS node_id, k % 37 AS i, (k % 7 + 1) / 10.0::DOUBLE AS amp, (k % 7 + 1) / 10.0::DOUBLE * (0.05::DOUBLE + (k % 9) * 0.3::DOUBLE) AS amp_ci, (k * 31 % 360)::DOUBLE AS phase,
  (k // 37 * 13 % 140) - 69.5::DOUBLE AS lat, (k // 37) * 0.1::DOUBLE AS mean, (k // 37 % 3) * 0.0001::DOUBLE AS slope FROM (SELECT s_suppkey - 1 AS k FROM supplier)),
se AS (SELECT *, 100 * amp * amp / sum(amp * amp) OVER (PARTITION BY node_id) AS energy, amp * amp / pow(amp_ci / 1.96::DOUBLE, 2) AS snr FROM co)"""

_NODAL_ROWS = f"""{_NODAL}, pr AS (SELECT i, i % 3 AS d0, i % 5 - 2 AS d1, i % 4 - 1 AS d2, i % 2 AS d3, 0 AS d4, i % 3 - 1 AS d5, (i % 4) * 0.25::DOUBLE AS se FROM range(30) r(i)),
te AS (SELECT i, i AS p, 1 AS k FROM range(30) r(i) UNION ALL SELECT i, i % 30 AS p, 1 AS k FROM range(30, 37) r(i) UNION ALL SELECT i, i * 2 % 30 AS p, CASE i % 2 WHEN 0 THEN 2 ELSE -1 END AS k FROM range(30, 37) r(i)),
sa AS (SELECT unnest([n_nationkey % 30, (n_nationkey * 3 + 1) % 30]) AS p, n_nationkey % 3 - 1 AS e0, n_nationkey % 2 AS e1, n_nationkey % 5 - 2 AS e2, (n_nationkey % 4) * 0.25::DOUBLE AS c, 0.01::DOUBLE * (n_nationkey % 7 + 1) AS r, n_nationkey % 3 AS f FROM nation),
tm AS (SELECT DISTINCT o_orderdate AS ts FROM orders), dy AS (SELECT ts, epoch_us(ts) / 86400000000.0::DOUBLE AS u, epoch_us(ts) / 86400000000.0::DOUBLE + 25567.5::DOUBLE AS d FROM tm),
a0 AS (SELECT ts, u, {", ".join(f"fmod(({c0}::DOUBLE + {c1}::DOUBLE * d + {c2}::DOUBLE * pow(d / 10000, 2) + {c3:.9f}::DOUBLE * pow(d / 10000, 3)) / 360, 1) AS {n}_" for n, (c0, c1, c2, c3) in LONGITUDES.items())} FROM dy),
a1 AS (SELECT *, fmod(u, 1) + h_ - s_ AS tau_ FROM a0),
la AS (SELECT node_id, sin(radians(CASE WHEN abs(max(lat)) < 5 THEN CASE WHEN max(lat) < 0 THEN -5 ELSE 5 END ELSE max(lat) END)) AS sl FROM co GROUP BY node_id),
st AS (SELECT ts, p, f, sum(r * cos(2 * pi() * a)) AS re, sum(r * sin(2 * pi() * a)) AS im FROM (SELECT ts, p, f, r, fmod(e0 * p_ + e1 * np_ + e2 * pp_ + c, 1) AS a FROM sa, a1) GROUP BY ts, p, f),
vv AS (SELECT ts, i AS p, fmod(d0 * tau_ + d1 * s_ + d2 * h_ + d3 * p_ + d4 * np_ + d5 * pp_ + pr.se, 1) AS v FROM pr, a1),
zz AS (SELECT vv.ts, vv.p, node_id, any_value(v) AS v, 1 + coalesce(sum(w * re), 0) AS re, coalesce(sum(w * im), 0) AS im FROM vv CROSS JOIN la LEFT JOIN
  (SELECT st.*, node_id AS nd, CASE f WHEN 0 THEN 1 WHEN 1 THEN 0.36309::DOUBLE * (1 - 5 * sl * sl) / sl ELSE 2.59808::DOUBLE * sl END AS w FROM st, la) x ON x.ts = vv.ts AND x.p = vv.p AND x.nd = node_id GROUP BY vv.ts, vv.p, node_id),
fu AS (SELECT ts, node_id, te.i, exp(sum(abs(k) * ln(sqrt(re * re + im * im)))) AS f, sum(k * (atan2(im, re) / (2 * pi()) + v)) AS a FROM te JOIN zz USING (p) GROUP BY ts, node_id, te.i)"""


def _nodal(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Coefficients, constituents and satellites; names have two digits, so that they sort as numbers do."""
    k = F.col("s_suppkey") - 1
    nd, amp = F.floor(k / 37), (k % 7 + 1) / 10.0
    name = lambda i: F.lpad(i.cast("string"), 2, "0")
    coefficients = table(spark, sf, "supplier").select(
        nd.alias("node_id"), name(k % 37).alias("name"), amp.alias("amp"), (amp * (0.05 + (k % 9) * 0.3)).alias("amp_ci"), (k * 31 % 360).cast("double").alias("phase"),
        (nd * 13 % 140 - 69.5).alias("lat"), (nd * 0.1).alias("mean"), ((nd % 3) * 0.0001).alias("slope"),
    )
    i = F.col("id")
    numbers = F.array(*(x.cast("double") for x in (i % 3, i % 5 - 2, i % 4 - 1, i % 2, i * 0, i % 3 - 1)))
    of = lambda j, c: F.struct(name(j).alias("name"), c.cast("double").alias("coef"))
    shallow = F.when(i >= 30, F.array(of(i % 30, F.lit(1)), of(i * 2 % 30, F.when(i % 2 == 0, 2).otherwise(-1))))
    constituents = spark.range(37).select(name(i).alias("name"), numbers.alias("doodson"), ((i % 4) * 0.25).alias("semi"), shallow.alias("shallow"))
    n = F.col("n_nationkey")
    satellites = table(spark, sf, "nation").select(
        F.explode(F.array(name(n % 30), name((n * 3 + 1) % 30))).alias("name"), F.array(*(x.cast("double") for x in (n % 3 - 1, n % 2, n % 5 - 2))).alias("deldood"),
        ((n % 4) * 0.25).alias("phcorr"), (0.01 * (n % 7 + 1)).alias("amprat"), (n % 3).cast("int").alias("ilatfac"),
    )
    return coefficients, constituents, satellites


@query(f"{_NODAL} SELECT node_id, lpad(CAST(i AS VARCHAR), 2, '0') AS name, round(snr, 6) AS snr, round(energy, 6) AS energy FROM se WHERE snr >= 2 AND energy >= 0.5::DOUBLE")
def t1_constituent_selection(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(select_constituents(_nodal(spark, sf)[0], 2.0, 0.5).select("node_id", "name", "snr", "energy"))


@query(f"""{_NODAL_ROWS} SELECT node_id, strftime(ts, '%Y-%m-%d') AS day, round(any_value(mean) + any_value(slope) * date_diff('microsecond', TIMESTAMP '2000-01-01', ts) / 86400000000.0::DOUBLE
+ sum(amp * f * cos(2 * pi() * a - radians(phase))), 4) AS level FROM se JOIN fu USING (node_id, i) WHERE snr >= 2 AND energy >= 0.5::DOUBLE GROUP BY node_id, ts""")
def t1_predict_tide_nodal(spark: SparkSession, sf: str) -> DataFrame:
    """With astronomical arguments, nodal corrections, products, selection and trend."""
    coefficients, constituents, satellites = _nodal(spark, sf)
    times = table(spark, sf, "orders").select(F.col("o_orderdate").cast("timestamp").alias("ts"))
    out = predict_tide(coefficients, times, constituents=constituents, satellites=satellites, min_snr=2.0, min_energy=0.5, trend="slope")
    return rounded(out.select("node_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "level"), 4)


@query(f"{FLOWS_SQL[:-1]}, {_EX}, k AS (SELECT reach_id, flow, CASE WHEN coalesce(flow > a, true) AND coalesce(flow > b, true) THEN 'high' WHEN coalesce(flow < a, true) AND coalesce(flow < b, true) THEN 'low' END AS kind FROM x WHERE a IS NOT NULL OR b IS NOT NULL) SELECT kind, [round(q, 6) FOR q IN quantile_cont(flow, [i / 100 FOR i IN range(101)])] AS levels, count(*) AS n FROM k WHERE kind IS NOT NULL GROUP BY kind")
def t3_exceedance_curve(spark: SparkSession, sf: str) -> DataFrame:
    out = T.exceedance_curve(T.local_extrema(flows(spark, sf), ["reach_id"], value="flow"), [], "flow")
    return rounded(out.select("kind", "levels", "n"))


# hydrology ----------------------------------------------------------------------------------------


@query(f"{CELLS_SQL}, v AS (SELECT CASE WHEN mask = 1 THEN target END AS v FROM cells) SELECT round(min(v), 6) AS min, round(max(v), 6) AS max, round(avg(v), 6) AS mean, count(*) FILTER (WHERE v IS NULL) AS missing, count(*) AS n, coalesce(bool_and(v = 0), false) AS all_zero FROM v")
def a18_rain_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(H.rain_summary(cells(spark, sf).select(F.when(F.col("mask") == 1, F.col("target")).alias("depth"))))


@query(f"{CELLS_SQL} SELECT time_index, round(avg(target), 6) AS mean, round(max(target), 6) AS max FROM cells GROUP BY time_index")
def a18_rain_mean_by_time(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(H.rain_mean_by_time(cells(spark, sf), "time_index", "target"))


@query(f"{CELLS_SQL} SELECT y, x, round(sum(target), 6) AS total FROM cells GROUP BY y, x")
def a18_rain_total_by_cell(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(H.rain_total_by_cell(cells(spark, sf), "target"))


@query(f"{CELLS_SQL} SELECT time_index, round(max(target), 6) AS max FROM cells GROUP BY time_index HAVING max(target) > 1.5::DOUBLE")
def a19_extreme_times(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(H.extreme_times(cells(spark, sf), 1.5, "time_index", "target"))


@query(f"{CELLS_SQL}, th AS (SELECT unnest([0.1::DOUBLE, 0.5::DOUBLE]) AS threshold) SELECT scenario, threshold, round((count(*) FILTER (WHERE target > threshold)) * 100.0::DOUBLE, 6) AS area, round(sum(target) * 100, 6) AS volume FROM cells, th WHERE NOT (u - target < -1) GROUP BY scenario, threshold")
def a20_flooded_area_volume(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(H.flooded_area_volume(cells(spark, sf), ["scenario"], [0.1, 0.5], 10.0, "target", "u"))


_AREA = f"{PEAKS_SQL}, ar AS (SELECT location, warming, sum(flow) AS area FROM peaks GROUP BY ALL)"


@query(f"{_AREA} SELECT a.location, a.warming, round(a.area, 4) AS area, round(100 * (a.area - b.area) / nullif(b.area, 0), 6) AS percent FROM ar a LEFT JOIN ar b ON a.location = b.location AND b.warming = 0 WHERE a.warming > 0")
def a21_warming_change(spark: SparkSession, sf: str) -> DataFrame:
    area = peaks(spark, sf).groupBy("location", "warming").agg(F.sum("flow").alias("area"))
    return H.warming_change(area, ["location"]).select("location", "warming", F.round("area", 4).alias("area"), F.round("percent", 6).alias("percent"))


_PK = f"{PEAKS_SQL}, pk AS (SELECT location, ari, duration, reach_id, max(greatest(flow, 0)) AS peak FROM peaks GROUP BY ALL)"


@query(f"{_PK} SELECT location, ari, duration, reach_id, round(peak, 6) AS peak FROM pk")
def a22_peak_by_duration(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(H.peak_by_duration(peaks(spark, sf)))


@query(f"{_PK}, r AS (SELECT location, duration, peak, row_number() OVER (PARTITION BY location ORDER BY peak DESC, duration) AS k FROM pk WHERE ari = 100) SELECT location, duration, round(peak, 6) AS peak FROM r WHERE k = 1")
def a22_worst_duration(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(H.worst_duration(H.peak_by_duration(peaks(spark, sf)), ["location"]))


@query(f"{_PK} SELECT location, ari, " + ", ".join(f"round(max(peak) FILTER (WHERE duration = {d}), 6) AS d{d}" for d in (6, 12, 18, 24)) + " FROM pk GROUP BY location, ari")
def a23_peak_table_pivot(spark: SparkSession, sf: str) -> DataFrame:
    out = H.peak_table_pivot(H.peak_by_duration(peaks(spark, sf)), ["location", "ari"], [6, 12, 18, 24])
    return rounded(out.withColumnsRenamed({str(d): f"d{d}" for d in (6, 12, 18, 24)}))


@query(f"{_PK}, f AS (SELECT location, regr_slope(log10(ari), peak) AS s, regr_intercept(log10(ari), peak) AS i, avg(peak) AS target FROM pk GROUP BY location) SELECT location, round(greatest(least(pow(10, i + s * target), 250), 2), 4) AS ari FROM f")
def a24_rain_ari_for_flow(spark: SparkSession, sf: str) -> DataFrame:
    p = H.peak_by_duration(peaks(spark, sf))
    p = p.join(p.groupBy("location").agg(F.avg("peak").alias("target")), "location")
    return H.rain_ari_for_flow(p, ["location"]).select("location", F.round("ari", 4).alias("ari"))


@query("""WITH b AS (SELECT n_name AS name, list((s_suppkey % 9 + 1)::DOUBLE ORDER BY s_suppkey) AS tocs, list(s_acctbal ORDER BY s_suppkey) AS flows, list(s_suppkey ORDER BY s_suppkey) AS reaches FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name)
SELECT name, coalesce([d FOR d IN [6, 12, 18, 24] IF d > 2 * list_max(tocs)][1], 24)::INT AS duration, reaches[list_position(flows, list_max(flows))] AS reach_id, round(list_max(flows), 6) AS flow FROM b WHERE list_max(flows) > 0""")
def a25_event_duration(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    row = F.struct(F.col("s_suppkey").alias("k"), (F.col("s_suppkey") % 9 + 1).cast("double").alias("toc"), F.col("s_acctbal").alias("q"))
    b = s.groupBy(F.col("n_name").alias("name")).agg(F.array_sort(F.collect_list(row)).alias("r"))
    b = b.select("name", F.transform("r", lambda x: x["toc"]).alias("tocs"), F.transform("r", lambda x: x["q"]).alias("flows"), F.transform("r", lambda x: x["k"]).alias("reaches"))
    return rounded(H.event_duration(b, [6, 12, 18, 24]))


@query(f"{_PK}, w AS (SELECT location, duration, count(DISTINCT ari) AS n, max(peak) AS peak FROM pk GROUP BY ALL), b AS (SELECT n_nationkey AS location, 3 + n_nationkey % 4 AS toc FROM nation), r AS (SELECT w.*, row_number() OVER (PARTITION BY w.location ORDER BY peak DESC, duration) AS k FROM w JOIN b USING (location) WHERE n = 3 AND duration BETWEEN 2 * toc AND 4 * toc) SELECT location, duration, round(peak, 6) AS peak FROM r WHERE k = 1")
def a26_select_event(spark: SparkSession, sf: str) -> DataFrame:
    b = table(spark, sf, "nation").select(F.col("n_nationkey").alias("location"), (F.col("n_nationkey") % 4 + 3).alias("toc"))
    return rounded(H.select_event(H.peak_by_duration(peaks(spark, sf)), b))


@query(f"{PEAKS_SQL}, f AS (SELECT location, duration, count(DISTINCT warming) AS n FROM peaks WHERE warming <> location % 3 GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY location ORDER BY n DESC, duration) AS k FROM f) SELECT n_nationkey AS location, round(100.0 * coalesce(n, 0) / 4, 6)::DOUBLE AS percent, duration FROM nation LEFT JOIN b ON b.location = n_nationkey AND k = 1")
def a27_run_completeness(spark: SparkSession, sf: str) -> DataFrame:
    outputs = peaks(spark, sf).where(F.col("warming") != F.col("location") % 3)
    return H.run_completeness(outputs, table(spark, sf, "nation").select(F.col("n_nationkey").alias("location")))


@query(f"{FLOWS_SQL[:-1]}, p AS (SELECT reach_id, max(greatest(flow, 0)) AS peak FROM flows GROUP BY reach_id) SELECT reach_id, round(greatest(sqrt(peak / 0.5::DOUBLE) / 2, 10), 6) AS half, round(reach_id * 3 - greatest(sqrt(peak / 0.5::DOUBLE) / 2, 10), 6) AS xmin FROM p")
def a28_river_footprint(spark: SparkSession, sf: str) -> DataFrame:
    f = flows(spark, sf)
    points = f.select("reach_id").distinct().select("reach_id", (F.col("reach_id") * 3.0).alias("x"), F.lit(0.0).alias("y"))
    return rounded(H.river_footprint(f, points).select("reach_id", "half", "xmin"))


@query(f"{FLOWS_SQL[:-1]}, pk AS (SELECT reach_id, arg_max(ts, flow) + INTERVAL 24 HOUR AS e FROM flows GROUP BY reach_id UNION ALL SELECT reach_id, max(ts) FROM flows GROUP BY reach_id) SELECT reach_id, strftime(min(e), '%Y-%m-%d %H:%M') AS until FROM pk GROUP BY reach_id")
def a29_simulation_end(spark: SparkSession, sf: str) -> DataFrame:
    f = flows(spark, sf)
    return H.simulation_end(H.peak_time(f, ["reach_id"]), [f], ["reach_id"]).select("reach_id", F.date_format("end", "yyyy-MM-dd HH:mm").alias("until"))


@query(f"{FLOWS_SQL[:-1]}, r AS (SELECT kind, reach_id, ts, row_number() OVER (PARTITION BY kind ORDER BY flow DESC, ts, reach_id) AS k, min(ts) OVER (PARTITION BY kind) AS first FROM flows) SELECT kind, reach_id, strftime(ts, '%Y-%m-%d %H:%M') AS peak, strftime(first - INTERVAL 1 HOUR, '%Y-%m-%d %H:%M') AS start FROM r WHERE k = 1")
def a30_peak_reference_time(spark: SparkSession, sf: str) -> DataFrame:
    out = H.peak_reference_time(flows(spark, sf), ["kind"])
    return out.select("kind", "reach_id", F.date_format("peak_ts", "yyyy-MM-dd HH:mm").alias("peak"), F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"))


@query(f"{CELLS_SQL} SELECT patch_row, patch_col, y, x, round(max(target), 6) AS targetmax, round(max(u), 6) AS umax FROM cells GROUP BY patch_row, patch_col, y, x")
def a31_cell_max_over_time(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(H.cell_max_over_time(cells(spark, sf), ["patch_row", "patch_col", "y", "x"], ["target", "u"]))


@query(f"{CELLS_SQL} SELECT scenario, y, x, vec_id, round(max(target) OVER w, 6) AS targetmax, round(max(u) OVER w, 6) AS umax FROM cells WINDOW w AS (PARTITION BY scenario, y, x ORDER BY vec_id)")
def a31_running_max(spark: SparkSession, sf: str) -> DataFrame:
    out = H.running_max(cells(spark, sf).select("scenario", "y", "x", "vec_id", "target", "u"), ["scenario", "y", "x"], ["target", "u"], "vec_id")
    return rounded(out.select("scenario", "y", "x", "vec_id", "targetmax", "umax"))


@query(f"{CELLS_SQL} SELECT scenario, min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max, min(time_index) AS time_index_min, max(time_index) AS time_index_max, count(*) FILTER (WHERE target = 0) AS missing, count(*) AS n FROM cells GROUP BY scenario")
def a32_extent_report(spark: SparkSession, sf: str) -> DataFrame:
    return H.extent_report(cells(spark, sf).withColumn("target", F.nullif("target", F.lit(0.0))), "scenario", "time_index", "target")


@query(f"{FLOWS_SQL} SELECT reach_id, strftime(ts, '%Y-%m-%d %H') AS hour, round(avg(greatest(flow, 0)), 6) AS flow, count(*) AS members FROM flows GROUP BY ALL")
def a33_ensemble_flow(spark: SparkSession, sf: str) -> DataFrame:
    f = flows(spark, sf).select("reach_id", F.date_format("ts", "yyyy-MM-dd HH").alias("hour"), "flow")
    return rounded(H.ensemble_flow(f, "mean", ts="hour"))


@query(f"{CELLS_SQL} SELECT vec_id, y, x, round(target, 6) AS value, 1.5::DOUBLE AS lim FROM cells WHERE target > 1.5::DOUBLE")
def a34_outliers(spark: SparkSession, sf: str) -> DataFrame:
    c = cells(spark, sf).withColumn("value", F.col("target"))
    return rounded(H.outliers(c, {"h": 1.5}).select("vec_id", "y", "x", "value", F.col("limit").alias("lim")))


_POLY = "WITH pg AS (SELECT c_custkey AS id, c_nationkey AS g, (c_custkey % 10)::DOUBLE AS x, (c_custkey % 7)::DOUBLE AS y, (1 + c_custkey % 13)::DOUBLE AS w, (1 + c_custkey % 5)::DOUBLE AS h FROM customer)"


def _polygons(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    x, y, w, h = ((v).cast("double") for v in (k % 10, k % 7, k % 13 + 1, k % 5 + 1))
    at = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    return table(spark, sf, "customer").select(k.alias("poly_id"), F.col("c_nationkey").alias("g"), F.array(at(x, y), at(x + w, y), at(x + w, y + h), at(x, y + h)).alias("vertices"))


@query(f"{_POLY}, r AS (SELECT g, id, w * h AS area, row_number() OVER (PARTITION BY g ORDER BY w * h DESC, id) AS k FROM pg) SELECT g, id AS poly_id, round(area, 6) AS area FROM r WHERE k = 1")
def a35_largest_polygon(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(H.largest_polygon(_polygons(spark, sf), ["g"]))


@query(f"{_POLY} SELECT id AS poly_id FROM pg WHERE x <= 5.5 AND x + w >= 4.5 AND y <= 3.5 AND y + h >= 2.5")
def j9_polygons_in_region(spark: SparkSession, sf: str) -> DataFrame:
    return J.polygons_in_region(_polygons(spark, sf), (4.5, 5.5, 2.5, 3.5)).select("poly_id")


_LO = "3 + trunc((min(x) - 3) / 2) * 2 - 1"


@query(f"{_POLY} SELECT g, round({_LO}, 6)::DOUBLE AS xmin, round({_LO} + (trunc((max(x) - ({_LO})) / 4) + 1) * 4, 6)::DOUBLE AS xmax FROM pg GROUP BY g")
def a36_domain_region(spark: SparkSession, sf: str) -> DataFrame:
    p = _polygons(spark, sf).select("g", F.col("vertices")[0]["x"].alias("x"), F.col("vertices")[0]["y"].alias("y"))
    return rounded(H.domain_region(p, ["g"], (3.0, 3.0), 2.0, 4.0).select("g", "xmin", "xmax"))


# checks and logs ----------------------------------------------------------------------------------


@query(f"{INDEX_SQL} SELECT row_id, scenario FROM idx WHERE row_id IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 4)")
def u1_rows_in_split(spark: SparkSession, sf: str) -> DataFrame:
    split = table(spark, sf, "lineitem").where("l_linenumber = 4").select(F.col("l_orderkey").alias("row_id"))
    return U.rows_in_split(patch_index(spark, sf), split).select("row_id", "scenario")


@query("SELECT k, 'a' AS side FROM (SELECT DISTINCT o_custkey AS k FROM orders EXCEPT SELECT c_custkey FROM customer) UNION ALL SELECT k, 'b' FROM (SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders)")
def u2_same_keys(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"))
    return U.same_keys(a, table(spark, sf, "customer").select(F.col("c_custkey").alias("k")), ["k"])


@query(f"WITH m AS (SELECT l_returnflag AS k, l_discount AS v FROM lineitem) SELECT k, count(v) AS n, round(min(v), 6) AS min, round(max(v), 6) AS max, round(avg(v), 6) AS mean, round(stddev_pop(v) + {_EPS}, 6) AS std FROM m GROUP BY k")
def u3_merge_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Moments of two halves of the table, merged."""
    rows = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("k"), F.col("l_discount").cast("double").alias("v"), "l_linenumber")
    return rounded(merge_stats([masked_stats(rows.where(t), ["k"], "v", None) for t in ("l_linenumber <= 2", "l_linenumber > 2")], ["k"]))


@query(f"{INDEX_SQL} SELECT scenario, var, t, patch_row, patch_col, count(*) AS n FROM idx GROUP BY ALL HAVING count(*) > 1")
def u4_check_unique(spark: SparkSession, sf: str) -> DataFrame:
    return U.check_unique(patch_index(spark, sf), ["scenario", "var", "t", "patch_row", "patch_col"])


@query("SELECT page_id FROM pages WHERE url NOT LIKE 'https:%'")
def u5_missing_files(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages").select("page_id", F.col("url").alias("path"))
    return U.missing_files(p, p.where("path LIKE 'https:%'")).select("page_id")


@query("SELECT count(*) AS rows, count(*) FILTER (WHERE starts_with(url, 'https://')) AS rows_changed, count(*) FILTER (WHERE starts_with(url, 'https://')) AS cells_changed FROM pages")
def f10_rewrite_counters(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").select("page_id", "url", F.lit(None).cast("string").alias("other"))
    return U.rewrite_prefixes(pages, [("https://www.", "s3://"), ("https://", "/mnt/")], ["url", "other"])[1]


@query("WITH ln AS (SELECT event_id, 'iter: ' || event_id || ' loss: ' || value AS value, value AS v FROM events WHERE user_id % 3 = 0 UNION ALL SELECT event_id, 'note iter: 1 loss: 2', NULL FROM events WHERE user_id % 3 <> 0) SELECT event_id, event_id + 1 AS step, round(v, 6) AS metric FROM ln WHERE starts_with(value, 'iter')")
def l1_extract_metrics(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    text = F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("iter: "), F.col("event_id").cast("string"), F.lit(" loss: "), F.col("value").cast("string"))).otherwise("note iter: 1 loss: 2")
    return rounded(L.extract_metrics(e.select("event_id", text.alias("value")), r"iter: (\d+) loss: ([-+0-9.eE]+)", True))


def _status(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    logs = e.where("user_id % 5 <> 0").select("user_id", F.when(F.col("event_id") % 97 == 0, F.concat(F.lit("Failed at "), F.col("event_id").cast("string"))).otherwise("ok").alias("value"))
    return L.run_status(logs, e.where("user_id % 4 = 0").select("user_id"), e.select("user_id"), ["user_id"])


_ST = "st AS (SELECT user_id, user_id % 5 <> 0 AS started, user_id % 4 = 0 AS success, count(*) FILTER (WHERE event_id % 97 = 0 AND user_id % 5 <> 0) AS errors FROM events GROUP BY user_id)"


@query(f"WITH {_ST} SELECT user_id, started, success, CAST(errors AS INT) AS errors FROM st")
def l2_run_status(spark: SparkSession, sf: str) -> DataFrame:
    return _status(spark, sf).withColumn("errors", F.size("errors"))


@query(f"WITH {_ST} SELECT user_id % 2 AS stage, count(*) FILTER (WHERE success) AS succeeded, count(*) FILTER (WHERE NOT success AND started AND errors > 0) AS failed, count(*) FILTER (WHERE NOT success AND started AND errors = 0) AS running, count(*) FILTER (WHERE NOT success AND NOT started) AS not_started FROM st GROUP BY 1")
def l3_status_summary(spark: SparkSession, sf: str) -> DataFrame:
    return L.status_summary(_status(spark, sf).withColumn("stage", F.col("user_id") % 2), ["stage"])


@query("SELECT user_id, round(max(value) FILTER (WHERE event_id % 2 = 0), 6) AS memory, round(max(value) FILTER (WHERE event_id % 2 = 1), 6) AS runtime FROM events GROUP BY user_id")
def l4_runtime_summary(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    text = F.concat(F.when(F.col("event_id") % 2 == 0, "Max memory = ").otherwise("Runtime = "), F.col("value").cast("string"), F.lit(" units"))
    return rounded(L.runtime_summary(e.select("user_id", text.alias("value")), ["user_id"], {"memory": "memory", "runtime": "Runtime"}))


@query(f"{CELLS_SQL}, m AS (SELECT scenario, CASE WHEN mask = 1 THEN target END AS v FROM cells) SELECT scenario, count(v) AS n, round(min(v), 6) AS min, round(max(v), 6) AS max, round(avg(v), 6) AS mean, round(stddev_pop(v) + 1e-12::DOUBLE, 6) AS std FROM m GROUP BY scenario")
def x1_stream_masked_stats(spark: SparkSession, sf: str) -> DataFrame:
    """The streaming form over the table's files as a stream, run until all are read."""
    stream = spark.readStream.schema(table(spark, sf, "embeddings").schema).parquet(f"{sf}/embeddings.parquet*")
    v = F.col("vec_id")
    e = stream.select(scenario_of(F.col("label")).alias("scenario"), v, F.posexplode("embedding").alias("pos", "e"))
    c = e.select("scenario", (F.greatest(F.col("e").cast("double"), F.lit(0.0)) * 5.0).alias("value"), ((F.col("pos") + v) % 5 != 0).cast("int").alias("mask"))
    return rounded(drain(stream_masked_stats(c, ["scenario"]), "complete").select("scenario", "n", "min", "max", "mean", "std"))
