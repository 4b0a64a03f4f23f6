"""Long series in blocks against short ones whole, as-of joins and tides against plain Python."""

import bisect
import cmath
import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from floodgrid.operators import hydro as H
from floodgrid.operators import joins as J
from floodgrid.operators import sampling as W
from floodgrid.operators import series as T
from floodgrid.operators import stats as A
from floodgrid.operators import tides
from floodgrid.operators.blocks import Blocks, smoothed_values

START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def uneven(spark):
    """A hot series with most rows, half of them within a second of a month; short ones, null keys, null values."""
    rng = random.Random(4)
    spots = {int(rng.random() * 1e6) for _ in range(400)} | {int(rng.random() * 2.6e12) for _ in range(400)}
    rows = [("hot", t, rng.choice([None, rng.randint(-5, 5) / 2, float(rng.randint(-50, 50))])) for t in spots]
    rows += [(k, int(rng.random() * 2.6e12), rng.random() - 0.5) for k in ("a", "b", None) for _ in range(30)]
    rows += [("none", 5, None), ("one", 7, 1.0)]
    return spark.createDataFrame([(k, START + dt.timedelta(microseconds=t), t, v) for k, t, v in rows], "k string, ts timestamp, step long, value double").repartition(3)


def same(a, b):
    def rows(df):
        return sorted((tuple((x is None, round(x, 9) if isinstance(x, float) else x) for x in r) for r in df.collect()), key=str)

    assert a.columns == b.columns and rows(a) == rows(b)


def test_a_hot_series_lies_in_many_blocks(uneven):
    blocks = Blocks(uneven, ["k"], "ts", rows=50)
    sizes = blocks.df.groupBy("k", "_block").count().collect()
    hot = [r["count"] for r in sizes if r["k"] == "hot"]
    assert blocks.split and len(hot) >= 12 and max(hot) <= 100
    assert [r["_block"] for r in sizes if r["k"] != "hot"] == [0] * 5
    order = [r["_block"] for r in blocks.df.where("k = 'hot'").orderBy("ts").collect()]
    assert order == sorted(order)
    assert not Blocks(uneven, ["k"], "ts").split


@pytest.mark.parametrize("rows", [1, 40])
def test_blocks_change_no_result(uneven, rows):
    known = uneven.where("value IS NOT NULL")
    for f in (
        lambda r: T.local_extrema(known, ["k"], rows=r),
        lambda r: T.zero_downcrossing(known, ["k"], rows=r),
        lambda r: T.high_low_tides(known, ["k"], "2024-01-02", "2024-01-09", value="value", rows=r),
        lambda r: T.best_metric_history(uneven, by=("k",), step="step", rows=r),
        lambda r: T.best_metric_history(uneven, "lower", by=("k",), step="step", rows=r),
        lambda r: H.running_max(uneven, ["k"], ["value"], rows=r),
        lambda r: T.smooth(uneven, ["k"], 0.7, "step", rows=r),
        lambda r: T.local_extrema(known.where("k = 'hot'").drop("k"), [], rows=r),
        lambda r: H.running_max(uneven.select("step", "value"), [], ["value"], "step", rows=r),
    ):
        same(f(rows), f(10**6))


def test_smooth_is_the_recurrence(uneven):
    out = {}
    for r in T.smooth(uneven, ["k"], 0.7, "step", rows=30).orderBy("step").collect():
        out.setdefault(r["k"], []).append((r["value"], r["smoothed"]))
    for rows in out.values():
        state = None
        for v, got in rows:
            state = state if v is None else v if state is None else 0.7 * state + 0.3 * v
            assert (got is None and state is None) or got == pytest.approx(state, abs=1e-9)


@pytest.mark.parametrize("start", [None, 0.0, -3.5])
def test_smoothed_values_are_rounded_once(start):
    from fractions import Fraction

    rng = random.Random(2)
    for n in (0, 1, 2, 3, 64, 301):
        x = [rng.randint(-10_000, 10_000) / 100 for _ in range(n)]
        for weight in (0.0, 0.5, 0.9, 0.999, 1.0):
            w, state = Fraction(weight), None if start is None else Fraction(start)
            for v, got in zip(x, smoothed_values(np.array(x), weight, start), strict=True):
                state = Fraction(v) if state is None else w * state + (1 - w) * Fraction(v)
                assert abs(Fraction(float(got)) - state) <= Fraction(1, 2**51) * max(1, abs(state))
    inf = float("inf")
    assert smoothed_values(np.array([1.0, inf, 2.0, -inf, 1.0]), 0.5).tolist()[:3] == [1.0, inf, inf]
    assert np.isnan(smoothed_values(np.array([1.0, inf, 2.0, -inf, 1.0]), 0.5)[3:]).all()


@pytest.mark.parametrize("rows", [40, 10**6])
def test_hydrograph_blocks_are_bounded_and_join_to_whole_series(uneven, rows):
    blocks = T.hydrograph_blocks(uneven, ["k"], value="value", size=37, rows=rows).collect()
    whole = {r["k"]: r for r in T.hydrograph_matrix(uneven, ["k"], value="value", rows=rows).collect()}
    want = {}
    for r in uneven.orderBy("ts", F.asc_nulls_first("value")).collect():
        want.setdefault(r["k"], []).append(r["value"])
    assert {k: (r["values"], r["n"]) for k, r in whole.items()} == {k: (v, len(v)) for k, v in want.items()}
    for k, v in want.items():
        own = sorted((r["block"], r["values"], r["n"]) for r in blocks if r["k"] == k)
        assert own == [(i, v[37 * i : 37 * i + 37], len(v[37 * i : 37 * i + 37])) for i in range(-(-len(v) // 37))]
    assert not T.hydrograph_blocks(uneven.where("false"), ["k"], value="value").collect()


def test_map_tide_deals_the_points_of_a_crowded_node(spark):
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 50.0, 50.0)], "node_id long, x double, y double")
    waves = spark.createDataFrame([(n, c, 0.02 * c, 0.5 * n, 30.0 * c) for n in (1, 2) for c in (1, 2)], "node_id long, name int, freq double, amp double, phase double")
    times = spark.createDataFrame([(START + dt.timedelta(hours=h),) for h in range(7)], "ts timestamp")
    args = (spark, (0.0, 12.0, 0.0, 9.0), 1.0, nodes, waves, times, 0.25)
    plain = T.map_tide(*args)
    assert plain.count() == 13 * 10 * 7 and plain.columns == ["node_id", "point_id", "x", "y", "ts", "level"]
    same(T.map_tide(*args, at_once=2, crowd=10), plain)
    level = {(r["node_id"], r["ts"]): r["level"] for r in T.predict_tide(waves, times).collect()}
    for r in plain.collect():
        assert (r["x"], r["y"], r["node_id"]) == (r["point_id"] % 13, r["point_id"] // 13, 1)
        assert r["level"] == pytest.approx(level[1, r["ts"]] + 0.25)


def test_running_values_pass_over_nulls_and_null_times(spark):
    df = spark.createDataFrame([("a", None, 9.0), ("a", 1, None), ("a", 2, 3.0), ("a", 3, None), ("a", 4, 1.0)], "k string, t int, v double")
    for rows in (1, 100):
        got = Blocks(df, ["k"], "t", rows).running({"m": "v"}).orderBy("t").collect()
        assert [r["m"] for r in got] == [9.0] * 5
        got = Blocks(df.where("t IS NOT NULL"), ["k"], "t", rows).running({"l": "v", "n": ("v", True)}, "last").orderBy("t").collect()
        assert [(r["l"], r["n"]) for r in got] == [(None, 3.0), (3.0, 3.0), (3.0, 1.0), (1.0, 1.0)]


@pytest.mark.parametrize("rows", [1, 60, 10**6])
def test_nearest_time_equals_brute_force(spark, uneven, rows):
    rng = random.Random(9)
    asks = [(k, START + dt.timedelta(microseconds=t)) for k in ("hot", "a", None, "missing") for t in [int(rng.random() * 2e6), int(rng.random() * 2e6), *(int(rng.random() * 2.8e12) for _ in range(120))]]
    hot = [r["ts"] for r in uneven.where("k = 'hot'").limit(40).collect()]
    asks += [("hot", t) for t in hot] + [("hot", hot[0])] * 3 + [("hot", None)]
    samples = uneven.select("k", "ts", "value").unionByName(uneven.where("k = 'hot'").select("k", "ts", F.lit(7.0).alias("value")))
    known = {}
    for r in samples.collect():
        at = known.setdefault(r["k"], {})
        at[r["ts"]] = min((x for x in (r["value"], at.get(r["ts"])) if x is not None), default=None)
    want = []
    for k, t in asks:
        times = sorted(known.get(k, {}))
        if t is None:
            continue
        i = bisect.bisect_left(times, t)
        near = min(times[max(i - 1, 0) : i + 1], key=lambda x: (abs(x - t), x), default=None)
        want.append((k, t, near, known[k][near] if near else None))
    got = [tuple(r) for r in J.nearest_time(samples, spark.createDataFrame(asks, "k string, ts timestamp"), ["k"], rows=rows).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_nearest_time_of_empty_tables(spark):
    none = spark.createDataFrame([], "k string, ts timestamp, value double")
    asks = spark.createDataFrame([("a", START)], "k string, ts timestamp")
    assert [tuple(r) for r in J.nearest_time(none, asks, ["k"]).collect()] == [("a", START, None, None)]
    assert J.nearest_time(none, asks.limit(0), ["k"]).collect() == []


# tides


def test_astronomy_of_a_known_time(spark):
    """At 2000-01-01 12:00 the mean longitudes are those of the almanac to a hundredth of a degree."""
    row = spark.createDataFrame([(dt.datetime(2000, 1, 1, 12),)], "ts timestamp").select(*(c.alias(n) for n, c in tides.astronomy("ts").items())).first()
    near = {"s": 218.32, "h": 280.47, "p": 83.35, "np": -125.04, "pp": 282.94}
    for n, degrees in near.items():
        assert (row[n] * 360 - degrees + 180) % 360 - 180 == pytest.approx(0, abs=0.02)
    assert row["tau"] == pytest.approx(0.5 + row["h"] - row["s"])


def brute_level(t, lat, coefficients, constituents, satellites, mean=0.0):
    d = (t - dt.datetime(1899, 12, 31, 12)).total_seconds() / 86400
    astro = [math.fmod(sum(c * x for c, x in zip(p, (1, d, (d / 1e4) ** 2, (d / 1e4) ** 3), strict=True)) / 360, 1) for p in tides.LONGITUDES.values()]
    days = (t - dt.datetime(1970, 1, 1)).total_seconds() / 86400
    astro = [math.fmod(days, 1) + astro[1] - astro[0], *astro]
    lat = lat if abs(lat) >= 5 else math.copysign(5, lat)
    sin = math.sin(math.radians(lat))
    weights = (1, 0.36309 * (1 - 5 * sin * sin) / sin, 2.59808 * sin)
    level = mean
    for name, amp, phase in coefficients:
        _, doodson, semi, shallow = next(c for c in constituents if c[0] == name)
        f, angle = 1.0, 0.0
        for part, k in shallow or [(name, 1.0)]:
            _, doodson, semi, _ = next(c for c in constituents if c[0] == part)
            z = 1 + sum(r * weights[kind] * cmath.exp(2j * math.pi * (sum(a * b for a, b in zip(dood, astro[3:], strict=True)) + ph)) for n, dood, ph, r, kind in satellites if n == part)
            f *= abs(z) ** abs(k)
            angle += k * (cmath.phase(z) / (2 * math.pi) + sum(a * b for a, b in zip(doodson, astro, strict=True)) + semi)
        level += amp * f * math.cos(2 * math.pi * angle - math.radians(phase))
    return level


def test_nodal_tide_equals_plain_python(spark):
    constituents = [("M2", [2.0, 0.0, 0.0, 0.0, 0.0, 0.0], 0.0, None), ("K1", [1.0, 1.0, 0.0, 0.0, 0.0, 0.0], -0.75, None), ("O1", [1.0, -1.0, 0.0, 0.0, 0.0, 0.0], -0.25, None), ("M4", None, None, [("M2", 2.0)]), ("MK3", None, None, [("M2", 1.0), ("K1", -1.0)])]
    satellites = [("M2", [0.0, -1.0, 0.0], 0.5, 0.0373, 0), ("M2", [1.0, 0.0, 0.0], 0.25, 0.05, 2), ("K1", [0.0, 1.0, 0.0], 0.0, 0.1356, 1), ("O1", [0.0, -1.0, 0.0], 0.0, 0.1886, 0)]
    own = [("M2", 1.2, 30.0), ("K1", 0.4, 200.0), ("O1", 0.2, 10.0), ("M4", 0.05, 77.0), ("MK3", 0.03, 300.0)]
    nodes = {1: 41.5, 2: -2.0, 3: 0.0}
    times = [dt.datetime(1999, 12, 31, 23), dt.datetime(2024, 5, 6, 7, 8, 9, 500_000), dt.datetime(1969, 3, 1, 6)]
    c = spark.createDataFrame([(n, *x, lat, 0.25 * n) for n, lat in nodes.items() for x in own], "node_id int, name string, amp double, phase double, lat double, mean double")
    table = spark.createDataFrame(constituents, "name string, doodson array<double>, semi double, shallow array<struct<name string, coef double>>")
    sats = spark.createDataFrame(satellites, "name string, deldood array<double>, phcorr double, amprat double, ilatfac int")
    out = tides.predict_tide(c, spark.createDataFrame([(t,) for t in times], "ts timestamp"), constituents=table, satellites=sats).collect()
    assert len(out) == 9
    for r in out:
        n = r["node_id"]
        assert r["level"] == pytest.approx(brute_level(r["ts"], nodes[n], own, constituents, satellites, 0.25 * n), abs=1e-6)


def test_constituent_selection_is_over_all_of_a_node(spark):
    rows = [(1, "a", 3.0, 0.5), (1, "b", 4.0, 50.0), (1, "c", 0.1, 0.01), (2, "a", 1.0, None)]
    c = spark.createDataFrame(rows, "node_id int, name string, amp double, amp_ci double")
    got = tides.select_constituents(c, 2.0, 1.0).collect()
    assert [(r["node_id"], r["name"]) for r in got] == [(1, "a")]  # b is noise but counts as energy, c is too weak
    assert got[0]["energy"] == pytest.approx(900 / 25.01) and got[0]["snr"] == pytest.approx(9 / (0.5 / 1.96) ** 2)
    assert tides.select_constituents(c).count() == 4


# draws and percentiles


@pytest.mark.parametrize("rows", [3, 50, 10**6])
def test_draws_are_the_same_in_blocks(spark, rows):
    """One row has half of all weight; blocks change nothing but the work."""
    table = [(i, 500.0 if i == 77 else float(i % 9), "x") for i in range(200)] + [(1000, None, "y"), (1001, -2.0, "z")]
    df = spark.createDataFrame(table, "row_id long, price double, name string").repartition(3)
    got = {r["draw_id"]: (r["row_id"], r["replica"], r["name"]) for r in W.weighted_sample(df, "price", 2.0, 4, 5, rows=rows).collect()}
    assert set(got) == set(range(404)) and all(v[1] == d % 4 and v[2] == "x" for d, v in got.items())
    import hashlib

    line = sorted((int(hashlib.md5(str(i).encode()).hexdigest()[:8], 16) % 64, i, w) for i, w, _ in table if w and w > 0)
    ends, total = [], 0.0
    for b in range(64):
        own = 0.0
        for _, i, w in (x for x in line if x[0] == b):
            own += w
            ends.append((total + own, i))
        total += own
    for d, (row, _, _) in got.items():
        u = int(hashlib.md5(f"draw:5:{d}".encode()).hexdigest()[:13], 16) / (1 << 52)
        assert row == ends[bisect.bisect_right([e for e, _ in ends], u * ends[-1][0])][1]
    assert W.weighted_sample(df.limit(0), "price").count() == 0 and W.weighted_sample(df.where("price < 0"), "price").count() == 0


@pytest.mark.parametrize("ranked", [1, 10, 10**6])
def test_percentiles_beside_outliers(spark, ranked, monkeypatch):
    """Values of 1e12 and 1e300 beside [0, 1], equal values, null groups and groups without values."""
    rng = np.random.default_rng(11)
    groups = {"a": [*rng.random(900), 1e12, -1e12], "b": [*rng.random(300) * 1e-9, 1e300, -1e300, 5.0], None: [3.0] * 400 + [4.0], "c": [2.5], "d": [None, float("nan")]}
    df = spark.createDataFrame([(k, float(v) if v is not None else None) for k, vs in groups.items() for v in vs], "k string, v double").repartition(3)
    qs, seen = [0, 1, 25, 50, 99.9, 100], []
    keep = A.join_same
    monkeypatch.setattr(A, "join_same", lambda left, right, keys, how="inner": seen.append(right) or keep(left, right, keys, how))
    got = {r["k"]: r["percentiles"] for r in A.exact_percentiles(df, "v", qs, ["k"], ranked=ranked).collect()}
    for k, vs in groups.items():
        known = [v for v in vs if v is not None and v == v]
        assert got[k] == (pytest.approx(np.percentile(known, qs).tolist(), rel=1e-12) if known else None)
    rounds = [found for found in seen if "_again" in found.columns]
    assert len(rounds) >= (3 if ranked < 100 else 1) and rounds[-1].where("_again").isEmpty()
