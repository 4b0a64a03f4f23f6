"""Streams over several files: one micro-batch each, late rows, and a stop and restart from the checkpoint."""

import datetime as dt
import time

from pyspark.sql import functions as F

from floodgrid.operators import score as S
from floodgrid.streaming import streams as X

RAIN = "k string, ts timestamp, depth double"


def add(spark, folder, rows, schema=RAIN):
    """One more file, later than those before."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
    time.sleep(0.05)


def at(day, hour=0):
    return dt.datetime(2024, 1, day, hour)


def run(stream, mode, folder, checkpoint):
    """Runs a stream over what is there now; its batches' rows by number."""
    got = {}

    def each(batch, number):
        got[number] = [tuple(r) for r in batch.collect()]

    stream.writeStream.outputMode(mode).option("checkpointLocation", str(checkpoint)).foreachBatch(each).trigger(availableNow=True).start().awaitTermination()
    return got


def test_daily_rain_over_files_late_rows_and_a_restart(spark, tmp_path):
    folder, checkpoint = tmp_path / "in", tmp_path / "state"
    add(spark, folder, [("a", at(1, 1), 1.0), ("a", at(1, 5), 2.0), ("b", at(1, 7), 5.0)])
    add(spark, folder, [("a", at(3), 4.0), ("a", at(1, 9), 8.0)])  # day 1 is still open when this file is read
    add(spark, folder, [("c", at(3), 7.0)])
    add(spark, folder, [("a", at(1, 9), 100.0), ("b", at(4, 2), 1.0)])  # day 1 was given out: too late

    def stream():
        source = spark.readStream.schema(RAIN).option("maxFilesPerTrigger", 1).parquet(str(folder))
        return X.stream_daily_rain(source, ["k"], "1 day").select("k", F.date_format("day", "dd").alias("day"), "total", "n")

    got = run(stream(), "append", folder, checkpoint)
    assert len(got) >= 3
    assert sorted(x for rows in got.values() for x in rows) == [("a", "01", 11.0, 3), ("b", "01", 5.0, 1)]
    # the stream stops; later it goes on from its checkpoint, with the open days as they were
    add(spark, folder, [("a", at(3, 20), 6.0)])
    add(spark, folder, [("b", at(9), 0.5)])
    more = run(stream(), "append", folder, checkpoint)
    assert not set(more) & set(got)
    assert sorted(x for rows in more.values() for x in rows) == [("a", "03", 10.0, 2), ("b", "04", 1.0, 1), ("c", "03", 7.0, 1)]
    assert all(not rows for rows in run(stream(), "append", folder, checkpoint).values())  # nothing new


def test_best_metric_goes_on_after_a_restart(spark, tmp_path):
    folder, schema = tmp_path / "in", "dataset string, metric string, iter int, value double"
    add(spark, folder, [("d", "csi", 1, 0.5), ("d", "csi", 2, float("nan"))], schema)
    add(spark, folder, [("d", "csi", 3, 0.5), ("d", "rmse", 1, 2.0)], schema)

    def stream():
        return X.stream_best_metric(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder)))

    got = run(stream(), "update", folder, tmp_path / "state")
    assert got[0] == [("d", "csi", 0.5, 1)] and sorted(got[1]) == [("d", "csi", 0.5, 3), ("d", "rmse", 2.0, 1)]
    add(spark, folder, [("d", "csi", 4, 0.4)], schema)
    add(spark, folder, [("d", "csi", 5, 0.9)], schema)
    more = run(stream(), "update", folder, tmp_path / "state")
    last = {}
    for n in sorted(more):
        last |= {r[:2]: r[2:] for r in more[n]}
    assert last[("d", "csi")] == (0.9, 5) and min(more) == max(got) + 1


def test_masked_stats_over_files_equal_a_batch(spark, tmp_path):
    schema = "k string, value double, mask int"
    rows = [("a" if i % 3 else "b", float(i % 11), i % 4 != 0 and 1 or 0) for i in range(120)]
    for i in range(0, 120, 30):
        add(spark, tmp_path / "in", rows[i : i + 30], schema)
    stream = X.stream_masked_stats(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), ["k"])
    got = run(stream, "complete", tmp_path / "in", tmp_path / "state")
    assert len(got) == 4
    batch = [tuple(r) for r in X.masked_stats(spark.createDataFrame(rows, schema), ["k"], "value", "mask").collect()]
    for g, w in zip(sorted(got[3]), sorted(batch), strict=True):
        assert g[0] == w[0] and all(abs(x - y) < 1e-9 for x, y in zip(g[1:], w[1:], strict=True))


def test_scores_of_several_batches_equal_those_of_all(spark, tmp_path):
    schema = "scenario string, t string, patch_row int, patch_col int, y int, x int, pred double, target double, mask int"
    cells = [("s", f"t{i % 2}", 0, 0, 0, i, i / 10, (i * 7 % 10) / 10, 1) for i in range(40)]
    stats = [S.patch_global_stats(spark.createDataFrame(cells[i : i + 10], schema), ["scenario", "t"]) for i in range(0, 40, 10)]
    for part in stats:
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.05)
    got = {}
    source = spark.readStream.schema(stats[0].schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    X.stream_scores(source, lambda b, n: got.update({(r["scenario"], r["t"]): r["rmse"] for r in b.collect()}), str(tmp_path / "state"), once=True).awaitTermination()
    for t in ("t0", "t1"):
        own = [(c[6] - c[7]) ** 2 for c in cells if c[1] == t]
        assert abs(got["s", t] - (sum(own) / len(own)) ** 0.5) < 1e-9


def test_cell_scores_of_several_batches_and_a_restart(spark, tmp_path):
    schema = "scenario string, t string, pred double, target double, mask int"
    cells = [("s", f"t{i % 2}", i / 10, (i * 7 % 10) / 10, int(i % 5 > 0)) for i in range(60)]
    got, numbers = {}, []

    def go():
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

        def sink(batch, number):
            numbers.append(number)
            got.update({(r["scenario"], r["t"]): (r["n"], r["rmse"]) for r in batch.collect()})

        X.stream_cell_scores(source, sink, str(tmp_path / "state"), once=True).awaitTermination()

    def want(rows, t):
        own = [(c[2] - c[3]) ** 2 for c in rows if c[1] == t and c[4]]
        return len(own), (sum(own) / len(own)) ** 0.5

    for upto in (40, 60):
        for i in range(len(numbers) * 10, upto, 10):
            add(spark, tmp_path / "in", cells[i : i + 10], schema)
        go()
        assert len(numbers) == upto // 10
        for t in ("t0", "t1"):
            n, rmse = want(cells[:upto], t)
            assert got["s", t][0] == n and abs(got["s", t][1] - rmse) < 1e-9
