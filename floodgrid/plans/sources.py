"""Queries of the sources and sinks: tables are written, read back and summed up."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import logs as L
from ..operators.stats import masked_stats
from ..sources import io
from ..sources.adapters import CELLS_SQL, INDEX_SQL, cells, patch_index, table, vectors
from ..streaming.streams import checkpoint_path
from .registry import query, rounded

_BAD = "(row_id % 13 = 0)"


def _folder(spark: SparkSession, name: str) -> str:
    return checkpoint_path(spark, f"{name}-{uuid.uuid4().hex}")


def _manifest(spark: SparkSession, sf: str) -> DataFrame:
    """The index with a path that is blank for some rows."""
    rows = patch_index(spark, sf)
    path = F.when(F.col("row_id") % 13 == 0, F.lit("")).otherwise(F.concat_ws("/", "scenario", "t"))
    return rows.select("row_id", "scenario", "var", "t", "time_index", "patch_row", "patch_col", path.alias("coarse_path"), (F.col("price") / 1e6).alias("aoi_ratio"), "filtered_out")


_SUM = "SELECT scenario, var, count(*) AS n, sum(row_id)::BIGINT AS ids, count(*) FILTER (WHERE {bad}) AS blank, sum(patch_row * 11 + patch_col)::BIGINT AS places, round(avg(price / 1e6), 6) AS ratio FROM idx GROUP BY scenario, var"


def _summed(index: DataFrame) -> DataFrame:
    place = F.sum(F.col("patch_row") * 11 + F.col("patch_col")).cast("bigint")
    return rounded(index.groupBy("scenario", "var").agg(F.count("*").alias("n"), F.sum("row_id").alias("ids"), F.count_if(F.col("coarse_path").isNull()).alias("blank"), place.alias("places"), F.avg("aoi_ratio").alias("ratio")))


@query(f"{INDEX_SQL} {_SUM.format(bad=_BAD)}")
def s1_read_patch_index(spark: SparkSession, sf: str) -> DataFrame:
    """A manifest as CSV with its own row numbers, typed, blanks as NULL."""
    path = _folder(spark, "manifest")
    _manifest(spark, sf).write.option("header", True).csv(path)
    return _summed(io.read_patch_index(spark, path))


@query(f"{INDEX_SQL} SELECT count(*) AS n, count(*)::BIGINT AS n_ids, 0::BIGINT AS first, count(*) - 1 AS last FROM idx")
def s1_read_patch_index_numbered(spark: SparkSession, sf: str) -> DataFrame:
    """A manifest without row numbers gets them from 0 on, without gaps."""
    path = _folder(spark, "manifest")
    _manifest(spark, sf).drop("row_id").repartition(5).write.option("header", True).csv(path)
    return io.read_patch_index(spark, path).agg(F.count("*").alias("n"), F.count_distinct("row_id").alias("n_ids"), F.min("row_id").alias("first"), F.max("row_id").alias("last"))


@query(f"{INDEX_SQL} {_SUM.format(bad='false')}")
def s2_write_patch_index(spark: SparkSession, sf: str) -> DataFrame:
    """Written by scenario and variable, in two appends, and read as a table."""
    path, rows = _folder(spark, "index"), _manifest(spark, sf)
    for part in (0, 1):
        io.write_patch_index(rows.where(F.col("row_id") % 2 == part), path)
    return _summed(spark.read.parquet(path))


@query(f"{CELLS_SQL} SELECT scenario, t, count(DISTINCT vec_id) AS patches, round(sum(target::FLOAT::DOUBLE), 3) AS total, sum(mask)::BIGINT AS valid FROM cells GROUP BY scenario, t")
def s3_read_patches(spark: SparkSession, sf: str) -> DataFrame:
    path = _folder(spark, "patches")
    v = vectors(spark, sf)
    rows = v.select("scenario", "var", "t", "time_index", "patch_row", "patch_col", F.lit(2).alias("downscale"), F.lit("fine").alias("grid"), "h", "w", F.col("target").cast("array<float>").alias("values"), F.col("mask").cast("array<tinyint>").alias("mask"))
    io.write_patches(rows, path)
    total = lambda c, t: F.aggregate(c, F.lit(0).cast(t), lambda a, x: a + x)
    found = io.read_patches(spark, path).select("scenario", "t", total("values", "double").alias("total"), total("mask", "bigint").alias("valid"))
    return rounded(found.groupBy("scenario", "t").agg(F.count("*").alias("patches"), F.sum("total").alias("total"), F.sum("valid").alias("valid")), 3)


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, count(*) FILTER (WHERE event_id % 3 <> 0) AS with_h FROM events GROUP BY event_type")
def s4_read_point_series(spark: SparkSession, sf: str) -> DataFrame:
    """One file of text per event type, with comments, leading blanks and short lines."""
    path = _folder(spark, "series")
    e = table(spark, sf, "events")
    line = F.concat(F.lit("  "), F.col("event_id").cast("string"), F.lit("\t"), F.col("value").cast("string"), F.when(F.col("event_id") % 3 != 0, F.lit("   1.5 ")).otherwise(""))
    lines = F.explode(F.array(line, F.lit("# time level depth"), F.lit("   ")))
    e.select("event_type", lines.alias("value")).write.partitionBy("event_type").text(path)
    parts = [r["event_type"] for r in e.select("event_type").distinct().collect()]  # a few kinds of events
    out = None
    for kind in sorted(parts):
        one = io.read_point_series(spark, f"{path}/event_type={kind}", ["time", "zs", "h"]).withColumn("event_type", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    return rounded(out.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("zs").alias("total"), F.count("h").alias("with_h")), 4)


@query(f"{CELLS_SQL} SELECT scenario, count(target) AS n, round(min(target), 6) AS min, round(max(target), 6) AS max, round(avg(target), 6) AS mean, round(stddev_pop(target) + 1e-12::DOUBLE, 6) AS std FROM cells GROUP BY scenario")
def s5_stats_json(spark: SparkSession, sf: str) -> DataFrame:
    """Statistics as the nested document, written and read back."""
    path = _folder(spark, "stats")
    found = masked_stats(cells(spark, sf), ["scenario"], "target", None)
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct("scenario", F.struct("n", "min", "max", "mean", "std").alias("s")))))
    io.write_stats_json(found.agg(entries.alias("stats"), F.lit(7).alias("seed"), F.lit(0.1).alias("val_ratio")), path)
    back = io.read_stats_json(spark, path, ("20y_12h_1c",))
    return rounded(back.select(F.explode("stats").alias("scenario", "s")).select("scenario", "s.*"))


@query(f"{CELLS_SQL} SELECT 'time' AS level, scenario, t, round(avg(target), 6) AS mean FROM cells GROUP BY scenario, t UNION ALL SELECT 'scenario', scenario, NULL, round(avg(target), 6) FROM cells GROUP BY scenario")
def s6_write_metric_tables(spark: SparkSession, sf: str) -> DataFrame:
    """A CSV folder per level, read back."""
    path, c = _folder(spark, "metrics"), cells(spark, sf)
    levels = {"time": ["scenario", "t"], "scenario": ["scenario"]}
    io.write_metric_tables({k: c.groupBy(*by).agg(F.avg("target").alias("mean")) for k, by in levels.items()}, path)
    out = None
    for k, by in levels.items():
        schema = ", ".join([*(f"{b} string" for b in by), "mean double"])
        one = spark.read.schema(schema).option("header", True).csv(f"{path}/{k}").withColumn("level", F.lit(k))
        one = one if "t" in by else one.withColumn("t", F.lit(None).cast("string"))
        out = one if out is None else out.unionByName(one)
    return rounded(out.select("level", "scenario", "t", "mean"))


@query("SELECT event_type, count(*) AS n, max(event_id) AS last, round(max(value), 6) AS best FROM events GROUP BY event_type")
def s7_read_log_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of many log files, with the file that they come from."""
    path = _folder(spark, "logs")
    e = table(spark, sf, "events")
    e.select("event_type", F.concat(F.lit("Validation iter "), F.col("event_id").cast("string"), F.lit(": value "), F.col("value").cast("string")).alias("value")).write.partitionBy("event_type").text(path)
    lines = io.read_log_lines(spark, path).withColumn("event_type", F.regexp_extract("file", "event_type=([^/]+)/", 1))
    found = L.extract_metrics(lines.select("event_type", "value"), r"Validation iter (\d+): value ([0-9.Ee+-]+)")
    return rounded(found.groupBy("event_type").agg(F.count("metric").alias("n"), F.max("step").alias("last"), F.max("metric").alias("best")))
