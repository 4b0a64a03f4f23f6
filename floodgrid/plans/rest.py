"""Queries of the remaining forms: paths, padding, crops, tags, counts, reports and guards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import cells as M
from ..operators import checks as U
from ..operators import hydro as H
from ..operators import resample as R
from ..operators import stats as A
from ..sources.adapters import CELLS_SQL, INDEX_SQL, cells, patch_index, table, vectors
from .registry import query, rounded

_EPS = "1e-12::DOUBLE"


@query(f"{INDEX_SQL} SELECT row_id, CASE WHEN filtered_out = 1 THEN '' ELSE 'fine/' || row_id || '.npy' END AS fine_path, CASE WHEN filtered_out = 1 THEN '' ELSE 'coarse/' || row_id || '.npy' END AS coarse_path FROM idx")
def m8_blank_filtered_paths(spark: SparkSession, sf: str) -> DataFrame:
    idx = patch_index(spark, sf)
    path = lambda kind: F.concat(F.lit(f"{kind}/"), F.col("row_id").cast("string"), F.lit(".npy"))
    out = M.blank_filtered_paths(idx.withColumns({"fine_path": path("fine"), "coarse_path": path("coarse")}), ["fine_path", "coarse_path"])
    return out.select("row_id", "fine_path", "coarse_path")


@query("SELECT vec_id, [CASE WHEN i // 10 < 8 AND i % 10 < 8 THEN round(embedding[CAST(i // 10 * 8 + i % 10 + 1 AS INT)]::DOUBLE, 6) END FOR i IN range(100)] AS values FROM embeddings")
def r3_pad_patches(spark: SparkSession, sf: str) -> DataFrame:
    patches = vectors(spark, sf).select("vec_id", "h", "w", F.col("u").alias("values"))
    return rounded(M.pad_patches(patches, 10).select("vec_id", "values"), signed=True)


_OFFSET = "CAST('0x' || substr(md5('9:{c}:' || vec_id), 1, 8) AS BIGINT) % 3"


@query(f"""{CELLS_SQL}, o AS (SELECT vec_id, {_OFFSET.format(c='y')} AS oy, {_OFFSET.format(c='x')} AS ox FROM embeddings),
g AS (SELECT vec_id, 'fine' AS grid, y - 2 * oy AS y, x - 2 * ox AS x, target AS value, 4 AS size FROM cells JOIN o USING (vec_id)
  UNION ALL SELECT vec_id, 'coarse', y // 2 - any_value(oy), x // 2 - any_value(ox), avg(target), 2 FROM cells JOIN o USING (vec_id) GROUP BY vec_id, y // 2, x // 2)
SELECT vec_id, grid, CAST(y AS INT) AS y, CAST(x AS INT) AS x, round(value, 6) AS value FROM g WHERE y BETWEEN 0 AND size - 1 AND x BETWEEN 0 AND size - 1""")
def r15_paired_crop(spark: SparkSession, sf: str) -> DataFrame:
    """The same random window of 2 x 2 coarse cells and the 4 x 4 fine cells within."""
    fine = cells(spark, sf).select("vec_id", "y", "x", F.col("target").alias("value"))
    small, large = R.paired_crop(R.block_mean(fine, ["vec_id"], 2), fine, 2, 2, 4, 9, "vec_id")
    out = small.withColumn("grid", F.lit("coarse")).unionByName(large.withColumn("grid", F.lit("fine")))
    return rounded(out.select("vec_id", "grid", "y", "x", "value"))


@query(f"{CELLS_SQL} SELECT DISTINCT vec_id, t AS tag FROM cells UNION ALL SELECT page_id, NULL FROM pages")
def f8_time_tag(spark: SparkSession, sf: str) -> DataFrame:
    """Tags of patches' paths; paths without one have none."""
    paths = vectors(spark, sf).select("vec_id", F.concat(F.lit("h_"), "scenario", F.lit("_"), "t", F.lit("_r000.npy")).alias("path"))
    plain = table(spark, sf, "pages").select(F.col("page_id").alias("vec_id"), F.concat(F.lit("page_"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"))
    return paths.unionByName(plain).select("vec_id", C.time_tag("path").alias("tag"))


@query("SELECT event_id, round((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1e6::DOUBLE, 6) AS seconds FROM events")
def f13_seconds_since(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(table(spark, sf, "events").select("event_id", C.seconds_since("ts", F.lit("2024-01-01 00:00:00")).alias("seconds")))


@query("SELECT l_returnflag, count(*) FILTER (WHERE l_discount = 0) AS zeros, count(l_discount) AS n FROM lineitem GROUP BY l_returnflag")
def a7_zero_count(spark: SparkSession, sf: str) -> DataFrame:
    return A.zero_count(table(spark, sf, "lineitem"), "l_discount", ["l_returnflag"])


@query("SELECT l_returnflag, round(avg(l_tax), 6) AS l_tax, round(avg(CASE WHEN l_linenumber <> 1 THEN l_discount END), 6) AS l_discount FROM lineitem GROUP BY l_returnflag")
def a17_finite_mean(spark: SparkSession, sf: str) -> DataFrame:
    """Values of first lines are infinite or not numbers."""
    odd = F.when(F.col("l_orderkey") % 2 == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    rows = table(spark, sf, "lineitem").withColumn("l_discount", F.when(F.col("l_linenumber") == 1, odd).otherwise(F.col("l_discount").cast("double")))
    return rounded(A.finite_mean(rows.withColumn("l_tax", F.col("l_tax").cast("double")), ["l_returnflag"], ["l_tax", "l_discount"]))


@query(f"{CELLS_SQL} SELECT scenario, count(target) AS n, round(min(target), 6) AS min, round(max(target), 6) AS max, round(avg(target), 6) AS mean, round(stddev_pop(target) + {_EPS}, 6) AS std, [round(v, 6) FOR v IN quantile_cont(target, [0, 0.25, 0.5, 0.75, 1])] AS percentiles FROM cells GROUP BY scenario")
def a34_outlier_report(spark: SparkSession, sf: str) -> DataFrame:
    out = H.outlier_report(cells(spark, sf), ["scenario"], "target")
    return rounded(out.select("scenario", "n", "min", "max", "mean", "std", "percentiles"))


@query(f"{CELLS_SQL}, g AS (SELECT unnest(range(16)) AS bin), h AS (SELECT least(CAST(floor(target / 0.25::DOUBLE) AS INT), 15) AS bin, count(*) AS n FROM cells WHERE target BETWEEN 0 AND 4 GROUP BY 1) SELECT CAST(g.bin AS INT) AS bin, round(g.bin * 0.25::DOUBLE, 6) AS left, coalesce(n, 0) AS n FROM g LEFT JOIN h USING (bin)")
def a34_outlier_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(H.outlier_histogram(cells(spark, sf), 16, 0.0, 4.0, "target"))


@query("SELECT c_nationkey AS poly_id, arg_min(x, (z, x, y)) AS x, arg_min(y, (z, x, y)) AS y, min(z) AS z FROM (SELECT c_nationkey, (c_custkey * 17 % 103)::DOUBLE AS x, (c_custkey * 29 % 89)::DOUBLE AS y, floor(c_acctbal::DOUBLE / 100) AS z FROM customer) GROUP BY c_nationkey")
def a35_deepest_corner(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    corners = table(spark, sf, "customer").select(F.col("c_nationkey").alias("poly_id"), (k * 17 % 103).cast("double").alias("x"), (k * 29 % 89).cast("double").alias("y"), F.floor(F.col("c_acctbal").cast("double") / 100).cast("double").alias("z"))
    return H.deepest_corner(corners)


@query("SELECT p_partkey AS k, 'b' AS side FROM part WHERE p_partkey NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT c_custkey, 'a' FROM customer WHERE c_custkey NOT IN (SELECT p_partkey FROM part)")
def u2_keys_that_differ(spark: SparkSession, sf: str) -> DataFrame:
    a, b = (table(spark, sf, t).select(F.col(c).alias("k")) for t, c in (("customer", "c_custkey"), ("part", "p_partkey")))
    return U.same_keys(a, b, ["k"])


@query(f"{CELLS_SQL}, a AS (SELECT DISTINCT y, x FROM cells), m AS (SELECT DISTINCT y + 1 AS y, x FROM cells) SELECT 'same' AS compared, (SELECT count(*) FROM a) = (SELECT count(*) FROM a JOIN a b USING (y, x)) AS same UNION ALL SELECT 'moved', NOT EXISTS (SELECT * FROM a EXCEPT SELECT * FROM m)")
def u4_same_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the grids of targets and predictions are one, and those of targets and cells moved by a row; an old column name is known."""
    fine = cells(spark, sf)
    other = U.require_columns(fine.select(F.col("y").alias("row"), "x"), ["y", "x"], {"row": "y"})
    found = {"same": U.check_same_grid(fine, other), "moved": U.check_same_grid(fine, other.withColumn("y", F.col("y") + 1))}
    return spark.createDataFrame(list(found.items()), "compared string, same boolean")
