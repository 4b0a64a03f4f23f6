"""Domain tables made from the general test tables (all rows of them)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scenario_of(label: Column) -> Column:
    return F.format_string("%dy_%dh_%dc", (label + 1) * 10, (label % 2 + 1) * 6, label % 4)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patch form: one row per 8 x 8 patch with arrays h, pred, u and mask."""
    v = F.col("vec_id")
    e = F.transform("embedding", lambda x: x.cast("double"))
    h = F.transform(e, lambda x: F.greatest(x, F.lit(0.0)) * 5.0)
    gain = F.lit(0.8) + F.lit(0.02) * (v % 21)
    return table(spark, sf_dir, "embeddings").select(
        v, scenario_of(F.col("label")).alias("scenario"), F.lit("h").alias("var"), F.concat(F.lit("t"), F.lpad((v % 48).cast("string"), 4, "0")).alias("t"),
        (v % 48).cast("int").alias("time_index"), (F.floor(v / 48) % 8).cast("int").alias("patch_row"), F.floor(v / 384).cast("int").alias("patch_col"),
        F.lit(8).alias("h"), F.lit(8).alias("w"), h.alias("target"), F.transform(h, lambda x: x * gain).alias("pred"), e.alias("u"),
        F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: ((i + v) % 5 != 0).cast("int")).alias("mask"),
    )


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored cells: target and pred depths, velocity u, mask, and logits of three thresholds."""
    from ..operators.cells import patches_to_cells

    out = patches_to_cells(vectors(spark, sf_dir), {"target": "target", "pred": "pred", "u": "u", "mask": "mask"})
    return out.withColumns({f"l{i}": (F.col("pred") - t) * 4.0 for i, t in ((1, 0.1), (2, 0.5), (3, 1.0))})


#: The same cells in SQL; queries append their own steps.
CELLS_SQL = """
WITH base AS (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS e, unnest(range(64)) AS pos FROM embeddings),
raw AS (
  SELECT vec_id, (10 * (label + 1)) || 'y_' || (6 * (1 + label % 2)) || 'h_' || (label % 4) || 'c' AS scenario, 'h' AS var,
         't' || lpad(CAST(vec_id % 48 AS VARCHAR), 4, '0') AS t, CAST(vec_id % 48 AS INT) AS time_index,
         CAST((vec_id // 48) % 8 AS INT) AS patch_row, CAST(vec_id // 384 AS INT) AS patch_col,
         CAST(pos // 8 AS INT) AS y, CAST(pos % 8 AS INT) AS x, CAST((pos + vec_id) % 5 <> 0 AS INT) AS mask, e AS u,
         greatest(e, 0::DOUBLE) * 5::DOUBLE AS target,
         greatest(e, 0::DOUBLE) * 5::DOUBLE * (0.8::DOUBLE + 0.02::DOUBLE * (vec_id % 21)) AS pred
  FROM base
),
cells AS (SELECT *, (pred - 0.1::DOUBLE) * 4 AS l1, (pred - 0.5::DOUBLE) * 4 AS l2, (pred - 1::DOUBLE) * 4 AS l3 FROM raw)
"""


def wide_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many cells for aggregates that need no places: one per line item."""
    t = table(spark, sf_dir, "lineitem")
    d = F.col("l_discount").cast("double")
    return t.select(
        F.col("l_returnflag").alias("scenario"), F.lit("h").alias("var"), F.date_format("l_shipdate", "yyyy-MM").alias("t"),
        (F.col("l_suppkey") % 10).cast("int").alias("patch_row"), F.col("l_linenumber").cast("int").alias("patch_col"),
        (d * 12.0).alias("target"), (d * 12.0 + (F.col("l_tax").cast("double") - 0.04) * 3.0).alias("pred"), (F.col("l_linestatus") == "F").cast("int").alias("mask"),
    )


WIDE_SQL = """
WITH cells AS (
  SELECT l_returnflag AS scenario, 'h' AS var, strftime(l_shipdate, '%Y-%m') AS t, CAST(l_suppkey % 10 AS INT) AS patch_row,
         CAST(l_linenumber AS INT) AS patch_col, CAST(l_discount AS DOUBLE) * 12::DOUBLE AS target,
         CAST(l_discount AS DOUBLE) * 12::DOUBLE + (CAST(l_tax AS DOUBLE) - 0.04::DOUBLE) * 3::DOUBLE AS pred,
         CAST(l_linestatus = 'F' AS INT) AS mask
  FROM lineitem
)
"""


def patch_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "orders")
    return t.select(
        F.col("o_orderkey").alias("row_id"), F.col("o_orderpriority").alias("scenario"),
        F.when(F.col("o_orderstatus") == "F", "h").when(F.col("o_orderstatus") == "O", "u").otherwise("v").alias("var"),
        F.date_format("o_orderdate", "yyyy-MM").alias("t"), F.month("o_orderdate").alias("time_index"),
        (F.col("o_custkey") % 8).cast("int").alias("patch_row"), (F.col("o_orderkey") % 11).cast("int").alias("patch_col"),
        F.when(F.col("o_custkey") % 7 == 0, 1).otherwise(0).alias("filtered_out"), F.col("o_totalprice").cast("double").alias("price"),
    )


INDEX_SQL = """
WITH idx AS (
  SELECT o_orderkey AS row_id, o_orderpriority AS scenario,
         CASE o_orderstatus WHEN 'F' THEN 'h' WHEN 'O' THEN 'u' ELSE 'v' END AS var, strftime(o_orderdate, '%Y-%m') AS t,
         CAST(month(o_orderdate) AS INT) AS time_index, CAST(o_custkey % 8 AS INT) AS patch_row, CAST(o_orderkey % 11 AS INT) AS patch_col,
         CAST(o_custkey % 7 = 0 AS INT) AS filtered_out, CAST(o_totalprice AS DOUBLE) AS price
  FROM orders
)
"""


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series of flow by reach: one per user of the events."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("reach_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").cast("double").alias("flow"), F.col("event_type").alias("kind"))


FLOWS_SQL = "WITH flows AS (SELECT user_id AS reach_id, ts, CAST(value AS DOUBLE) AS flow, event_type AS kind FROM events)\n"


def peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows by nation, return period and duration: line items of orders."""
    l, o, c = (table(spark, sf_dir, n) for n in ("lineitem", "orders", "customer"))
    rows = l.join(o, l.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey)
    return rows.select(
        F.col("c_nationkey").cast("int").alias("location"), F.element_at(F.array(F.lit(20), F.lit(50), F.lit(100)), (F.col("l_linenumber") % 3 + 1).cast("int")).alias("ari"),
        ((F.month("l_shipdate") % 4 + 1) * 6).cast("int").alias("duration"), (F.col("l_suppkey") % 5).cast("int").alias("reach_id"),
        F.col("l_extendedprice").cast("double").alias("flow"), (F.month("o_orderdate") % 4).cast("int").alias("warming"),
    )


PEAKS_SQL = """
WITH peaks AS (
  SELECT CAST(c_nationkey AS INT) AS location, [20, 50, 100][CAST(l_linenumber % 3 + 1 AS INT)] AS ari,
         CAST((month(l_shipdate) % 4 + 1) * 6 AS INT) AS duration, CAST(l_suppkey % 5 AS INT) AS reach_id,
         CAST(l_extendedprice AS DOUBLE) AS flow, CAST(month(o_orderdate) % 4 AS INT) AS warming
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
)
"""
