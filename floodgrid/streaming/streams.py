"""Streaming forms (X1-X4): the batch aggregates over files or rows as they arrive."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.score import metrics_of_sums, patch_global_stats
from ..operators.stats import masked_stats


def checkpoint_path(spark: SparkSession, name: str) -> str:
    """A place for a query's state in the shared folder that the cluster names; a local session makes its own."""
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if base is None:
        if context.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-checkpoint-")
        context.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}"


def drain(stream: DataFrame, mode: str) -> DataFrame:
    """The rows that a stream has given out when its present input is read: all of them in append mode, the last
    batch's in complete mode. They go through Parquet in the shared folder, not through the driver."""
    spark = stream.sparkSession
    path, batches = checkpoint_path(spark, f"stream-{uuid.uuid4().hex}"), []

    def each(batch: DataFrame, number: int) -> None:
        # a batch that is done again after a failure takes its own place
        batch.write.mode("overwrite").parquet(f"{path}/rows/{number}")
        batches.append(number)

    running = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").foreachBatch(each).trigger(availableNow=True).start()
    running.awaitTermination()
    done = sorted(set(batches)) if mode == "append" else batches[-1:]
    rows = spark.read.schema(stream.schema)
    return rows.parquet(*(f"{path}/rows/{n}" for n in done)) if done else spark.createDataFrame([], stream.schema)


def stream_masked_stats(stream: DataFrame, by: list[str], value: str = "value", mask: str | None = "mask") -> DataFrame:
    """Running moments per key; for update or complete mode. State: one row per key."""
    return masked_stats(stream, by, value, mask)


def stream_daily_rain(stream: DataFrame, by: list[str], delay: str = "1 day", ts: str = "ts", value: str = "depth") -> DataFrame:
    """Daily totals, given out once the watermark has passed the day; later rows are dropped."""
    day = F.window(ts, "1 day")
    return stream.withWatermark(ts, delay).groupBy(day.alias("w"), *by).agg(F.sum(value).alias("total"), F.count(value).alias("n")).select(*by, F.col("w.start").alias("day"), "total", "n")


def stream_best_metric(stream: DataFrame, better: str = "higher", by: tuple[str, ...] = ("dataset", "metric"), step: str = "iter", value: str = "value") -> DataFrame:
    """Best value so far and its latest step, per key; repeated rows change nothing. For update mode."""
    sign = 1 if better == "higher" else -1
    rows = stream.where(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")))
    best = rows.groupBy(*by).agg(F.max(F.struct((F.col(value) * sign).alias("v"), F.col(step).alias("i"))).alias("b"))
    return best.select(*by, (F.col("b.v") * sign).alias("best_value"), F.col("b.i").alias("best_step"))


def stream_scores(patch_stats: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, by: tuple[str, ...] = ("scenario", "t"), once: bool = False) -> StreamingQuery:
    """Running sums of patch vectors per key; each batch's changed keys reach ``sink`` as metrics.

    With ``once`` the stream ends when its present input is read.
    """
    numbers = [c for c in patch_stats.columns if c not in ("scenario", "var", "t", "patch_row", "patch_col")]
    return _scored(patch_stats.groupBy(*by).agg(*[F.sum(c).alias(c) for c in numbers]), sink, checkpoint, by, once)


def stream_cell_scores(cells: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, by: tuple[str, ...] = ("scenario", "t"), once: bool = False) -> StreamingQuery:
    """As :func:`stream_scores`, of cells (pred, target, mask) as they come in. State: one vector of sums per key."""
    return _scored(patch_global_stats(cells, list(by)), sink, checkpoint, by, once)


def _scored(summed: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, by: tuple[str, ...], once: bool) -> StreamingQuery:
    def each(batch: DataFrame, number: int) -> None:
        sink(metrics_of_sums(batch, list(by)), number)

    writer = summed.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(each)
    return (writer.trigger(availableNow=True) if once else writer).start()
