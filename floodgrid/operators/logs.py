"""Logs and run status (L1-L4)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def extract_metrics(lines: DataFrame, pattern: str, step_one: bool = False, value: str = "value") -> DataFrame:
    """(step, metric) of lines that begin with the pattern, whose groups are step and metric."""
    anchored = pattern if pattern.startswith("^") else f"^{pattern}"
    hit = lines.where(F.col(value).rlike(anchored))
    step = F.regexp_extract(value, anchored, 1).try_cast("bigint") + (1 if step_one else 0)
    other = [c for c in lines.columns if c != value]
    return hit.select(*other, step.alias("step"), F.regexp_extract(value, anchored, 2).try_cast("double").alias("metric"))


def run_status(logs: DataFrame, outputs: DataFrame, locations: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Per location: started (it has a log), success (it has an output), and its lines with ``fail``."""
    started = logs.groupBy(*by).agg(F.lit(True).alias("_s"), F.array_sort(F.collect_set(F.when(F.lower(value).contains("fail"), F.col(value)))).alias("_e"))
    done = outputs.select(*by).distinct().withColumn("_o", F.lit(True))
    out = locations.select(*by).distinct().join(started, by, "left").join(done, by, "left")
    return out.select(*by, F.coalesce("_s", F.lit(False)).alias("started"), F.coalesce("_o", F.lit(False)).alias("success"), F.coalesce("_e", F.array().cast("array<string>")).alias("errors"))


def status_summary(status: DataFrame, stage: list[str]) -> DataFrame:
    """Counts of succeeded, failed, running and not started runs per stage."""
    ok, bad = F.col("success"), F.size("errors") > 0
    return status.groupBy(*stage).agg(
        F.count_if(ok).alias("succeeded"), F.count_if(~ok & F.col("started") & bad).alias("failed"),
        F.count_if(~ok & F.col("started") & ~bad).alias("running"), F.count_if(~ok & ~F.col("started")).alias("not_started"),
    )


def runtime_summary(logs: DataFrame, by: list[str], labels: dict[str, str], value: str = "value") -> DataFrame:
    """For each named text, the largest number after ``=`` on a line with it."""
    number = F.regexp_extract(value, r"=\s*([-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?)", 1).try_cast("double")
    return logs.groupBy(*by).agg(*[F.max(F.when(F.col(value).contains(text), number)).alias(name) for name, text in labels.items()])
