"""All registered queries of the library itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import grids, hydrology, more, rest, scores, sources
from .registry import QUERIES, SQL, Query

_MODULES = (scores, grids, hydrology, more, rest, sources)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of all time steps, scenarios and the data set."""
    return scores.p14_global_metrics(spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
