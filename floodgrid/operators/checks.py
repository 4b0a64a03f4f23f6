"""Set operations and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import rewrite_prefix


def rows_in_split(index: DataFrame, split: DataFrame, row_id: str = "row_id") -> DataFrame:
    return index.join(split.select(row_id), row_id, "left_semi")


def same_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that only one table has, with ``side``; empty if the sets are equal."""
    x, y = a.select(*keys).distinct(), b.select(*keys).distinct()
    return x.exceptAll(y).withColumn("side", F.lit("a")).union(y.exceptAll(x).withColumn("side", F.lit("b")))


def require_columns(df: DataFrame, cols: list[str], aliases: dict[str, str] | None = None) -> DataFrame:
    """``df`` if it has the columns, after renaming known old names; ValueError tells what is missing."""
    for old, new in (aliases or {}).items():
        if old in df.columns and new not in df.columns:
            df = df.withColumnRenamed(old, new)
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def check_same_grid(a: DataFrame, b: DataFrame, axes: tuple[str, ...] = ("y", "x")) -> bool:
    return same_keys(a, b, list(axes)).isEmpty()


def check_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with several rows."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def missing_files(index: DataFrame, listing: DataFrame, path: str = "path") -> DataFrame:
    return index.join(listing.select(path), path, "left_anti")


def rewrite_prefixes(df: DataFrame, rules: list[tuple[str, str]], cols: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rewritten rows, one row of counters): the first matching rule rewrites a cell.

    Counters: ``rows``, ``rows_changed`` and ``cells_changed``; asking for them alone is a dry run.
    """
    new = {c: rewrite_prefix(c, rules) for c in cols}
    changed = [F.coalesce(new[c] != F.col(c), F.lit(False)) for c in cols]
    cells = sum((x.cast("long") for x in changed[1:]), changed[0].cast("long"))
    counters = df.agg(F.count("*").alias("rows"), F.count_if(cells > 0).alias("rows_changed"), F.coalesce(F.sum(cells), F.lit(0)).alias("cells_changed"))
    return df.withColumns(new), counters
