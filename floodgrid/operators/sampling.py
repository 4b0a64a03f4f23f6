"""Splits, extremes, weights and draws.

Seeded choices use ``md5(seed:key)``, which any engine computes alike; they replace generators
whose sequences only one library has.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import ROWS, Blocks


def hash_order(seed: int | str, *keys: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def uniform(seed: int | str, *keys: Column) -> Column:
    """A number in [0, 1) of 52 bits from md5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys])), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def train_val_split(index: DataFrame, by: str = "scenario", ratio: float = 0.1, seed: int = 0, row_id: str = "row_id") -> DataFrame:
    """``split``: per group, max(1, half-even(n * ratio)) rows are val, by hash order; the rest train.

    Rows are counted by the first 16 bits of their hashes. In each group the border between val and
    train falls into one such part, whose rows alone are ranked; all rows then compare their hashes with
    the border's, one row a group, and are not shuffled. Rows of one id go together.
    """
    rows = index.withColumn("_key", hash_order(seed, row_id)).withColumn("_part", F.substring("_key", 1, 4))
    parts = rows.groupBy(F.col(by).alias("_by"), F.col("_part").alias("_p")).agg(F.count("*").alias("_n"))
    group = Window.partitionBy("_by")  # at most 65,536 rows
    parts = parts.withColumns({"_before": F.sum("_n").over(group.orderBy("_p")) - F.col("_n"), "_total": F.sum("_n").over(group)})
    val = F.greatest(F.lit(1), F.bround(F.col("_total") * F.lit(float(ratio)), 0))
    border = parts.where((F.col("_before") < val) & (val <= F.col("_before") + F.col("_n"))).select("_by", "_p", (val - F.col("_before")).alias("_rank"))
    inside = rows.join(border, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_part") == F.col("_p"))).select("_by", "_rank", F.struct("_key", row_id).alias("_last"))
    ends = inside.withColumn("_k", F.row_number().over(Window.partitionBy("_by").orderBy("_last"))).where(F.col("_k") == F.col("_rank")).select("_by", "_last")
    placed = rows.join(ends, F.col(by).eqNullSafe(F.col("_by")))
    return placed.withColumn("split", F.when(F.struct("_key", row_id) <= F.col("_last"), "val").otherwise("train")).select(*index.columns, "split")


def best_worst(df: DataFrame, better: dict[str, str], ids: list[str], by: list[str] | None = None) -> DataFrame:
    """Best and worst row of each metric: ``better`` maps it to higher, lower or neutral.

    NULLs are left out, the first row by ``ids`` wins ties; a neutral metric's "best" is its
    minimum. Columns: by, metric, better, best and worst values and structs of ids.
    """
    by = by or []
    pairs = ", ".join(f"'{m}', CAST(`{m}` AS DOUBLE)" for m in better)
    names = F.create_map(*[x for m, b in better.items() for x in (F.lit(m), F.lit(b))])
    long = df.select(*by, *ids, F.expr(f"stack({len(better)}, {pairs}) AS (metric, v)")).where("v IS NOT NULL AND NOT isnan(v)")
    key = F.struct(*ids)
    out = long.groupBy(*by, "metric").agg(
        F.min(F.struct(F.col("v").alias("v"), key.alias("k"))).alias("low"), F.min(F.struct((-F.col("v")).alias("v"), key.alias("k"))).alias("high")
    )
    up = names[F.col("metric")] == "higher"
    low, high = F.struct(F.col("low.v").alias("v"), F.col("low.k").alias("k")), F.struct((-F.col("high.v")).alias("v"), F.col("high.k").alias("k"))
    best, worst = F.when(up, high).otherwise(low), F.when(up, low).otherwise(high)
    return out.select(*by, "metric", names[F.col("metric")].alias("better"), best["v"].alias("best"), best["k"].alias("best_ids"), worst["v"].alias("worst"), worst["k"].alias("worst_ids"))


def top_k(df: DataFrame, metric: str, k: int, by: list[str], ids: list[str], largest: bool = True) -> DataFrame:
    """The k rows of each group with the largest (or smallest) metric, with ``rank``; ties by ids."""
    order = F.desc_nulls_last(metric) if largest else F.asc_nulls_last(metric)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(order, *ids))
    return df.where(F.col(metric).isNotNull()).withColumn("rank", rank).where(F.col("rank") <= k)


def ordered_levels(df: DataFrame, scenario: str = "scenario", t: str = "t") -> DataFrame:
    from ..functions.columns import time_sort_key

    return df.orderBy(scenario, time_sort_key(t))


def sample_weights(patches: DataFrame, scores: list[dict], base: float = 1.0, cap: float | None = None, summary: DataFrame | None = None) -> DataFrame:
    """Adds ``weight``: base + the sum of alpha * score, at most ``cap``.

    A score: {"column", "alpha", "mode", ...}. mode "percentile": (r - lo) / (hi - lo) clipped to
    [0, 1], lo and hi given or taken from ``summary`` (one row); "ratio": min(r / reference, 1);
    "hard": r >= threshold. ValueError for negative alphas or caps, hi <= lo, or no positive weight.
    """
    if base < 0 or (cap is not None and cap <= 0) or any(s["alpha"] < 0 for s in scores):
        raise ValueError("base, cap and alpha must not be negative")
    out = patches if summary is None else patches.crossJoin(F.broadcast(summary))  # one row
    terms = [F.lit(float(base))]
    for s in scores:
        r = F.coalesce(F.col(s["column"]), F.lit(0.0))
        if s["mode"] == "percentile":
            if not isinstance(s["lo"], str) and s["hi"] <= s["lo"]:
                raise ValueError("hi must be over lo")
            lo, hi = (F.col(x) if isinstance(x, str) else F.lit(float(x)) for x in (s["lo"], s["hi"]))
            value = F.least(F.greatest(F.coalesce(F.try_divide(r - lo, hi - lo), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
        elif s["mode"] == "ratio":
            value = F.least(r / F.lit(float(s["reference"])), F.lit(1.0))
        else:
            value = (r >= s["threshold"]).cast("double")
        terms.append(value * s["alpha"])
    weight = reduce(lambda a, b: a + b, terms)
    out = out.withColumn("weight", weight if cap is None else F.least(weight, F.lit(float(cap))))
    return out if summary is None else out.drop(*summary.columns)


def weighted_sample(df: DataFrame, weight: str, ratio: float = 1.0, replicas: int = 1, epoch: int = 0, row_id: str = "row_id", buckets: int = 64, rows: int = ROWS) -> DataFrame:
    """ceil(n * ratio / replicas) * replicas draws with replacement, in proportion to the weights.

    Rows lie along a line in the order of (hash bucket, id), each as long as its weight; a draw (a hashed
    uniform number) is a spot on it. Weights are summed up in blocks, the blocks' sums within buckets,
    the buckets' at last, so that each row knows where it ends; then draws and row ends are ordered
    together, and a draw's row is the next end behind it. Both steps cut long stretches into blocks
    of about ``rows``, also where one row draws most. ``replica`` is draw_id modulo replicas. Rows without
    a positive weight are never drawn; ids must be numbers.
    """
    bucket = F.conv(F.substring(F.md5(F.col(row_id).cast("string")), 1, 8), 16, 10).cast("bigint") % buckets
    own = df.withColumns({"_b": bucket, "_w": F.col(weight).cast("double")}).where(F.col("_w") > 0)
    ends = Blocks(own, ["_b"], row_id, rows).running({"_end": "_w"}, "sum")
    totals = own.groupBy("_b").agg(F.sum("_w").alias("_t"))
    before = totals.select("_b", (F.sum("_t").over(Window.orderBy("_b")) - F.col("_t")).alias("_start"))  # one row per bucket
    ends = ends.join(F.broadcast(before), "_b").select(F.struct(*df.columns).alias("_row"), (F.col("_start") + F.col("_end")).alias("_at"))
    n = df.count()
    draws_n = -(-max(1, round(n * ratio)) // replicas) * replicas if n else 0
    whole = ends.agg(F.max("_at").alias("_all"))
    draws = df.sparkSession.range(draws_n).crossJoin(F.broadcast(whole)).where("_all IS NOT NULL")
    draws = draws.select(F.col("id").alias("draw_id"), (uniform(f"draw:{epoch}", F.col("id")) * F.col("_all")).alias("_at"))
    line = ends.unionByName(draws, allowMissingColumns=True)
    # from the far end: at one spot draws come before the row that ends there
    met = Blocks(line, [], "_at", rows).running({"_found": ("_row", True)}, "last", ties=(F.col("draw_id").isNull(), F.col("draw_id")))
    return met.where("draw_id IS NOT NULL").select("draw_id", (F.col("draw_id") % replicas).alias("replica"), "_found.*")


def enlarged_shuffle(df: DataFrame, ratio: int = 1, replicas: int = 1, epoch: int = 0, row_id: str = "row_id") -> DataFrame:
    """Every row ``ratio`` times (and a few more, so that replicas get equally many) in hash order: ``position``, ``replica``.

    Positions come from range-partitioned sorting and partition offsets, not from one window.
    """
    n = df.count()
    total = -(-(n * ratio) // replicas) * replicas if n else 0
    key = hash_order(f"shuffle:{epoch}", "copy", row_id)
    copies = df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(ratio - 1))))
    # fewer than `replicas` more, the first ones of another copy
    copies = copies.unionByName(df.withColumn("copy", F.lit(ratio)).orderBy(key, row_id).limit(total - n * ratio))
    # about a million rows in a part, of 256 to 1,048,576 parts
    digits = next((d for d in (2, 3, 4) if total <= 16**d * 1_000_000), 5)
    ranked = copies.withColumn("_k", key).withColumn("_p", F.conv(F.substring("_k", 1, digits), 16, 10).cast("int"))
    sizes = ranked.groupBy("_p").agg(F.count("*").alias("_n"))
    offsets = sizes.withColumn("_off", F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).select("_p", "_off")  # a row per part
    out = ranked.join(F.broadcast(offsets), "_p")
    out = out.withColumn("position", F.row_number().over(Window.partitionBy("_p").orderBy("_k", "copy", row_id)) - 1 + F.col("_off"))
    return out.withColumn("replica", F.col("position") % replicas).drop("_k", "_p", "_off")
