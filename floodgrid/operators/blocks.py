"""Running values and neighbours along ordered series of any length.

A series of more than ``rows`` rows is cut into blocks of consecutive rows, so that no task sorts a whole
hot series. Blocks are summed up (a maximum, a last value, a factor and an offset, edge rows), the
few summaries of a series are scanned in order, and what each block takes over is joined back.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, TimestampNTZType, TimestampType

#: Rows that a series may have before it is cut.
ROWS = 1_000_000
#: Blocks that all long series together are cut into at most by time; each holds an even share of their rows.
MOST_BLOCKS = 4096


def join_same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equal keys, nulls being equal; the keys of ``right`` are left out."""
    if not keys:
        return left.crossJoin(right)  # one row
    other = right.withColumnsRenamed({k: f"_same_{k}" for k in keys})
    on = [left[k].eqNullSafe(other[f"_same_{k}"]) for k in keys]
    return left.join(other, on, how).drop(*(f"_same_{k}" for k in keys))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: the lineage ends there."""
    from ..streaming.streams import checkpoint_path

    path = checkpoint_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def place_of(df: DataFrame, order: str) -> Column:
    """The order column as a double: numbers, dates or timestamps (in microseconds, exact)."""
    kind = df.schema[order].dataType
    if isinstance(kind, (DateType, TimestampType, TimestampNTZType)):
        return F.unix_micros(F.col(order).cast("timestamp")).cast("double")
    return F.col(order).cast("double")


def smoothed_values(x: np.ndarray, weight: float, start: float | None = None) -> np.ndarray:
    """``weight`` * previous + (1 - weight) * x, from the first value or from ``start``; no nulls in ``x``.

    Sums over 1, 2, 4, .. values, in extended precision: results are rounded to doubles once, not at each step.
    """
    y = (np.longdouble(1) - weight) * x.astype(np.longdouble)
    if len(y):
        y[0] = x[0] if start is None else weight * np.longdouble(start) + y[0]
    step, power = 1, np.longdouble(weight)
    while step < len(y) and abs(power) > 1e-30:
        with np.errstate(invalid="ignore"):
            y[step:] = y[step:] + power * y[:-step]
        step, power = 2 * step, power * power
    if len(y) and not np.isfinite(x).all():  # what is infinite or not a number stays so to the end
        first = int(np.argmax(~np.isfinite(x)))
        with np.errstate(invalid="ignore"):
            y[first:] = np.cumsum(x[first:])
    return y.astype(float)


class Blocks:
    """``df`` with ``_block``: consecutive numbers along each series, 0 throughout for a short one.

    Bounds are percentiles of the order column over the rows of all long series, so that a block of
    one has no more than its share of them, however unevenly it is spread; only rows of one equal
    place can't be parted. Rows with a null place come first, as Spark sorts them. With no long
    series nothing is added to the plan.
    """

    def __init__(self, df: DataFrame, by: list[str], order: str, rows: int = ROWS):
        self.by, self.order = list(by), order
        counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
        long = F.col("_n") > rows
        most = counts.agg(F.sum(F.when(long, F.col("_n"))).alias("n")).first()["n"]
        self.split = most is not None
        if not self.split:
            self.df = df.withColumn("_block", F.lit(0))
            return
        parts = min(MOST_BLOCKS, math.ceil(most / rows) + 1)
        marked = join_same(df, counts.where(long).select(*by, F.lit(True).alias("_long")), self.by, "left").withColumn("_place", place_of(df, order))
        fractions = [i / parts for i in range(1, parts)]
        bounds = marked.where("_long").agg(F.percentile_approx("_place", fractions, 10 * parts).alias("q")).first()["q"]
        splits = [-math.inf, *sorted(set(bounds or [0.0])), math.inf]
        cut = Bucketizer(splits=splits, inputCol="_place", outputCol="_bucket", handleInvalid="keep").transform(marked.withColumn("_place", F.coalesce("_place", F.lit(-math.inf))))
        number = F.when(F.col("_long") & F.col(order).isNotNull(), F.col("_bucket").cast("int")).when(F.col("_long"), F.lit(-1)).otherwise(F.lit(0))
        self.df = cut.withColumn("_block", number).drop("_long", "_place", "_bucket")

    def _carried(self, out: DataFrame, carry: DataFrame) -> DataFrame:
        return join_same(out, carry, [*self.by, "_block"], "left")

    def running(self, values: dict[str, Column | str | tuple[Column | str, bool]], kind: str = "max", ties: tuple[Column, ...] = ()) -> DataFrame:
        """Adds, for each name, the greatest (``max``), the sum or the last non-null value (``last``) up to each row.

        A value given with True runs backwards, from the end. ``ties`` orders rows of one place either
        way; non-null values of one place must be one alone for ``last``.
        """
        op = {"max": F.max, "sum": F.sum, "last": lambda c: F.last(c, True)}[kind]
        wanted = {n: v if isinstance(v, tuple) else (v, False) for n, v in values.items()}
        wanted = {n: (F.col(v) if isinstance(v, str) else v, back) for n, (v, back) in wanted.items()}

        def before(end: int, keys: list[str], order: str, back: bool, more: tuple[Column, ...] = ()) -> WindowSpec:
            return Window.partitionBy(*keys).orderBy(F.desc(order) if back else F.asc(order), *more).rowsBetween(Window.unboundedPreceding, end)

        out = self.df.withColumns({n: op(v).over(before(0, [*self.by, "_block"], self.order, back, ties)) for n, (v, back) in wanted.items()})
        if not self.split:
            return out.drop("_block")

        def end(v: Column, back: bool) -> Column:
            return op(v) if kind != "last" else (F.min_by if back else F.max_by)(v, F.when(v.isNotNull(), F.col(self.order)))

        edges = self.df.groupBy(*self.by, "_block").agg(*(end(*v).alias(f"_c_{n}") for n, v in wanted.items()))
        carry = {f"_c_{n}": op(F.col(f"_c_{n}")).over(before(-1, self.by, "_block", back)) for n, (_, back) in wanted.items()}
        join = {"max": F.greatest, "sum": lambda a, b: F.coalesce(a + b, a, b), "last": F.coalesce}[kind]
        out = self._carried(out, edges.withColumns(carry)).withColumns({n: join(F.col(n), F.col(f"_c_{n}")) for n in wanted})
        return out.drop("_block", *carry)

    def neighbours(self, value: Column, before: str | None = None, after: str | None = None) -> DataFrame:
        """Adds the value of the row before and of the row after; null at the ends. Equal places go by their values."""
        df = self.df.withColumn("_own_value", F.struct(value.alias("v")))
        w = Window.partitionBy(*self.by, "_block").orderBy(self.order, "_own_value")
        sides = {n: f for n, f in ((before, F.lag), (after, F.lead)) if n}
        out = df.withColumns({n: f("_own_value").over(w) for n, f in sides.items()})
        if self.split:
            key = F.struct(self.order, "_own_value")
            edges = df.groupBy(*self.by, "_block").agg(F.max_by("_own_value", key).alias("_last"), F.min_by("_own_value", key).alias("_first"))
            along = Window.partitionBy(*self.by).orderBy("_block")
            out = self._carried(out, edges.select(*self.by, "_block", F.lag("_last").over(along).alias("_lag"), F.lead("_first").over(along).alias("_lead")))
            out = out.withColumns({n: F.coalesce(n, "_lag" if f is F.lag else "_lead") for n, f in sides.items()}).drop("_lag", "_lead")
        return out.withColumns({n: F.col(n)["v"] for n in sides}).drop("_own_value", "_block")

    def smoothed(self, value: str, weight: float, into: str) -> DataFrame:
        """``weight`` * previous + (1 - weight) * value from the first value on; a null repeats what was before.

        A block turns the state c before it into factor * c + offset; before the first value c is that value.
        """
        by, order, split, fields = self.by, self.order, self.split, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.df.schema)

        def local(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values(order, kind="stable", na_position="first")
            x = frame[value].astype(float)
            known = x.dropna()
            offset = smoothed_values(known.to_numpy(), weight, 0.0 if split else None)
            n = x.notna().cumsum()
            return frame.assign(_factor=(weight if split else 0.0) ** n.to_numpy(), _offset=pd.Series(offset, known.index).reindex(x.index).ffill().fillna(0.0), _begun=n > 0, _known=float(known.iloc[0]) if len(known) else float("nan"), _at=range(len(x)))

        out = self.df.groupBy(*by, "_block").applyInPandas(local, f"{fields}, _factor double, _offset double, _begun boolean, _known double, _at int")
        own = ("_factor", "_offset", "_begun", "_known", "_at", "_block")
        if not self.split:
            return out.withColumn(into, F.when(F.col("_begun"), F.col("_offset"))).drop(*own)
        edges = out.groupBy(*by, "_block").agg(F.max_by(F.struct("_factor", "_offset", "_known"), "_at").alias("e")).select(*by, "_block", "e.*")
        keys = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in edges.schema if f.name in by)

        def along(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values("_block")
            carry, given, state = [], [], None
            for factor, offset, known in zip(frame["_factor"], frame["_offset"], frame["_known"], strict=True):
                given.append(state is not None)
                if state is None and not math.isnan(known):
                    state = known
                carry.append(state)
                state = None if state is None else factor * state + offset
            return frame[[*by, "_block"]].assign(_carry=pd.Series(carry, frame.index, dtype=float), _given=given)

        joined = self._carried(out, edges.groupBy(*by).applyInPandas(along, f"{keys}_block int, _carry double, _given boolean"))
        state = F.when(F.col("_begun") | F.col("_given"), F.col("_factor") * F.col("_carry") + F.col("_offset"))
        return joined.withColumn(into, state).drop(*own, "_carry", "_given")
