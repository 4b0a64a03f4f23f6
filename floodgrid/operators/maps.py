"""Whole maps in patch form (R9, R11, R13, P26): patches stay rows, only their edges are exchanged.

A patch is keys, patch_row, patch_col and row-major arrays of h * w values.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from .resample import light

_SIDES = ("above", "below", "before", "behind")


def whole_map(patches: DataFrame, keys: list[str], rows: int, cols: int, values: list[str]) -> DataFrame:
    """All rows * cols tiles of each key: missing ones have NULL arrays and ``mask`` 0, the others 1."""
    tile = F.explode(F.sequence(F.lit(0), F.lit(rows * cols - 1)))
    tiles = patches.select(*keys).distinct().withColumn("_i", tile)
    tiles = tiles.select(*keys, F.floor(F.col("_i") / cols).cast("int").alias("patch_row"), (F.col("_i") % cols).cast("int").alias("patch_col"))
    there = patches.select(*keys, "patch_row", "patch_col", *values, F.lit(1).alias("mask"))
    return tiles.join(there, [*keys, "patch_row", "patch_col"], "left").withColumn("mask", F.coalesce("mask", F.lit(0)))


def with_edges(patches: DataFrame, keys: list[str], h: int, w: int, value: str = "values") -> DataFrame:
    """Adds the neighbours' edges: rows ``above`` and ``below``, columns ``before`` and ``behind``; NULL where none is."""
    v, row, col = F.col(value), F.col("patch_row"), F.col("patch_col")
    column = lambda at: F.transform(F.sequence(F.lit(0), F.lit(h - 1)), lambda i: F.get(v, i * w + at))
    sent = {
        "above": (row + 1, col, F.slice(v, (h - 1) * w + 1, w)), "below": (row - 1, col, F.slice(v, 1, w)),
        "before": (row, col + 1, column(w - 1)), "behind": (row, col - 1, column(0)),
    }
    out = F.explode(F.array(*(F.struct(r.alias("r"), c.alias("c"), F.lit(side).alias("side"), edge.alias("edge")) for side, (r, c, edge) in sent.items())))
    edges = patches.select(*keys, out.alias("_e")).select(*keys, F.col("_e.r").alias("patch_row"), F.col("_e.c").alias("patch_col"), "_e.side", "_e.edge")
    met = edges.groupBy(*keys, "patch_row", "patch_col").agg(*(F.max(F.when(F.col("side") == s, F.col("edge"))).alias(s) for s in _SIDES))
    return patches.join(met, [*keys, "patch_row", "patch_col"], "left")


def _stack(column: pa.Array, *shape: int) -> np.ndarray:
    """Arrays of one size as a stack, NaN for nulls and missing arrays."""
    n = math.prod(shape)
    there = np.flatnonzero(np.asarray(pc.equal(pc.list_value_length(column), n).fill_null(False)))
    out = np.full((len(column), *shape), np.nan)
    out[there] = column.take(pa.array(there)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(there), *shape)
    return out


def _lists(x: np.ndarray, none: np.ndarray | None = None) -> pa.Array:
    """A stack as lists, NaN as null; ``none``: which rows are null."""
    flat = x.reshape(len(x), -1)
    values = pa.array(flat.ravel(), from_pandas=True)
    offsets = pa.array(np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1], mask=np.append(none, False) if none is not None else None)
    return pa.ListArray.from_arrays(offsets, values)


def map_stencil(
    patches: DataFrame, keys: list[str], rows: int, cols: int, h: int, w: int, run: Callable[[np.ndarray, dict[str, np.ndarray]], np.ndarray], into: str, value: str = "values"
) -> DataFrame:
    """``into``: ``run`` of each patch with a ring of its neighbours' cells around it, (n, h + 2, w + 2).

    ``run`` also gets, for each side, which patches lie at that end of the map. The ring's corners
    and what missing tiles would hold are NaN; NaN comes back as NULL.
    """
    ready = with_edges(patches.where(F.col(value).isNotNull()), keys, h, w, value)
    own = patches.columns
    fields = [*patches.schema.fields, StructField(into, ArrayType(DoubleType()))]

    def padded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
            x = np.full((batch.num_rows, h + 2, w + 2), np.nan)
            x[:, 1:-1, 1:-1] = _stack(at[value], h, w)
            x[:, 0, 1:-1], x[:, -1, 1:-1] = _stack(at["above"], w), _stack(at["below"], w)
            x[:, 1:-1, 0], x[:, 1:-1, -1] = _stack(at["before"], h), _stack(at["behind"], h)
            r, c = (at[k].to_numpy(zero_copy_only=False) for k in ("patch_row", "patch_col"))
            ends = {"above": r == 0, "below": r == rows - 1, "before": c == 0, "behind": c == cols - 1}
            yield pa.RecordBatch.from_arrays([*(at[k] for k in own), _lists(run(x, ends))], names=[*own, into])

    return ready.mapInArrow(padded, StructType(fields))


def _slopes(x: np.ndarray, ends: dict[str, np.ndarray], dx: float) -> tuple[np.ndarray, np.ndarray]:
    """Central differences along y and x; one-sided at the map's ends, 0 where it is one cell wide."""
    def along(v: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        before, here, behind = v[:, :-2], v[:, 1:-1], v[:, 2:]
        g = (behind - before) / (2 * dx)
        g[first, 0] = (behind - here)[first, 0] / dx
        g[last, -1] = (here - before)[last, -1] / dx
        if g.shape[1] == 1:
            g[first & last] = 0.0
        return g

    down = along(x[:, :, 1:-1], ends["above"], ends["below"])
    return down, along(x[:, 1:-1].transpose(0, 2, 1), ends["before"], ends["behind"]).transpose(0, 2, 1)


def map_hillshade(
    patches: DataFrame, keys: list[str], rows: int, cols: int, h: int, w: int, azimuth: float = 315.0, altitude: float = 45.0, value: str = "values", dx: float = 1.0
) -> DataFrame:
    """``shade`` of every patch as of the whole map: see :func:`floodgrid.operators.resample.hillshade`.

    A cell beside a missing one or a missing tile is NULL.
    """
    east, south, up = light(azimuth, altitude)

    def shade(x: np.ndarray, ends: dict[str, np.ndarray]) -> np.ndarray:
        gy, gx = _slopes(x, ends, dx)
        return np.clip(((up - east * gx - south * gy) / np.sqrt(1 + gx * gx + gy * gy) + 1) / 2, 0, 1)

    return map_stencil(patches, keys, rows, cols, h, w, shade, "shade", value)


def tv_of_patches(patches: DataFrame, h: int, w: int, value: str = "values") -> DataFrame:
    """``tv`` of each patch: the mean absolute difference of neighbours along y plus that along x; no shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _stack(batch.column(batch.schema.names.index(value)), h, w)
            total = np.zeros(len(x))
            for axis in (1, 2):
                d = np.abs(np.diff(x, axis=axis)).reshape(len(x), -1)
                n = np.isfinite(d).sum(axis=1)
                with np.errstate(invalid="ignore", divide="ignore"):
                    total += np.where(n > 0, np.nansum(d, axis=1) / n, np.nan)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(total, from_pandas=True)], names=[*batch.schema.names, "tv"])

    return patches.mapInArrow(run, StructType([*patches.schema.fields, StructField("tv", DoubleType())]))


def _weights(n: int, s: int) -> np.ndarray:
    """(n * s, n): the shares of coarse places in fine ones; half-pixel centres, ends clamped."""
    at = np.maximum((np.arange(n * s) + 0.5) / s - 0.5, 0)
    low = np.minimum(np.floor(at).astype(int), n - 1)
    out = np.zeros((n * s, n))
    out[np.arange(n * s), low] += 1 - (at - low)
    out[np.arange(n * s), np.minimum(low + 1, n - 1)] += at - low
    return out


def resize_patches(patches: DataFrame, h: int, w: int, s: int, mode: str, value: str = "values", into: str = "resized") -> DataFrame:
    """``into``: each patch's array s times as fine (``bilinear``, ``nearest``) or as coarse (``mean``); no shuffle.

    A fine cell of a missing coarse neighbour is NULL; a mean leaves missing cells out.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, cols = _weights(h, s), _weights(w, s)
        for batch in batches:
            x = _stack(batch.column(batch.schema.names.index(value)), h, w)
            if mode == "mean":
                blocks = x.reshape(len(x), h // s, s, w // s, s)
                n = np.isfinite(blocks).sum(axis=(2, 4))
                out = np.where(n > 0, np.nansum(blocks, axis=(2, 4)) / np.maximum(n, 1), np.nan)
            elif mode == "nearest":
                out = x.repeat(s, axis=1).repeat(s, axis=2)
            else:
                known = np.isfinite(x)
                out = rows @ np.where(known, x, 0.0) @ cols.T
                out[rows @ known.astype(float) @ cols.T < 1 - 1e-9] = np.nan
            yield pa.RecordBatch.from_arrays([*batch.columns, _lists(out)], names=[*batch.schema.names, into])

    return patches.mapInArrow(run, StructType([*patches.schema.fields, StructField(into, ArrayType(DoubleType()))]))
