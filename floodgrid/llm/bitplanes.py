"""Exact k-means of 64-component integer vectors by bit planes and population counts.

Bit i of all 64 components is one 64-bit word, so that a vector of B-bit integers (two's complement)
is B words. The dot product of two vectors is the sum over pairs of planes of their AND's population
count, weighted by 2^(i + j), negative where just one of the two is a sign plane. No rounding occurs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField, StructType

from .text import Scratch, map_batches, quoted

DIMS = 64
#: Integers beyond it could give squared distances beyond 63 bits.
LIMIT = 1 << 27
_RESULT = [StructField("cluster", IntegerType()), *(StructField(c, LongType()) for c in ("distance", "cluster_inertia", "inertia")), StructField("centroid_sha256", StringType())]
#: Vectors that meet the centroids at a time: their counts stay in a core's cache.
_ROWS = 512


def integers(column: pa.Array, scale: int, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors that count, as floor(scale * x), and their rows.

    Those with another length, with a null or non-finite component, or with an integer beyond
    LIMIT are left out.
    """
    rows = np.flatnonzero(np.asarray(pc.equal(pc.list_value_length(column), dims).fill_null(False)))
    values = column.take(pa.array(rows)).flatten().cast(pa.float64())
    with np.errstate(over="ignore", invalid="ignore"):
        x = np.floor(np.asarray(values.to_numpy(zero_copy_only=False), np.float64).reshape(len(rows), dims) * scale)
        fine = (np.abs(x) <= LIMIT).all(axis=1)  # false for NaN
    return x[fine].astype(np.int64), rows[fine]


def widths(q: np.ndarray) -> np.ndarray:
    """Planes that each vector needs, its sign plane included."""
    most = np.maximum(q, ~q).max(axis=1, initial=0)
    return np.frexp(most.astype(np.float64))[1] + 1


def to_planes(q: np.ndarray, width: int) -> np.ndarray:
    """(n, width) words: bit d of word i is bit i of component d."""
    out = np.empty((len(q), width), "<u8")
    for i in range(width):
        out[:, i] = np.packbits(((q >> i) & 1).astype(np.uint8), axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def from_planes(planes: np.ndarray) -> np.ndarray:
    width = planes.shape[1]
    bits = np.unpackbits(np.ascontiguousarray(planes).view(np.uint8).reshape(len(planes), width, 8), axis=2, bitorder="little")
    weights = 1 << np.arange(width, dtype=np.int64)
    weights[-1] *= -1
    return np.einsum("nwd,w->nd", bits.astype(np.int64), weights)


def dot_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact dot products (n, k) of vectors given as planes."""
    last_a, last_b = a.shape[1] - 1, b.shape[1] - 1
    total = np.zeros((len(a), len(b)), np.int64)
    for shift in range(last_a + last_b + 1):
        count = np.zeros(total.shape, np.int16)
        for i in range(max(0, shift - last_b), min(last_a, shift) + 1):
            j = shift - i
            ones = np.bitwise_count(a[:, i, None] & b[None, :, j])
            if (i == last_a) != (j == last_b):
                count -= ones
            else:
                count += ones
        total += count.astype(np.int64) << shift
    return total


def nearest(planes: np.ndarray, q: np.ndarray, centroids: np.ndarray, of_centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid's number (ties: the smaller) and the squared distance."""
    squares = np.einsum("kd,kd->k", centroids, centroids)
    cluster, distance = np.empty(len(q), np.int32), np.empty(len(q), np.int64)
    for at in range(0, len(q), _ROWS):
        part = slice(at, at + _ROWS)
        d = squares - 2 * dot_products(planes[part], of_centroids)
        cluster[part] = d.argmin(axis=1)
        distance[part] = d.min(axis=1) + np.einsum("nd,nd->n", q[part], q[part])
    return cluster, distance


def _groups(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The planes of a batch, and their rows, by width."""
    sizes = np.asarray(pc.binary_length(column))
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        words = b"".join(column.take(pa.array(rows)).to_pylist())
        yield np.frombuffer(words, "<u8").reshape(len(rows), size // 8), rows


def pack_planes(vectors: DataFrame, scale: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id``, ``planes binary``: the vectors that count, each with as many planes as it needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q, rows = integers(batch.column(1), scale, DIMS)
            width = widths(q)
            for w in np.unique(width):
                own = np.flatnonzero(width == w)
                words = to_planes(q[own], int(w))
                ids = batch.column(0).take(pa.array(rows[own]))
                yield pa.RecordBatch.from_arrays([ids, pa.array([x.tobytes() for x in words], pa.binary())], names=["id", "planes"])

    plain = vectors.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(vector_col)).alias("vector"))
    return map_batches(plain, run, StructType([StructField("vec_id", plain.schema["id"].dataType), StructField("planes", BinaryType())]))


def _means(packed: DataFrame, centroids: np.ndarray) -> list[tuple[int, int, int]]:
    """(cluster, component, floor of the mean) of each non-empty cluster; tasks add up their own rows first."""
    of_centroids = to_planes(centroids, int(widths(centroids).max()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for batch in batches:
            for planes, _ in _groups(batch.column(0)):
                q = from_planes(planes)
                cluster, _ = nearest(planes, q, centroids, of_centroids)
                order = np.argsort(cluster, kind="stable")
                found, first = np.unique(cluster[order], return_index=True)
                n[found] += np.diff(np.append(first, len(order)))
                total[found] += np.add.reduceat(q[order], first, axis=0)
        some = np.flatnonzero(n)
        columns = [np.repeat(some, DIMS), np.tile(np.arange(DIMS), len(some)), np.repeat(n[some], DIMS), total[some].ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["cluster", "d", "n", "total"])

    parts = packed.select("planes").mapInArrow(run, "cluster long, d long, n long, total long")
    met = parts.groupBy("cluster", "d").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    return [(r["cluster"], r["d"], int(r["total"]) // r["n"]) for r in met.collect()]  # k * 64 rows


def _assigned(packed: DataFrame, centroids: np.ndarray) -> DataFrame:
    of_centroids = to_planes(centroids, int(widths(centroids).max()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for planes, rows in _groups(batch.column(1)):
                cluster, distance = nearest(planes, from_planes(planes), centroids, of_centroids)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(cluster), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    schema = StructType([packed.schema["vec_id"], StructField("cluster", IntegerType()), StructField("distance", LongType())])
    return map_batches(packed.select("vec_id", "planes"), run, schema)


def plane_kmeans(vectors: DataFrame, k: int = 40, rounds: int = 5, scale: int = 256, seed: str = "2", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector that counts: ``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256``.

    Components become floor(scale * x). Centroids start as the ``k`` vectors of the smallest SHA-256
    (in hex) of ``seed:id``, in that order; each round assigns every vector to the nearest centroid
    (ties: the smaller number) and then takes each cluster's floor(sum / count); empty clusters keep
    their centroid. Vectors are assigned once more at the end. ``distance`` is squared.

    Left out: vectors that are null, have another length than 64, a null or non-finite component, or
    one whose integer is beyond 2^27 (distances would not fit a long). Repeated rows count each. Null
    ids can be centroids only after all others; equal ids are told apart by their planes. With fewer
    than k vectors there are fewer centroids; an empty table gives no rows. Other columns don't
    matter. An inertia beyond a long is null.

    Rows are never shuffled: each pass over the packed planes, written once, adds up its own rows,
    and 64 k numbers a task meet. The driver holds k centroids.
    """
    spark = vectors.sparkSession
    tables = Scratch(spark)
    packed = tables.write(pack_planes(vectors, scale, id_col, vector_col), "planes")
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    seeds = packed.select(rank.alias("rank"), "planes").orderBy(F.col("rank").asc_nulls_last(), "planes").limit(k).collect()
    if not seeds:
        tables.clear()
        return spark.createDataFrame([], StructType([packed.schema["vec_id"], *_RESULT]))
    centroids = np.concatenate([from_planes(np.frombuffer(r["planes"], "<u8")[None, :]) for r in seeds])
    for _ in range(rounds):
        centroids, before = centroids.copy(), centroids
        for c, d, mean in _means(packed, before):
            centroids[c, d] = mean
    assigned = tables.write(_assigned(packed, centroids), "clusters", instead_of=(packed,))
    inertia = {r["cluster"]: int(r["i"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("i")).collect()}

    def long(x: int) -> int | None:
        return x if x < 1 << 63 else None

    total = long(sum(inertia.values()))
    rows = [Row(cluster=c, cluster_inertia=long(inertia[c]), inertia=total, centroid_sha256=hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c in sorted(inertia)]
    per_cluster = spark.createDataFrame(rows, StructType([_RESULT[0], *_RESULT[2:]]))  # k rows
    return assigned.join(F.broadcast(per_cluster), "cluster").select("vec_id", *(f.name for f in _RESULT))

