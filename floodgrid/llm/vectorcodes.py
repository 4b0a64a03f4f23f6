"""Product codes of vectors from exactly computed codebooks.

Vectors are cut into parts. Each part's values of a chunk of rows lie sorted along a Hilbert curve in
flat blocks, and each block has its least and greatest values (a box) and sums. In a round an entry
whose least distance from a block's box is beyond the greatest distance of another entry can't be
nearest to any of the block's rows: what is left is the block's shortlist. Where it is one entry, the
block's sums are all that the round needs; else an exact kernel compares the rows with the shortlist.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from .bitplanes import integers
from .text import _BATCH, Scratch, map_batches, quoted

#: Rows of a chunk, which is one row of the table of blocks, and of a block.
CHUNK = 8192
BLOCK = 64
#: Chunks in an Arrow batch; a chunk of 64 components is 2.5 MB at most.
_CHUNKS = 8
_RESULT = [StructField("code", StringType()), StructField("error", LongType()), StructField("label_error", LongType()), StructField("codebooks_sha256", StringType())]
#: Up to this integer all sums of a kernel are exact in doubles.
_SMALL = 1 << 22


def hilbert_keys(x: np.ndarray, bits: int) -> np.ndarray:
    """Place along a Hilbert curve of points with ``bits``-bit coordinates; d * bits is at most 64."""
    x = x.astype(np.uint64).T.copy()
    one, top = np.uint64(1), 1 << (bits - 1)
    q = top
    while q > 1:
        low = np.uint64(q - 1)
        for axis in x:
            turned = (axis & np.uint64(q)) != 0
            swap = np.where(turned, np.uint64(0), (x[0] ^ axis) & low)
            x[0] ^= np.where(turned, low, swap)
            axis ^= swap  # a view of x; for the first axis swap is 0
        q >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.uint64)
    q = top
    while q > 1:
        flip ^= np.where((x[-1] & np.uint64(q)) != 0, np.uint64(q - 1), np.uint64(0))
        q >>= 1
    key = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, -1, -1):
        for axis in x:
            key = (key << one) | (((axis ^ flip) >> np.uint64(b)) & one)
    return key


def hilbert_order(part: np.ndarray) -> np.ndarray:
    """The order of rows along the curve; parts of over 64 components are sorted by their first 64."""
    axes = part[:, :64]
    bits = min(16, max(1, 64 // axes.shape[1]))
    low = axes.min(axis=0)
    span = axes.max(axis=0) - low + 1
    return np.argsort(hilbert_keys(((axes - low) << bits) // span, bits), kind="stable")


def _bytes(x: np.ndarray, kind: str) -> bytes:
    return np.ascontiguousarray(x, kind).tobytes()


def _part_of(part: np.ndarray) -> dict[str, bytes]:
    """A chunk's values of one part, in flat blocks."""
    order = hilbert_order(part)
    values = part[order]
    first = np.arange(0, len(values), BLOCK)
    kind = "<i2" if len(values) and np.abs(values).max() < 1 << 15 else "<i4"
    return {
        "rows": _bytes(order, "<i4"), "values": _bytes(values, kind), "low": _bytes(np.minimum.reduceat(values, first, axis=0), "<i4"),
        "high": _bytes(np.maximum.reduceat(values, first, axis=0), "<i4"), "sums": _bytes(np.add.reduceat(values, first, axis=0), "<i8"),
    }


_FIELDS = ("rows", "values", "low", "high", "sums")
_PART = StructType([StructField(f, BinaryType()) for f in _FIELDS])


class Blocks:
    """One part of one chunk."""

    def __init__(self, part: dict[str, bytes], dims: int):
        self.rows = np.frombuffer(part["rows"], "<i4")
        kind = f"<i{len(part['values']) // (len(self.rows) * dims)}"
        self.values = np.frombuffer(part["values"], kind).reshape(-1, dims)
        self.low, self.high = (np.frombuffer(part[f], "<i4").reshape(-1, dims).astype(np.int64) for f in ("low", "high"))
        self.sums = np.frombuffer(part["sums"], "<i8").reshape(-1, dims)
        self.sizes = np.full(len(self.sums), BLOCK)
        self.sizes[-1] = len(self.rows) - BLOCK * (len(self.sums) - 1)

    def shortlists(self, entries: np.ndarray) -> np.ndarray:
        """(blocks, entries): whether an entry may be nearest to a row of the block."""
        out = np.empty((len(self.low), len(entries)), bool)
        for at in range(0, len(out), 32):
            low, high = self.low[at : at + 32, None], self.high[at : at + 32, None]
            under, over = low - entries, entries - high
            least = np.maximum(np.maximum(under, over), 0)
            most = np.maximum(np.abs(under), np.abs(over))
            nearest = np.einsum("bed,bed->be", least, least)
            out[at : at + 32] = nearest <= np.einsum("bed,bed->be", most, most).min(axis=1)[:, None]
        return out

    def assign(self, entries: np.ndarray, distances: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the sorted rows the nearest entry (ties: the lower) and squared distance; which blocks went whole.

        Without ``distances`` a block that goes to one entry as a whole costs nothing by row.
        """
        small = max(np.abs(entries).max(initial=0), np.abs(self.low).max(initial=0), np.abs(self.high).max(initial=0)) <= _SMALL
        kind = np.float64 if small else np.int64
        e, x = entries.astype(kind), self.values.astype(kind)
        squares = (e * e).sum(axis=1)
        short = self.shortlists(entries)
        whole = short.sum(axis=1) == 1
        code = np.repeat(short.argmax(axis=1), self.sizes)
        error = np.zeros(len(code), np.int64)
        for b in np.flatnonzero(~whole):
            own = slice(b * BLOCK, b * BLOCK + self.sizes[b])
            some = np.flatnonzero(short[b])
            d = squares[some] - 2 * (x[own] @ e[some].T)
            code[own] = some[d.argmin(axis=1)]
        if distances:
            apart = self.values - entries[code]
            error = np.einsum("nd,nd->n", apart, apart)
        return code, error, whole

    def sums_of(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count and componentwise sum of the rows of each entry."""
        code, _, whole = self.assign(entries)
        n = np.bincount(code, minlength=len(entries))
        single = ~np.repeat(whole, self.sizes)
        total = np.empty(entries.shape, np.int64)
        of_block = code[BLOCK * np.flatnonzero(whole)]
        for d in range(entries.shape[1]):  # doubles hold sums of a chunk exactly
            total[:, d] = np.bincount(code[single], self.values[single, d], len(entries)) + np.bincount(of_block, self.sums[whole, d], len(entries))
        return n, total


class _few:
    """Small Arrow batches, as a row of the table is a chunk."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self) -> None:
        self.before = self.spark.conf.get(_BATCH)
        self.spark.conf.set(_BATCH, str(_CHUNKS))

    def __exit__(self, *_) -> None:
        self.spark.conf.set(_BATCH, self.before)


def block_table(vectors: DataFrame, scale: int, parts: int, dims: int, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """A row per chunk: ``ids``, ``labels``, and a part's blocks each in ``p0``, ``p1`` ..."""
    plain = vectors.select(*(F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate((id_col, vector_col, label_col))))
    own = plain.schema
    per = dims // parts

    def chunk(ids: list[pa.Array], labels: list[pa.Array], q: list[np.ndarray]) -> pa.RecordBatch:
        x = np.concatenate(q)
        cut = pa.array([0, len(x)], pa.int32())
        columns = [pa.ListArray.from_arrays(cut, pa.concat_arrays(c)) for c in (ids, labels)]
        columns += [pa.array([_part_of(x[:, p * per : (p + 1) * per])], pa.struct([(f, pa.binary()) for f in _FIELDS])) for p in range(parts)]
        return pa.RecordBatch.from_arrays(columns, names=[f"c{i}" for i in range(len(columns))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list, list] = ([], [], [])
        size = 0
        for batch in batches:
            q, rows = integers(batch.column(1), scale, dims)
            at = 0
            while at < len(q):
                n = min(CHUNK - size, len(q) - at)
                taken = pa.array(rows[at : at + n])
                for to, x in zip(held, (batch.column(0).take(taken), batch.column(2).take(taken), q[at : at + n]), strict=True):
                    to.append(x)
                size, at = size + n, at + n
                if size == CHUNK:
                    yield chunk(*held)
                    held, size = ([], [], []), 0
        if size:
            yield chunk(*held)

    fields = [StructField("ids", ArrayType(own["c0"].dataType)), StructField("labels", ArrayType(own["c2"].dataType))]
    fields += [StructField(f"p{p}", _PART) for p in range(parts)]
    return map_batches(plain, run, StructType(fields))


def _restored(batch: pa.RecordBatch, row: int, first: int, parts: int, per: int) -> np.ndarray:
    """A chunk's vectors in the order of its ids."""
    blocks = [Blocks(batch.column(first + p)[row].as_py(), per) for p in range(parts)]
    q = np.empty((len(blocks[0].rows), parts * per), np.int64)
    for p, b in enumerate(blocks):
        q[b.rows, p * per : (p + 1) * per] = b.values
    return q


def first_entries(table: DataFrame, entries: int, parts: int, per: int) -> np.ndarray:
    """(parts, entries, per): the parts of the vectors of the least ids, ascending."""
    id_type = table.schema["ids"].dataType.elementType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids = batch.column(0)[row].values
                q = _restored(batch, row, 1, parts, per)
                some = np.arange(len(ids))
                if len(ids) > entries:
                    last = ids[int(pc.sort_indices(ids, null_placement="at_end")[entries - 1].as_py())]
                    if last.is_valid:  # repeated ids: all rows of the last one
                        some = np.flatnonzero(np.asarray(pc.less_equal(ids, last).fill_null(False)))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(some)), pa.array(list(q[some]), pa.list_(pa.int64()))], names=["id", "q"])

    rows = map_batches(table.select("ids", *(f"p{p}" for p in range(parts))), run, StructType([StructField("id", id_type), StructField("q", ArrayType(LongType()))]))
    found = rows.orderBy(F.col("id").asc_nulls_last(), "q").limit(entries).collect()
    q = np.array([r["q"] for r in found], np.int64).reshape(len(found), parts * per)
    return np.stack([q[:, p * per : (p + 1) * per] for p in range(parts)])


def improved(table: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round; entries without rows stay."""
    parts, entries, per = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros((parts, entries), np.int64), np.zeros(books.shape, np.int64)
        for batch in batches:
            for p in range(parts):
                for part in batch.column(p):
                    some, sums = Blocks(part.as_py(), per).sums_of(books[p])
                    n[p] += some
                    total[p] += sums
        p, e = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(n[p, e]), pa.array(list(total[p, e]), pa.list_(pa.int64()))], names=["p", "e", "n", "total"])

    rows = table.select(*(f"p{p}" for p in range(parts))).mapInArrow(run, "p int, e int, n long, total array<long>")
    sums = [F.sum(F.col("total")[d].cast("decimal(38,0)")).alias(f"s{d}") for d in range(per)]
    out = books.copy()
    for r in rows.groupBy("p", "e").agg(F.sum("n").alias("n"), *sums).collect():  # parts * entries rows
        out[r["p"], r["e"]] = [int(r[f"s{d}"]) // r["n"] for d in range(per)]
    return out


def coded(table: DataFrame, books: np.ndarray) -> DataFrame:
    """``vec_id, code, error, label``: hex digits of the parts' entries, and the squared distances' sum."""
    parts, _, per = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, labels = batch.column(0)[row].values, batch.column(1)[row].values
                codes, errors = np.empty((len(ids), parts), np.uint8), np.zeros(len(ids), np.int64)
                for p in range(parts):
                    blocks = Blocks(batch.column(2 + p)[row].as_py(), per)
                    code, error, _ = blocks.assign(books[p], distances=True)
                    codes[blocks.rows, p] = code
                    errors[blocks.rows] += error
                digits = codes.tobytes().hex()
                said = [digits[i : i + 2 * parts] for i in range(0, len(digits), 2 * parts)]
                yield pa.RecordBatch.from_arrays([ids, pa.array(said, pa.string()), pa.array(errors), labels], names=["id", "code", "error", "label"])

    kinds = [table.schema["ids"].dataType.elementType, StringType(), LongType(), table.schema["labels"].dataType.elementType]
    return map_batches(table, run, StructType([StructField(n, k) for n, k in zip(("vec_id", "code", "error", "label"), kinds, strict=True)]))


def vector_codes(
    vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, dims: int = 64,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """One row per vector that counts: ``vec_id, code, error, label_error, codebooks_sha256``.

    Components become floor(scale * x); each part's codebook starts as that part of the vectors of
    the ``entries`` least ids. A round assigns every part to the nearest entry (squared distance, ties:
    the lower index) and takes each entry's floor(sum / count); entries without parts stay. Parts are
    assigned once more at the end. ``code`` has two hex digits a part, ``error`` is the sum of the
    parts' squared distances, ``label_error`` its sum over equal labels (nulls together).

    Left out: vectors that are null, have another length than ``dims``, a null or non-finite
    component, or one whose integer is beyond 2^27 (distances would not fit a long). Repeated rows
    count each. Null ids come after all others among the first entries; equal ids are ordered by their
    components. With fewer vectors than entries there are fewer entries; an empty table gives no rows.
    Other columns don't matter. A label's error beyond a long is null.

    Rows are not shuffled but for the labels' sums, which meet as one row a label and task. Each pass
    reads the written blocks; a task holds one batch of chunks, the driver the codebooks.
    """
    if dims % parts or not 1 <= entries <= 256:
        raise ValueError("parts must divide the vectors, and a code has two hex digits")
    spark, per = vectors.sparkSession, dims // parts
    tables = Scratch(spark)
    # Arrow batches of rows here, of chunks from then on
    table = tables.write(block_table(vectors, scale, parts, dims, id_col, vector_col, label_col), "blocks")
    with _few(spark):
        books = first_entries(table, entries, parts, per)
        result = StructType([StructField("vec_id", table.schema["ids"].dataType.elementType), *_RESULT])
        if not books.shape[1]:
            tables.clear()
            return spark.createDataFrame([], result)
        for _ in range(rounds):
            books = improved(table, books)
    rows = tables.write(coded(table, books), "codes", batch_rows=_CHUNKS, instead_of=(table,))
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    labels = rows.groupBy(F.col("label").alias("of")).agg(F.try_sum("error").alias("label_error"))
    joined = rows.join(labels, F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))

