"""Whole-batch text kernels in numpy, and the shared folder that intermediate tables go to.

A *batch* is an Arrow string array; its UTF-8 buffer is viewed as one ``uint8`` array, so that
words, lines and n-grams of many documents are found by a few array passes, without a Python
object per word.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructField, StructType

#: Bytes of text that one numpy pass handles; a longer document is a pass of its own.
PASS_BYTES = 2 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)
#: Base of the rolling hash; odd, so that it has an inverse modulo 2^64.
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that the cluster names in ``spark.checkpoint.dir``.

    Where the session has none (a local test), a folder is made and set for the session.
    """
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if base is None:
        if context.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
        base = context.getCheckpointDir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Rows in an Arrow batch while a table is written; a batch of sets or of long texts is large in the
#: JVM and in Python at once.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Numbers in a part of a count table while it is shuffled.
_COUNT_PART = 4096


def small_batches(spark: SparkSession) -> SparkSession:
    """The session, with Arrow batches of BATCH_ROWS from now on; for queries that return lazy plans."""
    spark.conf.set(_BATCH, str(BATCH_ROWS))
    return spark


def written(df: DataFrame, name: str, path: str | None = None, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """``df`` written to the shared folder and read again: the lineage ends there."""
    spark = df.sparkSession
    path, before = path or scratch(spark, name), spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(batch_rows))
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_BATCH, before)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whatever store it lies."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Intermediate tables of one job. A table is dropped once all that is made of it has been written."""

    def __init__(self, spark: SparkSession):
        self.spark, self._tables = spark, []

    def write(self, df: DataFrame, name: str, instead_of: tuple[DataFrame, ...] = (), batch_rows: int = BATCH_ROWS) -> DataFrame:
        """``df`` written and read again; then the tables that it takes the place of are dropped."""
        path = scratch(self.spark, name)
        out = written(df, name, path, batch_rows)
        self._tables.append((out, path))
        self.drop(*instead_of)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            for i, (own, path) in enumerate(self._tables):
                if own is t:
                    remove(self.spark, path)
                    del self._tables[i]
                    break

    def clear(self) -> None:
        self.keep()

    def keep(self, *tables: DataFrame) -> None:
        """Drops all but these."""
        self.drop(*[own for own, _ in self._tables if not any(own is t for t in tables)])


def quoted(name: str) -> str:
    """A column's name as Spark's expressions want it, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def unused(name: str, columns: list[str]) -> str:
    """``name``, with underscores behind it until no column has it (names differ by more than case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType) -> DataFrame:
    """``mapInArrow`` for columns of any name (its own handling of names fails on dots): batches hold
    the columns of ``df`` and of ``schema`` in their order."""

    def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(batches):
            yield pa.RecordBatch.from_arrays(batch.columns, names=[f"c{i}" for i in range(batch.num_columns)])

    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    numbered = StructType([StructField(f"c{i}", f.dataType, f.nullable) for i, f in enumerate(schema.fields)])
    return plain.mapInArrow(renamed, numbered).toDF(*schema.names)


def bucket_counts(rows: DataFrame, buckets: Callable[[pa.RecordBatch], Iterator[tuple[int, np.ndarray]]], size: int, tables: int = 1) -> np.ndarray:
    """How often each of ``size`` buckets occurs, (tables, size); a power of two each.

    ``buckets`` gives (table, bucket numbers) of a batch. Each task adds up its own rows; parts of
    the sums are then shuffled and added. The result has ``tables * size`` numbers whatever the input.
    """
    per = size // min(_COUNT_PART, size)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((tables, size), np.int64)
        for batch in batches:
            for k, found in buckets(batch):
                total[k] += np.bincount(found, minlength=size)
        parts = total.reshape(tables * per, -1).astype("<i8")
        some = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([parts[i].tobytes() for i in some], pa.binary())], names=["part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = None, None
        for batch in batches:
            for p, c in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = np.frombuffer(c.as_py(), "<i8")
                part, total = p, x.copy() if total is None else total + x
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "counts"])

    out = np.zeros((tables * per, size // per), np.int64)
    counts = rows.mapInArrow(count, "part int, counts binary").groupBy("part").applyInArrow(add, "part int, counts binary")
    for row in counts.collect():
        out[row["part"]] = np.frombuffer(row["counts"], "<i8")
    return out.reshape(tables, size)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, elementwise."""
    x = x + _ODD
    x ^= x >> _S30
    x *= _M1
    x ^= x >> _S27
    x *= _M2
    x ^= x >> _S31
    return x


#: A random value per byte.
_BYTE = mix(np.arange(256, dtype=np.uint64) * _M1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
#: 0: white space, 1: in a word, 2: other ASCII, as wordpunct tokenizers split
_CLASS = np.full(256, 1, np.uint8)
_CLASS[:128] = 2
_CLASS[[*range(48, 58), *range(65, 91), 95, *range(97, 123)]] = 1
_CLASS[_SPACE] = 0
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, up to n - 1; kept for the next batch."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(max(n, PASS_BYTES + 1), base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def slices(column: pa.Array | pa.ChunkedArray, most: int = PASS_BYTES, most_rows: int = 4096) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts are about ``most`` bytes together; every row is in one range."""
    sizes = np.asarray(pc.binary_length(column).fill_null(0))
    at = begin = 0
    total = 0
    for at, n in enumerate(sizes.tolist()):
        if at - begin >= most_rows or (total and total + n > most):
            yield begin, at
            begin, total = at, 0
        total += n
    if len(sizes):
        yield begin, len(sizes)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and where each text begins (one more for the end). Null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or at[0] == at[-1]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


class Text:
    """A batch of texts: bytes, rolling hash, words and lines.

    Hashes are equal for equal byte strings, whichever batch they are in; different strings share
    one with a probability of about 2^-64.
    """

    def __init__(self, column: pa.Array, lower: bool = False, punct: bool = False):
        """lower: A-Z as a-z. punct: words also end where letters or digits meet other signs."""
        self.data, self.docs = utf8(column)
        if lower:
            self.data = _LOWER[self.data]
        self._roll: np.ndarray | None = None
        self.inside = ~_SPACE[self.data]
        self.starts, self.ends = self._runs(punct)
        #: words before each document, and in all
        self.at = np.searchsorted(self.starts, self.docs)
        self.n_words = np.diff(self.at)

    def _runs(self, punct: bool) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.data)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        first, last = self.inside.copy(), self.inside.copy()
        first[1:] &= ~self.inside[:-1]
        last[:-1] &= ~self.inside[1:]
        if punct:
            kind = _CLASS[self.data]
            turn = kind[1:] != kind[:-1]
            first[1:] |= turn & self.inside[1:]
            last[:-1] |= turn & self.inside[:-1]
        cut = self.docs[(self.docs > 0) & (self.docs < n)]
        first[cut] = self.inside[cut]
        last[cut - 1] = self.inside[cut - 1]
        return np.flatnonzero(first), np.flatnonzero(last) + 1

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A hash of each byte range."""
        if self._roll is None:
            power, self._inverse = _power(len(self.data) + 1)
            self._roll = np.zeros(len(self.data) + 1, np.uint64)
            np.add.accumulate(_BYTE[self.data] * power[: len(self.data)], out=self._roll[1:])
        h = (self._roll[ends] - self._roll[starts]) * self._inverse[starts]
        return mix(h ^ ((ends - starts).astype(np.uint64) * _ODD))

    def words(self) -> np.ndarray:
        return self.hashes(self.starts, self.ends)

    def doc_of_words(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.docs) - 1), self.n_words)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        r"""Start, end and document of the lines, split at \n; an empty text is one empty line."""
        breaks = np.flatnonzero(self.data == 10)
        starts = np.sort(np.concatenate([self.docs[:-1], breaks + 1]), kind="stable")
        ends = np.sort(np.concatenate([self.docs[1:], breaks]), kind="stable")
        doc = np.repeat(np.arange(len(self.docs) - 1), np.diff(np.searchsorted(breaks, self.docs)) + 1)
        return starts, ends, doc

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """Sums of per-byte values, by document."""
        total = np.zeros(len(flags) + 1, np.int64)
        np.add.accumulate(flags, dtype=np.int64, out=total[1:])
        return total[self.docs[1:]] - total[self.docs[:-1]]


def ngrams(words: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each n-word window that lies in one document, and its first word's index."""
    if len(words) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    k = len(words) - n + 1
    h = words[:k].copy()
    for i in range(1, n):
        h = mix(h * _M2 + words[i : i + k])
    at = np.flatnonzero(doc[:k] == doc[n - 1 :])
    return h[at], at


def repeated(keys: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key, whether its document has it twice or more, and whether it came there before."""
    twice, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    own = mix(keys ^ mix(doc.astype(np.uint64)))
    order = np.argsort(own, kind="stable")
    same = own[order[1:]] == own[order[:-1]]
    later[order[1:]] = same
    twice[order[1:]] = same
    twice[order[:-1]] |= same
    return twice, later
