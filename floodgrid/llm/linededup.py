"""Line dedup: documents probe a sharded minimal perfect hash of the lines that many documents have.

Line keys are counted by document; those of enough documents are indexed, the others never drop
anything. Each belongs to a shard by its hash. A shard is one row: the bit levels of a minimal
perfect hash (Limasset et al. 2017) that numbers its keys without gaps, and two arrays by that
number, a 64-bit fingerprint and the count. The shards go to the documents, as many at a time as a
bound on their bytes allows, and the documents' lines probe the arrays inside the scan: no line of
a document is written or shuffled but for counting.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from .text import Scratch, Text, map_batches, mix, quoted, slices, unused, utf8

#: Bits of a level for each key that is left.
_GAMMA = 2.0
_COUNTS = "h1 long, h2 long, n long"


def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(keys ^ mix(np.full(1, level + 77, np.uint64))) % np.uint64(size)).astype(np.int64)


def build_mph(keys: np.ndarray) -> list[np.ndarray]:
    """Bit arrays of a minimal perfect hash over distinct keys.

    Level by level each key takes the bit that its hash names; bits that two keys want stay 0 and
    those keys go on. A key's number is the count of set bits before its own.
    """
    levels = []
    while len(keys):
        size = max(64, int(_GAMMA * len(keys)))
        at = _place(keys, len(levels), size)
        alone = np.bincount(at, minlength=size) == 1
        levels.append(alone)
        keys = keys[~alone[at]]
        if len(levels) > 200:
            raise ValueError("keys are not distinct")
    return levels


def probe_mph(levels: list[np.ndarray], keys: np.ndarray, ranks: list[np.ndarray] | None = None) -> np.ndarray:
    """Number of each key; -1 for one that no level has (a stranger may also get a member's number)."""
    out = np.full(len(keys), -1, np.int64)
    left, before = np.arange(len(keys)), 0
    for i, bits in enumerate(levels):
        rank = ranks[i] if ranks else np.cumsum(bits)
        if len(left):
            at = _place(keys[left], i, len(bits))
            hit = bits[at]
            out[left[hit]] = before + rank[at[hit]] - 1
            left = left[~hit]
        before += int(rank[-1])
    return out


def _name(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    return mix(h1.view(np.uint64) ^ mix(h2.view(np.uint64)))


SHARD = "shard int, sizes array<int>, bits binary, prints binary, counts binary"
#: Bytes of the index for each key: fingerprint, count, and bits of the levels.
KEY_BYTES = 13


def build_index(counts: DataFrame, shards: int) -> DataFrame:
    """One row per shard of (h1, h2, n); n is kept as it is up to 2^32 - 1."""

    def build(table: pa.Table) -> pa.Table:
        h1, h2 = (table.column(c).to_numpy() for c in ("h1", "h2"))
        names = _name(h1, h2)
        levels = build_mph(names)
        at = probe_mph(levels, names)
        prints, ns = np.zeros(len(names), "<u8"), np.zeros(len(names), "<u4")
        prints[at] = h2.view(np.uint64)
        ns[at] = np.minimum(table.column("n").to_numpy(), 0xFFFFFFFF).astype(np.uint32)
        return pa.table(
            {
                "shard": pa.array([table.column("shard")[0].as_py()], pa.int32()),
                "sizes": pa.array([[len(x) for x in levels]], pa.list_(pa.int32())),
                "bits": pa.array([b"".join(np.packbits(x).tobytes() for x in levels)], pa.binary()),
                "prints": pa.array([prints.tobytes()], pa.binary()),
                "counts": pa.array([ns.tobytes()], pa.binary()),
            }
        )

    sharded = counts.withColumn("shard", F.pmod("h1", F.lit(shards)).cast("int"))
    return sharded.groupBy("shard").applyInArrow(build, SHARD)


class Shard:
    """The arrays of one row of ``build_index``."""

    def __init__(self, sizes: list[int], bits: bytes, prints: bytes, counts: bytes):
        raw, begin = np.frombuffer(bits, np.uint8), 0
        self.levels: list[np.ndarray] = []
        for size in sizes:
            n = (size + 7) // 8
            self.levels.append(np.unpackbits(raw[begin : begin + n], count=size).astype(bool))
            begin += n
        self.ranks = [np.cumsum(x, dtype=np.int32) for x in self.levels]
        self.prints, self.counts = np.frombuffer(prints, "<u8"), np.frombuffer(counts, "<u4")

    def count(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """The count of each key, 0 for strangers."""
        at = probe_mph(self.levels, _name(h1, h2), self.ranks)
        known = (at >= 0) & (self.prints[at] == h2.view(np.uint64))
        return np.where(known, self.counts[at], 0)


class Index:
    """Some of the shards; ``rows`` are dicts as ``build_index`` makes them."""

    def __init__(self, rows: list[dict], shards: int):
        self.rows, self.shards = {r["shard"]: r for r in rows}, shards
        self._open: dict[int, Shard] = {}

    def count(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """The count of each key, 0 for strangers and keys of other shards."""
        out = np.zeros(len(h1), np.int64)
        shard = np.mod(h1, self.shards)
        order = np.argsort(shard, kind="stable")
        ends = np.searchsorted(shard[order], np.arange(self.shards + 1))
        for s, row in self.rows.items():
            own = order[ends[s] : ends[s + 1]]
            if len(own):
                if s not in self._open:
                    self._open[s] = Shard(row["sizes"], row["bits"], row["prints"], row["counts"])
                out[own] = self._open[s].count(h1[own], h2[own])
        return out


class Lines:
    """The lines of a batch of texts: start, end and document of each, and the keys of those that have one."""

    def __init__(self, column: pa.Array, min_chars: int):
        t = Text(column, lower=True)
        self.starts, self.ends, self.doc = t.lines()
        first = np.searchsorted(t.starts, self.starts)
        last = np.searchsorted(t.ends, self.ends, side="right") - 1
        self.keyed = np.flatnonzero(first <= last)
        a, b = t.starts[first[self.keyed]], t.ends[last[self.keyed]]
        if min_chars > 1:
            chars = np.concatenate([[0], np.cumsum((t.data & 0xC0) != 0x80)])
            enough = chars[b] - chars[a] >= min_chars
            self.keyed, a, b = self.keyed[enough], a[enough], b[enough]
        raw = t.data.tobytes()
        digests = b"".join([xxhash.xxh3_128_digest(raw[x:y]) for x, y in zip(a.tolist(), b.tolist(), strict=True)])
        self.h1, self.h2 = np.frombuffer(digests, "<i8").reshape(-1, 2).T


def _distinct(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order that sorts rows by the columns, and where in it each distinct row begins."""
    order = np.lexsort(columns[::-1])
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([c[order[1:]] != c[order[:-1]] for c in columns])
    return order, np.flatnonzero(new)


def line_counts(texts: DataFrame, min_chars: int = 1) -> DataFrame:
    """(h1, h2, n): how many rows of ``texts`` (one string column) have each line key, of all keys."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(0)):
                found = Lines(batch.column(0).slice(a, b - a), min_chars)
                order, own = _distinct(found.h1, found.h2, found.doc[found.keyed])
                h1, h2 = found.h1[order[own]], found.h2[order[own]]
                order, first = _distinct(h1, h2)
                n = np.diff(np.append(first, len(order)))
                yield pa.RecordBatch.from_arrays([pa.array(h1[order[first]]), pa.array(h2[order[first]]), pa.array(n, pa.int64())], names=["h1", "h2", "n"])

    return texts.mapInArrow(count, _COUNTS).groupBy("h1", "h2").agg(F.sum("n").alias("n"))


def _without(column: pa.Array, found: Lines, drop: np.ndarray) -> pa.Array:
    """The texts without the lines that ``drop`` marks, the others joined by line breaks."""
    data, docs = utf8(column)
    keep = np.flatnonzero(~drop)
    first = np.ones(len(keep), bool)
    first[1:] = found.doc[keep[1:]] != found.doc[keep[:-1]]
    edge = np.zeros(len(data) + 1, np.int32)
    # a kept line brings the break before it, unless it is the first that its text keeps
    np.add.at(edge, found.starts[keep] - ~first, 1)
    np.add.at(edge, found.ends[keep], -1)
    stay = np.cumsum(edge[:-1]) > 0
    at = np.concatenate([[0], np.cumsum(stay)])[docs].astype(np.int32)
    whole = pa.StringArray.from_buffers(len(column), pa.py_buffer(at), pa.py_buffer(data[stay]))
    return pc.if_else(column.is_valid(), whole, pa.scalar(None, pa.string()))


def line_dedup(
    docs: DataFrame, text: str = "text", min_docs: int = 10, min_chars: int = 1, keys_per_shard: int = 20_000, index_bytes: int = 32 << 20
) -> DataFrame:
    r"""Rows of ``docs`` without the lines that many documents have.

    A line's key is the line without ``[\x20\x09-\x0D]`` at its ends and with A-Z in lower case. A
    key of at least ``min_chars`` code points that is in ``min_docs`` rows or more loses all its
    lines in every row; the other lines stay as they are, joined by ``\n``. Adds ``n_lines`` and
    ``n_dropped``; columns of ``docs`` with these names are replaced, all others (nulls too) pass
    unchanged, whatever their names. A null or empty text is one empty line and stays so; a text
    that loses all its lines becomes empty. Each row is a document: repeated rows, and rows that
    share an id, count as several. Very long texts are handled whole, one at a time.

    Shards of ``index_bytes`` together are broadcast at a time. Where the lines that drop need
    more, the documents are scanned once for each such part, and in between written with marks of
    what has been found; the result is the same. An empty table gives no rows.
    """
    carry = [c for c in docs.columns if c not in ("n_lines", "n_dropped") or c == text]
    docs = docs.select(*(F.col(quoted(c)) for c in carry))
    spark, tables = docs.sparkSession, Scratch(docs.sparkSession)
    counts = line_counts(docs.select(F.col(quoted(text)).cast("string").alias("text")), min_chars)
    common = tables.write(counts.where(F.col("n") >= min_docs), "lines")
    keys = common.count()
    shards = max(1, -(-keys // keys_per_shard))
    index = tables.write(build_index(common, shards), "index", instead_of=(common,))
    per = max(1, index_bytes // (KEY_BYTES * keys_per_shard))
    at, rounds = carry.index(text), -(-shards // per)
    mark = unused("marks", carry)
    kept = [StructField(f.name, StringType()) if i == at else f for i, f in enumerate(docs.schema.fields)]
    rows = docs.withColumn(mark, F.lit(None).cast("binary"))
    for r in range(rounds):
        found = index.where((F.col("shard") >= r * per) & (F.col("shard") < (r + 1) * per)).toArrow().to_pylist()  # of index_bytes
        shared = spark.sparkContext.broadcast((found, shards))
        last = r == rounds - 1
        schema = StructType([*kept, *([StructField("n_lines", LongType()), StructField("n_dropped", LongType())] if last else [StructField(mark, BinaryType())])])
        marked = map_batches(rows, _probe(shared, at, min_chars, min_docs, last, schema.names), schema)
        rows = marked if last else tables.write(marked, "marked", instead_of=(rows,))
    tables.drop(index)
    return rows


def _probe(shared, at: int, min_chars: int, min_docs: int, last: bool, names: list[str]):
    """The task that probes the broadcast shards; the marks of earlier ones are in the last column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(*shared.value)
        for batch in batches:
            texts = batch.column(at).cast(pa.string())
            for a, b in slices(texts):
                part, column = batch.slice(a, b - a), texts.slice(a, b - a)
                found = Lines(column, min_chars)
                drop = np.zeros(len(found.doc), bool)
                drop[found.keyed] = index.count(found.h1, found.h2) >= min_docs
                ends = np.searchsorted(found.doc, np.arange(part.num_rows + 1))
                for i, before in enumerate(part.column(part.num_columns - 1)):
                    if before.is_valid:
                        n = ends[i + 1] - ends[i]
                        drop[ends[i] : ends[i + 1]] |= np.unpackbits(np.frombuffer(before.as_py(), np.uint8), count=n).astype(bool)
                others = [c if i != at else column for i, c in enumerate(part.columns[:-1])]
                if last:
                    others[at] = _without(column, found, drop) if drop.any() else column
                    lost = np.concatenate([[0], np.cumsum(drop)])
                    new = [pa.array(np.diff(ends), pa.int64()), pa.array(lost[ends[1:]] - lost[ends[:-1]], pa.int64())]
                else:
                    new = [pa.array([np.packbits(drop[x:y]).tobytes() for x, y in zip(ends[:-1], ends[1:], strict=True)], pa.binary())]
                yield pa.RecordBatch.from_arrays([*others, *new], names=names)

    return run
