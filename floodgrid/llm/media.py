"""Media columns: archives of images, written and read by a Spark data source of their own.

A data set is a folder of ``.tar`` archives. The writer closes a *segment* about every
``segmentBytes`` and lists the segments' offsets in a sidecar next to the archive. The reader plans
one partition per byte range: it takes the members whose header lies in the range, walking from the
last listed offset before it. Batches of payloads leave as Arrow record batches. Each member is
read by its offset, and one that fails is tried again by itself. Paths are URIs of any file system
that pyarrow opens, so driver and executors need only the same URI.
"""

from __future__ import annotations

import hashlib
import json
import struct
import tarfile
import time
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

_BLOCK = 512


@dataclass
class Segment(InputPartition):
    """Members of ``path`` whose headers lie in [begin, end); walking starts at ``sync``."""

    path: str
    sync: int
    begin: int
    end: int


@dataclass
class Wrote(WriterCommitMessage):
    path: str | None
    members: int


class MemberError(OSError):
    """A member that could not be read after all tries; says which."""


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def read_header(block: bytes) -> tarfile.TarInfo | None:
    """The member that a 512-byte block describes; None for a block of zeros, the archive's end."""
    if not block.strip(b"\0"):
        return None
    return tarfile.TarInfo.frombuf(block, "utf-8", "surrogateescape")


def walk(handle, segment: Segment) -> Iterator[tuple[str, int, int, int]]:
    """(name, offset of the header, offset of the payload, size) of a segment's members."""
    at = segment.sync
    long_name = None
    first = at
    while at < segment.end or long_name is not None:
        handle.seek(at)
        info = read_header(handle.read(_BLOCK))
        if info is None:
            return
        begin = at + _BLOCK
        after = begin + -(-info.size // _BLOCK) * _BLOCK
        if info.type == tarfile.GNUTYPE_LONGNAME:
            handle.seek(begin)
            long_name, first = handle.read(info.size).rstrip(b"\0").decode("utf-8", "surrogateescape"), at
        else:
            first = at if long_name is None else first
            if info.isreg() and segment.begin <= first < segment.end:
                yield long_name or info.name, first, begin, info.size
            long_name = None
        at = after


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.range = int(options.get("rangebytes", 16 << 20))
        self.batch = int(options.get("batchbytes", 4 << 20))
        self.tries = int(options.get("tries", 3))

    def partitions(self) -> list[Segment]:
        files, base = _opened(self.path)
        found = files.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=False))
        out = []
        sidecars = {f.path for f in found if f.path.endswith(".segments")}
        archives = sorted((f for f in found if f.path.endswith(".tar") and "/_" not in f.path[len(base) :]), key=lambda f: f.path)

        def offsets(f: fs.FileInfo) -> list[int]:
            if f"{f.path}.segments" not in sidecars:
                return [0]
            with files.open_input_stream(f"{f.path}.segments") as s:
                return json.loads(s.read()) or [0]

        with ThreadPoolExecutor(32) as pool:
            known = list(pool.map(offsets, archives))
        for f, starts in zip(archives, known, strict=True):
            for begin in range(0, f.size, self.range):
                end = min(begin + self.range, f.size)
                sync = starts[bisect_right(starts, begin) - 1] if starts[0] <= begin else 0
                out.append(Segment(f.path, sync, begin, end))
        return out or [Segment("", 0, 0, 0)]

    def payload(self, files: fs.FileSystem, handle, path: str, at: int, size: int) -> tuple[bytes, object]:
        """The bytes at an offset; a failed or short read is tried again with a new handle."""
        why: Exception | str = ""
        for turn in range(self.tries):
            try:
                if turn:
                    time.sleep(0.1 * 2**turn)
                    handle = files.open_input_file(path)
                handle.seek(at)
                data = handle.read(size)
                if len(data) == size:
                    return data, handle
                why = f"{len(data)} of {size} bytes"
            except OSError as e:
                why = e
        raise MemberError(f"{path} at {at}: {why} after {self.tries} tries")

    def read(self, partition: Segment) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        files, _ = _opened(self.path)
        names, offsets, data, held = [], [], [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array([partition.path] * len(names), pa.string()), pa.array(offsets, pa.int64()), pa.array(data, pa.binary())],
                names=["name", "archive", "offset", "payload"],
            )

        handle = files.open_input_file(partition.path)
        for name, _, at, size in walk(handle, partition):
            payload, handle = self.payload(files, handle, partition.path, at, size)
            names.append(name)
            offsets.append(at)
            data.append(payload)
            held += size
            if held >= self.batch:
                yield batch()
                names, offsets, data, held = [], [], [], 0
        if names:
            yield batch()


class ArchiveWriter(DataSourceArrowWriter):
    """Writes (name, payload) rows; a task's archive counts once its commit is accepted."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.segment = int(options.get("segmentbytes", 4 << 20))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Wrote:
        files, base = _opened(self.path)
        path, out, starts, at, members = f"{base}/_writing/{uuid.uuid4().hex}.tar", None, [0], 0, 0
        for batch in iterator:
            for name, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if out is None:
                    files.create_dir(f"{base}/_writing", recursive=True)
                    out = files.open_output_stream(path)
                if at - starts[-1] >= self.segment:
                    starts.append(at)
                info = tarfile.TarInfo(name or "")
                data = payload.as_py() or b""
                info.size = len(data)
                head = info.tobuf(tarfile.GNU_FORMAT, "utf-8", "surrogateescape")
                pad = -len(data) % _BLOCK
                out.write(head + data + b"\0" * pad)
                at += len(head) + len(data) + pad
                members += 1
        if out is None:
            return Wrote(None, 0)
        out.write(b"\0" * (2 * _BLOCK))
        out.close()
        with files.open_output_stream(f"{path}.segments") as s:
            s.write(json.dumps(starts).encode())
        return Wrote(path, members)

    def commit(self, messages: list[Wrote | None]) -> None:
        files, base = _opened(self.path)
        files.create_dir(base, recursive=True)
        for m in messages:
            if m is not None and m.path:
                for end in (".segments", ""):
                    files.move(m.path + end, f"{base}/{m.path.rpartition('/')[2]}{end}")

    def abort(self, messages: list[Wrote | None]) -> None:
        files, base = _opened(self.path)
        if files.get_file_info(f"{base}/_writing").type == fs.FileType.Directory:
            files.delete_dir(f"{base}/_writing")


class ArchiveSource(DataSource):
    """``spark.read.format("media_archive").load(uri)`` gives name, archive, offset and payload.

    Options: rangeBytes, batchBytes and tries to read, segmentBytes to write.
    """

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return "name string, archive string, offset long, payload binary"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ArchiveSource)


#: Width of the images; a payload is a positive multiple of it.
WIDTH = 576
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes, level: int = 1) -> bytes:
    """A grey image of 8-bit samples, one per byte, without row filters; lossless."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    raw = np.zeros((len(rows), WIDTH + 1), np.uint8)
    raw[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(raw.tobytes(), level)) + _chunk(b"IEND", b"")


def from_png(data: bytes) -> bytes:
    """The samples of an image that ``to_png`` made; other images raise ValueError."""
    if data[:8] != _SIGNATURE:
        raise ValueError("not a PNG")
    at, head, body = 8, None, []
    while at < len(data):
        (n,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        part = data[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", data, at + 8 + n)[0] != zlib.crc32(kind + part):
            raise ValueError("a chunk is damaged")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            body.append(part)
        at += 12 + n
    if head is None or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not a grey image of 8 bits")
    rows = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(head[1], head[0] + 1)
    if rows[:, 0].any():
        raise ValueError("rows are filtered")
    return rows[:, 1:].tobytes()


def feature(samples: bytes) -> str:
    """A difference hash of 64 bits, as hex: the image's 8 x 9 block sums, each against the next."""
    flat = np.frombuffer(samples, np.uint8)
    edges = (np.arange(73) * len(flat)) // 72
    total = np.concatenate([[0], np.cumsum(flat, dtype=np.int64)])
    blocks = ((total[edges[1:]] - total[edges[:-1]]) * 1000 // np.maximum(1, np.diff(edges))).reshape(8, 9)
    return np.packbits(blocks[:, 1:] > blocks[:, :-1]).tobytes().hex()


def store_texts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> None:
    """Writes each text as an image; the member's name is the key (empty for a null key).

    Null and empty texts are an image of one row of 255s; very long ones are one tall image. Repeated
    rows and ids are members of their own; other columns are not read. An empty table writes no
    archive. A task that is lost leaves nothing that is read.
    """
    register(docs.sparkSession)

    def images(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = []
                for t in part.column(1).to_pylist():
                    raw = (t or "").encode()
                    out.append(to_png(raw + b"\xff" * (max(1, -(-len(raw) // WIDTH)) * WIDTH - len(raw))))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.binary())], names=["name", "payload"])

    rows = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("name"), F.col(text).cast("string").alias("text"))
    rows.mapInArrow(images, "name string, payload binary").write.format("media_archive").mode("append").save(path)


FEATURES = (
    "name string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
    "media_sha256 string, feature string"
)


def media_features(spark: SparkSession, path: str, **options) -> DataFrame:
    """Digests and a feature of each image of an archive folder, from its stored bytes.

    ``n_bytes`` leaves out the 255s at the end, which no UTF-8 text has. Members with equal bytes
    get equal values; repeated names are rows of their own, a name that was null is empty. A folder
    without archives gives no rows. A damaged member raises an error that names it.
    """
    register(spark)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, where, at, stored in zip(*(batch.column(i) for i in range(4)), strict=True):
                media = stored.as_py()
                try:
                    payload = from_png(media)
                except ValueError as e:
                    raise MemberError(f"{name} in {where} at {at}: {e}") from e
                rows.append((name.as_py(), len(payload.rstrip(b"\xff")), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload)))
            if rows:
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                names = [x.split()[0] for x in FEATURES.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return spark.read.format("media_archive").options(**options).load(path).mapInArrow(of, FEATURES)
