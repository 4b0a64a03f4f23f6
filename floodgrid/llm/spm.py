"""SentencePiece encoding and decoding with the tokenizers library.

The model file (a protobuf) is parsed here, and its normaliser, space mark, scores or merges and
byte fallback are rebuilt as a tokenizers pipeline. Texts are encoded part by part: pieces of such
models hold the space mark at their beginning only, so no piece joins two parts, and each distinct
part is encoded once per task, in multithreaded batches. The ids are those of the rebuilt
pipeline; the sentencepiece library only says whether it gives the same.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from .text import map_batches, quoted

MARK = "▁"
#: Kinds of pieces in the protobuf (fixed values of the file format).
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


@dataclass
class PieceModel:
    """What a SentencePiece model file says."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    bpe: bool = False
    byte_fallback: bool = False
    charsmap: bytes = b""
    add_prefix: bool = True
    trim_spaces: bool = True
    escape_spaces: bool = True

    @property
    def unknown(self) -> int:
        return next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)

    @property
    def by_part(self) -> bool:
        """Whether no piece and no normalisation reaches from one space-separated part to another."""
        return (
            not self.charsmap and self.add_prefix and not self.trim_spaces and self.escape_spaces
            and not any(re.search(f"[^{MARK}]{MARK}", p) for p, _, kind in self.pieces if kind in (NORMAL, USER_DEFINED))
        )


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protobuf message."""

    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[i]
            value |= (byte & 0x7F) << shift
            i, shift = i + 1, shift + 7
            if byte < 0x80:
                return value, i

    i = 0
    while i < len(data):
        key, i = varint(i)
        if key & 7 == 0:
            value, i = varint(i)
        else:
            n = {1: 8, 5: 4}.get(key & 7)
            if n is None:
                n, i = varint(i)
            value, i = data[i : i + n], i + n
        yield key >> 3, value


def parse_model(data: bytes) -> PieceModel:
    """Field numbers: ModelProto has pieces (1), trainer_spec (2), normalizer_spec (3)."""
    model = PieceModel()
    for number, value in _fields(data):
        if number == 1:
            f = dict(_fields(value))
            model.pieces.append((f[1].decode(), struct.unpack("<f", f[2])[0] if 2 in f else 0.0, f.get(3, NORMAL)))
        elif number == 2:
            f = dict(_fields(value))
            model.bpe, model.byte_fallback = f.get(3, 1) == 2, bool(f.get(35, 0))
            if f.get(3, 1) not in (1, 2):
                raise ValueError("only unigram and BPE models are supported")
        elif number == 3:
            f = dict(_fields(value))
            model.charsmap = f.get(2, b"")
            model.add_prefix, model.trim_spaces, model.escape_spaces = (bool(f.get(k, 1)) for k in (3, 4, 5))
    return model


def read_model(path: str) -> PieceModel:
    with open(path, "rb") as f:
        return parse_model(f.read())


def merges(model: PieceModel) -> list[tuple[str, str]]:
    """BPE merges in order of the merged piece's score; splits of one piece by their parts' ids."""
    ids = {p: i for i, (p, _, kind) in enumerate(model.pieces) if kind in (NORMAL, USER_DEFINED)}
    found = []
    for p, score, kind in model.pieces:
        if kind == NORMAL:
            for cut in range(1, len(p)):
                if p[:cut] in ids and p[cut:] in ids:
                    found.append((-score, ids[p], ids[p[:cut]], ids[p[cut:]], p[:cut], p[cut:]))
    return [(a, b) for *_, a, b in sorted(found)]


def build(model: PieceModel):
    """The tokenizers pipeline of a model."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers

    if model.bpe:
        core = models.BPE(
            {p: i for i, (p, _, _) in enumerate(model.pieces)}, merges(model),
            unk_token=model.pieces[model.unknown][0], fuse_unk=True, byte_fallback=model.byte_fallback,
        )
    else:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], model.unknown, model.byte_fallback)
    out = Tokenizer(core)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.trim_spaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.add_prefix:
        steps.append(normalizers.Prepend(MARK if model.escape_spaces else " "))
    if model.escape_spaces:
        steps.append(normalizers.Replace(" ", MARK))
    out.normalizer = normalizers.Sequence(steps)
    own = [AddedToken(p, normalized=False) for p, _, kind in model.pieces if kind == USER_DEFINED]
    if own:
        out.add_tokens(own)
    ends = [decoders.Replace(model.pieces[model.unknown][0], " ⁇ "), decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
    out.decoder = decoders.Sequence(ends + ([decoders.Strip(" ", 1, 0)] if model.add_prefix else []))
    return out


class Decoder:
    """Text of ids: the pieces' bytes in a row, as the rebuilt pipeline's decoder joins them.

    The table does the same as that decoder at a sixth of its time, and cuts broken bytes as
    sentencepiece does; tests compare all three.
    """

    def __init__(self, model: PieceModel):
        self.table = [self._bytes_of(p, kind) for p, _, kind in model.pieces]
        self.prefix = model.add_prefix

    @staticmethod
    def _bytes_of(piece: str, kind: int) -> bytes:
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        if kind == CONTROL:
            return b""
        return " ⁇ ".encode() if kind == UNKNOWN else piece.replace(MARK, " ").encode()

    def decode(self, ids: np.ndarray) -> str:
        """A byte that is not UTF-8 becomes U+FFFD."""
        out = b"".join(map(self.table.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return out[1:] if self.prefix and out[:1] == " " else out


class Codec:
    """Encodes batches; remembers the parts it has seen, up to ``most``."""

    def __init__(self, path: str, threads: int = 2, most: int = 600_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true" if threads > 1 else "false")
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        from sentencepiece import SentencePieceProcessor

        self.model = read_model(path)
        self.threads, self.most = threads, most
        self.tokenizer = build(self.model)
        self.reference = SentencePieceProcessor(model_file=path)
        self.known: dict[str, bytes] = {}
        self.differ: set[str] = set()
        self.mark = next((i for i, (p, _, kind) in enumerate(self.model.pieces) if p == MARK and kind == NORMAL), None)
        self.by_part = self.model.by_part and self.mark is not None

    def parts(self, text: str) -> list[str]:
        """Parts of a text, each without the one mark before it."""
        if not text:
            return []
        if not self.by_part:
            return [text]
        if MARK in text or "  " in text or text[0] == " " or text[-1] == " ":
            return [p[1:] for p in re.findall(f"{MARK}+[^{MARK}]*", MARK + text.replace(" ", MARK))]
        return text.split(" ")

    def learn(self, new: list[str]) -> None:
        if self.by_part and "" in new:  # a lone mark; the libraries give no ids for an empty text
            self.known[""] = array("I", [self.mark]).tobytes()
            if self.reference.piece_to_id(MARK) != self.mark:
                self.differ.add("")
            new = [p for p in new if p]
        own = self.tokenizer.encode_batch_fast(new, add_special_tokens=False)
        theirs = self.reference.encode(new, num_threads=self.threads)
        for part, mine, truth in zip(new, own, theirs, strict=True):
            ids = mine.ids
            if ids != truth:
                self.differ.add(part)
            self.known[part] = array("I", ids).tobytes()

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[bool]]:
        """Ids (little-endian, 32 bits), and whether the two libraries agree on the text."""
        cut = [self.parts(t) for t in texts]
        if len(self.known) > self.most:
            self.known.clear()
            self.differ.clear()
        new = set().union(*cut).difference(self.known)
        if new:
            self.learn(list(new))
        get = self.known.__getitem__
        same = [not self.differ or self.differ.isdisjoint(c) for c in cut]
        return [b"".join(map(get, c)) for c in cut], same


@lru_cache(maxsize=4)
def codec(path: str, threads: int) -> Codec:
    return Codec(path, threads)


@lru_cache(maxsize=4)
def decoder(path: str) -> Decoder:
    return Decoder(read_model(path))


def encode(docs: DataFrame, model: str, text: str = "text", threads: int = 2) -> DataFrame:
    """Rows of ``docs`` with ``ids array<int>`` and ``parity boolean``; no shuffle.

    Ids are those of the rebuilt tokenizers pipeline without begin and end; special strings inside
    a text are ordinary text. ``parity`` is false for a text with a part for which sentencepiece
    gives other ids. Null or empty texts have no ids; other columns, nulls and repeated rows pass
    unchanged, and columns of ``docs`` with the added names are replaced. Very long texts are
    encoded whole. An empty table gives no rows.
    """
    docs = docs.select(*(F.col(quoted(c)) for c in docs.columns if c == text or c not in ("ids", "parity")))
    of_text = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model, threads)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids, same = c.encode([t or "" for t in part.column(of_text).to_pylist()])
                ends = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<i4")))
                yield pa.RecordBatch.from_arrays([*part.columns, lists, pa.array(same, pa.bool_())], names=[*part.schema.names, "ids", "parity"])

    added = [StructField("ids", ArrayType(IntegerType())), StructField("parity", BooleanType())]
    return map_batches(docs, run, StructType([*docs.schema.fields, *added]))


def decode(rows: DataFrame, model: str, ids: str = "ids", into: str = "decoded", digest: bool = False) -> DataFrame:
    """Rows with the text of their ``ids`` in column ``into``; null ids give a null text.

    With ``digest``, ``n_tokens`` and ``ids_crc32`` (little-endian unsigned 32-bit ids; 0 for null)
    take the place of the ids. Empty lists give an empty text; other columns and repeated rows pass
    unchanged, whatever their names, and those with the added names are replaced.
    An empty table gives no rows.
    """
    added = [StructField(into, StringType()), *([StructField("n_tokens", LongType()), StructField("ids_crc32", LongType())] if digest else [])]
    names = [f.name for f in added]
    rows = rows.select(*(F.col(quoted(c)) for c in rows.columns if c == ids or c not in names))
    of_ids = rows.columns.index(ids)
    carry = [i for i in range(len(rows.columns)) if not (digest and i == of_ids)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = decoder(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                values = [x.values.to_numpy(zero_copy_only=False).astype("<u4") if x.is_valid else None for x in part.column(of_ids)]
                new = [pa.array([None if v is None else d.decode(v) for v in values], pa.string())]
                if digest:
                    new += [pa.array([0 if v is None else f(v) for v in values], pa.int64()) for f in (len, lambda v: zlib.crc32(v.tobytes()))]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in carry), *new], names=[*(part.schema.names[i] for i in carry), *names])

    return map_batches(rows, run, StructType([*(rows.schema.fields[i] for i in carry), *added]))


def there_and_back(docs: DataFrame, model: str, text: str = "text", into: str = "decoded", threads: int = 2) -> DataFrame:
    """As ``decode(encode(docs), digest=True)``, in one task a batch: ids don't leave it.

    Adds ``parity``, ``into``, ``n_tokens`` and ``ids_crc32``; columns with these names are replaced,
    except the text's. Null or empty texts have no ids and come back empty; other columns and
    repeated rows pass unchanged, very long texts are handled whole. An empty table gives no rows.
    """
    added = [StructField("parity", BooleanType()), StructField(into, StringType()), StructField("n_tokens", LongType()), StructField("ids_crc32", LongType())]
    names = [f.name for f in added]
    docs = docs.select(*(F.col(quoted(c)) for c in docs.columns if c == text or c not in names))
    of_text = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, d = codec(model, threads), decoder(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids, same = c.encode([t or "" for t in part.column(of_text).to_pylist()])
                back = pa.array([d.decode(np.frombuffer(x, "<u4")) for x in ids], pa.string())
                new = [pa.array(same, pa.bool_()), back, pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(list(map(zlib.crc32, ids)), pa.int64())]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*part.schema.names, *names])

    return map_batches(docs, run, StructType([*docs.schema.fields, *added]))
