"""Packing of tokenised documents into windows of a fixed length, by the sum-of-squares rule."""

from __future__ import annotations

import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _class_of(kind: str, last: int = 0x24F) -> str:
    """The characters up to U+024F whose category begins with ``kind``, for use inside [...]."""
    return "".join(re.escape(chr(i)) for i in range(last + 1) if unicodedata.category(chr(i)).startswith(kind))


def _byte_signs() -> dict[int, str]:
    """The sign that byte-level tokenizers use for each byte which isn't a visible Latin-1 character."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in seen)}


class WordEncoder:
    """Ids that the tokenizers library gives a text, asked for once per distinct word.

    The file's pre-tokenizer cuts a text into words that are encoded on their own, so a text's ids
    are its words' ids in a row. That holds for characters up to U+024F (one code point each, no
    composition, the same classes in every Unicode version); a text that has any other character as
    it is or in lower case, a control character or a special token's ``<|`` goes to the library whole.
    """

    def __init__(self, path: str, most_words: int = 800_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # kept here: each access makes a new handle
        self.model = self.tokenizer.model
        self.most_words = most_words
        self.known: dict[str, bytes] = {}
        self.signs = _byte_signs()
        letters, digits = _class_of("L"), _class_of("N")
        self.split = re.compile(rf"[{letters}]+|'(?:s|t|re|ve|m|ll|d)|[{digits}]|[^ \t\n\v\f\r{letters}{digits}]+").findall
        self.odd = re.compile(r"[^\t-\r -~\xa1-\u024f]").search

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, word: str) -> bytes:
        """A word in lower case, by the model alone: its bytes as signs, then merges."""
        signs = word if word.isascii() else word.encode().decode("latin-1").translate(self.signs)
        return array("I", [t.id for t in self.model.tokenize(signs)]).tobytes()

    def _words(self, text: str) -> list[str] | None:
        """None for a text that the library gets whole."""
        if self.odd(text) or "<|" in text:
            return None
        low = text.lower()
        return None if self.odd(low) else self.split(low)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        words = [self._words(t) for t in texts]
        if len(self.known) > self.most_words:
            self.known.clear()
        for w in set().union(*filter(None, words)).difference(self.known):
            self.known[w] = self._word(w)
        get = self.known.__getitem__
        return [self._whole(t) if ws is None else b"".join(map(get, ws)) for t, ws in zip(texts, words, strict=True)]


@lru_cache(maxsize=4)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


class SumOfSquares:
    """Online packing; ``put`` takes pieces no longer than a window.

    ``levels[h]`` is the number of open windows filled up to h, and ``at[h]`` lists them. A piece
    of s ids goes to the h for which the sum of squares of the levels is least afterwards: the
    sum falls by 2 (levels[h] - levels[h + s]) - 2, and by one less where h is 0 (a new window) or
    h + s a full one, as those are no levels. Ties: the fullest. No more than ``most`` windows stay open: beyond that, and at the end, pieces of the
    emptiest windows are cut to fill up the fullest ones.
    """

    def __init__(self, size: int, most: int = 512):
        self.size, self.most = size, most
        self.levels = np.zeros(size + 1, np.int64)
        self.at: dict[int, list[list]] = {}
        self.open = 0

    def _add(self, fill: int, window: list) -> None:
        self.levels[fill] += 1
        self.at.setdefault(fill, []).append(window)
        self.open += 1

    def _take(self, fill: int) -> list:
        self.levels[fill] -= 1
        self.open -= 1
        return self.at[fill].pop()

    def put(self, piece: tuple, length: int) -> list[list]:
        """Windows that are full now."""
        size, levels = self.size, self.levels
        done = []
        gain = 2 * levels[: size - length + 1]
        gain[: size - length] -= 2 * levels[length:size]
        gain[-1] += 1
        gain[levels[: size - length + 1] == 0] = np.iinfo(np.int64).min
        gain[0] = 1 - 2 * levels[length] if length < size else 0
        best = len(gain) - 1 - int(np.argmax(gain[::-1]))
        window = self._take(best) if best else []
        window.append((piece, length))
        if best + length == size:
            done.append(window)
        else:
            self._add(best + length, window)
        if self.open > self.most:
            done += self.drain(self.most // 2)
        return done

    def drain(self, leave: int) -> list[list]:
        """Fill the fullest windows with cut pieces of the emptiest, until ``leave`` are open."""
        windows = sorted(((f, w) for f, ws in self.at.items() for w in ws), key=lambda x: x[0])
        self.levels[:] = 0
        self.at, self.open = {}, 0
        done, low, high = [], 0, len(windows) - 1
        loose: list[tuple[tuple, int]] = []
        while high - low + 1 + bool(loose) > leave and (low < high or loose):
            fill, window = windows[high]
            while fill < self.size:
                if not loose:
                    if low >= high:
                        break
                    loose = windows[low][1]
                    low += 1
                piece, length = loose.pop()
                part = min(length, self.size - fill)
                window.append((piece, part))
                fill += part
                if part < length:
                    loose.append(((piece[0], piece[1] + part, piece[2]), length - part))
            if fill < self.size:
                windows[high] = (fill, window)
                break
            done.append(window)
            high -= 1
            if high < low:
                break
        for fill, window in windows[low : high + 1]:
            self._add(fill, window)
        if loose:
            self._add(sum(n for _, n in loose), loose)
        return done


def binary_parts(window: list, size: int) -> Iterator[list]:
    """A partly filled window as windows filled to powers of two, largest first."""
    left = sum(n for _, n in window)
    pieces = list(window)[::-1]
    while left:
        want = 1 << (left.bit_length() - 1)
        left -= want
        out = []
        while want:
            piece, length = pieces.pop()
            part = min(length, want)
            out.append((piece, part))
            want -= part
            if part < length:
                pieces.append(((piece[0], piece[1] + part, piece[2]), length - part))
        yield out


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer: str, size: int = 4096, end: int = 2, keep_ids: bool = False, most_open: int = 512) -> DataFrame:
    """Pieces of the documents' ids, placed in windows of ``size``; no shuffle.

    One row per piece: ``doc_id``, ``start`` and ``length`` in the document's ids (which end with
    ``end``), ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset`` in the window, and with
    ``keep_ids`` also ``ids array<int>``. Each task packs its own rows in their order, with at most
    ``most_open`` open windows in memory, and its window numbers begin at its partition number
    times 2^32. A document longer than a window fills whole ones first. Nothing is padded but what
    a task's last window leaves, and that is split into windows filled to powers of two. Null or
    empty texts are the ``end`` id alone; null ids stay null; repeated rows are packed each;
    other columns are left out; an empty table gives no rows.
    ``size`` must be a power of two.
    """
    if size < 1 or size & (size - 1):
        raise ValueError("size must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer)
        state = SumOfSquares(size, most_open)
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 32
        last = np.array([end], "<u4").tobytes()
        rows: list[tuple] = []

        def emit(window: list) -> None:
            nonlocal number
            offset = 0
            for (doc, start, ids), length in window:
                own = ids[4 * start : 4 * (start + length)]
                rows.append((doc, start, length, zlib.crc32(own), len(ids) // 4, number, offset, own))
                offset += length
            number += 1

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 8
            arrays = [pa.array(c, pa.int64()) for c in columns[:7]]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if keep_ids:
                arrays.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in columns[7]], pa.list_(pa.int32())))
                names.append("ids")
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [t or "" for t in part.column(1).to_pylist()]
                for doc, ids in zip(part.column(0).to_pylist(), encoder.encode(texts), strict=True):
                    ids += last
                    total, start = len(ids) // 4, 0
                    while total - start >= size:
                        emit([((doc, start, ids), size)])
                        start += size
                    if start < total:
                        for window in state.put((doc, start, ids), total - start):
                            emit(window)
                if len(rows) >= 2000:
                    yield batch_of(rows)
                    rows.clear()
        for window in state.drain(1):
            emit(window)
        for window in [w for ws in state.at.values() for w in ws]:
            for part in binary_parts(window, size):
                emit(part)
        yield batch_of(rows)

    ready = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return ready.mapInArrow(run, PIECES + (", ids array<int>" if keep_ids else ""))
