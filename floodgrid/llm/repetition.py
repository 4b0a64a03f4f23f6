"""Quality rules: how much of a text lies inside repeated n-grams and lines."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, MapType, StructField, StructType

from .text import Text, map_batches, ngrams, quoted, repeated, slices

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class RepetitionRules:
    """Limits of the verdict.

    ``ngram_chars``: for each n-gram length in words, the largest share of word characters that
    may lie inside n-grams which the text has twice or more. ``line_chars``: the same for lines
    that repeat an earlier line. ``min_words`` and ``max_repeat_words`` are the base rules.
    """

    min_words: int = 50
    max_repeat_words: float = 0.5
    ngram_chars: dict[int, float] = field(default_factory=lambda: {5: 0.30, 7: 0.27, 10: 0.24})
    line_chars: float = 0.30


#: The columns that are added, but for the verdict.
ADDED = [StructField(c, LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars")]
ADDED.append(StructField("dup_ngram_chars", MapType(IntegerType(), LongType())))


def measure(column: pa.Array, lengths: list[int]) -> dict[str, np.ndarray]:
    """The counts of each text of a batch; see ``repetition``."""
    t = Text(column)
    n = len(column)
    points = ((t.data & 0xC0) != 0x80) & t.inside
    chars = np.zeros(len(points) + 1, np.int64)
    np.add.accumulate(points, dtype=np.int64, out=chars[1:])
    words, doc = t.words(), t.doc_of_words()
    word_chars = chars[t.ends] - chars[t.starts]
    out = {
        "n_words": t.n_words,
        "word_chars": chars[t.docs[1:]] - chars[t.docs[:-1]],
        "n_symbols": t.per_doc(_SYMBOL[t.data]),
    }
    starts, ends, of = t.lines()
    line_chars = chars[ends] - chars[starts]
    full = line_chars > 0
    _, later = repeated(t.hashes(starts[full], ends[full]), of[full])
    out["n_dup_lines"] = np.bincount(of[full][later], minlength=n)
    out["dup_line_chars"] = np.bincount(of[full][later], line_chars[full][later], minlength=n).astype(np.int64)

    def covered(k: int) -> np.ndarray:
        keys, at = ngrams(words, doc, k)
        twice, _ = repeated(keys, doc[at])
        edge = np.zeros(len(words) + 1, np.int64)
        np.add.at(edge, at[twice], 1)
        np.add.at(edge, at[twice] + k, -1)
        return np.add.accumulate(edge)[:-1] > 0

    out["n_repeat_words"] = np.bincount(doc[covered(3)], minlength=n)
    for k in lengths:
        inside = covered(k)
        out[f"chars_{k}"] = np.bincount(doc[inside], word_chars[inside], minlength=n).astype(np.int64)
    return out


def repetition(docs: DataFrame, text: str = "text", rules: RepetitionRules = RepetitionRules()) -> DataFrame:
    r"""Rows of ``docs`` with repetition counts and the verdict.

    Adds ``n_words``, ``word_chars`` (code points in words), ``n_symbols``, ``n_dup_lines``,
    ``n_repeat_words``, ``dup_line_chars``, ``dup_ngram_chars`` (by n-gram length),
    ``base_failed`` and ``kept``. Words are runs of bytes other than ``[\x20\x09-\x0D]``; lines
    are split at ``\n``. A column of ``docs`` with one of these names is replaced; all others,
    nulls included, pass unchanged. A null or empty text has no words, so it fails the base rule.
    Texts are read whole, whatever their length; equal rows get equal results. No
    shuffle. An empty table gives no rows.
    """
    lengths = sorted(rules.ngram_chars)
    added = [*(f.name for f in ADDED), "base_failed", "kept"]
    docs = docs.select(*(F.col(quoted(c)) for c in docs.columns if c == text or c not in added))
    of_text = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(of_text)
            for a, b in slices(column):
                part = batch.slice(a, b - a)
                m = measure(column.slice(a, b - a), lengths)
                maps = pa.MapArray.from_arrays(
                    pa.array(np.arange(b - a + 1, dtype=np.int32) * len(lengths)),
                    pa.array(np.tile(np.array(lengths, np.int32), b - a)),
                    pa.array(np.stack([m[f"chars_{k}"] for k in lengths], 1).ravel() if lengths else np.zeros(0, np.int64)),
                )
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, *[pa.array(m[c], pa.int64()) for c in added[:6]], maps],
                    names=[*part.schema.names, *added[:7]],
                )

    found = map_batches(docs, run, StructType([*docs.schema.fields, *ADDED]))
    base = (F.col("n_words") < rules.min_words) | (F.col("n_repeat_words") > rules.max_repeat_words * F.col("n_words"))
    limits = [F.col("dup_line_chars") <= rules.line_chars * F.col("word_chars")]
    limits += [F.col("dup_ngram_chars")[k] <= share * F.col("word_chars") for k, share in rules.ngram_chars.items()]
    verdict = F.lit(True)
    for x in limits:
        verdict &= x
    return found.withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & verdict)
