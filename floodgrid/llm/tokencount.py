"""Token counts with a digest cache: a text is encoded once per tokenizer version, whoever has it."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .spm import MARK, NORMAL, read_model
from .text import Scratch, quoted, unused

CACHE = "text_digest binary, tokenizer_digest string, n_tokens long"


class PieceCounter:
    """Counts of a sentencepiece model.

    Where the model's file says that no piece has a space mark after another character and that
    nothing is normalised, no piece joins two space-separated parts: a text's count is then the sum
    over its parts, each counted once per task. Other models count whole texts.
    """

    def __init__(self, path: str, most: int = 400_000):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        self.most = most
        self.known: dict[str, int] = {"": 1}  # a lone mark
        said = read_model(path)
        self.by_part = said.by_part and any(p == MARK and kind == NORMAL for p, _, kind in said.pieces)

    @staticmethod
    def parts(text: str) -> list[str]:
        if MARK in text or "  " in text or text[0] == " " or text[-1] == " ":
            return [p[1:] for p in re.findall(f"{MARK}+[^{MARK}]*", MARK + text.replace(" ", MARK))]
        return text.split(" ")

    def count(self, texts: list[str]) -> list[int]:
        if not self.by_part:
            return [len(x) for x in self.model.encode(texts, num_threads=1)]
        cut = [self.parts(t) if t else [] for t in texts]
        if len(self.known) > self.most:
            self.known = {"": 1}
        new = list(set().union(*cut).difference(self.known))
        if new:
            self.known.update(zip(new, map(len, self.model.encode(new, num_threads=1)), strict=True))
        get = self.known.__getitem__
        return [sum(map(get, c)) for c in cut]


@lru_cache(maxsize=4)
def piece_counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def tokenizer_digest(path: str) -> str:
    """Names the tokenizer's version: its file and the library's."""
    import sentencepiece

    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + sentencepiece.__version__.encode()).hexdigest()


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(CACHE).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHE)


def token_counts(docs: DataFrame, tokenizer: str, cache: str, text: str = "text", limit: int = 4096, normalise=lambda c: c) -> DataFrame:
    """Rows of ``docs`` without the text, with ``n_bytes``, ``n_tokens`` and ``over_limit``.

    ``cache``: a Parquet folder (shared by all executors) of counts by the SHA-256 of the
    normalised text and the tokenizer's digest. Texts that it lacks are made distinct, encoded and
    appended; then every row joins its count. ``normalise`` may merge texts only if they have the
    same count (the default merges none but null and empty). Writers may append at the same time:
    a digest that is there twice is read once. Null or empty texts have 0 bytes and tokens; other
    columns, nulls and repeated rows pass unchanged, whatever their names, and columns of ``docs``
    with the added names are replaced. Very long texts are encoded whole. An empty table gives no rows.
    """
    spark, tables = docs.sparkSession, Scratch(docs.sparkSession)
    version = tokenizer_digest(tokenizer)
    added = ("n_bytes", "n_tokens", "over_limit")
    key = unused("text_digest", [*docs.columns, *added])
    plain: Column = F.coalesce(F.col(quoted(text)).cast("string"), F.lit(""))
    digest = lambda c: F.unhex(F.sha2(c, 256)).alias(key)

    def known() -> DataFrame:
        own = read_cache(spark, cache).where(F.col("tokenizer_digest") == version)
        return own.groupBy(F.col("text_digest").alias(key)).agg(F.max("n_tokens").alias("n_tokens"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = piece_counter(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                counts = counter.count(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([version] * part.num_rows, pa.string()), pa.array(counts, pa.int64())],
                    names=["text_digest", "tokenizer_digest", "n_tokens"],
                )

    # each task sends a text once, however often it has it
    distinct = docs.select(normalise(plain).alias("content")).select(digest("content"), "content").dropDuplicates([key])
    distinct.join(known().select(key), key, "left_anti").mapInArrow(count, CACHE).write.mode("append").parquet(cache)
    carry = [c for c in docs.columns if c != text and c not in added]
    rows = docs.select(*(F.col(quoted(c)) for c in carry), F.octet_length(plain).cast("long").alias("n_bytes"), digest(normalise(plain)))
    # written, so that Spark can split a text that many rows have
    counts = tables.write(known(), "counts")
    joined = rows.join(counts, key, "left").withColumn("over_limit", F.col("n_tokens") > limit)
    return joined.select(*(F.col(quoted(c)) for c in carry), *added)
