"""Quality classifier by importance resampling.

Two hashed n-gram models (words and word pairs, lower case, split where letters meet other signs)
are counted: one over all documents (raw), one over labelled good ones (target). A document's log
weight is the log of the two models' ratio: the sum over its n-grams, smoothed towards 0 where a
bucket is rare. Standard Gumbel noise is added and the k largest sums are kept, which samples k
documents without replacement in proportion to their weights. Sums of long texts differ by far more
than the noise does: what it decides are short texts and those near the k-th place.

A filter of its own follows, since a few words that good documents surely don't have weigh little in
the sum of a long text: ``doubt`` is what its words' log-ratios have below ``-sure``, a word, and
documents over the limit of good ones go whatever they weigh.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from .text import Scratch, Text, bucket_counts, map_batches, mix, ngrams, quoted, slices


@dataclass(frozen=True)
class ImportanceConfig:
    """bits: buckets of each model are 2^bits. labelled: at most about so many labelled rows are
    used (a hash of the id decides). holdout: share of them that calibrates k and the limit of doubt
    instead of fitting. keep_clean: share of the held-out good documents that k must leave room for.
    temperature: scale of the Gumbel noise; 1 samples in proportion to the weights. prior_words,
    prior_pairs: pseudo-counts. keep_plain: share of the held-out good documents that the filter of
    doubt must leave. sure: log-ratios of words above -sure raise no doubt. calm: so many words
    without doubt are added to a text's own, as a short one's mean is uncertain."""

    bits: int = 17
    labelled: int = 50_000
    holdout: float = 0.25
    keep_clean: float = 0.998
    temperature: float = 1.0
    prior_words: float = 1.0
    prior_pairs: float = 3.0
    sure: float = 1.0
    keep_plain: float = 0.982
    calm: float = 20.0
    seed: int = 0


def _features(column: pa.Array, bits: int) -> tuple[Text, list[tuple[np.ndarray, np.ndarray]]]:
    t = Text(column, lower=True, punct=True)
    words, doc = t.words(), t.doc_of_words()
    pairs, at = ngrams(words, doc, 2)
    shift = np.uint64(64 - bits)
    return t, [((words >> shift).astype(np.int64), doc), ((pairs >> shift).astype(np.int64), doc[at])]


def _labelled(labels: DataFrame, good, cfg: ImportanceConfig) -> tuple[np.ndarray, np.ndarray]:
    """Ids of good rows to fit on, and to calibrate with; a bounded number."""
    rows = labels.where(F.col("doc_id").isNotNull()).select("doc_id", F.coalesce(good, F.lit(False)).alias("good"))
    total = max(1, rows.count())
    spot = F.pmod(F.xxhash64("doc_id", F.lit(cfg.seed)), F.lit(1 << 30)) / float(1 << 30)
    ids = rows.where("good").where(spot < cfg.labelled / total).select("doc_id", spot.alias("spot")).limit(2 * cfg.labelled).toPandas()
    ids["turn"] = (mix(ids["doc_id"].to_numpy(np.uint64) ^ np.uint64(cfg.seed + 1)) >> np.uint64(34)) / float(1 << 30)
    held = (ids["turn"] < cfg.holdout).to_numpy(bool)
    every = ids["doc_id"].to_numpy(np.int64)
    return np.unique(every[~held]), np.unique(every[held])


def fit(docs: DataFrame, target_ids: np.ndarray, cfg: ImportanceConfig) -> tuple[np.ndarray, np.ndarray]:
    """Log-ratios of the word buckets and of the pair buckets, from one pass over ``docs``."""

    def buckets(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        # tables: raw words, raw pairs, target words, target pairs
        ids, column = batch.column(0), batch.column(1)
        chosen = np.isin(ids.fill_null(-1).to_numpy(zero_copy_only=False), target_ids) & np.asarray(ids.is_valid())
        for a, b in slices(column):
            for k, (bucket, doc) in enumerate(_features(column.slice(a, b - a), cfg.bits)[1]):
                yield k, bucket
                yield 2 + k, bucket[chosen[a:b][doc]]

    ready = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = bucket_counts(ready, buckets, 1 << cfg.bits, tables=4)
    out = []
    for raw, target, prior in ((total[0], total[2], cfg.prior_words), (total[1], total[3], cfg.prior_pairs)):
        expected = raw * (target.sum() / max(1, raw.sum()))
        out.append(np.log((target + prior) / (expected + prior)))
    return out[0], out[1]


def weigh(column: pa.Array, ratios: tuple[np.ndarray, np.ndarray], cfg: ImportanceConfig) -> tuple[np.ndarray, np.ndarray]:
    """The log weight of each text, the sum of its n-grams' log-ratios, and the doubt about its words."""
    _, found = _features(column, cfg.bits)
    n = len(column)
    # counts of nothing are whole numbers
    weight = sum(np.bincount(doc, r[bucket], minlength=n).astype(float) for r, (bucket, doc) in zip(ratios, found, strict=True))
    words, doc = found[0]
    below = np.bincount(doc, np.maximum(-ratios[0] - cfg.sure, 0)[words], minlength=n)
    return weight, below / (np.bincount(doc, minlength=n) + cfg.calm)


def gumbel(ids: np.ndarray, seed: int) -> np.ndarray:
    """Standard Gumbel noise that depends on the id and the seed only."""
    u = (mix(mix(ids.astype(np.uint64)) ^ np.uint64(seed)) >> np.uint64(11)).astype(np.float64)
    return -np.log(-np.log((u + 0.5) / float(1 << 53)))


def kth_largest(scores: DataFrame, column: str, k: int, exact_below: int = 20_000) -> float:
    """The k-th largest value, by histograms of 4096 bins, each inside a bin of the one before.

    Equal values count each; nulls don't count. With fewer than k values it is the smallest one, without
    any -inf; for k = 0 it is inf.
    """
    low, high, n = scores.agg(F.min(column), F.max(column), F.count(column)).first()
    if k >= n:
        return float("-inf") if low is None else low
    if k <= 0:
        return float("inf")
    c, above = F.col(column), 0
    while n > exact_below and low < high:
        width = (high - low) / 4096
        inside = scores.where((c >= low) & (c <= high))
        bins = inside.groupBy(F.least(F.floor((c - low) / F.lit(width)), F.lit(4095)).alias("bin")).agg(
            F.count("*").alias("n"), F.min(c).alias("low"), F.max(c).alias("high")
        )
        for b in bins.orderBy(F.desc("bin")).collect():  # at most 4096 rows
            if above + b["n"] >= k:
                if (b["low"], b["high"]) == (low, high):
                    return low
                low, high, n = b["low"], b["high"], b["n"]
                break
            above += b["n"]
    if low == high:
        return low
    last = scores.where((c >= low) & (c <= high)).select(column).toPandas()[column].to_numpy()
    return float(np.sort(last)[::-1][k - above - 1])


def importance_resample(
    docs: DataFrame,
    labels: DataFrame,
    good=None,
    carry: list[str] | None = None,
    cfg: ImportanceConfig = ImportanceConfig(),
) -> DataFrame:
    """``carry`` columns of ``docs`` (default: all), with ``weight`` (log), ``perturbed``, ``doubt``, ``kept``.

    ``good``: a condition on ``labels`` (doc_id, quality, toxic) that makes a row a target; by
    default ``quality = 1 and toxic = 0``. k is the number of documents that weigh at least as
    much as the lowest ``1 - keep_clean`` of the held-out targets; a document is kept if it is among
    the k largest and no more doubtful than ``keep_plain`` of those targets. Without any target every
    document stays. Null or empty texts weigh 0 without doubt, null ids draw the noise of id 0;
    repeated rows draw the same noise and ties at the k-th place all stay. Labels of unknown ids are
    ignored. Columns of ``docs`` with the added names are replaced, others pass unchanged whatever
    their names. Counting reads all documents, very long ones whole; only the labelled sample is
    bounded. Weights are made twice, for the k-th place and for the result, so that no copy of the
    texts is written. An empty table gives no rows.
    """
    good = (F.col("quality") == 1) & (F.col("toxic") == 0) if good is None else good
    carry = [c for c in (carry or docs.columns) if c not in ("weight", "perturbed", "doubt", "kept")]
    columns = [F.col(quoted(c)) for c in carry]
    target, held = _labelled(labels, good, cfg)
    if not len(target):
        return docs.select(*columns).withColumns({"weight": F.lit(0.0), "perturbed": F.lit(0.0), "doubt": F.lit(0.0), "kept": F.lit(True)})
    spark, tables = docs.sparkSession, Scratch(docs.sparkSession)
    shared = spark.sparkContext.broadcast((fit(docs, target, cfg), held))  # 2^(bits+1) numbers and a bounded sample

    def score(fields: list[StructField], verdict) -> DataFrame:
        names = [f.name for f in fields]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ratios, checks = shared.value
            for batch in batches:
                *others, ids, column = batch.columns
                number = ids.fill_null(0).to_numpy(zero_copy_only=False)
                found = [weigh(column.slice(a, b - a), ratios, cfg) for a, b in slices(column)]
                weight, doubt = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0), np.zeros(0))
                perturbed = weight + cfg.temperature * gumbel(number, cfg.seed)
                last = verdict(perturbed, doubt, np.isin(number, checks) & np.asarray(ids.is_valid()))
                new = [pa.array(x) for x in (weight, perturbed, doubt, last)]
                yield pa.RecordBatch.from_arrays([*others[: len(fields) - 4], *new], names=names)

        width = len(fields) - 4
        ready = docs.select(*columns[:width], F.col("doc_id").cast("long"), F.col("text").cast("string")).toDF(*map(str, range(width + 2)))
        return map_batches(ready, run, StructType(fields))

    doubles = [StructField(n, DoubleType()) for n in ("weight", "perturbed", "doubt")]
    scored = tables.write(score([*doubles, StructField("checks", BooleanType())], lambda perturbed, doubt, checks: checks), "importance")
    of_good = scored.where("checks").agg(F.percentile("weight", F.lit(1 - cfg.keep_clean)), F.percentile("doubt", F.lit(cfg.keep_plain))).first()
    cut, limit = (float(x) if x is not None else e for x, e in zip(of_good, (float("-inf"), float("inf")), strict=True))
    threshold = kth_largest(scored, "perturbed", scored.where(F.col("weight") >= F.lit(cut)).count())
    tables.clear()
    return score([*docs.select(*columns).schema.fields, *doubles, StructField("kept", BooleanType())], lambda perturbed, doubt, checks: (perturbed >= threshold) & (doubt <= limit))
