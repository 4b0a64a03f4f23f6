"""Queries that apply each operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bitplanes import plane_kmeans
from .importance import importance_resample
from .licences import licence_scan
from .linededup import line_dedup
from .media import media_features, store_texts
from .neardup import NearDupConfig, near_duplicates
from .packing import pack
from .pii import span_digests
from .repetition import repetition
from .spm import there_and_back
from .text import scratch, small_batches
from .tokencount import token_counts
from .vectorcodes import vector_codes
from .wrapper import extract


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return small_batches(spark).read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = extract(small_batches(spark).read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    return pages.withColumn("n_chars", F.char_length("text").cast("long"))


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "media")
    store_texts(_documents(spark, sf_dir), path)
    found = media_features(spark, path)
    return found.select(F.expr("try_cast(name AS BIGINT)").alias("doc_id"), *found.columns[1:])


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition(_documents(spark, sf_dir)).drop("text").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "dup_line_chars",
        *(F.col("dup_ngram_chars")[k].alias(f"dup_{k}gram_chars") for k in (5, 7, 10)),
    )


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return importance_resample(_documents(spark, sf_dir), labels, carry=["doc_id"])


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_documents(spark, sf_dir), cfg=NearDupConfig(shingle=2))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_digests(_documents(spark, sf_dir)).drop("text")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup(_documents(spark, sf_dir))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"), scratch(spark, "token-cache"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes every text, decodes the ids again, and tells whether both libraries and texts agree."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    docs = _documents(spark, sf_dir)
    rows = there_and_back(docs, model)
    rows = rows.withColumn("round_trip", F.col("decoded") == F.replace(F.coalesce("text", F.lit("")), F.lit("▁"), F.lit(" ")))
    return rows.withColumn("decoded_sha256", F.sha2("decoded", 256)).drop("text", "decoded")


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plane_kmeans(_embeddings(spark, sf_dir))


def op12_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_scan(_documents(spark, sf_dir)).drop("expressions")


def op13_vector_code_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(_embeddings(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_packing, op2_html_extraction, op3_media_columns, op4_quality_rules, op5_quality_classifier, op6_minhash_near_dedup, op7_pii, op8_line_dedup, op9_token_counts, op10_sentencepiece,
             op11_centroid_clustering, op12_license_scans, op13_vector_code_compression]
    return {f.__name__: f for f in found}


_BLANKS = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"

#: Texts that DuckDB can check whole: line keys, their document counts and what is kept.
OP8_SQL = f"""
WITH docs AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text FROM documents),
lines AS (
  SELECT r, doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM docs
),
keyed AS (
  SELECT r, doc_id, pos, line,
         translate(trim(line, {_BLANKS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
),
common AS (SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10),
kept AS (SELECT *, key IN (SELECT key FROM common) AS dropped FROM keyed)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE dropped))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM kept GROUP BY r, doc_id
"""


_WORDS = r"""
w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all({text}, '[^\x20\x09-\x0D]+') AS ws FROM documents)
"""
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: All pairs that share a shingle, counted; then what each document reaches by links.
OP6_SQL = f"""
WITH RECURSIVE {_WORDS.format(text=_LOWER)},
sh AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(ws) < 2 THEN ws ELSE [ws[i] || ' ' || ws[i + 1] FOR i IN range(1, len(ws))] END) AS s FROM w
  )
),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.c)
SELECT r.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(c) AS component_id, r.doc_id = min(c) AS kept
FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""


def _covered(k: int) -> str:
    """CTEs: for each word, whether it lies in a k-word window that its document has twice."""
    return f"""
g{k} AS (SELECT doc_id, i, n, length(word) AS size, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {k - 1} FOLLOWING) AS gram FROM t),
f{k} AS (SELECT doc_id, i, size, i + {k} <= n AND count(*) FILTER (WHERE i + {k} <= n) OVER (PARTITION BY doc_id, gram) > 1 AS twice FROM g{k}),
c{k} AS (SELECT doc_id, size, max(twice::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW) AS inside FROM f{k}),
s{k} AS (SELECT doc_id, sum(inside) AS words, sum(inside * size) AS chars FROM c{k} GROUP BY doc_id)"""


OP4_SQL = rf"""
WITH {_WORDS.format(text="coalesce(text, '')")},
t AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM w),
{", ".join(_covered(k) for k in (3, 5, 7, 10))},
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM w),
d AS (
  SELECT doc_id, length(regexp_replace(line, '[ 	-
]', '', 'g')) AS size, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) > 1 AS later
  FROM l WHERE regexp_matches(line, '[^ 	-
]')
),
dl AS (SELECT doc_id, count(*) FILTER (WHERE later) AS lines, coalesce(sum(size) FILTER (WHERE later), 0) AS chars FROM d GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[ 	-
]', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dl.lines, 0)::BIGINT AS n_dup_lines,
         coalesce(s3.words, 0)::BIGINT AS n_repeat_words, coalesce(dl.chars, 0)::BIGINT AS dup_line_chars, coalesce(s5.chars, 0)::BIGINT AS dup_5gram_chars,
         coalesce(s7.chars, 0)::BIGINT AS dup_7gram_chars, coalesce(s10.chars, 0)::BIGINT AS dup_10gram_chars
  FROM w LEFT JOIN dl USING (doc_id) LEFT JOIN s3 USING (doc_id) LEFT JOIN s5 USING (doc_id) LEFT JOIN s7 USING (doc_id) LEFT JOIN s10 USING (doc_id)
),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND dup_line_chars <= 0.3::DOUBLE * word_chars AND dup_5gram_chars <= 0.3::DOUBLE * word_chars
          AND dup_7gram_chars <= 0.27::DOUBLE * word_chars AND dup_10gram_chars <= 0.24::DOUBLE * word_chars AS kept
FROM b
"""


def _op11_sql(k: int = 40, rounds: int = 5) -> str:
    """Every round as a CTE of centroids: distances to all, the nearest, floors of means."""
    nearest = """
a{n} AS MATERIALIZED (
  SELECT vec_id, q, arg_min(c, (d, c)) AS c, min(d) AS d
  FROM (SELECT v.vec_id, v.q, m.c, list_sum([(v.q[i] - m.m[i]) * (v.q[i] - m.m[i]) FOR i IN range(1, 65)])::BIGINT AS d FROM v CROSS JOIN m{n} m) GROUP BY vec_id, q
)"""
    means = """
m{next} AS MATERIALIZED (
  SELECT m.c, coalesce(x.m, m.m) AS m
  FROM m{n} m LEFT JOIN (
    SELECT c, list(floor(s::DOUBLE / k)::BIGINT ORDER BY i) AS m
    FROM (SELECT c, i, sum(q[i]) AS s, count(*) AS k FROM a{n}, range(1, 65) r(i) GROUP BY c, i) GROUP BY c
  ) x USING (c)
)"""
    steps = [(nearest.format(n=n) + "," + means.format(n=n, next=n + 1)) for n in range(rounds)]
    return f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS q
  FROM embeddings WHERE len(embedding) = 64 AND len([x FOR x IN embedding IF isfinite(x)]) = 64
),
m0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c, q AS m FROM v ORDER BY sha256('2:' || vec_id) LIMIT {k}),
{",".join(steps)},{nearest.format(n=rounds)}
SELECT vec_id, c::INT AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(m, ',')) AS centroid_sha256
FROM a{rounds} JOIN m{rounds} USING (c)
"""


def _op13_sql(rounds: int = 4) -> str:
    nearest = """
a{n} AS MATERIALIZED (
  SELECT vec_id, p, any_value(q) AS q, arg_min(e, (d, e)) AS e, min(d) AS d
  FROM (SELECT v.vec_id, v.p, v.q, m.e, list_sum([(v.q[i] - m.m[i]) * (v.q[i] - m.m[i]) FOR i IN range(1, 17)])::BIGINT AS d FROM v JOIN m{n} m USING (p)) GROUP BY vec_id, p
)"""
    means = """
m{next} AS MATERIALIZED (
  SELECT m.p, m.e, coalesce(x.m, m.m) AS m
  FROM m{n} m LEFT JOIN (
    SELECT p, e, list(floor(s::DOUBLE / k)::BIGINT ORDER BY i) AS m
    FROM (SELECT p, e, i, sum(q[i]) AS s, count(*) AS k FROM a{n}, range(1, 17) r(i) GROUP BY p, e, i) GROUP BY p, e
  ) x USING (p, e)
)"""
    steps = [(nearest.format(n=n) + "," + means.format(n=n, next=n + 1)) for n in range(rounds)]
    return f"""
WITH w AS MATERIALIZED (
  SELECT vec_id, label, [floor(1024 * x::DOUBLE)::BIGINT FOR x IN embedding] AS q
  FROM embeddings WHERE len(embedding) = 64 AND len([x FOR x IN embedding IF isfinite(x)]) = 64
),
v AS MATERIALIZED (SELECT vec_id, p, q[16 * p + 1 : 16 * p + 16] AS q FROM w, range(4) r(p)),
m0 AS MATERIALIZED (SELECT p, e, q AS m FROM (SELECT p, q, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e FROM v) WHERE e < 256),
{",".join(steps)},{nearest.format(n=rounds)},
c AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(array_to_string(m, ','), ',' ORDER BY p, e)) FROM m{rounds}) AS codebooks_sha256
FROM c JOIN w USING (vec_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_centroid_clustering": _op11_sql(), "op13_vector_code_compression": _op13_sql(), "op4_quality_rules": OP4_SQL, "op6_minhash_near_dedup": OP6_SQL, "op8_line_dedup": OP8_SQL}
