"""From raw documents to packed training sequences: five stages, each written and read again.

Each stage takes the columns of documents (doc_id, text, lang, source, n_chars); extra columns do
not go on. Null and empty texts, repeated rows and ids, empty tables and very long texts pass
through every stage, as each stage's text says. A row is a document, whatever its id.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floodgrid.llm.importance import importance_resample
from floodgrid.llm.linededup import line_dedup
from floodgrid.llm.neardup import without_near_duplicates
from floodgrid.llm.packing import pack
from floodgrid.llm.pii import redact_pii
from floodgrid.llm.text import Scratch, small_batches

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars`` is the length of the text as it is now; null for a null text."""
    length = F.char_length("text").cast(docs.schema["n_chars"].dataType)
    return docs.withColumn("n_chars", length).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling keeps.

    Empty and null texts weigh 0; repeated rows stay or go together; without labelled good
    documents all stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return importance_resample(docs.select(*COLUMNS), labels, carry=COLUMNS).where("kept").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that ten documents or more have.

    All rows stay; a null text stays null, and one that loses all its lines becomes empty.
    """
    return _counted(line_dedup(docs.select(*COLUMNS)))


def near_dups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the least id.

    Rows without words or with a null id stay. Rows that repeat an id are told apart by their
    texts; rows that repeat both stay or go together.
    """
    return without_near_duplicates(docs.select(*COLUMNS))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind; all rows stay, a null text stays null."""
    small_batches(spark)
    return _counted(redact_pii(docs.select(*COLUMNS)))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of tokens; null and empty texts are the end token alone, repeated rows are packed each."""
    small_batches(spark)
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality classifier", quality), ("line dedup", lines), ("near dedup", near_dups), ("pii", pii), ("packing", packing)]

#: Classifier, sketches and tokenizer have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; a stage's table is dropped when the next one's is written."""
    tables, docs = Scratch(spark), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = tables.write(stage(spark, docs, sf_dir), name.replace(" ", "-"), instead_of=(docs,))
    return STAGES[-1][1](spark, docs, sf_dir)
