"""Operators of a training-data pipeline: packing, extraction, media, filters, dedup, PII, tokens.

Nothing outside this subpackage imports it.  Every operator takes and returns DataFrames; numpy
and tokenizer libraries only run inside Spark tasks, on bounded batches of rows.
"""
