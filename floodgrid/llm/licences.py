"""Licence scans: notice phrases and identifier tags found by Aho-Corasick automata, and the value of licence expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from .text import map_batches, quoted, slices

#: Phrases whose places are counted, and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Families of licences: how much each restricts use, 0 (not at all) to 1, and words that name it.
#: Of phrases at one place the longest counts.
FAMILIES = {
    "public-domain": (0.05, ["public domain", "cc0", "the unlicense", "creative commons zero"]),
    "mit": (0.1, ["mit license", "mit licence", "permission is hereby granted free of charge"]),
    "isc": (0.1, ["isc license", "permission to use copy modify and or distribute this software"]),
    "bsd": (0.1, ["bsd license", "bsd licence", "bsd 2 clause", "bsd 3 clause", "redistribution and use in source and binary forms"]),
    "zlib": (0.1, ["zlib license"]),
    "boost": (0.1, ["boost software license"]),
    "apache": (0.15, ["apache license", "apache licence", "apache software license"]),
    "cc-by": (0.2, ["cc by", "creative commons attribution"]),
    "mpl": (0.4, ["mozilla public license"]),
    "epl": (0.4, ["eclipse public license"]),
    "lgpl": (0.45, ["gnu lesser general public license", "gnu library general public license", "gnu lgpl"]),
    "cc-by-sa": (0.5, ["cc by sa", "creative commons attribution sharealike", "creative commons attribution share alike"]),
    "gpl": (0.6, ["gnu general public license", "gnu gpl"]),
    "agpl": (0.7, ["gnu affero general public license", "gnu agpl"]),
    "cc-by-nd": (0.8, ["cc by nd", "creative commons attribution noderivatives", "creative commons attribution noderivs"]),
    "cc-by-nc": (0.9, ["cc by nc", "creative commons attribution noncommercial", "creative commons attribution non commercial"]),
    "cc-by-nc-sa": (0.9, ["cc by nc sa"]),
    "cc-by-nc-nd": (0.95, ["cc by nc nd"]),
    "proprietary": (1.0, ["all rights reserved", "proprietary and confidential"]),
}
#: Families that are told apart by a version behind their name.
VERSIONED = {"apache": (1, 2), "mpl": (1, 2), "epl": (1, 2), "lgpl": (2, 3), "gpl": (1, 2, 3), "agpl": (1, 3)}
#: Names in expressions that don't begin with their family's.
NAMES = {"cc0": "public-domain", "unlicense": "public-domain", "0bsd": "bsd", "bsl": "boost", "lgpllr": "lgpl"}
#: How an unknown name restricts.
UNKNOWN = 0.5
#: What is left of a restriction under an exception.
EXCEPTION = 0.5

#: Tags that an expression follows; behind the weak ones all names must be known.
TAGS = {"spdx-license-identifier:": True, "license-expression:": True, "license:": False, "licence:": False, "licenses:": False}

_LOW = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(256))
#: No token has a colon, so that no expression reaches beyond the next tag.
_TOKEN = re.compile(rb"[ \t]*(\(|\)|[a-z0-9][a-z0-9.+-]*)")
_PRECEDENCE = {"or": 1, "and": 2, "with": 3}


class Value(NamedTuple):
    """Of a licence expression: its labels, how it restricts, and whether all its names are known."""

    labels: frozenset[str]
    weight: float
    known: bool


def value_of(name: str) -> Value:
    """A single identifier, in lower case: ``gpl-3.0-or-later`` is of the label ``gpl-3``."""
    words = name.rstrip("+").split("-", 4)
    for n in range(min(4, len(words)), 0, -1):
        family = NAMES.get("-".join(words[:n]), "-".join(words[:n]))
        if family in FAMILIES:
            version = words[n].partition(".")[0] if n < len(words) else ""
            label = f"{family}-{version}" if version.isdigit() and int(version) in VERSIONED.get(family, ()) else family
            return Value(frozenset([label]), FAMILIES[family][0], True)
    return Value(frozenset([name]), UNKNOWN, False)


def evaluate(text: bytes, at: int = 0) -> tuple[Value | None, int]:
    """The value of the licence expression at ``at`` (ASCII in lower case), and where it ends.

    A shunting-yard parser: ``with`` binds closest, then ``and``, then ``or``; all bind to the left.
    ``or`` restricts as the lighter side does, ``and`` as the heavier, ``with`` and an exception's name
    by half. The expression is the longest beginning that is well formed once open brackets are
    closed and a trailing operator is left out; None if that is empty. Linear in its length, however deep.
    """
    operators: list[str] = []
    weights: list[float] = []
    labels: set[str] = set()
    known, wants_name, end = True, True, at

    def reduce(least: int) -> None:
        while operators and _PRECEDENCE.get(operators[-1], 0) >= least:
            right, operator = weights.pop(), operators.pop()
            left = weights.pop()
            weights.append(left * EXCEPTION if operator == "with" else min(left, right) if operator == "or" else max(left, right))

    while found := _TOKEN.match(text, at):
        token = found[1].decode().rstrip(".")
        excepts = wants_name and operators[-1:] == ["with"]
        if wants_name:
            if token == "(" and not excepts:
                operators.append(token)
            elif token in ("(", ")") or token in _PRECEDENCE:
                break
            else:
                value = value_of(token)
                weights.append(value.weight)
                if not excepts:
                    labels |= value.labels
                    known &= value.known
                wants_name, end = False, found.end()
        elif token == ")":
            reduce(1)
            if not operators:
                break
            operators.pop()
            end = found.end()
        elif token in _PRECEDENCE:
            reduce(_PRECEDENCE[token])
            operators.append(token)
            wants_name = True
        else:
            break
        at = found.end()
    while wants_name and operators:  # what waits for a name that doesn't come
        if operators.pop() in _PRECEDENCE:
            break
    while operators:
        if operators[-1] == "(":
            operators.pop()
        else:
            reduce(1)
    return (Value(frozenset(labels), weights[0], known) if weights else None), end


@lru_cache(maxsize=1)
def _automata() -> tuple[ahocorasick.Automaton, ahocorasick.Automaton]:
    """Of phrases, between spaces: (words, base label or None, label, weight); of tags: whether it is strong."""
    phrases: dict[str, tuple[str, float]] = {}
    for family, (weight, said) in FAMILIES.items():
        for p in said:
            phrases[p] = (family, weight)
            for v in VERSIONED.get(family, ()):
                for form in (f"{p} version {v}", f"{p} v{v}", f"{p} {v}"):
                    phrases[form] = (f"{family}-{v}", weight)
    phrases |= {p: (label, value_of(label).weight) for p, label in BASE.items()}
    phrase, tag = ahocorasick.Automaton(), ahocorasick.Automaton()
    for p, (label, weight) in phrases.items():
        phrase.add_word(f" {p} ", (len(p.split()), len(p) + 2, BASE.get(p), label, weight))
    for t, strong in TAGS.items():
        tag.add_word(t, strong)
    phrase.make_automaton()
    tag.make_automaton()
    return phrase, tag


class Scan(NamedTuple):
    n_words: int
    n_base: int
    first_word: int | None
    last_word: int | None
    base_labels: str
    labels: str
    score: float
    expressions: list[str]


def scan(text: str) -> Scan:
    """What one text says of its licences, in time linear in its length."""
    phrase, tag = _automata()
    raw = text.encode().lower()  # bytes: A-Z only
    words = re.sub(rb" {2,}", b" ", b" " + raw.translate(_LOW) + b" ").decode("latin-1")
    found = sorted((end - size + 1, -n, n, base, label, weight) for end, (n, size, base, label, weight) in phrase.iter(words))
    labels: set[str] = set()
    base_labels: set[str] = set()
    expressions: list[str] = []
    score, n_base, first, last, word, at, reach = 0.0, 0, None, None, 0, 0, 0
    for start, _, n, base, label, weight in found:
        word, at = word + words.count(" ", at, start), start
        if base:
            n_base, last = n_base + 1, word
            first = word if first is None else first
            base_labels.add(base)
        if word + n > reach:  # else it lies in a longer one
            labels.add(label)
            score, reach = max(score, weight), word + n
    if "licen" in words:
        seen = -1
        for end, strong in tag.iter(raw.decode("latin-1")):
            if end < seen:  # inside the expression before
                continue
            value, until = evaluate(raw, end + 1)
            if value and (strong or value.known):
                labels |= value.labels
                score, seen = max(score, value.weight), until
                expressions.append(raw[end + 1 : until].decode().strip())
    n_words = words.count(" ") - 1
    return Scan(n_words, n_base, first, last, ",".join(sorted(base_labels)), ",".join(sorted(labels | base_labels)), score, expressions)


_RESULT = [
    *(StructField(c, LongType()) for c in ("n_words", "n_base", "first_word", "last_word")), StructField("base_labels", StringType()), StructField("labels", StringType()),
    StructField("score", DoubleType()), StructField("expressions", ArrayType(StringType())),
]


def licence_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, expressions``.

    Words are runs of digits, letters and characters beyond ASCII, A-Z in lower case. ``n_base``
    counts the places where a BASE phrase's words stand, ``first_word`` and ``last_word`` are the
    least and greatest of them (null without any). ``labels`` adds those of the families' notices (the
    longest at a place) and of the expressions behind identifier tags. ``score`` is how much the text
    is restricted, 0 if it says nothing: what stands side by side, or joined by "and", counts by the
    most, "or" by the least, "with" halves. ``expressions`` are as found, in lower case.

    Nothing is shuffled. A null or empty text has no words; null ids and repeated rows stay; an empty
    table gives no rows; very long texts are scanned whole, in linear time; other columns don't matter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end in slices(batch.column(1)):
                part = batch.slice(begin, end - begin)
                columns = list(zip(*(scan(t or "") for t in part.column(1).to_pylist()), strict=True))
                kinds = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.float64(), pa.list_(pa.string())]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", *(f.name for f in _RESULT)])

    plain = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).cast("string").alias("text"))
    return map_batches(plain, run, StructType([StructField("doc_id", plain.schema["id"].dataType), *_RESULT]))
