"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .text import map_batches, quoted

#: Kinds in their order where two spans begin at one place; the first four are the base.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "secret")
_ORDER = {k: i for i, k in enumerate(KINDS)}

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a digit run is matched from its beginning only, which is where the leftmost match begins
_IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
# zero-width, so that every place where an IBAN may begin is tried
_IBAN = re.compile(r"(?<![A-Za-z0-9])(?=([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}))")
#: Characters of an IBAN by country.
_IBAN_LENGTH = {
    c[:2]: int(c[2:])
    for c in (
        "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 "
        "GB22 GE22 GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 "
        "MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 "
        "TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30"
    ).split()
}
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_SECRET = re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{32,}+")
#: Words that speak for a kind when they stand within 40 code points of a span.
CONTEXT = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "credit", "karte", "tarjeta", "carte"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
    "iban": ("iban", "bank", "account", "konto", "cuenta", "compte"),
    "ssn": ("ssn", "social", "security"),
    "secret": ("token", "key", "secret", "password", "passwd", "bearer", "api", "auth"),
}
_NEAR = {k: re.compile(r"(?<![a-z])(?:" + "|".join(w) + r")(?![a-z])") for k, w in CONTEXT.items()}
#: Score of a confirmed span, before its context; a kind that needs context has less than 0.5.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.9, "ssn": 0.4, "secret": 0.3}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d)
        if i % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The leftmost matches: a local part ends at an @, so each @ is tried from left to right."""
    free, at = 0, text.find("@")
    while at >= 0:
        before = text[free:at]
        start = free + len(before.rstrip(_LOCAL))
        free = at + 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            free = m.end()
        at = text.find("@", free)


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """Numbers of their country's length that pass mod 97; for other countries, the longest that ends where a group does."""
    free = 0
    for m in _IBAN.finditer(text):
        if m.start() < free:
            continue
        length, plain, ends = _IBAN_LENGTH.get(m[1][:2]), "", []
        for i, c in enumerate(m[1], m.start() + 1):
            plain += c.strip()
            after = text[i : i + 1]
            if c != " " and (len(plain) == length if length else len(plain) >= 15) and not (after.isascii() and after.isalnum()):
                ends.append((i, plain))
        for end, number in reversed(ends):
            if mod97(number):
                yield m.start(), end
                free = end
                break


def find(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) of each span, in code points, by start and kind."""
    found: list[tuple[str, int, int]] = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        found += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p) < 256 for p in m.groups())]
        for m in _CARD.finditer(text):
            if 12 <= m.end() - m.start() <= 37:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    found.append(("card", *m.span()))
        if "+" in text:
            found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
        found += [("iban", a, b) for a, b in _ibans(text)]
        found += [("ssn", *m.span()) for m in _SSN.finditer(text)]
        found += [("secret", *m.span()) for m in _SECRET.finditer(text)]
    out = []
    for kind, a, b in found:
        near = text[max(0, a - 40) : a].lower() + " " + text[b : b + 40].lower()
        score = PRIOR[kind] + (0.3 if _NEAR[kind].search(near) else 0.0)
        if _ORDER[kind] < 4 or score >= 0.5:
            out.append((kind, a, b, round(min(score, 1.0), 2)))
    return sorted(out, key=lambda x: (x[1], _ORDER[x[0]], x[2]))


def redacted(text: str, spans: list[tuple[str, int, int, float]]) -> str:
    """The text with each span, or run of overlapping spans, as the first one's ``<kind>``."""
    out, at = [], 0
    for kind, a, b, _ in spans:
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _map(docs: DataFrame, text: str, added: list[StructField], of: Callable[[str | None], list], replace: bool = False) -> DataFrame:
    """``docs`` with the columns ``added``, instead of those that have their names; ``of`` gives their values for a text."""
    names = {f.name for f in added}
    at = docs.columns.index(text)
    carry = [i for i, c in enumerate(docs.columns) if c not in names or (i == at and not replace)]
    types = [to_arrow_type(f.dataType) for f in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                part = batch.slice(begin, 512)
                rows = [of(t) for t in part.column(at).cast(pa.string()).to_pylist()]
                new = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
                columns = [*(part.column(i) for i in carry), *new]
                yield pa.RecordBatch.from_arrays(columns, names=[str(i) for i in range(len(columns))])

    return map_batches(docs, run, StructType([*(docs.schema.fields[i] for i in carry), *added]))


SPANS = ArrayType(StructType().add("kind", "string").add("start", "long").add("end", "long").add("score", "double"))


def find_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """Rows of ``docs`` with ``pii``: spans (kind, start, end, score) in code points; no shuffle.

    Emails, IP addresses, card numbers (Luhn) and phone numbers are always reported; IBANs must
    pass mod 97; social security numbers and secrets also need a word nearby that speaks for
    them. Null or empty texts have no spans; other columns, nulls and repeated rows pass
    unchanged, and a column ``pii`` of ``docs`` is replaced. Whole texts are searched, in time
    linear in their length. An empty table gives no rows.
    """
    return _map(docs, text, [StructField("pii", SPANS)], lambda t: [[{"kind": k, "start": a, "end": b, "score": s} for k, a, b, s in find(t or "")]])


def redact_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span of ``find_pii`` replaced by ``<kind>``.

    Null stays null and empty stays empty; the columns and their order stay, others pass unchanged
    whatever their names, and repeated rows are redacted each. An empty table gives no rows.
    """
    out = _map(docs, text, [StructField(text, StringType())], lambda t: [None if t is None else redacted(t, find(t))], replace=True)
    return out.select(*map(quoted, docs.columns))


def span_digests(docs: DataFrame, text: str = "text") -> DataFrame:
    """Rows of ``docs`` with counts of the base kinds, ``base_sha256`` and ``spans``.

    Null and empty texts have no spans; columns of ``docs`` with the added names are replaced, all
    others pass unchanged, and repeated rows have a result each. An empty table gives no rows.
    """

    def of(t: str | None) -> list:
        spans = find(t or "")
        said = [f"{k}:{a}:{b}" for k, a, b, _ in spans]
        base = [x for x, s in zip(said, spans, strict=True) if _ORDER[s[0]] < 4]
        counts = [sum(s[0] == k for s in spans) for k in KINDS[:4]]
        return [*counts, hashlib.sha256(",".join(base).encode()).hexdigest(), ",".join(said)]

    counts = [StructField(f"n_{k}", LongType()) for k in KINDS[:4]]
    return _map(docs, text, [*counts, StructField("base_sha256", StringType()), StructField("spans", StringType())], of)
