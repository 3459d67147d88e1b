"""Personal data: regular expressions propose spans, checksums confirm them, nearby words move the score.

Base kinds (email, ip, card, phone) follow fixed patterns, found leftmost and without overlaps per kind; spans that
fail their test are dropped and not tried again. The method adds ``iban`` (confirmed by mod 97), and ``ssn`` and
``local_phone``, which have no checksum and so need a context word nearby to reach the threshold.

Defined results: a null or empty text has no spans; ties and repeated rows are scanned alike; an empty table gives an
empty table; extra columns are kept unless they have the name of the result column ``pii``. All patterns run in time
linear in the text: long runs of digits or letters are entered at their beginning only.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from shelfmark.llm import common

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn", "local_phone")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])")

#: Words within CONTEXT_CHARS before or after a span that raise or lower its score.
CONTEXT_CHARS = 48
RAISES = {
    "email": ("mail", "contact", "write"), "ip": ("host", "server", "address", "login"), "card": ("card", "visa", "credit", "payment"),
    "phone": ("phone", "call", "tel", "mobile", "fax"), "iban": ("iban", "account", "bank"), "ssn": ("ssn", "social", "security"),
    "local_phone": ("phone", "call", "tel", "mobile", "fax"),
}
LOWERS = {"ip": ("version", "release"), "card": ("isbn", "serial", "order"), "phone": ("isbn", "part"), "ssn": ("serial", "part", "isbn"), "local_phone": ("serial", "isbn", "part")}
START_SCORE = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.9, "ssn": 0.4, "local_phone": 0.3}
THRESHOLD = 0.5

SPANS = ArrayType(StructType([StructField("kind", StringType()), StructField("start", LongType()), StructField("end", LongType()), StructField("score", DoubleType())]))


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        total += v if i % 2 == 0 else (2 * v - 9 if v > 4 else 2 * v)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    rest = 0
    for c in iban[4:] + iban[:4]:
        v = int(c, 36)
        rest = (rest * (10 if v < 10 else 100) + v) % 97
    return rest == 1


def emails(text: str) -> list[tuple[int, int]]:
    """The local part is the run of its characters before each @, as far back as the last match allows."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            found.append((start, m.end()))
            free = m.end()
        else:
            free = max(free, at)  # no local part reaches over an @
        at = text.find("@", max(at + 1, free))
    return found


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _score(kind: str, text: str, start: int, end: int, lowered: str) -> float:
    near = lowered[max(0, start - CONTEXT_CHARS) : start] + " " + lowered[end : end + CONTEXT_CHARS]
    score = START_SCORE[kind]
    score += 0.2 if any(w in near for w in RAISES[kind]) else 0
    score -= 0.2 if any(w in near for w in LOWERS.get(kind, ())) else 0
    return round(min(1.0, max(0.0, score)), 3)


def find(text: str | None) -> list[dict]:
    """All spans, by kind and then by start; code points, end exclusive."""
    text = text or ""
    spans: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        spans["email"] = emails(text)
    if "." in text:
        spans["ip"] = [m.span() for m in _IP.finditer(text) if all(int(p[-10:]) <= 255 and not p[:-10].strip("0") for p in m[0].split("."))]
    spans["card"] = [m.span() for m in _CARD.finditer(text) if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        spans["phone"] = [m.span() for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    spans["iban"] = [m.span() for m in _IBAN.finditer(text) if 15 <= len(s := m[0].replace(" ", "")) <= 34 and mod97(s)]
    if "-" in text:
        spans["ssn"] = [m.span() for m in _SSN.finditer(text)]
    spans["local_phone"] = [m.span() for m in _LOCAL_PHONE.finditer(text)]
    if not any(spans.values()):
        return []
    lowered = text.lower()
    if len(lowered) != len(text):  # a few letters grow when lowered; offsets must not move
        lowered = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    found = [{"kind": k, "start": a, "end": b, "score": _score(k, text, a, b, lowered)} for k in KINDS for a, b in spans[k]]
    return [s for s in found if s["kind"] in BASE_KINDS or s["score"] >= THRESHOLD]


def redact(text: str | None, spans: list[dict]) -> str | None:
    """The text with a tag in place of each stretch that spans cover; the first span names a stretch."""
    if not text or not spans:
        return text
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if s["start"] >= at:
            out += [text[at : s["start"]], f"[{s['kind'].upper()}]"]
        at = max(at, s["end"])
    return "".join(out) + text[at:]


def _scan(texts: pa.Array) -> dict:
    return {"pii": [find(t) for t in texts.to_pylist()]}


def _redact(texts: pa.Array) -> dict:
    return {"redacted": [redact(t, find(t)) for t in texts.to_pylist()]}


def pii_spans(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns and ``pii``, an array of (kind, start, end, score)."""
    return common.map_texts(df, _scan, [StructField("pii", SPANS)], text, keep)


def redacted(df: DataFrame, text: str = "text") -> DataFrame:
    """All columns, with a tag in place of each personal detail in the text (null stays null)."""
    made = common.map_texts(df, _redact, [StructField("redacted", StringType())], text)
    return made.select(*(F.col("redacted").alias(c) if c == text else F.col(f"`{c}`") for c in df.columns))
