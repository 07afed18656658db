"""Personal data: expressions propose spans, checksums confirm them, context words adjust a score.

The base kinds (email, ip, card, phone) are exact: every proposal that passes its check is
kept, whatever its score.  The further kinds (IBAN by mod-97, identity numbers by context)
are kept where the score reaches a threshold.  Offsets are code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")
# A further kind needs this score; a context word within CONTEXT characters before a span adds NEAR.
THRESHOLD, CONTEXT, NEAR = 0.7, 48, 0.4

# What a kind scores by itself once its check holds, and words that speak for it.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.4}
WORDS = {
    "email": ("mail", "email", "contact", "correo", "courriel"),
    "ip": ("ip", "host", "server", "address", "client"),
    "card": ("card", "credit", "visa", "karte", "carte", "tarjeta"),
    "phone": ("phone", "call", "tel", "mobile", "telefon", "fax"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social", "security"),
}
# Lengths of an IBAN by country, as registered.
IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28, "CH": 21,
    "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DJ": 27, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FK": 18, "FO": 18,
    "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HN": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23,
    "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27,
    "MD": 24, "ME": 22, "MK": 19, "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28, "NL": 18, "NO": 15, "OM": 23, "PK": 24, "PL": 28,
    "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27,
    "SO": 23, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20, "YE": 30,
}

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# No match can begin inside a run of digits (the run's first digit would match too), so runs are tried once.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
# A start, and per country the rest of its length with single blanks between; what follows a blank is not looked at.
_IBAN = re.compile(r"(?<![A-Za-z0-9])(?:%s)(?![A-Za-z0-9])" % "|".join(f"{cc}[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for cc, n in IBAN_LENGTH.items()))
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    if len(iban) != IBAN_LENGTH.get(iban[:2], -1):
        return False
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """The leftmost match around an @ begins where its run of local characters begins, or where the last match ended."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            free = m.end()
        else:
            free = max(free, at + 1)  # local parts do not reach over an @
        at = text.find("@", at + 1)


def ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255 for part in m.group().split(".")):
            yield m.span()


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
            yield m.span()


def ibans(text: str) -> Iterator[tuple[int, int]]:
    at = 0
    while m := _IBAN.search(text, at):
        holds = mod97(m.group().replace(" ", ""))
        if holds:
            yield m.span()
        at = m.end() if holds else m.start() + 1  # a wrong one hides nothing that begins inside it


def ssns(text: str) -> Iterator[tuple[int, int]]:
    for m in _SSN.finditer(text):
        area, group, serial = m.group().split("-")
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            yield m.span()


_FINDERS = {"email": emails, "ip": ips, "card": cards, "phone": phones, "iban": ibans, "ssn": ssns}


def score(kind: str, text: str, start: int) -> float:
    near = re.findall(r"[^\W\d_]+", text[max(0, start - CONTEXT):start].lower())
    return min(1.0, PRIOR[kind] + NEAR * any(w in WORDS[kind] for w in near))


def find(text: str) -> list[tuple[str, int, int, float]]:
    """All kept spans (kind, start, end, score), by kind as in KINDS, then start."""
    found = []
    for kind in KINDS:
        for start, end in _FINDERS[kind](text):
            s = score(kind, text, start)
            if kind in BASE or s >= THRESHOLD:
                found.append((kind, start, end, s))
    return found


def redact(text: str, spans: list[tuple[str, int, int, float]]) -> str:
    """The text with each span replaced by its kind in angle brackets; of overlapping spans the earliest (then longest) names the whole stretch."""
    out, at, reach = [], 0, 0
    for kind, start, end, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= reach:
            out += [text[at:start] if start > at else "", f"<{kind}>"]
        reach = at = max(reach, end)
    return "".join([*out, text[at:]])


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
_SPANS = "array<struct<kind:string,start:bigint,end:bigint,score:double>>"


def _scan(texts: pa.Array) -> list[pa.Array]:
    spans, clean = [], []
    for text in texts.to_pylist():
        found = find(text or "")
        spans.append([dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in found])
        clean.append(redact(text, found) if found else text)
    return [pa.array(spans, pa.list_(_SPAN)), pa.array(clean, pa.string())]


def personal_data(docs: DataFrame, text_col: str = "text", spans_col: str = "pii_spans", redacted_col: str = "redacted") -> DataFrame:
    """``docs`` with the spans of every text (kind, start, end, score) and the redacted text.

    A null text has no spans and stays null; an empty one stays empty.  Whole texts are
    searched, in time linear in their length.  Rows are handled one by one, so repeated
    rows, null ids and other columns pass through; an empty table gives an empty result.
    Columns named like the two outputs are replaced.
    """
    return tx.mapped(docs, text_col, _scan, {spans_col: _SPANS, redacted_col: "string"})


def _digest(batch: pa.RecordBatch) -> pa.RecordBatch:
    counts: dict[str, list[int]] = {k: [] for k in BASE}
    sha, every = [], []
    for spans in batch.column("spans").to_pylist():
        names = [f"{s['kind']}:{s['start']}:{s['end']}" for s in spans]
        base = [n for n, s in zip(names, spans, strict=True) if s["kind"] in BASE]
        for k in BASE:
            counts[k].append(sum(s["kind"] == k for s in spans))
        sha.append(hashlib.sha256(",".join(base).encode()).hexdigest())
        every.append(",".join(names))
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(counts[k], pa.int64()) for k in BASE), pa.array(sha, pa.string()), pa.array(every, pa.string())],
                                      ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"])


def digests(found: DataFrame, id_col: str = "doc_id", spans_col: str = "pii_spans") -> DataFrame:
    """Per row the counts of the base kinds, the digest of their spans, and all spans as text."""
    slim = found.select(F.col(id_col).cast("long").alias("doc_id"), F.col(spans_col).alias("spans"))
    return slim.mapInArrow(tx.by_slices(_digest), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
