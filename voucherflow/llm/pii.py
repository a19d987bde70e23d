"""Personal data: patterns propose spans, checksums confirm them, and context words move the score.

Base kinds are found leftmost and non-overlapping within a kind, and a match that fails its check is dropped without a retry:
email; ip (no part over 255); card (14 to 19 digits that pass Luhn); phone (`+`, 10 to 15 digits). Base spans are always reported. Further kinds:
iban (mod-97), ssn, local_phone (a number without `+`) and card13 (13 digits that pass Luhn). iban stands by its checksum; the others have
a prior score that context words near the span raise or lower, and are reported from `THRESHOLD` up. Spans of different kinds may overlap;
a further kind is not reported where it overlaps a base span.

Patterns run on whole texts. A kind is tried only on texts that hold a character it cannot do without, and the e-mail pattern starts from the
`@` signs, which gives the matches of a left-to-right search at a cost in proportion to the text. Positions are code points, end
exclusive. Null texts count as empty and give no span; null or repeated doc_ids are rows like any other; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voucherflow.llm.common import slices

BASE = ("email", "ip", "card", "phone")
FURTHER = ("iban", "ssn", "local_phone", "card13")
KINDS = BASE + FURTHER
ORDER = {kind: n for n, kind in enumerate(KINDS)}

# Patterns of the base kinds.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")   # a match never starts inside a run of digits
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Patterns of the further kinds.
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
LOCAL_PHONE = re.compile(r"(?<![0-9+.-])(?:\([0-9]{3}\)[ ]?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9-])")

# Prior score of a kind, and the words that move it within WINDOW characters of the span.
PRIOR = {"email": 0.9, "ip": 0.8, "card": 0.95, "phone": 0.8, "iban": 0.95, "ssn": 0.55, "local_phone": 0.5, "card13": 0.4}
WINDOW, STEP, THRESHOLD = 48, 0.2, 0.6
FOR = {
    "email": ("mail", "contact", "write"), "ip": ("ip", "address", "host", "server"), "card": ("card", "visa", "mastercard", "payment"),
    "phone": ("phone", "call", "tel", "mobile", "contact"), "iban": ("iban", "account", "bank"), "ssn": ("ssn", "social", "security"),
    "local_phone": ("phone", "call", "tel", "mobile", "fax"), "card13": ("card", "visa", "mastercard", "payment"),
}
AGAINST = {
    "email": ("example",), "ip": ("version", "release", "section"), "card": ("order", "tracking", "isbn", "serial"), "phone": ("order", "isbn"), "iban": ("serial", "sku"),
    "ssn": ("part", "order", "sku", "serial"), "local_phone": ("order", "isbn", "part", "serial", "ticket"), "card13": ("isbn", "ean", "barcode", "order", "serial"),
}
_WORD = re.compile(r"[a-z]+")


def digits_of(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def luhn(digits: str) -> bool:
    total = 0
    for n, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if n % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """ISO 7064 check of an IBAN without spaces."""
    return 15 <= len(iban) <= 34 and int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _octets(text: str) -> bool:
    values = [p.lstrip("0") for p in text.split(".")]
    return all(len(v) <= 3 and int(v or 0) <= 255 for v in values)


_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def emails(text: str):
    """Matches of EMAIL in left-to-right order: every match holds an `@` that its local part runs up to."""
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        found = EMAIL.match(text, start) if start < at else None
        if found:
            free = found.end()
            yield found.start(), found.end()
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = []
    if "@" in text:
        out += [(a, b, "email") for a, b in emails(text)]
    if _DIGIT.search(text):
        out += [(m.start(), m.end(), "ip") for m in IP.finditer(text) if _octets(m[0])]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = digits_of(m[0])
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), m.end(), "card"))
        if "+" in text:
            out += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 10 <= len(digits_of(m[0])) <= 15]
    out.sort(key=lambda s: (s[0], ORDER[s[2]]))
    return out


_DIGIT = re.compile("[0-9]")


def ibans(text: str):
    """Spans that pass mod-97, left to right, each as long as it can be; a match that fails is tried again up to each of its spaces, as it may hold words that follow."""
    m = IBAN.search(text)
    while m:
        ends = [m.end(), *(k for k in range(m.end() - 1, m.start(), -1) if text[k] == " ")]
        end = next((e for e in ends if IBAN.fullmatch(text, m.start(), e) and mod97(text[m.start():e].replace(" ", ""))), None)
        if end:
            yield m.start(), end
        m = IBAN.search(text, end or m.start() + 1)


def _merged(spans: list[tuple[int, int, str]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches that the spans cover, in order and apart."""
    starts, ends = [], []
    for a, b, _ in sorted(spans):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a), ends.append(b)
    return starts, ends


def further_spans(text: str, taken: list[tuple[int, int, str]]) -> list[tuple[int, int, str, float]]:
    if not _DIGIT.search(text):
        return []
    found = [(a, b, "iban") for a, b in ibans(text)]
    if "-" in text:
        found += [(m.start(), m.end(), "ssn") for m in SSN.finditer(text)]
    found += [(m.start(), m.end(), "local_phone") for m in LOCAL_PHONE.finditer(text)]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = digits_of(m[0])
            if len(digits) == 13 and luhn(digits):
                found.append((m.start(), m.end(), "card13"))
    starts, ends = _merged(taken)
    out = []
    for a, b, kind in found:
        at = bisect_right(ends, a)      # the first taken stretch that ends after this span starts
        if at < len(starts) and starts[at] < b:
            continue
        score = context_score(text, a, b, kind)
        if score >= THRESHOLD:
            out.append((a, b, kind, score))
    return out


def context_score(text: str, start: int, end: int, kind: str) -> float:
    """The kind's prior, one step up or down for words near the span; never over 1 or under 0."""
    near = set(_WORD.findall(text[max(0, start - WINDOW):start].lower() + " " + text[end:end + WINDOW].lower()))
    score = PRIOR[kind] + STEP * bool(near & set(FOR[kind])) - STEP * bool(near & set(AGAINST[kind]))
    return round(min(1.0, max(0.0, score)), 3)


def scan(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str, float]]]:
    """Base spans, and all spans with scores; both by start, then kind as listed."""
    base = base_spans(text)
    every = [(a, b, k, context_score(text, a, b, k)) for a, b, k in base] + further_spans(text, base)
    every.sort(key=lambda s: (s[0], ORDER[s[2]], s[1]))
    return base, every


SPANS = "doc_id long, base array<struct<start:int,end:int,kind:string>>, spans array<struct<start:int,end:int,kind:string,score:double>>"


def find(docs: DataFrame) -> DataFrame:
    """One row for each document: its base spans, and all spans with their scores."""
    base_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("score", pa.float64())]))

    def run(batches):
        for piece in slices(batches, "text"):
            base, spans = [], []
            for text in piece.column("text").to_pylist():
                b, s = scan(text or "")
                base.append([{"start": x, "end": y, "kind": k} for x, y, k in b])
                spans.append([{"start": x, "end": y, "kind": k, "score": v} for x, y, k, v in s])
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(base, base_type), pa.array(spans, span_type)], ["doc_id", "base", "spans"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SPANS)


def joined(column: str):
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in BASE]
    scores = F.array_join(F.transform("spans", lambda s: s["score"].cast("string")), ",")
    return found.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"), scores.alias("scores"))


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first and longest counts."""
    out, at = [], 0
    for a, b, kind in sorted((s[:3] for s in spans), key=lambda s: (s[0], -s[1])):
        if a >= at:
            out += (text[at:a], f"[{kind}]")
            at = b
    return "".join([*out, text[at:]])
