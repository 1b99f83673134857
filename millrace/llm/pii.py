"""Personal data: patterns propose spans, checksums confirm them, nearby words move the score."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Kinds in their order; the first four are the base, always reported when confirmed.
KINDS = ("email", "ip", "card", "phone", "iban", "secret")
#: Words near a span that speak for a kind, and how far to look.
CONTEXT = {
    "iban": ("iban", "bank", "account", "konto", "compte", "cuenta"),
    "phone": ("tel", "phone", "call", "fax", "mobile"),
    "card": ("card", "visa", "mastercard", "credit", "karte", "carte", "tarjeta"),
    "secret": ("password", "passwd", "token", "secret", "api_key", "apikey", "api key", "credential", "bearer"),
}
#: Words near a span that speak against a kind.
AGAINST = {
    "iban": ("isbn", "serial number", "part number", "tracking"),
    "secret": ("checksum", "digest", "sha1", "sha256", "md5", "commit", "uuid"),
}
REACH, THRESHOLD = 40, 0.5

_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SECRET = re.compile(r"(?i)(?:password|passwd|token|secret|api_?key)\s*[=:]\s*[\"']?([A-Za-z0-9_+/-]{12,})")
_TOKEN = re.compile(r"(?<![A-Za-z0-9_+/=.@-])[A-Za-z0-9_-]{16,}+(?![+/=.@][A-Za-z0-9])")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    turned = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of local@domain: found from the sign outward, which reads each character once."""
    last = 0
    for m in _AT.finditer(text):
        start = m.start()
        low = start
        while low > last and (text[low - 1] in "._%+-" or text[low - 1].isascii() and text[low - 1].isalnum()):
            low -= 1
        if low < start:
            last = m.end()
            yield low, last


def _near(text: str, start: int, end: int, kind: str) -> float:
    """0.3 if a word that speaks for the kind is near, less 0.3 if one that speaks against it is."""
    around = text[max(0, start - REACH) : start].lower() + " " + text[end : end + REACH].lower()
    return 0.3 * (any(w in around for w in CONTEXT.get(kind, ())) - any(w in around for w in AGAINST.get(kind, ())))


def find(text: str) -> list[tuple[int, str, int, float]]:
    """(start, kind, end, score) of each confirmed span, by start and then kind. Offsets count code points.

    Base spans pass their own test (parts up to 255, Luhn, number of digits) and score 0.7 at least, so nearby words
    never remove one. The others need a score of THRESHOLD: an IBAN has 0.6 by its checksum, so only words against it
    reject it; a value that is assigned to a secret's name has 0.4 and another run of 16 signs with 4 letters and 4
    digits 0.3, so nearby words decide both.
    """
    found, assigned = [], set()

    def add(kind: str, start: int, end: int, score: float) -> None:
        score = min(1.0, score + _near(text, start, end, kind))
        if score >= THRESHOLD:
            found.append((start, kind, end, score))

    if "@" in text:
        for start, end in _emails(text):
            add("email", start, end, 0.9)
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") or "0" for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p) <= 255 for p in parts):
            add("ip", *m.span(), 0.8)
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                add("card", *m.span(), 0.8)
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                add("phone", *m.span(), 0.7)
    for m in _IBAN.finditer(text):
        if mod97(m[0].replace(" ", "")):
            add("iban", *m.span(), 0.6)
    if "=" in text or ":" in text:
        for m in _SECRET.finditer(text):
            assigned.add(m.start(1))
            add("secret", *m.span(1), 0.4)
    if any(w in text.lower() for w in CONTEXT["secret"]):
        for m in _TOKEN.finditer(text):
            digits, letters = sum(c.isdigit() for c in m[0]), sum(c.isalpha() for c in m[0])
            if digits >= 4 and letters >= 4 and m.start() not in assigned:
                add("secret", *m.span(), 0.3)
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[1]), s[2]))


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            ids, texts = batch.column(0).slice(at, 1024), batch.column(1).slice(at, 1024)
            spans = [[{"kind": k, "start": s, "end": e, "score": x} for s, k, e, x in find(t.as_py() or "")] for t in texts]
            yield pa.RecordBatch.from_arrays([ids, pa.array(spans, pa.list_(span))], names=["doc_id", "spans"])


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id and spans (kind, start, end, score) of every row of docs (doc_id, text; others are ignored).

    Null and empty texts have no spans; a null doc_id stays null; repeated rows give repeated results.
    """
    return docs.select("doc_id", "text").mapInArrow(_found, "doc_id long, spans array<struct<kind:string,start:long,end:long,score:double>>")


def redact(text: str) -> str:
    """The text with each span replaced by its kind in angle brackets; of overlapping spans the first counts."""
    out, at = [], 0
    for start, kind, end, _ in find(text):
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
            at = end
    return "".join([*out, text[at:]])


