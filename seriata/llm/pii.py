"""Personal data: patterns propose spans, checksums confirm them, context adjusts their score."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, slices

#: The base kinds in the order of the result, then the kinds that the method adds.
BASE = ("email", "ip", "card", "phone")
ADDED = ("iban",)

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only begin where a run of digits does, so the look-behind changes nothing but the time on long runs.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")

#: How likely a confirmed span of a kind is personal data before its context is read.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.9}
#: Words near a span that speak for or against its kind.
FOR = {
    "email": "email e-mail mail contact write correo courriel", "ip": "ip address host server login addr adresse", "card": "card visa mastercard credit payment karte carte tarjeta",
    "phone": "phone tel call mobile fax telefon téléphone teléfono", "iban": "iban account bank konto compte cuenta",
}
AGAINST = {"email": "example noreply", "ip": "version release section chapter", "card": "isbn serial order tracking", "phone": "order version", "iban": "serial"}
WINDOW = 48


def luhn(digits: str) -> bool:
    """Whether the last digit is the check digit of the others."""
    total = sum(map(int, digits[-1::-2])) + sum(int(d) * 2 - 9 * (d > "4") for d in digits[-2::-2])
    return total % 10 == 0


def mod97(code: str) -> bool:
    """Whether a bank account number has the remainder 1 (letters count 10 to 35, the first four characters last)."""
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _digits(x: str) -> str:
    return "".join(c for c in x if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", m.end() if m else at + 1)


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def _is_card(x: str) -> bool:
    d = _digits(x)
    return 16 <= len(d) <= 19 and luhn(d)


def _is_iban(x: str) -> bool:
    code = x.replace(" ", "")
    return 15 <= len(code) <= 34 and mod97(code)


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """Account numbers; of a match that fails, ends at its spaces are tried too, as a word may follow the number."""
    m = _IBAN.search(text)
    while m:
        a, b = m.span()
        ends = [b, *(i for i in range(b - 1, a, -1) if text[i] == " ")]
        end = next((e for e in ends if _is_iban(text[a:e])), None)
        if end:
            yield a, end
        m = _IBAN.search(text, end or a + 1)


_CONFIRMED = {
    "ip": (_IP, lambda x: all(map(_byte, x.split(".")))), "card": (_CARD, _is_card),
    "phone": (_PHONE, lambda x: 8 <= len(_digits(x)) <= 15),
}


def find_spans(text: str) -> list[tuple[str, int, int]]:
    """Confirmed (kind, start, end) spans by kind, then start: code points, end exclusive."""
    found = [("email", a, b) for a, b in _emails(text)]
    for kind in BASE[1:]:
        pattern, confirm = _CONFIRMED[kind]
        found += [(kind, *m.span()) for m in pattern.finditer(text) if confirm(m[0])]
    return found + [("iban", a, b) for a, b in _ibans(text)]


def context_score(text: str, kind: str, start: int, end: int) -> float:
    """The kind's prior, raised or lowered by the words within WINDOW code points."""
    near = set(re.findall(r"[^\W\d_]+(?:-[^\W\d_]+)?", f"{text[max(0, start - WINDOW) : start]} {text[end : end + WINDOW]}".lower()))
    score = PRIOR[kind] + 0.15 * bool(near & set(FOR[kind].split())) - 0.3 * bool(near & set(AGAINST[kind].split()))
    return round(min(1.0, max(0.0, score)), 2)


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, scores array<double>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        columns: list[list] = [[] for _ in range(7)]
        for text in batch.column(1):
            text = text.as_py() or ""
            spans = find_spans(text)
            told = [f"{k}:{a}:{b}" for k, a, b in spans]
            n_base = sum(k in BASE for k, _, _ in spans)  # the base kinds come first
            row = [*(sum(k == kind for k, _, _ in spans) for kind in BASE), hashlib.sha256(",".join(told[:n_base]).encode()).hexdigest(), ",".join(told), [context_score(text, *s) for s in spans]]
            for c, v in zip(columns, row, strict=True):
                c.append(v)
        types = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.list_(pa.float64())]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], [x.split()[0] for x in SCHEMA.split(", ")])


def find_pii(docs: DataFrame) -> DataFrame:
    """A row per row of docs: counts by base kind, a digest of the base spans, all spans and their scores.

    Base spans are the leftmost non-overlapping matches of each kind that its
    check confirms; the method adds bank accounts (mod 97). Null and empty texts
    have none; a null doc_id stays null; repeated rows are each scanned; very
    long texts are read whole, one at a time; without rows there are none in the
    result; other columns do not matter.
    """
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(_scan), SCHEMA)


def redact(text: str, least: float = 0.5) -> str:
    """The text with every span of at least this score replaced by its kind."""
    out, done = [], 0
    for kind, a, b in sorted(find_spans(text), key=lambda s: (s[1], -s[2])):
        if a >= done and context_score(text, kind, a, b) >= least:
            out += [text[done:a], f"<{kind}>"]
            done = b
    return "".join([*out, text[done:]])
