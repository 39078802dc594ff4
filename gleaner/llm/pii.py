"""Personal data: patterns propose, checksums confirm, context words adjust the score.

Base kinds (always reported, score 1): email, ip (parts at most 255), card (16 to 19 digits
passing Luhn), phone (international form, 8 to 15 digits). The method adds kinds whose
pattern alone is weak: iban (of its country's length, mod-97), card15 (13 to 15 digits passing Luhn), ssn, local
phone numbers and secrets. A weak candidate starts at its kind's score, gains for each kind of
context word (whole words only) within WINDOW characters around it, and is reported from THRESHOLD on.

Offsets are code points, ends exclusive. Every scan is linear in the text, whatever its
characters. Defined cases: a null text counts as empty and has no spans; null or repeated
doc_ids pass through row by row; an empty table gives no rows; extra columns are ignored by ``find`` and kept by ``mask``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql import functions as F

from .common import keep, small_batches, table

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "card15", "ssn", "local_phone", "secret")
WINDOW, THRESHOLD = 40, 0.6

_local = re.compile(r"[A-Za-z0-9._%+-]+")
_at_domain = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_dotted = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_digits = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_plus = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_iban_head = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=\x20?[A-Z0-9])")
_ssn = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_phone_local = re.compile(r"(?<![\w+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![\w-])")
_secret = re.compile(r"\bAKIA[0-9A-Z]{16}\b|\b(?:ghp|gho|xox[bp]|sk)[-_][A-Za-z0-9-]{16,}|\b(?:password|passwd|secret|token|api_?key)\b\s{0,3}[=:]\s{0,3}[\"']?[^\s\"']{6,}[\"']?")
#: Context words, as whole words.
_CONTEXT = {
    "card15": re.compile(r"\b(?:(?:credit|debit|kredit)?cards?|credit|visa|amex|payments?|(?:kredit)?karten?|tarjetas?|cartes?)\b", re.I),
    "ssn": re.compile(r"\b(?:ssn|social|security|tax|tin)\b", re.I),
    "local_phone": re.compile(r"\b(?:(?:tele)?phones?|tel|telefon\w*|t[ée]l[ée]phone|tel[ée]fono|call|mobile|cell|fax|anruf\w*|llam\w+|appel\w*)\b", re.I),
    "iban": re.compile(r"\b(?:iban|bank|account|konto|cuenta|compte)\b", re.I),
}
#: The length of an IBAN by country.
_IBAN_LENGTH = {
    k: int(n)
    for k, n in re.findall(
        r"([A-Z]{2})([0-9]{2})",
        "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 "
        "GB22 GE22 GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 "
        "MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 "
        "TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30",
    )
}
_START = {"iban": 0.7, "card15": 0.4, "ssn": 0.4, "local_phone": 0.4, "secret": 0.8}
_GAIN = 0.3


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d *= 1 + i % 2
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """Whether the letters-to-numbers form of the rotated account number is 1 modulo 97."""
    s = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """Account numbers of their country's length, in groups or not, whatever words follow."""
    for m in _iban_head.finditer(text):
        left = _IBAN_LENGTH.get(m.group()[:2], 0) - 4
        at = m.end()
        while left > 0 and at < len(text):
            if text[at] == " " and at + 1 < len(text):
                at += 1
            if not (text[at].isascii() and (text[at].isupper() or text[at].isdigit())):
                break
            at, left = at + 1, left - 1
        if left == 0 and not (at < len(text) and text[at].isascii() and text[at].isalnum()) and mod97(text[m.start() : at]):
            yield m.start(), at


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    for m in _at_domain.finditer(text):
        at = m.start()
        start = at
        while start > done and _local.match(text[start - 1]):
            start -= 1
        if start < at:
            yield start, m.end()
            done = m.end()


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _dotted.finditer(text):
        if m.group().count(".") < 3:
            continue
        parts, at = [], m.start()
        for p in m.group().split("."):
            parts.append((at, at + len(p), p))
            at += len(p) + 1
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            if all(len(x := p[2].lstrip("0")) <= 3 and int(x or 0) <= 255 for p in four):
                yield four[0][0], four[3][1]


def _chains(text: str) -> Iterator[tuple[int, int, str]]:
    for m in _digits.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19:
                yield m.start(), m.end(), digits


def _context(kind: str, text: str, start: int, end: int) -> float:
    words = _CONTEXT.get(kind)
    if words is None:
        return 0.0
    return _GAIN * bool(words.search(text, max(0, start - WINDOW), start)) + _GAIN / 2 * bool(words.search(text, end, end + WINDOW))


def spans(text: str | None) -> dict[str, list[tuple[int, int]]]:
    """Spans of each kind, base kinds first, by start."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in (*BASE, *ADDED)}
    if not text:
        return out
    weak: list[tuple[str, int, int]] = []
    if "@" in text:
        out["email"] = list(_emails(text))
    out["ip"] = list(_ips(text))
    for start, end, digits in _chains(text):
        if luhn(digits):
            if len(digits) >= 16:
                out["card"].append((start, end))
            else:
                weak.append(("card15", start, end))
    if "+" in text:
        out["phone"] = [m.span() for m in _plus.finditer(text) if 8 <= sum(map(str.isdigit, m.group())) <= 15]
    weak += [("iban", *x) for x in _ibans(text)]
    weak += [("ssn", *m.span()) for m in _ssn.finditer(text)]
    weak += [("local_phone", *m.span()) for m in _phone_local.finditer(text)]
    weak += [("secret", *m.span()) for m in _secret.finditer(text)]
    base = [s for k in BASE for s in out[k]]
    for kind, start, end in weak:
        if _START[kind] + _context(kind, text, start, end) >= THRESHOLD and not any(a < end and start < b for a, b in base):
            out[kind].append((start, end))
    return out


def written(found: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in found[k])


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def find(docs: DataFrame) -> DataFrame:
    """One row per document with its counts, the digest of its base spans and all spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep("pii", None, dict)  # lets go of what other operators kept
        for b in batches:
            found = [spans(t) for t in b.column(1).to_pylist()]
            cols = [b.column(0), *(pa.array([len(f[k]) for f in found], pa.int64()) for k in BASE)]
            cols.append(pa.array([hashlib.sha256(written(f, BASE).encode()).hexdigest() for f in found], pa.string()))
            cols.append(pa.array([written(f, (*BASE, *ADDED)) for f in found], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def masked(text: str) -> str:
    """The text with every span, overlaps merged, replaced by its kind in angle brackets."""
    found = sorted((a, b, k) for k, v in spans(text).items() for a, b in v)
    out, done, last = [], 0, -1
    for a, b, kind in found:
        if a < last:  # overlaps the span before
            last = max(last, b)
            done = max(done, last)
            continue
        out += [text[done:a], f"<{kind.upper()}>"]
        done = last = b
    return "".join([*out, text[done:]]) if found else text


def mask(docs: DataFrame) -> DataFrame:
    """All documents and columns, texts masked and ``n_chars``, where present, brought up to date."""
    at = docs.columns.index("text")
    chars = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep("pii", None, dict)  # lets go of what other operators kept
        for b in batches:
            texts = b.column(at).to_pylist()
            new = [t if t is None else masked(t) for t in texts]
            cols = b.columns
            cols[at] = pa.array(new, pa.string())
            if chars is not None:
                kept = cols[chars].to_pylist()
                cols[chars] = pa.array([k if a == b_ else len(b_) for k, a, b_ in zip(kept, texts, new)], cols[chars].type)
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names)

    return docs.mapInArrow(run, T.StructType(docs.schema.fields))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return find(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: personal data and secrets are replaced by their kind's name."""
    small_batches(spark)
    return mask(docs)
