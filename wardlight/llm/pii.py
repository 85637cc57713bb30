"""Personal data in texts: patterns propose spans, checksums confirm them, nearby words move their score."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from wardlight.llm.common import documents, each_batch

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "short_card", "ssn", "local_phone")
KINDS = BASE + ADDED

#: Score of a proposal by kind: (without, with) a word of its kind nearby. A span counts from REPORTED up.
SCORES = {"email": (1.0, 1.0), "ip": (1.0, 1.0), "card": (1.0, 1.0), "phone": (1.0, 1.0),
          "iban": (0.9, 1.0), "short_card": (0.4, 0.8), "ssn": (0.3, 0.8), "local_phone": (0.3, 0.7)}
REPORTED = 0.5
#: How far before and after a proposal a context word may stand, in characters.
NEARBY = 40
CONTEXT = {
    "iban": re.compile(r"(?i)\b(?:iban|account|konto|cuenta|compte)\b"),
    "short_card": re.compile(r"(?i)\b(?:card|visa|amex|credit|debit|karte|tarjeta|carte)\b"),
    "ssn": re.compile(r"(?i)\b(?:ssn|social security|taxpayer|tax id)\b"),
    "local_phone": re.compile(r"(?i)\b(?:phone|tel|telephone|call|mobile|fax|telefon|tel[ée]fono|t[ée]l[ée]phone)\b"),
}

# A number starts where no digit stands before it and takes all it can (possessive), so a search is linear in the text.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9]){15,}+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SHORT_CARD = re.compile(r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,14}(?![ -]?[0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+().-])(?<![0-9+] )\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![ .-]?[0-9])")
_SIXTEEN = re.compile(r"[0-9](?:[ -]?[0-9]){12}")
_DOUBLED = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)


def digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(number: str) -> bool:
    values = [ord(c) - 48 for c in reversed(number)]
    return (sum(values[::2]) + sum(_DOUBLED[v] for v in values[1::2])) % 10 == 0


def mod97(account: str) -> bool:
    """The check of international account numbers: letters as 10 to 35, the first four characters last."""
    moved = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses, found from their @ signs: what stands before one is taken back to the last find."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        done = found.end() if found else at + 1
        if found:
            yield start, done
        at = text.find("@", done)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """email, ip, card and phone spans, by kind and start."""
    spans = [("email", *s) for s in emails(text)] if "@" in text else []
    if "." in text:
        spans += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    if _SIXTEEN.search(text):
        spans += [("card", *m.span()) for m in _CARD.finditer(text) if 16 <= len(d := digits(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        spans += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(digits(m[0])) <= 15]
    return spans


def _proposals(text: str) -> Iterator[tuple[str, int, int]]:
    for m in _IBAN.finditer(text):
        account = m[0].replace(" ", "")
        if 15 <= len(account) <= 34 and mod97(account):
            yield "iban", *m.span()
    if _SIXTEEN.search(text):
        yield from (("short_card", *m.span()) for m in _SHORT_CARD.finditer(text) if luhn(digits(m[0])))
    if "-" in text:
        yield from (("ssn", *m.span()) for m in _SSN.finditer(text) if m[0][:3] not in ("000", "666") and m[0][0] != "9" and m[0][4:6] != "00" and m[0][7:] != "0000")
    yield from (("local_phone", *m.span()) for m in _LOCAL_PHONE.finditer(text) if 8 <= len(digits(m[0])) <= 12)


def added_spans(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Confirmed spans of further kinds whose score is high enough and that touch no span found before them."""
    held, out = sorted((s, e) for _, s, e in taken), []
    for kind, start, end in _proposals(text):
        low, high = SCORES[kind]
        near = low < REPORTED and CONTEXT[kind].search(text[max(0, start - NEARBY) : start] + "\n" + text[end : end + NEARBY])
        i = bisect_left(held, (end, -1))
        if (low >= REPORTED or near and high >= REPORTED) and not any(s < end and e > start for s, e in held[max(0, i - 3) : i]):
            held.insert(i, (start, end))
            held.sort()
            out.append((kind, start, end))
    return out


def find(text: str) -> list[tuple[str, int, int]]:
    """All spans, by kind as listed in KINDS, then start; code points, end exclusive."""
    base = base_spans(text)
    order = {k: i for i, k in enumerate(KINDS)}
    return base + sorted(added_spans(text, base), key=lambda s: (order[s[0]], s[1]))


def _finder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        found = [[{"kind": k, "start": s, "end": e} for k, s, e in find(t)] for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, kind)], names=["doc_id", "spans"])


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id and spans (kind, start, end) of every document.

    The four base kinds are reported as soon as their own test holds (parts of an address up to 255, Luhn, number of
    digits). Further kinds are account numbers that pass mod-97, 13 to 15 digit cards that pass Luhn, social security
    numbers and phone numbers without a country code; the last three need one of their words nearby.

    Null or empty text: no spans. A null doc_id stays null. Repeated rows give repeated rows. An empty table gives no
    rows. Whole texts are searched, in time linear in their length. Other columns are not read.
    """
    return each_batch(documents(docs), "doc_id long, spans array<struct<kind:string,start:long,end:long>>", _finder)


def _hider(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for text in batch.column("text").to_pylist():
            for kind, start, end in sorted(find(text), key=lambda s: -s[1]):
                text = f"{text[:start]}<{kind}>{text[end:]}"
            texts.append(text)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])


def hide_personal_data(docs: DataFrame) -> DataFrame:
    """The texts with every span replaced by its kind in angle brackets (spans of base kinds that overlap: the later first)."""
    return each_batch(documents(docs), "doc_id long, text string", _hider)
