"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, scheme separators, plus signs, digits and identifier cues. From each
anchor a deterministic parser grows left and right to the boundary its format sets and then validates what it found. No
parser looks at text twice for its kind: it starts at or after the end of its last match.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

#: The kinds, in the order in which spans with one start are listed; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "account", "ssn", "url")
SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_other long"

_DIGITS = frozenset("0123456789")
_UPPER = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_ALNUM = _DIGITS | _UPPER | frozenset("abcdefghijklmnopqrstuvwxyz")
_LABEL, _LOCAL = _ALNUM | {"-"}, _ALNUM | frozenset("._%+-")
_PHONE = _DIGITS | frozenset(" ().-")
_ACCOUNT_CUES, _SSN_CUES = ("IBAN", "Iban", "iban"), ("SSN", "ssn", "Social Security", "social security")

Span = tuple[int, int]


def _run(text: str, at: int, allowed: frozenset[str]) -> int:
    while at < len(text) and text[at] in allowed:
        at += 1
    return at


def _email(text: str, at: int, floor: int) -> tuple[Span | None, int]:
    """at: the at-sign. The local part is every allowed character before it back to floor; the domain needs two labels."""
    start = at
    while start > floor and text[start - 1] in _LOCAL:
        start -= 1
    end = _run(text, at + 1, _LABEL)
    if start == at or end == at + 1:
        return None, floor
    last = end
    while last < len(text) and text[last] == "." and (nxt := _run(text, last + 1, _LABEL)) > last + 1:
        last = nxt
    return ((start, last), last) if last > end else (None, floor)


def _ip(text: str, at: int, floor: int) -> tuple[Span | None, int]:
    """at: a digit; a match begins where its run of digits (after floor) begins."""
    if at > floor and text[at - 1] in _DIGITS:
        return None, floor
    end, parts = _run(text, at, _DIGITS), []
    parts.append(text[at:end])
    while len(parts) < 4:
        if end >= len(text) or text[end] != "." or (nxt := _run(text, end + 1, _DIGITS)) == end + 1:
            return None, floor
        parts.append(text[end + 1 : nxt])
        end = nxt
    fine = all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in parts)
    return (at, end) if fine else None, end


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = ord(d) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _card(text: str, at: int, floor: int) -> tuple[Span | None, int]:
    """at: the first digit not yet used."""
    end, n = at + 1, len(text)
    while end < n:
        if text[end] in _DIGITS:
            end += 1
        elif text[end] in " -" and end + 1 < n and text[end + 1] in _DIGITS:
            end += 2
        else:
            break
    if end == at + 1:
        return None, floor
    digits = text[at:end].replace(" ", "").replace("-", "")
    return (at, end) if 14 <= len(digits) <= 19 and luhn(digits) else None, end


def _phone(text: str, at: int, floor: int) -> tuple[Span | None, int]:
    """at: a plus sign."""
    if at + 1 >= len(text) or text[at + 1] not in _DIGITS:
        return None, floor
    end = _run(text, at + 2, _PHONE)
    while end > at + 3 and text[end - 1] not in _DIGITS:
        end -= 1
    if end <= at + 3:
        return None, floor
    return (at, end) if 10 <= sum(c in _DIGITS for c in text[at:end]) <= 15 else None, end


def _account(text: str, at: int, floor: int) -> tuple[Span | None, int]:
    """at: the end of a cue. An international account number: country, check digits, groups; validated modulo 97."""
    start = _run(text, at, frozenset(" :=#."))
    if start == at or start - at > 8:
        return None, floor
    end, body = start, ""
    while end < len(text) and len(body) < 34:
        if text[end] in _ALNUM:
            body += text[end].upper()
            end += 1
        elif text[end] == " " and body and end + 1 < len(text) and (text[end + 1] in _DIGITS or text[end + 1] in _UPPER):
            end += 1
        else:
            break
    if len(body) < 15 or not (body[:2].isalpha() and body[2:4].isdigit()):
        return None, floor
    fine = int("".join(str(int(c, 36)) for c in body[4:] + body[:4])) % 97 == 1
    return ((start, end), end) if fine else (None, floor)


def _ssn(text: str, at: int, floor: int) -> tuple[Span | None, int]:
    """at: the end of a cue. Three, two and four digits; area 000, 666 and 9xx, group 00 and serial 0000 are never issued."""
    start = _run(text, at, frozenset(" :=#."))
    part = text[start : start + 11]
    if start == at or start - at > 8 or len(part) < 11 or part[3] + part[6] != "--" or not all(c in _DIGITS for c in part[:3] + part[4:6] + part[7:]):
        return None, floor
    if text[start + 11 : start + 12] in _DIGITS or part[:3] in ("000", "666") or part[0] == "9" or part[4:6] == "00" or part[7:] == "0000":
        return None, floor
    return (start, start + 11), start + 11


_URL_END = frozenset(" \t\n\r\x0b\x0c\"'<>`|()[]{}")


def _url(text: str, at: int, floor: int) -> tuple[Span | None, int]:
    """at: the colon of a scheme separator. Reported only with credentials: user:password@host."""
    start = at
    while start > floor and text[start - 1] in _ALNUM:
        start -= 1
    end = at + 3
    while end < len(text) and text[end] not in _URL_END:
        end += 1
    user, sign, host = text[at + 3 : end].partition("/")[0].rpartition("@")
    if start == at or not sign or not host or ":" not in user:
        return None, floor
    return (start, end), end


def _anchors() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    table: dict[str, tuple[tuple[int, Callable, int], ...]] = {"@": ((0, _email, 0),), "://": ((6, _url, -2),), "+": ((3, _phone, 0),)}
    table |= {d: ((1, _ip, 0), (2, _card, 0)) for d in "0123456789"}
    table |= {c: ((4, _account, 1),) for c in _ACCOUNT_CUES} | {c: ((5, _ssn, 1),) for c in _SSN_CUES}
    for cue, parsers in table.items():
        found.add_word(cue, parsers)
    found.make_automaton()
    return found


def find(text: str, anchors: ahocorasick.Automaton) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of everything found, sorted."""
    floor = [0] * len(KINDS)
    out = []
    for end, parsers in anchors.iter(text):
        for kind, parse, shift in parsers:
            at = end + shift
            if at >= floor[kind]:
                span, floor[kind] = parse(text, at, floor[kind])
                if span:
                    out.append((span[0], kind, span[1]))
    out.sort()
    return out


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: counts of the base kinds, a digest of their spans, all spans as kind:start:end in code points.

    Kinds beyond the base four (account, ssn, url) are what cues and schemes add. A null or empty text has no spans;
    repeated rows stay repeated; a null doc_id stays null; other columns are ignored. Rows are independent of each other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = _anchors()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = []
                for text in part.column(1).to_pylist():
                    found = find(text, anchors) if text else []
                    base = [x for x in found if x[1] < 4]
                    write = lambda spans: ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)
                    rows.append((*(sum(k == kind for _, k, _ in base) for kind in range(4)), hashlib.sha256(write(base).encode()).hexdigest(), write(found), len(found) - len(base)))
                types = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64()]
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(list(c), t) for c, t in zip(columns, types, strict=True))], [x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, SCHEMA)
