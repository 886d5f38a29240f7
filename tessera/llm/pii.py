"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds the anchors: at-signs, a plus before a digit, digit pairs (adjacent, or with one
space or hyphen between), digits around a dot, scheme marks and identifier cue words. At each anchor a parser of its
kind expands to the left and right, validates (octet bounds, Luhn sum, digit counts, IBAN remainder) and moves on past
what it read, so that a text is read a bounded number of times.

Base kinds are email, ip, card and phone, each leftmost and non-overlapping within its kind; url (scheme, then up to
white space or a quote) and account (a cue word, then a number of at least six digits, or a valid IBAN) are added.
Offsets count code points, ends exclusive.

Defined cases: a null or empty text has no spans; texts of any length are read whole; repeated rows give repeated
results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.common import as_documents

#: Fixed kinds, in their order.
BASE = ("email", "ip", "card", "phone")
ADDED = ("url", "account")
ORDER = {kind: k for k, kind in enumerate(BASE + ADDED)}
CUES = ("iban", "account", "acct", "ssn", "passport", "conta", "konto", "compte", "cuenta")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
_DIGITS = "0123456789"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)+")
_PART = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_URL = re.compile(r"[^\s<>\"'`|{}]+")
_ACCOUNT = re.compile(r"(?:[ \t]?(?:number|no\.?|nr\.?|n[ºo°]))?[ \t]{0,3}[:=#]?[ \t]{0,3}([A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{1,4}){2,8}|[0-9](?:[ .-]?[0-9]){5,33})(?![A-Za-z0-9])")


@lru_cache(1)
def anchors() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for a in _DIGITS:
        found.add_word(f"+{a}", ("phone", 2))
        for b in _DIGITS:
            found.add_word(f"{a}.{b}", ("ip", 3))
            for between in ("", " ", "-"):
                found.add_word(f"{a}{between}{b}", ("card", 2 + len(between)))
    found.add_word("@", ("email", 1))
    found.add_word("://", ("url", 3))
    for cue in CUES:
        for form in (cue, cue.upper(), cue.capitalize()):
            found.add_word(form, ("account", len(cue)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if k & 1:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def iban(number: str) -> bool:
    plain = number.replace(" ", "")
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every span, by start, then kind."""
    spans: list[tuple[int, int, str]] = []
    done = dict.fromkeys(ORDER, 0)  # per kind, where its last expansion ended
    for last, (kind, length) in anchors().iter(text):
        at = last - length + 1
        if at < done[kind]:
            continue
        if kind == "email":
            start = at
            while start > done[kind] and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                spans.append((start, m.end(), kind))
                done[kind] = m.end()
        elif kind == "ip":
            start = at
            while start > done[kind] and text[start - 1] in _DIGITS:
                start -= 1
            m = _CHAIN.match(text, start)
            done[kind] = m.end()
            octets = list(_PART.finditer(text, start, m.end()))
            for k in range(0, len(octets) - 3, 4):
                if all(len(o.group().lstrip("0")) <= 3 and int(o.group().lstrip("0") or 0) <= 255 for o in octets[k : k + 4]):
                    spans.append((octets[k].start(), octets[k + 3].end(), kind))
        elif kind == "card":
            m = _CARD.match(text, at)
            done[kind] = m.end()
            if m.end() - at < 40:
                digits = m.group().replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    spans.append((at, m.end(), kind))
        elif kind == "phone":
            if m := _PHONE.match(text, at):
                done[kind] = m.end()
                if 10 <= sum(c in _DIGITS for c in m.group()) <= 15:
                    spans.append((at, m.end(), kind))
        elif kind == "url":
            start = at
            while start > done[kind] and text[start - 1] in _SCHEME:
                start -= 1
            while start < at and not text[start].isalpha():
                start += 1
            if start < at and (m := _URL.match(text, at + 3)):
                end = at + 3 + len(m.group().rstrip(".,;:!?)]"))
                done[kind] = m.end()
                if end > at + 3:
                    spans.append((start, end, kind))
        elif not (at and text[at - 1].isalnum()) and (m := _ACCOUNT.match(text, last + 1)):
            if m.group(1)[0] in _DIGITS or iban(m.group(1)):
                spans.append((m.start(1), m.end(1), kind))
                done[kind] = m.end()
    spans.sort(key=lambda s: (s[0], ORDER[s[2]], s[1]))
    return spans


def listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column("text").to_pylist():
            spans = find(text)
            kinds = [s[2] for s in spans]
            base = listed([s for s in spans if s[2] in BASE])
            rows.append((*map(kinds.count, BASE), hashlib.sha256(base.encode()).hexdigest(), listed(spans)))
        columns = list(zip(*rows, strict=True)) if rows else [()] * 6
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64() if k < 4 else pa.string()) for k, c in enumerate(columns))], ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"])


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and all spans of every document."""
    return as_documents(docs).mapInArrow(_scan, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def mask(text: str) -> str:
    """The text with every span replaced by its kind in angle brackets; overlapping spans become one."""
    out, at = [], 0
    for start, end, kind in find(text):
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])
