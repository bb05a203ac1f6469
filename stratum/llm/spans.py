"""Spans of text found by patterns: the base kinds of secrets and personal data, and how spans are written down.

A span is (start, kind number, end) in code points, end exclusive. A text's spans are written as
``kind:start:end`` by start, then kind in its listed order, joined by commas.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left

Span = tuple[int, int, int]

# The base patterns of secrets.
SECRET_KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ASSIGN_HINT = re.compile(r"password|passwd|secret|token|api_?key", re.ASCII | re.IGNORECASE)
ASSIGN_LEAST = 8
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")  # a run is taken whole, so its length can stand in the pattern
HEX = re.compile(r"[0-9a-f]{32,}")

# The base patterns of personal data. (A look-behind spares tries inside a run of digits, none of which can match.)
PII_KINDS = ("email", "ip", "card", "phone")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digest(spans: list[Span], kinds: tuple[str, ...]) -> tuple[str, str]:
    """(the spans written down, SHA-256 of that in lower-case hex)."""
    text = ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in sorted(spans))
    return text, hashlib.sha256(text.encode()).hexdigest()


def covered(spans: list[Span]) -> list[tuple[int, int]]:
    """The stretches that spans cover, in order, none reaching into another."""
    out: list[tuple[int, int]] = []
    for a, _, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def free(taken: list[tuple[int, int]], a: int, b: int) -> bool:
    """Whether a to b overlaps none of the covered stretches: the last one that begins before b reaches farthest."""
    at = bisect_left(taken, (b,))
    return not at or taken[at - 1][1] <= a


def secret_spans(text: str) -> list[Span]:
    """Base spans of secrets; a match that fails its condition is dropped and its characters are not searched again."""
    out = [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if ASSIGN_HINT.search(text):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    return sorted(out)


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _emails(text: str) -> list[Span]:
    """As EMAIL.finditer, but tried only around an at sign, so that long runs of its characters cost nothing."""
    out, at, done = [], text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = EMAIL.match(text, start) if start < at else None
        if m:
            out.append((start, 0, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_NOT_DIGIT = re.compile(r"[^0-9]")
_ANY_DIGIT = re.compile(r"[0-9]")


def pii_spans(text: str) -> list[Span]:
    """Base spans of personal data; a match that fails its condition is dropped and not tried again."""
    out = _emails(text) if "@" in text else []
    if not _ANY_DIGIT.search(text):
        return sorted(out)
    for m in IP.finditer(text):
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)
