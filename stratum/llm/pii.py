"""Personal data: base patterns, and spans that a conditional random field over word shapes adds.

Words that hold a digit or an at sign, and two words on either side, are decoded; every other word is fixed at
O, where the chain falls apart exactly, so decoding those stretches is decoding the whole text. An added span
must also be possible for its kind (digits, Luhn, parts of an address) and overlap no base span.

Cases: a null text is empty; a null id stays; repeated rows each give a row; an empty table gives an empty
result; other columns are not looked at. Only 0 to 9 are digits; bytes that are not UTF-8 count as U+FFFD, one for
each bad sequence.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sound, table
from .crf import LABELLED, Crf, trained
from .spans import PII_KINDS, Span, covered, digest, free, luhn, pii_spans

WINDOW = 2
_ACTIVE = re.compile(r"[0-9@]+")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_GAP = re.compile(r"[\x20\x09-\x0D]")
_DIGITS = re.compile(r"[^0-9]")
_PART = re.compile(r"[0-9]{1,3}")  # str.isdigit() would take superscripts, which int() refuses


def stretches(text: str) -> list[list[tuple[int, int]]]:
    """Words (start, end) around those that hold a digit or an at sign; stretches that touch are one."""
    out: list[list[tuple[int, int]]] = []
    word_end = 0
    for hit in _ACTIVE.finditer(text):
        if hit.start() < word_end:
            continue  # in the word that was just taken
        left, right = _around(text, hit.start(), hit.end())
        word_end = left[-1][1]
        if out and left[0][0] <= out[-1][-1][1]:
            have = out[-1][-1][1]
            out[-1].extend(w for w in left + right if w[0] >= have)
        else:
            out.append(left + right)
    return out


def _around(text: str, a: int, b: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(up to WINDOW words before and the word that holds a to b, up to WINDOW words after it)."""
    start = a
    while start and not _GAP.match(text, start - 1):
        start -= 1
    end = m.start() if (m := _GAP.search(text, b)) else len(text)
    before: list[tuple[int, int]] = []
    at = start
    while at and len(before) < WINDOW:
        while at and _GAP.match(text, at - 1):
            at -= 1
        stop = at
        while at and not _GAP.match(text, at - 1):
            at -= 1
        if stop > at:
            before.insert(0, (at, stop))
    after: list[tuple[int, int]] = []
    at = end
    while len(after) < WINDOW and (m := _WORD.search(text, at)):
        after.append(m.span())
        at = m.end()
    return [*before, (start, end)], after


def _possible(kind: str, found: str) -> bool:
    digits = _DIGITS.sub("", found)
    if kind == "email":
        local, _, host = found.rpartition("@")
        return bool(local and host) and "@" not in local
    if kind == "ip":
        parts = found.split(":")[0].split(".")
        return len(parts) == 4 and all(_PART.fullmatch(p) and int(p) <= 255 for p in parts)
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits) and not re.search(r"[^0-9 .-]", found)
    return 9 <= len(digits) <= 15 and not re.search(r"[^0-9 ().+/-]", found) and bool(re.search(r"[ ().-]", found))


def added_spans(texts: list[str], base: list[list[Span]], crf: Crf) -> list[list[Span]]:
    """What the random field adds to each text."""
    places = [(i, s) for i, t in enumerate(texts) for s in stretches(t)]
    labels = crf.decode([[texts[i][a:b] for a, b in words] for i, words in places])
    taken = [covered(b) for b in base]
    out: list[list[Span]] = [[] for _ in texts]
    for (i, words), path in zip(places, labels, strict=True):
        at = 0
        while at < len(path):
            if not path[at]:
                at += 1
                continue
            kind = (int(path[at]) - 1) // 2
            end = at + 1
            while end < len(path) and path[end] == 2 + 2 * kind:
                end += 1
            span = _trim(texts[i], words[at][0], words[end - 1][1], kind)
            at = end
            if span and _possible(PII_KINDS[kind], texts[i][span[0] : span[2]]) and free(taken[i], span[0], span[2]):
                out[i].append(span)
    return out


def _trim(text: str, a: int, b: int, kind: int) -> Span | None:
    lead = "+(" if kind == 3 else ""
    while a < b and not (text[a].isalnum() or text[a] in lead):
        a += 1
    while b > a and not text[b - 1].isalnum():
        b -= 1
    return (a, kind, b) if a < b else None


def pii_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", labelled: tuple[str, ...] = LABELLED) -> DataFrame:
    """Base counts and digest, and all spans, of every document; see the module for the cases. The labelled table that the
    field is trained on is an argument: sentences with their personal data marked, as in crf.py."""
    crf = trained(labelled)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x.as_py() or "" for x in batch.column(1)]
            base = [pii_spans(t) for t in texts]
            more = added_spans(texts, base, crf)
            counts = [Counter(k for _, k, _ in b) for b in base]
            arrays = [batch.column(0), *(pa.array([c[k] for c in counts], pa.int64()) for k in range(4))]
            arrays.append(pa.array([digest(b, PII_KINDS)[1] for b in base], pa.string()))
            arrays.append(pa.array([digest([*b, *m], PII_KINDS)[0] for b, m in zip(base, more, strict=True)], pa.string()))
            arrays.append(pa.array([len(m) for m in more], pa.int64()))
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), sound(text_col).alias("text"))
    kinds = ["long"] * 5 + ["string"] * 2 + ["long"]
    return rows.mapInArrow(each, ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)))


def op9_pii(spark, sf_dir: str) -> DataFrame:
    return pii_scan(table(spark, sf_dir, "documents"))
