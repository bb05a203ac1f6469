"""Benchmark decontamination by template windows.

Texts are canonicalised: numbers, names and units after a number become typed placeholders, other words lose case and edge
punctuation. Words of a name, or of a number, that stand in a row are one placeholder, so that a value may be replaced by one of another
length. A capital inside a sentence makes a name; whether one that begins a sentence does can't be known, so texts have two template
forms, with these as plain words and as names, and a third form without placeholders in which all words count as they are.
Windows of a few canonical words are hash-joined with those of the benchmark, form by form; matches of one item at like shifts (within
BAND words) between document and item make an alignment. An alignment counts if

* windows without placeholders alone hold enough of the item, which is then there word for word, or
* all windows together hold enough of it and its slots are consistent, that is, what stands in a slot of the item is
  replaced by one and the same value wherever it recurs.

So are questions with other numbers or names found, while texts that only share a skeleton are left alone. Windows of an item
should hold PLAIN plain words; an item with few such windows, like a sum in words, has to match in all its windows, and is looked for
by its words alone if it has under LEAST plain words.

The hashes of the benchmark's windows go to every task only up to SENT; a larger benchmark is joined by a
shuffle on the hash.

Cases: a null text has no windows and is not contaminated; a null id stays; repeated rows each give a row; items
that are null or have under LEAST words match nothing; an item shorter than a window is matched whole; an
empty table or benchmark gives no matches; other columns are not looked at, but kept by remove_contaminated() whatever their names; bytes that are not UTF-8 count as U+FFFD.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, free_names, sound, table

WINDOW = 8
#: Plain words that a window must hold, so that runs of placeholders match nothing.
PLAIN = 5
#: Windows of one alignment that are enough (with WINDOW 8, a run of 13 words), or all that the item has.
ENOUGH = 6
#: Words of an item, and plain words of a template, at least.
LEAST = 3
#: Shifts that differ by up to half of this make one alignment.
BAND = 16
#: Window hashes of the benchmark that may be sent to every task: 16 MB.
SENT = 2_000_000

# Units of measure.
UNITS = frozenset(
    "mm cm m km in ft yd mi mile miles inch inches foot feet meter meters metre metres kilometer kilometers kilometre kilometres "
    "mg g kg t lb lbs oz gram grams kilogram kilograms ton tons pound pounds ounce ounces ml cl l liter liters litre litres gallon gallons "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "percent dollar dollars euro euros cent cents usd eur degrees celsius fahrenheit mph kmh volts watts amps".split()
)
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_NUMBER = re.compile(r"[0-9][0-9.,:/]*(?:st|nd|rd|th|%)?")
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_NUM, _NAME, _UNIT = (np.uint64(xxhash.xxh64_intdigest(x, 3)) for x in ("<number>", "<name>", "<unit>"))


class Words(dict):
    """word -> its canonical hash, with what kind of word it is in the lowest five bits; filled as words are met."""

    NUMBER, CAPITAL, UNIT, END, EMPTY = 1, 2, 4, 8, 16
    KINDS = 31

    def __missing__(self, word: str) -> int:
        bare = word if word.isalpha() else word[:-1] if word[:-1].isalpha() and not word[-1:].isalnum() else _EDGE.sub("", word)
        low = bare.lower()
        kind = self.CAPITAL * bare[:1].isupper() | self.UNIT * (low in UNITS) | self.END * (word[-1:] in ".!?:;|") | self.EMPTY * (not bare)
        if low[:1].isdigit() and _NUMBER.fullmatch(low):
            kind |= self.NUMBER
        out = xxhash.xxh64_intdigest(low.encode("utf-8", "surrogatepass"), 3) & ~self.KINDS | kind
        if len(word) <= 64:
            self[word] = out
        return out


@dataclass
class Form:
    """Canonical words: their hashes, which are slots, which hold a sentence's first word with a capital, and the first word of each in the text."""

    h: np.ndarray
    slot: np.ndarray | None
    first: np.ndarray | None
    start: np.ndarray


def canonical(text: str, words: Words) -> tuple[list[str], list[Form]]:
    """(words of the text, its forms: the words themselves, templates with sentences' first words as they are, and as names)."""
    raw = text.split()
    h = np.fromiter(map(words.__getitem__, raw), np.uint64, len(raw))
    flags = h & np.uint64(Words.KINDS)
    h ^= flags
    ended = np.empty(len(h), bool)
    ended[:1] = True
    ended[1:] = (flags[:-1] & np.uint64(Words.END)) > 0
    empty = (flags & np.uint64(Words.EMPTY)) > 0
    if empty.any():
        h, flags, ended = h[~empty], flags[~empty], ended[~empty]
        raw = [w for w, e in zip(raw, empty.tolist(), strict=True) if not e]
    out = [Form(h, None, None, np.arange(len(h)))]
    number = (flags & np.uint64(Words.NUMBER)) > 0
    capital = ((flags & np.uint64(Words.CAPITAL)) > 0) & ~number
    unit = (flags & np.uint64(Words.UNIT)) > 0
    unit[1:] &= number[:-1]
    unit[:1] = False
    for name in (capital & ~ended, capital):
        kind = number + 2 * (name & ~unit) + 3 * unit
        if kind.any():
            keep = np.ones(len(h), bool)
            keep[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 0) | (kind[1:] == 3)
            start = np.nonzero(keep)[0]
            first = np.add.reduceat((ended & name).astype(np.int64), start) > 0
            out.append(Form(np.choose(kind, [h, _NUM, _NAME, _UNIT])[keep], kind[keep] > 0, first, start))
    return raw, out


def windows(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all windows of that width."""
    n = len(h) - width + 1
    if n <= 0 or not width:
        return np.empty(0, np.uint64)
    out = h[:n].copy()
    for j in range(1, width):
        out *= _PRIME
        out += h[j : j + n]
    out ^= np.uint64(width)
    out ^= out >> np.uint64(32)
    return out


def _held(flags: np.ndarray, width: int) -> np.ndarray:
    """How many flags each window holds."""
    total = np.r_[0, np.cumsum(flags)]
    return total[width:] - total[: len(total) - width]


def _coarse(wanted: np.ndarray) -> np.ndarray:
    """Which low bits of hashes stand in the array; six bits more than it takes to number them."""
    out = np.zeros(1 << min(24, max(16, len(wanted).bit_length() + 6)), bool)
    out[(wanted & np.uint64(len(out) - 1)).view(np.int64)] = True
    return out


def _member(wanted: np.ndarray, coarse: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Positions of the hashes that stand in the sorted array; coarse tells by some bits which may."""
    maybe = np.nonzero(coarse[(hashes & np.uint64(len(coarse) - 1)).view(np.int64)])[0]
    place = np.minimum(np.searchsorted(wanted, hashes[maybe]), len(wanted) - 1)
    return maybe[wanted[place] == hashes[maybe]]


def _slots(form: Form, raw: list[str], at: int, width: int) -> list[str]:
    """What stands in the slots of a window."""
    out = []
    for i in range(at, at + width):
        if form.slot[i]:
            stop = form.start[i + 1] if i + 1 < len(form.start) else len(raw)
            out.append(" ".join(_EDGE.sub("", w) for w in raw[form.start[i] : stop]))
    return out


def _chosen(forms: list[Form], k: int, width: int, at: np.ndarray) -> np.ndarray:
    """Of the windows at these places those that no other form has: with a slot, and in the last form with a sentence's first word."""
    form = forms[k]
    if form.slot is None or not len(at):
        return at
    at = at[_held(form.slot, width)[at] > 0]
    return at[_held(form.first, width)[at] > 0] if k == 2 else at


def _forms(text: str, words: Words) -> tuple[list[str], list[Form]]:
    """canonical() with the forms at fixed places: the third is there only if it differs from the second."""
    raw, forms = canonical(text, words)
    if len(forms) == 2 and forms[1].first.any():  # only sentences' first words are slots
        forms.insert(1, Form(np.empty(0, np.uint64), np.empty(0, bool), np.empty(0, bool), np.empty(0, np.int64)))
    return raw, forms


def item_windows(text: str, words: Words) -> list[tuple]:
    """(hash, at, plain, slots, need_plain, need, width) of an item; need is null if its templates tell too little."""
    raw, forms = _forms(text, words)
    if len(raw) < LEAST:
        return []
    width = min(WINDOW, len(raw))
    hashes = windows(forms[0].h, width)
    need_plain = min(ENOUGH, len(hashes))
    out, need = [], None
    for k in range(1, len(forms)):
        form = forms[k]
        w = min(WINDOW, len(form.h))
        if (~form.slot).sum() < LEAST:
            continue
        plain = _held(~form.slot, w)
        at = np.nonzero(plain >= min(PLAIN, w))[0]
        mine = ENOUGH
        if len(at) < min(ENOUGH, len(plain)) or w < PLAIN:
            at, mine = np.arange(len(plain)), len(plain)
        need = min(need or len(plain), mine, len(plain))
        h = windows(form.h, w)
        out += [(int(h[a].view(np.int64)), int(form.start[a]), False, _slots(form, raw, a, w), w) for a in _chosen(forms, k, w, at)]
    out += [(int(v), a, True, [], width) for a, v in enumerate(hashes.view(np.int64))]
    return [(h, a, p, z, need_plain, need, w) for h, a, p, z, w in out]


_ITEM = "hash long, item long, at long, plain boolean, slots array<string>, need_plain long, need long, width long"


def benchmark_windows(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(hash, item, at, plain, slots, need_plain, need, width) of every window of the benchmark."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            rows = []
            for item, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if item is not None:
                    rows += [(r[0], item, *r[1:]) for r in item_windows(x.as_py() or "", words)]
            cols = list(zip(*rows, strict=True)) or [()] * 8
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.string()), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["hash", "item", "at", "plain", "slots", "need_plain", "need", "width"])

    rows = benchmark.select(F.col(id_col).cast("long").alias("item"), sound(text_col).alias("text"))
    return rows.mapInArrow(each, _ITEM)


def document_windows(docs: DataFrame, id_col: str, text_col: str, widths: list[int], known: np.ndarray | None) -> DataFrame:
    """(id, text_hash, hash, at, slots) of the documents' windows, only those with a known hash if these are given."""
    sent = docs.sparkSession.sparkContext.broadcast(known)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, wanted = Words(), sent.value
        coarse = _coarse(wanted) if wanted is not None and len(wanted) else None
        for batch in batches:
            if len(words) > 500_000:
                words = Words()
            rows: list[tuple] = []
            for key, th, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                raw, forms = _forms(x.as_py() or "", words)
                for k, form in enumerate(forms):
                    for width in widths:
                        hashes = windows(form.h, width)
                        at = np.arange(len(hashes)) if coarse is None else _member(wanted, coarse, hashes)
                        at = _chosen(forms, k, width, at)
                        rows += [(key, th, int(hashes[a].view(np.int64)), int(form.start[a]), _slots(form, raw, a, width) if k else []) for a in at]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["id", "text_hash", "hash", "at", "slots"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("text_hash"), sound(text_col).alias("text"))
    return rows.mapInArrow(each, "id long, text_hash long, hash long, at long, slots array<string>")


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", sent: int = SENT) -> DataFrame:
    """(id, text_hash, items array<long>, changed boolean) of the documents that hold an item; changed: in no
    alignment do all slots hold the item's own values."""
    items = cut(benchmark_windows(benchmark, item_col, item_text_col))
    distinct = items.select("hash").distinct()
    widths = [r["width"] for r in items.select("width").distinct().orderBy("width").collect()]
    known = None
    if distinct.limit(sent + 1).count() <= sent:
        known = np.sort(distinct.toArrow()["hash"].to_numpy().astype(np.int64).view(np.uint64))
    found = cut(document_windows(docs, id_col, text_col, widths, known))
    i = items.select(F.col("hash").alias("i_hash"), "item", F.col("at").alias("i_at"), "plain", F.col("slots").alias("i_slots"), "need_plain", "need")
    # A window with other slots than the item's, in number, is another one whose hash happens to be the same.
    pairs = found.join(i, (F.col("hash") == F.col("i_hash")) & (F.size("slots") == F.size("i_slots")))
    shift = F.col("at") - F.col("i_at")
    bands = F.array(F.floor(shift / BAND) * 2, F.floor((shift + BAND // 2) / BAND) * 2 + 1)
    pairs = pairs.select("id", "text_hash", "item", F.explode(bands).alias("band"), "i_at", "plain", "need_plain", "need", F.arrays_zip("i_slots", "slots").alias("z"))
    seen = F.array_distinct(F.flatten(F.collect_set("z")))
    places = lambda c: F.size(F.collect_set(c))
    aligned = pairs.groupBy("id", "text_hash", "item", "band").agg(
        places("i_at").alias("n"), places(F.when(F.col("plain"), F.col("i_at"))).alias("n_plain"), F.max("need").alias("need"), F.max("need_plain").alias("need_plain"), seen.alias("z")
    )
    was = F.transform("z", lambda x: x["i_slots"])
    whole = F.col("n_plain") >= F.col("need_plain")
    consistent = F.size(F.array_distinct(was)) == F.size("z")
    same = F.forall("z", lambda x: x["i_slots"] == x["slots"])
    good = aligned.where(whole | (F.coalesce(F.col("n") >= F.col("need"), F.lit(False)) & consistent)).select("id", "text_hash", "item", same.alias("same"))
    return good.groupBy("id", "text_hash").agg(F.sort_array(F.collect_set("item")).alias("items"), (~F.max("same")).alias("changed"))


def _joined(docs: DataFrame, benchmark: DataFrame, how: str, **names) -> DataFrame:
    hit_id, hit_hash = free_names(docs, "__hit_id", "__hit_hash")
    hits = cut(contaminated(docs, benchmark, **names)).select(F.col("id").alias(hit_id), F.col("text_hash").alias(hit_hash))
    id_col, text_col = names.get("id_col", "doc_id"), names.get("text_col", "text")
    on = docs[id_col].cast("long").eqNullSafe(F.col(hit_id)) & (F.xxhash64(docs[text_col]) == F.col(hit_hash))
    return docs.join(hits, on, how)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, **names) -> DataFrame:
    """The documents that hold no item, with all their columns."""
    return _joined(docs, benchmark, "left_anti", **names)


def decontaminate(docs: DataFrame, benchmark: DataFrame, **names) -> DataFrame:
    """(doc_id, contaminated, changed, items) of every document."""
    id_col, text_col = names.get("id_col", "doc_id"), names.get("text_col", "text")
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("__hash"))
    hits = cut(contaminated(docs, benchmark, **names)).select(F.col("id").alias("__hit_id"), "text_hash", "items", "changed")
    out = slim.join(hits, F.col("doc_id").eqNullSafe(F.col("__hit_id")) & (F.col("__hash") == F.col("text_hash")), "left")
    return out.select(
        "doc_id",
        F.col("items").isNotNull().alias("contaminated"),
        F.coalesce("changed", F.lit(False)).alias("changed"),
        F.coalesce("items", F.array().cast("array<long>")).alias("items"),
    )


def op10_decontaminate(spark, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
