"""Bit-sliced comparison of fingerprints.

A run of rows is stored vertically: plane j is one integer whose bit i is bit j of row i. Comparing every
row with the one s places further on is then one xor per plane; distances are kept for all lanes at once in
carry-save counters (bit k of every lane's count stands in one integer) and a run is abandoned as soon as
every lane has passed the radius.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd

#: Rows compared in one go; a run holds whole groups.
RUN = 4096


def _mask(flags: np.ndarray) -> int:
    return int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")


def _lanes(mask: int, n: int) -> np.ndarray:
    raw = np.frombuffer(mask.to_bytes((n + 7) // 8, "little"), dtype=np.uint8)
    return np.nonzero(np.unpackbits(raw, count=n, bitorder="little"))[0]


def planes(values: np.ndarray) -> list[int]:
    """Bit planes of a uint64 array; planes that are alike in every row come last, as they can't add to a distance."""
    bits = np.unpackbits(values.view(np.uint8).reshape(len(values), 8), axis=1, bitorder="little")
    out = [_mask(bits[:, j]) for j in range(64)]
    full = (1 << len(values)) - 1
    return [p for p in out if p not in (0, full)]


def near_lanes(vertical: list[int], shift: int, lanes: int, radius: int) -> int:
    """Of the lanes, those whose row differs in at most radius bits from the row shift places on."""
    width = radius.bit_length()
    count = [0] * width
    over = 0
    live = lanes
    for i, plane in enumerate(vertical):
        carry = (plane ^ (plane >> shift)) & live
        for k in range(width):
            count[k], carry = count[k] ^ carry, count[k] & carry
            if not carry:
                break
        over |= carry
        if i > radius and i % 4 == 3:
            live = lanes & ~(over | _above(count, radius))
            if not live:
                return 0
    return lanes & ~(over | _above(count, radius))


def _above(count: list[int], radius: int) -> int:
    """Lanes whose counter is above radius, compared from the highest bit down."""
    above, same = 0, -1
    for k in reversed(range(len(count))):
        if radius >> k & 1:
            same &= count[k]
        else:
            above |= same & count[k]
            same &= ~count[k]
    return above


def forest(group: np.ndarray, values: np.ndarray, radius: int) -> np.ndarray:
    """Component label (a row number) of each row, rows of one group being adjacent; links stay within a group."""
    n = len(values)
    start = np.r_[True, group[1:] != group[:-1]]
    first = np.maximum.accumulate(np.where(start, np.arange(n), 0))
    last = np.r_[np.nonzero(start)[0][1:], n][np.cumsum(start) - 1]
    room = last - np.arange(n)
    label = np.arange(n)
    vertical = planes(values)
    for shift in range(1, int((last - first).max(initial=1))):
        lanes = _mask(room > shift)
        found = _lanes(near_lanes(vertical, shift, lanes, radius), n)
        for i in found[label[found] != label[found + shift]]:
            a, b = label[i], label[i + shift]
            if a != b:
                span = slice(first[i], last[i])
                label[span][label[span] == max(a, b)] = min(a, b)
    return label


def chain_edges(label: np.ndarray, ids: np.ndarray) -> pd.DataFrame:
    """Each component as a chain of its members: as connected as all its pairs, with two edges a row at most."""
    order = np.argsort(label, kind="stable")
    same = label[order][1:] == label[order][:-1]
    return pd.DataFrame({"a": ids[order][1:][same], "b": ids[order][:-1][same]})


def link(batches: Iterator[pd.DataFrame], radius: int, keys: list[str]) -> Iterator[pd.DataFrame]:
    """Edges among rows (keys..., fp, id) of a partition sorted by keys; whole groups are gathered into runs."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        rows = pd.concat([*held, pdf]) if held else pdf
        k = rows[keys].to_numpy()
        open_from = int(np.nonzero((k != k[-1]).any(axis=1))[0].max(initial=-1)) + 1
        if open_from >= RUN:
            yield from _runs(rows.iloc[:open_from], radius, keys)
            rows = rows.iloc[open_from:]
        held = [rows]
    if held:
        yield from _runs(held[0], radius, keys)


def _runs(rows: pd.DataFrame, radius: int, keys: list[str]) -> Iterator[pd.DataFrame]:
    k = rows[keys].to_numpy()
    new = np.r_[True, (k[1:] != k[:-1]).any(axis=1)]
    group = np.cumsum(new)
    size = np.bincount(group)[group]
    pick = size > 1
    rows, group, size = rows[pick], group[pick], size[pick]
    order = np.lexsort((group, size))  # groups of one size together, so that lanes stay full as shifts grow
    fp = rows["fp"].to_numpy().astype(np.int64).view(np.uint64)[order]
    ids, group = rows["id"].to_numpy()[order], group[order]
    at = 0
    while at < len(group):
        end = min(at + RUN, len(group))
        while end < len(group) and group[end] == group[end - 1]:
            end += 1
        out = chain_edges(forest(group[at:end], fp[at:end], radius), ids[at:end])
        if len(out):
            yield out
        at = end
