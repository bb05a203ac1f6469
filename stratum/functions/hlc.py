"""Hybrid logical clock: 48 bits of milliseconds, 16 bits of counter."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

COUNTER_BITS = 16


def pack(ms: int, counter: int) -> int:
    return (ms << COUNTER_BITS) | counter


def unpack(hlc: int) -> tuple[int, int]:
    return hlc >> COUNTER_BITS, hlc & ((1 << COUNTER_BITS) - 1)


def pack_column(ms: Column, counter: Column) -> Column:
    return F.shiftleft(ms.cast("long"), COUNTER_BITS).bitwiseOR(counter.cast("long"))


def millis_column(hlc: Column) -> Column:
    return F.shiftright(hlc, COUNTER_BITS)


def counter_column(hlc: Column) -> Column:
    return hlc.bitwiseAND(F.lit((1 << COUNTER_BITS) - 1).cast("long"))


class Clock:
    """Gives strictly growing values; a later millisecond starts its counter at 0, otherwise the last value plus one."""

    def __init__(self, last: int = 0, now_ms: Callable[[], int] | None = None):
        self._last = last
        self._now = now_ms or (lambda: time.time_ns() // 1_000_000)

    @property
    def last(self) -> int:
        return self._last

    def observe(self, hlc: int) -> None:
        """Never give a value up to hlc, as after reopening a store whose clock was ahead."""
        self._last = max(self._last, hlc)

    def next(self) -> int:
        now = pack(self._now(), 0)
        self._last = now if now > self._last and unpack(now)[0] > unpack(self._last)[0] else self._last + 1
        return self._last
