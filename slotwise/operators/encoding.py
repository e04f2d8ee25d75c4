"""Bitmap encodings: which slots hold a digit, and which slots answer a predicate on it.

An answer is a formula over stored slots, built here in plain Python from the ranks of the
literals and compiled later to one aggregate (see ``index``).
"""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F

from slotwise.functions.digits import Basis


class Encoding(Enum):
    EQUALITY = 0
    INTERVAL = 1
    RANGE = 2


class IndexType(Enum):
    BITMAP = 1
    BITSLICED = 2


# formulas


@dataclass(frozen=True)
class Slots:
    """The union of the stored slots lo..hi of a component; component -1 is existence."""

    column: str
    component: int
    lo: int
    hi: int


@dataclass(frozen=True)
class Nothing:
    pass


@dataclass(frozen=True)
class Op:
    name: str  # and, or, andnot, xor
    left: object
    right: object


NONE = Nothing()


def both(a, b):
    if NONE in (a, b):
        return NONE
    return a if a == b else Op("and", a, b)


def either(a, b):
    if a == NONE or a == b:
        return b
    return a if b == NONE else Op("or", a, b)


def less(a, b):
    if a == NONE or b == NONE:
        return a
    return NONE if a == b else Op("andnot", a, b)


def differ(a, b):
    if NONE in (a, b):
        return b if a == NONE else a
    return NONE if a == b else Op("xor", a, b)


def interval_span(base: int) -> int:
    """A slot of the interval encoding holds its own digit and so many more."""
    return base // 2 - 1


def slot_count(encoding: Encoding, base: int) -> int:
    return {Encoding.EQUALITY: base, Encoding.RANGE: base - 1, Encoding.INTERVAL: (base + 1) // 2}[encoding] if base > 1 else 0


def slots_of(encoding: Encoding, base: int, digit: Column) -> Column:
    """Array of the slots that a document with ``digit`` is in."""
    if base == 1:
        return F.array().cast("array<int>")
    if encoding is Encoding.EQUALITY:
        return F.array(digit)
    if encoding is Encoding.RANGE:
        first, last = digit, F.lit(base - 2)
    else:
        first, last = F.greatest(F.lit(0), digit - interval_span(base)), F.least(digit, F.lit(slot_count(encoding, base) - 1))
    return F.when(first <= last, F.sequence(first, F.greatest(first, last))).otherwise(F.array().cast("array<int>"))


class Coded:
    """Formulas over the slots of one indexed column."""

    def __init__(self, column: str, encoding: Encoding, basis: Basis):
        self.column, self.encoding, self.basis = column, encoding, basis

    @property
    def existence(self) -> Slots:
        return Slots(self.column, -1, -1, -1)

    def _slot(self, i: int, lo: int, hi: int | None = None) -> Slots:
        return Slots(self.column, i, lo, lo if hi is None else hi)

    def digit_equals(self, i: int, v: int):
        base, every = self.basis.base(i), self.existence
        if base == 1:
            return every if v == 0 else NONE
        if self.encoding is Encoding.EQUALITY:
            return self._slot(i, v)
        if self.encoding is Encoding.RANGE:
            if v == 0:
                return self._slot(i, 0)
            return less(every, self._slot(i, v - 1)) if v == base - 1 else differ(self._slot(i, v), self._slot(i, v - 1))
        m, n = interval_span(base), slot_count(self.encoding, base)
        if v == base - 1:
            return less(every, either(self._slot(i, n - 1), self._slot(i, 0)))
        if v < m:
            return less(self._slot(i, v), self._slot(i, v + 1))
        if v == m:
            return both(self._slot(i, m), self._slot(i, 0))
        return less(self._slot(i, v - m), self._slot(i, v - m - 1))

    def digit_at_most(self, i: int, v: int):
        base = self.basis.base(i)
        if v < 0:
            return NONE
        if v >= base - 1:
            return self.existence
        if self.encoding is Encoding.EQUALITY:
            return self._slot(i, 0, v)
        if self.encoding is Encoding.RANGE:
            return self._slot(i, v)
        m = interval_span(base)
        if v < m:
            return less(self._slot(i, 0), self._slot(i, v + 1))
        return self._slot(i, 0) if v == m else either(self._slot(i, 0), self._slot(i, v - m))

    def equals(self, rank: int):
        digits, fits = self.basis.digits(rank)
        if not fits:
            return NONE
        found = self.existence
        for i, v in enumerate(digits):
            own = self.digit_equals(i, v)
            found = own if i == 0 else both(found, own)
        return found

    def at_most(self, rank: int):
        if rank < 0:
            return NONE
        digits, fits = self.basis.digits(rank)
        if not fits:
            return self.existence
        *upper, last = range(len(digits))
        found = self.digit_at_most(last, digits[last])
        for i in reversed(upper):
            same = self.digit_equals(i, digits[i])
            found = either(self.digit_at_most(i, digits[i] - 1), same if found == self.existence else both(same, found))
        return found
