"""Predicates on indexed columns, with the three-valued logic of SQL."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


class IntervalFlags(Enum):
    OPEN = 0
    INCLUDE_LEFT = 1
    INCLUDE_RIGHT = 2
    CLOSED = 3


class Predicate:
    def __and__(self, other: Predicate) -> Predicate:
        return Both("and", self, other)

    def __or__(self, other: Predicate) -> Predicate:
        return Both("or", self, other)

    def __xor__(self, other: Predicate) -> Predicate:
        return Both("xor", self, other)

    def __sub__(self, other: Predicate) -> Predicate:
        """AND NOT."""
        return Both("and", self, Not(other))

    def __invert__(self) -> Predicate:
        return Not(self)

    def as_column(self) -> Column:
        """The predicate as a filter on rows that have the columns themselves."""
        raise NotImplementedError


@dataclass(frozen=True)
class Compare(Predicate):
    """``column op value``; op is one of = <> < <= > >=. A null value is never true."""

    column: str
    op: str
    value: Any

    def __post_init__(self):
        if self.op not in ("=", "<>", "<", "<=", ">", ">="):
            raise ValueError(f"no such comparison: {self.op}")

    def as_column(self) -> Column:
        own, value = F.col(self.column), F.lit(self.value)
        return {"=": own == value, "<>": own != value, "<": own < value, "<=": own <= value, ">": own > value, ">=": own >= value}[self.op]


@dataclass(frozen=True)
class Not(Predicate):
    of: Predicate

    def as_column(self) -> Column:
        return ~self.of.as_column()


@dataclass(frozen=True)
class Both(Predicate):
    op: str  # and, or, xor
    left: Predicate
    right: Predicate

    def as_column(self) -> Column:
        a, b = self.left.as_column(), self.right.as_column()
        return a & b if self.op == "and" else a | b if self.op == "or" else a != b


def between(column: str, low: Any, high: Any, flags: IntervalFlags = IntervalFlags.CLOSED) -> Predicate:
    left = ">=" if flags in (IntervalFlags.INCLUDE_LEFT, IntervalFlags.CLOSED) else ">"
    right = "<=" if flags in (IntervalFlags.INCLUDE_RIGHT, IntervalFlags.CLOSED) else "<"
    return Compare(column, left, low) & Compare(column, right, high)


def comparisons(of: Predicate) -> list[Compare]:
    if isinstance(of, Compare):
        return [of]
    return comparisons(of.of) if isinstance(of, Not) else comparisons(of.left) + comparisons(of.right)
