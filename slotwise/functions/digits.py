"""Mixed-radix digits of a value."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


class Basis:
    """Bases of the digits of a value, the last one least significant."""

    def __init__(self, bases: Sequence[int]):
        if not bases or min(bases) < 1:
            raise ValueError("a basis has one base or more, each at least 1")
        self.bases = tuple(int(b) for b in bases)

    @classmethod
    def binary(cls, cardinality: int) -> Basis:
        return cls([2] * max(1, (max(1, cardinality) - 1).bit_length()))

    @property
    def product(self) -> int:
        return math.prod(self.bases)

    def base(self, component: int) -> int:
        return self.bases[component]

    def weight(self, component: int) -> int:
        """What one unit of the digit is worth."""
        return math.prod(self.bases[component + 1 :])

    def digits(self, value: int) -> tuple[tuple[int, ...], bool]:
        """The digits, and whether the value fits; they are its lowest digits if it doesn't."""
        return tuple(value // self.weight(i) % b for i, b in enumerate(self.bases)), 0 <= value < self.product

    def digit_columns(self, value: Column) -> list[Column]:
        """A column for each digit, most significant first; bits are read where all bases are 2."""
        value = value.cast("long")
        if set(self.bases) == {2} and len(self.bases) <= 63:
            return [F.bit_get(value, F.lit(len(self.bases) - 1 - i)).cast("int") for i in range(len(self.bases))]
        return [F.pmod(_div(value, self.weight(i)), F.lit(b)).cast("int") for i, b in enumerate(self.bases)]

    def fits(self, value: Column) -> Column:
        return (value >= 0) & (value < self.product)


def _div(value: Column, by: int) -> Column:
    return value if by == 1 else F.call_function("div", value, F.lit(by).cast("long"))
