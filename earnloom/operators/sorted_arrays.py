"""Binary search in sorted array columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def count_below(values: Column, bound: Column, or_equal: bool = False, bits: int = 22) -> Column:
    """How many entries of an ascending array lie below ``bound`` (or equal it): 0 for a null array or bound.

    The answer's binary digits are settled one by one, so an array of n entries takes log(n) look-ups;
    ``bits`` bounds the array's length by 2 ** bits - 1.
    """
    digits = F.array(*[F.lit(1 << b) for b in range(bits - 1, -1, -1)])

    def settle(found: Column, digit: Column) -> Column:
        entry = F.get(values, found + digit - 1)  # null beyond the end
        fits = (entry <= bound) if or_equal else (entry < bound)
        return F.when(fits, found + digit).otherwise(found)

    return F.aggregate(digits, F.lit(0), settle)
