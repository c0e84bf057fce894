"""Binary search in sorted arrays as a column expression."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

BITS = 24


def count_at_most(sorted_values: Column, value: Column, bits: int = BITS) -> Column:
    """How many elements of an ascending array are at most ``value``; arrays hold fewer than 2 ** ``bits``."""
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(bits))])
    return F.aggregate(steps, F.lit(0), lambda n, s: F.when(F.try_element_at(sorted_values, n + s) <= value, n + s).otherwise(n))
