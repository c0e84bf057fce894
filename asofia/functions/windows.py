"""Window helpers.

A security has at most one bar per calendar day, so a window partitioned by
``code`` is bounded by the length of the calendar. Windows that run across
securities are not; those live in ``operators.ranks`` with a split form.
"""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec, functions as F


def bar_window(by: str = "code", order: str = "date") -> WindowSpec:
    return Window.partitionBy(by).orderBy(order)


def trailing(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(-(n - 1), 0)


def _full(agg, c: Column, n: int, w: WindowSpec) -> Column:
    frame = trailing(w, n)
    return F.when(F.count(c).over(frame) == n, agg(c).over(frame))


def full_mean(c: Column, n: int, w: WindowSpec) -> Column:
    """Trailing mean, null until n non-null observations are in the frame."""
    return _full(F.avg, c, n, w)


def full_std(c: Column, n: int, w: WindowSpec) -> Column:
    """Trailing sample standard deviation with the same guard."""
    return _full(F.stddev_samp, c, n, w)


def pct_change(c: Column, n: int, w: WindowSpec) -> Column:
    previous = F.lag(c, n).over(w)
    return F.when(previous != 0, c / previous - 1)


def running(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def compound(c: Column) -> Column:
    """Aggregate: product of (1 + c) minus one, summed in logs where it can be.

    A return of -100 % or worse ends the curve at -1.
    """
    ruined = F.max(F.when(c <= -1, 1).otherwise(0)) == 1
    return F.when(ruined, F.lit(-1.0)).otherwise(
        F.exp(F.sum(F.when(c > -1, F.log1p(c)))) - 1)
