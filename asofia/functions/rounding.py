"""Report rounding that gives the same double in every engine.

``floor(x * 10^n + 0.5)`` uses only IEEE arithmetic. The small extra offset
moves exact decimal ties (means of prices with few decimals are full of them)
away from the boundary, so summation order cannot flip a result.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

TIE_OFFSET = "0.5000123"


def snap(c: Column | str, n: int = 4) -> Column:
    x = F.col(c) if isinstance(c, str) else c
    scale = float(10 ** n)
    return F.floor(x * F.lit(scale) + F.lit(float(TIE_OFFSET))) / F.lit(scale)


def snap_sql(expr: str, n: int = 4) -> str:
    scale = f"{10 ** n}.0::DOUBLE"
    return f"(floor(({expr})*{scale}+{TIE_OFFSET}::DOUBLE)/{scale})"
