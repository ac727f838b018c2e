"""Exact decimal rounding on whole numbers.

``round(double, n)`` depends on the binary value of the quotient, so ties differ between engines.
All counters are whole numbers, so the rounded quotient is computed with integer division instead.
"""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column
from pyspark.sql import functions as F


# Holds any product of a counter and a unit.
WIDE = "decimal(38,0)"


def _div(num: Column, den: Column) -> Column:
    return F.call_function("div", num, den)


def half_up(num: Column, den: Column | int = 1, *, scale: int = 1, digits: int = 0) -> Column:
    """``round(num / den / scale, digits)`` with ties away from zero.

    ``num`` and ``den`` are whole numbers. The result is BIGINT for ``digits=0``, else DOUBLE. It is
    NULL when either side is NULL or ``den`` is zero. The steps between are DECIMAL, so only a result
    too large for BIGINT raises (ANSI mode).
    """
    den = F.lit(den).cast("bigint") if isinstance(den, int) else den
    power = 10**digits
    common = gcd(power, scale)
    times, parts = power // common, scale // common
    if parts % 2:  # an even bottom makes its half a whole number
        times, parts = times * 2, parts * 2
    wide_num, wide_den = F.abs(num.cast(WIDE)), F.abs(den.cast(WIDE))
    top = wide_num * F.lit(times) + wide_den * F.lit(parts // 2)
    size = _div(top, F.nullif(wide_den * F.lit(parts), F.lit(0)))
    signed = F.when((num < 0) != (den < 0), -size).otherwise(size)
    return signed / F.lit(float(power)) if digits else signed


def per_exec(total: Column, executions: Column, *, scale: int = 1, digits: int = 0) -> Column:
    """Cost per execution, with at least one execution in the divisor and NULL kept NULL."""
    at_least_one = F.when(executions.isNotNull(), F.greatest(executions, F.lit(1)))
    return half_up(total, at_least_one, scale=scale, digits=digits)
