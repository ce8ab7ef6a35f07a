"""Scalar expressions. Everything here stays inside code generation."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

# Fixed value: the replacement character left by a wrong decoding of N-tilde.
BROKEN_CHARACTER = "�"


def parse_money(text: Column) -> Column:
    """Money text with thousands commas to BIGINT; unparsable text gives NULL."""
    return F.regexp_replace(text, ",", "").try_cast("bigint")


def whole_units(amount: Column) -> Column:
    """Numeric amount truncated to BIGINT; out of range gives NULL."""
    return amount.try_cast("bigint")


def repair_text(text: Column) -> Column:
    return F.replace(text, F.lit(BROKEN_CHARACTER), F.lit("N"))


def ratio(num: Column, den: Column) -> Column:
    """Division where a null or zero denominator gives NULL."""
    return F.try_divide(num, den)


def percent(part: Column, rest: Column) -> Column:
    """Share of ``part`` in ``part + rest``, times 100; a missing side gives NULL."""
    return F.try_divide(part, part + rest) * 100


def share(pct: Column) -> Column:
    return pct / 100


def yes_no(flag: Column) -> Column:
    return F.when(flag, F.lit("si")).otherwise(F.lit("no"))


def log_factorial(n: Column) -> Column:
    """ln(n!) for n >= 0: exact below ten, Stirling's series above.

    The series error is below 1e-12 from ten on.
    """
    x = F.greatest(n.cast("double"), F.lit(1.0))
    series = (
        x * F.ln(x) - x + 0.5 * F.ln(2 * math.pi * x)
        + 1 / (12 * x) - 1 / (360 * F.pow(x, 3))
        + 1 / (1260 * F.pow(x, 5)) - 1 / (1680 * F.pow(x, 7))
    )
    small = F.array(*[F.lit(math.lgamma(i + 1)) for i in range(10)])
    index = (F.least(n.cast("bigint"), F.lit(9)) + 1).cast("int")
    return F.when(n < 10, F.element_at(small, index)).otherwise(series)
