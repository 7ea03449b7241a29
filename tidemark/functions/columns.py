"""Null-safe scalar building blocks, all plain Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

LN2 = math.log(2.0)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def known(c: Column | str) -> Column:
    """NaN to NULL, so that aggregates skip a missing value instead of spreading it."""
    c = col(c)
    return F.when(~F.isnan(c), c)


def safe_ln(c: Column | str) -> Column:
    """Natural log; NULL for zero and below."""
    c = col(c)
    return F.ln(F.when(c > 0, c))


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b; NULL when b is zero (ANSI division would raise)."""
    return F.try_divide(col(a), col(b))


def log_ratio(a: Column | str, b: Column | str) -> Column:
    return safe_ln(ratio(a, b))


def or_zero(c: Column | str) -> Column:
    return F.coalesce(col(c), F.lit(0.0))


def zero_to(c: Column | str, value: float) -> Column:
    c = col(c)
    return F.when(c == 0, F.lit(value)).otherwise(c)


def epoch_ms(c: Column | str) -> Column:
    return F.timestamp_millis(col(c).cast("bigint"))


def epoch_seconds(c: Column | str) -> Column:
    return F.timestamp_seconds(col(c).cast("bigint"))


def iso_time(c: Column | str) -> Column:
    """ISO-8601 text to an instant; NULL where the text is no time."""
    return F.try_to_timestamp(col(c))


def tidy_name(name: str) -> str:
    return name.lower().replace(" ", "_")


# The published rational approximation of the normal tail
# (J. F. Hart and others, Computer Approximations, 1968; coefficients as printed in
# G. West, Better Approximations to Cumulative Normal Functions, 2005).
NORMAL_NUMERATOR = (
    3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
    112.079291497871, 221.213596169931, 220.206867912376,
)
NORMAL_DENOMINATOR = (
    8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
    296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752,
)


def _horner(x: Column, coefficients: tuple[float, ...]) -> Column:
    total = F.lit(coefficients[0])
    for c in coefficients[1:]:
        total = total * x + F.lit(c)
    return total


def norm_cdf(z: Column | str) -> Column:
    """Standard normal distribution function, absolute error below 1e-15.

    The published method switches to a continued fraction in the far tail for its
    relative error; the quotient alone already has the absolute one on the whole line.
    """
    z = col(z)
    x = F.least(F.abs(z), F.lit(37.0))
    tail = F.exp(-x * x / 2) * _horner(x, NORMAL_NUMERATOR) / _horner(x, NORMAL_DENOMINATOR)
    upper = z > 0
    folded = F.when(upper, 1.0).otherwise(0.0) + F.when(upper, -1.0).otherwise(1.0) * tail
    return F.when(z.isNotNull(), folded)
