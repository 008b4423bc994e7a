"""Column expressions over numbers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from opswell.functions.text import col


def cents(c: Column | str) -> Column:
    """Money as whole hundredths, so that sums are exact and do not depend on the order of adding."""
    return F.round(col(c) * 100).cast("long")


def whole_number(c: Column | str) -> Column:
    """Text as a whole number; null where it is none or too large.

    A cast that fails makes an exception for each row, which costs more than the
    rest of the row's work. So only signs and digits are cast, within the white
    space and control characters that a cast drops.
    """
    return F.when(col(c).rlike(r"^[\x00-\x20\x7f]*[+-]?[0-9]+[\x00-\x20\x7f]*$"), col(c).try_cast("long"))


def ratio(top: Column | str, bottom: Column | str) -> Column:
    """Quotient, null where the divisor is 0."""
    return F.try_divide(col(top).cast("double"), col(bottom).cast("double"))


def clamp(c: Column | str, lo: float = 0.0, hi: float = 100.0) -> Column:
    return F.least(F.greatest(col(c), F.lit(lo)), F.lit(hi))


def percent(part: Column | str, whole: Column | str) -> Column:
    """Share in percent, null unless the whole is above 0."""
    part, whole = col(part).cast("double"), col(whole).cast("double")
    return F.when(whole > 0, F.lit(100.0) * part / whole)


def fahrenheit_to_celsius(c: Column | str) -> Column:
    return (col(c) - 32.0) * 5.0 / 9.0


def celsius_to_kelvin(c: Column | str) -> Column:
    return col(c) + 273.15


def fahrenheit_to_rankine(c: Column | str) -> Column:
    return col(c) + 459.67


def common_divisor(a: Column | str, b: Column | str) -> Column:
    """Greatest common divisor by repeated division.

    The number of steps is at most that of two neighbouring Fibonacci numbers of
    the size of the smaller one, so small numbers take a few steps only.
    """
    start = F.struct(F.abs(col(a)).alias("a"), F.abs(col(b)).alias("b"))
    golden = (1 + 5**0.5) / 2
    steps = F.ceil(F.log(golden, F.least(start["a"], start["b"]) + 1.0)).cast("int") + 3
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(
        F.struct(s["b"].alias("a"), F.try_mod(s["a"], s["b"]).alias("b"))
    )
    return F.aggregate(F.sequence(F.lit(1), steps), start, step, lambda s: s["a"])


def fraction(numerator: Column | str, denominator: Column | str) -> Column:
    """Lowest terms as [numerator, denominator]; null for a denominator of 0."""
    n, d = col(numerator), col(denominator)
    g = common_divisor(n, d)
    # The sign sits on the numerator.
    sign = F.signum(d).cast("long")
    part = lambda x: F.call_function("div", x * sign, F.nullif(g, F.lit(0)))
    return F.when(d != 0, F.array(part(n), part(d)))


def more_severe(a: Column | str, b: Column | str) -> Column:
    """The smaller number is the more severe one."""
    return F.least(col(a), col(b))


def bump(c: Column | str) -> Column:
    return F.greatest(col(c) - 1, F.lit(1))
