"""Rounding, clamping and decibels with ECMAScript's number rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x: Column | str | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def js_round(x: Column | str, digits: int = 0) -> Column:
    """Half towards plus infinity: floor(x * 10^d + 0.5) / 10^d, as a double."""
    factor = float(10**digits)
    return F.floor(_col(x).cast("double") * factor + 0.5).cast("double") / factor


def js_round_int(x: Column | str) -> Column:
    return F.floor(_col(x).cast("double") + 0.5).cast("long")


def clamp(x: Column | str, low: float | Column, high: float | Column) -> Column:
    """Null stays null, which greatest and least alone would skip."""
    return F.when(_col(x).isNotNull(), F.least(F.greatest(_col(x), _col(low)), _col(high)))


def finite(x: Column | str) -> Column:
    """The value where it is a finite number, else null."""
    x = _col(x).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def ratio(part: Column, whole: Column) -> Column:
    """part / whole; 0 where the whole is 0 or null."""
    return F.when(whole > 0, part.cast("double") / whole).otherwise(F.lit(0.0))


def percentage(part: Column, whole: Column) -> Column:
    """Whole per cent; 0 where the whole is 0."""
    return F.when(whole == 0, F.lit(0).cast("long")).otherwise(js_round_int(part.cast("double") / whole * 100))


def average_or_zero(values: Column, digits: int = 2) -> Column:
    """Aggregate: the mean to ``digits`` places, 0 of nothing."""
    return F.coalesce(js_round(F.avg(values), digits), F.lit(0.0))


def amplitude_to_dbfs(x: Column | str) -> Column:
    return js_round(20 * F.log10(F.greatest(F.abs(_col(x)), F.lit(1.5849e-5))), 1)


def decibels_to_linear(db: Column | str) -> Column:
    return F.pow(F.lit(10.0), _col(db) / 20)


def linear_to_decibels(factor: Column | str, least: float = 2.220446049250313e-16) -> Column:
    return 20 * F.log10(F.greatest(_col(factor), F.lit(least)))


def bounded(x: Column | str, low: float, high: float) -> Column:
    """Optional finite number clamped to a range; null where it is none."""
    return clamp(finite(x), low, high)


def bounded_int(x: Column | str, low: int, high: int, default: int | None = None) -> Column:
    whole = clamp(js_round_int(finite(x)), low, high)
    return whole if default is None else F.coalesce(whole, F.lit(default).cast("long"))


def score(x: Column | str) -> Column:
    """Clamped to 0..1, two places."""
    return js_round(clamp(x, 0.0, 1.0), 2)


def checked(x: Column, condition: Column, message: str) -> Column:
    """The value where the condition holds; else the query fails with the message."""
    return F.when(condition, x).otherwise(F.raise_error(F.lit(message)))


def bounded_number(x: Column | str) -> Column:
    x = _col(x)
    return checked(x, finite(x).between(0, 1), "expected a number between 0 and 1")


def bounded_integer(x: Column | str, most: Column | float) -> Column:
    x = _col(x)
    return checked(x, finite(x).between(0, most) & (F.floor(x) == x), "expected a bounded integer")


def positive_number(x: Column | str) -> Column:
    x = _col(x)
    return checked(x, finite(x) > 0, "expected a positive number")


def non_negative_integer(x: Column | str) -> Column:
    x = _col(x)
    return checked(x, (finite(x) >= 0) & (F.floor(x) == x), "expected a non-negative integer")


def non_empty_string(x: Column | str) -> Column:
    x = F.trim(_col(x))
    return checked(x, F.length(x) > 0, "expected a non-empty string")


def int24(x: Column | str) -> Column:
    """A sample from -1 to 1 as a signed 24-bit integer, by a scale of its own on each side of 0."""
    x = clamp(x, -1.0, 1.0)
    return js_round_int(F.when(x < 0, x * 8388608).otherwise(x * 8388607))
