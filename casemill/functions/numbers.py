"""Number expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

NUMBER_PATTERN = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"


def round_to(value: Column, places: int) -> Column:
    """Round a double through its scaled value, the form other engines evaluate identically."""
    scale = float(10**places)
    return F.round(value.cast("double") * F.lit(scale)) / F.lit(scale)


def share(part: Column, whole: Column, scale: float = 100.0) -> Column:
    """``part / whole * scale``, null when the whole is zero."""
    return part * F.lit(float(scale)) / F.nullif(whole, F.lit(0))


def to_double(text: Column) -> Column:
    """Number held in a string, null for anything else (also for ``1d``, ``NaN`` and ``Infinity``)."""
    trimmed = F.trim(text.cast("string"))
    return F.when(trimmed.rlike(NUMBER_PATTERN), trimmed.try_cast("double"))


def finite(value: Column) -> Column:
    """A double as it is, null where it is no finite number; what :func:`to_double` gives of its text."""
    return F.when(~F.isnan(value) & (F.abs(value) != F.lit(float("inf"))), value)


def coerce_number(value: Column) -> Column:
    """Finite number or zero."""
    number = value.try_cast("double")
    infinite = F.abs(number) == F.lit(float("inf"))
    return F.when(number.isNull() | F.isnan(number) | infinite, F.lit(0.0)).otherwise(number)


def count_when(condition: Column) -> Column:
    """Rows for which the condition holds; null counts as no."""
    return F.count(F.when(condition, F.lit(1)))
