"""String and date expressions."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, functions as F

from casemill.functions.numbers import to_double

SPREADSHEET_EPOCH = "1899-12-30"
WHITE_SPACE = " \t\n\x0b\f\r"
# Words that mark a phone, a verbal channel and a cancellation cause.
PHONE_WORDS = ("telefon", "phone", "telefonico", "telefónico")
VERBAL_WORDS = ("verbal",)
CANCEL_WORDS = ("cancel",)


def strip(text: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def is_blank(text: Column) -> Column:
    """Null or nothing but white space."""
    return text.isNull() | (F.length(strip(text)) == 0)


def contains_any(text: Column, words: Iterable[str]) -> Column:
    """Case-insensitive: the text holds at least one of the words."""
    lowered = F.lower(text)
    return reduce(lambda a, b: a | b, [lowered.contains(word) for word in words])


def normalize_status(text: Column) -> Column:
    """Lower case, runs of white space to one underscore."""
    return F.regexp_replace(F.lower(text), r"\s+", "_")


def spreadsheet_date(value: Column) -> Column:
    """Spreadsheet serial day number to a date; zero, negative and unreadable values give null."""
    days = to_double(value).cast("int")
    return F.when(days > 0, F.date_add(F.lit(SPREADSHEET_EPOCH).cast("date"), days))


def similarity_ratio(left: Column, right: Column) -> Column:
    """``1 - levenshtein / longer length``; two empty strings are equal."""
    longest = F.greatest(F.length(left), F.length(right))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1.0 - F.levenshtein(left, right) / longest)


def month_text(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def email_domain(address: Column) -> Column:
    """Text from the last ``@`` on, null without one."""
    return F.when(address.contains("@"), F.concat(F.lit("@"), F.substring_index(address, "@", -1)))
