"""Lenient typing of text columns: what can't be read is null, and nothing is read that only looks like a value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DATE = r"^\s*\d{4,}-\d{1,2}-\d{1,2}([ T]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?)?\s*$"


def lenient_double(text: Column) -> Column:
    """A number, or null. A trailing d or f, which the JVM would take, is no number; neither are NaN and infinities."""
    number = F.when(~F.trim(text).rlike("[dDfF]$"), F.trim(text).try_cast("double"))
    return F.when(~F.isnan(number) & (F.abs(number) < F.lit(float("inf"))), number)


def lenient_int(text: Column) -> Column:
    """A whole number within int, halves rounded away from zero, or null."""
    return F.round(lenient_double(text)).try_cast("int")


def lenient_date(text: Column) -> Column:
    """A date written year-month-day, with or without a time, or null."""
    return F.when(text.rlike(_DATE), F.regexp_extract(text, r"\d{4,}-\d{1,2}-\d{1,2}", 0).try_cast("date"))


def compact_date(text: Column) -> Column:
    """A date written as eight digits, or null."""
    digits = F.trim(text)
    parts = F.concat_ws("-", F.substring(digits, 1, 4), F.substring(digits, 5, 2), F.substring(digits, 7, 2))
    return F.when(digits.rlike(r"^\d{8}$"), parts.try_cast("date"))


def truth(text: Column) -> Column:
    """Whether the text says yes, in either language; null says no."""
    return F.upper(F.coalesce(text, F.lit(""))).isin("TRUE", "SI", "1", "YES", "VERDADERO")


def present(text: Column) -> Column:
    """Neither null nor only spaces."""
    return text.isNotNull() & (F.trim(text) != "")


def keyed(key: Column) -> Column:
    """Usable as a key: neither null nor empty."""
    return key.isNotNull() & (key != "")
