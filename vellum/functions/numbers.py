"""Numbers and dates with the grammar and rounding that the rules are stated in."""

from __future__ import annotations

import datetime
import re

from pyspark.sql import Column, functions as F

from vellum.functions.text import WS


def rounded(value: Column, digits: int) -> Column:
    """Half-even rounding of the exact binary value, for small numbers such as scores."""
    return F.format_number(value, digits).cast("double")


def percent_of(part: Column, whole: Column) -> Column:
    """Whole percent, ties to the even number; null for an empty whole."""
    return F.rint(F.try_divide(100 * part.cast("double"), whole.cast("double"))).cast("int")


def to_number(cell: Column) -> Column:
    """A number without its commas, or null: inner single underscores and Arabic-Indic digits are allowed, type suffixes are not."""
    plain = F.translate(F.regexp_replace(F.replace(cell, F.lit(",")), rf"^{WS}+|{WS}+$", ""), "٠١٢٣٤٥٦٧٨٩", "0123456789")
    joined = F.regexp_replace(plain, r"(?<=\d)_(?=\d)", "")
    fits = joined.rlike(r"(?i)^[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity|nan)$")
    return F.when(fits, joined.try_cast("double"))


def to_day(cell: Column) -> Column:
    """A date written year-month-day, months and days of one or two digits; null if there is no such day."""
    plain = F.regexp_replace(cell, rf"^{WS}+|{WS}+$", "")
    return F.when(plain.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_date(plain, "yyyy-M-d"))


def days_inclusive(start: Column, end: Column) -> Column:
    return F.datediff(end, start) + 1


def plain_number(cell: str) -> float | None:
    """``to_number`` of one cell, in Python."""
    body = re.sub(r"(?<=[0-9])_(?=[0-9])", "", cell.replace(",", "").strip().translate(str.maketrans("٠١٢٣٤٥٦٧٨٩", "0123456789")))
    fits = re.fullmatch(r"(?i)[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?|inf|infinity|nan)", body)
    return float(body) if fits else None


def plain_day(cell: str) -> datetime.date | None:
    """``to_day`` of one cell, in Python."""
    found = re.fullmatch(r"([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})", cell.strip())
    try:
        return datetime.date(*map(int, found.groups())) if found else None
    except ValueError:
        return None
