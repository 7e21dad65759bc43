"""Column functions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def r(c: Column, digits: int = 6) -> Column:
    """Rounded for comparison, without negative zero."""
    return F.round(c, digits) + F.lit(0.0)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero or null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def relative_delta(a: Column, b: Column) -> Column:
    """(a - b) over b's size, which counts as 1 at least."""
    return (a - b) / F.greatest(F.abs(b), F.lit(1.0))


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """c within bounds; null stays null."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def sigmoid(c: Column) -> Column:
    """The logistic function, its argument held within 30 of zero."""
    return 1 / (1 + F.exp(-clamp(c, -30.0, 30.0)))


def week_start(c: Column) -> Column:
    """Monday of a date's week."""
    return F.date_trunc("week", c).cast("date")


def iso_week_start(year: Column, week: Column) -> Column:
    """Monday of an ISO week: the week of 4 January is the first."""
    return F.date_add(F.date_trunc("week", F.make_date(year, F.lit(1), F.lit(4))).cast("date"), (week - 1) * 7)


def week_from_label(label: Column) -> Column:
    """Monday of a week written 2026-W07, 2026_07, 202607 or W07/2026; null for anything else or weeks beyond 53."""
    forward = F.regexp_extract(label, r"^\s*(\d{4})[-_ ]?[Ww]?(\d{1,2})\s*$", 1), F.regexp_extract(label, r"^\s*(\d{4})[-_ ]?[Ww]?(\d{1,2})\s*$", 2)
    backward = F.regexp_extract(label, r"^\s*(?:KW|[Ww])?\s*(\d{1,2})[-_/ ](\d{4})\s*$", 2), F.regexp_extract(label, r"^\s*(?:KW|[Ww])?\s*(\d{1,2})[-_/ ](\d{4})\s*$", 1)
    year = F.coalesce(F.nullif(forward[0], F.lit("")), F.nullif(backward[0], F.lit(""))).cast("int")
    week = F.coalesce(F.nullif(forward[1], F.lit("")), F.nullif(backward[1], F.lit(""))).cast("int")
    return F.when(week.between(1, 53), iso_week_start(year, week))


def number_from_text(text: Column) -> Column:
    """A number with either mark as decimal: with both marks the last one is; a lone comma is decimal."""
    bare = F.regexp_replace(F.trim(text), r"[\s€%]", "")
    comma, dot = F.instr(F.reverse(bare), ","), F.instr(F.reverse(bare), ".")
    plain = (
        F.when((comma > 0) & (dot > 0) & (comma < dot), F.regexp_replace(F.regexp_replace(bare, r"\.", ""), ",", "."))
        .when((comma > 0) & (dot > 0), F.regexp_replace(bare, ",", ""))
        .when(comma > 0, F.regexp_replace(bare, ",", "."))
        .otherwise(bare)
    )
    return plain.try_cast("double")


def iso_week_distance(a: Column, b: Column) -> Column:
    """Weeks between two weeks of the year, round a year of 52."""
    apart = F.abs(a - b)
    return F.least(apart, F.abs(52 - apart))


def code(text: Column, digits: int) -> Column:
    """Digits only, without a trailing .0, padded or cut on the left."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(text.cast("string")), r"\.0$", ""), r"\D", "")
    return F.when(bare != "", F.right(F.lpad(bare, 32, "0"), F.lit(digits)))


def slug(text: Column, mark: str = "_") -> Column:
    """Lower-case letters and digits, everything between them one mark."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"[^a-z0-9]+", mark), f"^{mark}+|{mark}+$", "")


def amount_from_text(text: Column) -> Column:
    """An amount of money, rounded to cents; null for anything else and for amounts below zero.

    With both marks the last one is decimal and the other groups thousands. A lone comma is decimal where two digits at
    most follow, else it groups; one dot groups where three digits follow, and several dots always do.
    """
    bare = F.regexp_replace(text, r"[€\s]", "")
    comma, dot = F.instr(F.reverse(bare), ","), F.instr(F.reverse(bare), ".")
    without = lambda mark: F.regexp_replace(bare, mark, "")
    plain = (
        F.when((comma > 0) & (dot > 0) & (comma < dot), F.regexp_replace(without(r"\."), ",", "."))
        .when((comma > 0) & (dot > 0), without(","))
        .when(bare.rlike(r",[0-9]{1,2}$"), F.regexp_replace(bare, ",", "."))
        .when(comma > 0, without(","))
        .when(bare.rlike(r"^[0-9]+\.[0-9]{3}$") | bare.rlike(r"^[0-9]+(?:\.[0-9]+){2,}$"), without(r"\."))
        .otherwise(bare)
    )
    return F.round(F.when(plain.rlike(r"^\+?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"), plain.try_cast("double")), 2)
