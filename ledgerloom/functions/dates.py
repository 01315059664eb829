"""One date parser for all sources: ISO first, then day first; two-figure years turn at 50; the calendar is checked."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_date(c: Column) -> Column:
    """DATE of a text in yyyy-M-d, d-M-yyyy, d-M-yy, d Mon yyyy or ddMMyyyy; separators may be . / - or blank; null otherwise."""
    t = F.regexp_replace(F.trim(c), r"[./\s,-]+", "-")
    two = F.regexp_extract(t, r"^(\d{1,2}-\d{1,2}-)(\d{2})$", 2)
    century = F.when(two.try_cast("int") >= 50, "19").otherwise("20")
    pivot = F.concat(F.regexp_extract(t, r"^(\d{1,2}-\d{1,2}-)(\d{2})$", 1), century, two)
    named = F.concat(F.regexp_extract(t, r"^(\d{1,2})-([A-Za-z]{3})[a-z]*-(\d{4})$", 1), F.lit("-"), F.initcap(F.regexp_extract(t, r"^(\d{1,2})-([A-Za-z]{3})[a-z]*-(\d{4})$", 2)), F.lit("-"), F.regexp_extract(t, r"^(\d{1,2})-([A-Za-z]{3})[a-z]*-(\d{4})$", 3))
    as_day = lambda when, text, shape: F.try_to_timestamp(F.when(when, text), F.lit(shape)).cast("date")
    return F.coalesce(
        as_day(t.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), t, "y-M-d"),
        as_day(t.rlike(r"^\d{1,2}-\d{1,2}-\d{4}$"), t, "d-M-y"),
        as_day(two != "", pivot, "d-M-y"),
        as_day(t.rlike(r"^\d{1,2}-[A-Za-z]{3}[a-z]*-\d{4}$"), named, "d-MMM-y"),
        as_day(t.rlike(r"^\d{8}$"), t, "ddMMyyyy"),
    )


def length_of_stay(admitted: Column, discharged: Column) -> Column:
    """Days in 0..365, else null."""
    days = F.date_diff(discharged, admitted)
    return F.when(days.between(0, 365), days)


def age(dob: Column, on: Column) -> Column:
    """Whole years in 0..120, else null."""
    years = F.floor(F.months_between(on, dob) / 12).cast("int")
    return F.when(years.between(0, 120), years)
