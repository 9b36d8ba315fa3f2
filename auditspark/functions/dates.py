"""Dates as they are printed on documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ascii_digits

# Year first anywhere in a text, or day first with no digit at either side; the same as whole texts.
YEAR_FIRST = r"(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})"
DAY_FIRST = r"(?<!\d)(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})(?!\d)"
WHOLE_YEAR_FIRST = r"^\s*(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})\s*$"
WHOLE_DAY_FIRST = r"^\s*(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})\s*$"
#: Years below are of another calendar and aren't compared.
LEAST_YEAR = 1900
#: A text that is nothing but a date as ISO prints it.
ISO_ONLY = r"^\d{4}-\d{2}-\d{2}\z"


def date_of(year: Column, month: Column, day: Column) -> Column:
    """Null if there is no such day."""
    printed = F.concat(F.lpad(year, 4, "0"), F.lit("-"), F.lpad(month, 2, "0"), F.lit("-"), F.lpad(day, 2, "0"))
    return F.when(F.left(printed, F.lit(4)) != "0000", printed.try_cast("date"))


def parse_date(v: Column) -> Column:
    """The first date in a text. Once a year-first form is found, the other isn't looked for."""
    t = ascii_digits(v)
    part = lambda pattern, i: F.regexp_extract(t, pattern, i)
    first = date_of(part(YEAR_FIRST, 1), part(YEAR_FIRST, 2), part(YEAR_FIRST, 3))
    second = date_of(part(DAY_FIRST, 3), part(DAY_FIRST, 2), part(DAY_FIRST, 1))
    found = F.when(part(YEAR_FIRST, 1) != "", first).when(part(DAY_FIRST, 1) != "", second)
    return F.when(v.rlike(ISO_ONLY), F.when(~v.startswith("0000"), v.try_cast("date"))).otherwise(found)


def swap_day_month(d: Column) -> Column:
    """Null if there is no such month."""
    return F.when(F.dayofmonth(d) <= 12, F.make_date(F.year(d), F.dayofmonth(d), F.month(d)))


def normalize_date(v: Column) -> Column:
    """A whole printed date as yyyy-mm-dd; any other text as it is. Days aren't checked against the calendar."""
    t = ascii_digits(v)
    part = lambda pattern, i: F.regexp_extract(t, pattern, i)

    def iso(y, m, d):
        fits = m.cast("int").between(1, 12) & d.cast("int").between(1, 31)
        return F.when(fits, F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))).otherwise(v)

    first = iso(F.nullif(part(WHOLE_YEAR_FIRST, 1), F.lit("")), F.nullif(part(WHOLE_YEAR_FIRST, 2), F.lit("")), F.nullif(part(WHOLE_YEAR_FIRST, 3), F.lit("")))
    second = iso(F.nullif(part(WHOLE_DAY_FIRST, 3), F.lit("")), F.nullif(part(WHOLE_DAY_FIRST, 2), F.lit("")), F.nullif(part(WHOLE_DAY_FIRST, 1), F.lit("")))
    return F.when(part(WHOLE_YEAR_FIRST, 1) != "", first).when(part(WHOLE_DAY_FIRST, 1) != "", second).otherwise(v)


def printed_forms(v: Column) -> Column:
    """How a date may stand on a page: four separators, five orders."""
    d = parse_date(v)
    orders = [("yyyy", "MM", "dd"), ("dd", "MM", "yyyy"), ("MM", "dd", "yyyy"), ("d", "M", "yyyy"), ("yyyy", "M", "d")]
    forms = [F.date_format(d, s.join(o)) for s in ("/", "-", ".", " ") for o in orders]
    return F.array_distinct(F.array_compact(F.array(*forms)))


def is_iso(v: Column) -> Column:
    """Whether a text begins with a date as yyyy-mm-dd."""
    return F.coalesce(v.rlike(r"^\d{4}-\d{2}-\d{2}"), F.lit(False))
