"""Dates in text: which of four formats, and whether the day exists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Name, pattern, and the groups of year, month and day; tried in this order.
FORMATS = (
    ("iso", r"^([0-9]{4})-([0-9]{2})-([0-9]{2})([ T].*)?$", (1, 2, 3)),
    ("day_first", r"^([0-9]{2})/([0-9]{2})/([0-9]{4})$", (3, 2, 1)),
    ("month_first", r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})( .*)?$", (3, 1, 2)),
    ("compact", r"^([0-9]{4})([0-9]{2})([0-9]{2})$", (1, 2, 3)),
)
FIRST_YEAR, LAST_YEAR = 1900, 2100


def days_in_month(year: Column, month: Column) -> Column:
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    return F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)


def date_format(c: Column) -> Column:
    """The first of FORMATS that fits, or null."""
    out = F.when(c.isNull() | (c == ""), F.lit(None).cast("string"))
    for name, pattern, _ in FORMATS:
        out = out.when(c.rlike(pattern), name)
    return out


def date_parts(c: Column) -> Column:
    """year, month and day under the first format that fits."""
    def part(which: int) -> Column:
        out = F.when(c.isNull(), F.lit(None).cast("int"))
        for _, pattern, groups in FORMATS:
            out = out.when(c.rlike(pattern), F.regexp_extract(c, pattern, groups[which]).try_cast("int"))
        return out

    return F.struct(part(0).alias("year"), part(1).alias("month"), part(2).alias("day"))


def date_problem(c: Column) -> Column:
    """impossible (no such day), suspicious (year outside 1900 to 2100), or null."""
    p = date_parts(c)
    y, m, d = p["year"], p["month"], p["day"]
    real = (m >= 1) & (m <= 12) & (d >= 1) & (d <= days_in_month(y, m))
    return F.when(date_format(c).isNull(), F.lit(None).cast("string")).when(~real, "impossible").when((y < FIRST_YEAR) | (y > LAST_YEAR), "suspicious")
