"""Calendar months and days."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_of(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM")


def month_index(month: Column) -> Column:
    """'YYYY-MM' to a number whose neighbours are neighbouring months."""
    return (F.substring(month, 1, 4).cast("int") * 12 + F.substring(month, 6, 2).cast("int")).cast("int")


def month_start(month: Column) -> Column:
    return F.to_date(F.concat(month, F.lit("-01")))


def month_end(month: Column) -> Column:
    return F.last_day(month_start(month))


def in_months(date: Column, months: list[str]) -> Column:
    """Whether a date lies in one of the months, as date ranges: these reach the Parquet scan, a formatted month would not."""
    out = F.lit(False)
    for first, last in map(bounds, months):
        out = out | date.between(F.lit(first), F.lit(last))
    return out


def bounds(month: str) -> tuple[dt.date, dt.date]:
    year, m = int(month[:4]), int(month[5:7])
    after = dt.date(year + m // 12, m % 12 + 1, 1)
    return dt.date(year, m, 1), after - dt.timedelta(days=1)


def close_on_or_after(date: Column, day: Column) -> Column:
    """Month of the billing cycle that a date falls in, for cycles closing on a day of the month (28 at most)."""
    return month_of(F.when(F.dayofmonth(date) <= day, date).otherwise(F.add_months(F.trunc(date, "MM"), 1)))
