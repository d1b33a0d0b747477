"""Date parsing and period columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: accepted layouts, day first
DAY_FIRST_FORMATS = ["d/M/yyyy", "d-M-yyyy", "d.M.yyyy", "yyyy-M-d", "d MMM yyyy", "d MMMM yyyy",
                     "yyyy/M/d", "MMM d, yyyy", "MMMM d, yyyy", "MMM d yyyy", "MMMM d yyyy", "d/M/yy", "d-M-yy", "d.M.yy"]
ISO_TIME = r"^\s*(\d{4}-\d{1,2}-\d{1,2})[T ]\d{1,2}:\d{2}.*$"


def parse_day_first(text: Column) -> Column:
    """Day-first date text to DATE; text that fits no layout becomes null (also under ANSI mode). Of an ISO
    timestamp the date as written counts."""
    day = F.regexp_replace(F.trim(text), ISO_TIME, "$1")
    tries = [F.try_to_timestamp(day, F.lit(f)) for f in DAY_FIRST_FORMATS]
    return F.coalesce(*tries).cast("date")


def year_month(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def month_label(ts: Column) -> Column:
    return F.date_format(ts, "MMM yyyy")


def months_before(ts: Column, months: int = 6) -> Column:
    return F.add_months(ts.cast("date"), -months)
