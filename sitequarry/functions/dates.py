"""Days: Column -> Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def add_days(day: Column, days) -> Column:
    """ISO date so many days later."""
    return F.date_format(F.date_add(day, days), "yyyy-MM-dd")


def days_between(first: Column, second: Column) -> Column:
    """Whole days from the first to the second, negative if that is earlier; null if either is no date."""
    return F.datediff(second, first).cast("long")


def fresh(checked: Column, today: Column, most: int = 90) -> Column:
    """Whether what was checked that day is at most so many days old, and not from the future; false for no date."""
    return F.coalesce(days_between(checked, today).between(0, most), F.lit(False))
