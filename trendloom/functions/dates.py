"""Months and days."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_of(ts: Column) -> Column:
    return F.trunc(F.to_date(ts), "MM")


def month_of_serial(serial: Column) -> Column:
    """Month of a spreadsheet's day number, counted from 1899-12-30: 43466 is in 2019-01."""
    return F.trunc(F.date_add(F.lit("1899-12-30").cast("date"), serial.try_cast("double").cast("int")), "MM")


def period_start(period: Column) -> Column:
    """First day of 'yyyy-MM'; of 'yyyy', its January."""
    return F.to_date(F.when(F.char_length(period) == 4, F.concat(period, F.lit("-01"))).otherwise(period), "yyyy-MM")


def since(ts: Column, as_of: Column, days: int, most: int = 90) -> Column:
    """Whether ts is less than days before as_of, of which at most ``most`` count."""
    return ts > as_of - F.make_dt_interval(F.lit(min(days, most)))


def season(month: Column) -> list[Column]:
    angle = 2 * F.pi() * F.month(month) / 12
    return [F.sin(angle).alias("month_sin"), F.cos(angle).alias("month_cos")]
