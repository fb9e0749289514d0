"""Date helpers (C7, C9, C11, C12) as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.columns import SERIAL_DATE_ORIGIN


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fiscal_year(d) -> Column:
    """Federal fiscal year (Oct-Sep): ``year + (month >= 10)``; NULL stays NULL."""
    d = _c(d)
    return (F.year(d) + (F.month(d) >= 10).cast("int")).cast("int")


def serial_number(x) -> Column:
    """A text cell's spreadsheet serial day number; NULL unless it is a number from 0 up to the last
    day of the year 9999 (so NaN, infinities and other junk numbers are NULL)."""
    num = _c(x).try_cast("double")
    return F.when((num >= 0) & (num < 2958466), num)


def serial_to_date(x) -> Column:
    """A spreadsheet serial day number (days since 1899-12-30, fraction dropped)
    or an ISO text date -> DATE. Unparseable or out of the calendar -> NULL."""
    x = _c(x).cast("string")
    num = serial_number(x)
    from_serial = F.date_add(F.lit(SERIAL_DATE_ORIGIN).cast("date"), F.floor(num).cast("int"))
    from_text = F.coalesce(F.try_to_date(x, "yyyy-MM-dd"), F.try_to_date(x, "yyyy/MM/dd"),
                           F.to_date(F.try_to_timestamp(x, F.lit("yyyy-MM-dd HH:mm:ss"))))
    return F.when(num.isNotNull(), from_serial).when(x.try_cast("double").isNull(), from_text)


def days_before(v, n: int) -> Column:
    """C11: ``v - n days`` (inclusive lower bound of a look-back window)."""
    return F.date_sub(_c(v), n)


def add_months_rolling(start, months) -> Column:
    """C12 step: ``start + months`` where an invalid day rolls into the next month
    (Nov 30 + 3 months = Mar 2), unlike Spark's ``add_months`` which clamps."""
    start = _c(start)
    first = F.add_months(F.trunc(start, "MM"), months)
    return F.date_add(first, F.dayofmonth(start) - 1)


def quarter_sequence(bounds: DataFrame, start_col: str = "start", end_col: str = "end",
                     out: str = "quarter", step_months: int = 3) -> DataFrame:
    """One row per date ``start + 3i months`` (rolling) that is <= ``end``.

    ``bounds`` holds one row (an aggregate); the explode is bounded by the span in
    quarters, so this never scans data.
    """
    n = F.floor(F.months_between(F.col(end_col), F.col(start_col)) / step_months).cast("int") + 1
    steps = bounds.select(F.col(start_col), F.col(end_col),
                          F.explode(F.sequence(F.lit(0), F.greatest(n, F.lit(0)))).alias("_i"))
    d = add_months_rolling(F.col(start_col), F.col("_i") * step_months)
    return (steps.select(d.alias(out), F.col(end_col))
                 .filter(F.col(out) <= F.col(end_col)).select(out))
