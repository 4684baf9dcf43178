"""Calendar column functions: bucket flooring and bucket grids.

All are plain Column expressions (JVM side, inside whole-stage codegen).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PERIODS = ("day", "week", "month")

# Seasonal cycle length of the model for each bucket size
# (fixed values that must match the reference).
SEASONS = {"month": 12, "week": 52, "day": 7}


def check_period(period: str) -> str:
    if period not in PERIODS:
        raise ValueError(f"period must be one of {PERIODS}, got {period!r}")
    return period


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def floor_period(date, period: str) -> Column:
    """Start of the bucket holding ``date``.

    Weeks start on Sunday (``dayofweek`` is 1 on Sunday); Spark's own
    ``date_trunc('week')`` would give Monday.
    """
    d = _col(date)
    check_period(period)
    if period == "day":
        return d
    if period == "week":
        return F.date_sub(d, F.dayofweek(d) - 1)
    return F.trunc(d, "MM")


def period_interval(period: str) -> Column:
    check_period(period)
    return {"day": F.expr("INTERVAL 1 DAY"),
            "week": F.expr("INTERVAL 7 DAYS"),
            "month": F.expr("INTERVAL 1 MONTH")}[period]


def bucket_grid(start, stop, period: str) -> Column:
    """Array of bucket starts from ``start`` to ``stop`` (both floored)."""
    return F.sequence(_col(start), _col(stop), period_interval(period))


def month_steps(start, stop) -> Column:
    """Month steps from an arbitrary day, overflowing like calendar
    arithmetic on (year, month+k, day): Jan 31 -> Mar 2/3 -> Mar 31 ...

    k-th element = first of (start's month + k) plus (day(start) - 1)
    days; elements after ``stop`` are dropped.
    """
    s, e = _col(start), _col(stop)
    n = F.months_between(F.trunc(e, "MM"), F.trunc(s, "MM")).cast("int")
    ks = F.sequence(F.lit(0), n + 1)
    steps = F.transform(
        ks, lambda k: F.date_add(F.add_months(F.trunc(s, "MM"), k),
                                 F.dayofmonth(s) - 1))
    return F.filter(steps, lambda d: d <= e)
