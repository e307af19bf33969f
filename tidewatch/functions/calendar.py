"""New York exchange clock as column expressions (UTC wall-clock timestamps in, same out)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

NY = "America/New_York"
OPEN_MINUTE, CLOSE_MINUTE = 9 * 60 + 30, 16 * 60

# Full-day exchange closures 2024-2027 (New York dates).
FULL_CLOSURES = (
    "2024-01-01", "2024-01-15", "2024-02-19", "2024-03-29", "2024-05-27", "2024-06-19", "2024-07-04", "2024-09-02", "2024-11-28", "2024-12-25",
    "2025-01-01", "2025-01-09", "2025-01-20", "2025-02-17", "2025-04-18", "2025-05-26", "2025-06-19", "2025-07-04", "2025-09-01", "2025-11-27", "2025-12-25",
    "2026-01-01", "2026-01-19", "2026-02-16", "2026-04-03", "2026-05-25", "2026-06-19", "2026-07-03", "2026-09-07", "2026-11-26", "2026-12-25",
    "2027-01-01", "2027-01-18", "2027-02-15", "2027-03-26", "2027-05-31", "2027-06-18", "2027-07-05", "2027-09-06", "2027-11-25", "2027-12-24",
)


def ny_time(ts: Column) -> Column:
    return F.from_utc_timestamp(ts, NY)


def ny_date(ts: Column) -> Column:
    return F.to_date(ny_time(ts))


def _trading_day(day: Column, closures: Sequence[str]) -> Column:
    return ~F.dayofweek(day).isin(1, 7) & ~F.date_format(day, "yyyy-MM-dd").isin(*closures)


def is_closure(ts: Column, closures: Sequence[str] = FULL_CLOSURES) -> Column:
    """True when the New York date of ``ts`` is a full closure."""
    return F.date_format(ny_date(ts), "yyyy-MM-dd").isin(*closures)


def _minute_of_day(local: Column) -> Column:
    return F.hour(local) * 60 + F.minute(local)


def is_open(ts: Column, closures: Sequence[str] = FULL_CLOSURES) -> Column:
    """Regular session test: trading weekday, no closure, 09:30 <= minute < 16:00."""
    local = ny_time(ts)
    minute = _minute_of_day(local)
    return _trading_day(F.to_date(local), closures) & (minute >= OPEN_MINUTE) & (minute < CLOSE_MINUTE)


def effective_start(ts: Column, closures: Sequence[str] = FULL_CLOSURES) -> Column:
    """``ts`` when the exchange is open, else the next 09:30 keeping seconds and fraction.

    Null when ``closures`` leaves no session within the next 31 days.  Years without closures in the list count
    weekends only; pass the closures of the years in use.
    """
    local = ny_time(ts)
    day = F.to_date(local)
    first = F.when(_minute_of_day(local) < OPEN_MINUTE, 0).otherwise(1)
    session = F.get(
        F.filter(F.sequence(F.date_add(day, first), F.date_add(day, 31)), lambda d: _trading_day(d, closures)), F.lit(0)
    )
    opening = F.to_utc_timestamp(session.cast("timestamp") + F.expr("INTERVAL 570 MINUTE"), NY)
    fraction = ts.cast("timestamp") - F.date_trunc("minute", ts.cast("timestamp"))
    moved = opening + fraction
    return F.when(is_open(ts, closures), ts.cast("timestamp")).otherwise(moved).cast("timestamp_ntz")


def last_trading_day(day: Column) -> Column:
    """Weekend dates move back to Friday; closures are not considered."""
    back = F.when(F.dayofweek(day) == 1, 2).when(F.dayofweek(day) == 7, 1).otherwise(0)
    return F.date_sub(day, back)


def days_to_expiry(expiry: Column, now: Column) -> Column:
    """Ceiling of the days from ``now`` to midnight UTC of ``expiry``."""
    us = F.unix_micros(expiry.cast("timestamp")) - F.unix_micros(now.cast("timestamp"))
    return F.ceil(us / F.lit(86_400_000_000)).cast("int")
