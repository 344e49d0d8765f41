"""Time expressions on wall-clock (``timestamp_ntz``) values.

Everything here is a native Column expression (whole-stage codegen, no
Python per row) and independent of the session time zone: day and month
starts go through ``date``; differences are whole days (``datediff`` on
dates) plus microseconds of the day built from the clock fields, which are
read from ``timestamp_ntz`` without any zone. (``timestamp_diff`` would cast
to a session-zone timestamp first and shift wall-clock spans across DST.)
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, NumericType, StringType, TimestampNTZType

MICROS_PER_MINUTE = 60_000_000
MICROS_PER_HOUR = 3_600_000_000
MICROS_PER_DAY = 86_400_000_000
EPOCH_DATE = "1970-01-01"


def to_wall_clock(c: Column, dtype: DataType | None = None) -> Column:
    """Coerce a date-like column to ``timestamp_ntz``.

    Strings are parsed (an unparseable value raises under ANSI mode, like the
    original's strict parse); numeric columns are rejected by the caller
    because their unit is ambiguous.
    """
    if dtype is not None and isinstance(dtype, NumericType):
        raise ValueError("numeric date columns are not accepted; cast them to timestamps first")
    if isinstance(dtype, TimestampNTZType):
        return c
    parsed = c.cast("timestamp_ntz")
    if isinstance(dtype, StringType):
        # also fail without ANSI mode, where the cast alone would give NULL
        return F.when(c.isNotNull() & parsed.isNull(),
                      F.raise_error(F.concat(F.lit("unparseable date: "), c))).otherwise(parsed)
    return parsed


def month_start(ts: Column) -> Column:
    """First instant of the month of ``ts`` as ``timestamp_ntz``."""
    return F.trunc(ts.cast("date"), "MM").cast("timestamp_ntz")


def days_in_month(month: Column) -> Column:
    return F.dayofmonth(F.last_day(month.cast("date")))


def second_micros(ts: Column) -> Column:
    """Microseconds of the minute (seconds with fraction), as bigint."""
    return (F.date_part(F.lit("SECOND"), ts) * F.lit(1_000_000)).cast("bigint")


def micros_of_day(ts: Column) -> Column:
    return (F.hour(ts).cast("bigint") * F.lit(MICROS_PER_HOUR)
            + F.minute(ts).cast("bigint") * F.lit(MICROS_PER_MINUTE) + second_micros(ts))


def days_between(start: Column, end: Column) -> Column:
    return F.datediff(end.cast("date"), start.cast("date")).cast("bigint")


def micros_between(start: Column, end: Column) -> Column:
    """Exact wall-clock microseconds from ``start`` to ``end`` (negative if end < start)."""
    return days_between(start, end) * F.lit(MICROS_PER_DAY) + micros_of_day(end) - micros_of_day(start)


def epoch_micros(ts: Column) -> Column:
    """Wall-clock microseconds since 1970-01-01 00:00 (no zone applied)."""
    return micros_between(F.lit(EPOCH_DATE).cast("timestamp_ntz"), ts)


def hour_of_day_micros(ts: Column, hour: int) -> Column:
    """Time of day (micros) of ``ts`` with the clock set to ``hour``:00:00 and
    the sub-second part kept: ``datetime.replace(hour=h, minute=0, second=0)``."""
    return F.lit(hour * MICROS_PER_HOUR) + F.pmod(second_micros(ts), F.lit(1_000_000))


def future_month_end(last_month: Column, i: Column) -> Column:
    """Month-end ``i`` months after the month of ``last_month`` (i = 0 is its own end)."""
    return F.last_day(F.add_months(last_month.cast("date"), i)).cast("timestamp_ntz")
