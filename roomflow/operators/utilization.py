"""Room utilization against opening hours, and the rule-based recommendation.

Booked minutes per booking are clipped at the two outer ends only: the start
is moved up to opening time on its own day, the end back to closing time on
its own day; nights inside a multi-day booking still count. The month is the
start's month. Minutes are summed as exact microsecond counts (bigint), so
the totals do not depend on partitioning; the one shuffle is the
``groupBy(month, room)`` after a map-side partial aggregate, whose output is
rooms x months rows however large the input is. ``mode='daily'`` counts the open
hours of every day instead, in closed form (no row per day).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import timecols as T


def _check_hours(start_hour: int, end_hour: int) -> None:
    for h in (start_hour, end_hour):
        if not isinstance(h, int) or not 0 <= h <= 23:
            raise ValueError(f"opening hours must be whole hours in 0..23, got {h!r}")


def clipped_micros(start: Column, end: Column, start_hour: int = 9, end_hour: int = 18) -> Column:
    """Microseconds of a booking inside opening hours (outer ends clipped, >= 0).

    NULL when either end is NULL, so it adds nothing to a sum but the group
    of the row still exists.
    """
    _check_hours(start_hour, end_hour)
    # both clipped ends as microseconds of their own day, then add whole days
    s = F.greatest(T.micros_of_day(start), T.hour_of_day_micros(start, start_hour))
    e = F.least(T.micros_of_day(end), T.hour_of_day_micros(end, end_hour))
    diff = T.days_between(start, end) * F.lit(T.MICROS_PER_DAY) + e - s
    return F.when(start.isNotNull() & end.isNotNull(), F.greatest(diff, F.lit(0).cast("bigint")))


def with_booking_times(bookings: DataFrame, need_end: bool = True) -> tuple[DataFrame, str | None]:
    """Add ``_start`` / ``_end`` wall-clock columns resolved by candidate name."""
    start = C.resolve(bookings, C.BOOKING_START)
    end = C.resolve(bookings, C.BOOKING_END) if need_end else None
    if start is None or (need_end and end is None):
        raise ValueError(C.NO_START_END)
    schema = {f.name: f.dataType for f in bookings.schema.fields}
    out = bookings.withColumn("_start", T.to_wall_clock(C.col(start), schema[start]))
    if end is not None:
        out = out.withColumn("_end", T.to_wall_clock(C.col(end), schema[end]))
    return out, end


def open_micros(start: Column, end: Column, start_hour: int = 9, end_hour: int = 18) -> Column:
    """Microseconds of a booking inside the opening hours of every day it touches:
    the open time up to its end less that up to its start, each a whole number of
    days times the day's opening plus the part of the last day. NULL when either end
    is NULL, 0 when the end is not after the start."""
    _check_hours(start_hour, end_hour)
    opening = max(0, end_hour - start_hour) * T.MICROS_PER_HOUR

    def today(ts: Column) -> Column:
        since = T.micros_of_day(ts) - F.lit(start_hour * T.MICROS_PER_HOUR)
        return F.least(F.greatest(since, F.lit(0).cast("bigint")), F.lit(opening).cast("bigint"))

    whole = T.days_between(start, end) * F.lit(opening) + today(end) - today(start)
    return F.when(start.isNotNull() & end.isNotNull(), F.greatest(whole, F.lit(0).cast("bigint")))


def _split_by_month(df: DataFrame, keys: list[str]) -> DataFrame:
    """A row per booking and month it touches, its ends cut at the month's; a booking
    without an end after its start keeps one row, in the month of its start."""
    first = T.month_start(F.col("_start"))
    months = F.greatest(F.lit(0), F.months_between(
        T.month_start(F.col("_end") - F.expr("INTERVAL '0.000001' SECOND")).cast("date"),
        first.cast("date")).cast("int"))
    longer = F.col("_end") > F.col("_start")
    rows = df.select(*[C.col(k) for k in keys], "_start", "_end", first.alias("_first"), F.explode(
        F.when(longer, F.sequence(F.lit(0), months)).otherwise(F.array(F.lit(0)))).alias("_k"))
    month = F.add_months(F.col("_first").cast("date"), F.col("_k")).cast("timestamp_ntz")
    after = F.add_months(F.col("_first").cast("date"), F.col("_k") + 1).cast("timestamp_ntz")
    rows = rows.withColumns({"month": month, "_after": after})
    return rows.select(*[C.col(k) for k in keys], "month", F.greatest("_start", "month").alias("_start"),
                       F.when(F.col("_end").isNotNull(), F.least("_end", "_after")).alias("_end"))


def utilization_metrics(bookings: DataFrame, available_start_hour: int = 9,
                        available_end_hour: int = 18, mode: str = "endpoints") -> DataFrame:
    """Utilization % per month and room (else property, else month only).

    Columns: month, [room_id | property_id], booked_minutes (double),
    available_minutes (bigint), utilization_pct (double). The denominator is
    one room's opening minutes in that month, for every grouping.

    ``mode``: 'endpoints' clips the two outer ends only and puts a booking into the
    month of its start (the original's rule); 'daily' counts the opening hours of
    every day and puts each part of a booking into its own month.
    """
    if mode not in ("endpoints", "daily"):
        raise ValueError("mode must be 'endpoints' or 'daily'")
    df, _ = with_booking_times(bookings)
    group_key = C.present(df, ["room_id"]) or C.present(df, ["property_id"])
    keys = ["month"] + group_key
    hours = (available_start_hour, available_end_hour)
    if mode == "daily":
        per_row = _split_by_month(df, group_key).select(
            *keys, open_micros(F.col("_start"), F.col("_end"), *hours).alias("_micros"))
    else:
        per_row = df.select(
            T.month_start(F.col("_start")).alias("month"),
            *[C.col(k) for k in group_key],
            clipped_micros(F.col("_start"), F.col("_end"), *hours).alias("_micros"))
    booked = (C.drop_null_keys(per_row, keys)
              .groupBy(*keys)
              .agg(F.sum("_micros").alias("_micros")))
    return utilization_of(booked, keys, *hours)


def utilization_of(booked: DataFrame, keys: list[str], available_start_hour: int = 9,
                   available_end_hour: int = 18) -> DataFrame:
    """Utilization columns of groups with their booked microseconds ``_micros``."""
    per_day = (available_end_hour - available_start_hour) * 60
    available = (T.days_in_month(F.col("month")) * F.lit(per_day)).cast("bigint")
    booked_minutes = F.coalesce(F.col("_micros"), F.lit(0)).cast("double") / F.lit(
        float(T.MICROS_PER_MINUTE))
    return (booked
            .withColumn("booked_minutes", booked_minutes)
            .withColumn("available_minutes", available)
            .withColumn("utilization_pct", F.try_divide(F.lit(100.0) * F.col("booked_minutes"),
                                                         F.col("available_minutes").cast("double")))
            .select(*keys, "booked_minutes", "available_minutes", "utilization_pct"))


def recommend_underutilized(util_df: DataFrame, threshold_pct: float = 30.0) -> DataFrame:
    """Rows of a utilization table under ``threshold_pct``, lowest first.

    Ties are broken by the remaining columns so the order is reproducible.
    """
    under = util_df.filter(F.col("utilization_pct") < F.lit(float(threshold_pct)))
    rest = [c for c in under.columns if c != "utilization_pct"]
    return under.orderBy(F.col("utilization_pct").asc_nulls_last(),
                         *[F.col(c).asc_nulls_last() for c in rest])
