"""Monthly booking and revenue summaries.

Both are one hash aggregate (map-side partial, one shuffle of
months x keys partial rows). Null grouping keys are dropped, as pandas does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import timecols as T
from ..functions.totals import mean, total


def _wall_clock(df: DataFrame, name: str):
    dtype = {f.name: f.dataType for f in df.schema.fields}[name]
    return T.to_wall_clock(C.col(name), dtype)


def monthly_bookings_and_revenue(bookings: DataFrame) -> DataFrame:
    """Bookings per month (and room, property when present).

    Columns: month, [room_id], [property_id], bookings_count (bigint),
    avg_revenue (double; mean of the resolved price, 0.0 when no price column).
    """
    start = C.require(bookings, C.BOOKING_START, C.NO_START)
    price = C.resolve(bookings, C.BOOKING_PRICE)
    price_col = C.col(price) if price else F.lit(0.0)
    room_cols = C.present(bookings, C.ROOM_KEYS)
    keys = ["month"] + room_cols
    start_col = _wall_clock(bookings, start)
    df = bookings.select(T.month_start(start_col).alias("month"),
                         *[C.col(k) for k in room_cols],
                         start_col.alias("_start"), price_col.alias("_price"))
    return (C.drop_null_keys(df, keys)
            .groupBy(*keys)
            .agg(F.count("_start").alias("bookings_count"),
                 mean(F.col("_price")).alias("avg_revenue")))


def revenue_month(revenue: DataFrame):
    """Month column of a sales table: truncated date, else an existing ``month``."""
    date = C.resolve(revenue, C.REVENUE_DATE)
    if date is not None:
        return T.month_start(_wall_clock(revenue, date))
    if "month" in revenue.columns:
        return _wall_clock(revenue, "month")
    raise ValueError(C.NO_REVENUE_DATE)


def monthly_revenue_summary(revenue: DataFrame) -> DataFrame:
    """Revenue per month: month, total_revenue (0.0 if all null), avg_revenue."""
    month = revenue_month(revenue)
    price = C.require(revenue, C.REVENUE_PRICE, C.NO_REVENUE_PRICE)
    df = revenue.select(month.alias("month"), C.col(price).alias("_price"))
    return (C.drop_null_keys(df, ["month"])
            .groupBy("month")
            .agg(total(F.col("_price")).alias("total_revenue"),
                 mean(F.col("_price")).alias("avg_revenue")))
