"""The summary bundle (five tables) and its one-table digest."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import timecols as T
from ..functions.grouped import grouped_once
from ..functions.totals import known, mean_of, total, total_of
from .monthly import monthly_bookings_and_revenue, monthly_revenue_summary, revenue_month
from .ranking import top_revenue_products, top_tenants
from .utilization import clipped_micros, utilization_metrics, utilization_of, with_booking_times

# main measure of each summary table
MEASURES = {
    "bookings_monthly": "bookings_count",
    "revenue_monthly": "total_revenue",
    "utilization": "booked_minutes",
    "top_tenants": "total_revenue",
    "top_products": "total_revenue",
}


def summary(bookings: DataFrame, revenue: DataFrame) -> dict[str, DataFrame]:
    """Monthly bookings, monthly revenue, utilization, top tenants, top products."""
    return {
        "bookings_monthly": monthly_bookings_and_revenue(bookings),
        "revenue_monthly": monthly_revenue_summary(revenue),
        "utilization": utilization_metrics(bookings),
        "top_tenants": top_tenants(bookings),
        "top_products": top_revenue_products(revenue),
    }


def summary_in_one_pass(bookings: DataFrame, revenue: DataFrame) -> dict[str, DataFrame]:
    """The tables of :func:`summary` with each input read once: its group-bys are
    grouping sets of one aggregate, written at this call."""
    if C.TENANT not in bookings.columns:
        raise ValueError(C.NO_TENANT)
    b, _ = with_booking_times(bookings)
    price = C.resolve(bookings, C.BOOKING_PRICE)
    rooms = C.present(bookings, C.ROOM_KEYS)
    b = b.select(T.month_start(F.col("_start")).alias("month"), *[C.col(k) for k in rooms], C.col(C.TENANT),
                 F.col("_start"), (C.col(price) if price else F.lit(0.0)).alias("_price"),
                 clipped_micros(F.col("_start"), F.col("_end")).alias("_micros"))
    part = grouped_once(b, {"monthly": ["month", *rooms], "used": ["month", *rooms[:1]], "tenant": [C.TENANT]}, {
        "rows": F.count(F.lit(1)), "starts": F.count("_start"), "sum": F.sum(known(F.col("_price"))),
        "priced": F.count(known(F.col("_price"))), "_micros": F.sum("_micros")}, {
        "rows": F.col("rows"), "starts": F.col("starts"), "total": total_of(F.col("sum")),
        "mean": mean_of(F.col("sum"), F.col("priced")), "_micros": F.col("_micros")})
    sold_for = C.require(revenue, C.REVENUE_PRICE, C.NO_PRICE)
    keys = C.present(revenue, C.PRODUCT_KEYS)
    if not keys:
        raise ValueError(C.NO_PRODUCT)
    counted = "product_name" if "product_name" in keys else sold_for
    r = revenue.select(revenue_month(revenue).alias("month"), *[C.col(k) for k in keys],
                       C.col(sold_for).alias("_price"), C.col(counted).alias("_counted"))
    sold = grouped_once(r, {"month": ["month"], "product": keys}, {
        "sum": F.sum(known(F.col("_price"))), "priced": F.count(known(F.col("_price"))), "count": F.count("_counted")}, {
        "total_revenue": total_of(F.col("sum")), "avg_revenue": mean_of(F.col("sum"), F.col("priced")),
        "count": F.col("count")})
    return {
        "bookings_monthly": part["monthly"].select("month", *rooms, F.col("starts").alias("bookings_count"),
                                                   F.col("mean").alias("avg_revenue")),
        "revenue_monthly": sold["month"].select("month", "total_revenue", "avg_revenue"),
        "utilization": utilization_of(part["used"], ["month", *rooms[:1]]),
        "top_tenants": part["tenant"].select(
            C.TENANT, F.col("rows").alias("booking_count"), F.col("total").alias("total_revenue")).orderBy(
            F.desc("booking_count"), F.desc("total_revenue"), F.asc(C.TENANT)).limit(10),
        "top_products": sold["product"].select(*keys, "total_revenue", "avg_revenue", "count").orderBy(
            F.desc("total_revenue"), *[F.asc(k) for k in keys]).limit(20),
    }


def summary_kpis(tables: Mapping[str, DataFrame], measures: Mapping[str, str] = MEASURES) -> DataFrame:
    """One row per table: table_name, rows, measure, measure_total.

    Each row is one global aggregate of its table (partial aggregates, a
    single row per task reaches the final merge); the five rows are unioned.
    """
    rows = []
    for name, df in tables.items():
        measure = measures[name]
        rows.append(df.agg(F.count(F.lit(1)).alias("rows"),
                           total(F.col(measure)).alias("measure_total"))
                    .select(F.lit(name).alias("table_name"), "rows", F.lit(measure).alias("measure"),
                            "measure_total"))
    return reduce(DataFrame.unionByName, rows)
