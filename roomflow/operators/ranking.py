"""Tenant and product rankings, revenue per minute.

Top-N queries end in ``orderBy(...).limit(n)``, which Spark plans as
TakeOrderedAndProject: each partition keeps its own n best rows and only
those meet in the final merge, so the aggregated key space is never sorted
as a whole. Group keys are appended to the ordering so ties resolve the same
way on every run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import columns as C
from ..functions.totals import mean, total


def _empty(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], StructType([]))


def top_tenants(bookings: DataFrame, top_n: int = 10) -> DataFrame:
    """Tenants by booking count, then revenue: enterprise_name, booking_count, total_revenue."""
    price = C.resolve(bookings, C.BOOKING_PRICE)
    if C.TENANT not in bookings.columns:
        raise ValueError(C.NO_TENANT)
    price_col = C.col(price) if price else F.lit(0.0)
    df = bookings.select(C.col(C.TENANT), price_col.alias("_price"))
    return (C.drop_null_keys(df, [C.TENANT])
            .groupBy(C.TENANT)
            .agg(F.count(C.TENANT).alias("booking_count"),
                 total(F.col("_price")).alias("total_revenue"))
            .orderBy(F.desc("booking_count"), F.desc("total_revenue"), F.asc(C.TENANT))
            .limit(top_n))


def top_revenue_products(revenue: DataFrame, top_n: int = 20) -> DataFrame:
    """Products (name and/or type) by total revenue.

    Columns: [product_name], [product_type], total_revenue, avg_revenue, count.
    ``count`` counts product names; with only a type present it counts prices.
    """
    price = C.require(revenue, C.REVENUE_PRICE, C.NO_PRICE)
    keys = C.present(revenue, C.PRODUCT_KEYS)
    if not keys:
        raise ValueError(C.NO_PRODUCT)
    counted = "product_name" if "product_name" in keys else price
    df = revenue.select(*[C.col(k) for k in keys], C.col(price).alias("_price"),
                        C.col(counted).alias("_counted"))
    return (C.drop_null_keys(df, keys)
            .groupBy(*keys)
            .agg(total(F.col("_price")).alias("total_revenue"),
                 mean(F.col("_price")).alias("avg_revenue"),
                 F.count("_counted").alias("count"))
            .orderBy(F.desc("total_revenue"), *[F.asc(k) for k in keys])
            .limit(top_n))


def high_roi_products(revenue: DataFrame) -> DataFrame:
    """Revenue per minute by product (or room / property when no product).

    With a duration column: product, avg_revenue_per_minute (price over
    duration, zero durations ignored), total_revenue, transactions; sorted by
    the rate, highest first. Without one: product, total_revenue,
    transactions sorted by total. Missing product or price: an empty table.
    All rows are returned (no limit).
    """
    product = C.resolve(revenue, C.ROI_PRODUCT)
    price = C.resolve(revenue, C.REVENUE_PRICE)
    duration = C.resolve(revenue, C.ROI_DURATION)
    if product is None or price is None:
        return _empty(revenue)
    p = C.col(price)
    if duration is not None:
        d = C.col(duration)
        rate = F.try_divide(p.cast("double"), F.when(d != 0, d).cast("double"))
        df = revenue.select(C.col(product), p.alias("_price"), rate.alias("_rate"))
        return (C.drop_null_keys(df, [product])
                .groupBy(product)
                .agg(mean(F.col("_rate")).alias("avg_revenue_per_minute"),
                     total(F.col("_price")).alias("total_revenue"),
                     F.count(product).alias("transactions"))
                .orderBy(F.desc_nulls_last("avg_revenue_per_minute"), F.asc(product)))
    df = revenue.select(C.col(product), p.alias("_price"))
    return (C.drop_null_keys(df, [product])
            .groupBy(product)
            .agg(total(F.col("_price")).alias("total_revenue"),
                 F.count(product).alias("transactions"))
            .orderBy(F.desc("total_revenue"), F.asc(product)))


def product_revenue_rate(revenue: DataFrame) -> DataFrame:
    """Revenue per booked minute by product name/type (price itself when no
    ``booking_minutes`` column): keys, total_revenue, avg_rev_per_min, highest
    rate first. A zero minute count gives a NULL rate rather than infinity.
    """
    price = C.require(revenue, C.REVENUE_PRICE, "price column required")
    p = C.col(price)
    if "booking_minutes" in revenue.columns:
        rate = F.try_divide(p.cast("double"), C.col("booking_minutes").cast("double"))
    else:
        rate = p
    keys = C.present(revenue, C.PRODUCT_KEYS)
    if not keys:
        raise ValueError("product_name or product_type required")
    df = revenue.select(*[C.col(k) for k in keys], p.alias("_price"), rate.alias("_rate"))
    return (C.drop_null_keys(df, keys)
            .groupBy(*keys)
            .agg(total(F.col("_price")).alias("total_revenue"),
                 mean(F.col("_rate")).alias("avg_rev_per_min"))
            .orderBy(F.desc_nulls_last("avg_rev_per_min"), *[F.asc(k) for k in keys]))
