"""The nine-table report: its own dialect of the summaries.

Differs from the single operators on purpose: bookings are counted by
product name, utilization is stored duration (no clipping) per month and
product, tenants are ranked by revenue, lists stop at ten, and a pricing
suggestion is attached. Fixed column names: ``booking_start_time``,
``booking_end_time``, ``product_name``, ``calculated_price``,
``enterprise_name`` in bookings; ``created_at``, ``price``, ``product_name``
in revenue; ``duration_in_mins`` is optional.

``generate_report`` builds a table when it is asked for; ``report_in_one_pass``
reads each input once for all nine.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import timecols as T
from ..functions.grouped import grouped_once
from ..functions.totals import known, mean, mean_of, total, total_of

# ---------------------------------------------------------------------------
# Pricing thresholds (exclusive) and suggestion texts.
# ---------------------------------------------------------------------------
LOW_UTILIZATION_PCT = 30
HIGH_UTILIZATION_PCT = 80
DISCOUNT_TEXT = "Consider discounting this room to attract tenants"
INCREASE_TEXT = "Consider increasing price (high demand)"
STABLE_TEXT = "Keep price stable"
# ---------------------------------------------------------------------------


def _parse(df: DataFrame, names: list[str]) -> DataFrame:
    types = {f.name: f.dataType for f in df.schema.fields}
    return df.withColumns({n: T.to_wall_clock(C.col(n), types[n]) for n in names if n in types})


def prepare_bookings(bookings: DataFrame) -> DataFrame:
    b = _parse(bookings, ["booking_start_time", "booking_end_time"])
    return b.withColumn("month", T.month_start(F.col("booking_start_time")))


def prepare_revenue(revenue: DataFrame) -> DataFrame:
    r = _parse(revenue, ["created_at", "event_at"])
    return r.withColumn("month", T.month_start(F.col("created_at")))


def report_monthly_bookings(bookings: DataFrame) -> DataFrame:
    b = prepare_bookings(bookings)
    return (b.where(F.col("month").isNotNull()).groupBy("month")
            .agg(F.count("product_name").alias("total_bookings"),
                 mean(F.col("calculated_price")).alias("avg_revenue"),
                 total(F.col("calculated_price")).alias("total_revenue")))


def report_monthly_revenue(revenue: DataFrame) -> DataFrame:
    r = prepare_revenue(revenue)
    return (r.where(F.col("month").isNotNull()).groupBy("month")
            .agg(total(F.col("price")).alias("total_revenue"),
                 mean(F.col("price")).alias("avg_price")))


def _booked_minutes(b: DataFrame) -> Column:
    if "duration_in_mins" in b.columns:
        return F.coalesce(known(F.col("duration_in_mins")), F.lit(0))
    return F.lit(0)


def pricing_recommendation(pct: Column) -> Column:
    """Suggestion per utilization %; 30 and 80 themselves are 'stable'."""
    return (F.when(pct < LOW_UTILIZATION_PCT, F.lit(DISCOUNT_TEXT))
            .when(pct > HIGH_UTILIZATION_PCT, F.lit(INCREASE_TEXT))
            .otherwise(F.lit(STABLE_TEXT)))


def report_room_utilization(bookings: DataFrame, availability_hours_per_day: int = 9,
                            with_pricing: bool = True) -> DataFrame:
    """Stored minutes per month and product against open minutes.

    Columns: month, product_name, total_booked_minutes, days_in_month,
    available_minutes, utilization_pct[, pricing_recommendation].
    """
    b = prepare_bookings(bookings).withColumn("_booked", _booked_minutes(bookings))
    per_day = availability_hours_per_day * 60
    out = (C.drop_null_keys(b, ["month", "product_name"])
           .groupBy("month", "product_name")
           .agg(F.sum("_booked").alias("total_booked_minutes")))
    return _against_open_minutes(out, per_day, with_pricing)


def _against_open_minutes(booked: DataFrame, per_day: int, with_pricing: bool) -> DataFrame:
    days = T.days_in_month(F.col("month")).cast("bigint")
    out = (booked.withColumn("days_in_month", days)
           .withColumn("available_minutes", F.col("days_in_month") * F.lit(per_day))
           .withColumn("utilization_pct",
                       F.try_divide(F.col("total_booked_minutes").cast("double"),
                                    F.col("available_minutes").cast("double")) * F.lit(100.0)))
    if with_pricing:
        out = out.withColumn("pricing_recommendation", pricing_recommendation(F.col("utilization_pct")))
    return out


def report_underutilized(bookings: DataFrame, availability_hours_per_day: int = 9) -> DataFrame:
    """Utilization rows under 30 %, without the pricing column, unsorted."""
    util = report_room_utilization(bookings, availability_hours_per_day, with_pricing=False)
    return util.where(F.col("utilization_pct") < LOW_UTILIZATION_PCT)


def report_top_tenants(bookings: DataFrame, top_n: int = 10) -> DataFrame:
    b = C.drop_null_keys(bookings, [C.TENANT])
    return (b.groupBy(C.TENANT)
            .agg(F.count("product_name").alias("bookings"),
                 total(F.col("calculated_price")).alias("revenue"))
            .orderBy(F.desc("revenue"), F.asc(C.TENANT))
            .limit(top_n))


def report_top_products(revenue: DataFrame, top_n: int = 10) -> DataFrame:
    r = C.drop_null_keys(revenue, ["product_name"])
    return (r.groupBy("product_name")
            .agg(total(F.col("price")).alias("total_revenue"),
                 mean(F.col("price")).alias("avg_price"),
                 F.count("product_name").alias("transactions"))
            .orderBy(F.desc("total_revenue"), F.asc("product_name"))
            .limit(top_n))


def report_roi_products(bookings: DataFrame, top_n: int = 10) -> DataFrame:
    """Revenue per stored minute by product, from bookings; zero minutes ignored."""
    minutes = _booked_minutes(bookings)
    rate = F.try_divide(F.col("calculated_price").cast("double"),
                        F.when(minutes != 0, minutes).cast("double"))
    b = C.drop_null_keys(bookings.withColumn("_rate", rate), ["product_name"])
    return (b.groupBy("product_name")
            .agg(mean(F.col("_rate")).alias("avg_revenue_per_minute"),
                 total(F.col("calculated_price")).alias("total_revenue"))
            .orderBy(F.desc_nulls_last("avg_revenue_per_minute"), F.asc("product_name"))
            .limit(top_n))


def _or_none(build):
    try:
        return build()
    except (ValueError, KeyError):
        return None


class Report(Mapping):
    """The report's tables by name; each is built when it is first asked for."""

    def __init__(self, builders: dict[str, Callable[[], DataFrame | None]]):
        self._builders, self._built = builders, {}

    def __getitem__(self, name: str) -> DataFrame | None:
        if name not in self._built:
            self._built[name] = self._builders[name]()
        return self._built[name]

    def __iter__(self):
        return iter(self._builders)

    def __len__(self) -> int:
        return len(self._builders)


def generate_report(bookings: DataFrame, revenue: DataFrame,
                    availability_hours_per_day: int = 9) -> Report:
    """All report tables, lazily: asking for one plans that one only. Forecasts that
    cannot be built are None. For all of them :func:`report_in_one_pass` reads less."""
    from .forecast import bookings_forecast, revenue_forecast

    return Report({
        "monthly_bookings": lambda: report_monthly_bookings(bookings),
        "monthly_revenue": lambda: report_monthly_revenue(revenue),
        "room_utilization": lambda: report_room_utilization(bookings, availability_hours_per_day),
        "top_tenants": lambda: report_top_tenants(bookings),
        "top_products": lambda: report_top_products(revenue),
        "forecast_bookings": lambda: _or_none(lambda: bookings_forecast(bookings, months=3)),
        "forecast_revenue": lambda: _or_none(lambda: revenue_forecast(revenue, months=12)),
        "underutilized": lambda: report_underutilized(bookings, availability_hours_per_day),
        "roi_products": lambda: report_roi_products(bookings),
    })


def report_in_one_pass(bookings: DataFrame, revenue: DataFrame,
                       availability_hours_per_day: int = 9) -> dict[str, DataFrame | None]:
    """The tables of :func:`generate_report` with each input read once: its
    group-bys are grouping sets of one aggregate, written at this call, and every
    table is a part of it. Forecasts are fitted to the months found there."""
    from .forecast import forecast_series

    room = "room_id" if "room_id" in bookings.columns else None
    b = prepare_bookings(bookings)
    minutes = _booked_minutes(bookings)
    rate = F.try_divide(F.col("calculated_price").cast("double"), F.when(minutes != 0, minutes).cast("double"))
    price = F.col("calculated_price")
    sets = {"month": ["month"], "month_product": ["month", "product_name"], "tenant": [C.TENANT],
            "product": ["product_name"], "series": [room, "month"] if room else ["month"]}
    # months, products and tenants are keys of some sets: what is counted is a column of its own
    b = b.select("month", "product_name", C.col(C.TENANT), *([room] if room else []), price.alias("_price"),
                 minutes.alias("_booked"), rate.alias("_rate"), F.col("product_name").alias("_product"))
    part = grouped_once(b, sets, {
        "rows": F.count(F.lit(1)), "products": F.count("_product"), "sum": F.sum(known(F.col("_price"))),
        "priced": F.count(known(F.col("_price"))), "booked": F.sum("_booked"), "rates": F.sum(known(F.col("_rate"))),
        "rated": F.count(known(F.col("_rate")))}, {
        "rows": F.col("rows"), "products": F.col("products"), "total": total_of(F.col("sum")),
        "mean": mean_of(F.col("sum"), F.col("priced")), "booked": F.col("booked"),
        "mean_rate": mean_of(F.col("rates"), F.col("rated"))})
    r = prepare_revenue(revenue).select("month", "product_name", F.col("price").alias("_price"),
                                        F.col("product_name").alias("_product"))
    sold = grouped_once(r, {"month": ["month"], "product": ["product_name"]}, {
        "products": F.count("_product"), "sum": F.sum(known(F.col("_price"))),
        "priced": F.count(known(F.col("_price")))}, {
        "products": F.col("products"), "total": total_of(F.col("sum")), "mean": mean_of(F.col("sum"), F.col("priced"))})
    used = _against_open_minutes(part["month_product"].select(
        "month", "product_name", F.col("booked").alias("total_booked_minutes")), availability_hours_per_day * 60, True)
    series = part["series"].select(*([room] if room else []), F.col("month").alias("ds"), F.col("rows").alias("y"))
    return {
        "monthly_bookings": part["month"].select("month", F.col("products").alias("total_bookings"),
                                                 F.col("mean").alias("avg_revenue"), F.col("total").alias("total_revenue")),
        "monthly_revenue": sold["month"].select("month", F.col("total").alias("total_revenue"),
                                                F.col("mean").alias("avg_price")),
        "room_utilization": used,
        "top_tenants": part["tenant"].select(C.TENANT, F.col("products").alias("bookings"), F.col("total").alias(
            "revenue")).orderBy(F.desc("revenue"), F.asc(C.TENANT)).limit(10),
        "top_products": sold["product"].select(
            "product_name", F.col("total").alias("total_revenue"), F.col("mean").alias("avg_price"),
            F.col("products").alias("transactions")).orderBy(F.desc("total_revenue"), F.asc("product_name")).limit(10),
        "forecast_bookings": _or_none(lambda: forecast_series(series, [room] if room else [], periods=3)),
        "forecast_revenue": _or_none(lambda: forecast_series(
            sold["month"].select(F.col("month").alias("ds"), F.col("total").alias("y")), [], periods=12)),
        "underutilized": used.where(F.col("utilization_pct") < LOW_UTILIZATION_PCT).drop("pricing_recommendation"),
        "roi_products": part["product"].select(
            "product_name", F.col("mean_rate").alias("avg_revenue_per_minute"), F.col("total").alias("total_revenue"))
        .orderBy(F.desc_nulls_last("avg_revenue_per_minute"), F.asc("product_name")).limit(10),
    }


# main measure of each report table
REPORT_MEASURES = {
    "monthly_bookings": "total_revenue", "monthly_revenue": "total_revenue",
    "room_utilization": "total_booked_minutes", "top_tenants": "revenue", "top_products": "total_revenue",
    "forecast_bookings": "yhat", "forecast_revenue": "yhat", "underutilized": "total_booked_minutes",
    "roi_products": "total_revenue",
}
