"""Report-dialect queries (R1-R8)."""

from __future__ import annotations

from ..operators import report as R
from ..operators.summary import summary_kpis
from .catalog import bookings, money_mean_sql, money_total_sql, month_sql, register, revenue


def _report(spark, sf_dir):
    """The report's tables; each is planned when it is asked for."""
    return R.generate_report(bookings(spark, sf_dir), revenue(spark, sf_dir))


@register("report_monthly_bookings", f"""
SELECT month, COUNT(product_name) AS total_bookings,
       {money_mean_sql('calculated_price')} AS avg_revenue,
       {money_total_sql('calculated_price')} AS total_revenue
FROM (SELECT {month_sql('booking_start_time')} AS month, product_name, calculated_price
      FROM bookings) t
WHERE month IS NOT NULL
GROUP BY month""")
def report_monthly_bookings(spark, sf_dir):
    return _report(spark, sf_dir)["monthly_bookings"]


@register("report_monthly_revenue", f"""
SELECT month, {money_total_sql('price')} AS total_revenue, {money_mean_sql('price')} AS avg_price
FROM (SELECT {month_sql('created_at')} AS month, price FROM revenue) t
WHERE month IS NOT NULL
GROUP BY month""")
def report_monthly_revenue(spark, sf_dir):
    return _report(spark, sf_dir)["monthly_revenue"]


def _room_util_sql(hours: int, pricing: bool, where: str = "") -> str:
    pct = ("CAST(total_booked_minutes AS DOUBLE) / CAST(available_minutes AS DOUBLE) * 100.0")
    price_col = (f""",
       CASE WHEN {pct} < {R.LOW_UTILIZATION_PCT} THEN '{R.DISCOUNT_TEXT}'
            WHEN {pct} > {R.HIGH_UTILIZATION_PCT} THEN '{R.INCREASE_TEXT}'
            ELSE '{R.STABLE_TEXT}' END AS pricing_recommendation""" if pricing else "")
    sql = f"""
SELECT month, product_name, total_booked_minutes, days_in_month, available_minutes,
       {pct} AS utilization_pct{price_col}
FROM (SELECT month, product_name, CAST(SUM(mins) AS BIGINT) AS total_booked_minutes,
             CAST(day(last_day(month)) AS BIGINT) AS days_in_month,
             CAST(day(last_day(month)) AS BIGINT) * {hours * 60} AS available_minutes
      FROM (SELECT {month_sql('booking_start_time')} AS month, product_name,
                   COALESCE(duration_in_mins, 0) AS mins FROM bookings) b
      WHERE month IS NOT NULL AND product_name IS NOT NULL
      GROUP BY month, product_name) u"""
    if where:
        sql += f"\nWHERE {pct} {where}"
    return sql


@register("report_room_utilization", _room_util_sql(9, True))
def report_room_utilization(spark, sf_dir):
    return _report(spark, sf_dir)["room_utilization"]


@register("report_underutilized", _room_util_sql(9, False, "< 30"))
def report_underutilized(spark, sf_dir):
    return _report(spark, sf_dir)["underutilized"]


@register("report_room_utilization_12h", _room_util_sql(12, True))
def report_room_utilization_12h(spark, sf_dir):
    return R.report_room_utilization(bookings(spark, sf_dir), availability_hours_per_day=12)


@register("report_top_tenants", f"""
SELECT enterprise_name, COUNT(product_name) AS bookings,
       {money_total_sql('calculated_price')} AS revenue
FROM bookings WHERE enterprise_name IS NOT NULL
GROUP BY enterprise_name
ORDER BY revenue DESC, enterprise_name ASC
LIMIT 10""")
def report_top_tenants(spark, sf_dir):
    return _report(spark, sf_dir)["top_tenants"]


@register("report_top_products", f"""
SELECT product_name, {money_total_sql('price')} AS total_revenue,
       {money_mean_sql('price')} AS avg_price, COUNT(product_name) AS transactions
FROM revenue WHERE product_name IS NOT NULL
GROUP BY product_name
ORDER BY total_revenue DESC, product_name ASC
LIMIT 10""")
def report_top_products(spark, sf_dir):
    return _report(spark, sf_dir)["top_products"]


_ROI_SQL = f"""
SELECT product_name, {money_mean_sql('rate')} AS avg_revenue_per_minute,
       {money_total_sql('calculated_price')} AS total_revenue
FROM (SELECT product_name, calculated_price,
             CAST(calculated_price AS DOUBLE)
               / CAST(NULLIF(COALESCE(duration_in_mins, 0), 0) AS DOUBLE) AS rate
      FROM bookings) t
WHERE product_name IS NOT NULL
GROUP BY product_name
ORDER BY avg_revenue_per_minute DESC NULLS LAST, product_name ASC
LIMIT 10"""


@register("report_roi_products", _ROI_SQL, rounded=("avg_revenue_per_minute",))
def report_roi_products(spark, sf_dir):
    return _report(spark, sf_dir)["roi_products"]


# --- the whole report, each input read once (C5) ---------------------------------

def _report_kpi_sql() -> str:
    from .forecast_plans import _REVENUE_SERIES_SQL, _booking_series_sql, forecast_sql

    part = f"FROM (SELECT {month_sql('booking_start_time')} AS month, * FROM bookings) t"
    sqls = {
        "monthly_bookings": f"SELECT {money_total_sql('calculated_price')} AS total_revenue {part} "
                            "WHERE month IS NOT NULL GROUP BY month",
        "monthly_revenue": f"SELECT {money_total_sql('price')} AS total_revenue FROM (SELECT "
                           f"{month_sql('created_at')} AS month, price FROM revenue) t WHERE month IS NOT NULL GROUP BY month",
        "room_utilization": _room_util_sql(9, True),
        "top_tenants": f"SELECT {money_total_sql('calculated_price')} AS revenue FROM bookings "
                       "WHERE enterprise_name IS NOT NULL GROUP BY enterprise_name ORDER BY revenue DESC LIMIT 10",
        "top_products": f"SELECT {money_total_sql('price')} AS total_revenue FROM revenue "
                        "WHERE product_name IS NOT NULL GROUP BY product_name ORDER BY total_revenue DESC LIMIT 10",
        "forecast_bookings": forecast_sql(_booking_series_sql("room_id"), ["room_id"], 3),
        "forecast_revenue": forecast_sql(_REVENUE_SERIES_SQL, [], 12),
        "underutilized": _room_util_sql(9, False, "< 30"),
        "roi_products": _ROI_SQL,
    }
    return "\nUNION ALL\n".join(
        f"SELECT '{name}' AS table_name, COUNT(*) AS rows, '{R.REPORT_MEASURES[name]}' AS measure, "
        f"{money_total_sql(R.REPORT_MEASURES[name])} AS measure_total FROM ({sql}) t" for name, sql in sqls.items())


@register("report_kpis", _report_kpi_sql(), rounded=("measure_total",), digits=0)
def report_kpis(spark, sf_dir):
    return summary_kpis(R.report_in_one_pass(bookings(spark, sf_dir), revenue(spark, sf_dir)), R.REPORT_MEASURES)
