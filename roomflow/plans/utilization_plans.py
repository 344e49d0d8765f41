"""Utilization and underutilized-room queries."""

from __future__ import annotations

from ..operators.utilization import recommend_underutilized, utilization_metrics
from .catalog import bookings, clipped_micros_sql, month_sql, register


def _util_sql(keys: list[str], h0: int = 9, h1: int = 18, where: str = "") -> str:
    per_day = (h1 - h0) * 60
    key_sel = "".join(f", {k}" for k in keys)
    key_nn = "".join(f" AND {k} IS NOT NULL" for k in keys)
    booked = "(CAST(COALESCE(SUM(mic), 0) AS DOUBLE) / 60000000.0)"
    avail = f"CAST(day(last_day(month)) * {per_day} AS BIGINT)"
    inner = f"""
SELECT month{key_sel}, {booked} AS booked_minutes, {avail} AS available_minutes,
       100.0 * {booked} / CAST({avail} AS DOUBLE) AS utilization_pct
FROM (SELECT {month_sql('booking_start_time')} AS month{key_sel},
             {clipped_micros_sql('booking_start_time', 'booking_end_time', h0, h1)} AS mic
      FROM bookings) t
WHERE month IS NOT NULL{key_nn}
GROUP BY month{key_sel}"""
    if where:
        return f"SELECT * FROM ({inner}) u WHERE {where}"
    return inner


@register("utilization_by_room", _util_sql(["room_id"]))
def utilization_by_room(spark, sf_dir):
    return utilization_metrics(bookings(spark, sf_dir))


@register("utilization_by_property", _util_sql(["property_id"]))
def utilization_by_property(spark, sf_dir):
    return utilization_metrics(bookings(spark, sf_dir).drop("room_id"))


@register("utilization_overall", _util_sql([]))
def utilization_overall(spark, sf_dir):
    return utilization_metrics(bookings(spark, sf_dir).drop("room_id", "property_id"))


@register("utilization_hours_8_20", _util_sql(["room_id"], 8, 20))
def utilization_hours_8_20(spark, sf_dir):
    return utilization_metrics(bookings(spark, sf_dir), available_start_hour=8,
                               available_end_hour=20)


@register("underutilized_rooms", _util_sql(["room_id"], where="utilization_pct < 30.0"))
def underutilized_rooms(spark, sf_dir):
    return recommend_underutilized(utilization_metrics(bookings(spark, sf_dir)), 30.0)


@register("underutilized_rooms_t12", _util_sql(["room_id"], where="utilization_pct < 12.0"))
def underutilized_rooms_t12(spark, sf_dir):
    return recommend_underutilized(utilization_metrics(bookings(spark, sf_dir)), 12.0)


# Every day of a booking as a row (checking only: the Spark side has a closed form).
_DAILY_SQL = """
SELECT month, room_id, booked_minutes, available_minutes,
       100.0 * booked_minutes / CAST(available_minutes AS DOUBLE) AS utilization_pct
FROM (
  SELECT month, room_id, CAST(COALESCE(SUM(mic), 0) AS DOUBLE) / 60000000.0 AS booked_minutes,
         CAST(day(last_day(month)) * 540 AS BIGINT) AS available_minutes
  FROM (
    SELECT date_trunc('month', d) AS month, room_id, CASE WHEN e IS NOT NULL THEN greatest(
             epoch_us(least(e, d + INTERVAL 18 HOUR)) - epoch_us(greatest(s, d + INTERVAL 9 HOUR)), 0) END AS mic
    FROM (SELECT room_id, booking_start_time AS s, booking_end_time AS e, unnest(generate_series(
            date_trunc('day', booking_start_time),
            CASE WHEN booking_end_time > booking_start_time
                 THEN date_trunc('day', booking_end_time - INTERVAL 1 MICROSECOND)
                 ELSE date_trunc('day', booking_start_time) END, INTERVAL 1 DAY)) AS d FROM bookings) x) y
  WHERE month IS NOT NULL AND room_id IS NOT NULL
  GROUP BY month, room_id) z"""


@register("utilization_daily", _DAILY_SQL)
def utilization_daily(spark, sf_dir):
    return utilization_metrics(bookings(spark, sf_dir), mode="daily")
