"""Forecast queries (FC1-FC3, the column-list sink K2, report forecasts R9)."""

from __future__ import annotations

from ..operators import forecast as FC
from ..operators.monthly import monthly_revenue_summary
from ..operators.report import generate_report
from .catalog import bookings, money_mean_sql, money_total_sql, month_sql, register, revenue


def forecast_sql(series_sql: str, keys: list[str], periods: int, interval_width: float = 0.8,
                 seasonality: str | bool = "auto", key_out: str | None = None) -> str:
    """DuckDB text of ``forecast_series`` over a series query (keys, ds, y)."""
    z = FC.interval_z(interval_width)
    ks = keys or ["_k"]
    kcols = ", ".join(ks)
    kdef = "" if keys else ", 0 AS _k"
    using = f"USING ({kcols})"
    if seasonality == "auto":
        season_on = (f"date_diff('day', CAST(min_ds AS DATE), CAST(max_ds AS DATE)) "
                     f">= {FC.SEASON_MIN_SPAN_DAYS}")
    else:
        season_on = "TRUE" if seasonality else "FALSE"
    if key_out:
        out_keys = f"{key_out}, "
    else:
        out_keys = (", ".join(keys) + ", ") if keys else ""
    nn = "".join(f" AND {k} IS NOT NULL" for k in keys)
    dx = f"(date_diff('day', DATE '{FC.EPOCH}', CAST(pts.ds AS DATE)) - fit.xbar)"
    return f"""
WITH series AS ({series_sql}),
s AS (SELECT *{kdef}, date_diff('day', DATE '{FC.EPOCH}', CAST(ds AS DATE)) AS x,
             month(CAST(ds AS DATE) + 1) AS m
      FROM series WHERE ds IS NOT NULL{nn}),
fit AS (SELECT {kcols}, regr_count(y, x) AS n, regr_slope(y, x) AS b, regr_avgy(y, x) AS ybar,
               regr_avgx(y, x) AS xbar, regr_sxx(y, x) AS sxx, min(ds) AS min_ds, max(ds) AS max_ds
        FROM s GROUP BY {kcols} HAVING regr_count(y, x) >= 2),
r AS (SELECT s.*, y - (ybar + b * (x - xbar)) AS resid, {season_on} AS season_on
      FROM s JOIN fit {using} WHERE y IS NOT NULL),
sea AS (SELECT {kcols}, m, CASE WHEN season_on THEN avg(resid) ELSE 0.0 END AS season
        FROM r GROUP BY {kcols}, m, season_on),
sig AS (SELECT {kcols}, sqrt(sum((resid - season) * (resid - season)) / count(*)) AS sigma
        FROM r JOIN sea {using.replace(')', ', m)')} GROUP BY {kcols}),
pts AS (SELECT {kcols}, ds FROM s JOIN fit {using}
        UNION ALL
        SELECT {kcols}, CAST(last_day(CAST(max_ds AS DATE) + to_months(t.i)) AS TIMESTAMP) AS ds
        FROM fit CROSS JOIN range(0, {periods}) AS t(i)),
f AS (SELECT pts.*, fit.ybar + fit.b * {dx} + COALESCE(sea.season, 0.0) AS yhat,
             CAST('{z!r}' AS DOUBLE) * sig.sigma * sqrt(1.0 + 1.0 / fit.n + {dx} * {dx} / fit.sxx) AS half
      FROM pts JOIN fit {using} JOIN sig {using}
      LEFT JOIN sea ON {' AND '.join(f'sea.{k} = pts.{k}' for k in ks)}
                   AND sea.m = month(CAST(pts.ds AS DATE) + 1))
SELECT {out_keys}ds, yhat, yhat - half AS yhat_lower, yhat + half AS yhat_upper FROM f"""


POINTS = ("yhat", "yhat_lower", "yhat_upper")


def _booking_series_sql(key: str | None) -> str:
    k = f"{key}, " if key else ""
    return (f"SELECT {k}ds, COUNT(*) AS y FROM (SELECT {k}{month_sql('booking_start_time')} AS ds "
            f"FROM bookings) b GROUP BY {k}ds")


_REVENUE_SERIES_SQL = (f"SELECT ds, {money_total_sql('price')} AS y FROM "
                       f"(SELECT {month_sql('created_at')} AS ds, price FROM revenue) r GROUP BY ds")


@register("bookings_forecast_by_room", forecast_sql(_booking_series_sql("room_id"), ["room_id"], 3), rounded=POINTS)
def bookings_forecast_by_room(spark, sf_dir):
    return FC.bookings_forecast(bookings(spark, sf_dir), months=3)


@register("bookings_forecast_by_property",
          forecast_sql(_booking_series_sql("property_id"), ["property_id"], 6), rounded=POINTS)
def bookings_forecast_by_property(spark, sf_dir):
    return FC.bookings_forecast(bookings(spark, sf_dir), months=6, group_by="property_id")


@register("bookings_forecast_overall", forecast_sql(_booking_series_sql(None), [], 3), rounded=POINTS)
def bookings_forecast_overall(spark, sf_dir):
    return FC.bookings_forecast(bookings(spark, sf_dir).drop("room_id"), months=3)


@register("revenue_forecast", forecast_sql(_REVENUE_SERIES_SQL, [], 12), rounded=POINTS, digits=1)
def revenue_forecast(spark, sf_dir):
    return FC.revenue_forecast(revenue(spark, sf_dir), months=12)


@register("forecast_series", forecast_sql(
    f"SELECT month AS ds, {money_mean_sql('price')} AS y FROM "
    f"(SELECT {month_sql('created_at')} AS month, price FROM revenue) r "
    f"WHERE month IS NOT NULL GROUP BY month", [], 12, 0.9, False), rounded=POINTS, digits=4)
def forecast_series(spark, sf_dir):
    # A user series: average sale per month, no season, 90 % band.
    series = monthly_revenue_summary(revenue(spark, sf_dir))
    return FC.forecast_series(series, [], periods=12, interval_width=0.9, seasonality=False,
                              date_col="month", value_col="avg_revenue")


@register("forecast_as_arrays", forecast_sql(_booking_series_sql("room_id"), ["room_id"], 3,
                                             key_out="CAST(room_id AS VARCHAR) AS key"), rounded=POINTS)
def forecast_as_arrays(spark, sf_dir):
    # Column-list sink, checked after the round trip back to rows.
    fc = FC.bookings_forecast(bookings(spark, sf_dir), months=3)
    return FC.arrays_to_rows(FC.forecast_as_arrays(fc, ["room_id"]))


@register("report_forecast_bookings", forecast_sql(_booking_series_sql("room_id"), ["room_id"], 3), rounded=POINTS)
def report_forecast_bookings(spark, sf_dir):
    return generate_report(bookings(spark, sf_dir), revenue(spark, sf_dir))["forecast_bookings"]


@register("report_forecast_revenue", forecast_sql(_REVENUE_SERIES_SQL, [], 12), rounded=POINTS, digits=1)
def report_forecast_revenue(spark, sf_dir):
    return generate_report(bookings(spark, sf_dir), revenue(spark, sf_dir))["forecast_revenue"]


@register("forecast_user_model", f"""
WITH series AS ({_booking_series_sql("room_id")}),
s AS (SELECT *, date_diff('day', DATE '{FC.EPOCH}', CAST(ds AS DATE)) AS x
      FROM series WHERE ds IS NOT NULL AND room_id IS NOT NULL),
fit AS (SELECT room_id, regr_slope(y, x) AS b, regr_avgy(y, x) AS ybar, regr_avgx(y, x) AS xbar,
               sqrt(greatest(regr_syy(y, x) - regr_sxy(y, x) * regr_sxy(y, x) / regr_sxx(y, x), 0)
                    / regr_count(y, x)) AS off, max(ds) AS max_ds
        FROM s GROUP BY room_id HAVING COUNT(*) >= 2),
pts AS (SELECT room_id, ds FROM s JOIN fit USING (room_id)
        UNION ALL SELECT room_id, CAST(last_day(CAST(max_ds AS DATE) + to_months(t.i)) AS TIMESTAMP)
        FROM fit CROSS JOIN range(0, 3) AS t(i)),
f AS (SELECT room_id, ds, off,
             ybar + b * (date_diff('day', DATE '{FC.EPOCH}', CAST(ds AS DATE)) - xbar) AS yhat
      FROM pts JOIN fit USING (room_id))
SELECT room_id, ds, yhat, yhat - off AS yhat_lower, yhat + off AS yhat_upper FROM f""", rounded=POINTS)
def forecast_user_model(spark, sf_dir):
    series = FC.monthly_count_series(bookings(spark, sf_dir), "room_id")
    return FC.forecast_with_model(series, FC.straight_line, ["room_id"], periods=3)
