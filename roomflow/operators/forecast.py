"""Monthly forecasts for many series at once: linear trend + yearly season.

The original fits one Prophet model per series in a Python loop. Here every
series is fitted in the same distributed job with closed-form least squares:

1. ``series``: one row per (key, month) with value ``y`` (count or revenue),
   built by one partial+final aggregate over the raw table.
2. One aggregate per key fits the line (``regr_*`` of y on x = days since
   2000-01-01); rows without y take no part but keep their place.
3. Models are joined back to the series on the key; a series without keys is
   joined to its one-row model by broadcast, so no window and no task ever
   gathers a whole series.
4. Season (when the history spans >= 730 days, or forced): the mean residual
   per calendar month of ``ds + 1 day``; months without history get 0.
5. Band: yhat +- z * sigma * sqrt(1 + 1/n + (x - mean x)^2 / Sxx), sigma the
   RMS residual after the season, z the normal quantile of the width.
6. Output: the history months and ``periods`` future month ends starting at
   the end of the last observed month (the original's 'M' frequency),
   generated from the model rows.

This is a trend + season regression, not Prophet: numbers differ from a
Prophet fit, the shape of the output (history plus future, point forecast
and an 80 % band by default) is the same. Series with fewer than two months
are skipped.
"""

from __future__ import annotations

from collections.abc import Callable
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import timecols as T
from ..functions.totals import known, total
from ..session import reliable, ship_package

EPOCH = "2000-01-01"
SEASON_MIN_SPAN_DAYS = 730
OUTPUT = ["ds", "yhat", "yhat_lower", "yhat_upper"]


def interval_z(interval_width: float) -> float:
    if not 0.0 < interval_width < 1.0:
        raise ValueError("interval_width must be in (0, 1)")
    return NormalDist().inv_cdf(0.5 + interval_width / 2.0)


def _days(ds: Column) -> Column:
    return F.datediff(ds.cast("date"), F.lit(EPOCH).cast("date")).cast("bigint")


def _season_month(ds: Column) -> Column:
    return F.month(F.date_add(ds.cast("date"), 1))


def forecast_series(series: DataFrame, keys: list[str] | None = None, periods: int = 12,
                    interval_width: float = 0.8, seasonality: str | bool = "auto",
                    date_col: str = "ds", value_col: str = "y",
                    min_points: int = 2) -> DataFrame:
    """Forecast every series of ``series`` (columns keys..., date_col, value_col).

    Returns keys..., ds (timestamp_ntz), yhat, yhat_lower, yhat_upper.
    ``date_col`` values are expected at month starts (one row per month).
    """
    keys = list(keys or [])
    if periods < 0:
        raise ValueError("periods must be >= 0")
    z = interval_z(interval_width)
    s = series.select(*[C.col(k) for k in keys],
                      C.col(date_col).cast("timestamp_ntz").alias("ds"),
                      known(C.col(value_col)).cast("double").alias("y"))
    s = reliable(C.drop_null_keys(s, keys + ["ds"]))  # months x series rows, used five times below
    if not keys:  # one series: joins go by a constant to a table of one row
        s = s.withColumn("_series", F.col("ds").isNull())  # false; a literal would make it a cross join
    by = keys or ["_series"]
    s = s.withColumn("x", _days(F.col("ds")).cast("double")).withColumn("m", _season_month(F.col("ds")))

    # 1. A line per series; rows without y have no part in it.
    span = F.datediff(F.max("ds").cast("date"), F.min("ds").cast("date"))
    season_on = span >= SEASON_MIN_SPAN_DAYS if seasonality == "auto" else F.lit(bool(seasonality))
    fit = s.groupBy(*by).agg(
        F.regr_count("y", "x").alias("n"), F.regr_slope("y", "x").alias("b"),
        F.regr_avgy("y", "x").alias("ybar"), F.regr_avgx("y", "x").alias("xbar"),
        F.regr_sxx("y", "x").alias("sxx"), F.max("ds").alias("max_ds"), season_on.alias("season_on"),
    ).where(F.col("n") >= min_points)

    # 2. Per calendar month the mean residual, and the squares left around it.
    resid = F.col("y") - (F.col("ybar") + F.col("b") * (F.col("x") - F.col("xbar")))
    months = _on_series(s.where(F.col("y").isNotNull()), fit, by, keys).select(
        *by, "m", "season_on", resid.alias("r")).groupBy(*by, "m").agg(
        F.avg("r").alias("mean"), F.count("r").alias("c"), F.var_pop("r").alias("var"),
        F.sum(F.col("r") * F.col("r")).alias("squares"), F.first("season_on").alias("on"))
    around = months.groupBy(*by).agg(
        F.map_from_entries(F.collect_list(F.struct("m", F.when(F.col("on"), F.col("mean")).otherwise(F.lit(0.0)).alias("s"))))
        .alias("season_map"),  # at most twelve entries
        F.sum(F.when(F.col("on"), F.col("var") * F.col("c")).otherwise(F.col("squares"))).alias("sse"))
    model = _on_series(fit, around, by, keys).withColumn(
        "sigma", F.sqrt(F.col("sse") / F.col("n"))).drop("sse", "season_on")

    # 3. The months of the series and the month ends that follow.
    past = _on_series(s.select(*by, "ds"), model, by, keys)
    future = F.transform(
        F.sequence(F.lit(0), F.lit(periods - 1)) if periods > 0 else F.array().cast("array<int>"),
        lambda i: T.future_month_end(F.col("max_ds"), i))
    p = past.unionByName(model.withColumn("ds", F.explode(future)))
    dx = _days(F.col("ds")).cast("double") - F.col("xbar")
    season = F.coalesce(F.element_at(F.col("season_map"), _season_month(F.col("ds"))), F.lit(0.0))
    yhat = F.col("ybar") + F.col("b") * dx + season
    # try_divide: a degenerate series (all points on one date) gives NULL, not an error
    half = F.lit(z) * F.col("sigma") * F.sqrt(
        F.lit(1.0) + F.try_divide(F.lit(1.0), F.col("n").cast("double")) + F.try_divide(dx * dx, F.col("sxx")))
    return (p.withColumn("yhat", yhat)
            .withColumn("yhat_lower", F.col("yhat") - half)
            .withColumn("yhat_upper", F.col("yhat") + half)
            .select(*[C.col(k) for k in keys], *OUTPUT))


def _on_series(left: DataFrame, right: DataFrame, by: list[str], keys: list[str]) -> DataFrame:
    """Join on the series; without keys ``right`` is one row, which is broadcast."""
    return left.join(right if keys else F.broadcast(right), by)


MAX_POINTS = 100_000  # months of one series that a user model may be given


def forecast_with_model(series: DataFrame, model: Callable, keys: list[str], periods: int = 12,
                        date_col: str = "ds", value_col: str = "y", min_points: int = 2,
                        max_points: int = MAX_POINTS) -> DataFrame:
    """A user's model per series: ``model(x, y, at)`` gets numpy arrays of day numbers
    ``x`` (since 2000-01-01, ascending) with values ``y`` and the day numbers ``at`` of
    history and future, and returns ``(yhat, lower, upper)`` at ``at``. Columns and
    dates are those of :func:`forecast_series`, which stays the default.

    Each series goes to one task. A series of more than ``max_points`` rows is an error
    (raised by the count that runs first); one of fewer than ``min_points`` values is
    skipped. Rows without a value keep their place in the output only."""
    import numpy as np
    import pyarrow as pa

    if periods < 0:
        raise ValueError("periods must be >= 0")
    if not keys:
        raise ValueError("a user model needs keys: one series would be one task")
    s = series.select(*[C.col(k) for k in keys], C.col(date_col).cast("timestamp_ntz").alias("ds"),
                      known(C.col(value_col)).cast("double").alias("y"))
    s = reliable(C.drop_null_keys(s, keys + ["ds"]))
    longest = s.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max("ds").alias("last"))
    longest = reliable(longest)
    most = longest.agg(F.max("n")).first()[0] or 0
    if most > max_points:
        raise ValueError(f"a series has {most} rows, more than max_points ({max_points})")
    ship_package(series.sparkSession)
    future = F.transform(F.sequence(F.lit(0), F.lit(periods - 1)) if periods else F.array().cast("array<int>"),
                         lambda i: T.future_month_end(F.col("last"), i))
    ahead = longest.select(*keys, F.explode(future).alias("ds"))
    points = s.withColumn("known", F.lit(True)).unionByName(
        ahead.select(*keys, "ds", F.lit(None).cast("double").alias("y"), F.lit(False).alias("known")))
    points = points.withColumn("x", _days(F.col("ds")))
    schema = ", ".join(f"`{k}` {s.schema[k].dataType.simpleString()}" for k in keys)

    def fit(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("x")
        at = table.column("x").to_numpy().astype(float)
        y = table.column("y").to_numpy()
        has = table.column("known").to_numpy(zero_copy_only=False) & ~np.isnan(y)
        out = table.select([*keys, "ds"])
        if has.sum() < min_points:
            out = out.slice(0, 0)
            bands = [np.zeros(0)] * 3
        else:
            bands = model(at[has], y[has], at)
        for name, v in zip(OUTPUT[1:], bands):
            out = out.append_column(name, pa.array(np.asarray(v, dtype=float)))
        return out

    return points.groupBy(*keys).applyInArrow(
        fit, f"{schema}, ds timestamp_ntz, yhat double, yhat_lower double, yhat_upper double")


def straight_line(x, y, at):
    """A model for :func:`forecast_with_model`: least squares, with a band of one
    root-mean-square residual."""
    import numpy as np

    dx = x - x.mean()
    slope = (dx * y).sum() / (dx * dx).sum() if (dx * dx).sum() else 0.0
    yhat = y.mean() + slope * (at - x.mean())
    off = np.sqrt(np.mean((y - y.mean() - slope * dx) ** 2))
    return yhat, yhat - off, yhat + off


def monthly_count_series(bookings: DataFrame, group_by: str | None) -> DataFrame:
    start = C.require(bookings, C.BOOKING_START, C.NO_START_FORECAST)
    dtype = {f.name: f.dataType for f in bookings.schema.fields}[start]
    keys = [group_by] if group_by else []
    df = bookings.select(*[C.col(k) for k in keys],
                         T.month_start(T.to_wall_clock(C.col(start), dtype)).alias("ds"))
    return C.drop_null_keys(df, keys + ["ds"]).groupBy(*keys, "ds").agg(F.count(F.lit(1)).alias("y"))


def bookings_forecast(bookings: DataFrame, months: int = 3, group_by: str = "room_id",
                      interval_width: float = 0.8, seasonality: str | bool = "auto") -> DataFrame:
    """Monthly booking counts forecast per ``group_by`` (when that column
    exists), else one overall series. Long rows: [key], ds, yhat, yhat_lower,
    yhat_upper."""
    key = group_by if group_by in bookings.columns else None
    series = monthly_count_series(bookings, key)
    return forecast_series(series, [key] if key else [], periods=months,
                           interval_width=interval_width, seasonality=seasonality)


def revenue_forecast(revenue: DataFrame, months: int = 12, interval_width: float = 0.8,
                     seasonality: str | bool = "auto") -> DataFrame:
    """Monthly revenue total forecast (one series)."""
    date = C.require(revenue, C.REVENUE_DATE, C.NO_REVENUE_DATE_FORECAST)
    price = C.require(revenue, C.REVENUE_PRICE, C.NO_PRICE)
    dtype = {f.name: f.dataType for f in revenue.schema.fields}[date]
    df = revenue.select(T.month_start(T.to_wall_clock(C.col(date), dtype)).alias("ds"),
                        C.col(price).alias("_price"))
    series = (C.drop_null_keys(df, ["ds"]).groupBy("ds")
              .agg(total(F.col("_price")).alias("y")))
    return forecast_series(series, [], periods=months, interval_width=interval_width,
                           seasonality=seasonality)


def forecast_as_arrays(forecast: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Column-list form: one row per series, ``key`` as string and four
    arrays ordered by ds (the original's dict of lists). Each series is
    bounded by its months plus the horizon."""
    keys = list(keys or [])
    pts = F.sort_array(F.collect_list(F.struct(*OUTPUT)))
    agg = forecast.groupBy(*[C.col(k) for k in keys]).agg(pts.alias("_pts"))
    key_col = [F.concat_ws("|", *[C.col(k).cast("string") for k in keys]).alias("key")] if keys else []
    return agg.select(*key_col, *[F.col("_pts")[c].alias(c) for c in OUTPUT])


def arrays_to_rows(arrays: DataFrame) -> DataFrame:
    """Inverse of ``forecast_as_arrays`` (round trip for checking)."""
    keep = [c for c in arrays.columns if c not in OUTPUT]
    return arrays.select(*keep, F.inline(F.arrays_zip(*[F.col(c) for c in OUTPUT])))
