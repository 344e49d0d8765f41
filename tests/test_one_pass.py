"""Fused summaries and reports, the daily mode, NaN rules, load diagnosis, report
publishing and user models."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from roomflow.operators import forecast as FC
from roomflow.operators import profile as P
from roomflow.operators import report as R
from roomflow.operators.summary import summary, summary_in_one_pass, summary_kpis
from roomflow.operators.utilization import utilization_metrics
from roomflow.sources.fixtures import bookings_view, revenue_view
from roomflow.sources.io import publish_report, read_report


def _rows(df):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.collect()), key=str)


def _counted(df, counter):
    """``df`` that adds its rows to ``counter`` each time it is read."""
    def run(batches):
        for b in batches:
            counter.add(b.num_rows)
            yield b
    return df.mapInArrow(run, df.schema)


VARIANTS = [(), ("room_id",), ("property_id",), ("room_id", "property_id"), ("calculated_price",)]


@pytest.mark.parametrize("dropped", VARIANTS)
def test_summary_in_one_pass_equals_the_single_operators(spark, sf_small, dropped):
    b, r = bookings_view(spark, sf_small).drop(*dropped), revenue_view(spark, sf_small)
    want, got = summary(b, r), summary_in_one_pass(b, r)
    assert set(want) == set(got)
    for name in want:
        assert got[name].columns == want[name].columns, name
        assert _rows(got[name]) == _rows(want[name]), name


@pytest.mark.parametrize("dropped", [(), ("room_id",), ("duration_in_mins",)])
def test_report_in_one_pass_equals_the_lazy_report(spark, sf_small, dropped):
    b, r = bookings_view(spark, sf_small).drop(*dropped), revenue_view(spark, sf_small)
    want, got = R.generate_report(b, r), R.report_in_one_pass(b, r)
    assert list(want) == list(got)
    for name in want:
        assert set(got[name].columns) == set(want[name].columns), name
        cols = want[name].columns
        digits = [F.round(c, 1).alias(c) if t == "double" else F.col(c) for c, t in want[name].dtypes]
        assert _rows(got[name].select(cols).select(digits)) == _rows(want[name].select(digits)), name


def test_each_table_is_read_once(spark, sf_small):
    b, r = bookings_view(spark, sf_small), revenue_view(spark, sf_small)
    n_b, n_r = b.count(), r.count()
    sc = spark.sparkContext
    for fused in (lambda x, y: summary_kpis(summary_in_one_pass(x, y)).collect(),
                  lambda x, y: summary_kpis(R.report_in_one_pass(x, y), R.REPORT_MEASURES).collect()):
        seen_b, seen_r = sc.accumulator(0), sc.accumulator(0)
        fused(_counted(b, seen_b), _counted(r, seen_r))
        assert (seen_b.value, seen_r.value) == (n_b, n_r)


def test_the_series_of_a_forecast_is_evaluated_once(spark, sf_small):
    b = bookings_view(spark, sf_small)
    n = b.count()
    seen = spark.sparkContext.accumulator(0)
    FC.bookings_forecast(_counted(b, seen)).collect()
    assert seen.value == n


def test_report_entries_are_built_when_asked_for(spark, sf_small):
    asked = []
    rep = R.Report({"a": lambda: asked.append("a") or 1, "b": lambda: asked.append("b") or 2})
    assert len(rep) == 2 and list(rep) == ["a", "b"] and asked == []
    assert rep["b"] == 2 and rep["b"] == 2 and asked == ["b"]


# --- NaN ------------------------------------------------------------------------------------------

def test_nan_durations_count_as_missing(spark):
    rows = [(datetime(2024, 1, 3), "p", "t", 10.0, 60.0), (datetime(2024, 1, 4), "p", "t", 10.0, float("nan")),
            (datetime(2024, 1, 5), "q", "t", 5.0, float("nan"))]
    b = spark.createDataFrame(rows, "booking_start_time timestamp_ntz, product_name string, enterprise_name string, "
                                    "calculated_price double, duration_in_mins double")
    used = {r.product_name: r for r in R.report_room_utilization(b).collect()}
    assert used["p"].total_booked_minutes == 60.0 and used["p"].pricing_recommendation == R.DISCOUNT_TEXT
    assert used["p"].utilization_pct == pytest.approx(100 * 60 / (31 * 540))
    assert used["q"].total_booked_minutes == 0.0 and used["q"].pricing_recommendation == R.DISCOUNT_TEXT
    assert {r.product_name for r in R.report_underutilized(b).collect()} == {"p", "q"}
    roi = {r.product_name: r.avg_revenue_per_minute for r in R.report_roi_products(b).collect()}
    assert roi == {"p": pytest.approx(10 / 60), "q": None}


def test_nan_is_no_extreme_and_no_distinct_value(spark):
    df = spark.createDataFrame([(1.5, 1), (float("nan"), 2), (None, 3), (-0.0, 4), (0.0, 4)], "x double, y int")
    for approx in (False, True):
        got = {r.column: (r.min, r.max, r.unique) for r in P.profile_min_max_unique(df, approx=approx).collect()}
        assert float(got["x"][0]) == 0.0 and got["x"][1] == "1.5"
        assert got["y"] == ("1", "4", 4)
        if not approx:
            assert got["x"][2] == 2
    only = spark.createDataFrame([(float("nan"),)], "x double")
    assert P.profile_min_max_unique(only).first()[:] == ("x", None, None, 0)


# --- the daily mode -------------------------------------------------------------------------------

def _by_minute(s, e, h0, h1):
    """Open minutes by month, minute by minute."""
    out = {datetime(s.year, s.month, 1): 0}
    while s < e:
        m = datetime(s.year, s.month, 1)
        out[m] = out.get(m, 0) + (h0 <= s.hour < h1)
        s += timedelta(minutes=1)
    return out


@pytest.mark.parametrize("hours", [(9, 18), (0, 23), (8, 8), (18, 9)])
def test_daily_mode_equals_minute_by_minute(spark, hours):
    rng = random.Random(hours[0] * 31 + hours[1])
    rows, want = [], {}
    for room in range(60):
        s = datetime(2024, rng.randint(1, 12), rng.randint(1, 28), rng.randint(0, 23), rng.randint(0, 59))
        e = s + timedelta(minutes=rng.choice([-90, 0, 1, 45, 600, 1440, 5000, 40_000, 90_000]))
        rows.append((room, s, e))
        for m, minutes in _by_minute(s, e, *hours).items():
            want[room, m] = minutes
    rows += [(100, datetime(2024, 1, 31, 23), datetime(2024, 2, 1)), (101, datetime(2024, 5, 5), None),
             (102, None, datetime(2024, 5, 5)), (103, datetime(2024, 12, 31, 17), datetime(2025, 1, 1, 10))]
    want.update({(100, datetime(2024, 1, 1)): 0, (101, datetime(2024, 5, 1)): 0})
    for m, minutes in _by_minute(rows[-1][1], rows[-1][2], *hours).items():
        want[103, m] = minutes
    df = spark.createDataFrame(rows, "room_id int, start_time timestamp_ntz, end_time timestamp_ntz")
    got = utilization_metrics(df, *hours, mode="daily").collect()
    assert {(r.room_id, r.month): r.booked_minutes for r in got} == want


def test_daily_mode_counts_seconds_and_refuses_other_modes(spark):
    rows = [(1, datetime(2024, 3, 1, 8, 59, 59, 500_000), datetime(2024, 3, 2, 9, 0, 0, 250_000))]
    df = spark.createDataFrame(rows, "room_id int, start_time timestamp_ntz, end_time timestamp_ntz")
    assert utilization_metrics(df, mode="daily").first().booked_minutes == pytest.approx(540 + 0.25 / 60, abs=1e-12)
    with pytest.raises(ValueError):
        utilization_metrics(df, mode="hourly")


# --- diagnosis while loading ----------------------------------------------------------------------

def test_diagnosis_comes_with_the_load(spark, scratch, sf_small):
    b = bookings_view(spark, sf_small).withColumn("booking_start_time", F.when(
        F.col("room_id") % 3 == 0, F.lit("no date")).otherwise(F.col("booking_start_time").cast("string")))
    want = sorted(map(tuple, P.diagnose_columns(b).collect()))
    n = b.count()
    seen = spark.sparkContext.accumulator(0)
    load = P.LoadDiagnosis(_counted(b, seen))
    load.table.write.parquet(f"{scratch}/loaded")
    assert sorted(map(tuple, load.rows().collect())) == want
    assert seen.value == n and spark.read.parquet(f"{scratch}/loaded").count() == n
    assert any(r[5] for r in want)


# --- publishing -----------------------------------------------------------------------------------

def test_a_failed_report_leaves_the_old_one(spark, scratch):
    path = f"{scratch}/report"
    old = {"a": spark.range(3), "b": spark.range(5), "none": None}
    publish_report(old, path)
    assert {k: v.count() for k, v in read_report(spark, path).items()} == {"a": 3, "b": 5}
    broken = {"a": spark.range(7), "b": spark.range(5).select(F.raise_error(F.lit("lost")).alias("x"))}
    with pytest.raises(Exception, match="lost"):
        publish_report(broken, path)
    assert {k: v.count() for k, v in read_report(spark, path).items()} == {"a": 3, "b": 5}
    publish_report({"a": spark.range(7)}, path)
    assert {k: v.count() for k, v in read_report(spark, path).items()} == {"a": 7}


# --- user models ----------------------------------------------------------------------------------

def test_user_model_per_series(spark):
    rng = np.random.default_rng(0)
    rows = [(k, datetime(2022 + m // 12, m % 12 + 1, 1), float(5 + k * m + rng.normal()) if m % 7 else None)
            for k in range(4) for m in range(20)] + [(9, datetime(2022, 1, 1), 3.0), (None, datetime(2022, 1, 1), 1.0)]
    s = spark.createDataFrame(rows, "k int, ds timestamp_ntz, y double")
    got = FC.forecast_with_model(s, FC.straight_line, ["k"], periods=2).orderBy("k", "ds").collect()
    base = FC.forecast_series(s, ["k"], periods=2, seasonality=False).orderBy("k", "ds").collect()
    assert [(r.k, r.ds) for r in got] == [(r.k, r.ds) for r in base]
    assert np.allclose([r.yhat for r in got], [r.yhat for r in base])
    last = FC.forecast_with_model(s, lambda x, y, at: (np.full(len(at), y[-1]),) * 3, ["k"], periods=1)
    for r in last.collect():
        known = [y for k, _, y in rows if k == r.k and y is not None]
        assert r.yhat == known[-1]
    with pytest.raises(ValueError, match="max_points"):
        FC.forecast_with_model(s, FC.straight_line, ["k"], max_points=19)
    with pytest.raises(ValueError):
        FC.forecast_with_model(s, FC.straight_line, [])
    assert FC.forecast_with_model(s.limit(0), FC.straight_line, ["k"]).collect() == []
