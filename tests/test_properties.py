"""Property tests (hypothesis): invariants that must hold for any input."""

from datetime import datetime, timedelta

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from roomflow.operators.forecast import forecast_series
from roomflow.operators.monthly import monthly_bookings_and_revenue
from roomflow.operators.profile import profile_duplicates
from roomflow.operators.recommend import ml_product_upsell
from roomflow.operators.utilization import utilization_metrics

SETTINGS = settings(max_examples=8, deadline=None,
                    suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])
BASE = datetime(2023, 1, 1)

booking = st.tuples(
    st.one_of(st.none(), st.integers(1, 4)),                      # room
    st.one_of(st.none(), st.integers(0, 60 * 24 * 90)),           # start offset (minutes)
    st.one_of(st.none(), st.integers(-300, 60 * 24 * 3)),          # duration (minutes)
    st.one_of(st.none(), st.floats(0, 1000, allow_nan=False)),     # price
)


def _bookings(spark, rows):
    data = []
    for room, start, dur, price in rows:
        s = None if start is None else BASE + timedelta(minutes=start)
        e = None if s is None or dur is None else s + timedelta(minutes=dur)
        data.append((room, s, e, price))
    return spark.createDataFrame(data, "room_id int, start_time timestamp_ntz, end_time timestamp_ntz, "
                                       "price double")


@SETTINGS
@given(st.lists(booking, min_size=1, max_size=60))
def test_counts_add_up_and_minutes_non_negative(spark, rows):
    df = _bookings(spark, rows)
    monthly = monthly_bookings_and_revenue(df).collect()
    keyed = sum(1 for room, start, _, _ in rows if room is not None and start is not None)
    assert sum(r.bookings_count for r in monthly) == keyed
    util = utilization_metrics(df).collect()
    assert all(r.booked_minutes >= 0 for r in util)
    assert all(0 <= r.utilization_pct for r in util)


@SETTINGS
@given(st.lists(st.tuples(st.sampled_from("abcdef"), st.sampled_from("pqrstu")), min_size=1, max_size=80))
def test_support_never_exceeds_confidence(spark, pairs):
    df = spark.createDataFrame(pairs, "enterprise_name string, product_name string")
    for r in ml_product_upsell(df, min_support=0.1, min_confidence=0.0).collect():
        assert 0 < r.support <= r.confidence <= 1.0
        assert r.lift > 0


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 3), st.one_of(st.none(), st.integers(0, 2))), max_size=50))
def test_duplicates_plus_distinct_is_rows(spark, rows):
    df = spark.createDataFrame(rows, "a int, b int")
    (r,) = profile_duplicates(df).collect()
    assert (r.rows or 0) == len(rows)
    assert (r.duplicate_rows or 0) + (r.distinct_rows or 0) == len(rows)
    assert (r.distinct_rows or 0) == len(set(rows))


@SETTINGS
@given(st.lists(st.floats(0, 500, allow_nan=False), min_size=2, max_size=40), st.integers(0, 6))
def test_band_contains_forecast(spark, ys, periods):
    data = [(datetime(2020 + i // 12, i % 12 + 1, 1), float(y)) for i, y in enumerate(ys)]
    df = spark.createDataFrame(data, "ds timestamp_ntz, y double")
    out = forecast_series(df, [], periods=periods).collect()
    assert len(out) == len(ys) + periods
    assert all(r.yhat_lower <= r.yhat <= r.yhat_upper for r in out)
