"""Clip-to-opening-hours semantics and the utilization table."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from roomflow.operators.utilization import (
    clipped_micros,
    recommend_underutilized,
    utilization_metrics,
)

SCHEMA = "start timestamp_ntz, end timestamp_ntz"


def _minutes(spark, rows, h0=9, h1=18):
    df = spark.createDataFrame(rows, SCHEMA)
    out = df.select((clipped_micros(F.col("start"), F.col("end"), h0, h1) / 6e7).alias("m"))
    return [r.m for r in out.collect()]


def test_clip_table(spark):
    d = datetime
    rows = [
        (d(2024, 5, 1, 8), d(2024, 5, 1, 10)),     # start clipped to opening
        (d(2024, 5, 1, 17), d(2024, 5, 1, 20)),    # end clipped to closing
        (d(2024, 5, 1, 19), d(2024, 5, 1, 21)),    # after closing
        (d(2024, 5, 1, 12), d(2024, 5, 1, 11)),    # end before start
        (d(2024, 5, 1, 17), d(2024, 5, 2, 10)),    # overnight hours count
        (d(2024, 5, 1, 19), d(2024, 5, 2, 8)),     # neither end clipped
        (d(2024, 5, 1, 8), d(2024, 5, 3, 20)),     # three days incl. nights
        (d(2024, 5, 1, 8), None),                   # no end
    ]
    assert _minutes(spark, rows) == [60, 60, 0, 0, 1020, 780, 3420, None]


def test_clip_keeps_sub_second_part(spark):
    rows = [(datetime(2024, 5, 1, 8, 0, 0, 500000), datetime(2024, 5, 1, 10))]
    (m,) = _minutes(spark, rows)
    assert m == pytest.approx(59 + 59.5 / 60, abs=1e-9)


def _clip_py(s, e, h0, h1):
    if s is None or e is None:
        return None
    s_open = s.replace(hour=h0, minute=0, second=0)
    e_close = e.replace(hour=h1, minute=0, second=0)
    delta = (min(e, e_close) - max(s, s_open)).total_seconds() / 60
    return max(delta, 0.0)


def test_clip_against_python_restatement(spark):
    rnd = random.Random(7)
    base = datetime(2023, 1, 1)
    rows = []
    for _ in range(400):
        s = base + timedelta(minutes=rnd.randrange(0, 60 * 24 * 400), microseconds=rnd.randrange(0, 10**6))
        e = s + timedelta(minutes=rnd.randrange(-120, 60 * 24 * 3))
        rows.append((s, e))
    for h0, h1 in [(9, 18), (0, 23), (8, 20)]:
        got = _minutes(spark, rows, h0, h1)
        want = [_clip_py(s, e, h0, h1) for s, e in rows]
        assert got == pytest.approx(want, abs=1e-9)


def test_hours_validated(spark):
    with pytest.raises(ValueError):
        clipped_micros(F.col("a"), F.col("b"), 9, 24)


def _bookings(spark):
    d = datetime
    rows = [
        (1, 10, d(2024, 2, 1, 9), d(2024, 2, 1, 10)),
        (1, 10, d(2024, 2, 3, 9), None),               # null end: group kept, adds 0
        (2, 10, d(2024, 2, 5, 12), d(2024, 2, 5, 18)),
        (3, 20, d(2024, 3, 1, 9), None),               # all-null group -> 0 minutes
        (None, 20, d(2024, 3, 2, 9), d(2024, 3, 2, 10)),  # null room dropped in room grouping
        (4, 20, None, d(2024, 3, 2, 10)),               # no start: no month -> dropped
    ]
    return spark.createDataFrame(
        rows, "room_id bigint, property_id int, booking_start_time timestamp_ntz, "
              "booking_end_time timestamp_ntz")


def test_utilization_by_room(spark):
    out = {(r.month.month, r.room_id): r for r in utilization_metrics(_bookings(spark)).collect()}
    assert set(out) == {(2, 1), (2, 2), (3, 3)}
    assert out[(2, 1)].booked_minutes == 60.0
    assert out[(2, 1)].available_minutes == 29 * 9 * 60  # leap February
    assert out[(2, 2)].utilization_pct == pytest.approx(100 * 360 / (29 * 540))
    assert out[(3, 3)].booked_minutes == 0.0


def test_utilization_property_and_overall(spark):
    b = _bookings(spark)
    by_prop = utilization_metrics(b.drop("room_id"))
    assert by_prop.columns == ["month", "property_id", "booked_minutes", "available_minutes",
                               "utilization_pct"]
    rows = {(r.month.month, r.property_id): r.booked_minutes for r in by_prop.collect()}
    assert rows == {(2, 10): 420.0, (3, 20): 60.0}
    overall = utilization_metrics(b.drop("room_id", "property_id"))
    assert overall.columns[:2] == ["month", "booked_minutes"]
    assert overall.count() == 2


def test_candidate_names_and_missing_end(spark):
    b = _bookings(spark).withColumnRenamed("booking_start_time", "check_in") \
        .withColumnRenamed("booking_end_time", "check_out")
    assert utilization_metrics(b).count() == 3
    with pytest.raises(ValueError, match="start/end"):
        utilization_metrics(b.drop("check_out"))


def test_recommend_threshold_and_order(spark):
    util = utilization_metrics(_bookings(spark))
    under = recommend_underutilized(util, 1.0).collect()
    assert [r.room_id for r in under] == [3, 1]
    assert all(r.utilization_pct < 1.0 for r in under)


def test_wall_clock_minutes_ignore_session_zone(spark):
    # 2024-03-10 02:00 does not exist in New York; wall-clock spans still count
    rows = [(datetime(2024, 3, 10, 1, 0), datetime(2024, 3, 10, 4, 0)),
            (datetime(2024, 11, 3, 0, 30), datetime(2024, 11, 3, 3, 30))]
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert _minutes(spark, rows, 0, 23) == [180, 180]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
