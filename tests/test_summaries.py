"""Monthly summaries, rankings, ROI, report dialect; null and missing-column rules."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from roomflow.functions.columns import resolve, strip_headers
from roomflow.operators import report as R
from roomflow.operators.monthly import monthly_bookings_and_revenue, monthly_revenue_summary
from roomflow.operators.ranking import (
    high_roi_products,
    product_revenue_rate,
    top_revenue_products,
    top_tenants,
)

d = datetime

BOOKINGS = [
    # room, prop, tenant, product, ptype, start, end, minutes, price
    (1, 10, "acme", "desk", "A", d(2024, 1, 5, 9), d(2024, 1, 5, 10), 60, 100.0),
    (1, 10, "acme", "room", "B", d(2024, 1, 6, 9), d(2024, 1, 6, 11), 120, None),
    (2, 10, "beta", "desk", "A", d(2024, 1, 7, 9), d(2024, 1, 7, 9), 0, 50.0),
    (2, 10, None, "desk", "A", d(2024, 2, 7, 9), d(2024, 2, 7, 10), 60, 30.0),
    (3, 20, "beta", None, "B", d(2024, 2, 8, 9), d(2024, 2, 8, 10), 60, 20.0),
]
BSCHEMA = ("room_id bigint, property_id int, enterprise_name string, product_name string, "
           "product_type string, booking_start_time timestamp_ntz, booking_end_time timestamp_ntz, "
           "duration_in_mins int, calculated_price double")

SALES = [
    (d(2024, 1, 5, 9), "desk", "A", 100.0, 60),
    (d(2024, 1, 9, 9), "desk", "A", None, 30),
    (d(2024, 2, 1, 9), "room", "B", 40.0, 0),
    (d(2024, 2, 2, 9), None, "B", 10.0, 10),
]
SSCHEMA = "created_at timestamp_ntz, product_name string, product_type string, price double, duration_in_mins int"


@pytest.fixture()
def bookings(spark):
    return spark.createDataFrame(BOOKINGS, BSCHEMA)


@pytest.fixture()
def sales(spark):
    return spark.createDataFrame(SALES, SSCHEMA)


def test_resolve_is_exact_and_ordered(spark):
    df = spark.createDataFrame([(1, 2, 3)], "Price int, amount int, revenue int")
    assert resolve(df, ["price", "amount", "revenue"]) == "amount"
    padded = spark.createDataFrame([(1, 2)], "` room_id ` int, `price ` int")
    assert strip_headers(padded).columns == ["room_id", "price"]


def test_monthly_bookings_paths(bookings):
    rows = {(r.month.month, r.room_id, r.property_id): r
            for r in monthly_bookings_and_revenue(bookings).collect()}
    assert rows[(1, 1, 10)].bookings_count == 2
    assert rows[(1, 1, 10)].avg_revenue == 100.0           # null price skipped in the mean
    no_price = monthly_bookings_and_revenue(bookings.drop("calculated_price")).collect()
    assert {r.avg_revenue for r in no_price} == {0.0}
    overall = monthly_bookings_and_revenue(bookings.drop("room_id", "property_id"))
    assert overall.columns == ["month", "bookings_count", "avg_revenue"]
    with pytest.raises(ValueError, match="start datetime"):
        monthly_bookings_and_revenue(bookings.drop("booking_start_time"))


def test_monthly_revenue_sum_of_nulls_is_zero(spark):
    df = spark.createDataFrame([(d(2024, 1, 1), None), (d(2024, 1, 2), None)],
                               "date timestamp_ntz, price double")
    (row,) = monthly_revenue_summary(df).collect()
    assert row.total_revenue == 0.0 and row.avg_revenue is None


def test_monthly_revenue_month_column_untruncated(spark):
    df = spark.createDataFrame([(d(2024, 1, 15), 1.0), (d(2024, 1, 15), 2.0), (d(2024, 1, 16), 4.0)],
                               "month timestamp_ntz, price double")
    rows = sorted((r.month.day, r.total_revenue) for r in monthly_revenue_summary(df).collect())
    assert rows == [(15, 3.0), (16, 4.0)]
    with pytest.raises(ValueError, match="date column"):
        monthly_revenue_summary(df.drop("month"))


def test_top_tenants_order_and_null_tenant(bookings):
    rows = top_tenants(bookings).collect()
    assert [(r.enterprise_name, r.booking_count, r.total_revenue) for r in rows] == [
        ("acme", 2, 100.0), ("beta", 2, 70.0)]
    with pytest.raises(ValueError, match="enterprise_name"):
        top_tenants(bookings.drop("enterprise_name"))


def test_top_products_shapes(sales):
    both = top_revenue_products(sales).collect()
    assert [(r.product_name, r.product_type, r["count"]) for r in both] == [
        ("desk", "A", 2), ("room", "B", 1)]
    by_type = {r.product_type: r["count"] for r in top_revenue_products(sales.drop("product_name")).collect()}
    assert by_type == {"B": 2, "A": 1}   # counts prices when only the type exists
    with pytest.raises(ValueError):
        top_revenue_products(sales.drop("product_name", "product_type"))


def test_high_roi_products_both_shapes(sales):
    rows = {r.product_name: r for r in high_roi_products(sales).collect()}
    assert rows["desk"].avg_revenue_per_minute == pytest.approx(100 / 60)
    assert rows["room"].avg_revenue_per_minute is None       # zero minutes ignored
    no_dur = high_roi_products(sales.drop("duration_in_mins"))
    assert no_dur.columns == ["product_name", "total_revenue", "transactions"]
    empty = high_roi_products(sales.drop("price"))
    assert empty.columns == [] and empty.count() == 0


def test_product_revenue_rate(sales):
    plain = {r.product_name: r.avg_rev_per_min for r in product_revenue_rate(sales).collect()}
    assert plain["desk"] == 100.0
    per_min = product_revenue_rate(sales.withColumnRenamed("duration_in_mins", "booking_minutes"))
    got = {r.product_name: r.avg_rev_per_min for r in per_min.collect()}
    assert got["desk"] == pytest.approx(100 / 60) and got["room"] is None


def test_pricing_boundaries(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(29.999,), (30.0,), (80.0,), (80.001,), (None,)], "p double")
    got = [r.s for r in df.select(R.pricing_recommendation(F.col("p")).alias("s")).collect()]
    assert got == [R.DISCOUNT_TEXT, R.STABLE_TEXT, R.STABLE_TEXT, R.INCREASE_TEXT, R.STABLE_TEXT]


def test_report_tables(bookings, sales):
    rep = R.generate_report(bookings, sales)
    assert set(rep) == {"monthly_bookings", "monthly_revenue", "room_utilization", "top_tenants",
                        "top_products", "forecast_bookings", "forecast_revenue", "underutilized",
                        "roi_products"}
    util = {(r.month.month, r.product_name): r for r in rep["room_utilization"].collect()}
    assert util[(1, "desk")].total_booked_minutes == 60
    assert util[(1, "desk")].available_minutes == 31 * 9 * 60
    assert "pricing_recommendation" not in rep["underutilized"].columns
    tenants = [r.enterprise_name for r in rep["top_tenants"].collect()]
    assert tenants == ["acme", "beta"]                      # by revenue
    mb = {r.month.month: r.total_bookings for r in rep["monthly_bookings"].collect()}
    assert mb == {1: 3, 2: 1}                               # counts product names


def test_report_without_duration(bookings):
    util = R.report_room_utilization(bookings.drop("duration_in_mins")).collect()
    assert {r.total_booked_minutes for r in util} == {0}


def test_date_coercion_rules(spark):
    ok = spark.createDataFrame([("2024-01-05 09:00:00", 1.0), (None, 2.0)], "date string, price double")
    (row,) = monthly_revenue_summary(ok).collect()
    assert row.month == d(2024, 1, 1) and row.total_revenue == 1.0
    numeric = spark.createDataFrame([(1704445200, 1.0)], "date bigint, price double")
    with pytest.raises(ValueError, match="numeric date"):
        monthly_revenue_summary(numeric)
    bad = spark.createDataFrame([("2024-01-05", 1.0), ("not a date", 2.0)], "date string, price double")
    old = spark.conf.get("spark.sql.ansi.enabled")
    try:
        for ansi in ("true", "false"):
            spark.conf.set("spark.sql.ansi.enabled", ansi)
            with pytest.raises(Exception, match="(?i)not a date|cast|parse"):
                monthly_revenue_summary(bad).collect()
    finally:
        spark.conf.set("spark.sql.ansi.enabled", old)


def test_price_priority_differs_by_table(spark):
    b = spark.createDataFrame([(d(2024, 1, 5, 9), 10.0, 99.0)],
                              "start timestamp_ntz, price double, calculated_price double")
    (row,) = monthly_bookings_and_revenue(b).collect()
    assert row.avg_revenue == 99.0                         # bookings: calculated_price first
    r = spark.createDataFrame([(d(2024, 1, 5, 9), 10.0, 99.0, "x")],
                              "created_at timestamp_ntz, price double, calculated_price double, "
                              "product_name string")
    (row,) = monthly_revenue_summary(r).collect()
    assert row.total_revenue == 10.0                       # revenue: price first
    (top,) = top_revenue_products(r).collect()
    assert top.total_revenue == 10.0


def test_totals_of_odd_prices(spark):
    from decimal import Decimal

    from roomflow.functions.totals import mean, total

    def of(values, kind="double"):
        df = spark.createDataFrame([(v,) for v in values], f"x {kind}")
        return tuple(df.agg(total(F.col("x")), mean(F.col("x"))).first())

    nan, inf = float("nan"), float("inf")
    assert of([1.0, nan, 3.0, None]) == (4.0, 2.0)          # NaN is missing, as null
    assert of([None, nan]) == (0.0, None)
    assert of([1.0, inf]) == (inf, inf)
    assert of([4e-7, 4e-7]) == (8e-7, 4e-7)                 # nothing is rounded away
    assert of([1e-7] * 5)[1] == pytest.approx(1e-7, rel=1e-12)
    assert of([1.7e12 + k for k in range(100)])[1] == pytest.approx(1.7e12 + 49.5, rel=1e-15)
    assert of([1e300, 1e300]) == (2e300, 1e300)
    assert of([Decimal("0.10")] * 30, "decimal(18,4)") == (3.0, 0.1)  # exact in decimals
    assert of([3, 4, None], "int") == (7.0, 3.5)


def test_report_underutilized_equals_operator_and_summary_bundle(bookings, sales):
    from roomflow.operators.summary import summary, summary_kpis

    rep = R.generate_report(bookings, sales)
    derived = sorted(map(tuple, rep["underutilized"].collect()))
    assert derived == sorted(map(tuple, R.report_underutilized(bookings).collect()))
    tables = summary(bookings.withColumnRenamed("booking_start_time", "start_time")
                     .withColumnRenamed("booking_end_time", "end_time"),
                     sales)
    assert set(tables) == {"bookings_monthly", "revenue_monthly", "utilization", "top_tenants",
                           "top_products"}
    kpis = {r.table_name: r for r in summary_kpis(tables).collect()}
    assert kpis["top_tenants"].rows == 2 and kpis["revenue_monthly"].measure_total == 150.0
