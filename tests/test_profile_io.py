"""Profiling against pandas/numpy on the small fixture; sources, sinks, streaming."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from roomflow.operators import profile as P
from roomflow.sources.fixtures import bookings_view, revenue_view
from roomflow.sources.io import load_table, records_from_json, records_json, write_report


def test_profile_numeric_matches_numpy(spark, sf_small):
    b = bookings_view(spark, sf_small)
    pdf = b.select("room_id", "duration_in_mins", "calculated_price").toPandas()
    out = {r.column: r for r in P.profile_numeric(b, ["room_id", "duration_in_mins",
                                                     "calculated_price"]).collect()}
    for c in pdf.columns:
        v = pdf[c].dropna().astype(float).to_numpy()
        r = out[c]
        assert r["count"] == len(v)
        assert r.mean == pytest.approx(v.mean(), rel=1e-9)
        assert r.std == pytest.approx(v.std(ddof=1), rel=1e-7)
        for p, name in zip((25, 50, 75), ("p25", "p50", "p75")):
            assert r[name] == pytest.approx(np.percentile(v, p), rel=1e-12)
        assert (r["min"], r["max"]) == (v.min(), v.max())


def test_exact_quantiles_many_partitions(spark):
    rng = np.random.default_rng(1)
    vals = np.concatenate([rng.normal(0, 1, 3000), np.full(2000, 0.5)])  # a heavy duplicate value
    df = spark.createDataFrame([("x", float(v)) for v in vals], "column string, value double")
    probs = (0.0, 0.1, 0.25, 0.5, 0.9, 1.0)
    got = {r.p: r.q for r in P.exact_quantiles(df, probs, partitions=13).collect()}
    for p in probs:
        assert got[p] == pytest.approx(np.quantile(vals, p), rel=1e-12, abs=1e-12)


def test_categorical_duplicates_and_columns(spark, sf_small):
    b = bookings_view(spark, sf_small)
    pdf = b.toPandas()
    cat = {r.column: r for r in P.profile_categorical(b).collect()}
    vc = pdf["product_type"].value_counts()
    top = sorted(vc[vc == vc.max()].index)[0]
    assert (cat["product_type"].unique, cat["product_type"].top, cat["product_type"].freq) == (
        pdf["product_type"].nunique(), top, vc.max())
    cols = {r.column: r.null_count for r in P.profile_columns(b).collect()}
    assert cols == pdf.isnull().sum().to_dict()
    li = spark.read.parquet(f"{sf_small}/lineitem.parquet").select("l_orderkey", "l_linenumber")
    lpdf = li.toPandas()
    (dup,) = P.profile_duplicates(li).collect()
    assert dup.duplicate_rows == int(lpdf.duplicated().sum())
    (shape,) = P.profile_shape(b).collect()
    assert (shape.rows, shape.columns, shape.elements) == (len(pdf), 9, pdf.size)


def test_preview_and_diagnose(spark, sf_small):
    b = bookings_view(spark, sf_small)
    head = P.preview_head(b, 3, ["booking_start_time", "room_id"]).collect()
    assert [r.booking_start_time for r in head] == sorted(r.booking_start_time for r in head)
    diag = {r.role: r for r in P.diagnose_columns(b.withColumn("price", F.lit("x")).drop(
        "calculated_price")).collect()}
    assert diag["start"].resolved == "booking_start_time" and diag["start"].bad_values == 0
    assert diag["price"].resolved == "price" and diag["price"].bad_values == diag["price"].rows


def test_load_csv_strips_headers_and_records_round_trip(spark, scratch):
    path = os.path.join(scratch, "bookings.csv")
    with open(path, "w") as f:
        f.write(" room_id , booking_start_time ,price\n1,2024-01-05 09:00:00,10.5\n2,2024-01-06 10:00:00,\n")
    df = load_table(spark, path)
    assert df.columns == ["room_id", "booking_start_time", "price"]
    back = records_from_json(records_json(df), df.schema)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    with pytest.raises(ValueError, match="spreadsheets"):
        load_table(spark, os.path.join(scratch, "x.xlsx"))


def test_write_report_skips_missing(spark, scratch, sf_small):
    from roomflow.operators.report import generate_report

    b = bookings_view(spark, sf_small)
    r = revenue_view(spark, sf_small)
    rep = generate_report(b, r)
    assert rep["forecast_revenue"] is not None
    rep = {"monthly_bookings": rep["monthly_bookings"], "top_tenants": rep["top_tenants"],
           "forecast_revenue": None}                         # a forecast that could not be built
    written = write_report(rep, os.path.join(scratch, "report"))
    assert written == ["monthly_bookings", "top_tenants"]
    again = spark.read.parquet(os.path.join(scratch, "report", "top_tenants"))
    assert again.count() == 10


def test_streaming_monthly_revenue_equals_batch(spark, scratch, sf_small):
    from roomflow.operators.monthly import monthly_revenue_summary
    from roomflow.streaming.incremental import read_latest, start_incremental

    r = revenue_view(spark, sf_small)
    src = os.path.join(scratch, "sales")
    r.where(F.month("created_at") <= 6).write.parquet(src, mode="append")
    r.where(F.month("created_at") > 6).write.parquet(src, mode="append")
    out = os.path.join(scratch, "monthly")
    q = start_incremental(spark, src, r.schema, out, "monthly_revenue",
                          checkpoint_location=os.path.join(scratch, "ckpt"))
    q.awaitTermination(120)
    got = sorted(map(tuple, read_latest(spark, out).collect()))
    want = sorted(map(tuple, monthly_revenue_summary(r).collect()))
    assert got == want


def test_approx_quartiles_close_to_exact(spark, sf_small):
    b = bookings_view(spark, sf_small)
    exact = {r.column: r for r in P.profile_numeric(b, ["calculated_price"]).collect()}
    approx = {r.column: r for r in P.profile_numeric(b, ["calculated_price"], approx=True).collect()}
    e, a = exact["calculated_price"], approx["calculated_price"]
    spread = e["max"] - e["min"]
    for name in ("p25", "p50", "p75"):
        assert abs(a[name] - e[name]) <= 0.01 * spread
    ts = P.profile_datetime(b, approx=True).collect()
    assert {r.column for r in ts} == {"booking_start_time", "booking_end_time"}


@pytest.mark.parametrize("fmt", ["json", "orc", "parquet"])
def test_load_table_formats(spark, scratch, sf_small, fmt):
    from roomflow.operators.monthly import monthly_revenue_summary

    r = revenue_view(spark, sf_small)
    path = os.path.join(scratch, f"revenue.{fmt}")
    getattr(r.write, fmt)(path)
    schema = r.schema if fmt == "json" else None
    loaded = load_table(spark, path, schema=schema)
    assert sorted(loaded.columns) == sorted(r.columns)
    got = sorted(map(tuple, monthly_revenue_summary(loaded).collect()))
    assert got == sorted(map(tuple, monthly_revenue_summary(r).collect()))


@pytest.mark.parametrize("operator", ["monthly_bookings", "utilization"])
def test_streaming_bookings_tables_equal_batch(spark, scratch, sf_small, operator):
    from roomflow.streaming.incremental import INCREMENTAL, read_latest, start_incremental

    b = bookings_view(spark, sf_small)
    src = os.path.join(scratch, "bookings")
    b.where(F.month("booking_start_time") <= 6).write.parquet(src, mode="append")
    b.where(F.month("booking_start_time") > 6).write.parquet(src, mode="append")
    out = os.path.join(scratch, operator)
    q = start_incremental(spark, src, b.schema, out, operator,
                          checkpoint_location=os.path.join(scratch, "ckpt-" + operator))
    q.awaitTermination(180)
    got = sorted(map(tuple, read_latest(spark, out).collect()))
    want = sorted(map(tuple, INCREMENTAL[operator](b).collect()))
    assert got == want


def _stored(df, how, scratch):
    if how == "persisted":
        return df.persist()
    if how == "checkpointed":
        return df.checkpoint()
    path = os.path.join(scratch, "values")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


@pytest.mark.parametrize("reuse", ["true", "false"])
@pytest.mark.parametrize("how", ["persisted", "checkpointed", "file"])
def test_quartiles_and_cut_do_not_depend_on_how_the_input_is_stored(spark, scratch, how, reuse):
    from roomflow.operators.recommend import two_means_cut

    df = _stored(spark.range(20_000).select(
        F.lit("x").alias("column"), (F.rand(7) * F.lit(20.0)).alias("value")), how, scratch)
    spark.conf.set("spark.sql.exchange.reuse", reuse)
    try:
        got = {r.p: r.q for r in P.exact_quantiles(df, (0.25, 0.5, 0.75)).collect()}
        want = df.select(F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))).first()[0]
        assert [got[p] for p in (0.25, 0.5, 0.75)] == pytest.approx(want, rel=1e-12)
        x = np.sort(np.array([r.value for r in df.collect()]))
        s = np.cumsum(x - x.mean())[:-1]
        n1 = np.arange(1, len(x))
        assert two_means_cut(df, "value") == pytest.approx(x[np.argmax(s * s / (n1 * (len(x) - n1)))], rel=1e-12)
    finally:
        spark.conf.set("spark.sql.exchange.reuse", "true")
        df.unpersist()


def test_std_keeps_small_and_large_values(spark):
    cases = [[1e-4, 3e-4], [1e9, 1e9 + 1, 1e9 + 2], [1.7e9 + k for k in range(10)], [5.0], [1.7e12 + k for k in range(100)]]
    for values in cases:
        (r,) = P.profile_numeric(spark.createDataFrame([(v,) for v in values], "x double")).collect()
        assert r["count"] == len(values) and r.mean == pytest.approx(np.mean(values), rel=1e-15)
        assert r.std == (pytest.approx(np.std(values, ddof=1), rel=1e-6) if len(values) > 1 else None)


def test_profiles_keep_empty_columns_and_take_empty_tables(spark):
    df = spark.createDataFrame([(1.0, None, "a", None), (float("nan"), None, None, None)],
                               "x double, y double, s string, t string")
    num = {r.column: r for r in P.profile_numeric(df).collect()}
    assert (num["y"]["count"], num["y"].mean, num["y"].p50) == (0, None, None) and num["x"]["count"] == 1
    cat = {r.column: r for r in P.profile_categorical(df).collect()}
    assert (cat["t"]["count"], cat["t"].unique, cat["t"].top, cat["t"].freq) == (0, 0, None, None)
    assert (cat["s"]["count"], cat["s"].unique, cat["s"].top, cat["s"].freq) == (1, 1, "a", 1)
    assert {r.column: r.unique for r in P.profile_min_max_unique(df.drop("x")).collect()} == {"y": 0, "s": 1, "t": 0}
    assert P.profile_datetime(df).collect() == []
    assert P.profile_numeric(df.select("s")).collect() == [] and P.profile_categorical(df.select("x")).collect() == []
    assert tuple(P.profile_duplicates(df.limit(0)).first()) == (0, 0, 0)
    assert tuple(P.profile_duplicates(df.union(df)).first()) == (4, 2, 2)


def test_records_keep_nulls_and_microseconds(spark):
    df = spark.sql("SELECT 1 AS a, CAST(NULL AS INT) AS b, TIMESTAMP_NTZ '2024-01-02 03:04:05.123456' AS t")
    (text,) = records_json(df).first()
    assert text == '{"a":1,"b":null,"t":"2024-01-02T03:04:05.123456"}'
    assert tuple(records_from_json(records_json(df), df.schema).first()) == tuple(df.first())


def test_headers_that_differ_by_case_keep_the_known_name(spark):
    from roomflow.functions.columns import strip_headers
    from roomflow.operators.monthly import monthly_revenue_summary

    df = spark.sql("SELECT TIMESTAMP_NTZ '2024-01-02 03:04:05' AS created_at, 7.0D AS a, 3.0D AS b, 1 AS c").toDF(
        "created_at", "Price", " price ", "price_1")
    out = strip_headers(df)
    assert out.columns == ["created_at", "Price_2", "price", "price_1"]
    assert monthly_revenue_summary(out).first().total_revenue == 3.0
    assert strip_headers(df.toDF("a", "B", "b", "B ")).columns == ["a", "B", "b_1", "B_2"]


def test_summaries_read_their_table_once(spark, tmp_path):
    """Nulls of one column do not shift another's ranks, and what is left to run
    after the value counts are written reads no table."""
    rng = np.random.default_rng(3)
    rows = [(float(v) if k % 3 else None, float(k % 7), None) for k, v in enumerate(rng.normal(0, 1, 500))]
    spark.createDataFrame(rows, "a double, b double, none double").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    out = P.profile_numeric(df)
    assert "FileScan" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r.column: r for r in out.collect()}
    for i, name in enumerate("ab"):
        x = np.array([r[i] for r in rows if r[i] is not None])
        r = got[name]
        assert r["count"] == len(x)
        assert [r.mean, r.std, r.min, r.max] == pytest.approx([x.mean(), x.std(ddof=1), x.min(), x.max()])
        assert [r.p25, r.p50, r.p75] == pytest.approx(list(np.quantile(x, [0.25, 0.5, 0.75])))
    assert got["none"]["count"] == 0 and got["none"].mean is None and got["none"].p50 is None
