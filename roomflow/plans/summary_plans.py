"""Monthly summaries, rankings and revenue-per-minute queries (and variants
reached by dropping or renaming columns of the fixture tables)."""

from __future__ import annotations

import uuid

from ..operators.monthly import monthly_bookings_and_revenue, monthly_revenue_summary
from ..operators.ranking import (
    high_roi_products,
    product_revenue_rate,
    top_revenue_products,
    top_tenants,
)
from ..operators.summary import summary_in_one_pass, summary_kpis
from ..session import ensure_checkpoint_dir
from ..sources.io import load_table, records_from_json, records_json
from .catalog import bookings, money_mean_sql, money_total_sql, month_sql, register, revenue
from .utilization_plans import _util_sql


def _monthly_bookings_sql(keys: list[str], price: str | None = "calculated_price") -> str:
    ks = "".join(f", {k}" for k in keys)
    nn = "".join(f" AND {k} IS NOT NULL" for k in keys)
    avg = money_mean_sql("p") if price else "CAST(0.0 AS DOUBLE)"
    psel = f", {price} AS p" if price else ""
    return f"""
SELECT month{ks}, COUNT(*) AS bookings_count, {avg} AS avg_revenue
FROM (SELECT {month_sql('booking_start_time')} AS month{ks}{psel} FROM bookings) t
WHERE month IS NOT NULL{nn}
GROUP BY month{ks}"""


@register("monthly_bookings", _monthly_bookings_sql(["room_id", "property_id"]))
def monthly_bookings(spark, sf_dir):
    return monthly_bookings_and_revenue(bookings(spark, sf_dir))


@register("monthly_bookings_by_room", _monthly_bookings_sql(["room_id"]))
def monthly_bookings_by_room(spark, sf_dir):
    return monthly_bookings_and_revenue(bookings(spark, sf_dir).drop("property_id"))


@register("monthly_bookings_overall", _monthly_bookings_sql([]))
def monthly_bookings_overall(spark, sf_dir):
    return monthly_bookings_and_revenue(bookings(spark, sf_dir).drop("room_id", "property_id"))


@register("monthly_bookings_no_price", _monthly_bookings_sql(["room_id", "property_id"], None))
def monthly_bookings_no_price(spark, sf_dir):
    return monthly_bookings_and_revenue(bookings(spark, sf_dir).drop("calculated_price"))


def _monthly_revenue_sql(month_expr: str) -> str:
    return f"""
SELECT month, {money_total_sql('price')} AS total_revenue, {money_mean_sql('price')} AS avg_revenue
FROM (SELECT {month_expr} AS month, price FROM revenue) t
WHERE month IS NOT NULL
GROUP BY month"""


@register("monthly_revenue", _monthly_revenue_sql(month_sql("created_at")))
def monthly_revenue(spark, sf_dir):
    return monthly_revenue_summary(revenue(spark, sf_dir))


@register("monthly_revenue_from_month_col", _monthly_revenue_sql("event_at"))
def monthly_revenue_from_month_col(spark, sf_dir):
    # No date column, an existing `month` column: grouped by its exact values.
    r = revenue(spark, sf_dir).drop("created_at").withColumnRenamed("event_at", "month")
    return monthly_revenue_summary(r)


def _top_tenants_sql(price: str | None) -> str:
    total = money_total_sql(price) if price else "CAST(0.0 AS DOUBLE)"
    return f"""
SELECT enterprise_name, COUNT(enterprise_name) AS booking_count, {total} AS total_revenue
FROM bookings WHERE enterprise_name IS NOT NULL
GROUP BY enterprise_name
ORDER BY booking_count DESC, total_revenue DESC, enterprise_name ASC
LIMIT 10"""


@register("top_tenants", _top_tenants_sql("calculated_price"))
def top_tenants_q(spark, sf_dir):
    return top_tenants(bookings(spark, sf_dir))


@register("top_tenants_no_price", _top_tenants_sql(None))
def top_tenants_no_price(spark, sf_dir):
    return top_tenants(bookings(spark, sf_dir).drop("calculated_price"))


def _top_products_sql(keys: list[str]) -> str:
    ks = ", ".join(keys)
    nn = " AND ".join(f"{k} IS NOT NULL" for k in keys)
    counted = "product_name" if "product_name" in keys else "price"
    order = ", ".join(f"{k} ASC" for k in keys)
    return f"""
SELECT {ks}, {money_total_sql('price')} AS total_revenue, {money_mean_sql('price')} AS avg_revenue,
       COUNT({counted}) AS "count"
FROM revenue WHERE {nn}
GROUP BY {ks}
ORDER BY total_revenue DESC, {order}
LIMIT 20"""


@register("top_products", _top_products_sql(["product_name", "product_type"]))
def top_products(spark, sf_dir):
    return top_revenue_products(revenue(spark, sf_dir))


@register("top_products_by_name", _top_products_sql(["product_name"]))
def top_products_by_name(spark, sf_dir):
    return top_revenue_products(revenue(spark, sf_dir).drop("product_type"))


@register("top_products_by_type", _top_products_sql(["product_type"]))
def top_products_by_type(spark, sf_dir):
    return top_revenue_products(revenue(spark, sf_dir).drop("product_name"))


def _roi_sql(product: str, with_duration: bool = True) -> str:
    if with_duration:
        return f"""
SELECT {product}, {money_mean_sql('rate')} AS avg_revenue_per_minute,
       {money_total_sql('price')} AS total_revenue, COUNT({product}) AS transactions
FROM (SELECT {product}, price,
             CAST(price AS DOUBLE) / NULLIF(duration_in_mins, 0) AS rate FROM revenue) t
WHERE {product} IS NOT NULL
GROUP BY {product}"""
    return f"""
SELECT {product}, {money_total_sql('price')} AS total_revenue, COUNT({product}) AS transactions
FROM revenue WHERE {product} IS NOT NULL
GROUP BY {product}"""


@register("high_roi_products", _roi_sql("product_name"), rounded=("avg_revenue_per_minute",))
def high_roi_products_q(spark, sf_dir):
    return high_roi_products(revenue(spark, sf_dir))


@register("high_roi_products_no_duration", _roi_sql("product_name", False))
def high_roi_products_no_duration(spark, sf_dir):
    return high_roi_products(revenue(spark, sf_dir).drop("duration_in_mins"))


@register("high_roi_by_room", _roi_sql("room_id"), revenue_with_room=True,
          rounded=("avg_revenue_per_minute",))
def high_roi_by_room(spark, sf_dir):
    return high_roi_products(revenue(spark, sf_dir, with_room=True).drop("product_name"))


def _rate_sql(with_minutes: bool) -> str:
    rate = ("CAST(price AS DOUBLE) / NULLIF(duration_in_mins, 0)" if with_minutes else "price")
    return f"""
SELECT product_name, product_type, {money_total_sql('price')} AS total_revenue,
       {money_mean_sql('rate')} AS avg_rev_per_min
FROM (SELECT product_name, product_type, price, {rate} AS rate FROM revenue) t
WHERE product_name IS NOT NULL AND product_type IS NOT NULL
GROUP BY product_name, product_type"""


@register("product_revenue_rate", _rate_sql(True), rounded=("avg_rev_per_min",))
def product_revenue_rate_q(spark, sf_dir):
    # Minutes of each sale under the name this operator reads.
    r = revenue(spark, sf_dir).withColumnRenamed("duration_in_mins", "booking_minutes")
    return product_revenue_rate(r)


@register("product_revenue_rate_no_minutes", _rate_sql(False))
def product_revenue_rate_no_minutes(spark, sf_dir):
    return product_revenue_rate(revenue(spark, sf_dir))


# --- summary bundle digest (C1) and the JSON records sink (K1) --------------

def _kpi_sql() -> str:
    parts = [
        ("bookings_monthly", "bookings_count", _monthly_bookings_sql(["room_id", "property_id"])),
        ("revenue_monthly", "total_revenue", _monthly_revenue_sql(month_sql("created_at"))),
        ("utilization", "booked_minutes", _util_sql(["room_id"])),
        ("top_tenants", "total_revenue", _top_tenants_sql("calculated_price")),
        ("top_products", "total_revenue", _top_products_sql(["product_name", "product_type"])),
    ]
    return "\nUNION ALL\n".join(
        f"SELECT '{name}' AS table_name, COUNT(*) AS rows, '{m}' AS measure, "
        f"{money_total_sql(m)} AS measure_total FROM ({sql}) t" for name, m, sql in parts)


@register("summary_kpis", _kpi_sql(), rounded=("measure_total",), digits=2)
def summary_kpis_q(spark, sf_dir):
    return summary_kpis(summary_in_one_pass(bookings(spark, sf_dir), revenue(spark, sf_dir)))


_RECORDS = [
    ("bookings_monthly", _monthly_bookings_sql(["room_id", "property_id"])),
    ("revenue_monthly", _monthly_revenue_sql(month_sql("created_at"))),
    ("utilization", _util_sql(["room_id"])),
    ("top_tenants", _top_tenants_sql("calculated_price")),
    ("top_products", _top_products_sql(["product_name", "product_type"])),
]
# Columns of the records in one table: a row per record, null where it has no value
# (numbers as doubles, which both engines hand over with their nulls alike).
_RECORD_COLUMNS = [("month", "timestamp_ntz", "TIMESTAMP")] + [
    (c, "string", "VARCHAR") for c in ("enterprise_name", "product_name", "product_type")] + [
    (c, "double", "DOUBLE") for c in ("room_id", "property_id", "bookings_count", "booking_count", "count", "avg_revenue",
                                      "total_revenue", "booked_minutes", "available_minutes", "utilization_pct")]


def _records_sql() -> str:
    blank = ", ".join(f'CAST(NULL AS {t}) AS "{c}"' for c, _, t in _RECORD_COLUMNS)
    parts = [f"SELECT CAST(NULL AS VARCHAR) AS table_name, {blank} WHERE false"]
    parts += [f"SELECT '{name}' AS table_name, * FROM ({sql}) t" for name, sql in _RECORDS]
    typed = ", ".join(f'CAST("{c}" AS {t}) AS "{c}"' for c, _, t in _RECORD_COLUMNS)
    return f"SELECT table_name, {typed} FROM ({' UNION ALL BY NAME '.join(parts)}) u"


@register("records_json", _records_sql())
def records_json_q(spark, sf_dir):
    # Records sink: the summary tables as JSON, checked after the round trip back to columns.
    from pyspark.sql import functions as F

    tables = summary_in_one_pass(bookings(spark, sf_dir), revenue(spark, sf_dir))
    out = None
    for name, _ in _RECORDS:
        back = records_from_json(records_json(tables[name]), tables[name].schema)
        have = set(back.columns)
        back = back.select(F.lit(name).alias("table_name"), *[
            (F.col(f"`{c}`") if c in have else F.lit(None)).cast(t).alias(c) for c, t, _ in _RECORD_COLUMNS])
        out = back if out is None else out.unionByName(back)
    return out


# --- loading (S1, S2): files with padded headers, read by the loader ---------

def _written(spark, df, name: str) -> str:
    """``df`` as a Parquet folder with blanks around its headers."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/load-{name}-{uuid.uuid4().hex}"
    df.toDF(*[f" {c}  " for c in df.columns]).write.parquet(path)
    return path


def _as_double(table: str, price: str) -> str:
    return f"SELECT * REPLACE (CAST({price} AS DOUBLE) AS {price}) FROM {table}"


def _loaded(spark, df, price: str, name: str):
    return load_table(spark, _written(spark, df.withColumn(price, df[price].cast("double")), name))


@register("load_bookings", _as_double("bookings", "calculated_price"))
def load_bookings(spark, sf_dir):
    return _loaded(spark, bookings(spark, sf_dir), "calculated_price", "b")


@register("load_revenue", _as_double("revenue", "price"))
def load_revenue(spark, sf_dir):
    return _loaded(spark, revenue(spark, sf_dir), "price", "r")
