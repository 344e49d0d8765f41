"""Bookings and revenue tables derived from the driver's star-schema parquet.

``bookings``: one row per booking = one line item, joined to its order,
customer, part and supplier. ``revenue``: one row per sale = one line item
joined to its order and part. Nulls and zero durations are introduced on
purpose by fixed key rules so the null paths of every operator are reached.

The joins are plain inner equi-joins expressed declaratively; Catalyst prunes
the scans to the columns used and picks the join strategy from size
estimates (AQE re-plans at runtime), so no broadcast is forced here. Line items
are the large side and move once per join: customers meet their orders first,
and what a booking or sale keeps of several columns is computed before it moves.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


# Columns read from the driver tables, with their types. Reading with a
# declared schema skips the footer-inference job per table and per query, and
# fails loudly if the files ever change type.
SCHEMAS = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_shipdate timestamp_ntz",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz",
    "customer": "c_custkey bigint, c_name string",
    "part": "p_partkey bigint, p_name string, p_type string",
    "supplier": "s_suppkey bigint, s_nationkey int",
}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str, schema: str) -> DataFrame:
    """A driver table with a declared schema (which also prunes its columns)."""
    return spark.read.schema(schema).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _add_minutes(ts: Column, minutes: Column) -> Column:
    return F.timestamp_add("MINUTE", minutes, ts)


def _duration(l_orderkey: Column, l_quantity: Column) -> Column:
    return F.when(l_orderkey % 50 == 0, F.lit(0)).otherwise(l_quantity.cast("int") * 15)


def bookings_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate",
        F.when(F.col("l_partkey") % 97 == 0, F.lit(None).cast("double"))
         .otherwise(F.col("l_extendedprice") * (1 - F.col("l_discount")))
         .cast("decimal(18,4)").alias("calculated_price"))
    orders = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = _read(spark, sf_dir, "customer").select("c_custkey", "c_name")
    part = _read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    supplier = _read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    ordered = orders.join(customer, F.col("o_custkey") == customer.c_custkey).select(
        "o_orderkey",
        F.when(F.col("o_custkey") % 101 == 0, F.lit(None).cast("string"))
         .otherwise(F.col("c_name")).alias("enterprise_name"))
    start = _add_minutes(
        F.col("l_shipdate"),
        F.lit(360) + (F.col("l_orderkey") % 15) * 60 + (F.col("l_partkey") % 4) * 15)
    dur = _duration(F.col("l_orderkey"), F.col("l_quantity"))
    staged = (li.join(part, li.l_partkey == part.p_partkey)
              .join(supplier, F.col("l_suppkey") == supplier.s_suppkey)
              .select("l_orderkey", F.col("l_suppkey").alias("room_id"), F.col("s_nationkey").alias("property_id"),
                      F.col("p_name").alias("product_name"), F.col("p_type").alias("product_type"),
                      start.alias("booking_start_time"), dur.alias("duration_in_mins"), "l_partkey", "calculated_price"))
    staged = staged.withColumn(
        "booking_end_time",
        F.when(F.col("l_partkey") % 89 == 0, F.lit(None).cast("timestamp_ntz"))
         .otherwise(_add_minutes(F.col("booking_start_time"), F.col("duration_in_mins")))).drop("l_partkey")
    # last: the lines of an order meet here, which map-side partials by tenant collapse
    return staged.join(ordered, staged.l_orderkey == ordered.o_orderkey).select(
        "room_id", "property_id", "enterprise_name", "product_name", "product_type",
        "booking_start_time", "booking_end_time", "duration_in_mins", "calculated_price")


def revenue_view(spark: SparkSession, sf_dir: str, with_room: bool = False) -> DataFrame:
    """Sales table; ``with_room`` adds the supplier key as ``room_id`` (variant)."""
    li = _read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate",
        F.when(F.col("l_partkey") % 97 == 0, F.lit(None).cast("double"))
         .otherwise(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax")))
         .cast("decimal(18,6)").alias("price"))
    orders = _read(spark, sf_dir, "orders").select(
        "o_orderkey", _add_minutes(F.col("o_orderdate"), F.col("o_orderkey") % 1440).alias("created_at"))
    part = _read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    j = (li.join(orders, li.l_orderkey == orders.o_orderkey)
         .select("l_partkey", "l_suppkey", "created_at", "l_shipdate", "price",
                 _duration(F.col("l_orderkey"), F.col("l_quantity")).alias("duration_in_mins"))
         .join(part, F.col("l_partkey") == part.p_partkey))
    return j.select(
        "created_at",
        F.col("l_shipdate").alias("event_at"),
        F.col("p_name").alias("product_name"),
        F.col("p_type").alias("product_type"),
        "price", "duration_in_mins",
        *([F.col("l_suppkey").alias("room_id")] if with_room else []),
    )


# ---------------------------------------------------------------------------
# DuckDB text of the same views (the oracle side). Kept next to the Spark
# definitions so the two cannot drift apart unnoticed.
# ---------------------------------------------------------------------------
BOOKINGS_SQL = """
bookings AS (
  SELECT room_id, property_id, enterprise_name, product_name, product_type,
         booking_start_time,
         CASE WHEN l_partkey % 89 = 0 THEN NULL
              ELSE booking_start_time + to_minutes(duration_in_mins) END AS booking_end_time,
         duration_in_mins, calculated_price
  FROM (
    SELECT l.l_suppkey AS room_id,
           s.s_nationkey AS property_id,
           CASE WHEN o.o_custkey % 101 = 0 THEN NULL ELSE c.c_name END AS enterprise_name,
           p.p_name AS product_name,
           p.p_type AS product_type,
           l.l_shipdate + to_minutes(360 + (l.l_orderkey % 15) * 60 + (l.l_partkey % 4) * 15)
             AS booking_start_time,
           CASE WHEN l.l_orderkey % 50 = 0 THEN 0
                ELSE CAST(l.l_quantity AS INTEGER) * 15 END AS duration_in_mins,
           l.l_partkey,
           CASE WHEN l.l_partkey % 97 = 0 THEN NULL
                ELSE CAST(l.l_extendedprice * (1 - l.l_discount) AS DECIMAL(18,4)) END
             AS calculated_price
    FROM lineitem l
    JOIN orders o ON l.l_orderkey = o.o_orderkey
    JOIN customer c ON o.o_custkey = c.c_custkey
    JOIN part p ON l.l_partkey = p.p_partkey
    JOIN supplier s ON l.l_suppkey = s.s_suppkey
  ) x
)"""

_REVENUE_SQL = """
revenue AS (
  SELECT o.o_orderdate + to_minutes(o.o_orderkey % 1440) AS created_at,
         l.l_shipdate AS event_at,
         p.p_name AS product_name,
         p.p_type AS product_type,
         CASE WHEN l.l_partkey % 97 = 0 THEN NULL
              ELSE CAST(l.l_extendedprice * (1 - l.l_discount) * (1 + l.l_tax) AS DECIMAL(18,6)) END
           AS price,
         CASE WHEN l.l_orderkey % 50 = 0 THEN 0
              ELSE CAST(l.l_quantity AS INTEGER) * 15 END AS duration_in_mins{room}
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN part p ON l.l_partkey = p.p_partkey
)"""


REVENUE_SQL = _REVENUE_SQL.format(room="")
REVENUE_WITH_ROOM_SQL = _REVENUE_SQL.format(room=",\n         l.l_suppkey AS room_id")


def with_views(sql: str, *extra_ctes: str, revenue_with_room: bool = False) -> str:
    """Prefix ``sql`` with the view CTEs it names as whole words, then extras."""
    ctes = []
    if re.search(r"\bbookings\b", sql):
        ctes.append(BOOKINGS_SQL)
    if re.search(r"\brevenue\b", sql):
        ctes.append(REVENUE_WITH_ROOM_SQL if revenue_with_room else REVENUE_SQL)
    ctes.extend(extra_ctes)
    if not ctes:
        return sql
    head = "WITH " + ",\n".join(c.strip() for c in ctes)
    body = sql.lstrip()
    if body[:15].upper() == "WITH RECURSIVE ":
        return head.replace("WITH", "WITH RECURSIVE", 1) + ",\n" + body[15:]
    if body[:5].upper() == "WITH ":
        return head + ",\n" + body[5:]
    return head + "\n" + sql
