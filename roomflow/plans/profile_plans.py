"""Profiling queries (E1-E9) and input diagnosis (C6) over the fixture tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.timecols import month_start
from ..operators import profile as P
from ..operators import sketches as S
from ..session import stored
from ..sources.fixtures import read_table
from .catalog import bookings, register, revenue

# bookings columns and the Spark type names they carry
BOOKING_COLUMNS = [("room_id", "bigint"), ("property_id", "int"), ("enterprise_name", "string"),
                   ("product_name", "string"), ("product_type", "string"),
                   ("booking_start_time", "timestamp_ntz"), ("booking_end_time", "timestamp_ntz"),
                   ("duration_in_mins", "int"), ("calculated_price", "decimal(18,4)")]
NUMERIC = [c for c, t in BOOKING_COLUMNS if t in ("bigint", "int", "decimal(18,4)")]
STRINGS = [c for c, t in BOOKING_COLUMNS if t == "string"]
TIMES = [c for c, t in BOOKING_COLUMNS if t == "timestamp_ntz"]


def _union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


@register("profile_shape", f"""
SELECT COUNT(*) AS rows, CAST({len(BOOKING_COLUMNS)} AS BIGINT) AS columns,
       COUNT(*) * {len(BOOKING_COLUMNS)} AS elements FROM bookings""")
def profile_shape(spark, sf_dir):
    return P.profile_shape(bookings(spark, sf_dir))


@register("profile_columns", _union([
    f"SELECT CAST({i} AS BIGINT) AS position, '{c}' AS \"column\", '{t}' AS dtype, "
    f"SUM(CASE WHEN {c} IS NULL{' OR isnan(' + c + ')' if t == 'double' else ''} THEN 1 ELSE 0 END)"
    f"::BIGINT AS null_count FROM bookings"
    for i, (c, t) in enumerate(BOOKING_COLUMNS)]))
def profile_columns(spark, sf_dir):
    return P.profile_columns(bookings(spark, sf_dir))


def _numeric_sql(c: str) -> str:
    v = f"CAST({c} AS DOUBLE)"
    q = ", ".join(f"quantile_cont({v}, {p}) AS p{int(p * 100)}" for p in P.QUARTILES)
    return (f"SELECT '{c}' AS \"column\", COUNT({c}) AS count, avg({v}) AS mean, stddev_samp({v}) AS std, "
            f"min({v}) AS min, {q}, max({v}) AS max FROM bookings")


@register("profile_numeric", _union([_numeric_sql(c) for c in NUMERIC]), rounded=("mean", "std"))
def profile_numeric(spark, sf_dir):
    return P.profile_numeric(bookings(spark, sf_dir))


def _datetime_sql(c: str) -> str:
    us = f"CAST(epoch_us({c}) AS DOUBLE)"

    def ts(x: str) -> str:
        return f"make_timestamp(CAST(floor({x} + 0.5) AS BIGINT))"

    mean = f"make_timestamp(CAST((2 * SUM(epoch_us({c})) + COUNT({c})) // (2 * COUNT({c})) AS BIGINT))"
    q = ", ".join(f"{ts(f'quantile_cont({us}, {p})')} AS p{int(p * 100)}" for p in P.QUARTILES)
    return (f"SELECT '{c}' AS \"column\", COUNT({c}) AS count, {mean} AS mean, "
            f"{ts(f'min({us})')} AS min, {q}, {ts(f'max({us})')} AS max FROM bookings")


@register("profile_datetime", _union([_datetime_sql(c) for c in TIMES]))
def profile_datetime(spark, sf_dir):
    return P.profile_datetime(bookings(spark, sf_dir))


def _categorical_sql(c: str) -> str:
    return (f"SELECT '{c}' AS \"column\", SUM(cnt) AS count, COUNT(*) AS \"unique\", "
            f"arg_min(v, (-cnt, v)) AS top, max(cnt) AS freq "
            f"FROM (SELECT {c} AS v, COUNT(*) AS cnt FROM bookings WHERE {c} IS NOT NULL GROUP BY {c}) g")


@register("profile_categorical", _union([_categorical_sql(c) for c in STRINGS]))
def profile_categorical(spark, sf_dir):
    return P.profile_categorical(bookings(spark, sf_dir))


ORDERS_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
                  "o_orderpriority"]
ORDERS_SCHEMA = ("o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
                 "o_orderdate timestamp_ntz, o_orderpriority string")


@register("profile_min_max_unique", _union([
    f"SELECT '{c}' AS \"column\", CAST(min({c}) AS VARCHAR) AS min, CAST(max({c}) AS VARCHAR) AS max, "
    f"COUNT(DISTINCT {c}) AS \"unique\" FROM orders" for c in ORDERS_COLUMNS]))
def profile_min_max_unique(spark, sf_dir):
    return P.profile_min_max_unique(read_table(spark, sf_dir, "orders", ORDERS_SCHEMA))


@register("profile_duplicates", """
SELECT (SELECT COUNT(*) FROM lineitem) AS rows, COUNT(*) AS distinct_rows,
       (SELECT COUNT(*) FROM lineitem) - COUNT(*) AS duplicate_rows
FROM (SELECT DISTINCT * FROM lineitem) g""")
def profile_duplicates(spark, sf_dir):
    return P.profile_duplicates(spark.read.parquet(f"{sf_dir.rstrip('/')}/lineitem.parquet"))


# Previews show the price as a double.
_PREVIEW = "SELECT * REPLACE (CAST(calculated_price AS DOUBLE) AS calculated_price) FROM bookings ORDER BY "


def _shown(df):
    return df.withColumn("calculated_price", df["calculated_price"].cast("double"))


@register("preview_head", _PREVIEW
          + ", ".join(f"{c} ASC NULLS LAST" for c, _ in BOOKING_COLUMNS) + " LIMIT 5")
def preview_head(spark, sf_dir):
    return P.preview_head(_shown(bookings(spark, sf_dir)))


@register("preview_tail", _PREVIEW
          + ", ".join(f"{c} DESC NULLS LAST" for c, _ in BOOKING_COLUMNS) + " LIMIT 5")
def preview_tail(spark, sf_dir):
    return P.preview_tail(_shown(bookings(spark, sf_dir)))


def _diagnose_sql(table: str, roles, present: list[str], types: dict[str, str]) -> str:
    parts = []
    for role, cands, target in roles:
        name = next((c for c in cands if c in present), None)
        cand = ", ".join(cands)
        if name is None:
            parts.append(f"SELECT '{role}' AS role, '{cand}' AS candidates, CAST(NULL AS VARCHAR) AS resolved, "
                         f"COUNT(*) AS rows, CAST(NULL AS BIGINT) AS nulls, "
                         f"CAST(NULL AS BIGINT) AS bad_values FROM {table}")
            continue
        duck_target = {"timestamp_ntz": "TIMESTAMP", "double": "DOUBLE", "string": "VARCHAR"}[target]
        parts.append(
            f"SELECT '{role}' AS role, '{cand}' AS candidates, '{name}' AS resolved, COUNT(*) AS rows, "
            f"COUNT(*) - COUNT({name}) AS nulls, "
            f"SUM(CASE WHEN {name} IS NOT NULL AND TRY_CAST({name} AS {duck_target}) IS NULL "
            f"THEN 1 ELSE 0 END)::BIGINT AS bad_values FROM {table}")
    return _union(parts)


_REVENUE_COLUMNS = ["created_at", "event_at", "product_name", "product_type", "price", "duration_in_mins"]


@register("diagnose_bookings", _diagnose_sql("bookings", P.BOOKING_ROLES,
                                             [c for c, _ in BOOKING_COLUMNS], dict(BOOKING_COLUMNS)))
def diagnose_bookings(spark, sf_dir):
    return P.diagnose_columns(bookings(spark, sf_dir), P.BOOKING_ROLES)


@register("diagnose_revenue", _diagnose_sql("revenue", P.REVENUE_ROLES, _REVENUE_COLUMNS, {}))
def diagnose_revenue(spark, sf_dir):
    return P.diagnose_columns(revenue(spark, sf_dir), P.REVENUE_ROLES)



# --- mergeable profiles: sketches stored per month, merged, checked against the table ------

def _merged_sketches(spark, sf_dir):
    # the view is joined once: sketches and the check read what it wrote
    b = stored(bookings(spark, sf_dir).select(month_start(F.col("booking_start_time")).alias("month"), *NUMERIC), "numbers")
    parts = S.column_sketches(b, ["month"], NUMERIC)
    return b, S.merge_sketches(stored(parts, "sketches"))


@register("profile_quantile_sketches", _union([
    f"SELECT '{c}' AS \"column\", CAST({p} AS DOUBLE) AS p, COUNT({c}) AS count, TRUE AS within FROM bookings"
    for c in NUMERIC for p in P.QUARTILES]))
def profile_quantile_sketches(spark, sf_dir):
    b, merged = _merged_sketches(spark, sf_dir)
    answers = stored(S.sketched_quantiles(merged, P.QUARTILES), "quantiles")
    return S.check_quantiles(b, answers)


@register("profile_distinct_sketches", _union([
    f"SELECT '{c}' AS \"column\", COUNT({c}) AS count, COUNT(DISTINCT {c}) AS \"unique\", TRUE AS within FROM bookings"
    for c in NUMERIC]))
def profile_distinct_sketches(spark, sf_dir):
    b, merged = _merged_sketches(spark, sf_dir)
    exact = P.profile_min_max_unique(b.select(*NUMERIC)).select("column", "unique")
    found = S.sketched_distinct(merged).withColumnRenamed("unique", "estimate").join(exact, "column")
    off = F.abs(F.col("estimate") - F.col("unique"))
    return found.select("column", "count", "unique", (off <= 4 * S.distinct_error() * F.col("unique")).alias("within"))


@register("profile_top_values", _union([
    f"SELECT \"column\", count, top, freq FROM ({_categorical_sql(c)}) q" for c in STRINGS]))
def profile_top_values(spark, sf_dir):
    return S.exact_top(bookings(spark, sf_dir), STRINGS).drop("recounted")


@register("diagnose_bookings_while_loading", _diagnose_sql("bookings", P.BOOKING_ROLES,
                                                           [c for c, _ in BOOKING_COLUMNS], dict(BOOKING_COLUMNS)))
def diagnose_bookings_while_loading(spark, sf_dir):
    # The load itself (here a write) collects the metrics.
    load = P.LoadDiagnosis(bookings(spark, sf_dir), P.BOOKING_ROLES)
    stored(load.table, "loaded")
    return load.rows()
