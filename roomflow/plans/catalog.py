"""Registry of named queries: a Spark callable and, where SQL can say it, the
equivalent DuckDB SQL over the driver's tables (the correctness oracle).

Each Spark callable takes ``(spark, sf_dir)``, builds the bookings / revenue
tables from the parquet files in ``sf_dir`` and returns a lazy DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.fixtures import bookings_view, revenue_view, with_views

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None, *, revenue_with_room: bool = False,
             extra_ctes: tuple[str, ...] = (), rounded: tuple[str, ...] = (), digits: int = 6):
    """Register ``fn`` as query ``name``; ``sql`` is wrapped with the view CTEs.

    ``rounded`` names double results that depend on the order rows are added in
    (means of rates, fits); they are rounded to ``digits`` places here, on both
    sides, for the comparison. Operators themselves never round.
    """
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query name {name}")
        QUERIES[name] = (lambda spark, sf_dir: _rounded(fn(spark, sf_dir), rounded, digits)) if rounded else fn
        if sql is not None:
            full = with_views(sql, *extra_ctes, revenue_with_room=revenue_with_room)
            if rounded:
                full = (f"SELECT * REPLACE ({', '.join(f'round({c}, {digits}) AS {c}' for c in rounded)}) "
                        f"FROM ({full}) q")
            ORACLE[name] = full
        return fn
    return deco


def _rounded(df: DataFrame, columns: tuple[str, ...], digits: int) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def bookings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bookings_view(spark, sf_dir)


def revenue(spark: SparkSession, sf_dir: str, with_room: bool = False) -> DataFrame:
    return revenue_view(spark, sf_dir, with_room=with_room)


# ---------------------------------------------------------------------------
# SQL fragments shared by several oracle queries (DuckDB dialect).
# ---------------------------------------------------------------------------

def money_total_sql(x: str) -> str:
    return f"COALESCE(CAST(SUM({x}) AS DOUBLE), 0.0)"


def money_mean_sql(x: str) -> str:
    return f"(CAST(SUM({x}) AS DOUBLE) / COUNT({x}))"


def month_sql(ts: str) -> str:
    return f"date_trunc('month', {ts})"


def at_hour_sql(ts: str, hour: int) -> str:
    frac = f"((epoch_us({ts}) % 1000000) + 1000000) % 1000000"
    return f"(date_trunc('day', {ts}) + to_hours({hour}) + to_microseconds({frac}))"


def clipped_micros_sql(s: str, e: str, h0: int, h1: int) -> str:
    return (f"CASE WHEN {s} IS NULL OR {e} IS NULL THEN NULL ELSE greatest("
            f"epoch_us(least({e}, {at_hour_sql(e, h1)})) - "
            f"epoch_us(greatest({s}, {at_hour_sql(s, h0)})), 0) END")
