"""Column-role resolution: pick the first candidate name present in a table.

Resolution runs on the schema only (driver side, no job). Matching is exact
and case-sensitive, as in the original library; Spark's own name lookup is
case-insensitive by default, so names are resolved here before any Column is
built, and duplicate names differing only by case are made unique first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Candidate column names per role, in priority order. These must
# equal the original library's lists for the same tables to resolve alike.
# ---------------------------------------------------------------------------
BOOKING_START = ["start_time", "start", "start_datetime", "check_in", "booking_start_time", "booking_start"]
BOOKING_END = ["end_time", "end", "end_datetime", "check_out", "booking_end_time", "booking_end"]
BOOKING_PRICE = ["calculated_price", "price", "amount", "revenue"]
REVENUE_DATE = ["date", "created_at", "timestamp"]
REVENUE_PRICE = ["price", "amount", "revenue", "calculated_price"]
ROI_PRODUCT = ["product_name", "room_id", "property_id"]
ROI_DURATION = ["duration_in_mins", "booked_minutes", "duration", "minutes"]
ROOM_KEYS = ["room_id", "property_id"]
PRODUCT_KEYS = ["product_name", "product_type"]
TENANT = "enterprise_name"

# Error texts, equal to the original library's.
NO_START = "Could not find start datetime column in bookings"
NO_START_END = "Could not find start/end datetime columns in bookings"
NO_START_FORECAST = "Could not find start datetime for forecasting"
NO_REVENUE_DATE = "Could not find date column in revenue"
NO_REVENUE_DATE_FORECAST = "Could not find date column in revenue for forecasting"
NO_REVENUE_PRICE = "Could not find price column in revenue"
NO_PRICE = "Price column not found in revenue"
NO_TENANT = "enterprise_name column required for top_tenants"
NO_PRODUCT = "product_name or product_type required in revenue for top products"
# ---------------------------------------------------------------------------


def resolve(df: DataFrame, candidates: Sequence[str]) -> str | None:
    """First candidate that is a column of ``df`` (exact match), else None."""
    cols = set(df.columns)
    for c in candidates:
        if c in cols:
            return c
    return None


def require(df: DataFrame, candidates: Sequence[str], message: str) -> str:
    name = resolve(df, candidates)
    if name is None:
        raise ValueError(message)
    return name


def present(df: DataFrame, names: Sequence[str]) -> list[str]:
    """The subset of ``names`` that are columns of ``df``, in the given order."""
    cols = set(df.columns)
    return [n for n in names if n in cols]


def col(name: str) -> Column:
    """A Column for an exact (possibly odd) name, with backticks quoted."""
    return F.col("`" + name.replace("`", "``") + "`")


def strip_headers(df: DataFrame) -> DataFrame:
    """Strip blanks around every column name (by position, no lookup).

    Spark looks names up ignoring case, so of names that differ by case only
    one may stay. That is the one that a candidate list spells exactly (so
    ``price`` is found beside ``Price``), else the first; the others get a
    suffix.
    """
    names = [c.strip() for c in df.columns]
    known = {n for role in (BOOKING_START, BOOKING_END, BOOKING_PRICE, REVENUE_DATE, REVENUE_PRICE, ROI_PRODUCT,
                            ROI_DURATION, ROOM_KEYS, PRODUCT_KEYS, [TENANT]) for n in role}
    keeps: dict[str, int] = {}
    for i, n in enumerate(names):
        first = keeps.setdefault(n.lower(), i)
        if n in known and names[first] not in known:
            keeps[n.lower()] = i
    taken, new = {names[i].lower() for i in keeps.values()}, []
    for i, n in enumerate(names):
        if keeps[n.lower()] != i:
            k = 1
            while f"{n}_{k}".lower() in taken:
                k += 1
            n = f"{n}_{k}"
            taken.add(n.lower())
        new.append(n)
    return df.toDF(*new)


def drop_null_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Grouping drops rows whose key is null (pandas semantics)."""
    return df.dropna(subset=list(keys)) if keys else df
