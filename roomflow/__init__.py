"""roomflow: occupancy and sales analytics as Spark DataFrame operators.

Every operator takes DataFrames and returns a lazy DataFrame (or a dict of
them); nothing is collected except the k cluster means of the clustering
step. Column roles are resolved by candidate names (see
``roomflow.functions.columns``).
"""

from .operators.forecast import (
    bookings_forecast,
    forecast_as_arrays,
    forecast_series,
    revenue_forecast,
)
from .operators.monthly import monthly_bookings_and_revenue, monthly_revenue_summary
from .operators.profile import (
    diagnose_columns,
    exact_quantiles,
    preview_head,
    preview_tail,
    profile_categorical,
    profile_columns,
    profile_datetime,
    profile_duplicates,
    profile_min_max_unique,
    profile_numeric,
    profile_shape,
)
from .operators.ranking import high_roi_products, product_revenue_rate, top_revenue_products, top_tenants
from .operators.recommend import ml_product_upsell, ml_underutilized_rooms
from .operators.report import generate_report
from .operators.summary import summary, summary_kpis
from .operators.utilization import recommend_underutilized, utilization_metrics
from .sources.io import load_data, load_table, records_json, write_records, write_report

__all__ = [
    "bookings_forecast", "forecast_as_arrays", "forecast_series", "revenue_forecast",
    "monthly_bookings_and_revenue", "monthly_revenue_summary",
    "diagnose_columns", "exact_quantiles", "preview_head", "preview_tail", "profile_categorical",
    "profile_columns", "profile_datetime", "profile_duplicates", "profile_min_max_unique",
    "profile_numeric", "profile_shape",
    "high_roi_products", "product_revenue_rate", "top_revenue_products", "top_tenants",
    "ml_product_upsell", "ml_underutilized_rooms", "generate_report", "summary", "summary_kpis",
    "recommend_underutilized", "utilization_metrics",
    "load_data", "load_table", "records_json", "write_records", "write_report",
]
