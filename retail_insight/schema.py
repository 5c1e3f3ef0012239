"""Canonical purchase columns and the guards every operator starts with."""

from __future__ import annotations

from pyspark.sql import DataFrame

# Source header -> canonical column. `Customer ID` is listed
# before `Customer`, so it wins when an export carries both.
HEADER_NAMES = {
    "Customer ID": "customer_id",
    "Customer": "customer_id",
    "Customer Name": "customer_name",
    "Customer Age": "customer_age",
    "Gender": "gender",
    "Purchase Date": "purchase_date_raw",
    "Product Category": "product_category",
    "Product Price": "product_price",
    "Quantity": "quantity",
    "Total Purchase Amount": "total_amount",
    "Payment Method": "payment_method",
    "Returns": "returns",
    "Churn": "churn",
}

# The canonical columns of the table, the inputs of its reports and what they derive.
UNKNOWN = "unknown"
CATEGORICAL = ("gender", "product_category", "payment_method")

RFM_INPUT = ("customer_id", "purchase_ts", "total_amount")
RFM_METRICS = ("recency_days", "frequency", "monetary")

PRODUCT_INPUT = (
    "product_category",
    "product_price",
    "quantity",
    "total_amount",
    "returns",
)
PRODUCT_METRICS = (
    "avg_price",
    "avg_quantity",
    "total_revenue",
    "avg_returns_rate",
)


def has(df: DataFrame, *columns: str) -> bool:
    """True when every named column is present."""
    return set(columns) <= set(df.columns)


def require(df: DataFrame, *columns: str) -> None:
    """Raise ``ValueError`` naming the columns an operator cannot do without."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")


def require_rows(df: DataFrame, what: str) -> None:
    """Raise ``ValueError`` when ``df`` holds no row at all."""
    if df.isEmpty():
        raise ValueError(f"no usable rows: {what}")
