"""The standard loan schema and the alert schema."""

from __future__ import annotations

from pyspark.sql import types as T

LOAN_SCHEMA = T.StructType(
    [
        T.StructField("loan_id", T.StringType()),
        T.StructField("borrower_id", T.StringType()),
        T.StructField("borrower_name", T.StringType()),
        T.StructField("phone", T.StringType()),
        T.StructField("national_id", T.StringType()),
        T.StructField("amount", T.DoubleType()),
        T.StructField("loan_date", T.DateType()),
        T.StructField("disbursement_date", T.DateType()),
        T.StructField("approval_time", T.StringType()),
        T.StructField("officer_id", T.StringType()),
        T.StructField("officer_name", T.StringType()),
        T.StructField("branch", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("guarantor_name", T.StringType()),
        T.StructField("guarantor_phone", T.StringType()),
        T.StructField("repayment_amount", T.DoubleType()),
        T.StructField("interest_rate", T.DoubleType()),
        T.StructField("term_months", T.IntegerType()),
        T.StructField("purpose", T.StringType()),
        T.StructField("address", T.StringType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
    ]
)

STANDARD_FIELDS = LOAN_SCHEMA.fieldNames()
REQUIRED_TO_ANALYSE = ["borrower_id", "amount"]
REQUIRED_FIELDS = ["loan_id", "borrower_id", "amount", "officer_id"]
IMPORTANT_FIELDS = ["phone", "loan_date", "borrower_name", "branch", "status"]

# One row per alert. Member loans live in a separate link table (`operators.rules.alert_members`), because one
# phone or borrower can own an unbounded share of the book.
ALERT_SCHEMA = T.StructType(
    [
        T.StructField("alert_id", T.StringType()),
        T.StructField("alert_type", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("amount_at_risk", T.DoubleType()),
        T.StructField("detection_method", T.StringType()),
        T.StructField("officer_id", T.StringType()),
        T.StructField("entity_key", T.StringType()),
        T.StructField("loan_count", T.LongType()),
        T.StructField("evidence", T.StringType()),
    ]
)

FEATURE_NAMES = [
    "amount",
    "amount_log",
    "amount_vs_product_avg",
    "amount_vs_avg",
    "amount_percentile",
    "is_round_amount",
    "officer_loan_count",
    "officer_avg_amount",
    "officer_volume_z",
    "officer_approval_rate",
    "hour",
    "is_after_hours",
    "day_of_week",
    "is_weekend",
    "month",
    "is_month_end",
    "days_since_year_start",
    "shared_phone_count",
    "has_shared_phone",
    "shared_guarantor_count",
    "has_shared_guarantor",
    "national_id_loan_count",
    "geographic_density",
    "officer_geo_concentration",
    "branch_loan_count",
    "branch_avg_amount",
    "amount_vs_branch_avg",
    "borrower_loan_count",
    "has_multiple_loans",
    "borrower_total_exposure",
    "borrower_branch_count",
    "multi_branch_borrower",
    "borrower_officer_count",
]
