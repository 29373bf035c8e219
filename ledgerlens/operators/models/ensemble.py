"""Time features, weighted combination of model scores, prompts, and the hook for outside scorers."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ledgerlens.functions import risk
from ledgerlens.functions.clock import clock_parts, is_after_hours

# Weight of each model's score; a model without a listed weight counts UNLISTED_WEIGHT.
WEIGHTS = {
    "isolation_forest": 0.25,
    "autoencoder": 0.25,
    "huggingface": 0.30,
    "local_outlier": 0.10,
    "one_class_svm": 0.10,
}
UNLISTED_WEIGHT = 0.2

# Prompt labels and the columns behind them, in order, with the text after the value.
PROMPT_FIELDS = [
    ("Amount", "amount", " UGX"),
    ("Borrower", "borrower_name", ""),
    ("Officer", "officer_id", ""),
    ("Date", "loan_date", ""),
    ("Time", "approval_time", ""),
    ("Branch", "branch", ""),
    ("Status", "status", ""),
]

TIME_FEATURES = ["amount", "hour", "minute", "after_hours", "weekday", "month", "weekend"]


def time_features(loans: DataFrame) -> dict[str, Column]:
    """Amount, clock and calendar columns; an unreadable time counts as 12:00, a missing date as a June Wednesday."""
    hour, minute = clock_parts(F.col("approval_time"))
    date = F.try_to_date(F.substring(F.col("loan_date").cast("string"), 1, 10), "yyyy-MM-dd")
    weekday = F.coalesce(F.weekday(date), F.lit(2))
    columns = {
        "amount": F.coalesce(F.col("amount").cast("double"), F.lit(0.0)),
        "hour": hour,
        "minute": minute,
        "after_hours": is_after_hours(hour, "ensemble").cast("int"),
        "weekday": weekday,
        "month": F.coalesce(F.month(date), F.lit(6)),
        "weekend": (weekday >= 5).cast("int"),
    }
    return {name: value.cast("double") for name, value in columns.items()}


def ensemble_features(loans: DataFrame, key: str = "loan_id") -> DataFrame:
    return loans.select(key, *[c.alias(n) for n, c in time_features(loans).items()])


def sigmoid(raw: Column) -> Column:
    return 1 / (1 + F.exp(-raw))


def combine_scores(
    df: DataFrame, scores: Mapping[str, str], weights: Mapping[str, float] = WEIGHTS
) -> DataFrame:
    """Weighted mean of the scores a row has, 0.5 when it has none; also how many there were and the risk level.

    `scores` maps model names to score columns (0 to 1, null when the model gave none).
    """
    zero = F.lit(0.0)
    weighted, total, used = zero, zero, F.lit(0)
    for model, column in scores.items():
        weight = F.lit(weights.get(model, UNLISTED_WEIGHT))
        value = F.col(column)
        weighted = weighted + F.coalesce(value * weight, zero)
        total = total + F.when(value.isNotNull(), weight).otherwise(zero)
        used = used + value.isNotNull().cast("int")
    score = F.coalesce(F.try_divide(weighted, total), F.lit(0.5))
    return df.withColumn("ensemble_score", score).withColumns(
        {"risk_level": risk.score_level(F.col("ensemble_score")), "models_used": used}
    )


def flagged_loans(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Loans above the threshold as `ml_score` and `ml_risk`, with the whole table's loan and flag counts."""
    counts = scored.agg(
        F.struct(
            F.count(F.lit(1)).alias("total"), F.count_if(F.col("ensemble_score") > threshold).alias("flagged")
        )
    ).scalar()
    return (
        scored.filter(risk.is_fraud(F.col("ensemble_score"), threshold))
        .withColumn("_c", counts)
        .withColumns({"total_loans": F.col("_c.total"), "ml_flagged": F.col("_c.flagged")})
        .withColumnsRenamed({"ensemble_score": "ml_score", "risk_level": "ml_risk"})
        .drop("_c")
    )


def prompt_text(loans: DataFrame, column: str = "prompt") -> DataFrame:
    """One line per loan, `Label: value` parts in fixed order; absent fields are left out."""
    parts = [
        F.concat(F.lit(f"{label}: "), F.col(name).cast("string"), F.lit(suffix))
        for label, name, suffix in PROMPT_FIELDS
        if name in loans.columns
    ]
    return loans.withColumn(column, F.concat_ws(" | ", *parts))


def batch_score(
    df: DataFrame,
    load: Callable[[], Callable[[pd.Series], pd.Series]],
    column: str,
    alias: str = "score",
    batch_size: int = 32,
) -> DataFrame:
    """Score a column with an outside model: `load` runs once per task, its result gets `batch_size` rows at a time."""

    @F.pandas_udf(DoubleType())
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for batch in batches:
            pieces = [model(batch.iloc[i : i + batch_size]) for i in range(0, len(batch), batch_size)]
            yield pd.concat(pieces) if pieces else batch.astype("float64")

    return df.withColumn(alias, scored(F.col(column)))


def attach_level(df: DataFrame, score: str) -> DataFrame:
    """The score as `ml_fraud_score` with its level; the bounds themselves belong to the lower level here."""
    return df.withColumn("ml_fraud_score", F.col(score)).withColumn(
        "ml_risk_level", risk.score_level(F.col(score), closed=False)
    )
