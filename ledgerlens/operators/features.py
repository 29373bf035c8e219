"""Feature columns over a loan table, with a fit/apply split.

`fit` keeps officer and branch statistics for later batches; `batch_stats` computes what is relative to the batch
at hand. Both write one row per key to the shared folder: the joins in `add_features` then know the real size of
each table, so small ones (officers, branches, products) are broadcast by Catalyst and large ones (phones,
borrowers, cells) are shuffled, with AQE splitting the loans of a hot key. Per-key window functions would put a
hot key into one task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.clock import is_after_hours
from ledgerlens.functions.ranks import percentile_ranks
from ledgerlens.operators.rules import GEO_DIGITS
from ledgerlens.schema import FEATURE_NAMES
from ledgerlens.session import written_table

GROUPS = ("amount", "officer", "time", "network", "geo", "branch", "borrower")
ROUND_AMOUNT = 100000


@dataclass
class FeatureStats:
    """Written statistics tables by name and the few whole-batch numbers."""

    tables: dict[str, DataFrame] = field(default_factory=dict)
    numbers: dict[str, object] = field(default_factory=dict)


def _cell(df: DataFrame) -> DataFrame:
    return df.withColumn("cell_lat", F.round("latitude", GEO_DIGITS)).withColumn(
        "cell_lon", F.round("longitude", GEO_DIGITS)
    )


def _known(df: DataFrame, *keys: str) -> DataFrame:
    return df.dropna(subset=list(keys))


def _officer_stats(loans: DataFrame) -> DataFrame:
    return _known(loans, "officer_id").groupBy("officer_id").agg(
        F.count("loan_id").alias("officer_loan_count"),
        F.sum("amount").alias("officer_total_amount"),
        F.avg("amount").alias("officer_avg_amount"),
        F.coalesce(F.stddev_samp("amount"), F.lit(0.0)).alias("officer_amount_std"),
    )


def _branch_stats(loans: DataFrame) -> DataFrame:
    return _known(loans, "branch_id").groupBy("branch_id").agg(
        F.count("loan_id").alias("branch_loan_count"),
        F.sum("amount").alias("branch_total_amount"),
        F.avg("amount").alias("branch_avg_amount"),
    )


_FITTED: dict[str, tuple[str, Callable[[DataFrame], DataFrame]]] = {
    "officer": ("officer", _officer_stats),
    "branch": ("branch", _branch_stats),
}


_BATCH: dict[str, tuple[str, Callable[[DataFrame], DataFrame]]] = {
    "product": (
        "amount",
        lambda d: _known(d, "product_id").groupBy("product_id").agg(F.avg("amount").alias("product_avg")),
    ),
    "percentile": ("amount", lambda d: percentile_ranks(d, "amount", "amount_percentile")),
    "approval": (
        "officer",
        lambda d: _known(d, "officer_id")
        .groupBy("officer_id")
        .agg(F.avg((~F.col("status").eqNullSafe("rejected")).cast("int")).alias("officer_approval_rate")),
    ),
    "phone": (
        "network",
        lambda d: _known(d, "phone_number")
        .groupBy("phone_number")
        .agg(F.count_distinct("borrower_id").alias("shared_phone_count")),
    ),
    "guarantor": (
        "network",
        lambda d: _known(d, "guarantor_name")
        .groupBy("guarantor_name")
        .agg(F.count("loan_id").alias("shared_guarantor_count")),
    ),
    "national_id": (
        "network",
        lambda d: _known(d, "national_id")
        .groupBy("national_id")
        .agg(F.count("loan_id").alias("national_id_loan_count")),
    ),
    "cell": (
        "geo",
        lambda d: _cell(_known(d, "latitude", "longitude"))
        .groupBy("cell_lat", "cell_lon")
        .agg(F.count("loan_id").alias("geographic_density")),
    ),
    "officer_cell": (
        "geo",
        lambda d: _cell(_known(d, "latitude", "longitude", "officer_id"))
        .groupBy("officer_id", "cell_lat", "cell_lon")
        .agg(F.count("loan_id").alias("officer_geo_concentration")),
    ),
    "borrower": (
        "borrower",
        lambda d: _known(d, "borrower_id")
        .groupBy("borrower_id")
        .agg(
            F.count("loan_id").alias("borrower_loan_count"),
            F.sum("amount").alias("borrower_total_exposure"),
            F.count_distinct("branch_id").alias("borrower_branch_count"),
            F.count_distinct("officer_id").alias("borrower_officer_count"),
        ),
    ),
}


def _written(loans: DataFrame, plans: dict, groups: Sequence[str]) -> dict[str, DataFrame]:
    wanted = {name: build for name, (group, build) in plans.items() if group in groups}
    with ThreadPoolExecutor(max_workers=4) as pool:
        done = {name: pool.submit(lambda b=build, n=name: written_table(b(loans), n)) for name, build in wanted.items()}
        return {name: future.result() for name, future in done.items()}


def fit(loans: DataFrame, groups: Sequence[str] = GROUPS) -> FeatureStats:
    """Officer and branch statistics, to be reused on later batches."""
    stats = FeatureStats(_written(loans, _FITTED, groups))
    if "officer" in groups:
        row = (
            stats.tables["officer"]
            .agg(
                F.count(F.lit(1)).alias("n"),
                F.avg("officer_loan_count").alias("mean"),
                F.stddev_samp("officer_loan_count").alias("sd"),
            )
            .first()
        )
        stats.numbers.update(officers=row["n"], officer_mean=row["mean"], officer_sd=row["sd"])
    return stats


def _event_time(loans: DataFrame) -> Column:
    for name in ("created_at", "disbursement_date", "loan_date"):
        if name in loans.columns:
            return F.col(name)
    raise ValueError("no date column")


def batch_stats(loans: DataFrame, groups: Sequence[str] = GROUPS) -> FeatureStats:
    """Statistics relative to this batch: means, ranks and counts per shared identifier."""
    stats = FeatureStats(_written(loans, _BATCH, groups))
    if "amount" in groups or "time" in groups:
        row = loans.agg(F.avg("amount").alias("mean"), F.min(_event_time(loans)).alias("first")).first()
        stats.numbers.update(
            amount_mean=row["mean"], year_start=date(row["first"].year, 1, 1) if row["first"] else None
        )
    return stats


def _flag(test: Column) -> Column:
    return F.coalesce(test.cast("int"), F.lit(0))


def _or_zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0))


def _amount(df: DataFrame, stats: FeatureStats) -> DataFrame:
    amount = F.col("amount")
    mean = stats.numbers["amount_mean"]
    return (
        df.join(stats.tables["product"], "product_id", "left")
        .join(stats.tables["percentile"], "amount", "left")
        .withColumns(
            {
                "amount_log": _or_zero(F.log1p(amount)),
                "amount_vs_product_avg": _or_zero(amount / (F.col("product_avg") + 1)),
                "amount_vs_avg": _or_zero(amount / (F.lit(mean).cast("double") + 1)),
                "amount_percentile": _or_zero(F.col("amount_percentile")),
                "is_round_amount": _flag(amount % ROUND_AMOUNT == 0),
                "amount": F.coalesce(amount, F.lit(0.0)),
            }
        )
        .drop("product_avg")
    )


def _officer(df: DataFrame, stats: FeatureStats) -> DataFrame:
    n, mean, sd = (stats.numbers[k] for k in ("officers", "officer_mean", "officer_sd"))
    z = F.lit(0.0)
    if n > 2 and sd:
        z = F.coalesce((F.col("officer_loan_count") - F.lit(mean)) / F.lit(sd), F.lit(0.0))
    kept = stats.tables["officer"].select("officer_id", "officer_loan_count", "officer_avg_amount")
    return (
        df.join(kept, "officer_id", "left")
        .join(stats.tables["approval"], "officer_id", "left")
        .withColumns(
            {
                "officer_volume_z": z,
                "officer_loan_count": _or_zero(F.col("officer_loan_count")),
                "officer_avg_amount": _or_zero(F.col("officer_avg_amount")),
                "officer_approval_rate": _or_zero(F.col("officer_approval_rate")),
            }
        )
    )


def _time(df: DataFrame, stats: FeatureStats) -> DataFrame:
    moment = _event_time(df)
    hour = F.coalesce(F.hour(moment.cast("timestamp_ntz")), F.lit(12))
    weekday = F.coalesce(F.weekday(moment), F.lit(0))
    start = F.lit(stats.numbers["year_start"])
    return df.withColumns(
        {
            "hour": hour,
            "is_after_hours": is_after_hours(hour).cast("int"),
            "day_of_week": weekday,
            "is_weekend": (weekday >= 5).cast("int"),
            "month": F.coalesce(F.month(moment), F.lit(1)),
            "is_month_end": _flag(F.dayofmonth(moment) > 27),
            "days_since_year_start": _or_zero(F.datediff(moment, start)),
        }
    )


def _network(df: DataFrame, stats: FeatureStats) -> DataFrame:
    t = stats.tables
    phones, backers = F.col("shared_phone_count"), F.col("shared_guarantor_count")
    return (
        df.join(t["guarantor"], "guarantor_name", "left")
        .join(t["national_id"], "national_id", "left")
        .join(t["phone"], "phone_number", "left")
        .withColumns(
            {
                "shared_phone_count": _or_zero(phones),
                "has_shared_phone": _flag(phones > 1),
                "shared_guarantor_count": _or_zero(backers),
                "has_shared_guarantor": _flag(backers > 2),
                "national_id_loan_count": _or_zero(F.col("national_id_loan_count")),
            }
        )
    )


def _geo(df: DataFrame, stats: FeatureStats) -> DataFrame:
    cell = ["cell_lat", "cell_lon"]
    return (
        _cell(df)
        .join(stats.tables["cell"], cell, "left")
        .join(stats.tables["officer_cell"], ["officer_id", *cell], "left")
        .withColumns(
            {n: _or_zero(F.col(n)) for n in ("geographic_density", "officer_geo_concentration")},
        )
        .drop(*cell)
    )


def _branch(df: DataFrame, stats: FeatureStats) -> DataFrame:
    kept = stats.tables["branch"].select("branch_id", "branch_loan_count", "branch_avg_amount")
    average = F.col("branch_avg_amount")
    return df.join(kept, "branch_id", "left").withColumns(
        {
            "amount_vs_branch_avg": _or_zero(F.col("amount") / (average + 1)),
            "branch_loan_count": _or_zero(F.col("branch_loan_count")),
            "branch_avg_amount": _or_zero(average),
        }
    )


def _borrower(df: DataFrame, stats: FeatureStats) -> DataFrame:
    count, branches = F.col("borrower_loan_count"), F.col("borrower_branch_count")
    return df.join(stats.tables["borrower"], "borrower_id", "left").withColumns(
        {
            "borrower_loan_count": _or_zero(count),
            "has_multiple_loans": _flag(count > 1),
            "borrower_total_exposure": _or_zero(F.col("borrower_total_exposure")),
            "borrower_branch_count": _or_zero(branches),
            "multi_branch_borrower": _flag(branches > 1),
            "borrower_officer_count": _or_zero(F.col("borrower_officer_count")),
        }
    )


_ADD = {
    "amount": _amount,
    "officer": _officer,
    "time": _time,
    "network": _network,
    "geo": _geo,
    "branch": _branch,
    "borrower": _borrower,
}


def add_features(
    loans: DataFrame, fitted: FeatureStats | None = None, groups: Sequence[str] = GROUPS
) -> DataFrame:
    """Loans plus their feature columns; officer and branch statistics come from `fitted` when it is given."""
    fitted = fitted or fit(loans, groups)
    batch = batch_stats(loans, groups)
    stats = FeatureStats({**batch.tables, **fitted.tables}, {**batch.numbers, **fitted.numbers})
    result = loans
    # joins that shuffle the loans come first, widest key first: later ones then carry neither that key nor other features
    for group in ("network", "geo", "borrower", "amount", "branch", "officer", "time"):
        if group in groups:
            result = _ADD[group](result, stats)
    return result


def feature_matrix(loans: DataFrame, fitted: FeatureStats | None = None, keep: Sequence[str] = ("loan_id",)) -> DataFrame:
    """`keep` columns and the 33 features as doubles, nulls as 0."""
    full = add_features(loans, fitted)
    kept = [c for c in keep if c not in FEATURE_NAMES]
    return full.select(*kept, *[F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(n) for n in FEATURE_NAMES])
