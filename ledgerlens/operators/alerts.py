"""Filters, counts, rankings and scores over alert tables and loan tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions import risk
from ledgerlens.functions.selection import quantiles
from ledgerlens.operators.rules import officer_volumes

# Upper bounds (included) and labels of the risk distribution.
RISK_BINS = [
    (1, 20, "0-20", "Very Low"),
    (2, 40, "21-40", "Low"),
    (3, 60, "41-60", "Medium"),
    (4, 80, "61-80", "High"),
    (5, 100, "81-100", "Critical"),
]


def filter_alerts(
    alerts: DataFrame, severity: str | None = None, method: str | None = None, limit: int | None = 50
) -> DataFrame:
    """Alerts of one severity and/or method with `total`, the number that matched before the limit."""
    matching = alerts
    if severity:
        matching = matching.filter(F.col("severity") == severity.upper())
    if method:
        matching = matching.filter(F.col("detection_method") == method)
    counted = matching.withColumn("total", matching.agg(F.count(F.lit(1))).scalar())
    if limit is None:
        return counted
    return counted.orderBy(F.desc("amount_at_risk"), "alert_id").limit(limit)


def top_severe(alerts: DataFrame, n: int = 5) -> DataFrame:
    """The `n` largest CRITICAL or HIGH alerts, CRITICAL first."""
    severe = alerts.filter(F.col("severity").isin("CRITICAL", "HIGH"))
    return severe.orderBy("severity", F.desc("amount_at_risk"), "alert_id").limit(n)


def recent(alerts: DataFrame, n: int = 10) -> DataFrame:
    """The `n` latest alerts by `created_at` (see `rules.with_created_at`), those without a time last."""
    return alerts.orderBy(F.desc_nulls_last("created_at"), "alert_id").limit(n)


def severity_counts(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("severity").agg(F.count(F.lit(1)).alias("alerts"))


def type_counts(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("alert_type").agg(
        F.translate("alert_type", "_", " ").alias("label"), F.count(F.lit(1)).alias("alerts")
    )


def portfolio_risk(alerts: DataFrame, scale: str = "engine") -> DataFrame:
    """One row: alerts per severity (unknown ones count as low), score, band and total amount at risk."""
    level = lambda *names: F.count_if(F.col("severity").isin(*names))
    score = risk.portfolio_score(F.col("severity"), scale)
    return alerts.agg(
        F.count(F.lit(1)).alias("total_alerts"),
        level("CRITICAL").alias("critical_alerts"),
        level("HIGH").alias("high_alerts"),
        level("MEDIUM").alias("medium_alerts"),
        F.count_if(~F.coalesce(F.col("severity").isin("CRITICAL", "HIGH", "MEDIUM"), F.lit(False))).alias("low_alerts"),
        score.alias("risk_score"),
        F.coalesce(F.sum("amount_at_risk"), F.lit(0.0)).alias("amount_at_risk"),
    ).withColumn("risk_band", risk.portfolio_band(F.col("risk_score")))


def _alerts_per_officer(alerts: DataFrame) -> DataFrame:
    return (
        alerts.filter(F.col("officer_id").isNotNull())
        .groupBy("officer_id")
        .agg(F.count(F.lit(1)).alias("alert_count"))
    )


def officer_ranking(loans: DataFrame, alerts: DataFrame, n: int = 10) -> DataFrame:
    """The `n` officers with the highest alert-based risk: flag rate in percent times 8 plus 5 per alert."""
    officers = (
        loans.filter(F.col("officer_id").isNotNull())
        .groupBy(F.col("officer_id").cast("string").alias("officer_id"))
        .agg(F.count("loan_id").alias("loan_count"))
    )
    flagged = F.coalesce(F.col("alert_count"), F.lit(0).cast("long"))
    rate = F.col("alert_count") / F.col("loan_count") * 100
    points = (rate * 8 + F.col("alert_count") * 5).cast("long")
    return (
        officers.join(_alerts_per_officer(alerts), "officer_id", "left")
        .withColumn("alert_count", flagged)
        .select(
            "officer_id",
            F.concat(F.lit("Officer "), F.expr("right(officer_id, 3)")).alias("name"),
            "loan_count",
            "alert_count",
            F.round(rate, 1).alias("flag_rate"),
            F.least(F.lit(100).cast("long"), points).alias("risk_score"),
        )
        .orderBy(F.desc("risk_score"), "officer_id")
        .limit(n)
    )


def officer_risk(loans: DataFrame, alerts: DataFrame, n: int | None = None) -> DataFrame:
    """Every officer with loans, total, z-score, alerts and risk: 10 per alert plus 30 for a z-score above 2."""
    points = F.col("alert_count") * 10 + F.when(F.col("z_score") > 2, 30).otherwise(0)
    ranked = (
        officer_volumes(loans)
        .join(_alerts_per_officer(alerts), "officer_id", "left")
        .withColumn("alert_count", F.coalesce("alert_count", F.lit(0).cast("long")))
        .withColumn("risk_score", F.least(F.lit(100).cast("long"), points))
        .withColumn("risk_band", risk.officer_band(F.col("risk_score")))
    )
    return ranked if n is None else ranked.orderBy(F.desc("risk_score"), "officer_id").limit(n)


def loan_risk(features: DataFrame) -> Column:
    """0 to 100 from approval rate, relative amount, hour and shared phone."""
    raw = (
        F.col("officer_approval_rate") * 30
        + F.col("amount_vs_avg") * 20
        + F.col("is_after_hours") * 25
        + F.col("shared_phone_count") * 25
    )
    return F.least(F.greatest(raw, F.lit(0.0)), F.lit(100.0))


def risk_distribution(features: DataFrame) -> DataFrame:
    """Loans per risk bin, right-closed, empty bins included."""
    score = loan_risk(features)
    bin_no = F.lit(len(RISK_BINS))
    for number, upper, _, _ in reversed(RISK_BINS[:-1]):
        bin_no = F.when(score <= upper, number).otherwise(bin_no)
    counts = features.select(bin_no.alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    bins = features.sparkSession.createDataFrame(
        [(number, text, label) for number, _, text, label in RISK_BINS], "bin int, range string, label string"
    )
    return bins.join(counts, "bin", "left").select(
        "range", "label", F.coalesce("n", F.lit(0).cast("long")).alias("loans")
    )


def portfolio_summary(loans: DataFrame) -> DataFrame:
    return loans.agg(
        F.count(F.lit(1)).alias("total_loans"),
        F.sum("amount").alias("total_amount"),
        F.count_distinct("officer_id").alias("officers"),
        F.count_distinct("branch_id").alias("branches"),
        F.min("loan_date").alias("first_date"),
        F.max("loan_date").alias("last_date"),
    )


def label_summary(loans: DataFrame) -> DataFrame:
    """Fraud loans, rate and count by fraud type, the whole book first (`fraud_type` null)."""
    whole = loans.agg(
        F.lit(None).cast("string").alias("fraud_type"),
        F.count_if("is_fraud").alias("loans"),
        F.avg(F.col("is_fraud").cast("int")).alias("rate"),
    )
    by_type = (
        loans.filter("is_fraud").groupBy("fraud_type").agg(F.count(F.lit(1)).alias("loans"), F.lit(None).alias("rate"))
    )
    return whole.unionByName(by_type.withColumn("rate", F.col("rate").cast("double")))


def detection_timeline(flags: DataFrame, methods: Sequence[str]) -> DataFrame:
    """Flagged loans per month and method, and `combined`: loans every method flagged.

    `flags` has (loan_id, month, method), possibly repeated; one pass to a row per loan, one to a row per month.
    """
    per_loan = flags.groupBy("month", "loan_id").agg(
        *[F.max((F.col("method") == m).cast("int")).alias(m) for m in methods]
    )
    both = F.lit(1)
    for m in methods:
        both = both * F.col(m)
    return per_loan.groupBy("month").agg(*[F.sum(m).alias(m) for m in methods], F.sum(both).alias("combined"))


def feature_correlations(features: DataFrame, label: str, names: Sequence[str], n: int = 10) -> DataFrame:
    """The `n` features most correlated with the label; all correlations in one aggregation.

    A constant feature has no correlation: its zero deviation gives null here, where `corr` would raise.
    """
    y = F.col(label).cast("double")

    def correlation(name: str) -> Column:
        x = F.col(name).cast("double")
        return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))

    row = features.agg(*[correlation(c).alias(c) for c in names])
    long = row.unpivot([], list(names), "feature", "correlation")
    return (
        long.filter(F.col("correlation").isNotNull() & ~F.isnan("correlation"))
        .orderBy(F.desc(F.abs("correlation")), "feature")
        .limit(n)
    )


def feature_summary(features: DataFrame, names: Sequence[str]) -> DataFrame:
    """Count, mean, sample deviation, minimum, exact quartiles and maximum per feature.

    Quartiles are linear between the two values around position (n - 1) * share.
    """
    stats = {"n": F.count, "mean": F.avg, "sd": F.stddev_samp, "minimum": F.min, "maximum": F.max}
    packed = features.agg(
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("feature"), *[f(F.col(c)).cast("double").alias(s) for s, f in stats.items()]
                )
                for c in names
            ]
        ).alias("rows")
    )
    cuts = quantiles(features, names, (0.25, 0.5, 0.75))
    quartiles = F.create_map(*[x for c in names for x in (F.lit(c), F.array(*[F.lit(v).cast("double") for v in cuts[c]]))])
    rows = packed.select(F.inline("rows")).withColumn("_q", F.element_at(quartiles, F.col("feature")))
    return rows.select(
        "feature", "n", "mean", "sd", "minimum", *[F.col("_q")[i].alias(q) for i, q in enumerate(["q1", "median", "q3"])], "maximum"
    )


def weekly_top(alerts: DataFrame, n: int = 10) -> DataFrame:
    """The `n` largest alerts per institution and week (`institution`, `week` columns)."""
    order = Window.partitionBy("institution", "week").orderBy(F.desc("amount_at_risk"), "alert_id")
    return alerts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def alert_precision(flags: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Precision and recall per alert type against confirmed outcomes.

    `flags`: distinct (alert_type, loan_id); `outcomes`: (loan_id, confirmed). Flags without an outcome are pending
    and do not count.
    """
    confirmed = outcomes.filter("confirmed").agg(F.count(F.lit(1))).scalar()
    judged = flags.join(outcomes, "loan_id")
    return (
        judged.groupBy("alert_type")
        .agg(F.count(F.lit(1)).alias("judged"), F.count_if("confirmed").alias("confirmed"))
        .withColumn("precision", F.try_divide("confirmed", "judged"))
        .withColumn("recall", F.try_divide(F.col("confirmed"), confirmed))
    )


def behaviour_monthly(loans: DataFrame) -> DataFrame:
    """Per month: after-hours share, round-amount share, and the share of the busiest officer."""
    month = F.trunc("loan_date", "month").alias("month")
    late = (F.hour("created_at") < 6) | (F.hour("created_at") >= 22)
    per_officer = loans.groupBy(month, "officer_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(late).alias("late"),
        F.count("created_at").alias("timed"),
        F.count_if(F.col("amount") % 100000 == 0).alias("round"),
    )
    busiest = F.max(F.when(F.col("officer_id").isNotNull(), F.col("n")))
    return per_officer.groupBy("month").agg(
        F.sum("n").alias("loans"),
        F.try_divide(F.sum("late"), F.sum("timed")).alias("after_hours_share"),
        (F.sum("round") / F.sum("n")).alias("round_amount_share"),
        (busiest / F.sum("n")).alias("officer_concentration"),
    )
