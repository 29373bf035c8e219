"""Writers for results, reports and the analysis history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

HISTORY_SCHEMA = T.StructType(
    [
        T.StructField("session_id", T.StringType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("file_name", T.StringType()),
        T.StructField("loans_analyzed", T.LongType()),
        T.StructField("alerts_generated", T.LongType()),
        T.StructField("risk_score", T.IntegerType()),
        T.StructField("results", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)


def json_records(df: DataFrame) -> DataFrame:
    """Each row as one JSON text: nulls kept, NaN as null, dates and times in ISO form."""
    plain = []
    for field in df.schema.fields:
        value = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            value = F.when(~F.isnan(value), value)
        elif isinstance(field.dataType, T.DateType):
            value = F.date_format(value, "yyyy-MM-dd")
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            value = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss")
        plain.append(value.alias(field.name))
    return df.select(F.to_json(F.struct(*plain), {"ignoreNullFields": "false"}).alias("value"))


def write_results(path: str, summary: DataFrame, alerts: DataFrame, officers: DataFrame) -> None:
    """Summary, alerts and officers as JSON lines in three folders."""
    for name, df in (("summary", summary), ("alerts", alerts), ("officers", officers)):
        json_records(df).write.mode("overwrite").text(f"{path}/{name}")


def report_alerts(alerts: DataFrame) -> DataFrame:
    return alerts.select(
        F.coalesce("severity", F.lit("")).alias("Severity"),
        F.translate(F.coalesce("alert_type", F.lit("")), "_", " ").alias("Type"),
        F.coalesce("title", F.lit("")).alias("Title"),
        F.coalesce("description", F.lit("")).alias("Description"),
        F.coalesce("amount_at_risk", F.lit(0.0)).cast("decimal(38,2)").alias("Amount at Risk (UGX)"),
        F.coalesce("officer_id", F.lit("")).alias("Officer ID"),
    )


def report_officers(officers: DataFrame) -> DataFrame:
    return officers.select(
        F.col("officer_id").alias("Officer ID"),
        F.coalesce("name", F.lit("")).alias("Name"),
        F.col("loan_count").alias("Loan Count"),
        F.col("alert_count").alias("Alert Count"),
        F.col("risk_score").alias("Risk Score"),
    )


def report_header(summary: DataFrame) -> DataFrame:
    """The report's heading lines, one metric per row."""
    labels = {
        "Risk Score": F.concat(F.col("risk_score").cast("string"), F.lit("/100")),
        "Total Records": F.col("total_records").cast("string"),
        "Critical Alerts": F.col("critical_alerts").cast("string"),
        "High Risk Alerts": F.col("high_alerts").cast("string"),
        "Medium Risk Alerts": F.col("medium_alerts").cast("string"),
    }
    rows = F.array(*[F.struct(F.lit(k).alias("Metric"), v.alias("Value")) for k, v in labels.items()])
    return summary.select(F.inline(rows))


def write_report(path: str, summary: DataFrame, alerts: DataFrame, officers: DataFrame) -> None:
    """The report as three CSV folders (heading, alerts, officers), written by the executors in parallel."""
    sections = {
        "heading": report_header(summary),
        "alerts": report_alerts(alerts),
        "officers": report_officers(officers),
    }
    for name, df in sections.items():
        df.write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{path}/{name}")


def history_rows(summaries: DataFrame) -> DataFrame:
    """Analysis sessions from (user_id, file_name, created_at, summary counts); low alerts do not count."""
    alerts = F.col("critical_alerts") + F.col("high_alerts") + F.col("medium_alerts")
    results = F.to_json(F.struct("total_records", "critical_alerts", "high_alerts", "medium_alerts", "risk_score"))
    return summaries.select(
        F.sha2(F.concat_ws("|", "user_id", "file_name", F.col("created_at").cast("string")), 256).alias("session_id"),
        F.col("user_id").cast("string").alias("user_id"),
        F.coalesce("file_name", F.lit("Unknown")).alias("file_name"),
        F.col("total_records").cast("long").alias("loans_analyzed"),
        alerts.cast("long").alias("alerts_generated"),
        F.col("risk_score").cast("int").alias("risk_score"),
        results.alias("results"),
        "created_at",
    )


def append_history(rows: DataFrame, path: str) -> None:
    """Append-only history, partitioned by user so that a user's scan reads only their own files."""
    rows.write.mode("append").partitionBy("user_id").parquet(path)


def read_history(spark: SparkSession, path: str, user_id: str, n: int = 10) -> DataFrame:
    """A user's latest sessions, newest first."""
    rows = spark.read.schema(HISTORY_SCHEMA).parquet(path).filter(F.col("user_id") == user_id)
    return latest(rows, n)


def latest(rows: DataFrame, n: int = 10) -> DataFrame:
    return rows.orderBy(F.desc("created_at"), "session_id").limit(n)
