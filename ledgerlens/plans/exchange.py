"""Registered queries over scans and sinks: the book goes out in a format and comes back through the reader."""

from __future__ import annotations


import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions.groups import one_row
from ledgerlens.operators import graph
from ledgerlens.operators.models import reconstruction, screening
from ledgerlens.plans.analysis import analyse, screen_file, screen_upload
from ledgerlens.session import own_folder, written_table
from ledgerlens.sources import readers, sinks
from ledgerlens.sources.loan_view import loan_table


def _path(spark: SparkSession) -> str:
    return own_folder(spark, "exchange")


def scan_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _path(spark)
    columns = ["loan_id", "borrower_id", "borrower_name", "phone_number", "loan_date", "guarantor_name", "status"]
    loan_table(spark, sf_dir).select(*columns).write.option("header", True).csv(path)
    return readers.read_csv(spark, path)


def scan_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _path(spark)
    columns = ["loan_id", "borrower_id", "borrower_name", "phone", "amount", "loan_date", "officer_id", "latitude"]
    book = loan_table(spark, sf_dir).withColumnRenamed("phone_number", "phone").select(*columns)
    texts = book.withColumns({c: F.col(c).cast("string") for c in ("loan_id", "borrower_id", "officer_id")})
    sinks.json_records(texts).write.text(path)
    return readers.read_json_records(spark, path).select(*columns)


def result_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts of the engine rules, written as the JSON result and read back."""
    path = _path(spark)
    analysis = analyse(loan_table(spark, sf_dir), "rule_only", "engine")
    sinks.write_results(path, analysis.summary(), analysis.alerts, analysis.officers())
    kinds = "alert_id string, alert_type string, severity string, amount_at_risk double, loan_count long"
    found = spark.read.schema(kinds).json(f"{path}/alerts")
    return found.withColumn("amount_at_risk", F.round("amount_at_risk", 2))


def report_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alert section of the CSV report, read back."""
    path = _path(spark)
    analysis = analyse(loan_table(spark, sf_dir), "rule_only", "engine")
    sinks.write_report(path, analysis.summary(), analysis.alerts, analysis.officers())
    found = readers.read_csv(spark, f"{path}/alerts", tidy_header=True)
    return found.select(
        "severity", "type", "title", "description", F.col("`amount_at_risk_(ugx)`").cast("double").alias("amount"), "officer_id"
    )


def preview_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.preview(loan_table(spark, sf_dir).select("loan_id", "borrower_id", "amount"), 10, "loan_id")


def upload_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An export with abbreviated headers: overrides sent as JSON name what the headers do not tell."""
    book = loan_table(spark, sf_dir)
    path = _path(spark)
    book.select(
        F.col("loan_id").alias("id"), F.col("borrower_id").alias("mid"), F.col("borrower_name").alias("name"),
        F.col("phone_number").alias("mob"), F.col("amount").alias("amt"), F.col("loan_date").alias("dt"),
        F.col("approval_time").alias("tm"), F.col("officer_id").alias("stf"), F.col("branch_name").alias("br"),
        F.col("status").alias("st"),
    ).write.option("header", True).csv(path)
    sent = '{"mid": "borrower_id", "amt": "amount", "dt": "loan_date", "tm": "approval_time", "stf": "officer_id", "st": "status"}'
    analysis, _ = screen_upload(
        readers.read_csv(spark, path), overrides=readers.parse_overrides(sent), mode="rule_only", ruleset="engine"
    )
    return analysis.alerts.groupBy("alert_type").agg(
        F.count(F.lit(1)).alias("alerts"), F.round(F.sum("amount_at_risk"), 2).alias("amount_at_risk")
    )


def scan_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a headerless export with planted surplus fields, missing fields and open quotes, by kind and number of fields."""
    n = F.col("loan_id")
    line = F.concat_ws(",", "loan_id", "borrower_id", F.concat(F.lit('"'), "borrower_name", F.lit(', Ltd"')), "status")
    planted = (
        F.when(n % 50 == 0, F.concat(line, F.lit(",extra,more")))
        .when(n % 70 == 0, F.concat_ws(",", "loan_id", "borrower_id"))
        .when(n % 110 == 0, F.concat_ws(",", "loan_id", "borrower_id", F.concat(F.lit('"'), "borrower_name"), "status"))
        .otherwise(line)
    )
    path = _path(spark)
    loan_table(spark, sf_dir).select(planted.alias("value")).write.text(path)
    rows, rejects = readers.read_csv_checked(spark, path, columns=["loan_id", "borrower_id", "borrower_name", "status"])
    whole = rows.agg(F.lit("rows").alias("kind"), F.count("status").cast("int").alias("fields"), F.count("loan_id").alias("lines"))
    return rejects.groupBy("kind", "fields").agg(F.count(F.lit(1)).alias("lines")).unionByName(whole)


def upload_unread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of an upload that could not be read, by field: planted amounts without a number, days that do not exist."""
    n = F.col("loan_id")
    path = _path(spark)
    loan_table(spark, sf_dir).select(
        "loan_id", "borrower_id", "phone_number", "officer_id", "status", "approval_time",
        F.when(n % 13 == 0, "n/a").otherwise(F.col("amount").cast("string")).alias("amount"),
        F.when(n % 17 == 0, "2024-02-30").otherwise(F.col("loan_date").cast("string")).alias("loan_date"),
    ).write.option("header", True).csv(path)
    analysis, _ = screen_file(spark, path, mode="rule_only", ruleset="engine")
    broken = analysis.rejects.agg(F.lit("lines").alias("field"), F.count(F.lit(1)).alias("filled"), F.count(F.lit(1)).alias("failed"))
    return analysis.unread.filter("filled > 0").unionByName(broken)


def phone_stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All borrowers of every shared phone, linked to the smallest of them."""
    book = loan_table(spark, sf_dir)
    return graph.phone_star_edges(book, graph.shared_phones(book)).select("source", "target")


def combined_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The combined risk from given scores: amounts stand for the probability, loan days for the forest's risk."""
    book = loan_table(spark, sf_dir)
    top = one_row(book, amount=F.max("amount"))
    given = book.withColumn("_t", top).select(
        "loan_id", (F.col("amount") / F.col("_t.amount")).alias("p"), F.dayofmonth("loan_date").cast("double").alias("r")
    )
    return given.select("loan_id", F.round(screening.combined_risk(F.col("p"), F.col("r")), 6).alias("risk_score"))


def reconstruction_given(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reconstruction error with a given model: unit scaling, and the first three inputs as components."""
    rows = written_table(reconstruction.reconstruction_features(loan_table(spark, sf_dir)), "inputs")
    names = reconstruction.FEATURES
    model = reconstruction.Reconstruction({c: (0.0, 1.0) for c in names}, np.eye(len(names))[:, :3], 5.0)
    return model.score(rows).select(
        "loan_id", F.round("mse", 6).alias("mse"), F.round("anomaly_score", 6).alias("anomaly_score"), "is_anomaly"
    )


EXCHANGE = {
    "scan_csv": scan_csv,
    "scan_json": scan_json,
    "result_json": result_json,
    "report_csv": report_csv,
    "preview_rows": preview_rows,
    "upload_overrides": upload_overrides,
    "scan_rejects": scan_rejects,
    "upload_unread": upload_unread,
    "phone_stars": phone_stars,
    "combined_score": combined_score,
    "reconstruction_given": reconstruction_given,
}
