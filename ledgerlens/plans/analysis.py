"""Whole analyses: which detectors run, and what a user gets back."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators import alerts as summaries
from ledgerlens.operators import features, mapping, rules
from ledgerlens.operators.models.screening import ALERT_COLUMNS, Screen, fit_and_screen
from ledgerlens.session import written_table
from ledgerlens.sources import readers
from ledgerlens.sources.standardise import apply_mapping, mapping_of, parse_failures, standardise

MODES = ("full", "rule_only", "ml_only")


@dataclass
class Analysis:
    """A written book, its written alerts, and what is derived from them on demand."""

    loans: DataFrame
    alerts: DataFrame
    ruleset: str
    #: Of an upload: (field, filled, failed), the filled cells of each typed field that could not be read.
    unread: DataFrame | None = None
    #: Of a file: the lines that did not fit its header (kind, fields, line).
    rejects: DataFrame | None = None

    def summary(self) -> DataFrame:
        """One row: loans and alerts by method and severity, score, band, amount at risk."""
        scale = "backend" if self.ruleset == "backend" else "engine"
        totals = summaries.portfolio_risk(self.alerts, scale)
        by_method = self.alerts.agg(
            F.struct(
                F.count_if(F.col("detection_method") == "rule").alias("rule"),
                F.count_if(F.col("detection_method") == "ml").alias("ml"),
            )
        ).scalar()
        return (
            totals.withColumn("_m", by_method)
            .withColumns({"rule_alerts": F.col("_m.rule"), "ml_alerts": F.col("_m.ml")})
            .withColumn("total_records", self.loans.agg(F.count(F.lit(1))).scalar())
            .drop("_m")
        )

    def officers(self, n: int | None = 10) -> DataFrame:
        if self.ruleset == "backend":
            return summaries.officer_ranking(self.loans, self.alerts, n or 10)
        return summaries.officer_risk(self.loans, self.alerts, n)

    def by_type(self) -> DataFrame:
        return summaries.type_counts(self.alerts)

    def by_severity(self) -> DataFrame:
        return summaries.severity_counts(self.alerts)

    def members(self, methods: bool = False) -> DataFrame:
        """Every loan behind every rule alert, and the loan of every model alert.

        With `methods` also whether a `rule` or the `ml` screen gave the alert's id, so that no join on ids is needed for it.
        """
        found, carry = self.alerts, []
        ids = ["alert_id", "alert_type", "entity_key"]
        if methods:  # an id is the hash of type and key
            carry = ["rule", "ml"]
            given = [F.max(F.col("detection_method") == m).alias(m) for m in carry]
            found = found.groupBy(*ids[1:]).agg(F.min("alert_id").alias("alert_id"), *given)
        of = lambda m: found.filter(F.col(m) if methods else F.col("detection_method") == m)
        rule = rules.alert_members(self.loans, of("rule"), self.ruleset, carry)
        book = self.loans.withColumn("entity_key", F.col("loan_id").cast("string"))
        return rule.unionByName(book.join(of("ml").select(*ids, *carry), "entity_key").select(rule.columns))


def analyse(
    loans: DataFrame,
    mode: str = "full",
    ruleset: str = "backend",
    screen: Screen | None = None,
    top_ml: int | None = None,
    written: bool = False,
) -> Analysis:
    """Run the rules, the model screen, or both over a loan table.

    The loans are written once, unless they are `written` already: detectors and features pass over them many times. Without a `screen` an
    unsupervised one is fitted on these loans. `top_ml` keeps only the riskiest model alerts; all by default.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    book = loans if written else written_table(loans, "book")
    parts = []
    if mode != "ml_only":
        parts.append(rules.all_alerts(book, ruleset))
    if mode != "rule_only":
        matrix = written_table(features.feature_matrix(book, keep=["loan_id", "officer_id"]), "features")
        model, scored = (screen, screen.score(matrix)) if screen else fit_and_screen(matrix, keep=ALERT_COLUMNS)
        parts.append(model.alerts(scored, top_ml))
    found = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return Analysis(book, written_table(found, "alerts"), ruleset)


def map_upload(
    exports: Mapping[str, DataFrame], sample_rows: int | None = None, order: str | None = None
) -> DataFrame:
    """(source, position, column, standard, confidence, method) of exports, from whole columns, or a sample of their rows."""
    cells = mapping.long_values(exports, order)
    if sample_rows is not None:
        cells = mapping.column_sample(cells, sample_rows)
    return written_table(mapping.resolve(mapping.detect(mapping.profile(cells))), "mapping")


def screen_upload(
    export: DataFrame,
    name: str = "upload",
    overrides: Mapping[str, str] | None = None,
    mode: str = "rule_only",
    ruleset: str = "engine",
) -> tuple[Analysis, DataFrame]:
    """One export from unknown columns to alerts; also its mapping. Needs at least borrower and amount.

    The analysis tells in `unread` how many cells of each typed field could not be read.
    """
    mapped = mapping.override(map_upload({name: export}), overrides or {})
    fields = mapping_of(mapped, name)
    missing = {"borrower_id", "amount"} - set(fields.values())
    if missing:
        raise ValueError(f"no column found for {', '.join(sorted(missing))}")
    applied = apply_mapping(export, fields, overrides)
    found = analyse(complete_loans(standardise(applied)), mode, ruleset)
    found.unread = parse_failures(applied)
    return found, mapped


def screen_file(spark: SparkSession, path: str, tidy_header: bool = False, **options) -> tuple[Analysis, DataFrame]:
    """A CSV file from unknown columns to alerts; `rejects` of the analysis are the lines that did not fit its header."""
    rows, rejects = readers.read_csv_checked(spark, path, tidy_header)
    found, mapped = screen_upload(rows, **options)
    found.rejects = rejects
    return found, mapped


def complete_loans(standard: DataFrame) -> DataFrame:
    """Every column that detectors and features read, null where the export has none, and an id for every row.

    A loan without an id is known by its row: alerts and their members need a key that no other loan shares. The row
    numbers are fixed once the book is written.
    """
    have = set(standard.columns)
    texts = (
        "loan_id", "borrower_name", "phone_number", "officer_id", "approval_time", "product_id", "national_id",
        "branch_id", "branch_name", "guarantor_name", "status",
    )
    added = {c: F.lit(None).cast("string") for c in texts if c not in have}
    if "loan_date" not in have:
        added["loan_date"] = F.lit(None).cast("date")
    filled = standard.withColumns(added) if added else standard
    row = F.concat(F.lit("row-"), F.monotonically_increasing_id().cast("string"))
    known = F.when(F.trim(F.col("loan_id").cast("string")) != "", F.col("loan_id").cast("string"))
    return filled.withColumn("loan_id", F.coalesce(known, row))

