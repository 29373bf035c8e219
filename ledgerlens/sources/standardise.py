"""From mapped exports to one standard loan table."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.functions.clock import any_date
from ledgerlens.functions.text import clean_phone, finite, normalise_status, parse_amount
from ledgerlens.schema import LOAN_SCHEMA

# Names the detectors expect for standard fields.
DETECTOR_NAMES = {"phone": "phone_number", "branch": "branch_name"}


def mapping_of(mappings: DataFrame, source: str) -> dict[str, str]:
    """Column -> field for one export; a mapping has at most one row per column of the export."""
    rows = mappings.filter((F.col("source") == source) & F.col("standard").isNotNull()).collect()
    return {r["column"]: r["standard"] for r in rows}


def apply_mapping(
    export: DataFrame, mapping: Mapping[str, str], overrides: Mapping[str, str] | None = None
) -> DataFrame:
    """The mapped columns under their standard names; an override takes its field from the detected column."""
    chosen = {c: f for c, f in mapping.items() if f not in (overrides or {}).values()}
    chosen.update(overrides or {})
    return export.select(*[F.col(f"`{c}`").alias(f) for c, f in chosen.items() if c in export.columns])


def _typed(field: T.StructField, clean: bool) -> Column:
    value = F.col(field.name)
    text = value.cast("string")
    if field.name == "amount":
        return parse_amount(text)
    if isinstance(field.dataType, T.DateType):
        return any_date(text)
    if field.name == "status" and clean:
        return normalise_status(text)
    if field.name in ("phone", "guarantor_phone") and clean:
        return clean_phone(text)
    if isinstance(field.dataType, T.StringType):
        return text
    number = F.translate(text, ",", "").try_cast(field.dataType)
    return finite(number) if isinstance(field.dataType, T.DoubleType) else number


def parse_failures(mapped: DataFrame) -> DataFrame:
    """(field, filled, failed): how many filled cells of each typed field could not be read."""
    fields = [f for f in LOAN_SCHEMA.fields if f.name in mapped.columns and not isinstance(f.dataType, T.StringType)]
    counts = []
    for f in fields:
        text = F.col(f.name).cast("string")
        filled = text.isNotNull() & (F.trim(text) != "")
        number = finite(F.translate(text, ",", "").try_cast("double"))
        read = number if f.name == "amount" else _typed(f, True)
        counts.append(
            F.struct(
                F.lit(f.name).alias("field"),
                F.count_if(filled).alias("filled"),
                F.count_if(filled & read.isNull()).alias("failed"),
            )
        )
    if not counts:
        return mapped.sparkSession.createDataFrame([], "field string, filled long, failed long")
    return mapped.agg(F.inline(F.array(*counts)))


def standardise(mapped: DataFrame, clean: bool = True) -> DataFrame:
    """Typed standard columns plus the defaults detectors rely on.

    `clean` also strips phone punctuation and writes status codes out; without it the values stay as exported.
    The approval instant is the loan date at the approval time when both are mapped, else null: a run-time default
    would make results depend on the clock.
    """
    fields = [f for f in LOAN_SCHEMA.fields if f.name in mapped.columns]
    typed = mapped.select(*[_typed(f, clean).alias(f.name) for f in fields])
    text = lambda name: F.col(name) if name in mapped.columns else F.lit(None).cast("string")
    added: dict[str, Column] = {}
    if "officer_name" not in typed.columns:
        added["officer_name"] = F.coalesce(text("officer_id"), F.lit("Unknown"))
    if "branch" not in typed.columns:
        added["branch"] = F.lit("Unknown")
    if "status" not in typed.columns:
        added["status"] = F.lit("active")
    if "guarantor_name" not in typed.columns:
        added["guarantor_name"] = F.lit(None).cast("string")
    for name in ("latitude", "longitude"):
        if name not in typed.columns:
            added[name] = F.lit(None).cast("double")
    complete = typed.withColumns(added) if added else typed
    if {"loan_date", "approval_time"} <= set(complete.columns):
        clock = F.concat_ws(" ", F.col("loan_date").cast("string"), F.substring("approval_time", 1, 5))
        instant = F.when(F.col("approval_time").isNotNull(), clock).try_cast("timestamp_ntz")
        complete = complete.withColumn("created_at", instant)
    else:
        complete = complete.withColumn("created_at", F.lit(None).cast("timestamp_ntz"))
    return complete.withColumnsRenamed(DETECTOR_NAMES).withColumn("branch_id", F.col("branch_name"))


def union_sources(books: Mapping[str, DataFrame]) -> DataFrame:
    """Standardised exports as one table with a `source` column; fields a source lacks are null."""
    tagged = [book.withColumn("source", F.lit(name)) for name, book in books.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
