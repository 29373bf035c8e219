"""Readers for loan exports: CSV with any header, JSON records, Parquet; override files."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.schema import LOAN_SCHEMA
from ledgerlens.session import written_table


def _blank_to_null(df: DataFrame) -> DataFrame:
    return df.select(*[F.when(F.trim(F.col(f"`{c}`")) != "", F.col(f"`{c}`")).alias(c) for c in df.columns])


def read_csv(spark: SparkSession, path: str, tidy_header: bool = False) -> DataFrame:
    """All columns as trimmed text, blanks null, short rows padded with null, blank lines skipped.

    Types are never inferred: inference would read the file twice and drop the leading zero of a phone number.
    `tidy_header` lower-cases names and joins words with `_`.
    """
    df = (
        spark.read.option("header", True)
        .option("inferSchema", False)
        .option("ignoreLeadingWhiteSpace", True)
        .option("ignoreTrailingWhiteSpace", True)
        .option("escape", '"')
        .option("mode", "PERMISSIVE")
        .csv(path)
    )
    if tidy_header:
        df = df.toDF(*["_".join(c.strip().lower().split()) for c in df.columns])
    return _blank_to_null(df)


#: Column of the raw text of a line that does not have one field per column.
_RAW = "_raw_line"


def read_csv_checked(
    spark: SparkSession, path: str, tidy_header: bool = False, columns: Sequence[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """`read_csv`, and the lines that did not fit: (rows, rejects).

    `rejects` has a row per line: `kind` is `long` (surplus fields, which the rows lack), `short` (missing fields, null in
    the rows) or `open` (a quote that is never closed), `fields` the number found, `line` its text. Rows and rejects come
    from one scan, written once. `columns` names the columns of files without a header.
    """
    reader = spark.read.option("header", columns is None)
    names = list(columns) if columns else reader.csv(path).columns
    rows = (
        reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in [*names, _RAW]]))
        .option("ignoreLeadingWhiteSpace", True)
        .option("ignoreTrailingWhiteSpace", True)
        .option("escape", '"')
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", _RAW)
        .option("enforceSchema", True)
        .csv(path)
    )
    kept = written_table(rows, "scanned")
    bare = F.regexp_replace(_RAW, '"([^"]|"")*"', "")
    fields = F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) + 1
    kind = F.when(bare.contains('"'), "open").when(fields > len(names), "long").otherwise("short")
    rejects = kept.filter(F.col(_RAW).isNotNull()).select(
        kind.alias("kind"), fields.cast("int").alias("fields"), F.col(_RAW).alias("line")
    )
    good = kept.drop(_RAW)
    if tidy_header:
        good = good.toDF(*["_".join(c.strip().lower().split()) for c in names])
    return _blank_to_null(good), rejects


def read_json_records(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines in the standard schema; fields a record lacks are null."""
    return spark.read.schema(LOAN_SCHEMA).json(path)


def read_json_array(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of records per file."""
    return spark.read.schema(LOAN_SCHEMA).option("multiLine", True).json(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def parse_overrides(text: str | None) -> dict[str, str]:
    """A JSON object original -> standard, as sent with an upload; nothing sent means no overrides."""
    return dict(json.loads(text)) if text else {}


def preview(df: DataFrame, n: int = 10, order: str | None = None) -> DataFrame:
    """The first `n` rows; name an order column when the same rows must come back each time."""
    return (df.orderBy(order) if order else df).limit(n)
