"""Header normalisation, name similarity and value cleaning."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ledgerlens.fixed_values import STATUS_CODES

_WORD = r"['-]*\p{L}[\p{L}'-]*"
PERSON_NAME = rf"^\s*{_WORD}(\s+{_WORD}){{1,3}}\s*$"
TWO_WORDS = r"^[A-Za-z]+\s+[A-Za-z]+"
ALPHA_WORDS = r"^\s*[\p{L}'-]+(\s+[\p{L}'-]+)+\s*$"


def normalise_header(name: Column, style: str = "backend") -> Column:
    """`backend`: trim, blanks and hyphens to `_`; `engine`: everything but letters and digits; `page`: ASCII only."""
    lower = F.lower(name)
    if style == "backend":
        return F.translate(F.trim(lower), " -", "__")
    return F.regexp_replace(lower, r"[^\p{L}\p{N}]" if style == "engine" else "[^a-z0-9]", "_")


def string_similarity(a: Column, b: Column, empty: str = "equal") -> Column:
    """(longest - edit distance) / longest, by characters.

    Two empty texts count 1; `empty="zero"` gives 0 as soon as either one is empty.
    """
    longest = F.greatest(F.length(a), F.length(b))
    ratio = (longest - F.levenshtein(a, b)) / longest
    if empty == "zero":
        return F.when((F.length(a) == 0) | (F.length(b) == 0), 0.0).otherwise(ratio)
    return F.when(longest == 0, 1.0).otherwise(ratio)


@F.pandas_udf(DoubleType())
def indel_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the longest common subsequence over the summed lengths. For short texts such as column names."""

    def ratio(x: str, y: str) -> float:
        row = [0] * (len(y) + 1)
        for ch in x:
            diagonal = 0
            for j, other in enumerate(y, 1):
                diagonal, row[j] = row[j], diagonal + 1 if ch == other else max(row[j], row[j - 1])
        total = len(x) + len(y)
        return 2 * row[-1] / total if total else 1.0

    return pd.Series([None if x is None or y is None else ratio(x, y) for x, y in zip(a, b)], dtype="float64")


def clean_phone(value: Column) -> Column:
    return F.translate(value, " -()", "")


#: What every text that Spark reads as a double looks like. Some texts of this shape are no numbers.
NUMBER_SHAPE = (
    r"(?i)^[\x00-\x20]*[+-]?(?:inf|infinity|nan|(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?[fd]?"
    r"|0x[0-9a-f.]+p[+-]?[0-9]+[fd]?)[\x00-\x20]*$"
)


def try_double(value: Column) -> Column:
    """The text as a double, null when it is none. A failed cast costs an exception per row, a failed match next to nothing."""
    return F.when(value.rlike(NUMBER_SHAPE), value.try_cast("double"))


def parse_amount(value: Column) -> Column:
    """Text amount without thousands commas; anything else than a finite number is 0."""
    return F.coalesce(finite(F.translate(value, ",", "").try_cast("double")), F.lit(0.0))


def finite(value: Column) -> Column:
    """The number, or null for NaN and infinities: one such cell would turn every mean into NaN."""
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def normalise_status(value: Column) -> Column:
    """Lower-case status word; one-letter codes written out."""
    lower = F.lower(F.trim(value))
    codes = F.create_map(*[F.lit(x) for pair in STATUS_CODES.items() for x in pair])
    return F.coalesce(F.try_element_at(codes, lower), lower)
