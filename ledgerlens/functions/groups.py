"""Grouped summaries that stay bounded when one key owns a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def modal_value(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Most frequent non-null `value` per key, the smallest on a tie.

    Counting per (key, value) first keeps the per-key state at one pair, where `mode` would hold a whole
    histogram of a hot key in one aggregation buffer.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("_n"), F.col(value))).alias(value))


def first_values(
    df: DataFrame, keys: Sequence[str], value: str, n: int, order: Sequence[Column], distinct: bool = False
) -> DataFrame:
    """The first `n` non-null values per key as an array column named after `value`.

    `row_number() <= n` is pushed below the shuffle as a per-task group limit, so a key sends at most `n` rows
    per map task and the collected list never exceeds `n`.
    """
    rows = df.filter(F.col(value).isNotNull())
    if distinct:
        rows = rows.select(*keys, value).distinct()
    ranked = rows.select(
        *keys, value, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).alias("_rank")
    ).filter(F.col("_rank") <= n)
    ordered = F.sort_array(F.collect_list(F.struct("_rank", value)))
    return ranked.groupBy(*keys).agg(F.transform(ordered, lambda pair: pair[value]).alias(value))


def distinct_values(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """All distinct non-null values per key, ascending, as an array column named after `value`.

    The pairs are made distinct first, so the array grows with the different values and not with the rows.
    """
    pairs = df.filter(F.col(value).isNotNull()).select(*keys, value).distinct()
    return pairs.groupBy(*keys).agg(F.sort_array(F.collect_list(value)).alias(value))


def one_row(df: DataFrame, **aggregates: Column) -> Column:
    """Whole-table aggregates as one struct-valued scalar subquery: a constant to the query that uses it."""
    return df.agg(F.struct(*[c.alias(name) for name, c in aggregates.items()]).alias("_row")).scalar()
