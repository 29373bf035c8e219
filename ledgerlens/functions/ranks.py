"""Exact global ranks without a single-partition sort."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.session import written_table

RANGES = 256


def ranked_values(df: DataFrame, column: str, ranges: int = RANGES, **sums: Column) -> DataFrame:
    """One row per distinct non-null value: `ties`, `before` (rows with a smaller value), `total`, and named `sums`.

    Rows collapse to (value, count) first. Range cuts taken from the distinct values split them into `ranges`
    parts; each part is ranked on its own and shifted by the rows of the parts before it. Only the cuts and one
    count per range visit the driver, so nothing there grows with the data.
    """
    counts = written_table(
        df.filter(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias("ties"), *[F.sum(value).alias(name) for name, value in sums.items()]),
        "value-counts",
    )
    as_double = counts.withColumn("_v", F.col(column).cast("double"))
    cuts = as_double.approxQuantile("_v", [i / ranges for i in range(1, ranges)], 0.2 / ranges)
    splits = [float("-inf"), *sorted(set(cuts)), float("inf")]
    if len(splits) > 2:
        parts = Bucketizer(splits=splits, inputCol="_v", outputCol="_part").transform(as_double)
    else:
        parts = as_double.withColumn("_part", F.lit(0.0))
    sizes = sorted((r["_part"], r["n"]) for r in parts.groupBy("_part").agg(F.sum("ties").alias("n")).collect())
    shifts, total = [], 0
    for part, size in sizes:
        shifts += [F.lit(part), F.lit(total)]
        total += size
    if not shifts:
        return counts.withColumn("before", F.lit(0).cast("long")).withColumn("total", F.lit(0).cast("long"))
    running = F.sum("ties").over(Window.partitionBy("_part").orderBy("_v"))
    return parts.select(
        column,
        "ties",
        (F.element_at(F.create_map(*shifts), F.col("_part")) + running - F.col("ties")).cast("long").alias("before"),
        F.lit(total).cast("long").alias("total"),
        *sums,
    )


def percentile_ranks(df: DataFrame, column: str, alias: str) -> DataFrame:
    """Distinct value -> its average rank divided by the number of rows (ties share the mean of their ranks)."""
    ranks = ranked_values(df, column)
    average_rank = F.col("before") + (F.col("ties") + 1) / 2.0
    return ranks.select(column, (average_rank / F.col("total")).alias(alias))


def score_statistics(df: DataFrame, column: str) -> DataFrame:
    """Count, mean, minimum, maximum, median and 95th percentile (sorted value at index floor(n * share))."""
    ranks = written_table(ranked_values(df, column), "value-ranks")

    def at(share: float) -> F.Column:
        index = F.floor(F.col("total") * share)
        hit = (F.col("before") <= index) & (index < F.col("before") + F.col("ties"))
        return F.max(F.when(hit, F.col(column)))

    return ranks.agg(
        F.sum("ties").alias("n"),
        (F.sum(F.col(column) * F.col("ties")) / F.sum("ties")).alias("mean"),
        F.min(column).alias("minimum"),
        F.max(column).alias("maximum"),
        at(0.5).alias("median"),
        at(0.95).alias("p95"),
    )
