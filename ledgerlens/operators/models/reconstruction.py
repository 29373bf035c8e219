"""Reconstruction-error anomalies with a linear autoencoder (principal components)."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.models.boosting import apply_scale, standard_scale
from ledgerlens.operators.models.ensemble import time_features
from ledgerlens.session import written_table

FEATURES = ["amount", "hour", "weekday", "month", "weekend", "amount_z"]


def reconstruction_features(loans: DataFrame, key: str = "loan_id", amount_stats: tuple | None = None) -> DataFrame:
    """The six inputs; the amount's z-score uses `amount_stats` (mean, deviation) or this table's own."""
    base = time_features(loans)
    rows = loans.select(key, *[base[c].alias(c) for c in FEATURES[:-1]])
    if amount_stats is None:
        pair = rows.agg(F.struct(F.avg("amount").alias("m"), F.stddev_pop("amount").alias("s"))).scalar()
        rows = rows.withColumn("_p", pair)
        z = (F.col("amount") - F.col("_p.m")) / (F.col("_p.s") + 1e-8)
        return rows.withColumn("amount_z", z).drop("_p")
    mean, sd = amount_stats
    return rows.withColumn("amount_z", (F.col("amount") - mean) / (sd + 1e-8))


@dataclass
class Reconstruction:
    """Scaling, a 6 x k component matrix and the error threshold."""

    stats: dict[str, tuple[float, float]]
    components: np.ndarray
    threshold: float

    def error(self) -> Column:
        """Mean squared reconstruction error of scaled feature columns, as a plain arithmetic expression."""
        residual = np.eye(len(FEATURES)) - self.components @ self.components.T
        squares = []
        for weights in residual:
            term = reduce(lambda a, b: a + b, [F.col(c) * float(w) for c, w in zip(FEATURES, weights)])
            squares.append(term * term)
        return reduce(lambda a, b: a + b, squares) / len(FEATURES)

    def score(self, features: DataFrame, key: str = "loan_id") -> DataFrame:
        scaled = apply_scale(features, self.stats).select(key, self.error().alias("mse"))
        return scaled.withColumns(
            {
                "anomaly_score": F.least(F.try_divide(F.col("mse"), F.lit(2 * self.threshold)), F.lit(1.0)),
                "is_anomaly": F.col("mse") > self.threshold,
            }
        )


def fit_reconstruction(features: DataFrame, k: int = 3, percentile: float = 0.95) -> Reconstruction:
    """Fit on (assumed normal) feature rows; the threshold is their error at `percentile`."""
    rows = written_table(features, "reconstruction")
    scaled, stats = standard_scale(rows, FEATURES)
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="v").transform(scaled)
    components = PCA(k=k, inputCol="v", outputCol="p").fit(vectors).pc.toArray()
    model = Reconstruction(stats, components, 0.0)
    cut = scaled.select(model.error().alias("mse")).agg(F.percentile_approx("mse", percentile, 100000)).first()[0]
    model.threshold = float(cut)
    return model
