"""One-class boundary: random Fourier features (Rahimi and Recht 2007) and a linear one-class objective.

The objective is ½|w|² - rho + sum(loss(rho - w·z)) / (nu n), the hinge rounded off over a short stretch so that it has second
derivatives. A pass sums its value, gradient and curvature over all rows; a Newton step on the sums replaces the many small
steps of gradient descent. Tasks add up their rows, and what reaches the driver is as large as the number of random features
squared, whatever the rows. A step that did not lower the objective is halved, which costs a pass too.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ledgerlens.operators.models.boosting import apply_scale, standard_scale
from ledgerlens.session import written_table


def _map(x: np.ndarray, directions: np.ndarray, phases: np.ndarray) -> np.ndarray:
    return np.sqrt(2.0 / len(phases)) * np.cos(x @ directions + phases)


@dataclass
class Boundary:
    features: list[str]
    stats: dict[str, tuple[float, float]]
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    rho: float
    threshold: float = 0.0

    def score(self, df: DataFrame) -> DataFrame:
        """Adds `boundary_score`, above 0 outside the boundary, and `is_outlier` above the fitted threshold."""
        shared = df.sparkSession.sparkContext.broadcast((self.directions, self.phases, self.weights, self.rho))

        @F.pandas_udf(DoubleType())
        def outside(*columns: pd.Series) -> pd.Series:
            directions, phases, weights, rho = shared.value
            x = np.column_stack([c.to_numpy(dtype="float64") for c in columns])
            return pd.Series(rho - _map(x, directions, phases) @ weights)

        scaled = {c: (F.col(c).cast("double") - m) / (s or 1.0) for c, (m, s) in self.stats.items()}
        score = outside(*[scaled[c] for c in self.features])
        return df.withColumn("boundary_score", score).withColumn(
            "is_outlier", F.col("boundary_score") > self.threshold
        )


def _sums(z: np.ndarray, weights: np.ndarray, rho: float, width: float) -> np.ndarray:
    """Loss, its gradient and its curvature, summed over rows of features, as one flat vector.

    With v = rho - w·z the loss is 0 below 0, v²/(2 width) up to `width`, and v - width/2 beyond.
    """
    v = rho - z @ weights
    slope = np.clip(v / width, 0.0, 1.0)
    loss = np.where(v >= width, v - width / 2, slope * v / 2)
    extended = np.column_stack([-z, np.ones(len(z))])  # v by w and by rho
    bent = extended[(v > 0) & (v < width)]
    return np.concatenate([[loss.sum()], extended.T @ slope, (bent.T @ bent / width).ravel()])


def fit_boundary(
    df: DataFrame,
    features: Sequence[str],
    nu: float = 0.5,
    contamination: float = 0.1,
    dimension: int = 64,
    passes: int = 8,
    tolerance: float = 1e-4,
    seed: int = 42,
) -> Boundary:
    """At most `passes` passes, fewer when the gradient falls under `tolerance` of its first size."""
    names = list(features)
    rows = written_table(df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in names]), "boundary")
    scaled, stats = standard_scale(rows, names)
    n = rows.count()
    rng = np.random.default_rng(seed)
    directions = rng.normal(scale=np.sqrt(2.0 / len(names)), size=(len(names), dimension))
    phases = rng.uniform(0, 2 * np.pi, dimension)
    size = dimension + 1

    def one_pass(theta: np.ndarray | None, width: float) -> np.ndarray:
        """Sums at a point; without one, the sum of the features and of their products."""

        def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = 0.0
            for batch in batches:
                z = _map(batch[names].to_numpy(), directions, phases)
                if theta is None:
                    total = total + np.concatenate([z.sum(axis=0), (z.T @ z).ravel()])
                else:
                    total = total + _sums(z, theta[:-1], theta[-1], width)
            if np.ndim(total):
                yield pd.DataFrame({"place": np.arange(len(total), dtype="int32"), "total": total})

        sums = scaled.mapInPandas(partial, "place int, total double").groupBy("place").agg(F.sum("total").alias("total"))
        found = sums.collect()  # (dimension + 1) squared numbers
        out = np.zeros(len(found))
        for row in found:
            out[row["place"]] = row["total"]
        return out

    theta, model = np.zeros(size), None
    if n:
        moments = one_pass(None, 1.0) / n
        mean = moments[:dimension]
        spread = moments[dimension:].reshape(dimension, dimension) - np.outer(mean, mean)
        deviation = float(np.sqrt(max(mean @ spread @ mean, 1e-12)))  # of the scores along the mean
        width = deviation / 4
        theta = np.r_[mean, mean @ mean]
        best, step, first_size = np.inf, None, None
        for _ in range(passes - 1):
            sums = one_pass(theta, width) / (nu * n)
            value = 0.5 * theta[:-1] @ theta[:-1] - theta[-1] + sums[0]
            if step is not None and value > best:
                step = step / 2
                theta = kept + step
                continue
            best, kept = value, theta
            gradient = np.r_[theta[:-1], -1.0] + sums[1 : size + 1]
            curvature = np.diag(np.r_[np.ones(dimension), 1e-9]) + sums[size + 1 :].reshape(size, size)
            first_size = first_size or float(np.abs(gradient).max())
            if np.abs(gradient).max() <= tolerance * first_size:
                break
            step = -np.linalg.solve(curvature, gradient)
            reach = 4 * deviation  # where no row lies in the bent stretch the curvature of rho is none
            step = step * min(1.0, reach / max(abs(step[-1]), 1e-12))
            theta = theta + step
        theta = kept
    model = Boundary(names, stats, directions, phases, theta[:-1], float(theta[-1]))
    scores = model.score(rows).agg(F.percentile_approx("boundary_score", 1 - contamination, 100000)).first()
    model.threshold = float(scores[0]) if scores[0] is not None else 0.0
    return model
