"""Severity weights, portfolio scores and risk bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Points per alert of each severity; `other` covers every severity not named.
SEVERITY_POINTS = {
    "engine": {"CRITICAL": 25, "HIGH": 15, "MEDIUM": 8, "other": 3},
    "backend": {"HIGH": 10, "MEDIUM": 5, "LOW": 2, "other": 1},
    "count": {"other": 10},
}

# Lower bounds of the bands, strongest first.
PORTFOLIO_BANDS = [(70, "severe"), (40, "elevated"), (20, "guarded")]
OFFICER_BANDS = [(60, "high"), (30, "medium")]
SCORE_LEVELS = [(0.7, "HIGH"), (0.4, "MEDIUM")]
CONFIDENCE_LEVELS = [(0.4, "Very High"), (0.25, "High"), (0.1, "Medium")]


def ladder(value: Column, steps: list[tuple[float, str]], lowest: str, closed: bool) -> Column:
    """The first step whose bound `value` reaches (`closed`) or exceeds, else `lowest`."""
    result: Column | None = None
    for bound, label in steps:
        test = value >= bound if closed else value > bound
        result = F.when(test, label) if result is None else result.when(test, label)
    return result.otherwise(lowest)


def severity_points(severity: Column, scale: str = "engine") -> Column:
    weights = SEVERITY_POINTS[scale]
    points: Column | None = None
    for level, weight in weights.items():
        if level != "other":
            test = severity == level
            points = F.when(test, weight) if points is None else points.when(test, weight)
    return F.lit(weights["other"]) if points is None else points.otherwise(weights["other"])


def portfolio_score(severity: Column, scale: str = "engine") -> Column:
    """Aggregate: summed severity points, at most 100, 0 without alerts."""
    return F.least(F.lit(100), F.coalesce(F.sum(severity_points(severity, scale)), F.lit(0))).cast("int")


def portfolio_band(score: Column) -> Column:
    return ladder(score, PORTFOLIO_BANDS, "low", closed=True)


def officer_band(score: Column) -> Column:
    return ladder(score, OFFICER_BANDS, "low", closed=False)


def score_level(score: Column, closed: bool = True) -> Column:
    return ladder(score, SCORE_LEVELS, "LOW", closed)


def confidence_level(score: Column) -> Column:
    return ladder(F.abs(score - 0.5), CONFIDENCE_LEVELS, "Low", closed=False)


def is_fraud(score: Column, threshold: float = 0.5) -> Column:
    return score > threshold
