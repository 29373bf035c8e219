"""Isolation forest (Liu, Ting and Zhou 2008): trees built per sample on the executors, scored in Arrow batches."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ledgerlens.session import written_table

_NODES = "tree int, node int, feature int, threshold double, low int, high int, depth double"
_HASH_RANGE = 1 << 40
#: Rows scored at once.
BLOCK = 4096


def average_depth(n: float) -> float:
    """Mean depth of an unsuccessful search in a binary tree of `n` points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (np.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def _grow(tree: int, points: np.ndarray, seed: int) -> list[tuple]:
    rng = np.random.default_rng([seed, tree])
    limit = int(np.ceil(np.log2(max(len(points), 2))))
    nodes: list[list] = []
    stack = [(points, 0, -1, 0)]
    while stack:
        rows, depth, parent, side = stack.pop()
        number = len(nodes)
        if parent >= 0:
            nodes[parent][side] = number
        spread = np.flatnonzero(rows.max(axis=0) > rows.min(axis=0)) if len(rows) > 1 else []
        if depth >= limit or len(spread) == 0:
            nodes.append([tree, number, 0, 0.0, number, number, depth + average_depth(len(rows))])
            continue
        feature = int(rng.choice(spread))
        low, high = rows[:, feature].min(), rows[:, feature].max()
        cut = rng.uniform(low, high)
        below = rows[:, feature] <= cut
        nodes.append([tree, number, feature, float(cut), -1, -1, float("nan")])
        stack.append((rows[~below], depth + 1, number, 5))
        stack.append((rows[below], depth + 1, number, 4))
    return [tuple(n) for n in nodes]


def _row_hash(*columns: Column) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(_HASH_RANGE))


@dataclass
class IsolationForest:
    """A fitted forest: at most `trees * 2 * sample` nodes, whatever the size of the training table."""

    features: list[str]
    nodes: pd.DataFrame
    sample: int
    offset: float

    def _tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Feature, threshold and depth of every tree as a full binary tree: node i (from 1) leads to 2i and 2i + 1.

        Below a leaf all thresholds are infinite, so its rows end in the place at its far left. At most 2 * `sample` places a tree.
        """
        steps = int(np.ceil(np.log2(max(self.sample, 2))))
        nodes = self.nodes.sort_values(["tree", "node"])
        sizes = nodes.groupby("tree").size().to_numpy()
        base = np.repeat(np.cumsum(sizes) - sizes, sizes)
        low, high = nodes["low"].to_numpy() + base, nodes["high"].to_numpy() + base
        threshold = np.where(low == np.arange(len(nodes)), np.inf, nodes["threshold"].to_numpy())
        feature, depth = nodes["feature"].to_numpy().astype(np.int64), nodes["depth"].to_numpy()
        tests = np.zeros((len(sizes), 1 << steps), np.int64)
        cuts = np.full((len(sizes), 1 << steps), np.inf)
        at = (np.cumsum(sizes) - sizes)[:, None]
        for level in range(steps):
            width = 1 << level
            tests[:, width : 2 * width], cuts[:, width : 2 * width] = feature[at], threshold[at]
            at = np.stack([low[at], high[at]], axis=2).reshape(len(sizes), 2 * width)
        return tests, cuts, depth[at]

    def raw_score(self, spark: SparkSession) -> Column:
        """Negative anomaly score, -1 (outlier) to 0, of a row's feature columns."""
        shared = spark.sparkContext.broadcast((*self._tables(), average_depth(self.sample)))

        @F.pandas_udf(DoubleType())
        def score(*columns: pd.Series) -> pd.Series:
            tests, cuts, depths, normal = shared.value
            places = depths.shape[1]
            arrays = [c.to_numpy(dtype="float64") for c in columns]
            totals = np.zeros(len(arrays[0]))
            for begin in range(0, len(totals), BLOCK):  # what a block's steps touch stays in the processor's cache
                total = totals[begin : begin + BLOCK]
                n = len(total)
                x = np.concatenate([a[begin : begin + BLOCK] for a in arrays])  # feature by feature
                row = np.arange(n)
                where, at, above = np.empty(n, np.int64), np.empty(n, np.int64), np.empty(n, bool)
                value, cut = np.empty(n), np.empty(n)
                for test, limits, depth in zip(tests * n, cuts, depths, strict=True):
                    at.fill(1)
                    while at[0] < places:  # all rows are on one level
                        test.take(at, out=where, mode="clip")
                        np.add(where, row, out=where)
                        x.take(where, out=value, mode="clip")
                        limits.take(at, out=cut, mode="clip")
                        np.greater(value, cut, out=above)
                        np.add(at, at, out=at)
                        np.add(at, above, out=at)
                    at -= places
                    depth.take(at, out=value, mode="clip")
                    total += value
            return pd.Series(-np.power(2.0, -totals / len(tests) / normal))

        return score(*[F.col(c).cast("double") for c in self.features])

    def score(self, df: DataFrame) -> DataFrame:
        """Adds `decision` (below 0: outlier) and `prediction` (-1 or 1)."""
        return self._decided(df, self.raw_score(df.sparkSession))

    def _decided(self, df: DataFrame, raw: Column) -> DataFrame:
        return df.withColumn("decision", raw - F.lit(self.offset)).withColumn(
            "prediction", F.when(F.col("decision") < 0, -1).otherwise(1)
        )

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame(self.nodes, _NODES).write.mode("overwrite").parquet(f"{path}/nodes")
        meta = json.dumps({"features": self.features, "sample": self.sample, "offset": self.offset})
        spark.createDataFrame([(meta,)], "value string").write.mode("overwrite").text(f"{path}/meta")

    @staticmethod
    def load(spark: SparkSession, path: str) -> IsolationForest:
        meta = json.loads(spark.read.text(f"{path}/meta").first()["value"])
        nodes = spark.read.schema(_NODES).parquet(f"{path}/nodes").toPandas()
        return IsolationForest(meta["features"], nodes, meta["sample"], meta["offset"])


def _grown(table: DataFrame, features: Sequence[str], trees: int, sample: int, seed: int) -> IsolationForest:
    """Sample by row hash and grow one tree per group; the forest has no cut yet.

    A tree draws the rows of smallest hash of (key, seed, tree). Rows above a threshold that leaves three samples' worth
    on average are dropped at once, so that no tree falls short of its sample. A retried task draws the same rows, which
    `rand()` would not guarantee. The rule is the same for tables of any size.
    """
    n = table.count()
    share = min(1.0, 3.0 * sample / n) if n else 1.0
    draw = _row_hash(F.col("_key"), F.lit(seed), F.col("tree"))
    chosen = (
        table.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
        .withColumn("_draw", draw)
        .filter(F.col("_draw") < int(_HASH_RANGE * share))
        .withColumn("_rank", F.row_number().over(Window.partitionBy("tree").orderBy("_draw", "_key")))
        .filter(F.col("_rank") <= sample)
        .select("tree", "_rank", *features)
    )
    names = list(features)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        ordered = pdf.sort_values("_rank")
        rows = _grow(int(ordered["tree"].iloc[0]), ordered[names].to_numpy(), seed)
        return pd.DataFrame(rows, columns=[c.split()[0] for c in _NODES.split(", ")])

    nodes = chosen.groupBy("tree").applyInPandas(grow, _NODES).toPandas()
    return IsolationForest(names, nodes, min(sample, max(n, 2)), 0.0)


def _filled(df: DataFrame, features: Sequence[str], key: str) -> DataFrame:
    columns = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features]
    return df.select(F.col(key).alias("_key"), *columns)


def _cut(scores: DataFrame, contamination: float) -> float:
    return float(scores.agg(F.percentile_approx("_raw", contamination, 100000)).first()[0])


def fit_forest(
    df: DataFrame,
    features: Sequence[str],
    key: str = "loan_id",
    trees: int = 100,
    sample: int = 256,
    contamination: float = 0.05,
    seed: int = 42,
) -> IsolationForest:
    """A forest whose cut is the `contamination` quantile of the scores of `df`."""
    table = _filled(df, features, key)
    model = _grown(table, features, trees, sample, seed)
    model.offset = _cut(table.select(model.raw_score(df.sparkSession).alias("_raw")), contamination)
    return model


def fit_and_score(
    df: DataFrame,
    features: Sequence[str],
    key: str = "loan_id",
    keep: Sequence[str] | None = None,
    trees: int = 100,
    sample: int = 256,
    contamination: float = 0.05,
    seed: int = 42,
) -> tuple[IsolationForest, DataFrame]:
    """`fit_forest` and its `score` of the same rows, which are walked through the trees and written once for both.

    `df` has no null feature, as `feature_matrix` makes it. Of its columns `keep` are kept, all with None.
    """
    model = _grown(_filled(df, features, key), features, trees, sample, seed)
    raw = model.raw_score(df.sparkSession).alias("_raw")
    scored = written_table(df.select(*(df.columns if keep is None else keep), raw), "scored")
    model.offset = _cut(scored, contamination)
    return model, model._decided(scored, F.col("_raw")).drop("_raw")


def risk_from_decision(scored: DataFrame, epsilon: float = 0.0) -> DataFrame:
    """Adds `anomaly_risk`: the decision scaled to 0 (most normal of this table) to 100 (least).

    With `epsilon` 0 a constant decision gives 0. `scored` should be a written table: it is read twice.
    """
    bounds = scored.agg(F.struct(F.min("decision").alias("low"), F.max("decision").alias("high"))).scalar()
    span = F.col("_b.high") - F.col("_b.low") + epsilon
    risk = 100 * (1 - F.try_divide(F.col("decision") - F.col("_b.low"), span))
    return scored.withColumn("_b", bounds).withColumn("anomaly_risk", F.coalesce(risk, F.lit(0.0))).drop("_b")
