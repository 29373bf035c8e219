"""Scaling, stratified splitting, boosted trees, metrics and cross-validation."""

from __future__ import annotations

import json
import operator
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ledgerlens.functions.ranks import ranked_values
from ledgerlens.session import Scratch, written_table


def standard_scale(df: DataFrame, features: Sequence[str]) -> tuple[DataFrame, dict[str, tuple[float, float]]]:
    """Columns with mean 0 and population deviation 1, a constant column as 0; also the (mean, deviation) used."""
    row = df.agg(
        *[F.avg(c).alias(f"m_{c}") for c in features], *[F.stddev_pop(c).alias(f"s_{c}") for c in features]
    ).first()
    stats = {c: (float(row[f"m_{c}"] or 0.0), float(row[f"s_{c}"] or 0.0)) for c in features}
    return apply_scale(df, stats), stats


def apply_scale(df: DataFrame, stats: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(c) - mean) / (sd or 1.0) for c, (mean, sd) in stats.items()})


def _hash(key: str, seed: int) -> Column:
    return F.xxhash64(F.col(key), F.lit(seed))


def split_cuts(df: DataFrame, label: str, key: str, train_share: float = 0.8, seed: int = 42) -> dict:
    """Per label, the row hash up to which exactly the training share (rounded) of its rows lies.

    A histogram over the hash's top twelve bits finds the part that holds the cut; only that part is sorted.
    """
    hashed = df.select(F.col(label).alias("label"), _hash(key, seed).alias("h")).withColumn(
        "part", F.shiftright("h", 52)
    )
    parts = hashed.groupBy("label", "part").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("label").orderBy("part")
    running = parts.select(
        "label",
        "part",
        "n",
        (F.sum("n").over(order) - F.col("n")).alias("before"),
        F.round(F.sum("n").over(Window.partitionBy("label")) * train_share).cast("long").alias("wanted"),
    )
    holding = running.filter((F.col("before") < F.col("wanted")) & (F.col("wanted") <= F.col("before") + F.col("n")))
    found = holding.collect()  # a row per label
    if not found:
        return {}
    here = [(F.col("label") == F.lit(r["label"])) & (F.col("part") == F.lit(r["part"])) for r in found]
    rank = F.row_number().over(Window.partitionBy("label", "part").orderBy("h"))
    ranked = hashed.filter(reduce(operator.or_, here)).withColumn("r", rank)
    wanted = [(F.col("label") == F.lit(r["label"])) & (F.col("r") == F.lit(r["wanted"] - r["before"])) for r in found]
    return {r["label"]: r["h"] for r in ranked.filter(reduce(operator.or_, wanted)).select("label", "h").collect()}


def train_rows(df: DataFrame, label: str, key: str, train_share: float = 0.8, seed: int = 42) -> Column:
    """The condition that the training rows of `stratified_split` meet."""
    cuts = split_cuts(df, label, key, train_share, seed)
    in_train = F.lit(False)
    for value, cut in cuts.items():
        in_train = F.when(F.col(label) == value, _hash(key, seed) <= F.lit(cut)).otherwise(in_train)
    return in_train


def stratified_split(
    df: DataFrame, label: str, key: str, train_share: float = 0.8, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """Training and test rows with the same label shares; exact, repeatable, and a plain filter once cut."""
    in_train = train_rows(df, label, key, train_share, seed)
    return df.filter(in_train), df.filter(~in_train)


def confusion_metrics(predictions: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """Precision, recall and F1 of label 1; an empty denominator counts 0."""
    actual, said = F.col(label) == 1, F.col(predicted) == 1
    counts = predictions.agg(
        F.count_if(actual & said).alias("tp"), F.count_if(~actual & said).alias("fp"), F.count_if(actual & ~said).alias("fn")
    )
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp = F.col("tp")
    return counts.select(
        "tp",
        "fp",
        "fn",
        ratio(tp, tp + F.col("fp")).alias("precision"),
        ratio(tp, tp + F.col("fn")).alias("recall"),
        ratio(2 * tp, 2 * tp + F.col("fp") + F.col("fn")).alias("f1_score"),
    )


def roc_auc(scored: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """One row: positives, negatives and the exact area under the ROC curve, 0 when a class is missing.

    The area is the share of (positive, negative) pairs in order, a tie counting half: from the rank sum of the
    positives, where equal scores share the mean of their ranks. Rows without a score or a label are left out.
    """
    scored = scored.filter(F.col(label).isNotNull())
    positive = (F.col(label) == 1).cast("long")
    ranks = ranked_values(scored, score, positives=F.coalesce(positive, F.lit(0)))
    mean_rank = F.col("before") + (F.col("ties") + 1) / F.lit(2.0)
    p, n = F.col("positives"), F.col("negatives")
    sums = ranks.agg(
        F.coalesce(F.sum("positives"), F.lit(0)).alias("positives"),
        F.coalesce(F.sum(F.col("ties") - F.col("positives")), F.lit(0)).alias("negatives"),
        F.sum(F.col("positives") * mean_rank).alias("_ranks"),
    )
    area = F.try_divide(F.col("_ranks") - p * (p + 1) / F.lit(2.0), p.cast("double") * n)
    return sums.select("positives", "negatives", F.coalesce(area, F.lit(0.0)).alias("roc_auc"))


#: Bins of a feature, and rows from which its cuts are taken (on average).
BINS = 32
CUT_ROWS = 10_000
#: Features are held together in codes of at most so many values.
CODES = 1024
#: A part of so many rows is grown by one task; beyond, rows are held in blocks and a task gets about TASK_ROWS rows of parts.
WHOLE_ROWS = 2_000_000
BLOCK_ROWS = 1 << 18
TASK_ROWS = 250_000
#: Rows whose margins are found at once.
MARGIN_ROWS = 4096
#: Classifiers that grow side by side.
SIDE_BY_SIDE = 16
#: Gains this close, as a share of the best, are equal: sums differ in their last digits with the order of the rows.
EQUAL_GAIN = 1e-10


def feature_cuts(values: np.ndarray, bins: int, rows: float) -> np.ndarray:
    """At most `bins` - 1 cuts of one feature, between values: all, or those nearest to equal shares of the rows.

    As Spark's trees, which expect `rows` values and take those that are missing to be zeros.
    """
    distinct, counts = np.unique(values[values != 0], return_counts=True)
    zeros = rows - counts.sum()
    if zeros > np.finfo(float).eps * 100 * rows:
        at = np.searchsorted(distinct, 0.0)
        distinct, counts = np.insert(distinct, at, 0.0), np.insert(counts.astype(float), at, zeros)
    between = (distinct[1:] + distinct[:-1]) / 2
    if len(between) <= bins - 1:
        return between
    stride, cuts, seen = rows / bins, [], np.cumsum(counts)
    target = stride
    for i in range(1, len(distinct)):
        if abs(seen[i - 1] - target) < abs(seen[i] - target):
            cuts.append(between[i - 1])
            target += stride
    return np.array(cuts)


def _drawn(df: DataFrame, rows: int, seed: int) -> DataFrame:
    """About CUT_ROWS of the rows, those that Spark's trees draw with this seed."""
    if rows <= CUT_ROWS:
        return df
    spark = df.sparkSession
    number = spark.sparkContext._jvm.org.apache.spark.util.random.XORShiftRandom(seed).nextInt()
    drawn = df._jdf.toJavaRDD().sample(False, CUT_ROWS / rows, number)
    return DataFrame(spark._jsparkSession.createDataFrame(drawn, df._jdf.schema()), spark)


@dataclass
class Codes:
    """How the bins of features are held: feature f is the digit of weight `stride[f]` in the code `home[f]`."""

    bins: list[int]
    home: list[int]
    stride: list[int]
    sizes: list[int]

    @staticmethod
    def of(bins: Sequence[int]) -> Codes:
        """First fit, widest feature first. Few codes mean few sums a row; a code's sums stay in the processor's cache."""
        home, stride, sizes = [0] * len(bins), [0] * len(bins), []
        for f in sorted(range(len(bins)), key=lambda f: -bins[f]):
            if (at := next((g for g, size in enumerate(sizes) if size * bins[f] <= CODES), None)) is None:
                at = len(sizes)
                sizes.append(1)
            home[f], stride[f] = at, sizes[at]
            sizes[at] *= bins[f]
        return Codes(list(bins), home, stride, sizes)

    def encoded(self, bins: Sequence[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(self.sizes), len(bins[0])), np.int64)
        for f, b in enumerate(bins):
            out[self.home[f]] += b * self.stride[f]
        return out.astype(np.uint16)

    def above(self, feature: int, cut: int) -> np.ndarray:
        """Of every code whether the feature's bin in it lies above the cut."""
        return np.arange(self.sizes[self.home[feature]]) // self.stride[feature] % self.bins[feature] > cut

    def by_feature(self, sums: Sequence[np.ndarray]) -> list[np.ndarray]:
        """Sums by (node, code) of every code as sums by (node, bin) of every feature."""
        out = []
        for f, bins in enumerate(self.bins):
            held = sums[self.home[f]]
            out.append(held.reshape(len(held), -1, bins, self.stride[f]).sum(axis=(1, 3)))
        return out


def _parted(codes: Codes, block: np.ndarray, rows: np.ndarray, feature: int, cut: int) -> tuple[np.ndarray, np.ndarray]:
    above = codes.above(feature, cut)[block[codes.home[feature]][rows]]
    return rows[~above], rows[above]


def _rows_of(codes: Codes, block: np.ndarray, rows: np.ndarray, tree: tuple, wanted: set[int] | None) -> dict[int, np.ndarray]:
    """Rows by node: of the wanted nodes, or of the leaves. Only paths that lead to them are walked."""
    feature, cut = tree[:2]
    walked = None
    if wanted is not None:
        walked, up = set(wanted), wanted
        while up := {(node - 1) // 2 for node in up if node}:
            walked |= up
    out, stack = {}, [(0, rows)]
    while stack:
        node, rows = stack.pop()
        if walked is None and feature[node] < 0 or walked is not None and node in wanted:
            out[node] = rows
        elif walked is None or node in walked:
            stack.extend(zip((2 * node + 1, 2 * node + 2), _parted(codes, block, rows, feature[node], cut[node]), strict=True))
    return out


def _best_splits(n: np.ndarray, total: np.ndarray, cuts: np.ndarray) -> list[tuple]:
    """(feature, cut, gain, rows at the left, sum at the left) by node, of (node, feature, bin) rows and sums.

    The gain is that of the variance a row. Of equal gains the first feature and cut has it; a feature of -1 parts nothing.
    """
    left_n, left = np.cumsum(n, axis=2)[..., :-1], np.cumsum(total, axis=2)
    whole_n, whole = n.sum(axis=2)[:, :1, None], left[:, :1, -1:]
    left = left[..., :-1]
    behind = whole_n - left_n
    possible = (left_n > 0) & (behind > 0) & (np.arange(left.shape[2]) < cuts[:, None])
    with np.errstate(divide="ignore", invalid="ignore"):
        apart = left * left / left_n + (whole - left) * (whole - left) / behind
        gain = (apart - whole * whole / whole_n) / whole_n
        possible &= (gain > 1e-20) & (gain * whole_n > 1e-14 * apart)
    gain = np.where(possible, gain, -1.0).reshape(len(n), -1)
    first = (gain >= gain.max(axis=1, initial=-1.0, keepdims=True) * (1 - EQUAL_GAIN)).argmax(axis=1) if gain.shape[1] else []
    out = []
    for node, at in enumerate(first):
        f, cut = divmod(int(at), left.shape[2])
        found = gain[node, at] > 0
        out.append((f, cut, float(gain[node, at]), float(left_n[node, f, cut]), float(left[node, f, cut])) if found else (-1, 0, 0.0, 0.0, 0.0))
    return out or [(-1, 0, 0.0, 0.0, 0.0)] * len(n)


def _binned(table: DataFrame, features: Sequence[str], cuts: list[np.ndarray], codes: Codes, mask: np.dtype) -> DataFrame:
    """The rows as binary blocks: codes, labels as -1 and 1, and the parts that a row belongs to."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = [batch.column(f).to_numpy(zero_copy_only=False) for f in range(len(cuts))]
            y = batch.column(len(cuts)).to_numpy(zero_copy_only=False)
            if any(np.isnan(v).any() for v in x):
                raise ValueError("a feature is null or not a number")
            if not np.isin(y, (0.0, 1.0)).all():
                raise ValueError("a label is neither 0 nor 1")
            block = codes.encoded([np.searchsorted(c, v) for c, v in zip(cuts, x, strict=True)])
            parts = batch.column(len(cuts) + 1).to_numpy(zero_copy_only=False).astype(mask)
            held = [block.tobytes(), (2 * y - 1).astype(np.int8).tobytes(), parts.tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([h], pa.binary()) for h in held], names=["codes", "y", "parts"])

    return table.select(*features, "y", "parts").mapInArrow(pack, "codes binary, y binary, parts binary")


def _unpacked(codes: Codes, mask: np.dtype, row: Row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    y = np.frombuffer(row["y"], np.int8)
    return np.frombuffer(row["codes"], np.uint16).reshape(len(codes.sizes), -1), y, np.frombuffer(row["parts"], mask)


def _grown(codes: Codes, part: int, block: tuple, tree: tuple, weight: float, margin: np.ndarray) -> None:
    """Adds a tree's values to the margins of the part's rows."""
    coded, _, member = block
    for node, rows in _rows_of(codes, coded, np.flatnonzero(member >> part & 1), tree, None).items():
        margin[part, rows] += weight * tree[2][node]


def _margins(codes: Codes, folder: str, count: int, index: int, blocks: Iterator[tuple], so_far: Callable, done: int, rate: float) -> Iterator[tuple]:
    """Every block with its margins after `done` trees.

    They come from the trees alone. A file of the executor keeps them from one pass to the next: where it is missing (the
    first pass after a tree, or on another executor), the last tree is added to the file before it, or all trees to zero.
    """
    path = lambda n: f"{tempfile.gettempdir()}/{folder}/{index}-{n}"
    if os.path.exists(path(done)):
        with open(path(done), "rb") as held:
            for block in blocks:
                yield block, np.fromfile(held, count=count * len(block[1])).reshape(count, -1)
        return
    os.makedirs(os.path.dirname(path(0)), exist_ok=True)
    before = open(path(done - 1), "rb") if os.path.exists(path(done - 1)) else None
    trees = so_far(done - 1 if before else 0, done)
    own = f"{path(done)}-{uuid.uuid4().hex}"
    with open(own, "wb") as kept:
        for block in blocks:
            size = count * len(block[1])
            margin = (np.fromfile(before, count=size) if before else np.zeros(size)).reshape(count, -1)
            for number, by_part in trees:
                for part, tree in enumerate(by_part):
                    _grown(codes, part, block, tree, rate if number else 1.0, margin)
            margin.tofile(kept)
            yield block, margin
    os.replace(own, path(done))  # whole, whichever attempt of the task ends first
    if before:
        before.close()
        if os.path.exists(path(done - 1)):
            os.remove(path(done - 1))


def _sums(codes: Codes, blocks: Iterator[tuple], place: list, grown: list[tuple], wanted: list[list[int]], counted: bool) -> np.ndarray:
    """One array of, by part, the residuals and (if `counted`) rows by feature, wanted node and bin; `place` has a part's cuts among all."""
    sums = [[np.zeros((1 + counted, len(nodes), size)) for size in codes.sizes] for nodes in wanted]
    for (block, y, member), margin in blocks:
        for part, nodes in enumerate(wanted):
            if not nodes:
                continue
            rows_by_node = _rows_of(codes, block, np.flatnonzero(member >> part & 1), grown[part], set(nodes))
            for at, node in enumerate(nodes):
                rows = rows_by_node[node]
                sign = y[rows].astype(np.float64)
                residual = sign if margin is None else 4 * sign / (1 + np.exp(2 * sign * margin[part, rows]))
                every = len(rows) == len(y)
                for g, total in enumerate(sums[part]):
                    code = block[g] if every else block[g][rows]
                    total[0, at] += np.bincount(code, residual, minlength=total.shape[2])
                    if counted:
                        total[1, at] += np.bincount(code, minlength=total.shape[2])
    out = [np.zeros(0)]
    for part, by_code in enumerate(sums):
        for kind in range(1 + counted if wanted[part] else 0):
            for f, found in enumerate(codes.by_feature([s[kind] for s in by_code])):
                out.append(np.add.reduceat(found, np.r_[0, place[part][f] + 1], axis=1).ravel())
    return np.concatenate(out)


@dataclass
class BoostedTrees:
    """Fitted trees in heap order: the children of node i are 2 i + 1 and 2 i + 2, a `feature` of -1 marks a leaf."""

    features: list[str]
    rate: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    gain: np.ndarray
    rows: np.ndarray

    def margins(self, x: Sequence[np.ndarray]) -> np.ndarray:
        """Weighted sum of the trees' values by row, above 0 for label 1; `x` holds a column per feature."""
        size, out = self.feature.shape[1], np.zeros(len(x[0]))
        leaf, own = self.feature < 0, np.arange(size)
        down, tests = np.where(leaf, own, 2 * own + 1), np.where(leaf, 0, self.feature).astype(np.int64)
        limits = np.where(leaf, np.inf, self.threshold)
        for begin in range(0, len(out), MARGIN_ROWS):  # what a block's steps touch stays in the processor's cache
            n = len(x[0][begin : begin + MARGIN_ROWS])
            block, row = np.concatenate([c[begin : begin + MARGIN_ROWS] for c in x]), np.arange(n)
            for tree in range(len(down)):
                at = np.zeros(n, np.int64)
                for _ in range(int(np.log2(size + 1)) - 1):
                    at = down[tree].take(at) + (block.take(tests[tree].take(at) * n + row) > limits[tree].take(at))
                out[begin : begin + n] += (self.rate if tree else 1.0) * self.value[tree].take(at)
        return out


@dataclass
class Binning:
    """What a fit knows about its features: codes, and by part its cuts, their number and their places among all cuts."""

    codes: Codes
    own: list[list[np.ndarray]]
    counts: list[np.ndarray]
    place: list[list[np.ndarray]]


def _boost(features: Sequence[str], held: Binning, trees: int, depth: int, rate: float, summed: Callable) -> list[BoostedTrees]:
    """The trees of all parts; `summed` gives the `_sums` of wanted nodes of the tree that is being grown, from all rows.

    Of two children only the smaller one is summed up: the other one is what its parent has besides.
    """
    count = len(held.own)
    nodes = (1 << (depth + 1)) - 1
    shape = (count, trees, nodes)
    split_on, split_bin = np.full(shape, -1, np.int16), np.zeros(shape, np.uint16)
    threshold, gains, rows, value = np.zeros(shape), np.zeros(shape), np.zeros(shape), np.zeros(shape)
    bins = max((int(c.max(initial=0)) for c in held.counts), default=0) + 1

    def asked(t: int, wanted: list[list[int]], counted: bool) -> list[np.ndarray]:
        """By part the (sums and rows, node, feature, bin)."""
        flat = summed(t, (split_on, split_bin, value), wanted, counted)
        at, out = 0, []
        for part, some in enumerate(wanted):
            found = np.zeros((1 + counted, len(some), len(features), bins))
            for kind in range(1 + counted):
                for f, n in enumerate(held.counts[part] + 1):
                    found[kind, :, f, :n] = flat[at : at + len(some) * n].reshape(-1, n)
                    at += len(some) * n
            out.append(found)
        return out

    roots: list[np.ndarray] = []
    for t in range(trees):
        found = asked(t, [[0]] * count, t == 0)
        roots = roots or [part[1, 0] for part in found]  # rows by bin stay the same
        level_sums = [{0: (roots[i], found[i][0, 0])} for i in range(count)]
        for i in range(count):
            rows[i, t, 0] = roots[i][0].sum()
            value[i, t, 0] = found[i][0, 0, 0].sum() / rows[i, t, 0]
        for level in range(depth):
            smaller: list[list[int]] = [[] for _ in range(count)]
            for i in range(count):
                if not level_sums[i]:
                    continue
                n, total = (np.stack(c) for c in zip(*level_sums[i].values(), strict=True))
                for node, (f, cut, gain, n_left, left) in zip(level_sums[i], _best_splits(n, total, held.counts[i]), strict=True):
                    if f < 0:
                        continue
                    split_on[i, t, node], split_bin[i, t, node] = f, held.place[i][f][cut]
                    threshold[i, t, node], gains[i, t, node] = held.own[i][f][cut], gain
                    low, high = 2 * node + 1, 2 * node + 2
                    whole = value[i, t, node] * rows[i, t, node]
                    rows[i, t, low], rows[i, t, high] = n_left, rows[i, t, node] - n_left
                    value[i, t, low], value[i, t, high] = left / n_left, (whole - left) / rows[i, t, high]
                    smaller[i].append(low if n_left <= rows[i, t, high] else high)
            if level == depth - 1 or not any(smaller):
                break
            found = asked(t, smaller, True)
            children: list[dict] = [{} for _ in range(count)]
            for i, some in enumerate(smaller):
                for at, node in enumerate(some):
                    total, n = found[i][0, at], found[i][1, at]
                    parent_n, parent = level_sums[i][(node - 1) // 2]
                    rest = parent_n - n
                    both = {node: (n, total), node + (1 if node % 2 else -1): (rest, np.where(rest > 0, parent - total, 0.0))}
                    children[i].update({k: v for k, v in both.items() if rows[i, t, k] > 1})
            level_sums = children
    return [BoostedTrees(list(features), rate, split_on[i], threshold[i], value[i], gains[i], rows[i]) for i in range(count)]


def _boost_whole(features: Sequence[str], held: Binning, trees: int, depth: int, rate: float, blocks: Iterator[tuple]) -> BoostedTrees:
    """The trees of one part whose rows are all here."""
    coded, y, _ = (np.concatenate(c, axis=-1) for c in zip(*blocks, strict=True))
    block, margin, done = (coded, y, np.ones(len(y), np.uint8)), np.zeros((1, len(y))), 0

    def summed(t: int, grown: tuple, wanted: list[list[int]], counted: bool) -> np.ndarray:
        nonlocal done
        if done < t:
            _grown(held.codes, 0, block, tuple(a[0, done] for a in grown), rate if done else 1.0, margin)
            done = t
        return _sums(held.codes, iter([(block, margin if t else None)]), held.place, [(grown[0][0, t], grown[1][0, t])], wanted, counted)

    return _boost(features, held, trees, depth, rate, summed)[0]


def _boost_spread(features: Sequence[str], held: Binning, trees: int, depth: int, rate: float, blocks: RDD, tasks: int) -> list[BoostedTrees]:
    """The trees of all parts, whose rows lie in the blocks of many tasks: a level of a tree, of all parts, is one job."""
    sc, codes, place, count = blocks.context, held.codes, held.place, len(held.own)
    folder = f"ledgerlens-margins-{uuid.uuid4().hex}"
    kept = sc.broadcast(None)

    def summed(t: int, grown: tuple, wanted: list[list[int]], counted: bool) -> np.ndarray:
        nonlocal kept
        if t and t % 10 == 0 and not any(w != [0] for w in wanted):
            kept.unpersist()
            kept = sc.broadcast(tuple(a[:, :t].copy() for a in grown))
        old, base = kept, t - t % 10
        later = tuple(a[:, base:t].copy() for a in grown)
        here = [(grown[0][i, t].copy(), grown[1][i, t].copy()) for i in range(count)]

        def so_far(first: int, end: int) -> list[tuple]:
            start = base if first >= base else 0
            arrays = later if start or not base else [np.concatenate(c, axis=1) for c in zip(old.value, later, strict=True)]
            return [(n, [tuple(a[i, n - start] for a in arrays) for i in range(count)]) for n in range(first, end)]

        def run(index: int, of_task: Iterator[tuple]) -> Iterator[np.ndarray]:
            with_margins = _margins(codes, folder, count, index, of_task, so_far, t, rate) if t else ((b, None) for b in of_task)
            yield _sums(codes, with_margins, place, here, wanted, counted)

        passed = blocks.mapPartitionsWithIndex(run)
        return reduce(operator.add, passed.collect()) if tasks <= 64 else passed.treeReduce(operator.add)

    try:
        return _boost(features, held, trees, depth, rate, summed)
    finally:
        kept.unpersist()
        blocks.foreachPartition(lambda _: shutil.rmtree(f"{tempfile.gettempdir()}/{folder}", ignore_errors=True))


def fit_parts(
    df: DataFrame,
    features: Sequence[str],
    parts: Sequence[Column],
    label: str = "label",
    trees: int = 100,
    depth: int = 5,
    rate: float = 0.1,
    seed: int = 42,
) -> list[BoostedTrees]:
    """Gradient boosting on the logistic loss (Friedman 2001) with histograms: a classifier for each condition in `parts`.

    Equals Spark's `GBTClassifier`, up to splits of equal gain. The rows are binned once. Up to WHOLE_ROWS rows a
    part, each part is grown by one task: a job for every level would cost more than its sums. Beyond, blocks of rows are
    kept by Spark and a level of all parts is one job. The cuts of a part come from its own rows, about CUT_ROWS of them.
    """
    if len(parts) > SIDE_BY_SIDE:
        fitted = [fit_parts(df, features, parts[i : i + SIDE_BY_SIDE], label, trees, depth, rate, seed) for i in range(0, len(parts), SIDE_BY_SIDE)]
        return [model for models in fitted for model in models]
    names, count = [f"x{i}" for i in range(len(features))], len(parts)
    sc, mask = df.sparkSession.sparkContext, np.min_scalar_type((1 << count) - 1)
    numbers = [F.col(c).cast("double").alias(x) for c, x in zip(features, names, strict=True)]
    table = df.select(
        *numbers,
        F.col(label).cast("double").alias("y"),
        reduce(operator.add, [F.when(part, 1 << i).otherwise(0) for i, part in enumerate(parts)]).cast("int").alias("parts"),
    ).filter("parts > 0")
    sizes = list(table.agg(*[F.count_if(F.col("parts").bitwiseAND(1 << i) > 0) for i in range(count)]).first())
    if not all(sizes):
        raise ValueError("a classifier has no rows to learn from")
    own = []
    for part, n in zip(parts, sizes, strict=True):
        x = _drawn(df.filter(part).select(*numbers), n, seed).toPandas().to_numpy(dtype=float)
        own.append([feature_cuts(x[:, f], min(BINS, n), float(min(CUT_ROWS, n))) for f in range(len(names))])
    cuts = [np.unique(np.concatenate([c[f] for c in own])) for f in range(len(names))]
    place = [[np.searchsorted(cuts[f], c[f]) for f in range(len(names))] for c in own]
    codes = Codes.of([len(c) + 1 for c in cuts])
    held = Binning(codes, own, [np.array([len(c) for c in by_feature]) for by_feature in own], place)
    packed = _binned(table, names, cuts, codes, mask)
    if max(sizes) <= WHOLE_ROWS:

        def by_part(row: Row) -> Iterator[tuple]:
            block, y, parts = _unpacked(codes, mask, row)
            for part in range(count):
                rows = np.flatnonzero(parts >> part & 1)
                if len(rows):
                    yield part, (block[:, rows], y[rows], parts[rows])

        def grow(part: int, blocks: Iterator[tuple]) -> Iterator[tuple]:
            alone = Binning(codes, own[part : part + 1], held.counts[part : part + 1], place[part : part + 1])
            yield part, _boost_whole(features, alone, trees, depth, rate, (block for _, block in blocks))

        grown = packed.rdd.flatMap(by_part).partitionBy(count, int).mapPartitionsWithIndex(grow).collect()
        return [model for _, model in sorted(grown, key=lambda g: g[0])]
    tasks = max(1, min(sc.defaultParallelism, -(-sum(sizes) // TASK_ROWS)))

    def joined(rows: Iterator[Row]) -> Iterator[tuple]:
        some: list[tuple] = []
        for row in rows:
            some.append(_unpacked(codes, mask, row))
            if sum(len(b[1]) for b in some) >= BLOCK_ROWS:
                yield tuple(np.concatenate(c, axis=-1) for c in zip(*some, strict=True))
                some = []
        if some:
            yield tuple(np.concatenate(c, axis=-1) for c in zip(*some, strict=True))

    blocks = packed.repartition(tasks).rdd.mapPartitions(joined).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _boost_spread(features, held, trees, depth, rate, blocks, tasks)
    finally:
        blocks.unpersist()


_NODES = (
    "treeID int, nodeData struct<id: int, prediction: double, impurity: double, impurityStats: array<double>, rawCount: bigint, gain: double,"
    " leftChild: int, rightChild: int, split: struct<featureIndex: int, leftCategoriesOrThreshold: array<double>, numCategories: int>>"
)
#: The Spark version whose layout of saved models is written here; later ones read it too.
_LAYOUT = "4.1.2"


def library_model(spark: SparkSession, fitted: BoostedTrees, label: str, seed: int) -> PipelineModel:
    """The trees as a model of Spark's library. The impurity of nodes is not known and not a number."""
    nan, out = float("nan"), []
    arrays = (fitted.feature, fitted.threshold, fitted.value, fitted.gain, fitted.rows)
    n, depth = len(fitted.feature), int(np.log2(fitted.feature.shape[1] + 1)) - 1
    for number, (feature, threshold, value, gain, rows) in enumerate(zip(*(a.tolist() for a in arrays), strict=True)):
        order = [node for node in range(len(rows)) if rows[node] > 0]  # parents before their children
        ids = {node: i for i, node in enumerate(order)}
        for i, node in enumerate(order):
            inner = feature[node] >= 0
            down = (ids[2 * node + 1], ids[2 * node + 2]) if inner else (-1, -1)
            split = (feature[node], [threshold[node]], -1) if inner else (-1, [], -1)
            stats = [rows[node], rows[node] * value[node], nan]
            out.append((number, (i, value[node], nan, stats, int(rows[node]), gain[node] if inner else -1.0, *down, split)))
    params = {"featuresCol": "features", "labelCol": label, "predictionCol": "predicted", "maxDepth": depth, "seed": seed}
    common = {"timestamp": 0, "sparkVersion": _LAYOUT, "defaultParamMap": {}}
    tree = {"class": "org.apache.spark.ml.regression.DecisionTreeRegressionModel", "paramMap": {**params, "impurity": "variance"}, **common}
    whole = {
        "class": "org.apache.spark.ml.classification.GBTClassificationModel",
        "uid": f"GBTClassifier_{uuid.uuid4().hex[:12]}",
        "paramMap": {**params, "impurity": "variance", "lossType": "logistic", "maxIter": n, "stepSize": fitted.rate, "checkpointInterval": 10},
        "numFeatures": len(fitted.features),
        "numTrees": n,
        **common,
    }
    each = [(i, json.dumps({**tree, "uid": f"dtr_{uuid.uuid4().hex[:12]}"}), fitted.rate if i else 1.0) for i in range(n)]
    scratch = Scratch(spark, "boosted")
    spark.createDataFrame([(json.dumps(whole),)], "value string").coalesce(1).write.text(f"{scratch.root}/model/metadata")
    spark.createDataFrame(each, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{scratch.root}/model/treesMetadata")
    spark.createDataFrame(out, _NODES).coalesce(1).write.parquet(f"{scratch.root}/model/data")
    model = GBTClassificationModel.load(f"{scratch.root}/model")
    scratch.drop("model")
    return PipelineModel([VectorAssembler(inputCols=fitted.features, outputCol="features"), model])


def fit_boosted(
    train: DataFrame, features: Sequence[str], label: str = "label", trees: int = 100, depth: int = 5, rate: float = 0.1, seed: int = 42
) -> PipelineModel:
    return library_model(train.sparkSession, fit_parts(train, features, [F.lit(True)], label, trees, depth, rate, seed)[0], label, seed)


def probability(df: DataFrame, model: PipelineModel, alias: str = "probability_1") -> DataFrame:
    scored = model.transform(df)
    return scored.withColumn(alias, vector_to_array("probability")[1]).drop(
        "features", "rawPrediction", "probability", "predicted"
    )


def fold_margin(models: Sequence[BoostedTrees], features: Sequence[Column], fold: Column) -> Column:
    """The margin of a row by the model of its fold."""

    @F.pandas_udf(DoubleType())
    def margin(number: pd.Series, *columns: pd.Series) -> pd.Series:
        which, x = number.to_numpy(), [c.to_numpy(dtype="float64") for c in columns]
        out = np.zeros(len(which))
        for i, model in enumerate(models):
            rows = np.flatnonzero(which == i)
            if len(rows):
                out[rows] = model.margins([c[rows] for c in x])
        return pd.Series(out)

    return margin(fold, *[c.cast("double") for c in features])


@dataclass
class Training:
    """A fitted classifier with its holdout and cross-validation metrics (one row)."""

    model: PipelineModel
    metrics: dict[str, float]
    importances: list[tuple[str, float]]


def train_classifier(
    df: DataFrame,
    features: Sequence[str],
    label: str = "label",
    key: str = "loan_id",
    trees: int = 100,
    depth: int = 5,
    rate: float = 0.1,
    seed: int = 42,
    folds: int = 5,
) -> Training:
    """Holdout metrics on a stratified 80/20 split, F1 over `folds` hashed folds, and feature importances.

    The rows are written once. The holdout fit and those of all folds grow side by side, in the same passes.
    """
    rows = written_table(df.select(key, F.col(label).cast("double").alias(label), *features), "training")
    in_train = train_rows(rows, label, key, seed=seed)
    train, test = rows.filter(in_train), rows.filter(~in_train)
    fold = F.pmod(F.xxhash64(F.col(key), F.lit(seed + 1)), F.lit(max(folds, 1)))
    parts = [in_train, *[fold != number for number in range(folds)]]
    fitted, *by_fold = fit_parts(rows, features, parts, label, trees, depth, rate, seed)
    model = library_model(df.sparkSession, fitted, label, seed)
    margin = vector_to_array("rawPrediction")[1].alias("margin")
    judged = written_table(model.transform(test).select(label, "predicted", margin), "holdout")
    scores = confusion_metrics(judged, label).first()
    sizes = {name: part.agg(F.count(F.lit(1)), F.avg(label)).first() for name, part in (("train", train), ("test", test))}
    metrics = {
        "precision": scores["precision"],
        "recall": scores["recall"],
        "f1_score": scores["f1_score"],
        "roc_auc": roc_auc(judged, label, "margin").first()["roc_auc"],
        "training_samples": float(sizes["train"][0]),
        "test_samples": float(sizes["test"][0]),
        "fraud_rate_train": sizes["train"][1],
        "fraud_rate_test": sizes["test"][1],
    }
    if folds:
        own = fold_margin(by_fold, [F.col(c) for c in features], fold)
        guessed = written_table(rows.select(label, fold.alias("fold"), (own > 0).cast("double").alias("predicted")), "folds")
        f1 = [confusion_metrics(guessed.filter(F.col("fold") == number), label).first()["f1_score"] for number in range(folds)]
        mean = sum(f1) / folds
        metrics["cv_f1_mean"] = mean
        metrics["cv_f1_std"] = (sum((x - mean) ** 2 for x in f1) / folds) ** 0.5
    weights = model.stages[-1].featureImportances.toArray()
    importances = sorted(zip(features, map(float, weights)), key=lambda p: (-p[1], p[0]))
    return Training(model, metrics, importances)


def metrics_frame(df: DataFrame, training: Training) -> DataFrame:
    rows = [Row(metric=k, value=float(v)) for k, v in training.metrics.items()]
    return df.sparkSession.createDataFrame(rows, "metric string, value double")


def importance_frame(df: DataFrame, training: Training, n: int | None = None) -> DataFrame:
    rows = [Row(feature=f, importance=v) for f, v in training.importances[:n]]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double")
