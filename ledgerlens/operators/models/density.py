"""Local outlier factor (Breunig et al. 2000) with exact neighbours, over a k-d tree of cells.

1. Equal points collapse to one weighted point.
2. A bounded sample of the points grows a k-d tree that cuts the widest coordinate of a cell at its median. All
   coordinates take part, so a value that a third of the points share in one of them is cut along the others.
3. Every cell finds its points' nearest neighbours among its own. The distance to the k-th is an upper bound; where
   that ball reaches into the bounding box of other cells, the point is sent there as a query (its halo).
4. Only points with such queries are merged and cut again; the others are final.

The driver sees the sample and one bounding box per cell, both bounded by parameters. Nothing is approximated.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.session import written_table

#: Points of a cell, until there are MAX_CELLS of them; then cells grow.
CELL_POINTS = 4096
MAX_CELLS = 4096
SAMPLE_PER_CELL = 32
#: Points that are compared at a time inside a cell.
_BLOCK = 128
_CHUNK_CELLS = 4_000_000

_NEAR = "id long, other long, other_weight long, distance double"


@dataclass
class CellTree:
    """Nodes of a k-d tree: `axis` -1 marks a leaf, whose `left` is the number of its cell."""

    axis: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray

    @classmethod
    def grow(cls, sample: np.ndarray, cells: int) -> CellTree:
        axis, cut, left, right = [], [], [], []

        def node(rows: np.ndarray, wanted: int) -> int:
            place = len(axis)
            for column in (axis, cut, left, right):
                column.append(-1)
            spread = np.ptp(rows, axis=0) if len(rows) else np.zeros(1)
            if wanted > 1 and spread.max() > 0:
                a = int(spread.argmax())
                values = np.sort(rows[:, a])
                at = values[len(values) // 2]
                if at == values[0]:  # the lower half is one value
                    at = values[np.searchsorted(values, at, "right")]
                below = rows[:, a] < at
                axis[place], cut[place] = a, at
                left[place] = node(rows[below], wanted // 2)
                right[place] = node(rows[~below], wanted - wanted // 2)
            return place

        node(sample, max(1, cells))
        tree = cls(*(np.array(c) for c in (axis, cut, left, right)))
        leaves = np.flatnonzero(tree.axis == -1)
        tree.left[leaves] = np.arange(len(leaves))
        return tree

    def cell_of(self, points: np.ndarray) -> np.ndarray:
        at = np.zeros(len(points), dtype=np.int64)
        while True:
            moving = np.flatnonzero(self.axis[at] >= 0)
            if not len(moving):
                return self.left[at]
            here = at[moving]
            below = points[moving, self.axis[here]] < self.cut[here]
            at[moving] = np.where(below, self.left[here], self.right[here])


def _blocks(points: np.ndarray) -> list[np.ndarray]:
    """Positions in blocks of close points: halves of the widest coordinate, again and again."""
    out, open_blocks = [], [np.arange(len(points))]
    while open_blocks:
        rows = open_blocks.pop()
        if len(rows) <= _BLOCK:
            out.append(rows)
            continue
        axis = int(np.ptp(points[rows], axis=0).argmax())
        half = len(rows) // 2
        order = np.argpartition(points[rows, axis], half)
        open_blocks += [rows[order[:half]], rows[order[half:]]]
    return out


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    total = np.zeros((len(a), len(b)))
    for f in range(a.shape[1]):
        total += (a[:, f, None] - b[None, :, f]) ** 2
    return np.sqrt(total)


def _cut(asked: np.ndarray, other: np.ndarray, weight: np.ndarray, distance: np.ndarray, k: int):
    """Of (asked, other) rows those within each asked point's weighted k-distance, and that distance (inf: too few)."""
    order = np.lexsort((distance, asked))
    asked, other, weight, distance = asked[order], other[order], weight[order], distance[order]
    begin = np.flatnonzero(np.r_[True, asked[1:] != asked[:-1]]) if len(asked) else np.zeros(0, int)
    sizes = np.diff(np.r_[begin, len(asked)])
    before = np.cumsum(weight) - weight
    before -= np.repeat(before[begin], sizes)
    needed = before < k
    radius = np.maximum.reduceat(np.where(needed, distance, -1.0), begin) if len(begin) else np.zeros(0)
    total = np.add.reduceat(weight, begin) if len(begin) else np.zeros(0)
    keep = distance <= np.repeat(radius, sizes)
    return asked[keep], other[keep], weight[keep], distance[keep], asked[begin], np.where(total >= k, radius, np.inf)


def nearest_inside(points: np.ndarray, weight: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Per block of one cell: rows (asked, other, weight, distance) within the k-distance, asked points, their radius."""
    blocks = _blocks(points)
    low = np.array([points[b].min(axis=0) for b in blocks])
    high = np.array([points[b].max(axis=0) for b in blocks])
    for number, rows in enumerate(blocks):
        gap = np.maximum(0, np.maximum(low - high[number], low[number] - high))
        away = np.sqrt((gap**2).sum(axis=1))
        x, bound = points[rows], np.full(len(rows), np.inf)
        seen: list[tuple[np.ndarray, np.ndarray]] = []
        for near in np.argsort(away, kind="stable"):
            if away[near] > bound.max():
                break
            d = _distances(x, points[blocks[near]])
            seen.append((blocks[near], d))
            if not np.isfinite(bound).all() or len(seen) % 4 == 0:  # k other points bound the k-distance
                together = np.concatenate([s[1] for s in seen], axis=1)
                if together.shape[1] > k:
                    bound = np.partition(together, k, axis=1)[:, k]
                    # what lies beyond every bound is not needed again
                    if together.shape[1] > 16 * _BLOCK:
                        seen = _closest(seen, bound)
        others = np.concatenate([s[0] for s in seen])
        d = np.concatenate([s[1] for s in seen], axis=1)
        i, j = np.nonzero(d <= bound[:, None])
        w = weight[others[j]] - (others[j] == rows[i])
        real = w > 0
        yield _cut(rows[i[real]], others[j[real]], w[real], d[i[real], j[real]], k)


def _closest(seen: list[tuple[np.ndarray, np.ndarray]], bound: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    ids, d = np.concatenate([s[0] for s in seen]), np.concatenate([s[1] for s in seen], axis=1)
    needed = (d <= bound[:, None]).any(axis=0)
    return [(ids[needed], d[:, needed])]


def nearest_among(asked: np.ndarray, reach: np.ndarray, members: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(position of the asked, position of the member, distance) within each asked point's reach."""
    axis = int(np.ptp(members, axis=0).argmax())
    order = np.argsort(members[:, axis], kind="stable")
    line = members[order, axis]
    ask_order = np.argsort(asked[:, axis], kind="stable")
    start = 0
    while start < len(asked):
        stop, width = min(len(asked), start + 64), 0
        rows = ask_order[start:stop]
        low = np.searchsorted(line, (asked[rows, axis] - reach[rows]).min(), "left")
        high = np.searchsorted(line, (asked[rows, axis] + reach[rows]).max(), "right")
        for a in range(low, high, max(1, _CHUNK_CELLS // len(rows))):
            width = min(high, a + max(1, _CHUNK_CELLS // len(rows)))
            d = _distances(asked[rows], members[order[a:width]])
            i, j = np.nonzero(d <= reach[rows, None])
            yield rows[i], order[a + j], d[i, j]
        start = stop


def touched_boxes(
    points: np.ndarray, radius: np.ndarray, low: np.ndarray, high: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """(position of the point, number of the box): the boxes that each point's ball reaches into.

    `points` lie close together: a box beyond the widest ball around their common box is out for all of them, so that
    few boxes are left to compare, however many there are.
    """
    if not len(points):
        return np.zeros(0, int), np.zeros(0, int)
    apart = np.maximum(0, np.maximum(low - points.max(axis=0), points.min(axis=0) - high))
    # never larger than a point's own distance to the box, also when rounded: every step is monotone
    close = np.flatnonzero(np.sqrt((apart**2).sum(axis=1)) <= radius.max())
    gap = np.maximum(0, np.maximum(low[close][None] - points[:, None], points[:, None] - high[close][None]))
    i, j = np.nonzero(np.sqrt((gap**2).sum(axis=2)) <= radius[:, None])
    return i, close[j]


def cell_tree(points: DataFrame, features: Sequence[str], per_cell: int, max_cells: int = MAX_CELLS) -> CellTree:
    """The tree over a sample of SAMPLE_PER_CELL points for each of at most `max_cells` cells."""
    count = points.count()
    cells = min(max_cells, -(-count // per_cell))
    if cells <= 1:
        return CellTree.grow(np.zeros((0, 1)), 1)
    share = min(1.0, cells * SAMPLE_PER_CELL / count)
    drawn = points.filter(F.pmod(F.xxhash64(*features), F.lit(1 << 30)) < int(share * (1 << 30)))
    sample = np.array([tuple(r) for r in drawn.select(*features).limit(2 * cells * SAMPLE_PER_CELL).collect()], dtype=float)
    return CellTree.grow(sample.reshape(-1, len(list(features))), cells)


def neighbours(
    points: DataFrame, features: Sequence[str], k: int, per_cell: int = CELL_POINTS, max_cells: int = MAX_CELLS
) -> DataFrame:
    """(id, other, other_weight, distance): everything within the k-distance of each weighted point, ties included.

    `points` has a distinct long `id` and `weight` per point. A point of weight w is its own neighbour w - 1 times.
    """
    names = list(features)
    tree = cell_tree(points, names, per_cell, max_cells)
    floats = ", ".join(f"{n} double" for n in names)
    places = [f"asked_{i}" for i in range(len(names))]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([np.asarray(batch.column(n)) for n in names])
            columns = [pa.array(tree.cell_of(x)), *(batch.column(n) for n in ("id", "weight", *names))]
            yield pa.RecordBatch.from_arrays(columns, names=["cell", "id", "weight", *names])

    held = written_table(
        points.select("id", "weight", *[F.col(n).cast("double").alias(n) for n in names]).mapInArrow(
            placed, f"cell long, id long, weight long, {floats}"
        ),
        "lof-cells",
    )
    # a box per cell, of which there are at most `max_cells`
    boxes = held.groupBy("cell").agg(*[F.min(n) for n in names], *[F.max(n) for n in names]).orderBy("cell").collect()
    number = np.array([b[0] for b in boxes])
    low, high = (np.array([b[1 + o : 1 + o + len(names)] for b in boxes], dtype=float) for o in (0, len(names)))

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        """Neighbours of the cell's points among them; rows of other -1 ask other cells (weight: the cell)."""
        x, ids = pdf[names].to_numpy(), pdf["id"].to_numpy()
        here, parts = pdf["cell"].iat[0], []
        for asked, other, weight, distance, whose, radius in nearest_inside(x, pdf["weight"].to_numpy(), k):
            alone = np.setdiff1d(np.arange(len(x)), whose) if len(x) == 1 else np.zeros(0, int)
            whose, radius = np.r_[whose, alone], np.r_[radius, np.full(len(alone), np.inf)]
            i, j = touched_boxes(x[whose], radius, low, high)
            i, j = i[number[j] != here], j[number[j] != here]
            open_rows = np.isin(asked, whose[i])
            parts.append((ids[asked], ids[other], weight, distance, open_rows))
            parts.append((ids[whose[i]], np.full(len(i), -1), number[j], radius[i], np.ones(len(i), bool)))
        columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
        return pd.DataFrame(dict(zip(["id", "other", "other_weight", "distance", "open"], columns, strict=True)))

    near = written_table(held.groupBy("cell").applyInPandas(inside, f"{_NEAR}, open boolean"), "lof-inside")
    final = near.filter(~F.col("open")).drop("open")
    asking = near.filter("other = -1").select("id", F.col("other_weight").alias("cell"), F.col("distance").alias("reach"))
    if len(boxes) < 2 or asking.isEmpty():
        return final

    def meet(queries: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(members):
            return pd.DataFrame({"id": [], "other": [], "other_weight": [], "distance": []})
        ids, others, weight = queries["id"].to_numpy(), members["id"].to_numpy(), members["weight"].to_numpy()
        found = [
            (ids[i], others[j], weight[j], d)
            for i, j, d in nearest_among(queries[places].to_numpy(), queries["reach"].to_numpy(), members[names].to_numpy())
        ]
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [[], [], [], []]
        return pd.DataFrame(dict(zip(["id", "other", "other_weight", "distance"], columns, strict=True)))

    queries = asking.join(held.select("id", *[F.col(n).alias(p) for n, p in zip(names, places, strict=True)]), "id")
    foreign = queries.groupBy("cell").cogroup(held.groupBy("cell")).applyInPandas(meet, _NEAR)
    own = near.filter(F.col("open") & (F.col("other") >= 0)).drop("open")
    met = written_table(own.unionByName(foreign), "lof-met")
    order = Window.partitionBy("id").orderBy("distance").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    same = Window.partitionBy("id", "distance")
    before = F.col("_upto") - F.sum("other_weight").over(same)
    merged = (
        met.withColumn("_upto", F.sum("other_weight").over(order))
        .withColumn("_before", before)
        .filter(F.col("_before") < k)
        .drop("_upto", "_before")
    )
    return final.unionByName(merged)


def local_outlier_factor(
    df: DataFrame,
    features: Sequence[str],
    key: str = "loan_id",
    k: int = 20,
    per_cell: int = CELL_POINTS,
    max_cells: int = MAX_CELLS,
) -> DataFrame:
    """(key, lof): about 1 inside a cluster, larger for outliers. Missing coordinates count as 0; fewer than two rows have none."""
    names = list(features)
    rows = df.select(key, *[(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) + 0.0).alias(c) for c in names])
    points = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("weight"))
    points = written_table(points.withColumn("id", F.monotonically_increasing_id()), "lof-points")
    near = written_table(neighbours(points, names, k, per_cell, max_cells), "lof-neighbours")
    radius = written_table(near.groupBy("id").agg(F.max("distance").alias("radius")), "lof-radius")
    reached = near.join(radius.withColumnsRenamed({"id": "other"}), "other").withColumn(
        "reach", F.greatest("radius", "distance")
    )
    mean_reach = F.sum(F.col("reach") * F.col("other_weight")) / F.sum("other_weight")
    density = written_table(reached.groupBy("id").agg((1 / (mean_reach + 1e-10)).alias("density")), "lof-density")
    around = near.join(density.withColumnsRenamed({"id": "other", "density": "other_density"}), "other")
    mean_density = F.sum(F.col("other_density") * F.col("other_weight")) / F.sum("other_weight")
    factor = (
        around.groupBy("id")
        .agg(mean_density.alias("around"))
        .join(density, "id")
        .select("id", (F.col("around") / F.col("density")).alias("lof"))
    )
    scored = written_table(points.join(factor, "id").select(*names, "lof"), "lof-factor")
    return rows.join(scored, names).select(key, "lof")


def flag_share(scored: DataFrame, column: str, contamination: float = 0.1, alias: str = "is_outlier") -> DataFrame:
    """Marks the rows above the (1 - contamination) quantile of a score."""
    cut = scored.agg(F.percentile_approx(column, 1 - contamination, 100000)).scalar()
    return scored.withColumn(alias, F.col(column) > cut)
