"""Exact order statistics of many numeric columns at once, without sorting or shuffling values.

A double maps to a 64-bit number of the same order. Its bits are settled from the top, BITS at a time: a pass counts, for
every prefix that still holds a wanted rank, how often each continuation occurs, and the rank then falls into one of them.
A pass is one scan of the columns, its tasks send at most 2**BITS counts per open prefix, and the driver sees one prefix
per wanted rank; columns whose wanted values are settled early (a prefix of equal values) cost no further counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 13
_TOP = np.uint64(1 << 63)


def ordered_bits(x: np.ndarray) -> np.ndarray:
    """Numbers without sign in the order of the doubles; -0 and 0 are one value, NaN is the largest."""
    bits = (np.where(np.isnan(x), np.nan, x) + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63) == 1, ~bits, bits | _TOP)


def _value(bits: int) -> float:
    raw = bits ^ (1 << 63) if bits >> 63 else ~bits & ((1 << 64) - 1)
    return float(np.array([raw], dtype=np.uint64).view(np.float64)[0])


def order_statistics(df: DataFrame, ranks: dict[str, Sequence[int]]) -> dict[tuple[str, int], float]:
    """The value at each rank (from 0) among the non-null values of each column, ascending."""
    open_ranks = {(c, r): (0, r) for c, wanted in ranks.items() for r in wanted}  # settled prefix, rank inside it
    names = sorted({c for c, _ in open_ranks})
    columns = df.select(*[F.col(c).cast("double").alias(c) for c in names])
    done_bits = 0
    while done_bits < 64 and open_ranks:
        width = min(BITS, 64 - done_bits)
        shift = 64 - done_bits - width
        prefixes = {c: np.unique(np.array([p for (n, _), (p, _) in open_ranks.items() if n == c], dtype=np.uint64)) for c in names}

        def counted(batches: Iterator[pa.RecordBatch], at=(done_bits, width, shift, prefixes)) -> Iterator[pa.RecordBatch]:
            done, width, shift, prefixes = at
            sums = {c: np.zeros((len(p), 1 << width), np.int64) for c, p in prefixes.items()}
            for batch in batches:
                for c, wanted in prefixes.items():
                    x = batch.column(c).drop_null().to_numpy(zero_copy_only=False)
                    bits = ordered_bits(np.asarray(x, dtype=np.float64))
                    place = np.zeros(len(bits), np.int64)
                    if done:
                        prefix = bits >> np.uint64(64 - done)
                        place = np.minimum(np.searchsorted(wanted, prefix), len(wanted) - 1)
                        inside = wanted[place] == prefix
                        bits, place = bits[inside], place[inside]
                    digit = ((bits >> np.uint64(shift)) & np.uint64((1 << width) - 1)).astype(np.int64)
                    sums[c] += np.bincount((place << width) + digit, minlength=sums[c].size).reshape(sums[c].shape)
            for number, c in enumerate(prefixes):
                row, digit = np.nonzero(sums[c])
                if len(row):
                    found = [np.full(len(row), number), row, digit, sums[c][row, digit]]
                    yield pa.RecordBatch.from_arrays([pa.array(f, pa.int64()) for f in found], names=["c", "p", "digit", "n"])

        counts = columns.mapInArrow(counted, "c long, p long, digit long, n long").groupBy("c", "p", "digit").agg(F.sum("n").alias("n"))
        tables: dict[tuple[int, int], list] = {}
        for r in counts.collect():  # 2**BITS rows at most for each open prefix
            tables.setdefault((r["c"], r["p"]), []).append((r["digit"], r["n"]))
        following = {}
        for (c, rank), (prefix, inside) in open_ranks.items():
            digits = sorted(tables[names.index(c), int(np.searchsorted(prefixes[c], np.uint64(prefix)))])
            for digit, n in digits:
                if inside < n:
                    break
                inside -= n
            following[c, rank] = ((prefix << width) | digit, inside)
        open_ranks = following
        done_bits += width
    return {key: _value(prefix) for key, (prefix, _) in open_ranks.items()}


def quantiles(df: DataFrame, columns: Sequence[str], shares: Sequence[float]) -> dict[str, list[float | None]]:
    """Exact quantiles of every column, linear between the two values around position (n - 1) * share; null when empty."""
    counts = df.agg(*[F.count(F.col(c)).alias(c) for c in columns]).first()
    wanted = {
        c: sorted({f((counts[c] - 1) * s) for s in shares for f in (math.floor, math.ceil)}) for c in columns if counts[c]
    }
    found = order_statistics(df, wanted)
    out = {}
    for c in columns:
        if not counts[c]:
            out[c] = [None] * len(shares)
            continue
        places = [(counts[c] - 1) * s for s in shares]
        pairs = [(found[c, math.floor(p)], found[c, math.ceil(p)], p - math.floor(p)) for p in places]
        out[c] = [low if low == high else low + (high - low) * part for low, high, part in pairs]
    return out
