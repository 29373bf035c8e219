"""Scoring transactions as they arrive, with the history of their customer kept as state.

Every transaction leaves at once with the same history columns that `operators.history.with_history` computes for a table;
what follows (features, scores) is stateless. When transactions arrive in order of time the stream's rows are those of the
table. One that arrives late, but within the watermark, sees what is known of its past by then; rows already written are
not revised.

State of a customer: 30 days of transactions as packed arrays, the latest transaction, and the first time. A timer in event
time evicts what no later transaction can look back to, also for customers of whom nothing more comes. A micro-batch reads
and writes a customer's state once, however many rows it brings; it holds that customer's rows of the batch and 30 days, so
`files_per_batch` of the source bounds a hot customer.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ledgerlens.functions.clock import as_wall_clock
from ledgerlens.functions.timeline import DAY
from ledgerlens.operators.history import haversine_km, transaction_vector

WINDOW = 30 * DAY
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Numbers of a transaction that windows need, as one packed matrix: time, id, amount (both in millionths), failures.
_PACKED = ["micro", "transaction_id", "micros", "failures"]
_PAST = (
    "transaction_count_30d long, avg_amount_30d double, failed_attempts_24h long, unique_merchants_7d long,"
    " first_at long, prev_at long, prev_device string, prev_latitude double, prev_longitude double"
)


class CustomerHistory(StatefulProcessor):
    """Adds the past to each transaction of one customer."""

    def __init__(self, columns: list[str]):
        self.columns = columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "numbers binary, merchants array<string>")
        self.latest = handle.getValueState("latest", "micro long, id long, device string, latitude double, longitude double")
        self.first = handle.getValueState("first", "at long")

    def _read(self) -> tuple[np.ndarray, list]:
        if not self.window.exists():
            return np.zeros((0, len(_PACKED)), np.int64), []
        numbers, merchants = self.window.get()
        return np.frombuffer(numbers, np.int64).reshape(-1, len(_PACKED)), list(merchants)

    def _write(self, numbers: np.ndarray, merchants: list, watermark_ms: int) -> None:
        """What a transaction at the watermark or later can still look back to."""
        kept = np.flatnonzero(numbers[:, 0] // 1_000_000 >= watermark_ms // 1000 - WINDOW)
        if not len(kept):
            self.window.clear()
            return
        self.window.update((np.ascontiguousarray(numbers[kept]).tobytes(), [merchants[i] for i in kept]))
        if next(iter(self.handle.listTimers()), None) is None:
            oldest = int(numbers[kept[0], 0] // 1000) + WINDOW * 1000
            self.handle.registerTimer(max(oldest, watermark_ms) + 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values(["micro", "transaction_id"], kind="stable", ignore_index=True)
        old, old_merchants = self._read()
        numbers = np.concatenate([old, new[_PACKED].to_numpy(dtype=np.int64)])
        merchants = old_merchants + [None if pd.isna(m) else m for m in new["merchant"]]
        order = np.lexsort((numbers[:, 1], numbers[:, 0]))
        numbers, merchants = numbers[order], [merchants[i] for i in order]
        place = np.flatnonzero(order >= len(old))  # of the new ones, in their order
        at = numbers[:, 0] // 1_000_000
        now = at[place]
        until, since = np.searchsorted(at, now, "left"), {d: np.searchsorted(at, now - d * DAY, "left") for d in (1, 7, 30)}
        amounts, failed = (np.r_[0, np.cumsum(numbers[:, i])] for i in (2, 3))
        count = until - since[30]
        total = (amounts[until] - amounts[since[30]]) / 1e6
        first = min([int(at[0]), *([self.first.get()[0]] if self.first.exists() else [])])
        self.first.update((first,))
        out = new[self.columns].copy()
        out["transaction_count_30d"] = count
        out["avg_amount_30d"] = np.where(count > 0, total / np.maximum(count, 1), np.nan)
        out["failed_attempts_24h"] = failed[until] - failed[since[1]]
        out["unique_merchants_7d"] = _distinct_between(merchants, at, since[7], until, now)
        out["first_at"] = first
        before = self._before(new, numbers, order, len(old), place)
        for i, name in enumerate(["prev_at", "prev_device", "prev_latitude", "prev_longitude"]):
            out[name] = pd.Series([b[i] for b in before], dtype=object if i < 2 else float)
        self._write(numbers, merchants, timerValues.getCurrentWatermarkInMs())
        yield out

    def _before(self, new: pd.DataFrame, numbers: np.ndarray, order: np.ndarray, n_old: int, place: np.ndarray) -> list[tuple]:
        """(second, device, latitude, longitude) of the transaction before each new one; places are kept of the latest only."""
        known = self.latest.get() if self.latest.exists() else None
        own = [(int(m), int(i), d if isinstance(d, str) else None, la, lo) for m, i, d, la, lo in zip(
            new["micro"], new["transaction_id"], new["place"], new["latitude"], new["longitude"], strict=True)]
        out = []
        for k, p in enumerate(place):
            at_hand = [own[k - 1]] if k else []
            if known is not None and (known[0], known[1]) < own[k][:2]:
                at_hand.append(known)
            found = max(at_hand, key=lambda r: (r[0], r[1]), default=None)
            if p and (found is None or (found[0], found[1]) < (numbers[p - 1, 0], numbers[p - 1, 1])):
                found = (int(numbers[p - 1, 0]), int(numbers[p - 1, 1]), None, None, None)  # late: behind the latest
            out.append((None, None, None, None) if found is None else (found[0] // 1_000_000, *found[2:]))
        last = max([own[-1], *([tuple(known)] if known is not None else [])], key=lambda r: (r[0], r[1]))
        self.latest.update(tuple(None if isinstance(v, float) and v != v else v for v in last))
        return out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        numbers, merchants = self._read()
        self._write(numbers, merchants, timerValues.getCurrentWatermarkInMs())
        return iter([])

    def close(self) -> None:
        pass


def _distinct_between(merchants: list, at: np.ndarray, low: np.ndarray, high: np.ndarray, now: np.ndarray) -> np.ndarray:
    """Distinct merchants at positions [low, high): those not followed by the same merchant before `now`."""
    following, seen = np.full(len(at), np.iinfo(np.int64).max), {}
    for i in range(len(at) - 1, -1, -1):
        if merchants[i] is not None:
            following[i] = seen.get(merchants[i], following[i])
            seen[merchants[i]] = i
    named = np.array([m is not None for m in merchants], dtype=bool)
    return np.array([np.count_nonzero(named[a:b] & (following[a:b] >= b)) for a, b in zip(low, high, strict=True)], np.int64)


def scored_history(transactions: DataFrame, late: str = "1 day") -> DataFrame:
    """A stream of transactions (`ts` an instant) with the history columns of each; see `with_history`.

    Rows without customer or time have no history and are left out.
    """
    columns = transactions.columns
    amount = F.coalesce(F.col("amount").try_cast("decimal(28,6)"), F.lit(0).cast("decimal(28,6)"))
    known = transactions.filter(F.col("customer").isNotNull() & F.col("ts").isNotNull()).withWatermark("ts", late)
    ready = known.select(
        *columns,
        F.unix_micros("ts").alias("micro"),
        (amount * 1000000).cast("long").alias("micros"),
        F.coalesce(F.col("failed").cast("long"), F.lit(0).cast("long")).alias("failures"),
        F.col("device").cast("string").alias("place"),
    )
    kinds = dict(ready.dtypes)
    kept = [c for c in [*columns, "micro"] if c != "ts"]
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in kept), _PAST])
    found = ready.groupBy("customer").transformWithStateInPandas(CustomerHistory(kept), schema, "append", "EventTime")
    seconds = F.floor(F.col("micro") / 1000000)
    return found.select(
        *[as_wall_clock(F.timestamp_micros("micro")).alias("ts") if c == "ts" else F.col(c) for c in columns],
        "transaction_count_30d",
        F.when(F.isnan("avg_amount_30d"), None).otherwise(F.col("avg_amount_30d")).alias("avg_amount_30d"),
        "failed_attempts_24h",
        "unique_merchants_7d",
        (F.floor(seconds / DAY) - F.floor(F.col("first_at") / DAY)).cast("long").alias("customer_age_days"),
        ((seconds - F.col("prev_at")) / 60.0).alias("minutes_since_prev"),
        haversine_km(F.col("prev_latitude"), F.col("prev_longitude"), F.col("latitude"), F.col("longitude")).alias("distance_from_prev"),
        (F.col("prev_device") == F.col("device").cast("string")).alias("same_device"),
    )


def scored_vectors(transactions: DataFrame, late: str = "1 day") -> DataFrame:
    """The 15 features of each arriving transaction."""
    return transaction_vector(scored_history(transactions, late))


@contextlib.contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """State with timers needs the RocksDB store; the session's own setting comes back afterwards."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)
