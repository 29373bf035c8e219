"""Ordered scans over one range-partitioned timeline, in which one key may own a third of all rows.

Rows are range-partitioned by (key, time) and sorted, so a hot key, and a hot day of it, spread over as many partitions as
they need. A partition is streamed once with numpy; state is a few numbers and rows, whatever the partition holds. Only the
first key of a partition can have rows in partitions before it: what it lacks comes from carries, one row for the first and
one for the last key of each partition, and is added afterwards. So the carries are bounded by the number of partitions and
are broadcast.

Running sums are exact: measures are longs, and the sum before a row covers strictly smaller times of its key.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.session import written_table

DAY = 86400


def in_order(df: DataFrame, by: Sequence[str], then: Sequence[str] = ()) -> DataFrame:
    """Rows range-partitioned by `by` (equal values stay together), sorted by `by` and `then` in each partition."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(parts, *by).sortWithinPartitions(*by, *then)


def _changes(column: pa.Array, before: pa.Scalar | None) -> np.ndarray:
    """Where a value differs from the one before it; `before` is that of the row in front of the batch."""
    out = np.ones(len(column), dtype=bool)
    if before is not None:
        out[0] = not column[0].equals(before)
    if len(column) > 1:
        out[1:] = False
        for part in column.flatten() if pa.types.is_struct(column.type) else [column]:
            a, b = part.slice(1), part.slice(0, len(part) - 1)
            differ = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b)))
            out[1:] |= differ.to_numpy(zero_copy_only=False)
    return out


@dataclass
class _Key:
    """The key that a scan is at: totals so far, the open run of equal times, and its latest items."""

    value: pa.Scalar
    first: bool
    total: np.ndarray
    run_at: int
    run_base: np.ndarray
    items: pa.Array
    first_at: int | None


def _scan(measures: int, depth: int, names: list[str]):
    """Rows (key, at, row, item, measures...) in order; a row without `row` only adds its measures.

    Out: part, first, carry, key, row, previous items, first time of the key, sums before the row. A carry row tells a
    key's items, first time and totals in this partition.
    """

    def emitted(columns: list, n: int) -> pa.RecordBatch:
        arrays = [c if isinstance(c, pa.Array) else pa.array(c) for c in columns]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    def carried(key: _Key, part: int, row_type: pa.DataType) -> pa.RecordBatch:
        items = pa.ListArray.from_arrays(pa.array([0, len(key.items)], pa.int32()), key.items)
        columns = [
            pa.array([part], pa.int32()), pa.array([key.first]), pa.array([True]), pa.array([key.value.as_py()], key.value.type),
            pa.nulls(1, row_type), items, pa.array([key.first_at], pa.int64()),
        ]
        return emitted([*columns, *(pa.array([int(t)], pa.int64()) for t in key.total)], 1)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, key = TaskContext.get().partitionId(), None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys, row, item = batch.column(0), batch.column(2), batch.column(3)
            at = np.asarray(batch.column(1))
            change = _changes(keys, key.value if key else None)
            begin = np.flatnonzero(change)
            segment = np.cumsum(change)  # 0: the key of the batch before goes on
            own_first = 1 if key is None else 0 if key.first else -1
            sums = np.zeros((n + 1, measures), np.int64)
            for m in range(measures):
                np.cumsum(np.asarray(batch.column(4 + m)), out=sums[1:, m])
            bases = np.concatenate([[sums[0] - key.total if key else sums[0]], sums[begin]])
            run_change = change.copy()
            run_change[1:] |= at[1:] != at[:-1]
            run_change[0] |= key is None or at[0] != key.run_at
            run_begin = np.flatnonzero(run_change)
            run_base = np.concatenate([[key.run_base if key else sums[0]], sums[run_begin] - bases[segment[run_begin]]])
            value = run_base[np.cumsum(run_change)]

            told = np.flatnonzero(np.asarray(row.is_valid()))
            told_segment = segment[told]
            first_at = np.full(segment[-1] + 1, np.iinfo(np.int64).max)
            if key and key.first_at is not None:
                first_at[0] = key.first_at
            np.minimum.at(first_at, told_segment, at[told])

            # items before each told row: those of its key in this batch, in front of them what the key brought along
            held = key.items if key else item.slice(0, 0)
            pool = pa.concat_arrays([held, item.take(pa.array(told))])
            place = np.arange(len(told)) + len(held)
            floor = np.searchsorted(told_segment, told_segment, "left") + np.where(told_segment == 0, 0, len(held))
            if depth and len(told):
                low = np.maximum(place - depth, floor)
                counts = place - low
                index = np.repeat(low - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
                offsets = pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32))
                previous = pa.ListArray.from_arrays(offsets, pool.take(pa.array(index)))
            else:
                previous = pa.ListArray.from_arrays(pa.array(np.zeros(len(told) + 1, np.int32)), pool.slice(0, 0))
            if len(told):
                columns = [
                    np.full(len(told), part, np.int32), told_segment == own_first, np.zeros(len(told), bool),
                    keys.take(pa.array(told)), row.take(pa.array(told)), previous, first_at[told_segment],
                ]
                yield emitted([*columns, *(np.ascontiguousarray(value[told, m]) for m in range(measures))], len(told))

            def key_at(s: int, end: int, last=(keys, at, segment, sums, bases, value, told_segment, first_at, held, pool, own_first)):
                """The key of segment `s`, which this batch has up to row `end`."""
                keys, at, segment, sums, bases, value, told_segment, first_at, held, pool, own_first = last
                mine = np.flatnonzero(told_segment == s)[-depth:] if depth else np.zeros(0, int)
                items = pool.take(pa.array(mine + len(held)))
                if s == 0:
                    items = pa.concat_arrays([held, items])
                seen = int(first_at[s])
                return _Key(
                    keys[end - 1], s == own_first, sums[end] - bases[s], int(at[end - 1]), value[end - 1],
                    items.slice(max(0, len(items) - depth)), None if seen == np.iinfo(np.int64).max else seen,
                )

            if own_first >= 0 and segment[-1] > own_first:  # the partition's first key ends here
                end = int(begin[own_first]) if own_first == 0 else int(begin[1])
                yield carried(key_at(own_first, end) if end else key, part, row.type)
            key = key_at(int(segment[-1]), n)
        if key is not None:
            yield carried(key, part, row.type)

    return rows


def scan_timeline(
    df: DataFrame, key: str, at: str, then: Sequence[str], row: Column, item: Column | None = None, depth: int = 0,
    measures: Sequence[str] = (), only: Column | None = None,
) -> DataFrame:
    """(row, previous, first_at, measures): what stood before each row of `df` for which `only` holds (by default all).

    `previous` are the `depth` items before it (oldest first) in order of (`at`, `then`), `first_at` is the key's smallest
    time, and every measure (a long) is summed over the rows of the key with a strictly smaller time. Rows where `only`
    does not hold add their measures and nothing else. Rows without key or time have no place on the timeline: leave
    them out before.
    """
    told = F.lit(True) if only is None else only
    narrow = df.select(
        F.col(key).alias("_key"), F.col(at).cast("long").alias("_at"), F.when(told, row).alias("_row"),
        F.when(told, F.lit(None).cast("boolean") if item is None else item).alias("_item"),
        *[F.col(m).cast("long").alias(m) for m in measures], *[F.col(c).alias(f"_then_{i}") for i, c in enumerate(then)],
    )
    ordered = in_order(narrow, ["_key", "_at"], [f"_then_{i}" for i in range(len(then))])
    kinds = {f.name: f.dataType for f in narrow.schema.fields}
    fields = [
        ("_part", T.IntegerType()), ("_first", T.BooleanType()), ("_carry", T.BooleanType()), ("_key", kinds["_key"]),
        ("_row", kinds["_row"]), ("previous", T.ArrayType(kinds["_item"])), ("first_at", T.LongType()),
        *((m, T.LongType()) for m in measures),
    ]
    schema = T.StructType([T.StructField(n, t) for n, t in fields])
    scan = _scan(len(measures), depth, schema.names)
    scanned = written_table(ordered.select("_key", "_at", "_row", "_item", *measures).mapInArrow(scan, schema), "timeline")
    earlier = Window.partitionBy("_key").orderBy("_part")
    so_far = earlier.rowsBetween(Window.unboundedPreceding, -1)
    # the latest `depth` carries that have items: numbered by those before them
    has_items = F.when(F.size("previous") > 0, F.col("previous"))
    numbered = scanned.filter("_carry").withColumn("_before", F.count(has_items).over(so_far))
    latest = Window.partitionBy("_key").orderBy("_before").rangeBetween(-max(depth, 1), -1)
    brought = F.flatten(F.collect_list(has_items).over(latest))
    carries = numbered.select(
        "_part",
        "_first",
        F.min("first_at").over(so_far).alias("_first_at"),
        (F.slice(brought, F.greatest(F.size(brought) - depth + 1, F.lit(1)), depth) if depth else brought).alias("_brought"),
        *[F.coalesce(F.sum(m).over(so_far), F.lit(0)).alias(f"_{m}") for m in measures],
    )
    # at most one row for each partition
    rows = scanned.filter(~F.col("_carry")).join(F.broadcast(carries.filter("_first")), ["_part", "_first"], "left")
    joined = F.concat("_brought", "previous")
    whole = F.slice(joined, F.greatest(F.size(joined) - depth + 1, F.lit(1)), depth) if depth else F.col("previous")
    return rows.select(
        F.col("_row").alias("row"),
        F.when(F.col("_brought").isNull(), F.col("previous")).otherwise(whole).alias("previous"),
        F.least("first_at", "_first_at").alias("first_at"),
        *[(F.col(m) + F.coalesce(f"_{m}", F.lit(0))).alias(m) for m in measures],
    )


def _spells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (group, at) become distinct ones with the next time of the group; `open`: the partition ends before it."""
    part, group, time, first = TaskContext.get().partitionId(), None, None, True
    names = ["part", "edge", "group", "at", "next_at"]

    def rows(groups: pa.Array, at, following, edge: str) -> pa.RecordBatch:
        n = len(groups)
        columns = [pa.array([part] * n, pa.int32()), pa.array([edge] * n, pa.string()), groups, pa.array(at, pa.int64()), pa.array(following, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=names)

    for batch in batches:
        if not batch.num_rows:
            continue
        groups, at = batch.column(0), np.asarray(batch.column(1))
        if first:
            yield rows(groups.slice(0, 1), at[:1], [None], "first")
            first = False
        change = _changes(groups, group)
        new = change.copy()
        new[1:] |= at[1:] != at[:-1]
        new[0] |= time is None or at[0] != time
        starts = np.flatnonzero(new)
        if not len(starts):
            continue
        if group is not None:  # the row that waited: its follower is here
            yield rows(pa.array([group.as_py()], groups.type), [time], [None if change[starts[0]] else int(at[starts[0]])], "in")
        same = ~change[starts[1:]]
        following = pa.array(at[starts[1:]], pa.int64(), mask=~same)
        yield rows(groups.take(pa.array(starts[:-1])), at[starts[:-1]], following, "in")
        group, time = groups[int(starts[-1])], int(at[starts[-1]])
    if group is not None:
        yield rows(pa.array([group.as_py()], group.type), [time], [None], "open")


def following_times(df: DataFrame, group: Column, at: str) -> DataFrame:
    """Distinct (group, at) with `next_at`, the next larger time of the same group (null for its last)."""
    narrow = df.select(group.alias("group"), F.col(at).cast("long").alias("at"))
    schema = T.StructType(
        [T.StructField("part", T.IntegerType()), T.StructField("edge", T.StringType()), *narrow.schema.fields, T.StructField("next_at", T.LongType())]
    )
    scanned = written_table(in_order(narrow, ["group", "at"]).mapInArrow(_spells, schema), "spells")
    # a partition's open row is followed by the first row of the next partition that has any: two rows a partition
    edges = scanned.filter("edge <> 'in'").select("part", "edge", "group", "at")
    order = Window.partitionBy(F.lit(0)).orderBy("part", F.when(F.col("edge") == "first", 0).otherwise(1))
    after = edges.withColumns({"_group": F.lead("group").over(order), "_at": F.lead("at").over(order)})
    after = after.filter((F.col("edge") == "open") & F.col("group").eqNullSafe(F.col("_group")))
    late = F.broadcast(after.select("part", "edge", F.col("_at").alias("late")))
    return (
        scanned.filter("edge <> 'first'")
        .join(late, ["part", "edge"], "left")
        .select("group", "at", F.coalesce("next_at", "late").alias("next_at"))
    )
