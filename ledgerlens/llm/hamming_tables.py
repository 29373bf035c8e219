"""Embedding near-duplicates: binary codes by iterative quantisation, multi-index Hamming tables, exact rerank.

A rotation of the principal axes is learned on a bounded sample (the SAMPLE vectors of smallest id hash) so that the
signs of the rotated coordinates lose little and are balanced. Every vector gets a code of one bit per axis, at most
64. The code is cut into TABLES parts; two vectors meet in a table if their parts differ in at most two bits, because
each is entered under its own part and under every part one bit away. A pair of codes at distance 11 or less therefore
always meets, once: in the first table of the pair and there under one key. The tables hold codes. Pairs whose codes
differ in more than FAR bits are left out; where others are left, the original vectors of their entries are fetched and compared by cosine in double precision.

Pairs beyond 11 bits meet in most cases only. Simulated pairs at a cosine of 0.935 in 64 dimensions meet in 99.7 to 100 %,
whatever share of the squared norm a common component has (0, 0.25, 0.5, 0.7, 0.9). Vectors with a large common component
have codes that are alike, so more of them are compared.

Equal vectors collapse to one entry with a weight first. Keys of more than BLOCK entries are cut into blocks, and every
pair of blocks is a task of its own, so no key has to fit into one task. A task sends counts by vector and a spanning
forest of its links, never the pairs.

Edge cases: vectors that are null, empty, zero, of another length than the first valid one, or hold null or non-finite
components link with nothing, nor do vectors without a label; equal ids are one vector, the smallest by content
standing for it; a null id is left out; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm import common as C
from ledgerlens.operators.graph import connected_components

SAMPLE = 20_000
ITERATIONS = 50
TABLES = 4
BLOCK = 1024
FAR = 20
#: The contract's threshold.
COSINE = 0.93
#: Pairs compared at a time in a task.
PAIRS = 1 << 18


def learn_rotation(sample: np.ndarray, iterations: int = ITERATIONS) -> np.ndarray:
    """Principal axes around the origin, turned so that coordinates are close to their signs (Gong and Lazebnik).

    No mean is subtracted: the cosine is one of the vectors as they are, and so are the signs.
    """
    _, _, axes = np.linalg.svd(sample.T @ sample / len(sample))
    axes = axes[: min(64, sample.shape[1])].T
    reduced = sample @ axes
    turn, _ = np.linalg.qr(np.random.default_rng(7).standard_normal((axes.shape[1], axes.shape[1])))
    for _ in range(iterations):
        left, _, right = np.linalg.svd(np.where(reduced @ turn >= 0, 1.0, -1.0).T @ reduced)
        turn = (left @ right).T
    return axes @ turn


def codes_of(vectors: np.ndarray, projection: np.ndarray) -> np.ndarray:
    bits = vectors @ projection >= 0
    weights = np.uint64(1) << np.arange(projection.shape[1], dtype=np.uint64)
    return (bits * weights).sum(axis=1, dtype=np.uint64)


def parts_of(codes: np.ndarray, bits: int, tables: int = TABLES) -> np.ndarray:
    """One column of part values per table."""
    edges = np.linspace(0, bits, tables + 1).astype(int)
    return np.stack(
        [(codes >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1) for a, b in zip(edges[:-1], edges[1:], strict=True)], axis=1
    ).astype(np.int64)


def valid_vectors(vectors: DataFrame, scratch: C.Scratch) -> tuple[DataFrame, DataFrame]:
    """(id of every row, classes of equal vectors with one label): the classes have id, weight, label, vec (binary floats)."""
    v = F.col("vec")
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("id"), F.col("label"), F.col("embedding").cast("array<double>").alias("vec")
    ).filter("id is not null")
    clean = (
        F.col("label").isNotNull() & (F.size(v) > 0)
        & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(v, lambda x: x != 0)
    )
    one = rows.groupBy("id").agg(F.min(F.struct("label", "vec")).alias("r")).select("id", "r.label", "r.vec")
    classes = one.filter(F.coalesce(clean, F.lit(False))).groupBy("label", "vec").agg(
        F.min("id").alias("id"), F.count(F.lit(1)).alias("weight")
    )
    return one, scratch.write(classes.select("id", "weight", "label", "vec"), "classes")


def _enter(projection: np.ndarray):
    bits = projection.shape[1]
    edges = np.linspace(0, bits, TABLES + 1).astype(int)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(3).to_pylist()
            fits = np.array([i for i, r in enumerate(rows) if len(r) == len(projection)], dtype=np.int64)
            if not len(fits):
                continue
            x = np.array([rows[i] for i in fits])
            x /= np.abs(x).max(axis=1, keepdims=True)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            codes = codes_of(x, projection)
            parts = parts_of(codes, bits)
            for t in range(TABLES):
                flips = np.r_[0, 1 << np.arange(edges[t + 1] - edges[t])]
                keys = (parts[:, t : t + 1] ^ flips[None, :]).ravel()
                who = np.repeat(np.arange(len(fits)), len(flips))
                at = pa.array(fits[who])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(2).take(at),
                        pa.array(np.full(len(who), t, np.int32)),
                        pa.array(keys),
                        batch.column(0).take(at),
                        batch.column(1).take(at),
                        pa.array(codes[who].view(np.int64)),
                    ],
                    names=["label", "tab", "key", "id", "weight", "code"],
                )

    return run


def _meeting(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The one key under which two parts at distance two or less count as meeting."""
    x = a ^ b
    low = x & -x
    high = x ^ low
    return np.where(high == 0, np.minimum(a, b), np.minimum(a ^ low, a ^ high))


def _meetings(table: pa.Table, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions i < j of the pairs that count as meeting in a group of the table, if their codes are near enough."""
    group, tab, key, side = (np.array(table.column(c)) for c in ("group", "tab", "key", "side"))
    codes = np.array(table.column("code")).view(np.uint64)
    parts = parts_of(codes, bits)
    for i, j in C.pairs_within(C.group_sizes(group), PAIRS):
        # in a pair of different blocks only rows of different blocks meet
        ok = (side[i] != side[j]) | (side[i] < 0)
        ok &= np.bitwise_count(codes[i] ^ codes[j]) <= FAR
        i, j = i[ok], j[ok]
        t = tab[i]
        near = np.bitwise_count(parts[i] ^ parts[j]) <= 2
        ok = (np.argmax(near, axis=1) == t) & near[np.arange(len(t)), t]
        i, j, t = i[ok], j[ok], t[ok]
        ok = _meeting(parts[i, t], parts[j, t]) == key[i]
        yield i[ok], j[ok]


def _retrieve(bits: int):
    """The entries that a near code meets in their group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in C.whole_groups(batches, "group", 16 * BLOCK):
            hit = np.zeros(table.num_rows, dtype=bool)
            for i, j in _meetings(table, bits):
                hit[i] = True
                hit[j] = True
            if hit.any():
                yield from table.filter(pa.array(hit)).combine_chunks().to_batches()

    return run


def _compare(bits: int, cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, int] = {}
        forest = C.Forest()
        for table in C.whole_groups(batches, "group", 16 * BLOCK):
            ids, weight = np.array(table.column("id")), np.array(table.column("weight"))
            unit = np.array(table.column("vec").to_pylist())
            unit /= np.abs(unit).max(axis=1, keepdims=True)
            unit /= np.linalg.norm(unit, axis=1, keepdims=True)
            for i, j in _meetings(table, bits):
                ok = np.einsum("ij,ij->i", unit[i], unit[j]) >= cosine
                for a, b, wa, wb in zip(ids[i[ok]].tolist(), ids[j[ok]].tolist(), weight[i[ok]].tolist(), weight[j[ok]].tolist(), strict=True):
                    counts[a] = counts.get(a, 0) + wb
                    counts[b] = counts.get(b, 0) + wa
                    forest.join(a, b)
        yield _links([(a, n, None, None) for a, n in counts.items()])
        yield _links([(None, None, a, b) for a, b in forest.links])

    return run


def _links(rows: list[tuple]) -> pa.RecordBatch:
    cols = [pa.array([r[i] for r in rows], pa.int64()) for i in range(4)]
    return pa.RecordBatch.from_arrays(cols, names=["id", "n", "a", "b"])


def near_vectors(vectors: DataFrame, cosine: float = COSINE, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """Per vector of (vec_id, embedding, label): vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    C.small_batches(spark)
    scratch = C.Scratch(spark, "hamming")
    rows, classes = valid_vectors(vectors, scratch)
    order = F.xxhash64(F.lit(3), "id")
    drawn = [r["vec"] for r in classes.select("vec", order.alias("h"), "id").orderBy("h", "id").limit(sample).collect()]
    if not drawn:
        none = F.lit(0).cast("long")
        return rows.select(F.col("id").alias("vec_id"), none.alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    x = np.array([r for r in drawn if len(r) == len(drawn[0])])
    x /= np.abs(x).max(axis=1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    projection = learn_rotation(x)
    label = classes.schema["label"].dataType.simpleString()
    entry = f"label {label}, tab int, key long, id long, weight long, code long"
    entries = classes.mapInArrow(_enter(projection), entry)
    # keys that one entry holds meet nothing; large keys are cut into blocks
    sizes = classes.mapInArrow(_enter(projection), entry).groupBy("label", "tab", "key").agg(
        F.count(F.lit(1)).alias("size")
    )
    sizes = scratch.write(sizes.filter("size > 1"), "sizes")
    parts = F.ceil(F.col("size") / block).cast("int")
    own = F.pmod(F.xxhash64("id"), parts).cast("int")
    hot = F.explode(F.sequence(F.lit(0), parts - 1))
    cold = entries.join(sizes.filter(F.col("size") <= block), ["label", "tab", "key"]).select(
        "label", "tab", "key", "id", "weight", "code", F.lit("").alias("blocks"), F.lit(-1).alias("side")
    )
    split = entries.join(sizes.filter(F.col("size") > block), ["label", "tab", "key"]).select("*", own.alias("own"), hot.alias("other"))
    dense = split.select(
        "label", "tab", "key", "id", "weight", "code",
        F.concat_ws("-", F.least("own", "other"), F.greatest("own", "other")).alias("blocks"),
        F.when(F.col("own") == F.col("other"), -1).otherwise(F.col("own")).alias("side"),
    )
    group = F.xxhash64("label", "tab", "key", "blocks")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = cold.unionByName(dense).withColumn("group", group).repartition(n, "group")
    columns = ["group", "tab", "key", "id", "weight", "code", "side"]
    bits = projection.shape[1]
    met = dealt.select(*columns).sortWithinPartitions("group").mapInArrow(
        _retrieve(bits), "group long, tab int, key long, id long, weight long, code long, side int"
    )
    met = scratch.write(met, "met").join(classes.select("id", "vec"), "id").select(*columns, "vec")
    compared = met.repartition(n, "group").sortWithinPartitions("group").mapInArrow(
        _compare(bits, cosine), "id long, n long, a long, b long"
    )
    found = scratch.write(compared, "found")
    edges = found.filter("a is not null").select(F.col("a").alias("source"), F.col("b").alias("target"))
    members = connected_components(edges)
    links = found.filter("id is not null").groupBy("id").agg(F.sum("n").alias("n"))
    # a row belongs to the class of its vector; the other rows of the class are linked with it as well
    same = rows.join(classes.select("label", "vec", F.col("id").alias("class"), "weight"), ["label", "vec"], "left")
    out = same.join(links.withColumnRenamed("id", "class"), "class", "left").join(
        members.withColumnRenamed("id", "class"), "class", "left"
    )
    component = F.coalesce("component", "class", "id")
    return out.select(
        F.col("id").alias("vec_id"),
        (F.coalesce("weight", F.lit(1)) - 1 + F.coalesce("n", F.lit(0))).cast("long").alias("n_links"),
        component.alias("component_id"),
        (F.col("id") == component).alias("kept"),
    )
