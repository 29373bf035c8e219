"""MinHash near-duplicates by an LSH forest.

Every document has TREES * DEPTH min-hashes of its 5-word shingles. A tree orders the documents by its DEPTH values;
neighbours in that order that share a prefix of at least LEAST values are candidates, and the prefix is as long as
the region is dense (up to DEPTH). Candidates are confirmed on the full shingle sets, and confirmed links are joined
to components.

Steps, each written to the shared folder:

1. signatures (one pass over the texts); documents with equal shingle sets collapse to their smallest id;
2. every tree is range-partitioned by (tree, values, id) and sorted, so a large group is spread over partitions;
   neighbours with a long enough common prefix are candidates (also across the partition border);
3. every document confirms its likeliest candidate, and components are formed;
4. regions that still hold two components compare the signatures of all their members across components. A region
   is a prefix of LEAST values, of any size: where more than REGION documents share it they meet in blocks. So the neighbour
   lists are no cap: what they left out is compared here;
5. what the likely pairs between components, of step 2 and of step 4, connect is a cluster; step 4 hands on a spanning forest
   of them, never all. The texts of a cluster meet in blocks, where sketches rule pairs out and full sets confirm.

A pair is dropped without its texts being read only if fewer than FLOOR of the min-hashes agree, four standard
deviations below the threshold. A pair of similarity 0.85 shares a prefix of 4 in one tree with probability 0.52 and
in none of 16 trees with 8e-6, however many other documents share the prefix. A dense region costs the square of its
members, those of its largest component among themselves excepted.

Edge cases: null, empty or blank texts have no shingles and stay alone; fewer than 5 words are one shingle; equal
rows fall together; documents with a null id are left out; rows with one id are one document, their sets joined by
the first in order of the set's hash; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ledgerlens.llm import common as C
from ledgerlens.operators.graph import connected_components

TREES = 16
DEPTH = 8
LEAST = 4
#: Members of a region that are compared as one group; a denser one is cut into blocks.
REGION = 512
#: Shingles of one block when a cluster's texts are compared.
BLOCK = 400_000
SKETCH_BITS = 12
SHINGLE = 5
#: The contract's threshold: 100 * intersection >= 85 * union.
PERCENT = 85
#: Four standard deviations of a mean of 128 agreements below 0.85.
FLOOR = 0.72

_SEEDS = np.random.default_rng(20240229).integers(1, 1 << 63, size=TREES * DEPTH, dtype=np.uint64) | np.uint64(1)
_HASHED = 1 << 15


def signature(shingles: np.ndarray) -> np.ndarray:
    """The min-hash of every seed, cut to 16 bits; ordered as big-endian bytes sort."""
    best = np.full(len(_SEEDS), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), _HASHED):
        part = shingles[at : at + _HASHED]
        for j, seed in enumerate(_SEEDS):
            best[j] = min(best[j], (part * seed ^ (part * seed >> np.uint64(32))).min())
    return (C.mix(best) >> np.uint64(48)).astype(">u2")


def signatures_of(sets: list[np.ndarray]) -> np.ndarray:
    """Signatures of many sets at once: one vector pass per seed over all their shingles."""
    filled = [i for i, s in enumerate(sets) if len(s)]
    out = np.zeros((len(sets), len(_SEEDS)), dtype=">u2")
    if not filled:
        return out
    flat = np.concatenate([sets[i] for i in filled])
    lengths = np.array([len(sets[i]) for i in filled])
    starts = np.cumsum(lengths) - lengths
    best = np.empty((len(filled), len(_SEEDS)), dtype=np.uint64)
    for j, seed in enumerate(_SEEDS):
        product = flat * seed
        product ^= product >> np.uint64(32)
        best[:, j] = np.minimum.reduceat(product, starts)
    out[filled] = (C.mix(best) >> np.uint64(48)).astype(">u2")
    return out


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = C.text_bytes(batch.column(1))
        for a, b in C.slices(offsets, C.SLICE_BYTES // 2):
            sets = C.shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], SHINGLE)
            signed = signatures_of(sets)
            keys = np.zeros((2, b - a), dtype=np.int64)
            for i, s in enumerate(sets):
                if len(s):
                    both = C.mix(s), C.mix(s ^ np.uint64(0x5851F42D4C957F2D))
                    keys[:, i] = [int(x.sum(dtype=np.uint64).astype(np.int64)) for x in both]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(a, b - a),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(keys[0]),
                    pa.array(keys[1]),
                    pa.array([row.tobytes() for row in signed], pa.binary()),
                ],
                names=["doc_id", "n", "k1", "k2", "sig"],
            )
    C.give_back()


SIGNED = "doc_id long, n long, k1 long, k2 long, sig binary"


def signed_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, size of the shingle set, a 128-bit hash of the set, and the signature."""
    C.small_batches(docs.sparkSession)
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return slim.filter(F.col("doc_id").isNotNull()).mapInArrow(_sign, SIGNED)


def _common(a: bytes, b: bytes) -> int:
    n = 0
    while n < len(a) and a[n : n + 2] == b[n : n + 2]:
        n += 2
    return n // 2


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of rows that follow each other in a sorted tree; the partition's first and last row go out as markers."""
    last = None
    for batch in batches:
        tree, key, ids = (batch.column(i).to_pylist() for i in range(3))
        part = batch.column(3)
        pairs = []
        for row in zip(tree, key, ids, strict=True):
            if last is None:
                pairs.append((None, None, row[0], row[1], row[2], True))
            elif last[0] == row[0] and _common(last[1], row[1]) >= LEAST:
                pairs.append((min(last[2], row[2]), max(last[2], row[2]), None, None, None, None))
            last = row
        where = part[0].as_py() if len(part) else 0
        yield _pair_batch(pairs, where)
        end = where
    if last is not None:
        yield _pair_batch([(None, None, last[0], last[1], last[2], False)], end)


def _pair_batch(rows: list[tuple], part: int) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.bool_()]
    cols = [pa.array([r[j] for r in rows], kinds[j]) for j in range(6)]
    return pa.RecordBatch.from_arrays(
        [*cols, pa.array([part] * len(rows), pa.int32())], names=["a", "b", "tree", "key", "id", "first", "part"]
    )


def tree_rows(reps: DataFrame) -> DataFrame:
    """(tree, key, id): the DEPTH values of every tree as sortable bytes."""
    keys = [
        F.struct(F.lit(t).cast("int").alias("tree"), F.substring("sig", 1 + t * DEPTH * 2, DEPTH * 2).alias("key"))
        for t in range(TREES)
    ]
    return reps.select("id", F.explode(F.array(*keys)).alias("t")).select("t.tree", "t.key", "id")


def neighbour_pairs(trees: DataFrame, scratch: C.Scratch) -> DataFrame:
    """Distinct candidate pairs (a < b) of neighbours in any tree."""
    parts = int(trees.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = trees.repartitionByRange(parts, "tree", "key", "id").sortWithinPartitions("tree", "key", "id")
    found = scratch.write(
        ranged.select("tree", "key", "id", F.spark_partition_id().alias("part")).mapInArrow(
            _neighbours, "a long, b long, tree int, key binary, id long, first boolean, part int"
        ),
        "neighbours",
    )
    # one or two marker rows per partition: the last of one meets the first of the next
    marks = found.filter("id is not null")
    step = W.orderBy("part", F.col("first").desc())
    edge = marks.select(
        "tree", "key", "id", "first",
        F.lag("tree").over(step).alias("t0"), F.lag("key").over(step).alias("k0"), F.lag("id").over(step).alias("i0"),
    ).filter(F.col("first") & (F.col("tree") == F.col("t0")) & (F.substring("key", 1, LEAST * 2) == F.substring("k0", 1, LEAST * 2)))
    border = edge.select(F.least("id", "i0").alias("a"), F.greatest("id", "i0").alias("b"))
    return found.filter("a is not null").select("a", "b").unionByName(border).filter("a < b").distinct()


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keeps pairs whose sizes and signatures allow the similarity; adds the share of agreeing min-hashes."""
    width = TREES * DEPTH
    for batch in batches:
        if not batch.num_rows:
            continue
        x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), ">u2").reshape(-1, width) for i in (4, 5))
        n, m = (batch.column(i).to_numpy() for i in (2, 3))
        share = (x == y).mean(axis=1)
        good = (share >= FLOOR) & (100 * np.minimum(n, m) >= PERCENT * np.maximum(n, m))
        at = pa.array(np.flatnonzero(good))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(at), batch.column(1).take(at), pa.array(share[good])], names=["a", "b", "share"]
        )


def likely_pairs(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """(a, b, share) of the pairs that may reach the threshold."""
    left = reps.select(F.col("id").alias("a"), F.col("n").alias("n"), F.col("sig").alias("x"))
    right = reps.select(F.col("id").alias("b"), F.col("n").alias("m"), F.col("sig").alias("y"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "n", "m", "x", "y")
    return both.mapInArrow(_likely, "a long, b long, share double")


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact similarity of full shingle sets: (a, b) of the pairs that reach the threshold."""
    known: tuple[int, np.ndarray] | None = None
    for batch in batches:
        ids = [batch.column(i).to_numpy() for i in range(2)]
        sides = [C.text_bytes(batch.column(i)) for i in (2, 3)]
        good = []
        for i in range(batch.num_rows):
            sets = []
            for side, (data, offsets) in enumerate(sides):
                if side == 0 and known is not None and known[0] == ids[0][i]:
                    sets.append(known[1])
                    continue
                one = data[offsets[i] : offsets[i + 1]]
                sets.append(C.shingle_sets(one, np.array([0, len(one)]), SHINGLE)[0])
            known = (ids[0][i], sets[0])
            shared = len(np.intersect1d(*sets, assume_unique=True))
            if 100 * shared >= PERCENT * (len(sets[0]) + len(sets[1]) - shared) and shared:
                good.append(i)
        at = pa.array(good, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], names=["a", "b"])


def confirmed_pairs(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose full sets reach the threshold; `texts` has id, text."""
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("x"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("y"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return both.mapInArrow(_confirm, "a long, b long")


def _components(edges: DataFrame) -> DataFrame:
    return connected_components(edges.select(F.col("a").alias("source"), F.col("b").alias("target")))


def _with_components(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components so far, with these components."""
    for end in ("a", "b"):
        side = members.select(F.col("id").alias(end), F.col("component").alias(f"_{end}"))
        pairs = pairs.join(side, end, "left").withColumn(f"c{end}", F.coalesce(f"_{end}", end)).drop(f"_{end}")
    return pairs.filter("ca != cb")


def region_rows(trees: DataFrame, members: DataFrame, scratch: C.Scratch) -> DataFrame:
    """(group, id, component, side): the members of every region that holds two components.

    A region of up to REGION members is one group. A larger one is cut into blocks, and every pair of blocks is a group,
    where only members of different blocks meet (`side`). Members of its largest component have blocks of
    their own, which do not meet each other.
    """
    named = trees.join(members, "id", "left").select(
        "tree", F.substring("key", 1, LEAST * 2).alias("region"), "id", F.coalesce("component", "id").alias("component")
    )
    place = ["tree", "region"]
    sizes = named.groupBy(*place).agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("c0"), F.max("component").alias("c1"))
    sizes = scratch.write(sizes.filter("c0 < c1").select(*place, "n"), "regions")
    group = lambda low, high: F.xxhash64(*place, low, high).alias("group")
    small = named.join(sizes.filter(F.col("n") <= REGION), place).select(
        group(F.lit(0), F.lit(0)), "id", "component", F.lit(-1).alias("side")
    )
    dense = named.join(sizes.filter(F.col("n") > REGION), place)
    held = dense.groupBy(*place, "component").agg(F.count(F.lit(1)).alias("c")).groupBy(*place).agg(
        F.max(F.struct("c", "component")).alias("most"), F.sum("c").alias("n")
    )
    blocks = lambda n: F.ceil(n / REGION).cast("int")
    held = scratch.write(
        held.select(*place, F.col("most.component").alias("main"), blocks(F.col("most.c")).alias("inner"), blocks(F.col("n") - F.col("most.c")).alias("outer")),
        "dense",
    )
    main = F.col("component") == F.col("main")
    own = F.when(main, F.pmod(F.xxhash64("id"), "inner")).otherwise(F.col("inner") + F.pmod(F.xxhash64("id"), "outer")).cast("int")
    first = F.when(main, F.col("inner")).otherwise(0)
    dealt = dense.join(held, place).select(
        *place, "id", "component", own.alias("own"), F.explode(F.sequence(first, F.col("inner") + F.col("outer") - 1)).alias("other")
    )
    low, high = F.least("own", "other"), F.greatest("own", "other")
    side = F.when(low == high, -1).otherwise(F.col("own"))
    return small.unionByName(dealt.select(group(low, high), "id", "component", side.alias("side")))


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of the likely pairs between components inside each group."""
    width = TREES * DEPTH
    for table in C.whole_groups(batches, "group", 4096):
        group, ids, comp, side, n = (np.array(table.column(c)) for c in ("group", "id", "component", "side", "n"))
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), ">u2").reshape(-1, width).astype(np.uint16)
        forest = C.Forest()
        for i, j in C.pairs_within(C.group_sizes(group), 1 << 15):
            ok = (comp[i] != comp[j]) & ((side[i] != side[j]) | (side[i] < 0))
            ok &= 100 * np.minimum(n[i], n[j]) >= PERCENT * np.maximum(n[i], n[j])
            i, j = i[ok], j[ok]
            ok = (sig[i] == sig[j]).mean(axis=1) >= FLOOR
            for x, y in zip(ids[i[ok]].tolist(), ids[j[ok]].tolist(), strict=True):
                forest.join(x, y)
        yield _edge_batch(forest.links)


def _edge_batch(links: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k[i] for k in links], pa.int64()) for i in (0, 1)], names=["a", "b"])


def region_edges(trees: DataFrame, members: DataFrame, reps: DataFrame, scratch: C.Scratch) -> DataFrame:
    """Edges (a, b) that connect all likely pairs of different components which share a region of a tree."""
    rows = region_rows(trees, members, scratch).join(reps, "id")
    parts = int(trees.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select("group", "id", "component", "side", "n", "sig").repartition(parts, "group").sortWithinPartitions("group")
    return dealt.mapInArrow(_compare, "a long, b long").distinct()


def odd_sketch(shingles: np.ndarray) -> np.ndarray:
    """Bits that an odd number of shingles hash to: two sketches never differ in more bits than the sets differ in shingles."""
    bins = np.bincount((C.mix(shingles) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=1 << SKETCH_BITS) & 1
    return np.packbits(bins.astype(np.uint8)).view(np.uint64)


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links that join the components of a group of texts wherever two of its documents reach the threshold.

    The sketches rule out, without error, nearly all pairs below the threshold; the rest is compared on the full sets
    unless other links have joined the two by then.
    """
    for table in C.whole_groups(batches, "group", 1):
        links: list[tuple[int, int]] = []
        at = 0
        for size in C.group_sizes(np.array(table.column("group"))):
            part = table.slice(at, size).combine_chunks()
            at += size
            ids, comp, side = (np.array(part.column(c)) for c in ("id", "component", "side"))
            data, offsets = C.text_bytes(part.column("text"))
            sets: list[np.ndarray] = []
            for x, y in C.slices(offsets):
                sets += C.shingle_sets(data[offsets[x] : offsets[y]], offsets[x : y + 1] - offsets[x], SHINGLE)
            n = np.array([len(s) for s in sets])
            sketch = np.stack([odd_sketch(s) for s in sets])
            forest, root = C.Forest(), comp.copy()
            for i, j in C.pairs_within(np.array([size]), 1 << 14):
                # differing shingles d = |x| + |y| - 2 shared; the threshold allows (100 - PERCENT) / (100 + PERCENT) of the sum
                ok = (root[i] != root[j]) & ((side[i] != side[j]) | (side[i] < 0))
                i, j = i[ok], j[ok]
                differ = np.bitwise_count(sketch[i] ^ sketch[j]).sum(axis=1, dtype=np.int64)
                ok = (100 + PERCENT) * np.maximum(differ, np.abs(n[i] - n[j])) <= (100 - PERCENT) * (n[i] + n[j])
                i, j, differ = i[ok], j[ok], differ[ok]
                before = len(forest.links)
                for k in np.argsort(differ, kind="stable").tolist():
                    x, y = int(i[k]), int(j[k])
                    if forest.root(int(comp[x])) == forest.root(int(comp[y])):
                        continue
                    shared = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                    if 100 * shared >= PERCENT * (n[x] + n[y] - shared):
                        forest.join(int(comp[x]), int(comp[y]))
                        links.append((int(ids[x]), int(ids[y])))
                if len(forest.links) > before:
                    root = np.array([forest.root(int(c)) for c in comp])
        yield _edge_batch(links)


def settled_links(edges: DataFrame, members: DataFrame, reps: DataFrame, texts: DataFrame, scratch: C.Scratch) -> DataFrame:
    """Links (a, b) that join all components which hold documents that reach the threshold and that edges connect.

    What edges connect is a cluster. Its documents are dealt to blocks of about BLOCK shingles, and every pair of blocks is
    one group, where all pairs are compared; so a text is sent once per block of its cluster, never once per pair.
    """
    clusters = _components(edges)
    placed = clusters.join(reps.select("id", "n"), "id").join(members.withColumnRenamed("component", "c"), "id", "left")
    placed = scratch.write(placed.select("id", F.coalesce("c", "id").alias("component"), F.col("component").alias("cluster"), "n"), "placed")
    sizes = placed.groupBy("cluster").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    dealt = placed.join(sizes, "cluster").select(
        "id", "component", "cluster", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    )
    low, high = F.least("own", "other"), F.greatest("own", "other")
    dealt = dealt.select(
        "id", "component", F.xxhash64("cluster", low, high).alias("group"), F.when(low == high, -1).otherwise(F.col("own")).alias("side")
    )
    wanted = texts.join(placed.select("id"), "id", "left_semi").dropDuplicates(["id"])
    rows = dealt.join(wanted, "id").select("group", "id", "component", "side", "text")
    n = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "group").sortWithinPartitions("group").mapInArrow(_settle, "a long, b long")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept."""
    spark = docs.sparkSession
    scratch = C.Scratch(spark, "forest")
    signed = scratch.write(signed_documents(docs, text, doc_id), "signed")
    classes = scratch.write(signed.filter("n > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("id")), "classes")
    reps = scratch.write(
        signed.filter("n > 0").join(classes, ["k1", "k2"]).filter("doc_id = id").select("id", "n", "sig").dropDuplicates(["id"]),
        "reps",
    )
    trees = tree_rows(reps)
    likely = scratch.write(likely_pairs(neighbour_pairs(trees, scratch), reps), "likely")
    named = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    named = named.filter("id is not null")

    both = likely.select(F.col("a").alias("x"), F.col("b").alias("y"), "share").unionByName(
        likely.select(F.col("b").alias("x"), F.col("a").alias("y"), "share")
    )
    # the likeliest partner of every document: a maximum per document, combined before the shuffle
    best = both.groupBy("x").agg(F.max(F.struct("share", (-F.col("y")).alias("y"))).alias("m"))
    first = best.select(F.least("x", -F.col("m.y")).alias("a"), F.greatest("x", -F.col("m.y")).alias("b")).distinct()
    first = scratch.write(first, "first")
    wanted = first.select(F.col("a").alias("id")).unionByName(first.select(F.col("b").alias("id"))).distinct()
    links = scratch.write(confirmed_pairs(first, named.join(wanted, "id", "left_semi")), "links")
    members = scratch.write(_components(links), "members")

    far = region_edges(trees, members, reps, scratch)
    near = _with_components(likely, members).select("a", "b").join(first, ["a", "b"], "left_anti")
    edges = scratch.write(far.unionByName(near).distinct(), "edges")
    late = scratch.write(settled_links(edges, members, reps, named, scratch), "late")
    members = scratch.write(_components(links.unionByName(late)), "joined")
    scratch.drop("neighbours", "likely", "first", "links", "members", "edges", "placed", "late", "reps")

    classed = signed.select("doc_id", "n", "k1", "k2").join(classes, ["k1", "k2"], "left")
    joined = classed.join(members, "id", "left")
    component = F.coalesce("component", "id", "doc_id")
    return joined.select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("doc_id") == component).alias("kept")
    )
