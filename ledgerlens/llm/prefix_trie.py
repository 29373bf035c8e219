"""Prefix trie of conversations, rolled up in depth bands.

1. A turn becomes a narrow row (conversation, order, 16-byte hash of role and text, code points); texts are not moved.
   Prefixes taken from other conversations are added as rows.
2. Conversations are streamed turn by turn. The hash of a node is chained from its parent's, so equal prefixes have equal
   hashes wherever they are. A turn's row carries the ancestors that the roll-up needs and nothing else: level 0 lists
   those down to the next depth below that is a multiple of `height`; a node at a multiple of height**l lists at level l
   its ancestors at such multiples, down to the next multiple of height**(l+1).
3. Rows are grouped into nodes, with partial sums before the shuffle: a first turn that all conversations share is one
   row per task.
4. Upwards: inside every band all nodes explode to their ancestors of that band at once and are summed. The band roots,
   `height` times fewer levels of them, are then the nodes of the next level, until one band holds all. Downwards: the
   totals of band roots, complete by then, explode to the band above them. A node explodes to `height` ancestors at most,
   and a trie of depth D takes 2 log(D) / log(height) rounds instead of D.
5. Ends of a node are streamed from rows sorted by (node, conversation): pieces of the list first, split wherever a range
   partition ends, then one digest over the pieces. A node where a third of all conversations end is spread so too.

Memory: a task holds a conversation's last `height` hashes per level, not its turns.

Edge cases: rows whose conversation is null belong to none and are left out; a null turn comes first; turns of one number
are ordered by the hash of role and text, equal rows count each; a null role or text is empty; a conversation of a single
turn or of none (after rebuilding) is a member of the root; an empty table has no nodes, so no root; further columns are
ignored whatever they are called; very long conversations and texts need no more memory.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ledgerlens.llm import common as C

#: Levels of a band.
HEIGHT = 32
#: Fixed by the contract: conversations that share an opening, and the modulus of the number of its turns.
FAMILY = 100
OPENINGS = 6
#: Conversation numbers in one piece of a list of ends.
PIECE = 4096

ROOT = b"\x00" * 16
STEPS = "conv_id long, depth int, node binary, chars long, ends long, up array<array<binary>>"


def turn_rows(conversations: DataFrame) -> DataFrame:
    """(conv_id, n, key, chars): turns numbered from 0 in their conversation."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    key = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    slim = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", key.alias("key"), F.length(text).cast("long").alias("chars")
    )
    order = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "key")
    return slim.select("conv_id", (F.row_number().over(order) - 1).alias("n"), "key", "chars")


def opening_turns(conv_id: Column) -> Column:
    """Turns that a conversation takes from the first of its family."""
    return (F.crc32(conv_id.cast("string")) % OPENINGS).cast("int")


def rebuilt_rows(turns: DataFrame) -> DataFrame:
    """(conv_id, part, n, key, chars) of the rebuilt conversations, in order of (part, n); part -1 is a row per conversation."""
    own = turns.filter(F.col("n") >= opening_turns(F.col("conv_id"))).select("conv_id", F.lit(1).alias("part"), "n", "key", "chars")
    every = turns.filter(F.col("n") == 0).select("conv_id")
    start = every.select(
        "conv_id", F.lit(-1).alias("part"), F.lit(0).alias("n"), F.lit(b"").alias("key"), F.lit(0).cast("long").alias("chars")
    )
    openings = (
        turns.filter((F.col("n") < OPENINGS - 1) & (F.col("conv_id") % FAMILY == 0))
        .groupBy(F.col("conv_id").alias("family"))
        .agg(F.sort_array(F.collect_list(F.struct("n", "key", "chars"))).alias("opening"))  # five at most
    )
    taken = (
        every.withColumn("family", F.col("conv_id") - F.col("conv_id") % FAMILY)
        .join(openings, "family")
        .select("conv_id", F.lit(0).alias("part"), F.inline(F.slice("opening", F.lit(1), opening_turns(F.col("conv_id")))))
    )
    return own.unionByName(start).unionByName(taken)


def _walk(height: int):
    """Rows of sorted conversations become steps down the trie."""

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, node, depth, levels = None, ROOT, 0, []
        waiting = None  # the last step: whether the conversation ends there shows with the next row

        def recorded(rows: list[list]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=names
            )

        names = ["conv_id", "depth", "node", "chars", "ends", "up"]
        kinds = [pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.list_(pa.binary()))]
        for batch in batches:
            out = []
            columns = (batch.column(i).to_pylist() for i in (0, 1, 3, 4))
            for c, part, key, chars in zip(*columns, strict=True):
                if part < 0:  # a new conversation: at the root
                    if waiting:
                        waiting[4] = 1
                        out.append(waiting)
                    conv, node, depth, levels = c, ROOT, 0, [deque([ROOT], height)]
                    waiting = [conv, 0, ROOT, 0, 0, []]
                    continue
                out.append(waiting)
                depth += 1
                node = hashlib.blake2b(node + key, digest_size=16).digest()
                up, at = [], depth
                for level in range(len(levels) + 1):
                    if level == len(levels):
                        levels.append(deque([ROOT], height))
                    above = levels[level]  # ends with the closest
                    n = (at - 1) % height + 1
                    up.append(list(above)[-n:][::-1])
                    above.append(node)
                    if at % height:
                        break
                    at //= height
                waiting = [conv, depth, node, chars, 0, up]
            if out:
                yield recorded(out)
        if waiting:
            waiting[4] = 1
            yield recorded([waiting])

    return steps


def trie_nodes(rebuilt: DataFrame, height: int) -> tuple[DataFrame, DataFrame]:
    """(steps, nodes): a row per conversation and depth; a row per node with its own figures."""
    spark = rebuilt.sparkSession
    scratch = C.Scratch(spark, "trie")
    ordered = rebuilt.repartition("conv_id").sortWithinPartitions("conv_id", "part", "n")
    steps = scratch.write(ordered.mapInArrow(_walk(height), STEPS), "steps")
    nodes = steps.groupBy("node").agg(
        F.min("conv_id").alias("conv_id"),
        F.count(F.lit(1)).alias("n_convs"),
        F.sum("ends").alias("n_ends"),
        F.first("depth").alias("depth"),  # depth, chars and ancestors follow from the node
        F.first("chars").alias("chars"),
        F.first("up").alias("up"),
    )
    return steps, scratch.write(nodes, "nodes")


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("node").agg(*[F.sum(c).alias(c) for c in ("leaves", "saved", "children")])


def band_rollup(nodes: DataFrame, height: int, scratch: C.Scratch) -> DataFrame:
    """(node, leaves, saved, children): sums over whole subtrees; `children` counts direct ones.

    `nodes`: node, depth, up, leaves and saved (the node's own).
    """
    zero = F.lit(0).cast("long")
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    steps = [1]  # band roots of level l stand at the multiples of steps[l]
    while steps[-1] * height <= deepest:
        steps.append(steps[-1] * height)
    sums, roots = [], []
    own = nodes.withColumn("children", zero)
    for level, step in enumerate(steps):
        own = own.filter(F.col("depth") % step == 0) if level else own
        if level:
            below = sums[-1].select("node", "leaves", "saved")
            own = own.select("node", "depth", "up").join(below, "node").withColumn("children", zero)
        roots.append(own)
        ancestors = F.posexplode(F.try_element_at("up", F.lit(level + 1)))
        inside = own.filter((F.col("depth") % (step * height) != 0)).select("leaves", "saved", ancestors.alias("at", "node"))
        child = F.when(F.col("at") == 0, 1).otherwise(0).cast("long") if level == 0 else zero
        parts = own.select("node", "leaves", "saved", "children").unionByName(
            inside.select("node", "leaves", "saved", child.alias("children"))
        )
        if level == 0:  # a band root is a child of its parent too, but its sums are not complete yet
            border = own.filter((F.col("depth") % height == 0) & (F.col("depth") > 0))
            parts = parts.unionByName(
                border.select(
                    F.try_element_at(F.try_element_at("up", F.lit(1)), F.lit(1)).alias("node"), zero.alias("leaves"), zero.alias("saved"), (zero + 1).alias("children")
                )
            )
        sums.append(scratch.write(_summed(parts), f"up{level}"))
    done = sums[-1]
    for level in range(len(steps) - 2, -1, -1):
        below = roots[level + 1].filter(F.col("depth") > 0).select("node", "up").join(done.select("node", "leaves", "saved"), "node")
        above = below.select("leaves", "saved", zero.alias("children"), F.explode(F.try_element_at("up", F.lit(level + 1))).alias("node"))
        done = scratch.write(_summed(sums[level].unionByName(above)), f"down{level}")
    return done


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (node, conv_id) become (node, first, list), `list` the decimal numbers joined by commas."""
    node, held = None, []

    def piece() -> pa.RecordBatch:
        columns = [pa.array([node], pa.binary()), pa.array([held[0]], pa.int64()), pa.array([",".join(map(str, held))])]
        return pa.RecordBatch.from_arrays(columns, names=["node", "first", "list"])

    for batch in batches:
        for key, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if key != node or len(held) == PIECE:
                if held:
                    yield piece()
                node, held = key, []
            held.append(conv)
    if held:
        yield piece()


def _list_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces become the SHA-256 of each node's whole list."""
    node, digest = None, None
    for batch in batches:
        out = []
        for key, part in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if key != node:
                if digest is not None:
                    out.append((node, digest.hexdigest()))
                node, digest = key, hashlib.sha256(part.encode())
            else:
                digest.update(b"," + part.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["node", "ends_sha256"])
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([digest.hexdigest()])], names=["node", "ends_sha256"])


def end_digests(steps: DataFrame) -> DataFrame:
    """(node, ends_sha256) of the nodes where conversations end."""
    parts = int(steps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ends = steps.filter("ends = 1").select("node", "conv_id")
    pieces = ends.repartitionByRange(parts, "node", "conv_id").sortWithinPartitions("node", "conv_id")
    pieces = pieces.mapInArrow(_pieces, "node binary, first long, list string")
    ordered = pieces.repartition("node").sortWithinPartitions("node", "first")
    return ordered.mapInArrow(_list_digests, "node binary, ends_sha256 string")


def trie_report(conversations: DataFrame, height: int = HEIGHT) -> DataFrame:
    """Per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    scratch = C.Scratch(conversations.sparkSession, "trie_report")
    turns = scratch.write(turn_rows(conversations), "turns")
    return trie_of(rebuilt_rows(turns), height)


def trie_of(rows: DataFrame, height: int = HEIGHT) -> DataFrame:
    """The trie of conversations given as (conv_id, part, n, key, chars), each with one row of part -1 in front."""
    scratch = C.Scratch(rows.sparkSession, "rollup")
    steps, nodes = trie_nodes(rows, height)
    leaf = F.when(F.col("n_ends") == F.col("n_convs"), 1).otherwise(0).cast("long")  # nobody goes on from here
    saved = (F.col("n_convs") - 1) * F.col("chars")
    sums = band_rollup(nodes.select("node", "depth", "up", leaf.alias("leaves"), saved.alias("saved")), height, scratch)
    ends = scratch.write(end_digests(steps), "ends")
    parents = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    nodes = nodes.withColumn("parent", F.try_element_at(F.try_element_at("up", F.lit(1)), F.lit(1)))
    return (
        nodes.join(parents, "parent", "left")
        .join(sums, "node")
        .join(ends, "node", "left")
        .select(
            "conv_id",
            F.col("depth").cast("long").alias("depth"),
            "parent_conv_id",
            "n_convs",
            F.col("children").alias("n_children"),
            F.col("leaves").alias("n_leaves"),
            F.col("saved").alias("saved_tokens"),
            F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
        )
    )
