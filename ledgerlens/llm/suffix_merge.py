"""Byte-exact removal of repeated strings by blocks of phrases that are refined over all shards.

This replaces the merge of shard Burrows-Wheeler transforms: no transform, suffix order or common-prefix array is built.
What is kept of it is the refinement: positions of all shards stand in blocks that agree in their first d symbols, and d
grows until every block is settled. Bytes as symbols would need LENGTH rounds over every byte, so symbols are phrases.

A text is parsed into phrases: they begin where the hash of GRAM bytes is the strict minimum among the RADIUS positions
on either side. Whether a position begins a phrase depends on those bytes alone, so a string that occurs twice
is parsed alike, but for its ends. A shard is the phrase sequence of some documents.

Refinement: it begins with blocks of equal first phrase. A step extends every block by the block of the position that
follows, over all shards at once: d goes from 1 to 2 to 4. A shard sends one row per block it takes part in (a hash of its
phrases), and gets back which of its blocks are shared; positions alone in their block are settled and never looked at again.

Repeated intervals: all windows of LENGTH bytes with the same phrases inside are one run. A run whose phrases are
unshared cannot repeat. A run that is shared with one more phrase on each side, and the bytes that decided where those
phrases end, repeats as a whole. Only what is left, at the ends of repeated intervals, and windows without a
phrase begin, is compared window by window, by 64-bit hashes of all LENGTH bytes: first among documents that share a
phrase block, then across all.

Edge cases: null and empty texts have no bytes, and their hash is that of no bytes; a text shorter than LENGTH is kept;
overlapping occurrences count; repeated rows are texts of their own and empty each other; rows of one id and text
get one result each; null ids are values; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm import common as C

#: The contract's length of a repeated string, in bytes.
LENGTH = 400
GRAM = 8
RADIUS = 40
#: Bytes of text in a shard.
SHARD_BYTES = 4 << 20
#: Documents of one block whose windows are compared together, at most on average.
TOGETHER = 1024


def phrase_starts(data: np.ndarray, offsets: np.ndarray, prefix: np.ndarray) -> np.ndarray:
    """Positions whose GRAM bytes hash below all others within RADIUS, where all of those lie in the same document."""
    n = len(data) - GRAM + 1
    if n <= 2 * RADIUS:
        return np.zeros(0, dtype=np.int64)
    place = np.arange(n)
    h = C.span_hash(prefix, place, place + GRAM)
    # minimum of each RADIUS positions in a row, by doubling
    low, width = h, 1
    while width * 2 <= RADIUS:
        low = np.minimum(low[: len(low) - width], low[width:])
        width *= 2
    low = np.minimum(low[: n - RADIUS + 1], low[RADIUS - width : RADIUS - width + n - RADIUS + 1])
    mid = np.arange(RADIUS, n - RADIUS)
    good = mid[(h[mid] < low[mid - RADIUS]) & (h[mid] < low[mid + 1])]
    doc = np.searchsorted(offsets, good, side="right")
    return good[(good - RADIUS >= offsets[doc - 1]) & (good + RADIUS + GRAM <= offsets[doc])]


def runs_of(pos: np.ndarray, n_bytes: int, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(x0, x1, a, b): windows x0..x1 hold the phrase begins a..b entirely decided inside; b < a means none."""
    last = n_bytes - length
    # where the first begin inside changes, and where the last one does
    cuts = C.distinct(np.concatenate([[0], pos - RADIUS + 1, pos + RADIUS + GRAM - length]))
    x0 = cuts[(cuts >= 0) & (cuts <= last)]
    x1 = np.append(x0[1:] - 1, last)
    a = np.searchsorted(pos, x0 + RADIUS, side="left")
    b = np.searchsorted(pos, x0 + length - RADIUS - GRAM, side="right") - 1
    return x0, x1, a, b


SHARD = (
    "shard long, r1 array<long>, r2 array<long>, n_bytes array<long>, bounds array<long>, pos array<long>, sym array<long>,"
    " ctx array<long>"
)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shards: phrase begins of documents of at least LENGTH bytes, the phrases' hashes, and hashes of the deciding bytes."""
    held: list[tuple] = []
    size, number, part = 0, 0, 0

    def shard() -> pa.RecordBatch:
        nonlocal held, size, number
        cols = [np.concatenate([h[i] for h in held]) for i in (0, 1, 2, 4, 5, 6)]
        counts = np.concatenate([h[3] for h in held])
        bounds = np.r_[0, np.cumsum(counts)]
        lists = [cols[0], cols[1], cols[2], bounds, cols[3], cols[4].view(np.int64), cols[5].view(np.int64)]
        out = pa.RecordBatch.from_arrays(
            [pa.array([(part << 33) + number], pa.int64()), *[pa.array([x.astype(np.int64)], pa.list_(pa.int64())) for x in lists]],
            names=["shard", "r1", "r2", "n_bytes", "bounds", "pos", "sym", "ctx"],
        )
        held, size, number = [], 0, number + 1
        return out

    for batch in batches:
        if not batch.num_rows:
            continue
        part = batch.column(3)[0].as_py()
        r1, r2 = np.array(batch.column(0)), np.array(batch.column(1))
        data, offsets = C.text_bytes(batch.column(2))
        for a, b in C.slices(offsets):
            one, off = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            prefix = C.prefix_hash(one)
            pos = phrase_starts(one, off, prefix)
            doc = np.searchsorted(off, pos, side="right") - 1
            nxt = np.append(pos[1:], 0)
            whole = np.append(doc[1:] == doc[:-1], False) if len(pos) else np.zeros(0, bool)
            sym = C.span_hash(prefix, pos, np.where(whole, nxt, pos))
            left = C.span_hash(prefix, pos - RADIUS, pos)
            right = C.span_hash(prefix, pos, pos + RADIUS + GRAM)
            ctx = (left >> np.uint64(32) << np.uint64(32)) | (right >> np.uint64(32))
            held.append((r1[a:b], r2[a:b], np.diff(off), np.bincount(doc, minlength=b - a), pos - off[doc], sym, ctx))
            size += len(one)
            if size >= SHARD_BYTES:
                yield shard()
    if held:
        yield shard()


class State:
    """One shard as arrays; `doc` is the document of every phrase begin."""

    def __init__(self, row: dict):
        self.shard = row["shard"]
        self.r1, self.r2, self.n_bytes, self.bounds, self.pos = (
            np.asarray(row[c], dtype=np.int64) for c in ("r1", "r2", "n_bytes", "bounds", "pos")
        )
        self.sym, self.ctx = (np.asarray(row[c], dtype=np.int64).view(np.uint64) for c in ("sym", "ctx"))
        self.doc = C.document_of(self.bounds)
        self.end = self.bounds[1:][self.doc]  # behind the document's last begin

    def blocks(self, depth: int) -> np.ndarray:
        """The block of every suffix among those that agree in `depth` phrases (meaningless if it has fewer)."""
        block, d = C.mix(self.sym + np.uint64(1)), 1
        while d < depth:
            block = C.mix(block * np.uint64(0x9E3779B97F4A7C15) + np.append(block[d:], np.zeros(min(d, len(block)), np.uint64)))
            d *= 2
        return block

    def has(self, depth: int) -> np.ndarray:
        """Suffixes of at least `depth` whole phrases."""
        return np.arange(len(self.pos)) + depth < self.end

    def single(self) -> np.ndarray:
        """Block of a begin by the bytes around it, for windows that hold a single begin."""
        return C.mix(self.ctx ^ np.uint64(0xA0761D6478BD642F))

    def runs(self) -> tuple[np.ndarray, ...]:
        """(document, x0, x1, a, b) of all runs of windows; a and b count in the shard."""
        out = []
        for i in np.flatnonzero(self.n_bytes >= LENGTH):
            s, e = self.bounds[i], self.bounds[i + 1]
            x0, x1, a, b = runs_of(self.pos[s:e], int(self.n_bytes[i]))
            out.append((np.full(len(x0), i), x0, x1, a + s, b + s))
        if not out:
            return tuple(np.zeros(0, np.int64) for _ in range(5))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _states(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[State, dict]]:
    for batch in batches:
        for row in range(batch.num_rows):
            one = {n: batch.column(i)[row] for i, n in enumerate(batch.schema.names)}
            lists = {n: (v.values.to_numpy(zero_copy_only=False) if v.is_valid else np.zeros(0, np.int64)) if isinstance(v, pa.ListScalar) else v.as_py() for n, v in one.items()}
            yield State(lists), lists


def _send(depth: int):
    """(block, shard, several): the blocks of a shard at this depth; `several` if more than one of its suffixes is in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for state, row in _states(batches):
            if depth == 1:
                alive = state.has(1)
                blocks = np.concatenate([state.blocks(1)[alive], state.single()])
            else:
                shared = np.sort(row["shared"].astype(np.int64).view(np.uint64))
                half = _member(state.blocks(depth // 2), shared) & state.has(depth // 2)
                alive = half & state.has(depth) & np.append(half[depth // 2 :], np.zeros(min(depth // 2, len(half)), bool))[: len(half)]
                blocks = state.blocks(depth)[alive]
            yield _block_rows(blocks, state.shard)

    return run


def _block_rows(blocks: np.ndarray, shard: int) -> pa.RecordBatch:
    unique, n = np.unique(blocks, return_counts=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(unique.view(np.int64)), pa.array(np.full(len(unique), shard, np.int64)), pa.array(n > 1)],
        names=["block", "shard", "several"],
    )


def _member(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    if not len(among):
        return np.zeros(len(values), bool)
    return among[np.minimum(np.searchsorted(among, values), len(among) - 1)] == values


def _shared(sent: DataFrame) -> DataFrame:
    """(shard, shared): the blocks of every shard that hold two suffixes or more, of any shards.

    A block's rows are as many as its shards; they combine before the shuffle. The blocks go back by a join,
    so no block's shards are gathered in one place.
    """
    held = sent.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.max("several").alias("s")).filter("n > 1 or s")
    back = sent.select("block", "shard").join(held.select("block"), "block")
    return back.groupBy("shard").agg(F.collect_list("block").alias("shared"))


def _candidates(state: State, shared: dict[int, np.ndarray]) -> tuple[np.ndarray, ...]:
    """Runs (document, x0, x1, a, b) whose phrases are shared at every depth, and those without a begin."""
    doc, x0, x1, a, b = state.runs()
    n = b - a
    ok = n < 0
    single = n == 0
    if single.any():
        ok |= single & np.where(single, _member(state.single()[np.minimum(a, max(len(state.pos) - 1, 0))], shared[1]), False)
    for depth in (1, 2, 4):
        here = (n >= depth) & ((n < 2 * depth) if depth < 4 else True)
        if not here.any():
            continue
        alive = _member(state.blocks(depth), shared[depth]) & state.has(depth)
        dead = np.r_[0, np.cumsum(~alive)]
        ok[here] |= dead[np.maximum(b[here] - depth + 1, a[here])] == dead[a[here]]
    return doc[ok], x0[ok], x1[ok], a[ok], b[ok]


def _extended(state: State, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(has a begin on both sides, block of the run with them and the bytes that decide on them, block of the run)."""
    k = len(state.pos)
    if not k:
        return np.zeros(len(a), bool), np.zeros(len(a), np.uint64), np.zeros(len(a), np.uint64)
    inner = np.minimum(a, k - 1)
    start, end = state.bounds[state.doc[inner]], state.end[inner]
    good = (b >= a) & (a - 1 >= start) & (b + 1 < end)
    first, last = np.maximum(a - 1, 0), np.minimum(b + 1, k - 1)
    # the phrases from a - 1 up to b + 1 as one number: prefix sums of symbols times powers
    up, down = C.powers(k + 1)
    sums = np.r_[np.zeros(1, np.uint64), np.cumsum(C.mix(state.sym + np.uint64(7)) * up[:k])]
    inside = (sums[last] - sums[first]) * down[first]
    end = np.clip(b, inner, k - 1)
    core = C.mix((sums[end] - sums[inner]) * down[inner] + (end - inner).astype(np.uint64))
    core = np.where(b == a, state.single()[inner], core)
    left, right = state.ctx[first] >> np.uint64(32), state.ctx[last] & np.uint64(0xFFFFFFFF)
    out = C.mix(C.mix(inside + (last - first).astype(np.uint64)) ^ (left << np.uint64(32) | right))
    return good, out, core


def _all_shared(row: dict) -> dict[int, np.ndarray]:
    return {d: np.sort(row[f"shared{d}"].astype(np.int64).view(np.uint64)) for d in (1, 2, 4)}


EXTENDED = "block long, core long, run long, several boolean, shard long"


def _send_extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per shard: its extended blocks, each with its core and one run of it; and the cores of runs that have none."""
    for state, row in _states(batches):
        _, _, _, a, b = _candidates(state, _all_shared(row))
        good, block, core = _extended(state, a, b)
        at = np.flatnonzero(good)
        unique, first, n = np.unique(block[at], return_index=True, return_counts=True)
        lone = np.unique(core[~good & (b >= a)])
        none = pa.nulls(len(lone), pa.int64())
        cols = [
            [pa.array(unique.view(np.int64)), none],
            [pa.array(core[at[first]].view(np.int64)), pa.array(lone.view(np.int64))],
            [pa.array(at[first]), none],
            [pa.array(n > 1), pa.array(np.zeros(len(lone), bool))],
        ]
        joined = [pa.concat_arrays(c) for c in cols]
        yield pa.RecordBatch.from_arrays(
            [*joined, pa.array(np.full(len(joined[0]), state.shard, np.int64))], names=["block", "core", "run", "several", "shard"]
        )


def _sure_and_witnesses(sent: DataFrame, scratch: C.Scratch) -> DataFrame:
    """(shard, shared, asked): the extended blocks that repeat, and runs whose windows must be compared nevertheless.

    A run that is not sure may have its twin inside a sure one. So for every core of an unsure run, one run of each
    sure block of that core takes part in the comparison.
    """
    held = scratch.write(
        sent.filter("block is not null").groupBy("block").agg(
            F.count(F.lit(1)).alias("n"), F.max("several").alias("s"), F.min("core").alias("core"),
            F.min(F.struct("shard", "run")).alias("one"),
        ),
        "held",
    )
    sure = F.col("s") | (F.col("n") > 1)
    open_cores = held.filter(~sure).select("core").unionByName(sent.filter("block is null").select("core")).distinct()
    asked = held.filter(sure).join(open_cores, "core", "left_semi").select("one.shard", "one.run")
    asked = asked.groupBy("shard").agg(F.collect_list("run").alias("asked"))
    back = sent.filter("block is not null").select("block", "shard").join(held.filter(sure).select("block"), "block")
    back = back.groupBy("shard").agg(F.collect_list("block").alias("shared"))
    return scratch.write(back.join(asked, "shard", "left"), "shared")


RUNS = "r1 long, r2 long, near long, x0 array<long>, x1 array<long>, sure array<boolean>, asked array<boolean>"


def _run_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document the candidate runs; `sure` if the run repeats as a whole, `asked` if its windows are compared.

    `near` is the smallest block of the asked runs: documents that share passages are likely to share it.
    """
    for state, row in _states(batches):
        doc, x0, x1, a, b = _candidates(state, _all_shared(row))
        good, block, core = _extended(state, a, b)
        sure = good & _member(block, np.sort(row["shared"].astype(np.int64).view(np.uint64)))
        asked = ~sure
        asked[row["asked"].astype(np.int64)] = True
        docs, at = np.unique(doc, return_index=True)
        cut = np.append(at, len(doc))
        offsets = pa.array(cut.astype(np.int32))
        key = np.where(asked & (b >= a), core.view(np.int64), np.iinfo(np.int64).max)
        near = np.minimum.reduceat(key, at) if len(at) else key
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(state.r1[docs]),
                pa.array(state.r2[docs]),
                pa.array(near),
                *[pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (x0, x1, sure, asked)],
            ],
            names=["r1", "r2", "near", "x0", "x1", "sure", "asked"],
        )


def _ranges_of(doc: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first, last) of windows that follow each other; rows sorted by document and window."""
    if not len(x):
        return doc, x, x
    start = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (x[1:] != x[:-1] + 1)])
    return doc[start], x[start], x[np.r_[start[1:] - 1, len(x) - 1]]


WINDOWS = "h long, doc long, first int, last int"


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of the asked runs, compared inside the batch first.

    Those that occur twice in the batch go out as ranges, without a hash. Of every hash that occurs once, one row goes on to be
    compared with other batches; of one that occurs more often, too, so that others find it. So a hash is sent once
    per batch, however many documents hold it.
    """
    for batch in batches:
        hashes, docs, places = [], [], []
        for i in range(batch.num_rows):
            data = np.frombuffer(batch.column(1)[i].as_py().encode(), np.uint8)
            prefix = C.prefix_hash(data)
            x0, x1 = (np.array(batch.column(c)[i].values) for c in (2, 3))
            x = np.sort(C.ragged(x0, x1 - x0 + 1))
            hashes.append(C.span_hash(prefix, x, x + LENGTH))
            docs.append(np.full(len(x), batch.column(0)[i].as_py(), np.int64))
            places.append(x)
        if not hashes:
            continue
        h, doc, x = np.concatenate(hashes), np.concatenate(docs), np.concatenate(places)
        order = np.argsort(h, kind="stable")
        ordered = h[order]
        new = np.r_[True, ordered[1:] != ordered[:-1]] if len(h) else np.zeros(0, bool)
        alone = new & np.r_[new[1:], True] if len(h) else new
        twice = np.ones(len(h), dtype=bool)
        twice[order[alone]] = False
        d, first, last = _ranges_of(doc[twice], x[twice])
        rep = order[new]
        yield pa.RecordBatch.from_arrays(
            [
                pa.concat_arrays([pa.nulls(len(d), pa.int64()), pa.array(h[rep].view(np.int64))]),
                pa.array(np.concatenate([d, doc[rep]])),
                pa.array(np.concatenate([first, x[rep]]).astype(np.int32)),
                pa.array(np.concatenate([last, x[rep]]).astype(np.int32)),
            ],
            names=["h", "doc", "first", "last"],
        )


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows whose hash stands in two rows; equal hashes follow each other."""
    for table in C.whole_groups(batches, "h", 1 << 17):
        h = np.array(table.column("h"))
        if not len(h):
            continue
        same = h[1:] == h[:-1]
        hit = np.r_[same, False] | np.r_[False, same]
        doc, x = np.array(table.column("doc"))[hit], np.array(table.column("first"))[hit]
        order = np.lexsort((x, doc))
        d, first, last = _ranges_of(doc[order], x[order].astype(np.int64))
        yield pa.RecordBatch.from_arrays(
            [pa.array(d), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))], names=["doc", "first", "last"]
        )


def _keyed(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """r1, r2 (two hashes that stand for the id and the text), doc_id, text."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(
        F.xxhash64(body, F.col(doc_id)).alias("r1"),
        F.xxhash64(F.lit(11), F.col(doc_id), body).alias("r2"),
        F.col(doc_id).alias("doc_id"),
        body.alias("text"),
    )


def _one_per_row(found: DataFrame) -> DataFrame:
    """Rows of one id and text have the same runs, but a witness is marked in the copy of its shard alone: a run is asked if any copy is.

    Only distinct marks are gathered, so the copies of a row, however many, are a few arrays.
    """
    same = [F.first(c).alias(c) for c in ("x0", "x1", "sure")]
    one = found.groupBy("r1", "r2").agg(F.min("near").alias("near"), *same, F.collect_set("asked").alias("marks"))
    asked = F.transform(F.col("sure"), lambda _, i: F.exists("marks", lambda m: F.get(m, i)))
    return one.withColumn("asked", asked).drop("marks")


def repeated_ranges(docs: DataFrame, scratch: C.Scratch) -> DataFrame:
    """(r1, r2, x0, x1): ranges of repeated windows x0..x1 by their first bytes, in any order; `docs` as from `_keyed`."""
    parts = F.spark_partition_id().cast("long").alias("part")
    shards = scratch.write(docs.select("r1", "r2", "text", parts).mapInArrow(_parse, SHARD), "shards")
    state, names = shards, []
    for depth in (1, 2, 4):
        sent = scratch.write(state.mapInArrow(_send(depth), "block long, shard long, several boolean"), f"sent{depth}")
        back = scratch.write(_shared(sent), f"shared{depth}")
        scratch.drop(f"sent{depth}")
        names.append(back.withColumnRenamed("shared", f"shared{depth}"))
        state = shards.join(back, "shard", "left")
    state = shards
    for back in names:
        state = state.join(back, "shard", "left")
    sent = scratch.write(state.mapInArrow(_send_extended, EXTENDED), "sent")
    back = _sure_and_witnesses(sent, scratch)
    found = state.join(back, "shard", "left").mapInArrow(_run_rows, RUNS)
    one = _one_per_row(found)
    runs = scratch.write(one.withColumn("doc", F.monotonically_increasing_id()), "runs")
    scratch.drop("sent", "held", "shards", "shared", "shared1", "shared2", "shared4")
    zipped = F.arrays_zip("x0", "x1", "sure", "asked")
    open_runs = runs.select("r1", "r2", "doc", "near", F.filter(zipped, lambda r: r["asked"]).alias("u")).filter(F.size("u") > 0)
    # a block that very many documents share is dealt out in parts
    parts = open_runs.groupBy("near").agg(F.ceil(F.count(F.lit(1)) / TOGETHER).alias("parts"))
    open_runs = open_runs.join(parts, "near").withColumn("deal", F.xxhash64("near", F.pmod(F.col("doc"), F.col("parts"))))
    texts = docs.select("r1", "r2", "text").join(open_runs, ["r1", "r2"])
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # documents that share passages meet in one batch, where most of their windows are settled
    dealt = texts.select("doc", "text", "u.x0", "u.x1", "deal").repartition(n, "deal").sortWithinPartitions("deal")
    windows = scratch.write(dealt.select("doc", "text", "x0", "x1").mapInArrow(_windows, WINDOWS), "windows")
    scratch.drop()
    sent = windows.filter("h is not null").select("h", "doc", "first").repartition(n, "h").sortWithinPartitions("h")
    met = scratch.write(sent.mapInArrow(_meet, "doc long, first int, last int"), "met")
    hits = met.unionByName(windows.filter("h is null").select("doc", "first", "last"))
    sure = runs.select("doc", F.explode(F.filter(zipped, lambda r: r["sure"])).alias("s")).select(
        "doc", F.col("s.x0").cast("int").alias("first"), F.col("s.x1").cast("int").alias("last")
    )
    whole = hits.unionByName(sure).groupBy("doc").agg(F.collect_list("first").alias("x0"), F.collect_list("last").alias("x1"))
    ranges = scratch.write(whole.join(runs.select("doc", "r1", "r2"), "doc").select("r1", "r2", "x0", "x1"), "ranges")
    scratch.drop("windows", "met", "runs")
    return ranges


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document: bytes, bytes removed, runs removed, hash of the rest, the rest itself."""
    for batch in batches:
        out = []
        for i in range(batch.num_rows):
            data = np.frombuffer(batch.column(1)[i].as_py().encode(), np.uint8)
            gone = np.zeros(len(data) + 1, dtype=np.int64)
            if batch.column(2)[i].is_valid:
                x0, x1 = (np.array(batch.column(c)[i].values, dtype=np.int64) for c in (2, 3))
                np.add.at(gone, x0, 1)
                np.add.at(gone, x1 + LENGTH, -1)
            hit = np.cumsum(gone)[:-1] > 0
            spans = int((hit & ~np.r_[False, hit[:-1]]).sum()) if len(hit) else 0
            rest = data[~hit].tobytes()
            out.append((len(data), int(hit.sum()), spans, hashlib.sha256(rest).hexdigest(), rest))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        cols = [pa.array([r[j] for r in out], kinds[j]) for j in range(5)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def without_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the kept bytes."""
    spark = docs.sparkSession
    C.small_batches(spark)
    scratch = C.Scratch(spark, "suffixes")
    keyed = _keyed(docs, text, doc_id)
    ranges = repeated_ranges(keyed, scratch)
    rows = keyed.join(ranges, ["r1", "r2"], "left").select("doc_id", "text", "x0", "x1")
    kind = docs.schema[doc_id].dataType.simpleString()
    return rows.mapInArrow(
        _cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    )


def repeat_report(docs: DataFrame) -> DataFrame:
    return without_repeats(docs).drop("kept")

