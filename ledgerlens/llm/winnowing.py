"""Benchmark decontamination by winnowing.

Of every `WINDOW - K + 1` word K-grams in a row the one with the smallest hash is a fingerprint (the rightmost of
equal ones). A span of `WINDOW` words that a document shares with an item holds exactly one such run, so both sides
keep the same fingerprint of it: joining fingerprints loses no shared span of WINDOW words or more. Every joined pair
of positions is then extended word by word (word hashes of 64 bits) and counts where the run reaches WINDOW words.
Items of fewer words are one window; their word hashes are looked up at their own length.

Scale: the documents are read once and never shuffled. The fingerprints of the benchmark go to the tasks, in parts:
`PART_WORDS` bounds the item words held by one pass, and a larger benchmark takes several passes over the documents,
each with its part of the items, whose hits are written and then merged by document. The driver builds the parts one after
the other and never holds more than two.

Edge cases: a null or empty text, document or item, has no words and is not hit; repeated items are items of their
own; repeated documents give repeated rows; a null item id never appears in the digest but its windows hit; other
columns are not read, whatever they are called; an empty benchmark leaves every document clean.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.llm import common as C

WINDOW = 10
K = 5
#: Item words that one pass over the documents holds in a task (about 100 bytes each).
PART_WORDS = 1_000_000


def fingerprints(hashes: np.ndarray, k: int, run: int, bounds: np.ndarray) -> np.ndarray:
    """Positions of the minima of `run` K-grams in a row (rightmost of equal ones), none across documents."""
    rows = C.grams(hashes, k)
    n = len(rows) - run + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    best, at = rows[:n].copy(), np.zeros(n, dtype=np.int64)
    for j in range(1, run):
        lower = rows[j : j + n] <= best
        best[lower] = rows[j : j + n][lower]
        at[lower] = j
    first = np.arange(n)
    end = bounds[np.searchsorted(bounds, first, side="right")]
    return C.distinct((first + at)[first + run + k - 1 <= end])


@dataclass
class Benchmark:
    """One part of the items: their words, and fingerprint positions sorted by hash."""

    words: np.ndarray
    item_start: np.ndarray
    item_end: np.ndarray
    item_of: np.ndarray
    ids: list
    keys: np.ndarray
    places: np.ndarray
    short: dict

    @classmethod
    def build(cls, ids: list, texts: list, window: int = WINDOW, k: int = K) -> Benchmark:
        data, offsets = C.text_bytes(pa.array(texts, pa.string()))
        hashes, bounds, _, _ = C.words(C.SPACED[1][data], offsets, C.ALNUM)
        item_of = C.document_of(bounds)
        counts = np.diff(bounds)
        places = fingerprints(hashes, k, window - k + 1, bounds)
        keys = C.grams(hashes, k)[places] if len(places) else np.zeros(0, np.uint64)
        order = np.argsort(keys, kind="stable")
        short: dict[int, list] = {}
        for i in np.flatnonzero((counts > 0) & (counts < window)):
            short.setdefault(int(counts[i]), []).append((C.grams(hashes[bounds[i] : bounds[i + 1]], int(counts[i]))[0], i))
        tables = {
            n: (np.array([h for h, _ in sorted(v)], np.uint64), np.array([i for _, i in sorted(v)])) for n, v in short.items()
        }
        return cls(hashes, bounds[:-1][item_of], bounds[1:][item_of], item_of, ids, keys[order], places[order], tables)


def matches(hashes: np.ndarray, bounds: np.ndarray, bench: Benchmark, window: int = WINDOW, k: int = K):
    """(first word, word after the last, item) of every maximal shared run around a common fingerprint, unsorted."""
    places = fingerprints(hashes, k, window - k + 1, bounds)
    none = np.zeros(0, np.int64)
    first, last, item = none, none, none
    if len(places) and len(bench.keys):
        keys = C.grams(hashes, k)[places]
        low, high = np.searchsorted(bench.keys, keys), np.searchsorted(bench.keys, keys, side="right")
        found = high > low
        count = (high - low)[found]
        here = np.repeat(places[found], count)
        there = bench.places[C.ragged(low[found], count)]
        doc = np.searchsorted(bounds, here, side="right")
        left_room = np.minimum(here - bounds[doc - 1], there - bench.item_start[there])
        right_room = np.minimum(bounds[doc] - here, bench.item_end[there] - there)
        ends = []
        for room, step in ((left_room, -1), (right_room, 1)):
            # words that agree one after the other on this side; a run that reaches `window` has shown enough
            length, alive = np.zeros(len(here), np.int64), np.arange(len(here))
            for j in range(window):
                offset = -(j + 1) if step < 0 else j
                alive = alive[room[alive] > j]
                alive = alive[hashes[here[alive] + offset] == bench.words[there[alive] + offset]]
                if not len(alive):
                    break
                length[alive] += 1
            ends.append(length)
        first, last, item = here - ends[0], here + ends[1], bench.item_of[there]
        # every window of the run that holds this fingerprint; longer runs hold further fingerprints
        real = last - first >= window
        first, last, item = first[real], last[real], item[real]
    for n, (keys, items) in bench.short.items():
        rows = C.grams(hashes, n)
        start = np.arange(len(rows))
        rows, start = (x[start + n <= bounds[np.searchsorted(bounds, start, side="right")]] for x in (rows, start))
        low, high = np.searchsorted(keys, rows), np.searchsorted(keys, rows, side="right")
        found = high > low
        count = (high - low)[found]
        begin = np.repeat(start[found], count)
        first = np.concatenate([first, begin])
        last = np.concatenate([last, begin + n])
        item = np.concatenate([item, items[C.ragged(low[found], count)]])
    return first, last, item


HITS = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("starts", T.ArrayType(T.LongType())),
        T.StructField("ends", T.ArrayType(T.LongType())),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)


def _scan(bench: Benchmark, window: int, k: int, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = C.text_bytes(batch.column(text_at))
            out: list[tuple] = []
            for a, b in C.slices(offsets):
                part = C.SPACED[1][data[offsets[a] : offsets[b]]]
                hashes, bounds, _, _ = C.words(part, offsets[a : b + 1] - offsets[a], C.ALNUM)
                first, last, item = matches(hashes, bounds, bench, window, k)
                doc = np.searchsorted(bounds, first, side="right") - 1
                order = np.lexsort((last, first, doc))
                first, last, item, doc = first[order], last[order], item[order], doc[order]
                edges = np.searchsorted(doc, np.arange(b - a + 1))
                for i in range(b - a):
                    n = int(bounds[i + 1] - bounds[i])
                    x, y = edges[i], edges[i + 1]
                    if x == y:
                        out.append((n, [], [], []))
                        continue
                    reach = np.maximum.accumulate(last[x:y])
                    opens = np.flatnonzero(np.r_[True, first[x + 1 : y] > reach[:-1]])
                    starts = first[x:y][opens] - bounds[i]
                    ends = reach[np.r_[opens[1:] - 1, y - x - 1]] - bounds[i]
                    names = sorted({str(bench.ids[j]) for j in np.unique(item[x:y]) if bench.ids[j] is not None})
                    out.append((n, starts.tolist(), ends.tolist(), names))
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string()))
            cols = [pa.array([r[j] for r in out], kinds[j]) for j in range(4)]
            keep = [batch.column(j) for j in range(batch.num_columns) if j != text_at]
            names = [batch.schema.names[j] for j in range(batch.num_columns) if j != text_at]
            yield pa.RecordBatch.from_arrays([*keep, *cols], names=[*names, *HITS.names])
        C.give_back()

    return run


def benchmark_parts(
    items: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW, k: int = K,
    part_words: int = PART_WORDS,
) -> Iterator[Benchmark]:
    """The items in parts of bounded size; a part is built when it is asked for."""
    ids, texts, size = [], [], 0
    for row in items.select(F.col(item_id).cast("string").alias("i"), F.col(text).alias("t")).toLocalIterator():
        n = len(row["t"] or "") // 2 + 1
        if texts and size + n > part_words:
            yield Benchmark.build(ids, texts, window, k)
            ids, texts, size = [], [], 0
        ids.append(row["i"])
        texts.append(row["t"])
        size += n
    yield Benchmark.build(ids, texts, window, k)


def _scanned(docs: DataFrame, bench: Benchmark, window: int, k: int) -> DataFrame:
    """The columns of `docs` without its last, the text, and the hits."""
    fields = docs.schema.fields
    scan = _scan(bench, window, k, len(fields) - 1)
    return docs.mapInArrow(scan, T.StructType([*fields[:-1], *HITS.fields]))


def contaminated_spans(
    docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW, k: int = K,
    part_words: int = PART_WORDS,
) -> DataFrame:
    """Per document: doc_id, n_words, disjoint hit ranges [starts[i], ends[i]) in words, and the items that hit."""
    C.small_batches(docs.sparkSession)
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    parts = benchmark_parts(items, window=window, k=k, part_words=part_words)
    bench, following = next(parts), next(parts, None)
    if following is None:
        return _scanned(slim, bench, window, k)
    scratch = C.Scratch(docs.sparkSession, "winnowing")
    rows = scratch.write(slim.select("doc_id", F.monotonically_increasing_id().alias("row"), "text"), "docs")
    union = scratch.write(_scanned(rows, bench, window, k), "part0")  # all documents; further parts add those they hit
    done = 1
    while following is not None:
        bench, following = following, next(parts, None)
        hit = _scanned(rows, bench, window, k).filter(F.size("starts") > 0)
        union = union.unionByName(scratch.write(hit, f"part{done}"))
        done += 1
    scratch.drop("docs")
    return (
        union.groupBy("row")
        .agg(
            F.first("doc_id").alias("doc_id"),
            F.first("n_words").alias("n_words"),
            _merged(F.array_sort(F.flatten(F.collect_list(F.arrays_zip("starts", "ends"))))).alias("s"),
            F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        )
        .select("doc_id", "n_words", F.col("s.starts").alias("starts"), F.col("s.ends").alias("ends"), "items")
    )


def clean_documents(docs: DataFrame, items: DataFrame, text: str = "text", part_words: int = PART_WORDS) -> DataFrame:
    """The rows of `docs` that share no window with an item, with their columns; one pass for each part of the items."""
    C.small_batches(docs.sparkSession)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    scratch = C.Scratch(docs.sparkSession, "winnowing")
    parts = benchmark_parts(items, part_words=part_words)
    bench, done = next(parts), 0
    while bench is not None:
        rows = docs.select(F.struct(*columns).alias("row"), F.col(f"`{text}`").cast("string").alias("text"))
        docs = _scanned(rows, bench, WINDOW, K).filter(F.size("starts") == 0).select("row.*")
        bench = next(parts, None)
        if bench is not None:
            docs = scratch.write(docs, f"clean{done}")
            if done:
                scratch.drop(f"clean{done - 1}")
            done += 1
    return docs


def _merged(ranges: Column) -> Column:
    """Sorted ranges joined where they overlap or touch."""
    kind = "array<struct<starts:bigint,ends:bigint>>"

    def step(done, r):
        grow = (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["ends"] >= r["starts"])
        return F.when(
            grow,
            F.concat(
                F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))),
                F.array(
                    F.struct(
                        F.try_element_at(done, F.lit(-1))["starts"].alias("starts"),
                        F.greatest(F.try_element_at(done, F.lit(-1))["ends"], r["ends"]).alias("ends"),
                    )
                ),
            ),
        ).otherwise(F.concat(done, F.array(r)))

    return F.aggregate(ranges, F.array().cast(kind), step)


def contamination_report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = contaminated_spans(docs, items)
    hit = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda t, n: t + n)
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("starts") > 0).alias("contaminated"),
    )


def digest(item_ids: list) -> str:
    return hashlib.sha256(",".join(sorted(str(i) for i in item_ids)).encode()).hexdigest()
