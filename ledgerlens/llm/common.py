"""What the training-data operators share: scratch tables, and word hashing of whole Arrow batches with numpy.

The functions on arrays run inside Spark tasks (`mapInArrow`). They work on slices of a few megabytes of text, so a
task's memory follows the longest single document and not the batch or the partition.
"""

from __future__ import annotations

import contextlib
import ctypes
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.session import Scratch

#: Bytes of text that a task hashes at a time (a longer single document is one slice).
SLICE_BYTES = 1 << 19
#: Rows that Spark hands to Python at a time.
BATCH_ROWS = 512

ASCII_SPACE = b" \t\n\r\x0b\x0c"


def small_batches(spark: SparkSession) -> None:
    """Hand Python a few hundred rows at a time: documents can be long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Only A-Z become a-z; Spark's `lower` would also change other letters."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, offsets) of a string column; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    if column.null_count:
        lengths = np.diff(bounds)
        null = np.asarray(column.is_null())
        if lengths[null].any():  # bytes below a null are allowed by the format
            column = column.fill_null(b"")
            return text_bytes(column)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about `limit` bytes each."""
    first, last = 0, len(offsets) - 1
    while first < last:
        end = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        end = min(max(end, first + 1), last)
        yield first, end
        first = end




def worker_store() -> dict:
    """What a Python worker keeps from task to task (functions arrive anew with every task)."""
    name = "_ledgerlens_worker"
    if name not in sys.modules:
        sys.modules[name] = types.ModuleType(name)
    return sys.modules[name].__dict__


def give_back() -> None:
    """Return freed memory to the system at the end of a task: the worker lives on beside others."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64 and of its inverse, kept by the worker."""
    kept = worker_store()
    if "up" not in kept or len(kept["up"]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            factors = np.full(size, base, dtype=np.uint64)
            factors[0] = 1
            kept[name] = np.multiply.accumulate(factors)
    return kept["up"], kept["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers that spreads every bit (SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values; sorting is faster than hashing for 64-bit numbers."""
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which `span_hash` gets the hash of any range of the bytes."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers(len(prefix))
    value = (prefix[end] - prefix[start]) * down[start]
    return mix(value + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_table(separators: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(is a word byte, lower-cased byte) by byte, where only the separators stand between words."""
    is_word = np.ones(256, dtype=bool)
    is_word[list(separators)] = False
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    return is_word, lower


#: Words as `[^\x20\x09-\x0D]+`.
SPACED = word_table(ASCII_SPACE)
#: Words as `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of text whose A-Z are a-z already.
ALNUM = word_table(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


def words(data: np.ndarray, offsets: np.ndarray, kind: tuple[np.ndarray, np.ndarray]):
    """(hashes, offsets by document, start, end) of the words; no word crosses two documents."""
    is_word, lower = kind
    inside = is_word[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    filled = offsets[:-1][np.diff(offsets) > 0]
    begins[filled] = inside[filled]
    last = offsets[1:][np.diff(offsets) > 0] - 1
    ends[last] = inside[last]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    hashes = span_hash(prefix_hash(lower[data]), start, end)
    return hashes, np.searchsorted(start, offsets), start, end


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k words in a row, by first word, across document borders (`inside` tells which are real)."""
    n = max(0, len(hashes) - k + 1)
    out = np.full(n, np.uint64(k), dtype=np.uint64)
    for j in range(k):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + n])
    return out


def document_of(offsets: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = 5) -> list[np.ndarray]:
    """Sorted distinct hashes of k words in a row by document; a shorter text is one shingle, an empty one none."""
    hashes, bounds, _, _ = words(data, offsets, SPACED)
    rows = grams(hashes, k)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= k:
            out.append(distinct(rows[a : b - k + 1]))
        elif b > a:
            out.append(grams(hashes[a:b], int(b - a)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indexes of the ranges [start, start + length), one after the other."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, rows: int) -> Iterator[pa.Table]:
    """Tables of about `rows` rows that hold whole groups; equal values of `key` follow each other in the partition."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count >= rows:
            table = pa.Table.from_batches(held)
            values = np.array(table.column(key))
            change = np.flatnonzero(values[1:] != values[:-1])
            if len(change):
                end = int(change[-1]) + 1
                yield table.slice(0, end)
                table = table.slice(end)
            held = table.combine_chunks().to_batches()
            count = table.num_rows
    if held:
        yield pa.Table.from_batches(held)


def group_sizes(key: np.ndarray) -> np.ndarray:
    return np.diff(np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])) if len(key) else np.zeros(0, int)


def pairs_within(sizes: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions i < j of one group, for groups of these sizes that follow each other; about `most` pairs at a time."""
    starts = np.cumsum(sizes) - sizes
    after = np.repeat(starts + sizes, sizes) - np.arange(sizes.sum()) - 1  # partners behind each row
    total = np.cumsum(after)
    at = 0
    while at < len(after):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most)))
        yield np.repeat(np.arange(at, end), after[at:end]), ragged(np.arange(at, end) + 1, after[at:end])
        at = end


class Forest:
    """Union-find over ids that remembers which links joined two trees."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}
        self.links: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        parent = self.parent
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    def join(self, a: int, b: int) -> None:
        x, y = self.root(a), self.root(b)
        if x != y:
            self.parent[max(x, y)] = min(x, y)
            self.links.append((a, b))
