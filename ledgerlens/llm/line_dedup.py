"""Line dedup: repeated lines lose all their copies but one, told by compressed keep bitmaps instead of text.

1. Every long enough line becomes a narrow row (128-bit hash of its key, document, line number); texts stay where they are.
2. The rows are range-partitioned by (hash, document) and sorted by hash, then document from the largest down, then line.
   A line that a third of all documents hold is so spread over many partitions.
3. A partition is streamed. The first document of a hash is the one that keeps its lines; the lines of the others are
   dropped once `least` documents were seen (until then at most `least - 1` documents' lines wait). A hash that touches the
   border of a partition may go on in the next one: its rows leave undecided, beside one carry row (documents, largest
   document) a border. Carries are two rows a partition at most, so their totals are broadcast.
4. Dropped line numbers are collected per document into a bitmap (bit i: line i stays; lines behind the last bit stay),
   packed and deflated. Only documents that lose lines have one.

Edge cases: a null or empty text is one empty line; lines are split at \\n alone; a null id counts as one document, the
smallest of all; rows of one id are one document when documents are counted, but each row keeps its own lines and bitmap
(rows are known by id and text, equal rows get equal bitmaps); columns other than those named are carried along whatever
they are called; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.llm import common as C

#: Fixed by the contract: code points of a key that counts, and documents that make it a repeat.
MIN_CHARS = 40
MIN_DOCS = 5
#: Stands for a null id: smaller than every id.
NO_ID = -(1 << 63)

LINES = "hi long, lo long, doc long, text_hash long, line int"
#: kind 0: this line goes; 1: undecided, its hash touches a border; 2: carry (n_docs documents, doc the largest).
FOUND = f"kind byte, {LINES}, n_docs long"


def line_key(line: bytes) -> bytes:
    """The line without `[\\x20\\x09-\\x0D]` at its ends, A-Z lower-cased."""
    return line.strip(C.ASCII_SPACE).lower()


def long_enough(key: bytes, chars: int) -> bool:
    return len(key) >= chars and (len(key) >= 4 * chars or len(key.decode("utf-8", "replace")) >= chars)


def _hashed_lines(chars: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["hi", "lo", "doc", "text_hash", "line"]
        for batch in batches:
            doc, text_hash = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            data, offsets = C.text_bytes(batch.column(2))
            for a, b in C.slices(offsets):
                hashes, of, at = [], [], []
                for i in range(a, b):
                    text = data[offsets[i] : offsets[i + 1]].tobytes()
                    for n, line in enumerate(text.split(b"\n")):
                        key = line_key(line)
                        if long_enough(key, chars):
                            hashes.append(xxhash.xxh3_128_digest(key))
                            of.append(i)
                            at.append(n)
                if hashes:
                    halves = np.frombuffer(b"".join(hashes), dtype=np.int64).reshape(-1, 2)
                    columns = [halves[:, 0].copy(), halves[:, 1].copy(), doc[of], text_hash[of], np.array(at, np.int32)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)
        C.give_back()

    return rows


class _OpenKey:
    """The hash that a stream is at: rows wait in `held` until enough documents were seen."""

    def __init__(self, rows: dict[str, np.ndarray], border: bool):
        self.hi, self.lo, self.border = rows["hi"][0], rows["lo"][0], border
        self.largest = self.last = rows["doc"][0]
        self.n_docs, self.held = 1, []

    def continues(self, rows: dict[str, np.ndarray]) -> bool:
        return rows["hi"][0] == self.hi and rows["lo"][0] == self.lo

    def take(self, rows: dict[str, np.ndarray], least: int) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
        doc = rows["doc"]
        self.n_docs += int(doc[0] != self.last) + int(np.count_nonzero(doc[1:] != doc[:-1]))
        self.last = doc[-1]
        if self.border:
            yield 1, rows
        elif self.n_docs >= least:
            for part in [*self.held, rows]:
                other = part["doc"] != self.largest
                yield 0, {k: v[other] for k, v in part.items()}
            self.held = []
        else:
            self.held.append({k: v.copy() for k, v in rows.items()})

    def end(self, partition_ends: bool = False) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
        """Nothing more of this hash comes in this partition."""
        if self.border or partition_ends:
            yield from ((1, rows) for rows in self.held)
            one = {"hi": self.hi, "lo": self.lo, "doc": self.largest, "text_hash": 0, "line": 0}
            yield 2, {k: np.array([v], dtype=np.int32 if k == "line" else np.int64) for k, v in one.items()}


def _first_occurrences(least: int):
    """Stream a sorted partition; see step 3 above."""

    def batch_of(found: tuple[int, dict[str, np.ndarray]], n_docs: int = 0) -> pa.RecordBatch:
        kind, rows = found
        n = len(rows["hi"])
        columns = [np.full(n, kind, np.int8), *rows.values(), np.full(n, n_docs, np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["kind", *rows, "n_docs"])

    def part(rows: dict[str, np.ndarray], a: int, b: int) -> dict[str, np.ndarray]:
        return {k: v[a:b] for k, v in rows.items()}

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: _OpenKey | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = {name: np.asarray(batch.column(name)) for name in ("hi", "lo", "doc", "text_hash", "line")}
            hi, lo, doc = rows["hi"], rows["lo"], rows["doc"]
            change = (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])
            begin = np.flatnonzero(np.r_[True, change])
            end = np.r_[begin[1:], len(hi)]
            first = part(rows, 0, end[0])
            if key is None or not key.continues(first):
                if key is not None:
                    yield from (batch_of(f, key.n_docs) for f in key.end())
                key = _OpenKey(first, border=key is None)
            yield from (batch_of(f) for f in key.take(first, least))
            if len(begin) == 1:
                continue
            yield from (batch_of(f, key.n_docs) for f in key.end())
            if len(begin) > 2:  # hashes that begin and end in this batch
                a, b = begin[1], begin[-1]
                group = np.cumsum(change[a - 1 : b - 1]) - 1
                new_doc = np.r_[True, (doc[a + 1 : b] != doc[a : b - 1]) | (group[1:] != group[:-1])]
                docs = np.bincount(group[new_doc])
                goes = (docs[group] >= least) & (doc[a:b] != doc[begin[1:-1]][group])
                if goes.any():
                    yield batch_of((0, {k: v[a:b][goes] for k, v in rows.items()}))
            rest = part(rows, begin[-1], end[-1])
            key = _OpenKey(rest, border=False)
            yield from (batch_of(f) for f in key.take(rest, least))
        if key is not None:
            yield from (batch_of(f, key.n_docs) for f in key.end(partition_ends=True))
        C.give_back()

    return stream


def pack_bitmap(dropped: np.ndarray) -> bytes:
    """Deflated bits, lowest first: 1 where the line stays, as far as the byte of the last dropped line."""
    keep = np.ones((int(dropped.max()) // 8 + 1) * 8, dtype=bool)
    keep[dropped] = False
    return zlib.compress(np.packbits(keep, bitorder="little").tobytes(), 6)


def unpack_bitmap(bitmap: bytes | None, n_lines: int) -> np.ndarray:
    """Which of the lines stay; no bitmap: all."""
    keep = np.ones(n_lines, dtype=bool)
    if bitmap is not None:
        bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), bitorder="little")[:n_lines]
        keep[: len(bits)] = bits
    return keep


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(2)
        values, offsets = np.asarray(lists.flatten()), np.r_[0, np.cumsum(np.asarray(lists.value_lengths()))]
        packed = [pack_bitmap(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        n = pa.array(np.diff(offsets).astype(np.int64))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), n, pa.array(packed, pa.binary())],
            names=["doc", "text_hash", "n_dropped", "keep_bitmap"],
        )


def _identified(docs: DataFrame, text: str, doc_id: str):
    return (
        F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(NO_ID)).alias("doc"),
        F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("text_hash"),
    )


def line_keep_bitmaps(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", chars: int = MIN_CHARS, least: int = MIN_DOCS
) -> DataFrame:
    """(doc, text_hash, n_dropped, keep_bitmap) of the documents that lose lines."""
    spark = docs.sparkSession
    C.small_batches(spark)
    scratch = C.Scratch(spark, "lines")
    slim = docs.select(*_identified(docs, text, doc_id), F.col(f"`{text}`").alias("text"))
    # written first: the range partitioning samples its input, which then is this narrow table and not the texts
    lines = scratch.write(slim.mapInArrow(_hashed_lines(chars), LINES), "lines")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("hi"), F.col("lo"), F.col("doc").desc()]
    found = scratch.write(
        lines.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order, "text_hash", "line")
        .mapInArrow(_first_occurrences(least), FOUND),
        "found",
    )
    scratch.drop("lines")
    totals = found.filter("kind = 2").groupBy("hi", "lo").agg(F.sum("n_docs").alias("n"), F.max("doc").alias("largest"))
    border = found.filter("kind = 1").join(F.broadcast(totals.filter(F.col("n") >= least)), ["hi", "lo"])
    border = border.filter(F.col("doc") != F.col("largest"))
    dropped = found.filter("kind = 0").select("doc", "text_hash", "line")
    dropped = dropped.unionByName(border.select("doc", "text_hash", "line"))
    lists = dropped.groupBy("doc", "text_hash").agg(F.collect_set("line").alias("lines"))
    schema = "doc long, text_hash long, n_dropped long, keep_bitmap binary"
    return scratch.write(lists.mapInArrow(_bitmaps, schema), "bitmaps")


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(row, n_dropped, keep_bitmap): every row of `docs` as a struct, with its bitmap or null."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return docs.select(row, *_identified(docs, text, doc_id)).join(bitmaps, ["doc", "text_hash"], "left").select(
        "row", F.coalesce("n_dropped", F.lit(0).cast("long")).alias("n_dropped"), "keep_bitmap"
    )


def _kept(text: bytes, bitmap: bytes | None) -> tuple[int, bytes]:
    lines = text.split(b"\n")
    if bitmap is None:
        return len(lines), text
    keep = unpack_bitmap(bitmap, len(lines))
    return len(lines), b"\n".join([line for line, stays in zip(lines, keep, strict=True) if stays])


def deduplicated(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """The rows of `docs` with their repeated lines removed from `text`; a null text stays null."""

    @F.pandas_udf(T.StringType())
    def kept(texts, bitmaps):
        return texts.combine(bitmaps, lambda t, b: None if t is None else _kept(t.encode(), b)[1].decode())

    joined = with_bitmaps(docs, line_keep_bitmaps(docs, text, doc_id, **options), text, doc_id)
    cleaned = F.when(F.col("keep_bitmap").isNull(), F.col(f"row.`{text}`"))
    cleaned = cleaned.otherwise(kept(F.col(f"row.`{text}`"), F.col("keep_bitmap")))
    return joined.select(*[(cleaned if c == text else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_lines, digests = [], []
        data, offsets = C.text_bytes(batch.column(1))
        for i, bitmap in enumerate(batch.column(3).to_pylist()):
            n, kept = _kept(data[offsets[i] : offsets[i + 1]].tobytes(), bitmap)
            n_lines.append(n)
            digests.append(hashlib.sha256(kept).hexdigest())
        columns = [batch.column(0), pa.array(n_lines, pa.int64()), batch.column(2), pa.array(digests, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])
    C.give_back()


def line_report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_lines, n_dropped, kept_sha256."""
    slim = docs.select("doc_id", "text")
    joined = with_bitmaps(slim, line_keep_bitmaps(slim)).select("row.doc_id", "row.text", "n_dropped", "keep_bitmap")
    schema = T.StructType([docs.schema["doc_id"]]).add("n_lines", "long").add("n_dropped", "long").add("kept_sha256", "string")
    return joined.mapInArrow(_digests, schema)
