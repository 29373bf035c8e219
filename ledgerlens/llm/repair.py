"""Token ids in Re-Pair compressed shard files with random access.

Documents are range-partitioned by id, tokenised, and cut into shards of about SHARD_TOKENS ids. A shard is
compressed on its own: pairs of neighbouring symbols that occur often become nonterminals, again and again. A round
replaces all pairs that occur at least MIN_COUNT times (at most ROUND_RULES of them, most frequent first, a position
going to the pair that starts first), so a shard takes a few vector passes instead of one pass per rule; what it
yields is a grammar like any other Re-Pair grammar.

File format, version 1 (little-endian), one shard per Parquet row in column `shard`:

    4 bytes "RPR1" | u32 terminals | u32 rules | u32 symbols | u32 documents
    rules x (u32 left, u32 right)      symbol `terminals + i` expands to the two symbols of rule i
    rules x u32                        expansion length of each rule, in ids
    documents x u32                    ids of each document, with its end id
    documents x u32                    symbols of each document: no symbol crosses a document border
    u8 width (2 or 4) | symbols x width bytes

Document i of a shard is decoded from its own symbols; an id inside a document is found through the expansion
lengths without decoding what stands before it (`decode_range`). Columns beside `shard`: doc_ids, the partition, and
the ids that stand before the shard within its partition. Spark's writer commits the files, so a lost task is
written again.

Edge cases: null and empty texts are the end id alone; repeated ids and rows are encoded each, in order of id and text;
null ids come first; a text of any length is encoded whole; an empty table gives no shard and no row; other columns
are not read.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlens.llm import common as C

END_ID = 0
SHARD_TOKENS = 1 << 20
MIN_COUNT = 24
ROUND_RULES = 4096
ROUNDS = 6
#: Distinct pieces of text whose ids a worker remembers.
REMEMBERED = 2_000_000

def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Encodes texts with the tokenizers library, each distinct piece of text once.

    Byte-level pre-tokenisation never joins characters across a single blank between two characters that are not white
    space; the blank belongs to what follows. So texts are cut there, and the pieces are encoded on their own. Pieces
    are known by 64-bit hashes; the bytes of a text's tokens are counted against the text. A text that may hold a
    special token goes to the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        # byte-level tokens are spelled with one character per byte
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        for token, i in vocabulary.items():
            self.bytes_of[i] = len(token)
        self.special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(0, dtype=np.uint64)  # sorted hashes of the known pieces
        self.row = np.zeros(0, dtype=np.int32)  # their rows in what follows
        self.place = np.zeros(0, dtype=np.int64)  # where a piece's ids begin, and how many they are
        self.count = np.zeros(0, dtype=np.int64)
        self.seen = np.zeros(0, dtype=np.int32)  # slices of text that held the piece
        self.flat = np.zeros(0, dtype=np.uint32)

    def trim(self) -> None:
        """Keeps the pieces that were met again, the better half at most; what is dropped is encoded anew if it returns."""
        half = REMEMBERED // 2
        least = max(2, int(np.partition(self.seen, -half)[-half]) + 1)
        keep = self.seen[self.row] >= least
        rows = self.row[keep]
        self.keys, self.row = self.keys[keep], np.arange(len(rows), dtype=np.int32)
        self.flat = self.flat[C.ragged(self.place[rows], self.count[rows])]
        self.count, self.seen = self.count[rows], self.seen[rows] // 2
        self.place = np.cumsum(self.count) - self.count

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch(texts, add_special_tokens=False)]

    def learn(self, data: np.ndarray, keys: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        """Encode new pieces: those that begin with a blank as one text, whose tokens' bytes say which ends where."""
        blank = data[start] == 32
        own = np.r_[np.flatnonzero(blank), np.flatnonzero(~blank)]
        keys, start, end = keys[own], start[own], end[own]
        n = int(blank.sum())
        joined = data[C.ragged(start[:n], (end - start)[:n])].tobytes().decode()
        rest = [data[a:b].tobytes().decode() for a, b in zip(start[n:].tolist(), end[n:].tolist(), strict=True)]
        first, *coded = self.whole([joined, *rest])
        ids = np.array(first, dtype=np.uint32)
        ends = np.searchsorted(np.cumsum(self.bytes_of[ids]), np.cumsum((end - start)[:n])) + 1
        counts = np.r_[np.diff(np.r_[0, ends]), np.array([len(c) for c in coded], dtype=np.int64)].astype(np.int64)
        ids = np.concatenate([ids, np.fromiter(chain.from_iterable(coded), dtype=np.uint32)])
        order = np.argsort(keys)
        at = np.searchsorted(self.keys, keys[order])
        self.keys = np.insert(self.keys, at, keys[order])
        self.row = np.insert(self.row, at, (len(self.place) + order).astype(np.int32))
        self.place = np.concatenate([self.place, len(self.flat) + np.cumsum(counts) - counts])
        self.count = np.concatenate([self.count, counts])
        self.seen = np.concatenate([self.seen, np.zeros(len(counts), np.int32)])
        self.flat = np.concatenate([self.flat, ids])

    def cuts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where pieces begin: at texts, and at single blanks between characters that are surely no white space."""
        at = np.flatnonzero(data == 32)
        at = at[(at > 0) & (at + 1 < len(data))]
        before, after = data[at - 1], data[at + 1]
        good = (before > 32) & (before != 127) & (after > 32) & (after != 127)
        # white space beyond ASCII begins with these bytes
        good &= ~np.isin(after, (0xC2, 0xE1, 0xE2, 0xE3))
        good &= ~((before >= 128) & ((data[np.maximum(at - 2, 0)] == 0xC2) | np.isin(data[np.maximum(at - 3, 0)], (0xE1, 0xE2, 0xE3))))
        at = at[good]
        doc = np.searchsorted(offsets, at, side="right") - 1
        at = at[(at > offsets[doc]) & (at + 1 < offsets[doc + 1])]
        return np.sort(np.concatenate([offsets[:-1][np.diff(offsets) > 0], at]))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each closed by the end id, ids by text) of texts as UTF-8 bytes."""
        if len(self.keys) > REMEMBERED:
            self.trim()
        start = self.cuts(data, offsets)
        end = np.append(start[1:], len(data))
        hashes = C.span_hash(C.prefix_hash(data), start, end)
        keys, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        new = self.keys[at] != keys if len(self.keys) else np.ones(len(keys), bool)
        if new.any():
            self.learn(data, keys[new], start[first[new]], end[first[new]])
            at = np.searchsorted(self.keys, keys)
        rows = self.row[at]
        self.seen[rows] += 1
        rows = rows[inverse]
        counts = self.count[rows]
        flat = self.flat[C.ragged(self.place[rows], counts)]
        ends = np.r_[0, np.cumsum(counts)][np.searchsorted(start, offsets)]
        sizes = np.diff(ends)
        spelled = np.r_[0, np.cumsum(self.bytes_of[flat])][ends]
        hard = np.flatnonzero(np.diff(spelled) != np.diff(offsets)).tolist()
        texts = data.tobytes()
        for token in self.special:
            if token in texts:
                hard += [i for i in range(len(sizes)) if token in texts[offsets[i] : offsets[i + 1]]]
        parts, last = [], 0
        for i in sorted(set(hard)):
            ids = np.array(self.whole([texts[offsets[i] : offsets[i + 1]].decode()])[0], dtype=np.uint32)
            parts += [flat[last : ends[i]], ids]
            last, sizes[i] = ends[i + 1], len(ids)
        flat = np.concatenate([*parts, flat[last:]]) if parts else flat
        return np.insert(flat, np.cumsum(sizes), END_ID), sizes + 1


def worker_encoder(path: str) -> Encoder:
    """One encoder per worker, so that pieces are remembered from task to task."""
    kept = C.worker_store()
    if path not in kept.setdefault("encoders", {}):
        kept["encoders"][path] = Encoder(path)
    return kept["encoders"][path]


def _coarse(code: np.ndarray) -> np.ndarray:
    """Sixteen bits of a pair."""
    return ((code * code.dtype.type(0x9E3779B1)) >> code.dtype.type(code.dtype.itemsize * 8 - 16)).astype(np.int64)


def replace_pairs(seq: np.ndarray, doc: np.ndarray, next_symbol: int, min_count: int, most: int):
    """One round: (new sequence, its documents, rules as (left, right)) or None if no pair is frequent."""
    if len(seq) < 2:
        return None
    kind, half = (np.uint32, 16) if next_symbol <= 1 << 16 else (np.uint64, 32)  # narrow codes sort faster
    code = (seq[:-1].astype(kind) << kind(half)) | seq[1:].astype(kind)
    inside = doc[:-1] == doc[1:]
    ordered = np.sort(code[inside])
    if not len(ordered):
        return None
    edges = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1], True])
    n = np.diff(edges)
    good = np.flatnonzero(n >= min_count)
    if not len(good):
        return None
    if len(good) > most:
        good = good[np.argsort(-n[good], kind="stable")[:most]]
    pairs = ordered[edges[good]]
    # a table by sixteen bits of the pair; pairs that share a place wait for a later round
    table = np.full(1 << 16, -1, dtype=np.int32)
    table[_coarse(pairs)[::-1]] = np.arange(len(pairs), dtype=np.int32)[::-1]
    rule = table[_coarse(code)]
    at = np.flatnonzero((rule >= 0) & inside)
    rule = rule[at]
    hit = pairs[rule] == code[at]
    at, rule = at[hit], rule[hit]
    used = np.bincount(rule, minlength=len(pairs)) > 0
    rule, pairs = (np.cumsum(used) - 1)[rule], pairs[used]
    # overlapping pairs: of positions in a row every second one, from the first
    run = np.r_[True, at[1:] != at[:-1] + 1]
    begin = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
    take = (np.arange(len(at)) - begin) % 2 == 0
    at, rule = at[take], rule[take]
    out = seq.copy()
    out[at] = next_symbol + rule
    keep = np.ones(len(seq), dtype=bool)
    keep[at + 1] = False
    rules = np.stack([(pairs >> kind(half)).astype(np.uint32), (pairs & kind((1 << half) - 1)).astype(np.uint32)], axis=1)
    return out[keep], doc[keep], rules


def compress(ids: np.ndarray, sizes: np.ndarray, terminals: int, min_count: int = MIN_COUNT, rounds: int = ROUNDS) -> bytes:
    """The shard of documents whose ids follow each other in `ids`."""
    seq = ids.astype(np.uint32)
    doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    rules, lengths = [], np.ones(terminals, dtype=np.uint32)
    for _ in range(rounds):
        step = replace_pairs(seq, doc, terminals + sum(map(len, rules)), min_count, ROUND_RULES)
        if step is None:
            break
        before = len(seq)
        seq, doc, new = step
        rules.append(new)
        lengths = np.concatenate([lengths, lengths[new[:, 0]] + lengths[new[:, 1]]])
        if len(seq) > 0.97 * before:
            break
    grammar = np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)
    width = 2 if terminals + len(grammar) <= 1 << 16 else 4
    head = struct.pack("<4sIIII", b"RPR1", terminals, len(grammar), len(seq), len(sizes))
    counts = np.bincount(doc, minlength=len(sizes)).astype("<u4")
    return b"".join(
        [
            head,
            grammar.astype("<u4").tobytes(),
            lengths[terminals:].astype("<u4").tobytes(),
            sizes.astype("<u4").tobytes(),
            counts.tobytes(),
            bytes([width]),
            seq.astype(f"<u{width}").tobytes(),
        ]
    )


class Shard:
    """A shard file's content, decoded on demand."""

    def __init__(self, data: bytes):
        magic, self.terminals, rules, symbols, documents = struct.unpack_from("<4sIIII", data)
        if magic != b"RPR1":
            raise ValueError("not a shard of this format")
        at = 20

        def read(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, dtype=kind, count=n, offset=at)
            at += out.nbytes
            return out

        self.rules = read("<u4", 2 * rules).reshape(-1, 2)
        self.lengths = np.concatenate([np.ones(self.terminals, np.int64), read("<u4", rules).astype(np.int64)])
        self.sizes = read("<u4", documents).astype(np.int64)
        counts = read("<u4", documents).astype(np.int64)
        width = read("u1", 1)[0]
        self.symbols = read(f"<u{width}", symbols).astype(np.int64)
        self.first = np.r_[0, np.cumsum(counts)]

        ids = self._levels(self.terminals + np.arange(rules))
        own = self.lengths[self.terminals :]
        self.flat = np.concatenate([np.arange(self.terminals, dtype=np.uint32), ids])
        self.place = np.concatenate([np.arange(self.terminals), self.terminals + np.cumsum(own) - own])

    def _levels(self, symbols: np.ndarray) -> np.ndarray:
        """Replaces nonterminals by their two sides until only ids are left."""
        while len(symbols) and symbols.max() >= self.terminals:
            big = symbols >= self.terminals
            start = np.arange(len(symbols)) + np.cumsum(big) - big
            out = np.empty(len(symbols) + int(big.sum()), dtype=np.int64)
            out[start[~big]] = symbols[~big]
            sides = self.rules[symbols[big] - self.terminals]
            out[start[big]], out[start[big] + 1] = sides[:, 0], sides[:, 1]
            symbols = out
        return symbols.astype(np.uint32)

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """The ids that the symbols stand for, from the expanded rules."""
        return self.flat[C.ragged(self.place[symbols], self.lengths[symbols])]

    def document(self, i: int) -> np.ndarray:
        return self.expand(self.symbols[self.first[i] : self.first[i + 1]])

    def decode_range(self, i: int, start: int, end: int) -> np.ndarray:
        """Ids [start, end) of document i: only the symbols that reach into the range are expanded."""
        own = self.symbols[self.first[i] : self.first[i + 1]]
        ends = np.cumsum(self.lengths[own])
        a, b = np.searchsorted(ends, start, side="right"), np.searchsorted(ends, end, side="left") + 1
        before = ends[a - 1] if a else 0
        return self.expand(own[a:b])[start - before : end - before]


def _write_shards(path: str, shard_tokens: int, min_count: int, rounds: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(path)
        terminals = encoder.library.get_vocab_size(with_added_tokens=True)
        doc_ids: list = []
        ids: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        held, before, part = 0, 0, 0

        def shard() -> pa.RecordBatch:
            nonlocal doc_ids, ids, sizes, held, before
            blob = compress(np.concatenate(ids), np.concatenate(sizes), terminals, min_count, rounds)
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()),
                    pa.array([before], pa.int64()),
                    pa.array([held], pa.int64()),
                    pa.array([doc_ids], pa.list_(pa.int64())),
                    pa.array([blob], pa.binary()),
                ],
                names=["part", "before", "n_tokens", "doc_ids", "shard"],
            )
            before += held
            doc_ids, ids, sizes, held = [], [], [], 0
            return out

        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column(2)[0].as_py()
            names = batch.column(0).to_pylist()
            data, offsets = C.text_bytes(batch.column(1))
            for a, b in C.slices(offsets, 2 * C.SLICE_BYTES):
                flat, n = encoder.encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                ids.append(flat)
                sizes.append(n)
                doc_ids += names[a:b]
                held += len(flat)
                if held >= shard_tokens:
                    yield shard()
        if doc_ids:
            yield shard()
        C.give_back()

    return run


SHARDS = "part int, before long, n_tokens long, doc_ids array<long>, shard binary"


def write_shards(
    docs: DataFrame, path: str, tokenizer: str | None = None, shard_tokens: int = SHARD_TOKENS,
    min_count: int = MIN_COUNT, rounds: int = ROUNDS,
) -> None:
    """Encode the texts in ascending order of doc_id and write the shard files to `path`."""
    spark = docs.sparkSession
    C.small_batches(spark)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = slim.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    run = _write_shards(tokenizer or default_tokenizer(), shard_tokens, min_count, rounds)
    ordered.select("doc_id", "text", F.spark_partition_id().alias("part")).mapInArrow(run, SHARDS).write.mode(
        "overwrite"
    ).parquet(path)


def _read_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            shard = Shard(batch.column(2)[i].as_py())
            ids = shard.expand(shard.symbols).astype("<u4")
            ends = np.cumsum(shard.sizes)
            starts = ends - shard.sizes
            crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)]
            first = batch.column(0)[i].as_py()
            yield pa.RecordBatch.from_arrays(
                [batch.column(1)[i].values, pa.array(first + starts), pa.array(shard.sizes), pa.array(crc, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def read_shards(spark, path: str) -> DataFrame:
    """Per document, decoded from the files: doc_id, start, n_tokens, ids_crc32."""
    C.small_batches(spark)
    files = spark.read.schema(SHARDS).parquet(path)
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    ahead = totals.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("ahead"))  # a row per partition
    # as many rows as the range partitioning had partitions: small beside the shards, which then need no shuffle
    placed = files.join(F.broadcast(ahead), "part").select((F.col("ahead") + F.col("before")).alias("start"), "doc_ids", "shard")
    return placed.mapInArrow(_read_shards, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_report(docs: DataFrame, path: str | None = None, tokenizer: str | None = None) -> DataFrame:
    """Write the shards of `docs` and read them back."""
    path = path or f"{C.Scratch(docs.sparkSession, 'tokens').root}/shards"
    write_shards(docs, path, tokenizer)
    return read_shards(docs.sparkSession, path)
