"""Importance resampling towards a target distribution over hashed word n-grams, by batch concatenation.

1. Texts are taken in slices: their bytes are lower-cased, joined with a sentinel byte between documents, and one regex
   pass finds all words and sentinels. The sentinels' places are the document offsets in that list of words:
   `searchsorted` tells the document of every word, and word pairs that touch a sentinel are masked.
2. The CRC-32 of a word comes from zlib. That of "a b" is combined from those of a and b (CRC is linear: appending n bytes
   multiplies by a matrix that depends on n alone, kept as byte tables), so no pair is ever spelled out.
3. Every task sums its buckets with `bincount` and emits one row per bucket; Spark adds them up. The log ratios of all
   buckets (`buckets` numbers, a parameter, not data) go to the tasks that score documents in a second pass.
4. Scores are perturbed by Gumbel noise keyed by the id, so that the highest scores are a sample without replacement,
   the same in every run. Ranks come from one range exchange of narrow rows: the position in the partition plus the rows
   of the partitions before it. Nothing is sorted in one partition.

Edge cases: a null, empty or wordless text has no features and weight 0; a null id is hashed as an empty id and comes
before all others among ties; repeated rows are rows of their own, with equal scores if their texts are equal (rows of one
id that tie are ordered by their number of features, equal rows in any order); columns other than those named are carried
along whatever they are called; an empty corpus gives an empty result, an empty target makes gains out of the corpus alone.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ledgerlens.llm import common as C

#: Fixed by the contract.
BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 25
SEED = 7

#: Words as `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of lower-cased text, in UTF-8, or the sentinel.
TOKEN = re.compile(rb"[0-9a-z\x80-\xff]+|\x00")
SENTINEL = b"\x00"
#: A-Z become a-z; a zero byte, no part of any word, becomes a blank, so that the sentinel stands for itself alone.
FOLD = bytes(32 if b == 0 else b + 32 if 65 <= b <= 90 else b for b in range(256))

#: Words of fewer bytes have a table of their own for appending them; longer ones take further steps.
SHORT = 64


def _crc_steps() -> dict[str, np.ndarray]:
    """`byte`: the CRC-32 table. `short`: 4 byte tables for each number of zero bytes below SHORT. `jumps`: 2**j bytes."""
    kept = C.worker_store()
    if "crc" in kept:
        return kept["crc"]
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    bits = (np.arange(256)[:, None] >> np.arange(8)) & 1 == 1

    def byte_tables(columns: np.ndarray) -> np.ndarray:
        groups = [np.where(bits, columns[8 * k : 8 * k + 8], 0).astype(np.uint32) for k in range(4)]
        return np.concatenate([np.bitwise_xor.reduce(g, axis=1) for g in groups])

    columns, short = np.uint32(1) << np.arange(32, dtype=np.uint32), []
    for _ in range(SHORT):
        short.append(byte_tables(columns))
        columns = table[columns & 255] ^ (columns >> 8)
    jumps = [byte_tables(columns)]
    for _ in range(30):  # twice the same step: 2 * SHORT bytes and so on
        columns = _apply(jumps[-1], 0, columns)
        jumps.append(byte_tables(columns))
    kept["crc"] = {"byte": table, "short": np.concatenate(short), "jumps": np.stack(jumps)}
    return kept["crc"]


def _apply(tables: np.ndarray, base, crc: np.ndarray) -> np.ndarray:
    return (
        tables[base + (crc & 255)]
        ^ tables[base + 256 + ((crc >> 8) & 255)]
        ^ tables[base + 512 + ((crc >> 16) & 255)]
        ^ tables[base + 768 + (crc >> 24)]
    )


def joined_crc(left: np.ndarray, right: np.ndarray, right_bytes: np.ndarray) -> np.ndarray:
    """CRC-32 of "a b" from those of a and b and the bytes of b."""
    steps = _crc_steps()
    inner = ~left
    crc = ~(steps["byte"][(inner ^ np.uint32(32)) & 255] ^ (inner >> 8))  # a blank appended
    crc = _apply(steps["short"], (right_bytes % SHORT) * 1024, crc)
    rest = right_bytes // SHORT
    j = 0
    while rest.any():
        odd = np.flatnonzero(rest & 1)
        crc[odd] = _apply(steps["jumps"][j], 0, crc[odd])
        rest = rest >> 1
        j += 1
    return crc ^ right


def features(texts: list[bytes], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, bucket) of every run of one or two words, and the number of words by document."""
    tokens = TOKEN.findall(SENTINEL.join(texts))
    crc = np.fromiter(map(zlib.crc32, tokens), np.uint32, len(tokens))
    size = np.fromiter(map(len, tokens), np.int64, len(tokens))
    stop = (size == 1) & (crc == np.uint32(zlib.crc32(SENTINEL)))
    offsets = np.flatnonzero(stop)
    document = np.searchsorted(offsets, np.arange(len(tokens)))
    word = ~stop
    pair = np.flatnonzero(word[1:] & word[:-1])
    pairs = joined_crc(crc[pair], crc[pair + 1], size[pair + 1])
    bucket = np.r_[crc[word], pairs].astype(np.int64) % buckets
    return np.r_[document[word], document[pair]], bucket, np.bincount(document[word], minlength=len(texts))


def _slices_of(column: pa.Array) -> Iterator[tuple[int, int, list[bytes]]]:
    data, offsets = C.text_bytes(column)
    for a, b in C.slices(offsets):
        low = data[offsets[a] : offsets[b]].tobytes().translate(FOLD)
        at = (offsets[a : b + 1] - offsets[a]).tolist()
        yield a, b, [low[x:y] for x, y in zip(at[:-1], at[1:], strict=True)]


def _counted(buckets: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, texts in _slices_of(batch.column(0)):
                total += np.bincount(features(texts, buckets)[1], minlength=buckets)
        found = np.flatnonzero(total)
        if len(found):
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["bucket", "n"])
        C.give_back()

    return rows


def bucket_counts(docs: DataFrame, text: str = "text", buckets: int = BUCKETS) -> dict[int, int]:
    """Features by bucket over all rows; `buckets` numbers at most reach the driver."""
    C.small_batches(docs.sparkSession)
    slim = docs.select(F.col(f"`{text}`").cast("string").alias("text"))
    counts = slim.mapInArrow(_counted(buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    return {row["bucket"]: row["n"] for row in counts.collect()}


def bucket_gains(corpus: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> np.ndarray:
    """Thousandths of the log ratio of the two smoothed bucket distributions, floored."""
    all_corpus, all_target = float(sum(corpus.values())), float(sum(target.values()))
    gains = [
        math.floor(
            1000.0
            * math.log(
                ((target.get(b, 0) + 1.0) * (all_corpus + buckets)) / ((corpus.get(b, 0) + 1.0) * (all_target + buckets))
            )
        )
        for b in range(buckets)
    ]
    return np.array(gains, dtype=np.int64)


def _weighed(gains: np.ndarray, carried: int):
    """Carried columns, then the text; instead of the text n_words, n_features and weight."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            n_words, n_features, weight = (np.zeros(n, np.int64) for _ in range(3))
            for a, b, texts in _slices_of(batch.column(carried)):
                document, bucket, found = features(texts, len(gains))
                count = np.bincount(document, minlength=b - a)
                total = np.bincount(document, weights=gains[bucket], minlength=b - a).astype(np.int64)  # exact below 2**53
                n_words[a:b], n_features[a:b] = found, count
                weight[a:b] = np.where(count > 0, total // np.maximum(count, 1), 0)
            names = [*batch.schema.names[:carried], "n_words", "n_features", "weight"]
            arrays = [*batch.columns[:carried], *map(pa.array, (n_words, n_features, weight))]
            yield pa.RecordBatch.from_arrays(arrays, names=names)
        C.give_back()

    return rows


def gumbel_noise(doc_id: Column, seed: int) -> Column:
    """Thousandths of a Gumbel number from a hash of the id, floored."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def importance_ranks(
    docs: DataFrame, target: DataFrame, text: str = "text", doc_id: str = "doc_id", percent: int = PERCENT,
    min_words: int = MIN_WORDS, buckets: int = BUCKETS, seed: int = SEED, keep: list[str] | None = None,
) -> DataFrame:
    """The rows of `docs` (columns `keep`, by default all, in a struct `row`) with n_words, n_features, weight, score, rank."""
    spark = docs.sparkSession
    C.small_batches(spark)
    scratch = C.Scratch(spark, "resampling")
    gains = bucket_gains(bucket_counts(docs, text, buckets), bucket_counts(target, text, buckets), buckets)
    row = F.struct(*[F.col(f"`{c}`") for c in (docs.columns if keep is None else keep)]).alias("row")
    slim = docs.select(row, F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    measures = [T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight")]
    weighed = slim.mapInArrow(_weighed(gains, 2), T.StructType([*slim.schema.fields[:2], *measures]))
    scored = scratch.write(weighed.withColumn("score", F.col("weight") + gumbel_noise(F.col("id"), seed)), "scored")
    open_rows = scored.filter(F.col("n_words") >= min_words)
    drawn = open_rows.count() * percent // 100
    order = [F.col("score").desc(), F.col("id").asc_nulls_first(), F.col("n_features")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = scratch.write(
        open_rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()),
        "placed",
    ).withColumn("part", F.shiftright("at", 33))
    counts = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = F.sum("n").over(W.partitionBy(F.lit(0)).orderBy("part")) - F.col("n")  # a row per partition
    shift = F.broadcast(counts.select("part", (before - F.col("first") + 1).alias("shift")))
    rank = F.col("at") + F.col("shift")
    ranked = placed.join(shift, "part").withColumn("rank", F.when(rank <= drawn, rank))
    columns = ["row", "id", "n_words", "n_features", "weight", "score", "rank"]
    rest = scored.filter(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.select(*columns).unionByName(rest.select(*columns))


def resampled(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn rows themselves, with the columns of `docs`."""
    return importance_ranks(docs, target, **options).filter(F.col("rank").isNotNull()).select("row.*")


def resampling_report(docs: DataFrame, target: DataFrame) -> DataFrame:
    """Per document: doc_id, n_features, weight, score, rank."""
    ranks = importance_ranks(docs, target, keep=["doc_id"])
    return ranks.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")
