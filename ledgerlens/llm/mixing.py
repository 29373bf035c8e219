"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Every document of a source is expected `rate = target / source size` times. The documents of a source stand in order
of size (then of the id), so their prefix sums are `rate * rank`; with one random offset `u` a document
is emitted once for every integer between `u + rate * (rank - 1)` and `u + rate * rank`. The order by size makes
the sampling stratified: equal numbers of copies fall on every size range, so the words taken come near the target.

Scale: one range exchange by (source, size, id) splits a hot source and a hot size evenly. The rank inside
a partition is the row's position in it (`monotonically_increasing_id` of the sorted partition, written once), and
a table of one row per (partition, source) carries the ranks across partitions. No window runs over documents.

Edge cases: a null or empty text has size 0 and takes nothing of the target (its copies count 0 words); null is
a source of its own and comes last; repeated rows, also with equal ids, are rows of their own; a null id is a value;
columns other than those named are carried along whatever they are called; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ledgerlens.llm.common import Scratch

#: Fixed by the contract: weights by the rank of the source, and the most copies of a source's words.
WEIGHTS = (1, 2, 3)
MOST_COPIES = 3
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` in the text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, scratch: Scratch, weights=WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    The weight goes by the rank of the source in code point order, null last. Ranks come from a range partitioning,
    not from one sorted partition. A source is capped when `most * size * W < rest * weight` over the sources still
    open; rounds of that test end when no further source is capped, and in each only two sums reach the driver. All
    compared values are integers, so the targets do not depend on the order of sums.
    """
    spark = sources.sparkSession
    ordered = sources.withColumn("_null", F.col("source").isNull())
    placed = scratch.write(
        ordered.repartitionByRange(8, "_null", "source")
        .sortWithinPartitions("_null", "source")
        .withColumn("_at", F.monotonically_increasing_id()),
        "sources",
    ).withColumn("_part", F.shiftright("_at", 33))
    parts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = F.sum("_n").over(W.orderBy("_part")) - F.col("_n")  # a row per partition: eight at most
    rank = placed.join(parts.select("_part", "_first", before.alias("_before")), "_part").withColumn(
        "_rank", F.col("_before") + F.col("_at") - F.col("_first")
    )
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    weighed = scratch.write(rank.select("source", "source_size", weight.cast("long").alias("_w")), "weights")
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    rest, open_weight, capped = total, None, F.lit(False)
    while True:
        size = F.col("source_size").cast("decimal(38,0)")
        row = weighed.filter(~capped).agg(F.sum("_w").alias("w"), F.sum("source_size").alias("s")).first()
        now, rest = row["w"] or 0, total - most * (total - (row["s"] or 0))
        if now == open_weight or now == 0:
            break
        open_weight = now
        capped = size * most * F.lit(now).cast("decimal(38,0)") < F.lit(rest).cast("decimal(38,0)") * F.col("_w")
    share = (F.lit(float(rest)) * F.col("_w").cast("double")) / F.lit(float(max(open_weight or 1, 1)))
    target = F.when(capped, (F.col("source_size") * most).cast("double")).otherwise(share)
    return weighed.select("source", "source_size", target.alias("target"))


def systematic_copies(
    docs: DataFrame, source: str = "source", text: str = "text", order: str = "doc_id", seed: int = 17,
    weights=WEIGHTS, most: int = MOST_COPIES, keep: list[str] | None = None,
) -> DataFrame:
    """The rows of `docs` (columns `keep`, by default all) with size, source_size, target and copies in one struct `mix`."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    kept = F.struct(*[F.col(f"`{c}`") for c in (docs.columns if keep is None else keep)]).alias("row")
    rows = docs.select(kept, F.col(source).alias("source"), word_count(F.col(text)).alias("size"), F.col(order).alias("id"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sort = [F.col("source").asc_nulls_last(), F.col("size").asc(), F.col("id").asc_nulls_last()]
    placed = scratch.write(
        rows.repartitionByRange(parts, *sort).sortWithinPartitions(*sort).withColumn("at", F.monotonically_increasing_id()),
        "rows",
    ).withColumn("part", F.shiftright("at", 33))
    counts = scratch.write(
        placed.groupBy("part", "source").agg(
            F.count(F.lit(1)).alias("n"), F.min("at").alias("first"), F.sum("size").alias("words")
        ),
        "counts",
    )
    targets = source_targets(counts.groupBy("source").agg(F.sum("words").alias("source_size")), scratch, weights, most)
    spread = W.partitionBy("source").orderBy("part")  # a row per partition of the source
    runs = counts.select("part", "source", "first", (F.sum("n").over(spread) - F.col("n")).alias("before"))
    runs = scratch.write(
        runs.join(targets.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s"), "runs"
    )
    joined = placed.alias("d").join(
        runs.alias("r"), (F.col("d.part") == F.col("r.part")) & F.col("d.source").eqNullSafe(F.col("r.source"))
    )
    rank = F.col("r.before") + F.col("d.at") - F.col("r.first")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    # one offset in (0, 1) per source, the same in every run: twenty bits of a hash
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("s"), F.col("d.source")), F.lit("null")))
    offset = (F.conv(F.substring(F.md5(name), 1, 5), 16, 10).cast("double") + 0.5) / float(1 << 20)
    crossed = F.floor(offset + rate * (rank + 1)) - F.floor(offset + rate * rank)
    copies = F.when(rate >= most, F.lit(most)).otherwise(F.least(crossed, F.lit(most))).cast("int")
    return joined.select(
        "d.row",
        F.struct(F.col("d.size").alias("size"), F.col("source_size"), F.col("target"), copies.alias("copies")).alias("mix"),
    )


def mixed_report(docs: DataFrame, seed: int = 17) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken."""
    out = systematic_copies(docs, seed=seed, keep=["doc_id"])
    return out.select(
        F.col("row.doc_id").alias("doc_id"),
        F.col("mix.size").alias("size"),
        F.col("mix.source_size").alias("source_size"),
        F.col("mix.target").alias("target"),
        (F.col("mix.size") * F.col("mix.copies")).alias("taken"),
    )


def mixed_documents(docs: DataFrame, seed: int = 17) -> DataFrame:
    """The mix itself: every document as often as it was drawn, with the columns of `docs`."""
    out = systematic_copies(docs, seed=seed).filter(F.col("mix.copies") > 0)
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("mix.copies")))).select("row.*")
