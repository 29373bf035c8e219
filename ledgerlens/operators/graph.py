"""The relationship graph: officers, borrowers and guarantors, their links, and suspicious clusters.

Ids carry a type prefix (`O:`, `B:`, `G:`), so that an officer and a borrower of the same number stay apart, and a
guarantor's id is a hash of the whole name. Groups of borrowers are linked as stars around their smallest member:
linear in the group, with the same components as all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ledgerlens.functions.groups import first_values
from ledgerlens.session import Scratch, written_table

NODE_COLUMNS = ["id", "name", "type", "risk", "loan_count", "amount"]


def _officer(column: str = "officer_id") -> Column:
    return F.concat(F.lit("O:"), F.col(column).cast("string"))


def _borrower(column: str = "borrower_id") -> Column:
    return F.concat(F.lit("B:"), F.col(column).cast("string"))


def _guarantor(column: str = "guarantor_name") -> Column:
    return F.concat(F.lit("G:"), F.sha2(F.col(column), 256))


def _is_fraud(loans: DataFrame) -> Column:
    return F.coalesce(F.col("is_fraud"), F.lit(False)) if "is_fraud" in loans.columns else F.lit(False)


def officer_nodes(loans: DataFrame, high_from: int = 50) -> DataFrame:
    known = loans.filter(F.col("officer_id").isNotNull())
    return (
        known.groupBy("officer_id")
        .agg(F.count(F.lit(1)).alias("loan_count"), F.min_by("officer_name", "loan_id").alias("name"))
        .select(
            _officer().alias("id"),
            F.coalesce("name", F.col("officer_id").cast("string")).alias("name"),
            F.lit("officer").alias("type"),
            F.when(F.col("loan_count") > high_from, "high").otherwise("low").alias("risk"),
            "loan_count",
            F.lit(None).cast("double").alias("amount"),
        )
    )


def shared_phones(loans: DataFrame) -> DataFrame:
    """Phones of several borrowers with the smallest of them, written once: one row per phone."""
    pairs = loans.dropna(subset=["phone_number", "borrower_id"])
    shared = (
        pairs.groupBy("phone_number")
        .agg(F.count_distinct("borrower_id").alias("borrowers"), F.min("borrower_id").alias("hub"))
        .filter(F.col("borrowers") > 1)
    )
    return written_table(shared, "shared-phones")


def borrower_nodes(loans: DataFrame, shared: DataFrame, sample: int | None = None) -> DataFrame:
    """High risk with a fraudulent loan, medium with a shared phone, else low.

    `sample` keeps that many borrowers for a drawing, chosen by a hash of the id, so the same ones every time.
    """
    phones = shared.select("phone_number", F.lit(True).alias("_shared"))
    per_borrower = (
        loans.filter(F.col("borrower_id").isNotNull())
        .withColumn("_fraud", _is_fraud(loans))
        .join(phones, "phone_number", "left")
        .groupBy("borrower_id")
        .agg(
            F.min_by("borrower_name", "loan_id").alias("name"),
            F.min_by("amount", "loan_id").alias("amount"),
            F.count(F.lit(1)).alias("loan_count"),
            F.bool_or("_fraud").alias("_fraud"),
            F.bool_or(F.coalesce("_shared", F.lit(False))).alias("_shared"),
        )
    )
    if sample is not None:
        per_borrower = per_borrower.orderBy(F.xxhash64("borrower_id"), "borrower_id").limit(sample)
    return per_borrower.select(
        _borrower().alias("id"),
        F.coalesce("name", F.col("borrower_id").cast("string")).alias("name"),
        F.lit("borrower").alias("type"),
        F.when(F.col("_fraud"), "high").when(F.col("_shared"), "medium").otherwise("low").alias("risk"),
        "loan_count",
        "amount",
    )


def guarantor_nodes(loans: DataFrame, min_loans: int = 3, name_length: int = 20) -> DataFrame:
    return (
        loans.dropna(subset=["guarantor_name", "borrower_id"])
        .groupBy("guarantor_name")
        .agg(F.count(F.lit(1)).alias("loan_count"))
        .filter(F.col("loan_count") >= min_loans)
        .select(
            _guarantor().alias("id"),
            F.substring("guarantor_name", 1, name_length).alias("name"),
            F.lit("guarantor").alias("type"),
            F.lit("high").alias("risk"),
            "loan_count",
            F.lit(None).cast("double").alias("amount"),
        )
    )


def nodes(loans: DataFrame, sample: int | None = None) -> DataFrame:
    return (
        officer_nodes(loans)
        .unionByName(borrower_nodes(loans, shared_phones(loans), sample))
        .unionByName(guarantor_nodes(loans))
    )


def _edge(source: Column, target: Column, kind: str, suspicious: Column) -> list[Column]:
    return [
        source.alias("source"),
        target.alias("target"),
        F.lit(kind).alias("type"),
        suspicious.alias("suspicious"),
    ]


def approved_edges(loans: DataFrame) -> DataFrame:
    """Officer to each of their borrowers; suspicious when any of the borrower's loans is fraudulent."""
    known = loans.dropna(subset=["officer_id", "borrower_id"]).withColumn("_fraud", _is_fraud(loans))
    pairs = known.groupBy("officer_id", "borrower_id").agg(F.bool_or("_fraud").alias("_fraud"))
    if "is_fraud" in loans.columns:
        high = (
            loans.filter(_is_fraud(loans) & F.col("borrower_id").isNotNull())
            .select("borrower_id", F.lit(True).alias("_high"))
            .distinct()
        )
        pairs = pairs.join(high, "borrower_id", "left")
        suspicious = F.coalesce("_high", F.lit(False))
    else:
        suspicious = F.lit(False)
    return pairs.select(*_edge(_officer(), _borrower(), "approved", suspicious))


def phone_star_edges(loans: DataFrame, shared: DataFrame) -> DataFrame:
    """Each shared phone as a star from its smallest borrower to the others."""
    pairs = loans.select("phone_number", "borrower_id").dropna().distinct()
    linked = pairs.join(shared, "phone_number").filter(F.col("borrower_id") != F.col("hub"))
    return linked.select(*_edge(_borrower("hub"), _borrower(), "shared_phone", F.lit(True))).distinct()


def phone_pair_edges(loans: DataFrame, shown: int = 5) -> DataFrame:
    """For a drawing: all pairs among the first `shown` borrowers of each shared phone."""
    first = first_values(
        loans.filter(F.col("borrower_id").isNotNull()),
        ["phone_number"],
        "borrower_id",
        shown,
        [F.col("borrower_id")],
        distinct=True,
    ).filter(F.col("phone_number").isNotNull() & (F.size("borrower_id") > 1))
    left = first.select("phone_number", "borrower_id", F.posexplode("borrower_id").alias("i", "a"))
    pairs = left.select("i", "a", F.posexplode("borrower_id").alias("j", "b")).filter(F.col("i") < F.col("j"))
    return pairs.select(*_edge(_borrower("a"), _borrower("b"), "shared_phone", F.lit(True))).distinct()


def guarantor_edges(loans: DataFrame, min_loans: int = 3, shown: int | None = None) -> DataFrame:
    """Guarantors of at least `min_loans` loans to their borrowers: all, or the first `shown` for a drawing."""
    backed = loans.dropna(subset=["guarantor_name", "borrower_id"])
    counted = backed.groupBy("guarantor_name", "borrower_id").agg(F.count(F.lit(1)).alias("n"))
    busy = written_table(
        counted.groupBy("guarantor_name").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_loans).drop("n"),
        "busy-guarantors",
    )
    pairs = backed.select("guarantor_name", "borrower_id").distinct().join(busy, "guarantor_name", "left_semi")
    if shown is not None:
        order = Window.partitionBy("guarantor_name").orderBy("borrower_id")
        pairs = pairs.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= shown)
    return pairs.select(*_edge(_guarantor(), _borrower(), "guarantor", F.lit(True)))


def edges(loans: DataFrame) -> DataFrame:
    """Every link of the graph, shared phones as stars."""
    return (
        approved_edges(loans)
        .unionByName(phone_star_edges(loans, shared_phones(loans)))
        .unionByName(guarantor_edges(loans))
    )


def keep_known(links: DataFrame, known: DataFrame) -> DataFrame:
    """Links whose both ends are among the nodes, as after sampling."""
    return links.join(known.select(F.col("id").alias("source")), "source", "left_semi").join(
        known.select(F.col("id").alias("target")), "target", "left_semi"
    )


#: Nodes that a task links up before it sends them on and begins anew.
TASK_NODES = 1 << 19


def contracted_links(links: DataFrame, task_nodes: int = TASK_NODES) -> DataFrame:
    """Links of the same components, at most one per node and task: (source, target) to the smallest id of what a task joins.

    Every task runs union-find over its own links, `task_nodes` nodes at a time. What is left for `connected_components`
    are stars, so that most of its rounds have been spent inside the tasks, without a shuffle.
    """

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict = {}

        def root(x):
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = parent[up]
                x = up
            return x

        def stars() -> pa.RecordBatch:
            rows = [(root(x), x) for x in list(parent)]
            found = [pa.array([r[i] for r in rows if r[0] != r[1]], kind) for i in (0, 1)]
            return pa.RecordBatch.from_arrays(found, names=["source", "target"])

        kind = pa.string()
        for batch in batches:
            kind = batch.column(0).type
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x, y = root(a), root(b)
                if x != y:
                    parent[max(x, y)] = min(x, y)
            if len(parent) >= task_nodes:
                yield stars()
                parent.clear()
        if parent:
            yield stars()

    pairs = links.select("source", "target").dropna()
    return pairs.mapInArrow(joined, pairs.schema)


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component) for every end of a link; the component is its smallest id.

    Alternating large-star and small-star steps (Kiveris et al. 2014): every step replaces a node's links by links
    to its smallest neighbour, so a long chain shrinks geometrically. A step is one job: it writes the new links to
    the shared folder, which cuts the lineage, and observes how many there are and their hash on the way. Links
    that a later step replaced are deleted. The minima of a step are aggregated from the links while the links
    themselves come from the file, so the two sides of the join have shuffles of their own. The minima are never
    broadcast: there are as many steps as it takes, and each broadcast would pass through the driver.
    """

    scratch = Scratch(links.sparkSession, "components")

    def step(df: DataFrame, label: str) -> tuple[DataFrame, tuple]:
        seen = Observation()
        marks = df.observe(
            seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")
        )
        out = scratch.write(marks, label)
        return out, (seen.get.get("n", 0), seen.get.get("h"))

    pairs = links.select(
        F.greatest("source", "target").alias("u"), F.least("source", "target").alias("v")
    ).filter(F.col("u") != F.col("v"))
    name = "links"
    current, seen = step(pairs.distinct(), name)
    for i in range(max_rounds):
        if not seen[0]:
            break
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter(F.col("v") > F.col("u")).join(lowest.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large, _ = step(large.distinct(), f"large-star-{i}")
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(lowest.hint("merge"), "u").filter(F.col("v") != F.col("m"))
        moved = moved.select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = moved.unionByName(lowest.select("u", F.col("m").alias("v"))).filter(F.col("u") != F.col("v"))
        # a step's links have both ends in order: the larger id first
        small = small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        before, last, name = name, seen, f"small-star-{i}"
        current, seen = step(small.distinct(), name)
        scratch.drop(f"large-star-{i}", before)
        if seen == last:
            break
    else:
        raise RuntimeError(f"components did not settle within {max_rounds} rounds")
    members = current.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return members.unionByName(members.select(F.col("component").alias("id"), "component").distinct())


def suspicious_clusters(graph_nodes: DataFrame, links: DataFrame, min_size: int = 3) -> DataFrame:
    """Components over suspicious links with at least `min_size` nodes, most high-risk nodes first."""
    members = connected_components(contracted_links(links.filter("suspicious")))
    risks = graph_nodes.select("id", "risk")
    return (
        members.join(risks, "id", "left")
        .groupBy("component")
        .agg(F.count(F.lit(1)).alias("size"), F.count_if(F.col("risk") == "high").alias("high_risk_count"))
        .filter(F.col("size") >= min_size)
        .select(
            F.col("component").alias("cluster_id"),
            "size",
            "high_risk_count",
            F.when(F.col("high_risk_count") > 2, "high").otherwise("medium").alias("risk_level"),
        )
        .orderBy(F.desc("high_risk_count"), "cluster_id")
    )
