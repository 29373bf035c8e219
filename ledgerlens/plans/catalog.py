"""The registered queries: every operator bound to the driver's tables."""

from __future__ import annotations

import operator
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.fixed_values import MERCHANT_CATEGORIES, TRANSACTION_FEATURES
from ledgerlens.functions.clock import is_after_hours
from ledgerlens.functions.groups import one_row
from ledgerlens.functions.risk import confidence_level, is_fraud, portfolio_score
from ledgerlens.functions.ranks import score_statistics as value_statistics
from ledgerlens.operators import alerts as summaries
from ledgerlens.operators import features, graph, history, mapping, rules
from ledgerlens.operators.models import boosting, boundary, density, ensemble, forest, reconstruction, screening
from ledgerlens.plans.analysis import analyse, screen_upload
from ledgerlens.plans.exchange import EXCHANGE
from ledgerlens.schema import FEATURE_NAMES
from ledgerlens.session import own_folder, written_table
from ledgerlens.functions.text import normalise_header, string_similarity
from ledgerlens.sources.loan_view import loan_table, table
from ledgerlens.sources.standardise import apply_mapping, mapping_of, standardise
from ledgerlens.sources.standardise import union_sources as union_books
from ledgerlens.sources import readers, sinks
from ledgerlens.streaming import monitors, scoring

Query = Callable[[SparkSession, str], DataFrame]


def _alerts_of(alerts: DataFrame, **evidence: str) -> DataFrame:
    """Alert columns without the JSON text, plus named evidence fields as columns of the given type."""
    fields = [
        F.get_json_object("evidence", f"$.{path}").cast(kind).alias(name)
        for name, (path, kind) in ((n, v.split(":")) for n, v in evidence.items())
    ]
    plain = [c for c in alerts.columns if c != "evidence"]
    return alerts.select(*plain, *fields).withColumn("amount_at_risk", F.round("amount_at_risk", 2))


def _listed(column: str, separator: str = ", ") -> F.Column:
    return F.array_join(F.from_json(column, "array<string>"), separator)


def ghost_loans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.ghost_loans(loan_table(spark, sf_dir))
    out = _alerts_of(found, borrower_count="borrower_count:long", borrower_names="borrower_names:string")
    return out.withColumn("borrower_names", _listed("borrower_names"))


def officer_anomaly(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.officer_anomaly(loan_table(spark, sf_dir))
    out = _alerts_of(found, volume_z="volume_z_score:double", avg_amount="avg_amount:double", branch="branch:string")
    return out.withColumn("volume_z", F.round("volume_z", 6)).withColumn("avg_amount", F.round("avg_amount", 4))


def geo_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.geo_clusters(loan_table(spark, sf_dir))
    out = _alerts_of(
        found,
        center_latitude="center_latitude:double",
        center_longitude="center_longitude:double",
        borrowers="borrowers:string",
    )
    return out.withColumn("borrowers", _listed("borrowers"))


def after_hours_officer(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _alerts_of(rules.after_hours_officer(loan_table(spark, sf_dir)), hours="hours:string")
    return out.withColumn("hours", _listed("hours", ","))


def shared_guarantor(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _alerts_of(
        rules.shared_guarantor(loan_table(spark, sf_dir)),
        borrower_count="borrower_count:long",
        officers="officers_involved:string",
    )
    return out.withColumn("officers", _listed("officers", ","))


def stacking_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _alerts_of(rules.stacking_active(loan_table(spark, sf_dir)), branches="branches:string", officers="officers:string")
    return out.withColumn("branches", _listed("branches", ",")).withColumn(
        "officers", F.coalesce(_listed("officers", ","), F.lit(""))
    )


def officer_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _alerts_of(rules.officer_volume(loan_table(spark, sf_dir)), z_score="z_score:double")
    return out.withColumn("z_score", F.round("z_score", 6))


def amount_outlier(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _alerts_of(rules.amount_outlier(loan_table(spark, sf_dir)), mean="mean:double", std_dev="std_dev:double")
    return out.withColumn("mean", F.round("mean", 4)).withColumn("std_dev", F.round("std_dev", 4))


def officer_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    # No officer of the test tables holds 40 % of the book, so the share is a parameter here.
    found = rules.officer_concentration(loan_table(spark, sf_dir), share=0.03)
    return _alerts_of(found, percentage="percentage:double").withColumn("percentage", F.round("percentage", 6))


def _simple(detector: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: _alerts_of(detector(loan_table(spark, sf_dir)))


def _ruleset(name: str) -> Query:
    return lambda spark, sf_dir: _alerts_of(rules.all_alerts(loan_table(spark, sf_dir), name))


def alert_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = loan_table(spark, sf_dir)
    members = rules.alert_members(book, rules.all_alerts(book))
    return members.select("alert_id", "alert_type", "entity_key", "loan_id")


def additive_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = loan_table(spark, sf_dir)
    mean = book.agg(F.avg("amount")).scalar()
    hour = F.coalesce(F.hour("created_at"), F.lit(12))
    rows = book.select(
        "loan_id",
        "amount",
        (F.col("amount") / mean).alias("amount_ratio"),
        hour.alias("hour"),
        is_after_hours(hour, "transaction").cast("int").alias("is_after_hours"),
    )
    return rules.additive_score(rows).select("loan_id", "score")


def _rounded(df: DataFrame, keys: list[str], names: list[str], digits: int = 6) -> DataFrame:
    return df.select(*keys, *[F.round(F.col(n).cast("double"), digits).alias(n) for n in names])


def _feature_query(group: str, names: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        book = loan_table(spark, sf_dir)
        return _rounded(features.add_features(book, groups=[group]), ["loan_id"], names.split())

    return query


def feature_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(features.feature_matrix(loan_table(spark, sf_dir)), ["loan_id"], FEATURE_NAMES)


def feat_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics fitted on the loans before 1998, applied to the whole book."""
    book = loan_table(spark, sf_dir)
    fitted = features.fit(book.filter(F.col("loan_date") < F.lit("1998-01-01").cast("date")))
    names = (
        "officer_loan_count officer_avg_amount officer_volume_z branch_loan_count branch_avg_amount"
        " amount_vs_branch_avg"
    )
    return _rounded(features.add_features(book, fitted, ["officer", "branch"]), ["loan_id"], names.split())


def _both_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = loan_table(spark, sf_dir)
    return rules.all_alerts(book, "backend").unionByName(rules.all_alerts(book, "engine"))


def severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.severity_counts(_both_alerts(spark, sf_dir))


def alert_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.type_counts(_both_alerts(spark, sf_dir))


def _portfolio(ruleset: str, scale: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = summaries.portfolio_risk(rules.all_alerts(loan_table(spark, sf_dir), ruleset), scale)
        return found.withColumn("amount_at_risk", F.round("amount_at_risk", 2))

    return query


def alert_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = summaries.filter_alerts(rules.all_alerts(loan_table(spark, sf_dir)), severity="high", method="rule")
    return _alerts_of(found)


def top_severe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _alerts_of(summaries.top_severe(rules.all_alerts(loan_table(spark, sf_dir), "engine")))


def recent_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = loan_table(spark, sf_dir)
    return _alerts_of(summaries.recent(rules.with_created_at(book, rules.all_alerts(book))))


def officer_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = loan_table(spark, sf_dir)
    return summaries.officer_ranking(book, rules.all_alerts(book))


def officer_ranking_engine(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = loan_table(spark, sf_dir)
    ranked = summaries.officer_risk(book, rules.all_alerts(book, "engine"))
    return ranked.withColumn("z_score", F.round("z_score", 6))


def risk_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = loan_table(spark, sf_dir)
    needed = features.add_features(book, groups=["amount", "officer", "time", "network"])
    return summaries.risk_distribution(needed)


def portfolio_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.portfolio_summary(loan_table(spark, sf_dir))


def _amount_threshold(book: DataFrame) -> F.Column:
    stats = one_row(book.filter(F.col("amount") > 0), mean=F.avg("amount"), sd=F.stddev_pop("amount"))
    return stats["mean"] + 2.5 * stats["sd"]


def label_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = loan_table(spark, sf_dir)
    labelled = book.withColumn("_threshold", _amount_threshold(book)).withColumn(
        "fraud_type",
        F.when(F.col("officer_id") == F.col("borrower_id"), "self_lending").when(
            F.col("amount") > F.col("_threshold"), "amount"
        ),
    )
    labelled = labelled.withColumn("is_fraud", F.col("fraud_type").isNotNull())
    return summaries.label_summary(labelled).withColumn("rate", F.round("rate", 6))


def _flags(book: DataFrame, ruleset: str) -> DataFrame:
    return rules.alert_members(book, rules.all_alerts(book, ruleset), ruleset)


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = loan_table(spark, sf_dir)
    months = book.select("loan_id", F.trunc("loan_date", "month").alias("month"))
    flags = _flags(book, "backend").select("loan_id", F.lit("backend").alias("method"))
    flags = flags.unionByName(_flags(book, "engine").select("loan_id", F.lit("engine").alias("method"))).distinct()
    return summaries.detection_timeline(flags.join(months, "loan_id"), ["backend", "engine"])


def feature_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = loan_table(spark, sf_dir)
    matrix = features.feature_matrix(book, keep=["loan_id"])
    labelled = matrix.withColumn("label", (F.col("amount") > _amount_threshold(book)).cast("int"))
    found = summaries.feature_correlations(labelled, "label", FEATURE_NAMES)
    return found.withColumn("correlation", F.round("correlation", 6))


def feature_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = summaries.feature_summary(_features_of(loan_table(spark, sf_dir)), FEATURE_NAMES)
    return _rounded(found, ["feature", "n"], ["mean", "sd", "minimum", "q1", "median", "q3", "maximum"], 4)


def score_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return value_statistics(loan_table(spark, sf_dir), "amount").withColumn("mean", F.round("mean", 4))


def weekly_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = loan_table(spark, sf_dir)
    per_loan = rules.after_hours_loan(book).unionByName(rules.amount_outlier(book))
    where = book.select(
        F.col("loan_id").cast("string").alias("entity_key"),
        F.col("branch_name").alias("institution"),
        F.date_trunc("week", "loan_date").cast("date").alias("week"),
    )
    return summaries.weekly_top(per_loan.join(where, "entity_key")).select(
        "alert_id", "institution", "week", F.round("amount_at_risk", 2).alias("amount_at_risk"), "rank"
    )


def alert_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`labels.toxic` stands for the confirmed outcome of the loan of the same number."""
    book = loan_table(spark, sf_dir)
    outcomes = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("loan_id"), (F.col("toxic") == 1).alias("confirmed")
    )
    flags = _flags(book, "backend").select("alert_type", "loan_id").distinct()
    found = summaries.alert_precision(flags, outcomes)
    return _rounded(found, ["alert_type", "judged", "confirmed"], ["precision", "recall"])


def behaviour_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = summaries.behaviour_monthly(loan_table(spark, sf_dir))
    shares = ["after_hours_share", "round_amount_share", "officer_concentration"]
    return _rounded(found, ["month", "loans"], shares)


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_transactions(table(spark, sf_dir, "events"))


def _as_transactions(events: DataFrame) -> DataFrame:
    """Events as transactions: the number in `props` stands for device and place, and picks a merchant category."""
    k = F.get_json_object("props", "$.k").cast("int")
    categories = F.array(*[F.lit(c) for c in [*MERCHANT_CATEGORIES, "unknown"]])
    return events.select(
        F.col("user_id").alias("customer"),
        F.col("event_id").alias("transaction_id"),
        "ts",
        F.col("value").alias("amount"),
        F.col("event_type").alias("merchant"),
        (F.col("event_type") == "error").alias("failed"),
        F.element_at(categories, k % 16 + 1).alias("merchant_category"),
        (k % 3).alias("device"),
        (k * 0.01).alias("latitude"),
        (k * 0.02).alias("longitude"),
    )


def _history_window(*names: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _rounded(history.history_windows(transactions(spark, sf_dir)), ["transaction_id"], list(names), 10)

    return query


def hist_prev(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = history.previous_transaction(transactions(spark, sf_dir))
    return _rounded(
        found, ["transaction_id", "customer_age_days", "same_device"], ["minutes_since_prev", "distance_from_prev"], 4
    )


_VECTOR = [n for n, _, _ in TRANSACTION_FEATURES]


def vector15(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = history.transaction_vector(history.with_history(transactions(spark, sf_dir)))
    return _rounded(vectors, ["transaction_id"], _VECTOR, 10)


def vector15_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = history.transaction_vector(history.with_history(transactions(spark, sf_dir)))
    single = [F.col(n).cast("float").cast("double").alias(n) for n in _VECTOR]
    return history.normalise_vector(vectors).select("transaction_id", *single)


def _sequence_query(past: bool) -> Query:
    """Seven steps of 15 features: per feature the sum over steps of step number times value, rounded."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = history.feature_sequences(transactions(spark, sf_dir), history=past)
        steps = [F.get("sequence", F.lit(i)) for i in range(7)]
        weighed = [
            F.round(reduce(operator.add, [(i + 1) * F.get(step, F.lit(n)) for i, step in enumerate(steps)]), 6)
            for n in range(len(_VECTOR))
        ]
        return found.select("customer", "transaction_id", *[c.alias(n) for c, n in zip(weighed, _VECTOR, strict=True)])

    return query


def last7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = history.last_sequences(transactions(spark, sf_dir))
    ids = F.transform("sequence", lambda t: F.coalesce(t["transaction_id"].cast("string"), F.lit("-")))
    total = F.aggregate("sequence", F.lit(0.0), lambda acc, t: acc + t["amount"])
    return found.select(
        "customer",
        "transaction_id",
        F.array_join(ids, ",").alias("sequence"),
        F.round(total, 4).alias("sequence_amount"),
    )


# Corrections a user makes for the abbreviated layout, whose headers are too short to match by name.
SHORT_OVERRIDES = {
    "id": "loan_id",
    "mid": "borrower_id",
    "amt": "amount",
    "dt": "loan_date",
    "tm": "approval_time",
    "stf": "officer_id",
    "st": "status",
}


def exports(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The whole loan book in three export layouts: upper-case names, mixed names, abbreviations."""
    book = loan_table(spark, sf_dir)
    text = lambda c: F.col(c).cast("string")
    tagged = lambda tag, c: F.concat(F.lit(tag), text(c))
    phone = F.col("phone_number")
    amount = F.col("amount").cast("long")
    upper = book.select(
        F.col("loan_id").alias("row"),
        F.concat(F.lit("MCU-"), F.lpad(text("loan_id"), 9, "0")).alias("LOAN_REF"),
        tagged("CU", "borrower_id").alias("CUSTOMER_ID"),
        F.upper("borrower_name").alias("CUSTOMER_NAME"),
        F.concat(F.lit("256"), F.substring(phone, 2, 20)).alias("PHONE_NUMBER"),
        amount.cast("string").alias("PRINCIPAL_AMOUNT"),
        text("loan_date").alias("ISSUE_DATE"),
        F.col("approval_time").alias("APPROVAL_TIME"),
        tagged("EMP", "officer_id").alias("EMPLOYEE_ID"),
        F.col("branch_name").alias("BRANCH_CODE"),
        F.upper("status").alias("LOAN_STATE"),
    )
    mixed = book.select(
        F.col("loan_id").alias("row"),
        tagged("GDM", "loan_id").alias("loanId"),
        tagged("GC", "borrower_id").alias("clientId"),
        F.col("borrower_name").alias("Client Name"),
        F.concat(
            F.substring(phone, 1, 3), F.lit("-"), F.substring(phone, 4, 3), F.lit("-"), F.substring(phone, 7, 20)
        ).alias("telephone"),
        F.format_number(amount, 0).alias("loan_amount"),
        F.date_format("loan_date", "dd-MMM-yy").alias("Disbursement Date"),
        F.substring("approval_time", 1, 5).alias("time"),
        tagged("Officer ", "officer_id").alias("approvedBy"),
        F.col("branch_name").alias("branch location"),
        F.col("status").alias("Status"),
    )
    short = book.select(
        F.col("loan_id").alias("row"),
        tagged("W", "loan_id").alias("id"),
        tagged("M", "borrower_id").alias("mid"),
        F.col("borrower_name").alias("name"),
        phone.alias("mob"),
        amount.cast("string").alias("amt"),
        F.date_format("loan_date", "dd/MM/yyyy").alias("dt"),
        F.substring("approval_time", 1, 5).alias("tm"),
        tagged("S", "officer_id").alias("stf"),
        F.col("branch_name").alias("br"),
        F.upper(F.substring("status", 1, 1)).alias("st"),
        F.regexp_extract("guarantor_name", "^(.*) Brand", 1).alias("qx"),
        F.col("status").alias("qz"),
    )
    return {"upper": upper, "mixed": mixed, "short": short}


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.long_values(exports(spark, sf_dir), order="row")


def column_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.column_sample(_cells(spark, sf_dir), 100)


def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mapping.profile(_cells(spark, sf_dir))
    doubles = [f.name for f in found.schema.fields if f.dataType.typeName() == "double"]
    return found.withColumns({c: F.round(c, 6) for c in doubles})


def name_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct text of the dimension tables as if it were a header, with its best field."""
    columns = [
        ("customer", "c_name"),
        ("customer", "c_mktsegment"),
        ("supplier", "s_name"),
        ("part", "p_name"),
        ("part", "p_type"),
        ("nation", "n_name"),
        ("events", "event_type"),
        ("orders", "o_orderpriority"),
    ]
    texts = None
    for name, column in columns:
        part = table(spark, sf_dir, name).select(F.col(column).alias("header"))
        texts = part if texts is None else texts.union(part)
    clean = texts.filter(F.col("header").isNotNull()).distinct().withColumn("_clean", normalise_header(F.col("header")))
    matched = clean.withColumn("_match", mapping.name_match(F.col("_clean")))
    return matched.select(
        "header", F.col("_match.field").alias("field"), F.round("_match.score", 6).alias("score")
    )


def name_match_indel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as headers, matched by the indel ratio."""
    return mapping.name_match_indel(table(spark, sf_dir, "part").select("p_name"), "p_name")


def similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edit ratio of every part's name against its type and brand, with both empty-text rules."""
    part = table(spark, sf_dir, "part")
    return part.select(
        "p_partkey",
        F.round(string_similarity(F.col("p_name"), F.lower("p_type")), 6).alias("name_type"),
        F.round(string_similarity(F.col("p_type"), F.col("p_brand"), empty="zero"), 6).alias("type_brand"),
    )


def mapping_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mapping.detect(mapping.profile(_cells(spark, sf_dir)))
    return found.withColumn("confidence", F.round("confidence", 6))


def semantic_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct part name, part type and supplier's nation as if it were a header, with the nearest field."""
    part = table(spark, sf_dir, "part")
    texts = part.select(F.col("p_name").alias("header")).unionByName(part.select(F.col("p_type").alias("header")))
    texts = texts.unionByName(table(spark, sf_dir, "nation").select(F.col("n_name").alias("header"))).distinct()
    best = mapping.semantic_match(F.col("header"))
    return texts.select("header", best["field"].alias("field"), F.round(best["score"], 6).alias("score"))


def mapping_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mapping.resolve(mapping.detect(mapping.profile(_cells(spark, sf_dir))))
    return found.withColumn("confidence", F.round("confidence", 6))


def mapping_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same decision from the first 100 values of every column."""
    sampled = mapping.column_sample(_cells(spark, sf_dir), 100)
    found = mapping.resolve(mapping.detect(mapping.profile(sampled)))
    return found.withColumn("confidence", F.round("confidence", 6))


def mapping_engine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.resolve(mapping.detect_engine(mapping.profile(_cells(spark, sf_dir))))


def mapping_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.assign_pooled(mapping.pooled_candidates(mapping.profile(_cells(spark, sf_dir))))


def mapping_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.assign_first(mapping.filled_columns(exports(spark, sf_dir), order="row"))


def mapping_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.mapping_report(mapping.resolve(mapping.detect(mapping.profile(_cells(spark, sf_dir)))))


def semantic_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding against the mean vector of each label (at most a field list's worth of references)."""
    vectors = table(spark, sf_dir, "embeddings")
    entries = vectors.select("label", F.posexplode("embedding").alias("place", "x"))
    means = entries.groupBy("label", "place").agg(F.avg(F.col("x").cast("double")).alias("x"))
    mean_vectors = means.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("place", "x"))).alias("_v"))
    named = F.struct(F.col("label").alias("name"), F.transform("_v", lambda e: e["x"]).alias("vector"))
    references = mean_vectors.agg(F.sort_array(F.collect_list(named))).scalar()
    held = vectors.select("vec_id", "label", F.col("embedding").alias("vector"), references.alias("_refs"))
    found = mapping.nearest_by_cosine(held, F.col("_refs"), minimum=-1.0)
    return found.select("vec_id", "label", "match", F.round("score", 6).alias("score"))


def union_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three layouts profiled, mapped, corrected where headers are abbreviations, and united."""
    books = exports(spark, sf_dir)
    detected = mapping.resolve(mapping.detect(mapping.profile(mapping.long_values(books, order="row"))))
    detected = written_table(detected, "mappings")
    standard = {
        name: standardise(
            apply_mapping(book, mapping_of(detected, name), SHORT_OVERRIDES if name == "short" else None)
        )
        for name, book in books.items()
    }
    return union_books(standard).select(
        "source",
        "loan_id",
        "borrower_id",
        "phone_number",
        "amount",
        "loan_date",
        "approval_time",
        "officer_id",
        "officer_name",
        "branch_name",
        "status",
        F.hour("created_at").alias("created_hour"),
    )


def _labelled_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The written loan book with `is_fraud`: amounts beyond 2.5 deviations and loans to the officer themselves."""
    book = loan_table(spark, sf_dir)
    outlying = F.col("amount") > F.col("_threshold")
    own = F.coalesce(F.col("officer_id") == F.col("borrower_id"), F.lit(False))
    return (
        book.withColumn("_threshold", _amount_threshold(book)).withColumn("is_fraud", outlying | own).drop("_threshold")
    )


def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.nodes(_labelled_book(spark, sf_dir))


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edges(_labelled_book(spark, sf_dir))


def graph_drawing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a drawing shows: 50 hashed borrowers, their officers, and the links among the shown nodes."""
    book = _labelled_book(spark, sf_dir)
    shown = written_table(graph.nodes(book, sample=50), "shown")
    links = (
        graph.approved_edges(book)
        .unionByName(graph.phone_pair_edges(book))
        .unionByName(graph.guarantor_edges(book, shown=5))
    )
    return graph.keep_known(links, shown)


def phone_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.phone_pair_edges(loan_table(spark, sf_dir)).select("source", "target")


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = _labelled_book(spark, sf_dir)
    return graph.suspicious_clusters(graph.nodes(book), graph.edges(book))


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Borrowers linked by shared phones."""
    book = loan_table(spark, sf_dir)
    return graph.connected_components(graph.contracted_links(graph.phone_star_edges(book, graph.shared_phones(book))))


def _features_of(book: DataFrame, *keep: str) -> DataFrame:
    return written_table(features.feature_matrix(book, keep=["loan_id", *keep]), "features")


def gbt_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holdout metrics of the boosted classifier; the fold scores are the query `gbt_folds`."""
    book = _labelled_book(spark, sf_dir)
    matrix = _features_of(book, "is_fraud").withColumn("label", F.col("is_fraud").cast("int"))
    training = boosting.train_classifier(matrix, FEATURE_NAMES, folds=0)
    return boosting.metrics_frame(matrix, training)


def gbt_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holdout and five-fold F1 of the boosted classifier, each fit with all its trees."""
    book = _labelled_book(spark, sf_dir)
    matrix = _features_of(book, "is_fraud").withColumn("label", F.col("is_fraud").cast("int"))
    training = boosting.train_classifier(matrix, FEATURE_NAMES, folds=5)
    return boosting.metrics_frame(matrix, training)


def gbt_importances(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = _labelled_book(spark, sf_dir)
    matrix = _features_of(book, "is_fraud").withColumn("label", F.col("is_fraud").cast("int"))
    training = boosting.train_classifier(matrix, FEATURE_NAMES, folds=0)
    return boosting.importance_frame(matrix, training, 10)


def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the stratified 80/20 split per label."""
    book = _labelled_book(spark, sf_dir)
    train, test = boosting.stratified_split(book, "is_fraud", "loan_id")
    tagged = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return tagged.groupBy("part", "is_fraud").agg(F.count(F.lit(1)).alias("loans"))


def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and F1 of "after hours" as a prediction of the label."""
    book = _labelled_book(spark, sf_dir)
    hour = F.coalesce(F.hour("created_at"), F.lit(12))
    judged = book.select(
        F.col("is_fraud").cast("int").alias("label"), is_after_hours(hour).cast("int").alias("predicted")
    )
    found = boosting.confusion_metrics(judged)
    return _rounded(found, ["tp", "fp", "fn"], ["precision", "recall", "f1_score"])


def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranking quality of the amount for two labels: fraud, and approval after hours."""
    book = _labelled_book(spark, sf_dir)
    judged = book.select(F.col("is_fraud").cast("int").alias("label"), F.col("amount").cast("double").alias("score"))
    late = book.select(is_after_hours(F.hour("created_at")).cast("int").alias("label"), F.col("amount").cast("double").alias("score"))
    named = [boosting.roc_auc(rows).withColumn("labels", F.lit(name)) for name, rows in (("fraud", judged), ("late", late))]
    return _rounded(named[0].unionByName(named[1]), ["labels", "positives", "negatives"], ["roc_auc"], 9)


def standard_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    matrix = _features_of(loan_table(spark, sf_dir))
    scaled, _ = boosting.standard_scale(matrix, FEATURE_NAMES)
    return _rounded(scaled, ["loan_id"], FEATURE_NAMES, 4)


def iforest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forest decision, prediction and 0 to 100 risk of every loan."""
    matrix = _features_of(loan_table(spark, sf_dir))
    _, scored = forest.fit_and_score(matrix, FEATURE_NAMES, keep=["loan_id"])
    return forest.risk_from_decision(scored, 1e-10)


def risk_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    matrix = _features_of(loan_table(spark, sf_dir))
    factors = matrix.select("loan_id", screening.risk_factors().alias("_f"))
    return factors.select(
        "loan_id",
        F.array_join("_f", ",").alias("factors"),
        screening.type_of_factors(F.col("_f")).alias("alert_type"),
    )


def _ml_alerts(n: int | None) -> Query:
    """Alerts of the loans that the forest flags: all of them, or the `n` riskiest."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        matrix = _features_of(loan_table(spark, sf_dir), "officer_id")
        screen, scored = screening.fit_and_screen(matrix, keep=screening.ALERT_COLUMNS)
        return screen.alerts(scored, n)

    return query


def minmax_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The min-max risk of a plain decision column (the negative amount)."""
    plain = loan_table(spark, sf_dir).select("loan_id", (-F.col("amount")).alias("decision"))
    return _rounded(forest.risk_from_decision(plain), ["loan_id"], ["anomaly_risk"])


def lof(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ensemble.ensemble_features(loan_table(spark, sf_dir))
    found = density.local_outlier_factor(rows, ensemble.TIME_FEATURES)
    return density.flag_share(written_table(found.withColumn("lof", F.round("lof", 6)), "lof"), "lof")


def one_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ensemble.ensemble_features(loan_table(spark, sf_dir))
    model = boundary.fit_boundary(rows, ensemble.TIME_FEATURES)
    return model.score(rows).select("loan_id", "boundary_score", "is_outlier")


def pca_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reconstruction.reconstruction_features(loan_table(spark, sf_dir))
    return reconstruction.fit_reconstruction(rows).score(rows)


def pca_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reconstruction.reconstruction_features(loan_table(spark, sf_dir))
    return _rounded(rows, ["loan_id"], reconstruction.FEATURES)


def ensemble_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ensemble.ensemble_features(loan_table(spark, sf_dir))


def _ensemble_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three stand-in model scores per loan, two of them missing for some loans, combined."""
    book = loan_table(spark, sf_dir)
    stats = one_row(book, mean=F.avg("amount"), sd=F.stddev_pop("amount"))
    rows = book.withColumn("_s", stats).select(
        "loan_id",
        ensemble.sigmoid((F.col("amount") - F.col("_s.mean")) / F.col("_s.sd")).alias("s_forest"),
        F.when(F.col("officer_id").isNotNull(), ensemble.sigmoid(F.col("latitude") * 40 - 1)).alias("s_lof"),
        F.when(F.col("created_at").isNotNull(), F.hour("created_at") / 24.0).alias("s_text"),
    )
    return ensemble.combine_scores(
        rows, {"isolation_forest": "s_forest", "local_outlier": "s_lof", "huggingface": "s_text"}
    )


def ensemble_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    combined = _ensemble_scores(spark, sf_dir)
    score = F.col("ensemble_score")
    return combined.select(
        "loan_id",
        F.round(score, 6).alias("ensemble_score"),
        "risk_level",
        "models_used",
        confidence_level(score).alias("confidence"),
        is_fraud(score).alias("is_fraud"),
    )


def flagged_loans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ensemble.flagged_loans(_ensemble_scores(spark, sf_dir))
    return found.select(
        "loan_id", F.round("ml_score", 6).alias("ml_score"), "ml_risk", "total_loans", "ml_flagged"
    )


def prompt_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = loan_table(spark, sf_dir).withColumn("amount", F.col("amount").cast("long"))
    return ensemble.prompt_text(book.withColumnRenamed("branch_name", "branch")).select("loan_id", "prompt")


def batch_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stand-in outside model (share of digits in the prompt), its scores attached with a level."""
    scored = ensemble.batch_score(
        prompt_text(spark, sf_dir), lambda: lambda texts: texts.str.count("[0-9]") / texts.str.len(), "prompt"
    )
    return ensemble.attach_level(scored, "score").select(
        "loan_id", F.round("ml_fraud_score", 6).alias("ml_fraud_score"), "ml_risk_level"
    )


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    return monitors.read_events(spark, sf_dir, schema, "events.parquet")


def upload_no_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The book as another institution's CSV export, without loan ids, read and screened as an upload."""
    book = loan_table(spark, sf_dir)
    export = book.select(
        F.col("borrower_id").alias("clientId"),
        F.col("borrower_name").alias("Client Name"),
        F.col("phone_number").alias("telephone"),
        F.col("amount").alias("loan_amount"),
        F.concat_ws(" ", F.col("loan_date").cast("string"), F.lit("09:30:00")).alias("Disbursement Date"),
        F.col("approval_time").alias("time"),
        F.col("officer_id").alias("approvedBy"),
        F.col("branch_name").alias("branch location"),
        F.col("status").alias("Status"),
    )
    path = own_folder(spark, "exports")
    export.write.option("header", True).csv(path)
    analysis, _ = screen_upload(readers.read_csv(spark, path), mode="rule_only", ruleset="engine")
    return analysis.alerts.groupBy("alert_type", "severity").agg(
        F.count(F.lit(1)).alias("alerts"),
        F.count_distinct("alert_id").alias("ids"),
        F.round(F.sum("amount_at_risk"), 2).alias("amount_at_risk"),
    )


def stream_after_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitors.run_available(monitors.after_hours_events(_stream(spark, sf_dir)))


def stream_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = monitors.run_bounded(monitors.daily_repeats(_stream(spark, sf_dir)))
    return found.withColumn("total", F.round("total", 4))


def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = monitors.run_bounded(monitors.sliding_history(_stream(spark, sf_dir)))
    return found.withColumn("average", F.round("average", 10))


def stream_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitors.run_bounded(monitors.failure_bursts(_stream(spark, sf_dir)))


def stream_vector15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 15 features of every transaction as it arrives, its history kept as state: the rows of `vector15`."""
    vectors = scoring.scored_vectors(_as_transactions(_stream(spark, sf_dir)))
    with scoring.rocksdb_state(spark):
        return _rounded(monitors.run_available(vectors), ["transaction_id"], _VECTOR, 10)


def history_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One analysis session per branch and loan month, appended to the history; the ten latest of branch NATION_7."""
    book = loan_table(spark, sf_dir)
    where = book.select(
        F.col("loan_id").cast("string").alias("entity_key"),
        F.col("branch_name").alias("user_id"),
        F.trunc("loan_date", "month").alias("month"),
    )
    found = rules.amount_outlier(book).unionByName(rules.after_hours_loan(book)).join(where, "entity_key")
    level = lambda name: F.count_if(F.col("severity") == name).alias(f"{name.lower()}_alerts")
    sizes = where.groupBy("user_id", "month").agg(F.count(F.lit(1)).alias("total_records"))
    counted = found.groupBy("user_id", "month").agg(
        level("CRITICAL"), level("HIGH"), level("MEDIUM"), portfolio_score(F.col("severity")).alias("risk_score")
    )
    sessions = sizes.join(counted, ["user_id", "month"], "left").na.fill(0)
    rows = sinks.history_rows(
        sessions.withColumns(
            {
                "file_name": F.concat(F.lit("book-"), F.date_format("month", "yyyy-MM")),
                "created_at": F.col("month").cast("timestamp"),
            }
        )
    )
    path = own_folder(spark, "exports")
    sinks.append_history(rows, path)
    latest = sinks.read_history(spark, path, "NATION_7")
    return latest.select(
        "user_id",
        "file_name",
        "loans_analyzed",
        "alerts_generated",
        "risk_score",
        F.col("created_at").cast("timestamp_ntz").alias("created_at"),
    )


def analysis_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules and model screen together, as the one-row dashboard summary."""
    return analyse(loan_table(spark, sf_dir), "full", written=True).summary()


def analysis_rule_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = analyse(loan_table(spark, sf_dir), "rule_only", written=True).summary()
    return summary.withColumn("amount_at_risk", F.round("amount_at_risk", 2))


def timeline_ml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loans per month flagged by rules, by the forest, and by both."""
    analysis = analyse(loan_table(spark, sf_dir), "full", top_ml=None, written=True)
    months = analysis.loans.select("loan_id", F.trunc("loan_date", "month").alias("month"))
    methods = ["rule", "ml"]
    loans = analysis.members(methods=True).groupBy("loan_id").agg(*[F.max(m).alias(m) for m in methods])
    method = F.explode(F.array_compact(F.array(*[F.when(F.col(m), m) for m in methods])))
    flags = loans.join(months, "loan_id").select("loan_id", "month", method.alias("method"))
    return summaries.detection_timeline(flags, methods)


QUERIES: dict[str, Query] = {
    "ghost_loans": ghost_loans,
    "ghost_rows": _simple(rules.ghost_rows),
    "officer_anomaly": officer_anomaly,
    "officer_volume": officer_volume,
    "geo_clusters": geo_clusters,
    "after_hours_officer": after_hours_officer,
    "after_hours_loan": _simple(rules.after_hours_loan),
    "shared_guarantor": shared_guarantor,
    "stacking_active": stacking_active,
    "stacking_same_day": _simple(rules.stacking_same_day),
    "amount_outlier": amount_outlier,
    "self_lending": _simple(rules.self_lending),
    "officer_concentration": officer_concentration,
    "all_alerts": _ruleset("backend"),
    "all_alerts_engine": _ruleset("engine"),
    **EXCHANGE,
    "upload_no_id": upload_no_id,
    "all_alerts_demo": _ruleset("demo"),
    "alert_members": alert_members,
    "additive_score": additive_score,
    "severity_counts": severity_counts,
    "alert_types": alert_types,
    "portfolio_risk": _portfolio("engine", "engine"),
    "portfolio_risk_backend": _portfolio("backend", "backend"),
    "portfolio_risk_count": _portfolio("engine", "count"),
    "alert_filter": alert_filter,
    "top_severe": top_severe,
    "recent_alerts": recent_alerts,
    "officer_ranking": officer_ranking,
    "officer_ranking_engine": officer_ranking_engine,
    "risk_distribution": risk_distribution,
    "portfolio_summary": portfolio_summary,
    "label_summary": label_summary,
    "timeline": timeline,
    "feature_corr": feature_corr,
    "feature_summary": feature_summary,
    "score_statistics": score_statistics,
    "weekly_top": weekly_top,
    "alert_precision": alert_precision,
    "behaviour_monthly": behaviour_monthly,
    "feat_amount": _feature_query(
        "amount", "amount amount_log amount_vs_product_avg amount_vs_avg amount_percentile is_round_amount"
    ),
    "feat_officer": _feature_query(
        "officer", "officer_loan_count officer_avg_amount officer_volume_z officer_approval_rate"
    ),
    "feat_time": _feature_query(
        "time", "hour is_after_hours day_of_week is_weekend month is_month_end days_since_year_start"
    ),
    "feat_network": _feature_query(
        "network",
        "shared_phone_count has_shared_phone shared_guarantor_count has_shared_guarantor national_id_loan_count",
    ),
    "feat_geo": _feature_query("geo", "geographic_density officer_geo_concentration"),
    "feat_branch": _feature_query("branch", "branch_loan_count branch_avg_amount amount_vs_branch_avg"),
    "feat_borrower": _feature_query(
        "borrower",
        "borrower_loan_count has_multiple_loans borrower_total_exposure borrower_branch_count"
        " multi_branch_borrower borrower_officer_count",
    ),
    "feat_apply": feat_apply,
    "feature_matrix": feature_matrix,
    "hist_30d": _history_window("transaction_count_30d", "avg_amount_30d"),
    "hist_fail24": _history_window("failed_attempts_24h"),
    "hist_uniq7": _history_window("unique_merchants_7d"),
    "hist_prev": hist_prev,
    "vector15": vector15,
    "vector15_normalised": vector15_normalised,
    "last7": last7,
    "sequence15": _sequence_query(True),
    "sequence15_plain": _sequence_query(False),
    "column_sample": column_sample,
    "column_profile": column_profile,
    "name_match": name_match,
    "name_match_indel": name_match_indel,
    "similarity": similarity,
    "mapping_detect": mapping_detect,
    "semantic_headers": semantic_headers,
    "mapping_resolve": mapping_resolve,
    "mapping_sampled": mapping_sampled,
    "mapping_engine": mapping_engine,
    "mapping_pooled": mapping_pooled,
    "mapping_page": mapping_page,
    "mapping_report": mapping_report,
    "semantic_top1": semantic_top1,
    "union_sources": union_sources,
    "graph_nodes": graph_nodes,
    "graph_edges": graph_edges,
    "graph_drawing": graph_drawing,
    "phone_pairs": phone_pairs,
    "components": components,
    "clusters": clusters,
    "standard_scale": standard_scale,
    "split_counts": split_counts,
    "confusion": confusion,
    "roc_auc": roc_auc,
    "gbt_metrics": gbt_metrics,
    "gbt_folds": gbt_folds,
    "gbt_importances": gbt_importances,
    "iforest": iforest,
    "minmax_risk": minmax_risk,
    "risk_factors": risk_factors,
    "ml_alerts": _ml_alerts(None),
    "ml_top50": _ml_alerts(50),
    "lof": lof,
    "one_class": one_class,
    "pca_features": pca_features,
    "pca_error": pca_error,
    "ensemble_features": ensemble_features,
    "ensemble": ensemble_scores,
    "flagged_loans": flagged_loans,
    "prompt_text": prompt_text,
    "batch_score": batch_score,
    "stream_after_hours": stream_after_hours,
    "stream_daily": stream_daily,
    "stream_sliding": stream_sliding,
    "stream_bursts": stream_bursts,
    "stream_vector15": stream_vector15,
    "history_top": history_top,
    "analysis_full": analysis_full,
    "analysis_rule_only": analysis_rule_only,
    "timeline_ml": timeline_ml,
}
