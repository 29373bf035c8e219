"""One key owns a third of the rows: results stay whole and the plan splits it."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import timeline
from ledgerlens.operators import features, history, rules
from ledgerlens.session import written_table

ROWS = 120000


@pytest.fixture(scope="module")
def skewed(spark):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "16",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100k",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "20k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100k",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    number = F.col("id")
    book = spark.range(0, ROWS, 1, 8).select(
        number.alias("loan_id"),
        F.when(number % 3 == 0, "hot").otherwise(F.concat(F.lit("p"), number % 20000)).alias("phone_number"),
        (number % 30000).alias("borrower_id"),
        F.lit("n").alias("borrower_name"),
        F.lit("O").alias("officer_id"),
        F.lit("X").alias("branch_name"),
        F.lit(1.0).alias("amount"),
        F.concat(F.lit("g"), number % 9000).alias("guarantor_name"),
        F.concat(F.lit("i"), number % 9000).alias("national_id"),
        F.md5(number.cast("string")).alias("pad"),
    )
    yield written_table(book, "skewed")
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def final_plan(df):
    rows = df.collect()
    return rows, df._jdf.queryExecution().executedPlan().toString()


def test_feature_joins_split_the_hot_phone(skewed):
    wide = features.add_features(skewed, groups=["network"])
    rows, plan = final_plan(wide.agg(F.count(F.lit(1)), F.max("shared_phone_count"), F.max("pad")))
    assert "skew=true" in plan
    hot = skewed.filter("phone_number = 'hot'").select("borrower_id").distinct().count()
    assert rows[0][0] == ROWS and rows[0][1] == hot


def test_member_join_splits_the_hot_phone(skewed):
    alerts = rules.ghost_rows(skewed)
    keyed = skewed.select(F.lit("GHOST_LOAN").alias("alert_type"), F.col("phone_number").alias("entity_key"), "pad")
    joined = keyed.join(alerts.select("alert_type", "entity_key", "loan_count"), ["alert_type", "entity_key"])
    rows, plan = final_plan(joined.groupBy().agg(F.count(F.lit(1)), F.max("loan_count"), F.max("pad")))
    assert "skew=true" in plan
    assert rows[0][1] == ROWS // 3


def test_group_limit_runs_before_the_shuffle(skewed):
    _, plan = final_plan(rules.ghost_loans(skewed).groupBy().agg(F.max("evidence")))
    assert plan.count("WindowGroupLimit") >= 2 and "Partial" in plan


def test_a_hot_customer_day_is_spread(spark):
    """A third of all rows on one day of one customer: no partition of the scan holds much more than its share."""
    number = F.col("id")
    hot = number % 3 == 0
    rows = spark.range(30000).select(
        F.when(hot, "hot").otherwise(F.concat(F.lit("c"), number % 500)).alias("customer"),
        number.alias("transaction_id"),
        F.timestamp_seconds(F.lit(1704067200) + F.when(hot, number * 2).otherwise(number * 600)).cast("timestamp_ntz").alias("ts"),
        F.lit(2.0).alias("amount"),
        F.lit("m").alias("merchant"),
        F.lit(False).alias("failed"),
    )
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        ordered = timeline.in_order(history._timeline(rows), ["customer", "at"])
        sizes = [r["count"] for r in ordered.groupBy(F.spark_partition_id()).count().collect()]
        out = history.history_windows(rows)
        totals = out.filter(F.col("transaction_id") % 3 == 0)
        top = totals.agg(F.max("transaction_count_30d"), F.min("avg_amount_30d"), F.max("unique_merchants_7d")).first()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(sizes) == 12 and max(sizes) < 2 * sum(sizes) / 12
    assert tuple(top) == (9999, 2.0, 1)


def test_session_without_shared_folder_is_refused_on_a_cluster(monkeypatch):
    from ledgerlens import session

    class Context:
        master = "yarn"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        sparkContext = Context()
        conf = Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint_root(Session())


def test_dates_use_the_posix_century(spark):
    from ledgerlens.functions.clock import any_date

    rows = spark.createDataFrame([("22-Nov-24",), ("01-Feb-97",), ("1/2/2024",), ("2024-02-30",)], "t string")
    got = [r[0] for r in rows.select(any_date(F.col("t"))).collect()]
    assert got == [dt.date(2024, 11, 22), dt.date(1997, 2, 1), dt.date(2024, 2, 1), None]


def test_wide_keys_are_joined_before_features_are_added(spark, make_loans):
    """The loans are shuffled for names and phones first: later joins carry neither these texts nor the features of others."""
    book = written_table(make_loans([{"loan_id": f"L{i}", "guarantor_name": f"G{i % 3}", "loan_date": dt.date(2024, 1, 5)} for i in range(9)]), "narrow")
    plan = features.feature_matrix(book)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    keys = ["guarantor_name", "national_id", "phone_number", "cell_lat", "borrower_id"]  # from the innermost join out
    places = [next(i for i, line in enumerate(reversed(joins)) if f"({key}#" in line) for key in keys]
    assert places == sorted(places) and places[0] == 0
