"""Features against pandas, history windows against brute force."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerlens.functions.ranks import percentile_ranks, score_statistics
from ledgerlens.functions import selection, timeline
from ledgerlens.operators import features, history
from ledgerlens.schema import FEATURE_NAMES


def test_percentiles_match_pandas_average_ranks(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.integers(0, 40, 700).astype(float), np.full(400, 7.0)])
    want = pd.Series(values).rank(pct=True)
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
    got = {r["v"]: r["p"] for r in percentile_ranks(df, "v", "p").collect()}
    assert all(got[v] == pytest.approx(p) for v, p in zip(values, want))


def test_statistics_pick_sorted_values(spark):
    values = sorted(float(v * v % 101) for v in range(203))
    row = score_statistics(spark.createDataFrame([(v,) for v in values], "v double"), "v").first()
    assert (row["n"], row["minimum"], row["maximum"]) == (203, values[0], values[-1])
    assert row["median"] == values[101] and row["p95"] == values[int(203 * 0.95)]


@pytest.fixture(scope="module")
def book(make_loans):
    rng = random.Random(11)
    rows = []
    for i in range(300):
        amount = float(rng.randrange(1, 60) * 50000)
        rows.append(
            {
                "loan_id": f"L{i:04d}",
                "borrower_id": f"B{rng.randrange(90)}",
                "amount": None if i == 5 else amount,
                "phone_number": rng.choice([None, "hot", "hot", *[f"p{k}" for k in range(50)]]),
                "guarantor_name": rng.choice([None, *[f"g{k}" for k in range(40)]]),
                "national_id": rng.choice([None, *[f"n{k}" for k in range(70)]]),
                "officer_id": rng.choice([None, *[f"O{k}" for k in range(8)]]),
                "branch_id": rng.choice(["X", "Y", "Z"]),
                "product_id": rng.choice([None, "P", "Q"]),
                "status": rng.choice(["active", "rejected", None]),
                "created_at": None if i % 9 == 0 else dt.datetime(2023, 3, 1) + dt.timedelta(hours=rng.randrange(12000)),
                "latitude": None if i % 7 == 0 else rng.randrange(4) / 1000,
                "longitude": None if i % 7 == 0 else rng.randrange(4) / 1000,
            }
        )
    return make_loans(rows)


def pandas_features(d: pd.DataFrame) -> pd.DataFrame:
    f = pd.DataFrame(index=d.index)
    f["amount"] = d["amount"]
    f["amount_vs_product_avg"] = d["amount"] / (d.groupby("product_id")["amount"].transform("mean") + 1)
    f["amount_percentile"] = d["amount"].rank(pct=True)
    per = d.groupby("officer_id")["loan_id"].count()
    f["officer_loan_count"] = d["officer_id"].map(per)
    f["officer_volume_z"] = (f["officer_loan_count"] - per.mean()) / per.std()
    f["officer_approval_rate"] = d["officer_id"].map(d.groupby("officer_id")["status"].apply(lambda s: (s != "rejected").mean()))
    f["hour"] = d["created_at"].dt.hour.fillna(12)
    f["day_of_week"] = d["created_at"].dt.dayofweek.fillna(0)
    f["days_since_year_start"] = (d["created_at"] - pd.Timestamp(d["created_at"].min().year, 1, 1)).dt.days
    f["shared_phone_count"] = d.groupby("phone_number")["borrower_id"].transform("nunique")
    f["shared_guarantor_count"] = d.groupby("guarantor_name")["loan_id"].transform("count")
    f["national_id_loan_count"] = d.groupby("national_id")["loan_id"].transform("count")
    f["geographic_density"] = d.groupby(["latitude", "longitude"])["loan_id"].transform("count")
    f["officer_geo_concentration"] = d.groupby(["officer_id", "latitude", "longitude"])["loan_id"].transform("count")
    f["borrower_total_exposure"] = d.groupby("borrower_id")["amount"].transform("sum")
    f["borrower_officer_count"] = d.groupby("borrower_id")["officer_id"].transform("nunique")
    f["amount_vs_branch_avg"] = d["amount"] / (d.groupby("branch_id")["amount"].transform("mean") + 1)
    return f.fillna(0)


def test_features_match_pandas(book):
    matrix = features.feature_matrix(book)
    assert matrix.columns == ["loan_id", *FEATURE_NAMES]
    got = matrix.toPandas().set_index("loan_id").sort_index()
    source = book.toPandas().set_index("loan_id", drop=False).sort_index()
    want = pandas_features(source)
    for name in want:
        np.testing.assert_allclose(got[name], want[name].astype(float), rtol=1e-9, atol=1e-9, err_msg=name)


def test_fitted_statistics_are_reused(book):
    fitted = features.fit(book.filter("branch_id = 'X'"))
    rows = features.add_features(book, fitted, ["officer", "branch"]).select("branch_id", "branch_loan_count").distinct()
    counts = {r["branch_id"]: r["branch_loan_count"] for r in rows.collect()}
    assert counts["X"] > 0 and counts["Y"] == counts["Z"] == 0


def test_exact_quantiles_of_many_columns(spark):
    rng = np.random.default_rng(5)
    odd = np.array([0.0, -0.0, 1e-300, -1e300, np.inf, -np.inf, 2.5, 2.5])
    d = pd.DataFrame(
        {"a": rng.normal(size=3001) * 1e9, "b": rng.integers(0, 3, 3001) * 1.0, "c": np.resize(odd, 3001), "d": rng.normal(size=3001), "e": np.full(3001, -7.25)}
    )
    d.loc[d.index % 3 == 0, "d"] = None
    df = spark.createDataFrame([tuple(None if v != v else v for v in r) for r in d.itertuples(index=False)], "a double, b double, c double, d double, e double")
    df = df.withColumn("f", F.lit(None).cast("double")).repartition(5)
    shares = (0.0, 0.1, 0.25, 0.5, 0.75, 1.0)
    got = selection.quantiles(df, list("abcdef"), shares)
    for c in "abde":
        np.testing.assert_allclose(got[c], d[c].quantile(shares), rtol=1e-12)
    ranked = np.sort(d["c"].to_numpy())
    exact = selection.order_statistics(df, {"c": range(0, 3001, 100)})
    assert all(exact["c", r] == ranked[r] for r in range(0, 3001, 100))
    assert got["f"] == [None] * 6


@pytest.fixture(scope="module")
def transactions(spark):
    rng = random.Random(3)
    rows = []
    for i in range(500):
        customer = "hot" if rng.random() < 0.4 else f"c{rng.randrange(6)}"
        at = dt.datetime(2024, 1, 1) + dt.timedelta(seconds=rng.randrange(60 * 86400))
        if i % 10 == 0 and rows:
            at = rows[-1][2]
        rows.append(
            (customer, i, at, float(rng.randrange(1, 9999)) / 100, rng.choice(["a", "b", "c", None]), rng.random() < 0.2, "retail", rng.randrange(2), rng.random(), rng.random())
        )
    ddl = (
        "customer string, transaction_id long, ts timestamp_ntz, amount double, merchant string, failed boolean,"
        " merchant_category string, device int, latitude double, longitude double"
    )
    return spark.createDataFrame(rows, ddl)


@pytest.fixture(params=[1, 4, 37])
def partitions(request, spark):
    """Scans over few and many partitions: the hot customer goes on over several of them."""
    spark.conf.set("spark.sql.shuffle.partitions", str(request.param))
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_windows_match_brute_force(transactions, partitions):
    d = transactions.toPandas()
    d["s"] = (d["ts"] - pd.Timestamp("1970-01-01")) // pd.Timedelta(seconds=1)
    got = history.history_windows(transactions).toPandas().set_index("transaction_id")
    for row in d.itertuples():
        past = d[(d["customer"] == row.customer) & (d["s"] < row.s)]
        month, day, week = (past[past["s"] >= row.s - n * 86400] for n in (30, 1, 7))
        mine = got.loc[row.transaction_id]
        assert mine["transaction_count_30d"] == len(month)
        assert mine["failed_attempts_24h"] == day["failed"].sum()
        assert mine["unique_merchants_7d"] == week["merchant"].nunique()
        if len(month):
            assert mine["avg_amount_30d"] == pytest.approx(month["amount"].mean())
        else:
            assert pd.isna(mine["avg_amount_30d"])


def test_sequences_match_brute_force(transactions, partitions):
    d = transactions.toPandas().sort_values(["customer", "ts", "transaction_id"])
    got = {r["transaction_id"]: [s["transaction_id"] for s in r["sequence"]] for r in history.last_sequences(transactions).collect()}
    for _, group in d.groupby("customer"):
        ids = list(group["transaction_id"])
        for i, number in enumerate(ids):
            tail = ids[max(0, i - 6) : i + 1]
            assert got[number] == [None] * (7 - len(tail)) + tail


def test_previous_transaction_crosses_days(transactions, partitions):
    d = transactions.toPandas().sort_values(["customer", "ts", "transaction_id"])
    d["prev"] = d.groupby("customer")["ts"].shift()
    got = history.previous_transaction(transactions).toPandas().set_index("transaction_id")
    minutes = (d["ts"] - d["prev"]).dt.total_seconds() / 60
    np.testing.assert_allclose(got["minutes_since_prev"].loc[d["transaction_id"]], minutes, equal_nan=True)


@pytest.mark.parametrize("batch", ["2", "10000"])
def test_scan_matches_brute_force(spark, partitions, batch):
    """Strict sums, latest items and first time, with rows that only add; batches of two rows and whole ones."""
    rng = random.Random(partitions)
    rows = [(rng.choice("aaab") if rng.random() < 0.9 else "c", rng.randrange(60), i, rng.randrange(-3, 9), rng.random() < 0.5) for i in range(240)]
    df = spark.createDataFrame(rows, "k string, t long, i long, n long, told boolean")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        out = timeline.scan_timeline(df, "k", "t", ["i"], F.struct("k", "t", "i"), F.col("i"), 3, ["n"], F.col("told")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    told = [r for r in rows if r[4]]
    assert len(out) == len(told)
    for r in out:
        k, t, i = r["row"]
        mine = sorted(x[1:3] for x in told if x[0] == k)
        before = [x[1] for x in mine if x < (t, i)]
        assert r["previous"] == before[-3:] and r["first_at"] == mine[0][0]
        assert r["n"] == sum(x[3] for x in rows if x[0] == k and x[1] < t)


def test_following_times_cross_partitions(spark, partitions):
    rng = random.Random(1)
    rows = [(rng.choice("aab"), rng.choice("xy"), rng.randrange(40)) for _ in range(150)]
    df = spark.createDataFrame(rows, "a string, b string, t long")
    got = {(r["group"]["a"], r["group"]["b"], r["at"]): r["next_at"] for r in timeline.following_times(df, F.struct("a", "b"), "t").collect()}
    want = {}
    for a, b, t in set(rows):
        want[a, b, t] = min((x[2] for x in rows if x[:2] == (a, b) and x[2] > t), default=None)
    assert got == want


def test_transactions_without_customer_or_time_have_no_history(spark):
    ddl = "customer string, transaction_id long, ts timestamp_ntz, amount double, merchant string, failed boolean, device int, latitude double, longitude double"
    at = dt.datetime(2024, 1, 1)
    rows = [("a", 1, at, 1.0, "m", True, 1, 0.0, 0.0), (None, 2, at, 1.0, "m", True, 1, 0.0, 0.0), ("a", 3, None, 1.0, "m", True, 1, 0.0, 0.0)]
    rows.append(("a", 4, at + dt.timedelta(hours=1), None, None, None, None, None, None))
    got = {r["transaction_id"]: r for r in history.with_history(spark.createDataFrame(rows, ddl)).collect()}
    assert [got[i]["transaction_count_30d"] for i in (1, 2, 3, 4)] == [0, 0, 0, 1]
    assert got[4]["failed_attempts_24h"] == got[4]["unique_merchants_7d"] == 1 and got[4]["minutes_since_prev"] == 60
    assert got[2]["customer_age_days"] is None and got[4]["same_device"] is None
    assert history.last_sequences(spark.createDataFrame(rows, ddl)).count() == 4
    assert history.with_history(spark.createDataFrame([], ddl)).count() == 0


@pytest.mark.parametrize("past", [True, False])
def test_feature_sequences_are_the_vectors_in_order(transactions, partitions, past):
    rows = history.with_history(transactions) if past else transactions.select(
        "*", *[F.lit(None).cast(k).alias(c) for c, k in [("transaction_count_30d", "long"), ("avg_amount_30d", "double"),
        ("failed_attempts_24h", "long"), ("unique_merchants_7d", "long"), ("customer_age_days", "long"),
        ("minutes_since_prev", "double"), ("distance_from_prev", "double"), ("same_device", "boolean")]])
    vectors = {r[0]: list(r)[1:] for r in history.transaction_vector(rows).collect()}
    empty = [0.0, 0.0, 12.0, 2.0, 0.0, 0.0, 365.0, 10.0, 0.0, 0.3, 0.0, 0.0, 60.0, 0.0, 5.0]
    ids = {r["transaction_id"]: [s["transaction_id"] for s in r["sequence"]] for r in history.last_sequences(transactions).collect()}
    for r in history.feature_sequences(transactions, history=past).collect():
        want = [empty if i is None else vectors[i] for i in ids[r["transaction_id"]]]
        np.testing.assert_allclose(r["sequence"], want)


def test_vector_defaults(spark):
    ddl = (
        "transaction_id long, amount double, ts timestamp_ntz, avg_amount_30d double, customer_age_days long,"
        " transaction_count_30d long, merchant_category string, same_device boolean, distance_from_prev double,"
        " minutes_since_prev double, failed_attempts_24h long, unique_merchants_7d long"
    )
    rows = spark.createDataFrame([(1, 50.0, None, None, 0, 0, "CRYPTO", None, None, None, None, None), (2, 50.0, dt.datetime(2024, 1, 6, 18), 25.0, 9, 3, "5000", True, 2.0, 7.5, 1, 2)], ddl)
    first, second = history.transaction_vector(rows).orderBy("transaction_id").collect()
    assert list(first)[1:] == [50.0, 1.0, 12.0, 2.0, 0.0, 0.0, 365.0, 10.0, 50.0, 0.75, 0.0, 0.0, 60.0, 0.0, 5.0]
    assert list(second)[1:] == [50.0, 2.0, 18.0, 5.0, 1.0, 1.0, 9.0, 3.0, 25.0, 0.5, 1.0, 2.0, 7.5, 1.0, 2.0]
