"""Readers, sinks, history and streams."""

from __future__ import annotations

import datetime as dt
import json
import os
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import alerts as summaries
from ledgerlens.functions.clock import as_instant
from ledgerlens.operators import history, rules
from ledgerlens.plans.analysis import analyse
from ledgerlens.session import checkpoint_root, written_table
from ledgerlens.sources import readers, sinks
from ledgerlens.streaming import monitors, scoring


def test_csv_keeps_text_and_pads_rows(spark, tmp_path):
    path = tmp_path / "book.csv"
    path.write_text('Loan ID, Phone No ,Name\n L1 ,0772 ,"Lee, ""Ann"""\n\nL2,,\nL3\n')
    rows = readers.read_csv(spark, str(path), tidy_header=True).orderBy("loan_id").collect()
    assert [r.asDict() for r in rows] == [
        {"loan_id": "L1", "phone_no": "0772", "name": 'Lee, "Ann"'},
        {"loan_id": "L2", "phone_no": None, "name": None},
        {"loan_id": "L3", "phone_no": None, "name": None},
    ]


def test_lines_that_do_not_fit_are_told(spark, tmp_path):
    path = tmp_path / "book.csv"
    path.write_text('Loan ID,Phone,Name\nL1,07,"Lee, ""Ann"""\nL2,08\nL3,09,Bo,extra,"a,b"\nL4,"10,Cy\n\nL5,,\n')
    rows, rejects = readers.read_csv_checked(spark, str(path), tidy_header=True)
    assert {r["loan_id"]: r["name"] for r in rows.collect()} == {"L1": 'Lee, "Ann"', "L2": None, "L3": "Bo", "L4": None, "L5": None}
    got = {(r["kind"], r["fields"], r["line"]) for r in rejects.collect()}
    assert got == {("short", 2, "L2,08"), ("long", 5, 'L3,09,Bo,extra,"a,b"'), ("open", 3, 'L4,"10,Cy')}


def test_json_records_allow_missing_fields(spark, tmp_path):
    path = tmp_path / "book.json"
    path.write_text('{"loan_id": "L1", "amount": 5}\n{"loan_id": "L2", "phone": "07", "extra": 1}\n')
    rows = {r["loan_id"]: r for r in readers.read_json_records(spark, str(path)).collect()}
    assert rows["L1"]["amount"] == 5.0 and rows["L1"]["phone"] is None and rows["L2"]["phone"] == "07"
    (tmp_path / "array.json").write_text('[{"loan_id": "A"},\n {"loan_id": "B"}]')
    assert readers.read_json_array(spark, str(tmp_path / "array.json")).count() == 2


def test_overrides_and_preview(spark):
    assert readers.parse_overrides('{"mid": "borrower_id"}') == {"mid": "borrower_id"}
    assert readers.parse_overrides(None) == {}
    assert [r["id"] for r in readers.preview(spark.range(100), 3, "id").collect()] == [0, 1, 2]


def test_json_sink_keeps_nulls_and_writes_iso_times(spark):
    df = spark.createDataFrame(
        [(1, float("nan"), None, dt.date(2024, 1, 2), dt.datetime(2024, 1, 2, 3, 4, 5))],
        "a int, b double, c string, d date, e timestamp_ntz",
    )
    assert json.loads(sinks.json_records(df).first()["value"]) == {
        "a": 1,
        "b": None,
        "c": None,
        "d": "2024-01-02",
        "e": "2024-01-02T03:04:05",
    }


@pytest.fixture(scope="module")
def small_book(make_loans):
    rows = [
        {
            "loan_id": f"L{i}",
            "borrower_id": f"B{i // 2}",
            "phone_number": "07" if i < 5 else f"p{i}",
            "amount": 1000.0 * (i + 1),
            "officer_id": "O1",
            "officer_name": 'The "One", Esq.',
            "approval_time": "23:00" if i == 3 else "10:00",
            "loan_date": dt.date(2024, 1, 1),
            "status": "active",
        }
        for i in range(12)
    ]
    return make_loans(rows)


def test_report_round_trip(spark, small_book, tmp_path):
    analysis = analyse(small_book, "rule_only", "engine")
    summary, officers = analysis.summary(), analysis.officers()
    path = str(tmp_path / "report")
    sinks.write_report(path, summary, analysis.alerts, officers)
    back = spark.read.option("header", True).option("escape", '"').csv(f"{path}/alerts")
    assert back.count() == analysis.alerts.count()
    assert {r["Type"] for r in back.collect()} >= {"GHOST LOAN", "LOAN STACKING", "TIMING ANOMALY"}
    names = spark.read.option("header", True).option("escape", '"').csv(f"{path}/officers").collect()
    assert names[0]["Name"] == 'The "One", Esq.'
    heading = {r["Metric"]: r["Value"] for r in spark.read.option("header", True).csv(f"{path}/heading").collect()}
    assert heading["Total Records"] == "12" and heading["Risk Score"].endswith("/100")
    sinks.write_results(str(tmp_path / "json"), summary, analysis.alerts, officers)
    assert spark.read.json(str(tmp_path / "json/alerts")).count() == analysis.alerts.count()


def test_analysis_modes(small_book):
    both = analyse(small_book, "full", top_ml=None)
    row = both.summary().first()
    assert row["total_alerts"] == row["rule_alerts"] + row["ml_alerts"] and row["ml_alerts"] > 0
    assert analyse(small_book, "ml_only").summary().first()["rule_alerts"] == 0
    assert analyse(small_book, "rule_only").summary().first()["ml_alerts"] == 0
    assert both.members().select("alert_id").distinct().count() == both.alerts.count()
    with pytest.raises(ValueError):
        analyse(small_book, "other")


def test_members_tell_the_methods_without_a_join_on_ids(small_book):
    """A loan behind an id that rules and models both gave counts for both; the plan shuffles no alert ids."""
    analysis = analyse(small_book, "full", top_ml=None)
    some = analysis.alerts.limit(3).withColumn("detection_method", F.when(F.col("detection_method") == "rule", "ml").otherwise("rule"))
    analysis.alerts = analysis.alerts.unionByName(some).localCheckpoint()
    methods = analysis.alerts.select("alert_id", F.col("detection_method").alias("method"))
    want = {(r["loan_id"], r["method"]) for r in analysis.members().join(methods, "alert_id").collect()}
    found = analysis.members(methods=True).select("loan_id", "rule", "ml")
    got = {(r["loan_id"], m) for r in found.collect() for m in ("rule", "ml") if r[m]}
    assert got == want and {m for _, m in got} == {"rule", "ml"}
    assert "alert_id" not in found._jdf.queryExecution().sparkPlan().toString().split("Scan")[0]


def test_officer_risk_is_monotone(small_book):
    alerts = rules.all_alerts(small_book, "engine")
    rows = summaries.officer_risk(small_book, alerts, 10).collect()
    assert [r["risk_score"] for r in rows] == sorted((r["risk_score"] for r in rows), reverse=True)


def test_history_keeps_only_the_users_latest(spark, tmp_path):
    path = str(tmp_path / "history")
    base = spark.range(30).select(
        F.when(F.col("id") % 2 == 0, "ann").otherwise("bob").alias("user_id"),
        F.concat(F.lit("f"), F.col("id")).alias("file_name"),
        F.lit(10).alias("total_records"),
        F.lit(1).alias("critical_alerts"),
        F.lit(2).alias("high_alerts"),
        F.lit(3).alias("medium_alerts"),
        F.lit(50).alias("low_alerts"),
        F.lit(7).alias("risk_score"),
        F.timestamp_seconds(F.col("id") * 1000).alias("created_at"),
    )
    rows = sinks.history_rows(base)
    sinks.append_history(rows.filter("user_id = 'ann'"), path)
    sinks.append_history(rows.filter("user_id = 'bob'"), path)
    found = sinks.read_history(spark, path, "ann", 10).collect()
    assert [r["file_name"] for r in found] == [f"f{i}" for i in range(28, 8, -2)]
    assert {r["alerts_generated"] for r in found} == {6}


def test_written_tables_go_to_the_named_folder(spark):
    table = written_table(spark.range(5), "five")
    assert all(checkpoint_root(spark) in f for f in table.inputFiles()) and table.count() == 5


EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double"


def write_events(spark, folder, name, rows):
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(f"{folder}/{name}")


def test_daily_stream_drops_late_rows(spark, tmp_path):
    day = lambda d, h=12: dt.datetime(2024, 1, d, h)
    folder = str(tmp_path / "in")
    schema = spark.createDataFrame([], EVENTS).schema
    stream = lambda: monitors.read_events(spark, f"{folder}/*", schema, "*.parquet")
    state = str(tmp_path / "state")
    write_events(spark, folder, "a", [(1, day(1), 7, "view", 1.0), (2, day(1, 13), 7, "view", 2.0), (3, day(9), 8, "view", 1.0)])
    first = monitors.run_available(monitors.daily_repeats(stream()), state).collect()
    assert [(str(r["day"]), r["user_id"], r["events"], r["total"]) for r in first] == [("2024-01-01", 7, 2, 3.0)]
    write_events(
        spark,
        folder,
        "b",
        [(4, day(1, 14), 7, "view", 9.0), (5, day(9, 13), 8, "view", 1.0), (6, day(20), 9, "view", 1.0)],
    )
    rows = monitors.run_available(monitors.daily_repeats(stream()), state).collect()
    assert sorted((str(r["day"]), r["user_id"], r["events"]) for r in rows) == [("2024-01-01", 7, 2), ("2024-01-09", 8, 2)]


def test_failure_bursts_join_close_attempts(spark, tmp_path):
    minute = lambda d, m: dt.datetime(2024, 1, d) + dt.timedelta(minutes=m)
    folder = str(tmp_path / "in")
    rows = [
        (1, minute(1, 0), 7, "error", 1.0),
        (2, minute(1, 100), 7, "error", 1.0),
        (3, minute(1, 900), 7, "error", 1.0),
        (4, minute(1, 5), 7, "view", 1.0),
        (5, minute(9, 0), 8, "error", 1.0),
    ]
    write_events(spark, folder, "a", rows)
    schema = spark.createDataFrame([], EVENTS).schema
    found = monitors.run_available(monitors.failure_bursts(monitors.read_events(spark, f"{folder}/*", schema))).collect()
    assert [(r["user_id"], r["failures"]) for r in found] == [(7, 2)]


@pytest.mark.parametrize("files", [1, 6])
def test_stream_scores_equal_the_table(spark, tmp_path, files):
    """Transactions in order of time over several micro-batches: the same history columns as from the whole table."""
    rng = random.Random(files)
    start, rows = dt.datetime(2024, 1, 1), []
    for i in range(240):
        at = start + dt.timedelta(seconds=rng.randrange(90 * 24) * 3600 + rng.choice([0, 0, 7]), microseconds=rng.choice([0, 5]))
        rows.append((rng.choice(["hot", "hot", "a", "b"]), i, at, rng.choice([None, rng.randrange(1, 9999) / 100]), rng.choice(["m", "n", "o", None]),
                     rng.random() < 0.3, "retail", rng.choice([0, 1, None]), rng.random(), rng.choice([None, rng.random()])))
    rows.sort(key=lambda r: (r[2], r[1]))
    ddl = ("customer string, transaction_id long, ts timestamp_ntz, amount double, merchant string, failed boolean,"
           " merchant_category string, device int, latitude double, longitude double")  # fmt: skip
    table, size = spark.createDataFrame(rows, ddl), 240 // files
    for k in range(files):
        folder = tmp_path / f"part{k}"
        spark.createDataFrame(rows[k * size : (k + 1) * size], ddl).coalesce(1).write.parquet(str(folder))
        (tmp_path / "in").mkdir(exist_ok=True)
        written = next(folder.glob("*.parquet"))
        target = tmp_path / "in" / f"{k}.parquet"
        target.write_bytes(written.read_bytes())
        os.utime(target, (1_700_000_000 + k, 1_700_000_000 + k))
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream = stream.withColumn("ts", as_instant(F.col("ts")))
    with scoring.rocksdb_state(spark):
        got = monitors.run_available(scoring.scored_history(stream)).toPandas()
    want = history.with_history(table).toPandas()
    got, want = (d.sort_values("transaction_id", ignore_index=True)[want.columns] for d in (got, want))
    assert len(got) == 240
    pd.testing.assert_frame_equal(got, want, check_dtype=False, rtol=1e-9)
    vectors = history.transaction_vector(history.with_history(table)).count()
    assert vectors == 240


def test_distinct_merchants_of_a_window():
    rng = random.Random(4)
    merchants = [rng.choice(["a", "b", "c", None]) for _ in range(60)]
    at = np.sort(np.array([rng.randrange(40) for _ in range(60)]))
    low, high = np.searchsorted(at, at - 7, "left"), np.searchsorted(at, at, "left")
    got = scoring._distinct_between(merchants, at, low, high, at)
    assert got.tolist() == [len({m for m in merchants[a:b] if m}) for a, b in zip(low, high, strict=True)]
