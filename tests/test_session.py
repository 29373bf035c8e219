"""Written tables: kept by name, dropped by their owner, released as a whole."""

from __future__ import annotations

import os

import pytest

from ledgerlens.operators.graph import connected_components
from ledgerlens.session import Scratch, checkpoint_root, kept_table
from ledgerlens.sources.loan_view import INPUTS, _state
from ledgerlens.streaming import monitors


def test_kept_table_is_written_once_per_name(spark):
    first = kept_table(spark.range(3).toDF("x"), "kept-a")
    again = kept_table(spark.range(9).toDF("x"), "kept-a")
    other = kept_table(spark.range(9).toDF("x"), "kept-b")
    assert (first.count(), again.count(), other.count()) == (3, 3, 9)


def test_scratch_drops_its_tables(spark):
    scratch = Scratch(spark, "t")
    scratch.write(spark.range(3).toDF("x"), "one")
    scratch.write(spark.range(3).toDF("x"), "two")
    folder = scratch.root.removeprefix("file:")
    scratch.drop("one")
    assert sorted(os.listdir(folder)) == ["two"]


def test_components_leave_one_table(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "source long, target long")
    out = connected_components(edges)
    root = os.path.dirname(Scratch(spark, "x").root.removeprefix("file:"))
    newest = max((os.path.join(root, f) for f in os.listdir(root) if f.startswith("components")), key=os.path.getmtime)
    assert len(os.listdir(newest)) == 1
    assert {r["component"] for r in out.collect()} == {0} and out.count() == 41
    assert connected_components(edges.limit(0)).count() == 0


def test_state_follows_the_inputs(spark, tmp_path):
    for name in INPUTS:
        spark.range(2).write.parquet(str(tmp_path / f"{name}.parquet"))
    before = _state(spark, str(tmp_path))
    assert _state(spark, str(tmp_path)) == before
    spark.range(5).write.mode("append").parquet(str(tmp_path / "orders.parquet"))
    assert _state(spark, str(tmp_path)) != before


def test_bounded_stream_equals_a_batch(spark, tmp_path):
    rows = [(i, f"u{i % 3}", f"2024-01-{1 + i % 9:02d} 1{i % 9}:00:00", float(i), "error") for i in range(50)]
    table = spark.createDataFrame(rows, "event_id long, user_id string, t string, value double, event_type string")
    table = table.selectExpr("event_id", "user_id", "cast(t as timestamp_ntz) as ts", "value", "event_type")
    table.repartition(4).write.parquet(str(tmp_path / "events"))
    stream = monitors.read_events(spark, str(tmp_path / "events"), table.schema, files_per_batch=1)
    got = monitors.run_bounded(monitors.daily_repeats(stream)).collect()
    want = table.selectExpr("cast(ts as date) as day", "user_id", "value").groupBy("day", "user_id").count().filter("count > 1")
    assert {(r["day"], r["user_id"], r["events"]) for r in got} == {tuple(r) for r in want.collect()}


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "local-cluster[2,1,1024]"

        def getConf(self):
            return Conf()

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="checkpoint"):
        checkpoint_root(Session())


