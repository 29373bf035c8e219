"""A loan book derived from the TPC-H-style tables, used by the registered queries and the tests."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.session import kept_table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def loans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order: the order is the loan, its lines give officer and phone, its event the approval instant.

    No join is hinted: the small dimension files are under the broadcast threshold at test size and shuffled
    beyond it. Columns a query does not use are pruned, together with the joins' unused inputs.
    """
    orders = table(spark, sf_dir, "orders")
    line = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(F.min("l_partkey").alias("l_partkey"), F.max("l_suppkey").alias("l_suppkey"))
    )
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_name", "p_brand")
    events = table(spark, sf_dir, "events").select("event_id", "ts")

    joined = (
        orders.join(line, orders.o_orderkey == line.l_orderkey, "left")
        .join(customer, F.col("c_custkey") == F.col("o_custkey"), "left")
        .join(nation, F.col("n_nationkey") == F.col("c_nationkey"), "left")
        .join(supplier, F.col("s_suppkey") == F.col("l_suppkey"), "left")
        .join(part, F.col("p_partkey") == F.col("l_partkey"), "left")
        .join(events, F.col("event_id") == F.col("o_orderkey"), "left")
    )
    phone_digits = (F.col("l_partkey") * 100 + F.col("l_suppkey") % 100).cast("string")
    even_customer = (F.col("c_custkey") - F.col("c_custkey") % 2).cast("string")
    big = F.when(F.col("o_orderkey") % 97 == 0, 10).otherwise(1)
    return joined.select(
        F.col("o_orderkey").alias("loan_id"),
        F.col("o_custkey").alias("borrower_id"),
        F.col("c_name").alias("borrower_name"),
        F.concat(F.lit("07"), F.lpad(phone_digits, 8, "0")).alias("phone_number"),
        F.concat(F.lit("NIN"), F.lpad(even_customer, 9, "0")).alias("national_id"),
        (F.round(F.col("o_totalprice") / 1000.0) * 1000.0 * big).alias("amount"),
        F.col("o_orderdate").cast("date").alias("loan_date"),
        F.col("ts").alias("created_at"),
        F.date_format("ts", "HH:mm:ss").alias("approval_time"),
        F.col("l_suppkey").alias("officer_id"),
        F.col("s_name").alias("officer_name"),
        F.col("c_nationkey").alias("branch_id"),
        F.col("n_name").alias("branch_name"),
        F.when(F.col("o_orderstatus") == "O", "active")
        .when(F.col("o_orderstatus") == "F", "completed")
        .otherwise("defaulted")
        .alias("status"),
        F.col("p_type").alias("product_id"),
        F.concat("p_name", F.lit(" "), "p_brand").alias("guarantor_name"),
        ((F.col("o_custkey") % 50) * 0.001).alias("latitude"),
        ((F.col("l_partkey") % 40) * 0.001).alias("longitude"),
    )


INPUTS = ("orders", "lineitem", "customer", "nation", "supplier", "part", "events")


def _state(spark: SparkSession, sf_dir: str) -> str:
    """Sizes and times of the inputs' files: changes when an input does."""
    jvm, marks = spark.sparkContext._jvm, []
    for name in INPUTS:
        path = jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        marks += [f"{s.getPath()}|{s.getLen()}|{s.getModificationTime()}" for s in files.listStatus(path)]
    return hashlib.sha256("\n".join(sorted(marks)).encode()).hexdigest()[:24]


def loan_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The loan book as a table in the shared folder, written once for a state of its input files.

    Detectors and features pass over the book many times; each pass then scans the columns it needs instead of
    repeating the joins. The name of the table tells the state, so a changed input gives a new table.
    """
    return kept_table(loans(spark, sf_dir), f"loans-{_state(spark, sf_dir)}")
