"""Session settings and the shared folder for written intermediate tables."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def build_session(app_name: str = "ledgerlens", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every job here assumes; `conf` keys use `__` for dots."""
    settings = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by `spark.checkpoint.dir`.

    Only a local session (tests, a laptop) may run without that setting: it gets a fresh temporary folder.
    On a cluster a driver-local folder would be invisible to the executors, so the setting is required there.
    """
    sc = spark.sparkContext
    root = spark.conf.get(CHECKPOINT_DIR, None) or sc.getConf().get(CHECKPOINT_DIR) or sc.getCheckpointDir()
    if root is None:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder every executor can reach")
        root = tempfile.mkdtemp(prefix="ledgerlens-")
        sc.setCheckpointDir(root)
    return root


class Scratch:
    """Tables in the shared folder that belong to one run of an operator.

    `write` cuts the lineage: the rows come back from files that every executor can read, so a lost executor costs
    nothing that was written before. `drop` deletes what nobody reads any more.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{checkpoint_root(spark)}/scratch/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex[:12]}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables. The driver collects garbage, so that Spark also removes shuffle files of finished steps."""
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        gc.collect()
        jvm.System.gc()


def written_table(df: DataFrame, label: str) -> DataFrame:
    """Write `df` once to the shared folder and read it back.

    The result survives executor loss, has no lineage to recompute, and carries its real size, so Catalyst
    broadcasts it only when the file is under `spark.sql.autoBroadcastJoinThreshold` and otherwise shuffles
    (with AQE splitting hot keys on the other side).
    """
    spark = df.sparkSession
    root = checkpoint_root(spark)
    path = f"{root}/tables/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def kept_table(df: DataFrame, name: str) -> DataFrame:
    """The table `name` of this application, written from `df` unless it is complete already."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/tables/{spark.sparkContext.applicationId}/{name}"
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def own_folder(spark: SparkSession, kind: str) -> str:
    """A new folder of this application in the shared folder, for files of one kind (see WRITTEN)."""
    return f"{checkpoint_root(spark)}/{kind}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


#: What an application writes to the shared folder.
WRITTEN = ("tables", "scratch", "exchange", "streams", "exports")


def release_tables(spark: SparkSession) -> None:
    """Delete everything this application wrote. Call it when no result that reads it is needed any more."""
    sc, root = spark.sparkContext, checkpoint_root(spark)
    for kind in WRITTEN:
        path = sc._jvm.org.apache.hadoop.fs.Path(f"{root}/{kind}/{sc.applicationId}")
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
