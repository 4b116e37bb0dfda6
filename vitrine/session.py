"""Session set-up, table loading and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "vitrine", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings every job here relies on; a cluster's own submit settings win over none of them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder. Only a local session without one gets a temporary folder."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        shared = tempfile.mkdtemp(prefix="vitrine-checkpoint-")
    context.setCheckpointDir(shared)
    return shared


def cut(df: DataFrame, replaces: DataFrame | None = None) -> DataFrame:
    """Write the rows as Parquet to the shared folder and read them back: bounded lineage that survives a lost executor.

    ``replaces`` is an earlier result of ``cut`` that nothing reads any more, such as the round before; its files are deleted.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/vitrine-cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._cut_path = path
    old = getattr(replaces, "_cut_path", None)
    if old:
        place = spark._jvm.org.apache.hadoop.fs.Path(old)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return found


class Tables:
    """Lazily read parquet tables of one folder: ``Tables(spark, dir).pages``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
