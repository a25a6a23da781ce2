"""Session helper and lineage cutting."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "turnloom", cores: str = "*", shuffle: int | None = None) -> SparkSession:
    """A local session for tests and benches.  Clusters bring their own."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", "8g")
        # small local inputs still spread over the cores
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "16k")
    )
    if shuffle:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle))
    return b.getOrCreate()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the folder of ``spark.checkpoint.dir``."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_root(df.sparkSession))
    return df.checkpoint(eager=True)


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors see.  Without ``spark.checkpoint.dir`` only a local master may use a folder of this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", root)
    return root
