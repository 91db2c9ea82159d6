"""Session settings shared by the tests, the bench and interactive use."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = 8, name: str = "chronoweave", partitions: int = 8) -> SparkSession:
    """A session on this machine; on a cluster the submitter's settings hold instead."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return (
        builder.config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", os.environ.get("CHRONOWEAVE_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own: dict[str, str] = {}


def _shared(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which every executor shares.

    Where that setting is empty, a folder of our own is taken on a local master, as in tests; on a cluster there is
    no place that all executors share, so that is an error.
    """
    shared, context = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if shared:
        return shared.rstrip("/")
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _own:
        import tempfile

        _own[context.applicationId] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _own[context.applicationId]


def shared_folder(spark: SparkSession) -> str:
    """A new folder's path below the shared one."""
    import uuid

    return f"{_shared(spark)}/{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """checkpoint() into the shared folder."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(_shared(df.sparkSession))
    return df.checkpoint()
