"""Session settings and the reliable scratch folder."""

from __future__ import annotations

import posixpath
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", shuffle_partitions: int = 8, app: str = "footfall") -> SparkSession:
    """A local session for tests and benchmarks. A cluster brings its own session and settings."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names in ``spark.checkpoint.dir``.

    A local-mode session without that setting uses a new folder in its warehouse, the storage it names itself; anywhere
    else a machine-local folder would be lost with its executor, so the setting is required.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        named = posixpath.join(spark.conf.get("spark.sql.warehouse.dir"), f"_checkpoints-{uuid.uuid4().hex}")
    sc.setCheckpointDir(named)


FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed_shuffles(spark: SparkSession):
    """Tables written inside leave no shuffle files behind: they go with the action, not when the driver's memory is collected."""
    usual = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.unset(FREE_SHUFFLES) if usual is None else spark.conf.set(FREE_SHUFFLES, usual)


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and read it from there: cuts lineage, survives lost executors. Its shuffles are dropped then."""
    ensure_checkpoint_dir(df.sparkSession)
    with freed_shuffles(df.sparkSession):
        return df.checkpoint(eager=True)
