"""What the operators share: the folder all executors see, tables written there, and files in it."""

from __future__ import annotations

import posixpath
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.session import freed_shuffles

BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
# For rows with whole texts; Spark's own bound is 64 MB.
TEXT_BATCH = "4m"


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one that the session names for data that executors share.

    ``spark.checkpoint.dir`` is read from the session. Only a local master may lack it; its warehouse folder is used then.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = posixpath.join(spark.conf.get("spark.sql.warehouse.dir"), "_scratch")
    return posixpath.join(base.rstrip("/"), f"llm-{uuid.uuid4().hex}")


def settled(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends there and lost executors don't matter.
    The shuffles it took are dropped then."""
    spark = df.sparkSession
    path = shared_folder(spark)
    with freed_shuffles(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def text_batches(spark: SparkSession):
    """Actions inside send rows to Python in Arrow batches of ``TEXT_BATCH``: whole texts lie in the JVM and in the worker a batch at a time."""
    usual = spark.conf.get(BATCH_BYTES)
    spark.conf.set(BATCH_BYTES, TEXT_BATCH)
    try:
        yield
    finally:
        spark.conf.set(BATCH_BYTES, usual)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def open_store(uri: str):
    """File system and path of a folder or file, for tasks that write or read ranges of binary files."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_file(uri: str, data: bytes) -> None:
    """Write under a name of its own, then rename: a task that runs again or twice leaves one whole file."""
    store, path = open_store(uri)
    store.create_dir(posixpath.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(part) as out:
        out.write(data)
    store.move(part, path)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def content_keys(salt: int) -> dict[str, Column]:
    """k1, k2: 128 bits of a row's doc_id and text. Rows alike in both share them; nulls and empty texts differ."""
    text = F.col("text").cast("string")
    content = [F.col("doc_id").isNull(), F.col("doc_id").cast("bigint"), text.isNull(), text]
    return {"k1": F.xxhash64(*content), "k2": F.xxhash64(F.lit(salt), *content)}
