"""Writers and the health report over written tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.operators.clean import null_profile
from footfall.sources.readers import first_existing


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", partition_by: Sequence[str] = ()) -> None:
    writer = df.write.mode(mode).option("compression", "snappy")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def save_table(df: DataFrame, name: str, bucket_by: Sequence[str] = (), buckets: int = 0, mode: str = "overwrite") -> None:
    """A managed table, bucketed when later joins use the same key."""
    writer = df.write.mode(mode).format("parquet")
    if bucket_by and buckets:
        writer = writer.bucketBy(buckets, *bucket_by).sortBy(*bucket_by)
    writer.saveAsTable(name)


def health_report(spark: SparkSession, paths: dict[str, str], fmt: str = "parquet") -> DataFrame:
    """Per required output: whether it exists, and rows and missing values per column."""
    out = spark.createDataFrame([], "name string, present boolean, column string, rows bigint, nulls bigint")
    for name, path in paths.items():
        if first_existing(spark, [path]) is None:
            part = spark.range(1).select(
                F.lit(name).alias("name"), F.lit(False).alias("present"), F.lit(None).cast("string").alias("column"),
                F.lit(None).cast("bigint").alias("rows"), F.lit(None).cast("bigint").alias("nulls"),
            )
        else:
            df = spark.read.format(fmt).option("header", True).load(path)
            part = null_profile(df).select(F.lit(name).alias("name"), F.lit(True).alias("present"), "column", "rows", "nulls")
        out = out.unionByName(part)
    return out
