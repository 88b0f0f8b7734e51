"""Readers with fixed schemas; malformed rows are skipped, never guessed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.functions.scalar import parse_utc
from footfall.sources import schemas


def read_jsonl(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """One JSON object per line; lines that do not parse are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_csv(spark: SparkSession, path: str | list[str], schema: str, columns: Sequence[str] | None = None, **options) -> DataFrame:
    df = spark.read.schema(schema).options(header=True, mode="DROPMALFORMED", **options).csv(path)
    return df if columns is None else df.select(*columns)


def read_tsv_typed(spark: SparkSession, path: str | list[str], schema: str, casts: dict[str, str | Column], required: Sequence[str] = ()) -> DataFrame:
    """Headerless TSV read as text; columns named in ``casts`` are try-cast (or computed), and rows where a required
    column is missing or unreadable are dropped."""
    raw = spark.read.schema(schema).options(sep="\t", header=False, mode="DROPMALFORMED", quote="").csv(path)
    cols = {c: (F.col(c).try_cast(t) if isinstance(t, str) else t) for c, t in casts.items()}
    out = raw.withColumns(cols)
    return out.dropna(subset=list(required)) if required else out


def read_pois(spark: SparkSession, path) -> DataFrame:
    return read_tsv_typed(spark, path, schemas.POIS, {"lat": "double", "lon": "double"}, ("venue_id", "lat", "lon"))


def read_checkins_b(spark: SparkSession, path) -> DataFrame:
    """Second-platform check-ins with UTC and local time."""
    df = read_tsv_typed(spark, path, schemas.CHECKINS_B, {"user_id": "bigint", "tz_offset_min": "int"}, ("user_id", "venue_id"))
    out = df.withColumn("utc_ts", parse_utc("utc_text")).withColumn("local_ts", parse_utc("utc_text", "tz_offset_min"))
    return out.drop("utc_text").dropna(subset=["utc_ts"])


def read_friendships(spark: SparkSession, *paths: str) -> DataFrame:
    """All snapshots as raw (a, b) rows."""
    return read_tsv_typed(spark, list(paths), schemas.FRIENDSHIPS, {"a": "bigint", "b": "bigint"}, ("a", "b"))


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if columns is None else df.select(*columns)


def first_existing(spark: SparkSession, paths: Sequence[str]) -> str | None:
    """The first path that exists on its Hadoop file system."""
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    for p in paths:
        hp = jvm.org.apache.hadoop.fs.Path(p)
        if hp.getFileSystem(conf).exists(hp):
            return p
    return None


def read_optional(spark: SparkSession, paths: Sequence[str], schema: str, fmt: str = "parquet", **options) -> DataFrame:
    """The first existing path, or an empty table of the schema."""
    found = first_existing(spark, paths)
    if found is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).options(**options).format(fmt).load(found)
