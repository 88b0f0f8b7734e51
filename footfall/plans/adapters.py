"""Visit-shaped views over the star-schema test tables: one DataFrame per domain table."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Tables:
    """Lazily built views; every one grows linearly with the tables it reads."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        # Views cast zone-less timestamps, and local-time operators add their own offsets.
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def _lines(self) -> DataFrame:
        line = self.raw("lineitem").select(
            "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag", "l_shipdate"
        )
        orders = self.raw("orders").select("o_orderkey", "o_custkey")
        return line.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))

    @cached_property
    def _minute(self):
        return F.make_dt_interval(mins=((F.col("l_orderkey") * 7 + F.col("l_linenumber") * 61) % 1440).cast("int"))

    @cached_property
    def interactions(self) -> DataFrame:
        anonymous = F.col("l_returnflag") == "R"
        return self._lines.select(
            F.when(~anonymous, F.col("o_custkey")).alias("user_id"),
            F.col("l_suppkey").alias("business_id"),
            (F.col("l_shipdate").cast("timestamp") + self._minute).alias("ts"),
            F.when(anonymous, F.lit("checkin")).otherwise(F.lit("review")).alias("interaction_type"),
            F.when(~anonymous, (1 + F.col("l_quantity").cast("int") % 5).cast("double")).alias("stars"),
        )

    @cached_property
    def reviews(self) -> DataFrame:
        return self.interactions.where(F.col("user_id").isNotNull())

    @cached_property
    def businesses(self) -> DataFrame:
        s = self.raw("supplier")
        n = self.raw("nation")
        r = self.raw("region")
        key = F.col("s_suppkey")
        # Blocks of 100 venues lie next to each other, so the density of points stays the same at any size.
        block = F.floor(key / 100).cast("double") * F.lit(0.1)
        kinds = ["Coffee & Tea, Food", "Hotels, Resorts", "Restaurants, Bars", "Dinner Theater"]
        category = F.when(key % 5 == 0, F.lit(kinds[0]))
        for i, kind in enumerate(kinds[1:], 1):
            category = category.when(key % 5 == i, F.lit(kind))
        return (
            s.join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey"))
            .join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(
                key.alias("business_id"),
                F.col("s_name").alias("name"),
                F.col("n_name").alias("city"),
                F.col("r_name").alias("state"),
                (F.lit(39.9) + (key * 37 % 100) * F.lit(0.001)).alias("latitude"),
                (F.lit(-75.2) + (key * 53 % 100) * F.lit(0.001) + block).alias("longitude"),
                (1 + (key % 9) * F.lit(0.5)).alias("stars"),
                (key * 13 % 200).cast("int").alias("review_count"),
                category.alias("categories"),
            )
        )

    @cached_property
    def pois(self) -> DataFrame:
        key = F.col("p_partkey")
        block = F.floor(key / 2000).cast("double") * F.lit(0.1)
        return self.raw("part").select(
            key.alias("poi_id"),
            (F.lit(39.9) + (key * 41 % 1000) * F.lit(0.0001)).alias("lat"),
            (F.lit(-75.2) + (key * 59 % 1000) * F.lit(0.0001) + block).alias("lon"),
            F.concat_ws(" ", "p_type", "p_name", F.when(key % 2 == 0, F.lit("food")).otherwise(F.lit("hotels"))).alias(
                "category"
            ),
        )

    @cached_property
    def friendships(self) -> DataFrame:
        """Raw friend rows with repeats and self loops: the customers of neighbouring orders."""
        o = self.raw("orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("a"))
        nxt = self.raw("orders").select((F.col("o_orderkey") - 1).alias("k"), F.col("o_custkey").alias("b"))
        return o.join(nxt, "k").select("a", "b")

    @cached_property
    def checkins_b(self) -> DataFrame:
        """Second-platform check-ins with their own user ids, points of interest, UTC time and zone offset."""
        return self._lines.select(
            (F.col("o_custkey") + 1_000_000).alias("b_user_id"),
            F.col("l_partkey").alias("poi_id"),
            F.col("l_suppkey").alias("business_id"),
            (F.col("l_shipdate").cast("timestamp") + F.make_dt_interval(hours=(F.col("l_orderkey") % 96).cast("int"))).alias(
                "utc_ts"
            ),
            F.lit(-300).alias("tz_offset_min"),
        )

    @cached_property
    def visits_a(self) -> DataFrame:
        """First-platform visits to shared places."""
        return self._lines.where(F.col("l_returnflag") != "R").select(
            F.col("o_custkey").alias("user_id"),
            F.col("l_partkey").alias("place_id"),
            (F.col("l_shipdate").cast("timestamp") + self._minute).alias("ts"),
        )

    @cached_property
    def visits_b(self) -> DataFrame:
        return self.checkins_b.select(
            F.col("b_user_id").alias("user_id"), F.col("poi_id").alias("place_id"), F.col("utc_ts").alias("ts")
        )

    @cached_property
    def events(self) -> DataFrame:
        return self.raw("events").withColumn("ts", F.col("ts").cast("timestamp"))

    @cached_property
    def ballots(self) -> DataFrame:
        price = F.col("o_totalprice").cast("bigint")
        return self.raw("orders").select(
            F.col("o_orderkey").alias("persona_id"),
            F.col("o_orderpriority").alias("domain"),
            F.col("o_orderstatus").alias("archetype"),
            ((price % 1000) / F.lit(1000.0)).alias("ndcg"),
            ((price % 777) / F.lit(777.0)).alias("stars_ndcg"),
            (F.col("o_custkey") % 2).cast("int").alias("pairwise_win"),
            (F.col("o_orderkey") % 11).cast("double").alias("revisit_score"),
            ((F.col("o_custkey") % 97) / F.lit(97.0)).alias("model_revisit_signal"),
            F.col("o_custkey").alias("person_id"),
        )
