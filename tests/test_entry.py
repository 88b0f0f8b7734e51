"""The registered queries stand without the training-data part."""

import subprocess
import sys

BLOCKED = """
import sys
class Block:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("footfall.llm"):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
sys.meta_path.insert(0, Block())
import __spark_entry__ as e
names = set(e.queries())
assert "venue_ranking" in names and "pipeline" not in names and not any(n.startswith("op1") for n in names)
assert set(e.oracle_sql()) <= names
"""


def test_queries_without_the_training_part():
    subprocess.run([sys.executable, "-c", BLOCKED], check=True, timeout=120)


def test_guest_features_are_made_once(spark, monkeypatch):
    """Medians, quantiles and clusters read the users' features; these are not computed again for each."""
    import __spark_entry__ as entry
    from pyspark.sql import functions as F

    from footfall.catalog import models

    seen = spark.sparkContext.accumulator(0)

    def count(x):
        seen.add(1)
        return x

    once = F.udf(count, "long").asNondeterministic()
    real = models.ft.hotel_user_features
    monkeypatch.setattr(models.ft, "hotel_user_features", lambda *a: real(*a).withColumn("total_hotel_reviews", once("total_hotel_reviews")))
    folder = "/root/testdata/sf0.001"
    n = entry.queries()["hotel_guest_clusters"](spark, folder).count()
    assert 0 < seen.value <= n
