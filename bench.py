"""Time the headline queries: prints one JSON line."""

import json
import os
import sys
import time

from footfall.catalog import load
from footfall.catalog.registry import QUERIES
from footfall.session import local_session

HEADLINE = (
    "edges_by_count", "user_features", "venue_features", "hotel_user_features", "venue_ranking", "method_metrics", "social_venue_signals",
    "radius_pairs", "item_knn", "document_tfidf", "segment_summary", "serve_requests", "run_agreement",
)


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    load()
    spark = local_session(cores, int(cores) if cores.isdigit() else 8, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in HEADLINE:
        start = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_wall_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))


if __name__ == "__main__":
    main()
