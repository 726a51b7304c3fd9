"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from townloom.plans import catalog  # noqa: E402
from townloom.session import build_session  # noqa: E402

HEADLINE = ["district_report", "c2_leaf_bucket_with_alternates", "j1_places_in_buildings",
            "j3_nearest_building", "j12_box_overlap", "a1_zone_shares", "a5_demographics_weighted",
            "a6_jobs_summary", "a13_parcel_summary", "a14_level_of_service", "a21_zonal_stats",
            "a31_kernel_density", "w3_percentile_of_new_values", "w8_top_categories", "w11_greedy_dedup",
            "t5_pre_post", "r1_components", "r7_adjacency_radius", "m5_cosine_neighbours",
            "m10_program_neighbours", "m17_hit_rates", "s3_gtfs_tables"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    catalog.load_all()
    spark = build_session("townloom-bench", int(os.environ.get("BENCH_CPUS", "8")))
    spark.sparkContext.setLogLevel("ERROR")
    catalog.QUERIES["c1_poi_bucket"](spark, sf_dir).count()  # start the engine before timing
    times = {}
    for name in HEADLINE:
        start = time.time()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "headline_total_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
