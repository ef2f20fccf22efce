"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from lexmesh.plans.catalog import QUERIES
from lexmesh.session import session

HEADLINE = (
    "token_frequency", "clean_lines", "dedup_longest", "dict_anchors", "cooc_anchors", "merged_anchors", "lookup_find", "lookup_analogy", "reverse_query",
    "lens1_displacement", "lens2_no_counterpart", "lens3_isolation", "lens4_divergence", "lens5_doppelgangers", "lens6_bridges", "anchor_audit_buckets",
    "coverage_causes", "passages_context", "parse_atf_blocks", "ridge_align_accuracy",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session("bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    took = {}
    for name in HEADLINE:
        began = time.time()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
        print(name, took[name], file=sys.stderr)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))


if __name__ == "__main__":
    main()
