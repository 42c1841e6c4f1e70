"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from spindle.plans.queries import QUERIES
from spindle.session import local_session

HEADLINE = ("pagerank", "pagerank_isolated", "degrees", "adjacency", "graph_info", "symmetrise", "partition_edges", "scalar_arith_long", "pagerank_first10", "adjacency_blocks", "placed_links", "tree_reduce", "all_gather", "all_gather_dealt", "triplets_combine", "tagged_arith", "first_chunk")


def main() -> None:
    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(app="bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    took = {}
    for name in HEADLINE:
        began = time.time()
        QUERIES[name](spark, d).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(d.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
