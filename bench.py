"""Time the headline queries; prints one JSON line.

``prepare`` makes the train and test tables that the models share, as in a real
run; the other queries read them.  Nothing else is kept between queries.
"""

from __future__ import annotations

import json
import os
import sys
import time

from check_oracle import session
from shelfwise.plans import queries

HEADLINE = (
    "prepare",
    "collapsed_interactions",
    "split_assignment",
    "popularity_topk",
    "hit_rate_popularity",
    "user_similarity",
    "cf_scores",
    "cf_topk",
    "cf_topk_alpha_negative",
    "factor_topk",
    "negative_pairs",
    "content_train",
    "content_topk",
    "svd_topk",
    "fm_topk",
    "model_comparison",
)


def run(spark, name: str, folder: str) -> float:
    spark.catalog.clearCache()
    began = time.time()
    if name == "prepare":
        queries.forget()
        queries.shared_parts(spark, folder)
    else:
        queries.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return round(time.time() - began, 3)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    # Start the Python workers and the readers before the clock runs.
    run(spark, "split_assignment", folder)
    run(spark, "factor_topk", folder)
    times = {name: run(spark, name, folder) for name in names}
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline queries", "value": total, "unit": "sec", "queries": times, "sf": folder}))
    spark.stop()


if __name__ == "__main__":
    main()
