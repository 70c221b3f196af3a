"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is planned from scratch and fully executed (noop sink, no
collect); one warm-up, then the median of $BENCH_REPEAT runs.  Prints one
JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from riskgraph.plans import catalog  # noqa: E402
from riskgraph.session import build_session  # noqa: E402

HEADLINE = ["scored_nodes", "exposure_full", "review_queue", "rag_scores", "graph_components", "rank_nodes"]


def run_once(spark, key: str, sf: str) -> float:
    catalog._memo.clear()
    t0 = time.perf_counter()
    df = catalog.queries()[key](spark, sf)
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    keys = [k for k in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if k]
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=max(cpus, 8), app="riskgraph-bench",
                          extra={"spark.driver.memory": "16g", "spark.checkpoint.dir": tempfile.mkdtemp(prefix="riskgraph-bench-")})
    times = {}
    for key in keys:
        run_once(spark, key, sf)  # warm-up
        times[key] = round(statistics.median(run_once(spark, key, sf) for _ in range(repeat)), 3)
        print(f"# {key}: {times[key]}s", file=sys.stderr)
    sf_name = os.path.basename(sf).replace("sf", "")
    out = {
        "metric": "headline_total_median_sec",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(sf_name) if sf_name.replace(".", "", 1).isdigit() else sf_name,
        "cpus": cpus,
        "repeat": repeat,
        "settings": {
            "spark.sql.shuffle.partitions": spark.conf.get("spark.sql.shuffle.partitions"),
            "spark.sql.adaptive.enabled": spark.conf.get("spark.sql.adaptive.enabled"),
            "spark.driver.memory": spark.sparkContext.getConf().get("spark.driver.memory", ""),
        },
    }
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
