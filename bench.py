"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is fully executed into Spark's no-op sink (no collect to the driver).
Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

# Training-set build (windows, sequences, labels), feature ETL and documents,
# vocabularies, ranking, as-of join and rewards, scoring and losses, store
# upsert, batch prediction.
HEADLINE = ["window_features", "WIN-2", "LBL-8", "SEQ-1", "AGG-1", "AGG-2", "VOC-3", "SRT-2",
            "JOI-4", "FBK-1", "SCO-3", "MET-5", "STO-1", "predict_batch"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from seqwise.session import build_session
    from seqwise.plans.registry import all_queries
    extra = {}
    if os.environ.get("BENCH_EVENT_LOG"):  # stage/task times without the UI
        extra = {"spark.eventLog.enabled": "true", "spark.eventLog.dir": os.environ["BENCH_EVENT_LOG"]}
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=int(cpus),
                          app_name="seqwise-bench", extra=extra)
    qs = all_queries()
    names = [n for n in (sys.argv[1:] or HEADLINE) if n in qs]

    def run(name: str) -> float:
        t0 = time.perf_counter()
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    # Warm-up pass: JVM start-up, JIT and Python worker start are not the
    # queries' cost; the timed pass measures steady-state execution.
    for n in names:
        run(n)
    times = {n: round(run(n), 3) for n in names}
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
