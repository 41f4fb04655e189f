"""Time the windows on a skewed variant of the events: one user holding a
third of all rows (every third event reassigned), plain plan vs split plan.

Usage: python -m tools.skew_bench [sf_dir] [rows_per_split]
"""

from __future__ import annotations

import os
import sys
import time


def main(argv):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from pyspark.sql import functions as F
    from seqwise.operators.windows import sliding_windows
    from seqwise.session import build_session
    from seqwise.sources import TRAIN_COLUMNS, load_events
    sf_dir = argv[0] if argv else "/root/testdata/sf0.1"
    rps = int(argv[1]) if len(argv) > 1 else 5000
    spark = build_session()
    e = load_events(spark, sf_dir, TRAIN_COLUMNS + ["event_id"])
    e = e.withColumn("muid", F.when(F.col("event_id") % 3 == 0, F.lit(0)).otherwise(F.col("muid")))
    for rep in range(2):
        for label, kw in [("plain", {"hot": None}), (f"split<={rps}", {"rows_per_split": rps})]:
            t0 = time.perf_counter()
            sliding_windows(e, **kw).write.format("noop").mode("overwrite").save()
            if rep:
                print(f"{label:14s} {time.perf_counter() - t0:.2f} s", flush=True)


if __name__ == "__main__":
    main(sys.argv[1:])
