"""The cache tier as a stream: answers and what its state keeps."""

import datetime as dt
import random

from pyspark.sql import functions as F

from seqwise.sources.sinks import scratch_path
from seqwise.streaming.lookup import lookup_stream

START = dt.datetime(2024, 1, 1)
TTL = 3_600


def _plain(requests, store):
    cache, out = {}, {}
    for t, rid, user in sorted((t, rid, u) for rid, u, t in requests if u is not None and t is not None):
        if user in cache and (t - cache[user]).total_seconds() < TTL:
            out[rid] = ("cache", store[user])
        elif user in store:
            out[rid] = ("store", store[user])
            cache[user] = t
        else:
            out[rid] = (None, None)
    return out


def test_stream_equals_the_plain_cache(spark):
    r = random.Random(8)
    users = [f"u-{i}" for i in range(6)]
    store = {u: f'{{"n":{i}}}' for i, u in enumerate(users[:5])}  # the last has no row
    requests, rid = [], 0
    for day in range(4):
        t = START + dt.timedelta(days=day)
        for _ in range(60):
            t += dt.timedelta(seconds=r.choice([0, 1, 599, 1_800]))
            requests.append((f"r{rid:04d}", r.choice(users), t))
            rid += 1
    # ages of an entry around its end, to the microsecond
    for k, gap in enumerate([0, 3_599.999999, 0.000001, 3_600, 3_600.000001, 7_200]):
        t = (START + dt.timedelta(days=5)) if k == 0 else t + dt.timedelta(seconds=gap)
        requests.append((f"z{k}", "u-0", t))
    requests += [("n0", None, START), ("n1", "u-1", None)]
    schema = "request_id string, user_id string, requested_at timestamp_ntz"
    folder = scratch_path(spark, "requests")
    for i in range(0, len(requests), 60):  # a file a micro-batch, in time order
        spark.createDataFrame(requests[i:i + 60], schema).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    table = spark.createDataFrame(list(store.items()), "user_id string, features string")
    out, ckpt = scratch_path(spark, "lookups"), scratch_path(spark, "ckpt")
    q = (lookup_stream(stream, table).writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()
    got = spark.read.parquet(out).collect()
    want = _plain(requests, store)
    assert {g.request_id: (g.source, g.features) for g in got} == want and len(got) == len(want)
    assert all(g.write_back == (g.source == "store") for g in got)
    assert [want[f"z{k}"][0] for k in range(6)] == ["store", "cache", "store", "store", "store", "store"]
    # entries whose time is over left the state: only the user of the last day is there
    left = (spark.read.format("statestore").option("path", ckpt).option("stateVarName", "entry").load()
            .select(F.col("key.*")).collect())
    assert len(left) <= 1


def test_a_bucket_of_users_is_answered_as_each_alone():
    import pandas as pd
    from types import SimpleNamespace
    from seqwise.streaming.lookup import CacheEntries

    class Value:
        held = None

        def get(self):
            return self.held

        def update(self, value):
            self.held = value

        def clear(self):
            self.held = None
    timers, state = set(), Value()
    p = CacheEntries(1_000, "string", "bigint")
    p.init(SimpleNamespace(getValueState=lambda *_: state, registerTimer=timers.add, deleteTimer=timers.remove))

    def ask(*rows):
        df = pd.DataFrame(rows, columns=["request_id", "user_key", "t_us", "stored"])
        [got] = p.handleInputRows((0,), iter([df]), None)
        return {r.request_id: (r.source, r.features) for r in got.itertuples()}
    assert ask((1, "a", 0, "A"), (2, "b", 500, "B"), (3, "a", 999, "A"), (4, "c", 0, None)) == {
        1: ("store", "A"), 2: ("store", "B"), 3: ("cache", "A"), 4: (None, None)}
    assert timers == {2}  # of the oldest entry
    assert ask((5, "b", 1_499, "B2"), (6, "a", 1_000, "A2")) == {5: ("cache", "B"), 6: ("store", "A2")}
    list(p.handleExpiredTimer((0,), SimpleNamespace(getCurrentWatermarkInMs=lambda: 2), None))
    assert ask((7, "a", 1_500, "A3"), (8, "b", 1_500, None)) == {7: ("cache", "A2"), 8: (None, None)}
    list(p.handleExpiredTimer((0,), SimpleNamespace(getCurrentWatermarkInMs=lambda: 9), None))
    assert not timers and state.held is None
