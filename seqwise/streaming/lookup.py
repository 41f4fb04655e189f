"""The two-tier feature lookup as a stream (the batch form: ``operators.store.lookup_features``).

A request is answered from the user's cache entry while the entry is younger
than the time to live, else from the store, which renews the entry as of the
request. The cache is keyed state: one entry a user, the time it was filled and
the features as text, kept by buckets of users (see ``streaming.stateful``). An
event-time timer, that of a bucket's oldest entry, removes entries whose time is
over, so the state holds the users of the last ``ttl_seconds`` and the
watermark's delay, not all users ever seen.

The store is a static table that every micro-batch reads anew and joins by user;
an entry keeps what the store said when it was filled. Requests are answered in
the order (time, id). Without a user or a time, or later than the watermark, a
request gets no answer; without a row in the store its source is null and
nothing is cached."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from seqwise.functions.columns import epoch_us
from seqwise.functions.constants import FEATURE_TTL_SECONDS
from seqwise.streaming.stateful import (BUCKETS, STATE, as_ids, id_type, move_timer, read_rows, use_rocksdb_state,
                                        user_bucket, write_rows)

OUTPUT = "request_id {request}, user_id {user}, source string, features string, write_back boolean"


class CacheEntries(StatefulProcessor):
    """The cache entries of a bucket of users."""

    def __init__(self, ttl_us: int, user: str, request: str):
        self.ttl, self.user, self.request = ttl_us, user, request

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getValueState("entry", STATE)

    def _timer(self, entries: pd.DataFrame | None) -> int | None:
        return None if entries is None or not len(entries) else (int(entries["filled"].min()) + self.ttl) // 1000 + 1

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        asked = pd.concat(list(rows), ignore_index=True).sort_values(["t_us", "request_id"], kind="stable")
        old = read_rows(self.entries)
        cache = {} if old is None else dict(zip(old["user"].tolist(), zip(old["filled"].tolist(), old["features"])))
        users, there = asked["user_key"].tolist(), asked["stored"].notna()
        store = dict(asked.loc[there].drop_duplicates("user_key")[["user_key", "stored"]].itertuples(index=False))
        source, answer, changed = [], [], False
        for user, t in zip(users, asked["t_us"].tolist()):
            held = cache.get(user)
            if held is not None and t - held[0] < self.ttl:
                source.append("cache")
                answer.append(held[1])
                continue
            stored = store.get(user)
            source.append(None if stored is None else "store")
            answer.append(stored)
            if stored is not None:
                cache[user], changed = (t, stored), True
        if changed:
            new = pd.DataFrame({"user": list(cache), "filled": [f for f, _ in cache.values()],
                                "features": [x for _, x in cache.values()]})
            write_rows(self.entries, new)
            move_timer(self.handle, self._timer(old), self._timer(new))
        source = np.array(source, dtype=object)
        yield pd.DataFrame({"request_id": as_ids(asked["request_id"], self.request),
                            "user_id": as_ids(asked["user_key"], self.user), "source": source,
                            "features": answer, "write_back": source == "store"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        old = read_rows(self.entries)
        if old is not None:
            new = old[(old["filled"] + self.ttl) // 1000 + 1 > timerValues.getCurrentWatermarkInMs()]
            if len(new) < len(old):
                write_rows(self.entries, new)
                move_timer(self.handle, self._timer(old), self._timer(new))
        yield from ()

    def close(self) -> None:
        pass


def lookup_stream(requests: DataFrame, store: DataFrame, delay: str = "1 hour",
                  ttl_seconds: int = FEATURE_TTL_SECONDS, buckets: int = BUCKETS) -> DataFrame:
    """Streaming ``requests`` (request_id, user_id, requested_at) -> their
    source ('cache', 'store' or null), features as JSON, and whether the cache
    was filled. ``store``: one row a user (user_id, features as JSON)."""
    kinds = {"request": id_type(requests, "request_id"), "user": id_type(requests, "user_id")}
    use_rocksdb_state(requests.sparkSession)
    asked = requests.select("request_id", F.col("user_id").alias("user_key"), epoch_us(requests, "requested_at").alias("t_us"))
    asked = (asked.where(F.col("user_key").isNotNull() & F.col("t_us").isNotNull())
             .withColumn("ts", F.timestamp_micros("t_us")).withWatermark("ts", delay))
    tier = store.select(F.col("user_id").alias("store_key"), F.col("features").alias("stored"))
    joined = asked.join(tier, F.col("user_key") == F.col("store_key"), "left").drop("store_key")
    joined = joined.withColumn("bucket", user_bucket("user_key", buckets))
    return joined.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=CacheEntries(ttl_seconds * 1_000_000, kinds["user"], kinds["request"]),
        outputStructType=OUTPUT.format(**kinds), outputMode="Append", timeMode="EventTime")
