"""Keyed stateful stream processors (transformWithStateInPandas, RocksDB state).

The key of the state is a bucket of users (a hash of the user, ``BUCKETS`` of
them), so a micro-batch costs one Python call a bucket and not one a user, and
the users of a bucket are handled together, by arrays. A bucket keeps its rows
as one value, an Arrow table. State per user is bounded: the buffer keeps at
most ``size`` events; feedback keeps only predictions still waiting for the
user's next event."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from seqwise.functions.columns import epoch_us

ROCKSDB_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb_state(spark) -> None:
    """transformWithState needs the RocksDB state store (column families);
    the provider is fixed in a query's checkpoint when it first starts."""
    key = "spark.sql.streaming.stateStore.providerClass"
    if spark.conf.get(key, None) != ROCKSDB_PROVIDER:
        spark.conf.set(key, ROCKSDB_PROVIDER)

BUCKETS = 1024  # fixed for the life of a checkpoint; a task holds one bucket's rows of a micro-batch
STATE = "rows binary"


def user_bucket(user: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(user)), F.lit(buckets)).cast("int")


def read_rows(state) -> pd.DataFrame | None:
    """The rows that a value state of type ``STATE`` holds; None without any."""
    held = state.get()
    return None if held is None else pa.ipc.open_stream(pa.py_buffer(bytes(held[0]))).read_pandas()


def write_rows(state, rows: pd.DataFrame) -> None:
    if not len(rows):
        state.clear()
        return
    table, sink = pa.Table.from_pandas(rows, preserve_index=False), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    state.update((sink.getvalue().to_pybytes(),))


def move_timer(handle: StatefulProcessorHandle, before: int | None, after: int | None) -> None:
    """A bucket has one timer, at the earliest end of its rows (None: no rows)."""
    if before != after:
        if before is not None:
            handle.deleteTimer(before)
        if after is not None:
            handle.registerTimer(after)


BUFFER_OUTPUT = ("prediction_id {event_id}, user_id {muid}, model_version string, window_events int, "
                 "purchase_probability double, churn_risk double, predicted_next_event string, "
                 "engagement_score double, inactivity_risk double, window_event_ids string")


def id_type(df: DataFrame, column: str) -> str:
    """Ids are whole numbers or text (UUIDs); the state keeps them as they are."""
    kind = df.schema[column].dataType.simpleString()
    if kind not in ("bigint", "int", "string"):
        raise TypeError(f"{column} is {kind}; ids are int, long or string")
    return kind


def as_ids(values, kind: str) -> np.ndarray:
    return values.to_numpy(dtype=object) if kind == "string" else values.astype("int64").to_numpy()


def one_version(user) -> str:
    return "v1"


class LastEventsBuffer(StatefulProcessor):
    """Keeps the newest ``size`` events of every user of a bucket; on every
    arriving event emits the rule-based prediction over the user's newest
    ``size`` events up to it. Rows of a micro-batch are applied in event-time
    order."""

    SLICE = 10_000  # predictions emitted at once

    def __init__(self, size: int, event: str, version: Callable[[object], str]):
        from seqwise.functions.constants import EVENT_NAMES
        self.size, self.event, self.version = size, event, version
        self.ids = {name: i for i, name in enumerate(EVENT_NAMES)}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.buf = handle.getValueState("buf", STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True)[["muid", "t_us", "event_id", "event_name"]]
        new["event_id"] = as_ids(new["event_id"], self.event)
        old = read_rows(self.buf)
        seq = new if old is None else pd.concat([old, new], ignore_index=True)
        seq = seq.assign(is_new=np.arange(len(seq)) >= len(seq) - len(new))
        seq = seq.sort_values(["muid", "t_us", "event_id"], kind="stable").reset_index(drop=True)
        code, users = pd.factorize(seq["muid"])  # ascending: the rows are in order of the user
        users = users.tolist()
        first = np.searchsorted(code, np.arange(len(users) + 1))
        i, begin = np.arange(len(seq)), first[code]
        # the newest rows of every user are the next micro-batch's state
        keep = first[code + 1] - i <= self.size
        write_rows(self.buf, seq.loc[keep, ["muid", "t_us", "event_id", "event_name"]])

        # Rolling window of the user's newest `size` events up to each row.
        n = np.minimum(i - begin + 1, self.size)
        last_cart = np.maximum.accumulate(np.where(seq["event_name"] == "add_to_cart", i, -1))
        cart = last_cart > i - n
        lp = (seq["event_name"] == "purchase").to_numpy()
        purchase = np.where(lp, 2.0, np.minimum(95.0, n * 5.0 + np.where(cart, 40.0, 0.0)))
        churn = np.where(lp, 60.0, np.maximum(5.0, 80.0 - n * 10.0))
        nxt = np.where(lp, "pageview", np.where(cart, "purchase", np.where(n > 2, "add_to_cart", "viewcontent")))
        version = np.array([self.version(u) for u in users], dtype=object)
        # the padded window itself: static event ids of the newest `size`
        # events up to each new row, left-padded with 0
        ids = seq["event_name"].map(self.ids).fillna(0).astype(int).to_numpy()
        words = np.array([str(x) for x in range(max(self.ids.values()) + 1)], dtype=object)
        fresh = np.flatnonzero(seq["is_new"])
        for m in (fresh[k:k + self.SLICE] for k in range(0, len(fresh), self.SLICE)):
            at = m[:, None] - np.arange(self.size - 1, -1, -1)
            window = words[np.where(at >= begin[m][:, None], ids[np.maximum(at, 0)], 0)]
            yield pd.DataFrame({
                "prediction_id": seq["event_id"].to_numpy()[m],
                "user_id": seq["muid"].to_numpy()[m],
                "model_version": version[code[m]],
                "window_events": n[m].astype("int32"),
                "purchase_probability": purchase[m], "churn_risk": churn[m],
                "predicted_next_event": nxt[m],
                "engagement_score": n[m] * 0.15, "inactivity_risk": (10 - n[m]).astype(float),
                "window_event_ids": [",".join(w) for w in window.tolist()],
            })

    def close(self) -> None:
        pass


def buffer_predictions(events: DataFrame, size: int = 20, version: Callable[[object], str] = one_version,
                       buckets: int = BUCKETS) -> DataFrame:
    """Streaming events -> one prediction per event; ``version`` names the model
    version that serves a user. Events without a user or a time bring none (as
    in ``operators.scoring.prediction_log``)."""
    kinds = {c: id_type(events, c) for c in ("muid", "event_id")}
    use_rocksdb_state(events.sparkSession)
    # (input column names must not start with "_": such names reach pandas renamed)
    ev = (events.select("muid", "event_id", "event_name", epoch_us(events, "event_time").alias("t_us"))
          .where(F.col("muid").isNotNull() & F.col("t_us").isNotNull())
          .withColumn("bucket", user_bucket("muid", buckets)))
    return ev.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=LastEventsBuffer(size, kinds["event_id"], version),
        outputStructType=BUFFER_OUTPUT.format(**kinds),
        outputMode="Append", timeMode="None")


FEEDBACK_OUTPUT = "prediction_id {id}, predicted_next_event string, actual string, reward double"
WEEK_US = 168 * 3_600_000_000


def reward_of(predicted: np.ndarray, actual: np.ndarray) -> np.ndarray:
    return np.where(predicted == actual, 1.0, np.where(actual == "churn", -2.0, np.where(
        np.isin(actual, ["purchase", "checkout"]), 0.5, -0.1)))


class FeedbackProcessor(StatefulProcessor):
    """Predictions wait for the user's next event. The first event strictly
    after a prediction resolves it (its name, or 'churn' when it came more than
    168 h later); an event-time timer at prediction + 168 h resolves a silent
    user as 'churn' (a bucket's timer is that of its oldest prediction).
    Predictions never resolved stay pending (unresolved)."""

    COLUMNS = ["person", "t_us", "rid", "rname"]

    def __init__(self, kind: str):
        self.kind = kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getValueState("pending", STATE)

    def _timer(self, preds: pd.DataFrame | None) -> int | None:
        return None if preds is None or not len(preds) else (int(preds["t_us"].min()) + WEEK_US) // 1000 + 1

    def _keep(self, before: pd.DataFrame | None, preds: pd.DataFrame) -> None:
        write_rows(self.pending, preds[self.COLUMNS])
        move_timer(self.handle, self._timer(before), self._timer(preds))

    def _emit(self, preds: pd.DataFrame, actual: np.ndarray) -> pd.DataFrame:
        predicted = preds["rname"].to_numpy(dtype=object)
        return pd.DataFrame({"prediction_id": as_ids(preds["rid"], self.kind), "predicted_next_event": predicted,
                             "actual": actual, "reward": reward_of(predicted, actual)})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows), ignore_index=True)
        old = read_rows(self.pending)
        events = pdf.loc[pdf["tag"] == 0, self.COLUMNS]
        preds = pdf.loc[pdf["tag"] == 1, self.COLUMNS]
        preds = preds.assign(rid=as_ids(preds["rid"], self.kind))
        preds = preds if old is None else pd.concat([old, preds], ignore_index=True)
        # rows without a user are those of one user
        code = pd.factorize(pd.concat([events["person"], preds["person"]]), use_na_sentinel=False)[0].astype("int64")
        rank = np.unique(np.concatenate([events["t_us"], preds["t_us"]]).astype("int64"), return_inverse=True)[1]
        place = code * (len(rank) + 1) + rank  # the order of user and time
        events = events.assign(place=place[:len(events)], code=code[:len(events)]).sort_values(["place", "rid"], kind="stable")
        # the user's first event strictly after each prediction
        at = np.searchsorted(events["place"].to_numpy(), place[len(events):], side="right")
        found = np.append(events["code"].to_numpy(), -1)[at] == code[len(events):]
        self._keep(old, preds[~found])
        done, at = preds[found], at[found]
        soon = events["t_us"].to_numpy()[at] - done["t_us"].to_numpy() <= WEEK_US
        yield self._emit(done, np.where(soon, events["rname"].to_numpy(dtype=object)[at], "churn"))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        old = read_rows(self.pending)
        if old is None:
            return
        over = old["t_us"] + WEEK_US < timerValues.getCurrentWatermarkInMs() * 1000
        if over.any():
            self._keep(old, old[~over])
            yield self._emit(old[over], np.full(int(over.sum()), "churn", dtype=object))

    def close(self) -> None:
        pass


def feedback_input(users: str = "long", ids: str = "long") -> str:
    """Schema of a feed with ids of these types."""
    return f"kind string, muid {users}, t long, id {ids}, name string"


def feedback_stream(feed: DataFrame, delay: str = "1 hour", buckets: int = BUCKETS) -> DataFrame:
    """``feed``: rows (kind 'event'|'prediction', muid, t epoch us, id, name);
    rows without a time bring nothing."""
    use_rocksdb_state(feed.sparkSession)
    kind = id_type(feed, "id")
    tag = F.when(F.col("kind") == "event", 0).otherwise(1)
    # users as text and no null among an event's numbers: pandas would make them floats
    rid = F.col("id") if kind == "string" else F.when(
        tag == 0, F.coalesce("id", F.lit(2**63 - 1 if kind == "bigint" else 2**31 - 1).cast(kind))).otherwise(F.col("id"))
    x = feed.where(F.col("t").isNotNull()).select(
        user_bucket("muid", buckets).alias("bucket"), F.col("muid").cast("string").alias("person"),
        F.col("t").alias("t_us"), tag.alias("tag"), rid.alias("rid"), F.col("name").alias("rname"),
        F.timestamp_micros("t").alias("ts"))
    return (x.withWatermark("ts", delay).groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=FeedbackProcessor(kind), outputStructType=FEEDBACK_OUTPUT.format(id=kind),
        outputMode="Append", timeMode="EventTime"))
