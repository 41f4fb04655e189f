"""Hand-made event frames for edge cases."""

import datetime as dt

from pyspark.sql import types as T

EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("muid", T.LongType()),
    T.StructField("session_id", T.StringType()),
    T.StructField("event_name", T.StringType()),
    T.StructField("event_time", T.TimestampNTZType()),
    T.StructField("device_os", T.StringType()),
    T.StructField("channel", T.StringType()),
    T.StructField("traffic_source", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("product_id", T.StringType()),
    T.StructField("page_url", T.StringType()),
])

T0 = dt.datetime(2024, 1, 1, 0, 0, 0)


def ev(event_id, muid, t, name="pageview", session="s1", device="ios", channel="app",
       source="direct", category="books"):
    return (event_id, muid, session, name, t, device, channel, source, category, None, None)


def frame(spark, rows):
    return spark.createDataFrame(rows, EVENT_SCHEMA)
