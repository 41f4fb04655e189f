"""Feature store merges and the two-tier feature lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqwise.functions.columns import epoch_us
from seqwise.functions.constants import FEATURE_TTL_SECONDS
from seqwise.operators.keyed import KeyedTable

FEATURE_STRUCT = T.StructType([
    T.StructField("total_events", T.LongType()),
    T.StructField("purchase_count", T.LongType()),
    T.StructField("unique_categories", T.LongType()),
    T.StructField("session_count", T.LongType()),
    T.StructField("days_since_active", T.LongType()),
    T.StructField("preferred_channel", T.StringType()),
])
FEATURE_FIELDS = [f.name for f in FEATURE_STRUCT.fields]


def to_store_rows(features: DataFrame, version: int, computed_at: str) -> DataFrame:
    """User feature rows -> store rows (user_id, features struct, version, computed_at)."""
    return features.select(
        F.col("muid").alias("user_id"),
        F.struct(*[F.col(c).cast(FEATURE_STRUCT[c].dataType).alias(c) for c in FEATURE_FIELDS]).alias("features"),
        F.lit(version).alias("feature_version"),
        F.lit(computed_at).cast("timestamp_ntz").alias("computed_at"))


def features_to_json(store: DataFrame) -> DataFrame:
    return store.withColumn("features", F.to_json("features"))


def features_from_json(store: DataFrame) -> DataFrame:
    return store.withColumn("features", F.from_json("features", FEATURE_STRUCT))


def upsert_features(store: DataFrame, incoming: DataFrame) -> DataFrame:
    """Keyed upsert: incoming rows replace features, version and computed_at.
    Inside one incoming batch the newest computed_at wins (a partial max_by
    aggregate, so a key repeated many times costs no skew). Then anti join +
    union: both are shuffles on user_id (or broadcasts when AQE sees a small side)."""
    cols = ["features", "feature_version", "computed_at"]
    latest = (incoming.groupBy("user_id")
              .agg(F.max_by(F.struct(*cols), F.struct("computed_at", "feature_version")).alias("_r"))
              .select("user_id", *[F.col(f"_r.{c}").alias(c) for c in cols]))
    kept = store.join(latest.select("user_id"), "user_id", "left_anti")
    return kept.select("user_id", *cols).unionByName(latest)


STORE_KEY, STORE_ORDER = "user_id", ["computed_at", "feature_version"]


def write_back(cache: KeyedTable, lookups: DataFrame, as_of: str) -> dict[str, int]:
    """Write-through into a stored cache: the store hits of a lookup replace or
    insert the rows of their users, stamped ``as_of``; only their buckets change."""
    return cache.upsert(lookups.where(F.col("write_back")).select(
        "user_id", "features", F.lit(as_of).cast("timestamp_ntz").alias("computed_at")))


def get_features(store: DataFrame, requests: DataFrame, key: str = "user_id") -> DataFrame:
    return store.join(requests.select(key).distinct(), key, "left_semi")


def lookup_features(requests: DataFrame, cache: DataFrame, store: DataFrame, as_of: str,
                    ttl_seconds: int = FEATURE_TTL_SECONDS) -> DataFrame:
    """Two-tier lookup: a cache row younger than the TTL wins, else the store
    row, else null. ``write_back`` marks store hits to be written to the cache."""
    req = requests.select("user_id").distinct()
    c = cache.select("user_id", F.col("features").alias("_cf"), F.col("computed_at").alias("_cat"))
    s = store.select("user_id", F.col("features").alias("_sf"))
    j = req.join(c, "user_id", "left").join(s, "user_id", "left")
    j = j.withColumn("_asof", F.lit(as_of).cast("timestamp_ntz"))
    age_us = epoch_us(j, "_asof") - epoch_us(j, "_cat")
    fresh = F.col("_cf").isNotNull() & (age_us < F.lit(ttl_seconds * 1_000_000))
    src = F.when(fresh, "cache").when(F.col("_sf").isNotNull(), "store")
    return j.select("user_id", src.alias("source"),
                    F.when(fresh, F.col("_cf")).otherwise(F.col("_sf")).alias("features"),
                    (~fresh & F.col("_sf").isNotNull()).alias("write_back"))


def write_back_cache(cache: DataFrame, lookups: DataFrame, as_of: str) -> DataFrame:
    """Write-through: store hits of a lookup replace/insert the cache rows of
    their users, stamped ``computed_at = as_of`` (anti join + union, keyed)."""
    fresh = (lookups.where(F.col("write_back"))
             .select("user_id", "features", F.lit(as_of).cast("timestamp_ntz").alias("computed_at")))
    kept = cache.join(fresh.select("user_id"), "user_id", "left_anti")
    return kept.select("user_id", "features", "computed_at").unionByName(fresh)
