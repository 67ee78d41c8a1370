"""Joins with what is there: clips on disk, features in the store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratelake.functions.columns import content_key


def existing(rows: DataFrame, listing: DataFrame, key: str) -> DataFrame:
    return rows.join(listing.select(key).distinct(), key, "left_semi")


def missing(rows: DataFrame, listing: DataFrame, key: str) -> DataFrame:
    return rows.join(listing.select(key).distinct(), key, "left_anti")


def kept_and_missing(rows: DataFrame, listing: DataFrame, key: str, group: str) -> DataFrame:
    """(group, n_kept, n_missing)."""
    marked = rows.join(listing.select(key).distinct().withColumn("__there", F.lit(True)), key, "left")
    return marked.groupBy(group).agg(F.count_if(F.col("__there")).alias("n_kept"), F.count_if(F.col("__there").isNull()).alias("n_missing"))


def still_to_do(wanted: DataFrame, store: DataFrame, *extra: str) -> DataFrame:
    """Wanted (path, extra...) whose features aren't in the store, keyed by content key and model columns."""
    keyed = wanted.dropDuplicates(["path", *extra]).withColumn("cache_key", content_key(F.col("path")))
    return keyed.join(store.select("cache_key", *extra).distinct(), ["cache_key", *extra], "left_anti")


def read_features(wanted: DataFrame, store: DataFrame) -> DataFrame:
    """Features of every wanted path; a path without any fails the query."""
    keyed = wanted.withColumn("cache_key", content_key(F.col("path")))
    joined = keyed.join(store, "cache_key", "left")
    return joined.withColumn("features", F.coalesce("features", F.raise_error(F.concat(F.lit("no features for "), F.col("path"))).cast(store.schema["features"].dataType)))
