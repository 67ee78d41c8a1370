"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ratelake.operators.shared import cut, ensure_checkpoint_dir

__all__ = ["WORD", "cut", "delete", "ensure_checkpoint_dir", "hash_sample", "n_words", "shared_path", "small_enough", "table"]

#: Words are maximal runs of characters other than these (space, and tab to carriage return).
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    uuid = spark.sparkContext._jvm.java.util.UUID.randomUUID().toString()
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid}"


def delete(spark: SparkSession, path: str) -> None:
    """Removes a folder that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def n_words(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def small_enough(df: DataFrame, max_rows: int) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows, by counting no more than one beyond."""
    return df.limit(max_rows + 1).count() <= max_rows


def hash_sample(df: DataFrame, key: str, most: int, seed: int = 0) -> DataFrame:
    """The ``most`` rows with the least hash of ``key`` (all, if there are fewer); the same at every run.

    Rows far above the expected cut are filtered out first, so that few more than ``most`` reach the final sort.
    """
    n, bits = df.count(), 1 << 31
    place = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(bits))
    wanted = most + 6 * most**0.5 + 64
    near = df.where(place < int(bits * min(1.0, wanted / n))) if n > most else df
    return near.orderBy(place, key).limit(most)
