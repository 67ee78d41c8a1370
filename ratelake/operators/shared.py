"""Tables computed once into the storage that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_WITHIN = (1 << 33) - 1


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``).

    Where none is set a temporary folder serves a local session, and goes with it; on a cluster that is an error,
    because executors would not see the driver's folder.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            named = tempfile.mkdtemp(prefix="ratelake-checkpoint-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        context.setCheckpointDir(named)
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Computes ``df`` once into the shared folder; later reads come from there and survive lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def with_position(df: DataFrame, *order: str | Column, name: str = "position") -> DataFrame:
    """Adds the 0-based place of each row in the given order; rows that tie come in any order.

    A range sort and the row counts of its partitions give the places, so no task sees all rows. The sorted rows are
    written once: a sort that is planned twice (with other columns, or coalesced otherwise) has other partitions.
    """
    placed = cut(df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    counts = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__in"))  # one row per sort partition
    before = F.coalesce(F.sum("__in").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    joined = placed.withColumn("__part", part).join(F.broadcast(counts.select("__part", before.alias("__before"))), "__part")
    return joined.withColumn(name, F.col("__before") + F.col("__at").bitwiseAND(F.lit(_WITHIN))).drop("__at", "__part", "__before")


def join_same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Joins on equal ``keys``, where null equals null; ``left``'s keys stay."""
    other = right.withColumnsRenamed({k: f"__same_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [left[k].eqNullSafe(other[f"__same_{k}"]) for k in keys])
    return left.join(other, same, how).drop(*[f"__same_{k}" for k in keys])
