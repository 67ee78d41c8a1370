"""Run histories: best epoch, early stop, checkpoints, comparison. History: (run, epoch, dev)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratelake.functions.columns import epoch_name, missing_as_null

FIRST_BEST = -1.0


def with_progress(history: DataFrame, run: str = "run") -> DataFrame:
    """Adds ``best`` (so far, this epoch included), ``improved`` (strictly) and ``no_improve`` (epochs since)."""
    order = Window.partitionBy(run).orderBy("epoch")
    history = history.withColumn("dev", missing_as_null(F.col("dev")))
    before = F.greatest(F.lit(FIRST_BEST), F.coalesce(F.max("dev").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(FIRST_BEST)))
    marked = history.withColumn("improved", F.coalesce(F.col("dev") > before, F.lit(False)))
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    last = F.coalesce(F.max(F.when(F.col("improved"), F.col("epoch"))).over(upto), F.min("epoch").over(upto) - 1)
    best = F.greatest(F.lit(FIRST_BEST), F.coalesce(F.max("dev").over(upto), F.lit(FIRST_BEST)))
    return marked.withColumns({"best": best, "no_improve": F.col("epoch") - last})


def stopped(history: DataFrame, patience: int, run: str = "run") -> DataFrame:
    """The epochs that happen: up to the first with ``patience`` epochs without improvement; all if patience <= 0."""
    progress = with_progress(history, run)
    if patience <= 0:
        return progress
    stop = F.min(F.when(F.col("no_improve") >= patience, F.col("epoch"))).over(Window.partitionBy(run))
    return progress.withColumn("__stop", stop).where(F.col("__stop").isNull() | (F.col("epoch") <= F.col("__stop"))).drop("__stop")


def best_epoch(history: DataFrame, run: str = "run") -> DataFrame:
    """(run, best_epoch, best_dev): the first epoch with the highest value; null if none improved."""
    progress = with_progress(history, run)
    picked = F.max(F.when(F.col("improved"), F.struct("epoch", "dev")))
    return progress.groupBy(run).agg(picked["epoch"].alias("best_epoch"), picked["dev"].alias("best_dev"))


def checkpoints(history: DataFrame, patience: int, every: int, run: str = "run") -> DataFrame:
    """(run, kind, epoch, name): last, best (last if nothing improved) and periodic checkpoints of the run."""
    done = stopped(history, patience, run)
    ends = done.groupBy(run).agg(F.max("epoch").alias("last"), F.max(F.when(F.col("improved"), F.col("epoch"))).alias("best"))
    two = ends.select(run, F.explode(F.array(F.struct(F.lit("last").alias("kind"), F.col("last").alias("epoch")), F.struct(F.lit("best").alias("kind"), F.coalesce("best", "last").alias("epoch")))).alias("c")).select(run, "c.kind", "c.epoch")
    periodic = done.where(F.col("epoch") % every == 0).select(run, F.lit("periodic").alias("kind"), "epoch")
    return two.unionByName(periodic).withColumn("name", epoch_name(F.col("epoch")))


def resume_point(done: DataFrame, run: str = "run") -> DataFrame:
    """(run, next_epoch, best_dev) after the numerically last checkpoint."""
    return done.groupBy(run).agg((F.max("epoch") + 1).alias("next_epoch"), F.max_by("best", "epoch").alias("best_dev"))


def compare(history: DataFrame, run: str = "run") -> DataFrame:
    """(run, epoch, dev) of each run's best epoch, the first if several are equal."""
    best = F.max_by(F.struct("epoch", "dev"), F.struct("dev", -F.col("epoch")))
    return history.where(F.col("dev").isNotNull()).groupBy(run).agg(best.alias("b")).select(run, "b.epoch", "b.dev")
