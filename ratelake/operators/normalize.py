"""Per-source normalisation fitted on training rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratelake.operators.shared import cut

#: A deviation this small against the mean is rounding, not spread.
TOLERANCE = 1e-12


def fit(train: DataFrame, group: str, value: str) -> DataFrame:
    """(group, mean, std): population statistics; std is 1 where the values are constant."""
    mean, std = F.avg(value), F.stddev_pop(value)
    stats = train.where(F.col(value).isNotNull()).groupBy(group).agg(mean.alias("mean"), std.alias("std"))
    constant = F.col("std") <= F.greatest(F.lit(TOLERANCE) * F.abs("mean"), F.lit(0.0))
    return stats.withColumn("std", F.when(constant, F.lit(1.0)).otherwise(F.col("std")))


def apply(df: DataFrame, stats: DataFrame, group: str, value: str) -> DataFrame:
    """Normalises ``value``; groups without statistics keep theirs."""
    stats = stats.select(F.col(group).alias("__group"), "mean", "std")
    joined = df.join(stats, df[group] == stats["__group"], "left")
    scaled = F.when(F.col("mean").isNull(), F.col(value)).otherwise((F.col(value) - F.col("mean")) / F.col("std"))
    return joined.withColumn(value, scaled).drop("__group", "mean", "std")


def normalized(df: DataFrame, group: str, value: str, fit_where: str = "split = 'train'") -> DataFrame:
    """``df`` with ``value`` normalised by the statistics of its rows that fulfil ``fit_where``.

    What the rows stand on (caps, splits, parsing) is computed once, for the statistics and for the rows.
    """
    rows = cut(df)
    return apply(rows, fit(rows.where(fit_where), group, value), group, value)
