"""Agreement of predictions and targets: Spearman, Pearson, squared error, and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratelake.functions.columns import missing_as_null
from ratelake.operators.shared import join_same


def valid_pairs(df: DataFrame, pred: str, target: str) -> DataFrame:
    """Rows whose prediction and target are both there."""
    return df.withColumns({pred: missing_as_null(F.col(pred).cast("double")), target: missing_as_null(F.col(target).cast("double"))}).where(F.col(pred).isNotNull() & F.col(target).isNotNull())


def pearson(x: str, y: str) -> Column:
    """Linear correlation; NaN for fewer than two pairs or a constant side."""
    spread = F.sqrt(F.var_pop(x) * F.var_pop(y))
    return F.when((F.count("*") < 2) | (spread == 0), F.lit(float("nan"))).otherwise(F.try_divide(F.covar_pop(x, y), spread))


#: Distinct values of a group that one window may hold; more are cut into this many ranges by splitters.
RANGE_VALUES, RANGES = 1 << 20, 1024
#: Errors of the splitters' places, as a share of a range: a tenth either way.
_ACCURACY = 10 * RANGES


def _range(splitters: str, value: str) -> Column:
    """How many of the ascending splitters lie below the value, by binary search; 0 without splitters."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range((RANGES - 1).bit_length()))])
    at = F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(F.get(F.col(splitters), at + step - 1) < F.col(value), step).otherwise(0))
    return F.when(F.col(splitters).isNull(), F.lit(0)).otherwise(at)


def splitters(counts: DataFrame, group: list[str], value: str, most: int = RANGE_VALUES) -> DataFrame:
    """(group, __splitters): RANGES - 1 ascending values that cut a group's distinct values into ranges of equal number.

    Quantile sketches of the parts are merged. Only groups with more than ``most`` distinct values have splitters. As
    each distinct value is one row, ties never cross a border, and an outlier takes up one place, not many ranges.
    """
    wide = counts.groupBy(*group).agg(F.count("*").alias("__values")).where(F.col("__values") > most)
    # One literal instead of a thousand, which every rule of the optimizer would visit.
    shares = F.split(F.lit(" ".join(str(k / RANGES) for k in range(1, RANGES))), " ").cast("array<double>")
    return join_same(counts, wide, group, "left_semi").groupBy(*group).agg(F.percentile_approx(value, shares, F.lit(_ACCURACY)).alias("__splitters"))


def placed_values(df: DataFrame, group: list[str], value: str, most: int = RANGE_VALUES) -> DataFrame:
    """(group, value, __n, __before): each distinct value of a group, how many rows have it, and how many a lower one.

    Ties are counted first. A wide group's values are ranked by ranges, each in a task of its own, and shifted by the
    counts of the ranges below, so that a group that holds all rows is spread too.
    """
    counts = df.groupBy(*group, value).agg(F.count("*").alias("__n"))
    placed = join_same(counts, splitters(counts, group, value, most), group, "left").withColumn("__range", _range("__splitters", value)).drop("__splitters")
    by_range = placed.groupBy(*group, "__range").agg(F.sum("__n").alias("__in"))
    up = Window.partitionBy(*group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # RANGES rows at most
    below = by_range.select(*group, "__range", F.coalesce(F.sum("__in").over(up), F.lit(0)).alias("__below"))
    within = F.sum("__n").over(Window.partitionBy(*group, "__range").orderBy(value))
    joined = join_same(placed.withColumn("__upto", within), below, [*group, "__range"])
    return joined.select(*group, value, "__n", (F.col("__below") + F.col("__upto") - F.col("__n")).alias("__before"))


def average_ranks(df: DataFrame, group: list[str], value: str, name: str, most: int = RANGE_VALUES) -> DataFrame:
    """(group, value, rank): one row per distinct value; ties share the mean of their ranks."""
    rank = F.col("__before") + (F.col("__n") + 1) / 2.0
    return placed_values(df, group, value, most).select(*group, value, rank.alias(name))


def compute(df: DataFrame, group: list[str], pred: str, target: str) -> DataFrame:
    """(group, n, srcc, lcc, mse) over valid pairs; NaN where fewer than two. Both sides are ranked in one pass."""
    pairs = valid_pairs(df, pred, target).select(*group, F.col(pred).alias("__p"), F.col(target).alias("__t"))
    sides = F.explode(F.array(*[F.struct(F.lit(k).alias("__side"), F.col(c).alias("__value")) for k, c in enumerate(("__p", "__t"))])).alias("__s")
    ranks = average_ranks(pairs.select(*group, sides).select(*group, "__s.*"), [*group, "__side"], "__value", "__rank")
    ranked = pairs
    for k, (value, name) in enumerate((("__p", "__rp"), ("__t", "__rt"))):
        own = ranks.where(F.col("__side") == k).select(*group, F.col("__value").alias(value), F.col("__rank").alias(name))
        ranked = join_same(ranked, own, [*group, value])
    mse = F.when(F.count("*") < 2, F.lit(float("nan"))).otherwise(F.avg(F.pow(F.col("__p") - F.col("__t"), 2)))
    return ranked.groupBy(*group).agg(F.count("*").alias("n"), pearson("__rp", "__rt").alias("srcc"), pearson("__p", "__t").alias("lcc"), mse.alias("mse"))


def profile(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """(group, n, n_missing, std, least, most) to spot degenerate predictions."""
    v = missing_as_null(F.col(value))
    return df.groupBy(*group).agg(F.count("*").alias("n"), F.count_if(v.isNull()).alias("n_missing"), F.stddev_pop(v).alias("std"), F.min(v).alias("least"), F.max(v).alias("most"))


def mean_of_batch_means(df: DataFrame, batch: str, value: str) -> DataFrame:
    """One row: the unweighted mean over batches of their means."""
    return df.groupBy(batch).agg(F.avg(value).alias("__m")).agg(F.avg("__m").alias("epoch_loss"), F.count("*").alias("n_batches"))
