"""Pairwise ranking loss and the composite rating loss.

A pair of unequal targets loses by how far its predictions stand in the wrong order. The sum over all pairs is taken
without making any. Each row gets the number of rows with a lower target as its code. The highest bit in which two codes
differ is the one level at which the two rows lie in the two halves of one range of codes, so each row is put into its
range at every level. There, in order of predictions, a row of the lower half loses, against all rows of the upper half
with a lower prediction, their number times its own less their sum: two running sums. A group of n rows costs n log n
rows, however large it is; predictions are cut into ranges of RANGE_ROWS, whose sums are carried on from one to the next,
so a group that holds all rows is spread too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratelake.operators.metrics import placed_values
from ratelake.operators.shared import cut

#: Rows of a group that one window may hold; more are cut into ranges of predictions.
RANGE_ROWS = 1 << 16


def _levels(n: Column) -> Column:
    """The bits of a group's codes."""
    return F.when(n > 1, F.sequence(F.lit(0), F.ceil(F.log2(n.cast("double"))).cast("int") - 1)).otherwise(F.array().cast("array<int>"))


def _lost(rows: DataFrame, keys: list[str], range_rows: int) -> DataFrame:
    """(keys, __lost): the sum over the pairs of ``rows`` (keys, __p, __t), of which none is missing."""
    sides = F.explode(F.array(*[F.struct(F.lit(k).alias("__side"), F.col(c).alias("__value")) for k, c in enumerate(("__p", "__t"))])).alias("__s")
    placed = cut(placed_values(rows.select(*keys, sides).select(*keys, "__s.*"), [*keys, "__side"], "__value"))
    side = lambda k, value, *names: placed.where(F.col("__side") == k).select(*keys, F.col("__value").alias(value), *[F.col(x).alias(y) for x, y in names])
    sizes = placed.where(F.col("__side") == 1).groupBy(*keys).agg(F.sum("__n").alias("__in"))
    coded = rows.join(side(1, "__t", ("__before", "__code")), [*keys, "__t"]).join(side(0, "__p", ("__before", "__place")), [*keys, "__p"]).join(sizes, keys)
    levels = coded.select(*keys, "__p", "__code", F.floor(F.col("__place") / range_rows).alias("__range"), F.explode(_levels(F.col("__in"))).alias("__level"))
    upper = F.expr("(shiftright(__code, __level) & 1) = 1")
    levels = levels.select(*keys, "__p", "__range", "__level", F.expr("shiftright(__code, __level + 1)").alias("__node"), upper.alias("__upper"))
    node, high = [*keys, "__level", "__node"], (F.col("__upper").cast("long"), F.when(F.col("__upper"), F.col("__p")).otherwise(F.lit(0.0)))
    upto = Window.partitionBy(*node, "__range").orderBy("__p").rowsBetween(Window.unboundedPreceding, 0)
    summed = levels.withColumns({"__c": F.sum(high[0]).over(upto), "__s": F.sum(high[1]).over(upto)}).where(~F.col("__upper"))
    if (sizes.agg(F.max("__in")).first()[0] or 0) > range_rows:
        parts = levels.groupBy(*node, "__range").agg(F.sum(high[0]).alias("__c0"), F.sum(high[1]).alias("__s0"))
        below = Window.partitionBy(*node).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
        before = parts.select(*node, "__range", *[F.coalesce(F.sum(c).over(below), F.lit(0)).alias(c) for c in ("__c0", "__s0")])
        summed = summed.join(before, [*node, "__range"]).withColumns({"__c": F.col("__c") + F.col("__c0"), "__s": F.col("__s") + F.col("__s0")})
    # Equal predictions add nothing in either order; a sum a little below zero is rounding.
    return summed.groupBy(*keys).agg(F.greatest(F.sum(F.col("__p") * F.col("__c") - F.col("__s")), F.lit(0.0)).alias("__lost"))


def pair_rank(df: DataFrame, batch: str, key: str, pred: str, target: str, source: str | None = None, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(batch, n_pairs, rank_loss): mean hinge over pairs of unequal targets (and of one source); 0 without pairs.

    A missing prediction loses nothing against any other; one that is not a number makes its batch's loss NaN.
    """
    keys = ["__batch", "__source"] if source else ["__batch"]
    rows = df.where(F.col(target).isNotNull()).select(F.col(batch).alias("__batch"), *([F.col(source).alias("__source")] if source else []), F.col(pred).cast("double").alias("__p"), F.col(target).cast("double").alias("__t"))
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    odd = F.isnan("__p") & F.col("__p").isNotNull()
    by_target = rows.groupBy(*keys, "__t").agg(F.count("*").alias("__n"), F.max(odd).alias("__odd"))
    alike = F.sum(F.col("__n") * F.col("__n"))
    groups = by_target.groupBy(*keys).agg(((F.sum("__n") * F.sum("__n") - alike) / 2).cast("long").alias("__pairs"), F.max("__odd").alias("__odd"))
    lost = _lost(rows.where(F.col("__p").isNotNull() & ~F.isnan("__p")), keys, range_rows)
    whole = groups.join(lost, keys, "left").groupBy("__batch").agg(F.sum("__pairs").alias("n_pairs"), F.sum("__lost").alias("__lost"), F.max(F.col("__odd") & (F.col("__pairs") > 0)).alias("__odd"))
    mean = F.when(F.col("__odd"), F.lit(float("nan"))).otherwise(F.try_divide(F.coalesce("__lost", F.lit(0.0)), F.col("n_pairs")))
    out = df.select(batch).distinct().join(whole, F.col(batch) == F.col("__batch"), "left")
    return out.select(batch, F.coalesce("n_pairs", F.lit(0)).alias("n_pairs"), F.coalesce(mean, F.lit(0.0)).alias("rank_loss"))


def masked_mse(df: DataFrame, batch: str, pred: str, target: str) -> DataFrame:
    """(batch, mse) over rows with a target; 0 if none has one."""
    error = F.when(F.col(target).isNotNull(), F.pow(F.col(pred) - F.col(target), 2))
    return df.groupBy(batch).agg(F.coalesce(F.avg(error), F.lit(0.0)).alias("mse"))


def rating_loss(df: DataFrame, batch: str, key: str, acr: tuple[str, str], ccr: tuple[str, str] | None = None, source: str | None = None, alpha: float = 0.0, weight: float = 0.0) -> DataFrame:
    """(batch, total_loss): squared error + alpha * same-source ranking + weight * comparative ranking.

    A term of weight zero isn't planned at all.
    """
    total = masked_mse(df, batch, *acr).withColumnRenamed("mse", "total_loss")
    terms = []
    if alpha:
        terms.append((pair_rank(df, batch, key, *acr, source=source), alpha))
    if weight and ccr:
        terms.append((pair_rank(df, batch, key, *ccr), weight))
    for i, (term, scale) in enumerate(terms):
        total = total.join(term.select(batch, F.col("rank_loss").alias(f"__t{i}")), batch).withColumn("total_loss", F.col("total_loss") + scale * F.col(f"__t{i}")).drop(f"__t{i}")
    return total
