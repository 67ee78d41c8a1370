"""Scores of clips and clip pairs, clamped or rescaled, and stacked into prediction rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratelake.functions.columns import clamp, rescale
from ratelake.operators.shared import join_same


def lookup(rows: DataFrame, scores: DataFrame, key: str, score_key: str, score: str, out: str) -> DataFrame:
    """Adds the score of ``key``; a row without one fails the query, as a missing clip would."""
    side = scores.select(F.col(score_key).alias("__key"), F.col(score).alias("__score"))
    joined = rows.join(side, rows[key] == side["__key"], "left")
    return joined.withColumn(out, F.coalesce("__score", F.raise_error(F.concat(F.lit("no score for "), F.col(key).cast("string"))).cast("double"))).drop("__key", "__score")


def pair_difference(pairs: DataFrame, scores: DataFrame, a: str, b: str, score_key: str, score: str) -> DataFrame:
    """Adds ``diff``: score(a) - score(b)."""
    both = lookup(lookup(pairs, scores, a, score_key, score, "__a"), scores, b, score_key, score, "__b")
    return both.withColumn("diff", F.col("__a") - F.col("__b")).drop("__a", "__b")


def clamped(df: DataFrame, value: str, lo: float, hi: float) -> DataFrame:
    return df.withColumn(value, clamp(F.col(value), lo, hi))


def rescaled(df: DataFrame, value: str, lo: float, hi: float, group: list[str] | None = None) -> DataFrame:
    """Maps the values (of each group) onto [lo, hi], keeping their order; constant values become ``lo``.

    The extremes are one aggregated row (of each group) that is joined to all rows.
    """
    if group:
        joined = join_same(df, df.groupBy(*group).agg(F.min(value).alias("__least"), F.max(value).alias("__most")), group)
        return joined.withColumn(value, rescale(F.col(value), F.col("__least"), F.col("__most"), lo, hi)).drop("__least", "__most")
    ends = df.agg(F.min(value).alias("__least"), F.max(value).alias("__most"))
    return df.join(F.broadcast(ends)).withColumn(value, rescale(F.col(value), F.col("__least"), F.col("__most"), lo, hi)).drop("__least", "__most")


def stacked(acr: DataFrame, ccr: DataFrame) -> DataFrame:
    """(sample_id, pred_score) of both kinds."""
    return acr.select("sample_id", "pred_score").unionByName(ccr.select("sample_id", "pred_score"))


def paths_of_pairs(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct clips of both sides, so that each is scored once."""
    return pairs.select(F.explode(F.array(a, b)).alias("path")).distinct()
