"""Caps, splits, dedupes, batches and dense ids. All are deterministic: order comes from salted md5, ties from keys."""

from __future__ import annotations

from collections.abc import Iterable
from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratelake.operators.shared import with_position

SALT = "42"


def salted(key: Column, salt: str = SALT) -> Column:
    return F.md5(F.concat(F.lit(salt), key.cast("string")))


def cap(df: DataFrame, group: str, key: str, most: int | None, salt: str = SALT) -> DataFrame:
    """At most ``most`` rows of each group; 0 or None leaves all.

    The rank filter lets Spark keep only ``most`` rows of a group in each task before the shuffle.
    """
    if not most:
        return df
    place = F.row_number().over(Window.partitionBy(group).orderBy(salted(F.col(key), salt), key))
    return df.withColumn("__place", place).where(F.col("__place") <= most).drop("__place")


def ranked(df: DataFrame, group: str, key: str, salt: str = SALT) -> DataFrame:
    """Adds ``__rank`` (from 1) and ``__n`` of each row within its group, in salted order.

    Ranks are taken in 4096 hash ranges of a group and shifted by the ranges' counts, so a group that holds most rows
    is spread over many tasks.
    """
    order = salted(F.col(key), salt)
    df = df.withColumn("__order", order).withColumn("__range", F.substring("__order", 1, 3))
    counts = df.groupBy(group, "__range").agg(F.count("*").alias("__in"))
    up = Window.partitionBy(group).orderBy("__range")
    counts = counts.select(
        F.col(group).alias("__group"),
        F.col("__range").alias("__r"),
        (F.sum("__in").over(up) - F.col("__in")).alias("__before"),
        F.sum("__in").over(Window.partitionBy(group)).alias("__n"),
    )
    joined = df.join(counts, df[group].eqNullSafe(counts["__group"]) & (df["__range"] == counts["__r"]))
    within = F.row_number().over(Window.partitionBy(group, "__range").orderBy("__order", key))
    return joined.withColumn("__rank", F.col("__before") + within).drop("__group", "__r", "__before", "__range", "__order")


def split(df: DataFrame, group: str, key: str, tenths: int = 9, salt: str = SALT) -> DataFrame:
    """Sets ``split``: the first n * tenths div 10 rows of each group, in salted order, are for training."""
    label = F.when(F.col("__rank") <= F.expr(f"(__n * {tenths}) div 10"), "train").otherwise("dev")
    return ranked(df, group, key, salt).withColumn("split", label).drop("__rank", "__n")


def dedupe_first(frames: list[DataFrame], key: str) -> DataFrame:
    """One row per key over several inputs: (key, first input that has it)."""
    parts = [f.select(key).withColumn("input", F.lit(i)) for i, f in enumerate(frames)]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.groupBy(key).agg(F.min("input").alias("input"))


def with_batches(df: DataFrame, key: str, size: int) -> DataFrame:
    """Adds ``batch_id``: ``size`` rows each in key order; the last may be short."""
    placed = with_position(df, key, name="__position")
    return placed.withColumn("batch_id", F.floor(F.col("__position") / size).cast("long")).drop("__position")


#: Rounds of the permutation of positions.
ROUNDS = 6


def _round(value: Column, key: Column, number: Column) -> Column:
    """32 bits that depend on all three."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", key, number.cast("string"), value.cast("string"))), 1, 8), 16, 10).cast("long")


def permuted(position: Column, n: int, key: Column) -> Column:
    """Where each of ``n`` positions goes under the permutation named by ``key`` (a string).

    A Feistel network over a rectangle that is hardly larger than n: a position is a row and a column, and each round
    shifts one of them by a hash of the other. A result beyond n is put through again until it lies below, which takes a
    second walk for about one position in the root of n. So each row finds its place by itself, whatever its neighbours
    and its partition, and nothing is sorted.
    """
    across = max(1, isqrt(max(n - 1, 0)) + 1)
    down = max(1, -(-n // across))

    def walk(x: Column) -> Column:
        start = F.struct((x % across).alias("left"), F.floor(x / across).cast("long").alias("right"))

        def step(state: Column, number: Column) -> Column:
            side = F.when(number % 2 == 0, F.lit(across)).otherwise(F.lit(down)).cast("long")
            return F.struct(state["right"].alias("left"), ((state["left"] + _round(state["right"], key, number)) % side).alias("right"))

        # After an even number of rounds left is a column again, and right a row.
        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda state: state["left"] + state["right"] * across)

    first = walk(position.cast("long"))
    # No walk passes through more positions beyond n than there are.
    again = F.sequence(F.lit(1), F.lit(max(1, across * down - n)))
    return F.aggregate(F.array(F.lit(0)), first, lambda x, _: F.when(x < n, x).otherwise(F.aggregate(again, x, lambda y, _: F.when(y < n, y).otherwise(walk(y)))))


def shuffled_batches(df: DataFrame, key: str, size: int, epochs: Iterable[int], seed: int = 0) -> DataFrame:
    """Every row once in each of ``epochs``, with ``epoch``, ``batch_id`` and ``slot`` (its place in the batch).

    Batches have ``size`` rows each, but for the last. Places in key order are taken once, by a range sort; each epoch
    permutes them by ``permuted``, so rows are neither sorted nor moved again, and any batch of any epoch can be made
    anew. Equal keys take their places in any order.
    """
    placed = with_position(df, key, name="__position")
    n = placed.count()
    epoch = F.explode(F.array(*[F.lit(int(e)) for e in epochs])).alias("epoch")
    at = permuted(F.col("__position"), n, F.concat_ws("/", F.lit(str(seed)), F.col("epoch").cast("string")))
    out = placed.select("*", epoch).withColumn("__at", at)
    return out.withColumns({"batch_id": F.floor(F.col("__at") / size).cast("long"), "slot": (F.col("__at") % size).cast("long")}).drop("__at", "__position")


def dense_ids(df: DataFrame, value: str, batch: str) -> DataFrame:
    """Adds ``source_id``: 0-based place of the value among the batch's sorted distinct values."""
    place = F.dense_rank().over(Window.partitionBy(batch).orderBy(value)) - 1
    return df.withColumn("source_id", place.cast("long"))


def same_set(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: how many values only one side has, and whether the sets are equal."""
    sides = a.distinct().withColumn("__side", F.lit(1)).unionByName(b.distinct().withColumn("__side", F.lit(2)))
    odd = sides.groupBy(*a.columns).agg(F.count("*").alias("__n")).agg(F.count_if(F.col("__n") == 1).alias("n_different"))
    return odd.withColumn("equal", F.col("n_different") == 0)


def zipped(left: DataFrame, right: DataFrame, left_order: str, right_order: str) -> DataFrame:
    """Rows of both sides at equal places in their orders, side by side; as many as the shorter side has."""
    a, b = with_position(left, left_order, name="__left"), with_position(right, right_order, name="__right")
    return a.join(b, a["__left"] == b["__right"]).drop("__left", "__right")


def is_set(df: DataFrame, column: str, values: Iterable[str]) -> bool:
    """Whether the distinct values of a column are just these; reads few more than there should be."""
    wanted = set(values)
    found = {r[0] for r in df.select(column).distinct().limit(len(wanted) + 1).collect()}
    return found == wanted


def required(df: DataFrame, what: str) -> DataFrame:
    """``df``, or an error if it has no rows."""
    if df.isEmpty():
        raise AssertionError(f"{what} is empty")
    return df
