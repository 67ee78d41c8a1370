"""Mixing sources to target weights by Sainte-Lague apportionment.

Sources in code-point order (null last) weigh 5, 2, 1, repeating, and share all words; a target stops at three times
its source's size and the excess is reshared by weight. All words are cut into equal blocks; the blocks go to the
sources by highest quotients target / (2k + 1), then each source's blocks go to its shards by the same rule. A shard
lays its documents out in a seeded order and takes its quota as a run of blocks from a seeded block on, going round as
often as needed.

A shard is a hash range of one source with a bounded share of words and of documents, so a source with a third of
all rows is many shards. The driver only sees sums.

Defined cases: null and empty texts have size 0 and are never taken; a null source is a source of its own, last in
order; rows with equal ids are documents of their own, and so are equal rows, which are numbered in any order and lie in
places of their own; an empty table gives an empty mix; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ratelake.llm.common import cut, n_words, small_enough, table
from ratelake.operators.shared import join_same, with_position

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
#: Words in a block; smaller only where all words make fewer than MIN_BLOCKS blocks.
BLOCK = 32
MIN_BLOCKS = 4096
SHARD_WORDS = 1 << 20
SHARD_DOCS = 1 << 12
#: Shards of a source whose quotas are set together.
GROUP = 1 << 12
#: Sources (about 100 bytes each) that are broadcast; more are joined by a shuffle.
MAX_BROADCAST = 1 << 16
SEED = 20_24

_SOURCE = ("__null", "__source")


def _sized(docs: DataFrame, seed: int) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").isNull().alias("__null"),
        F.coalesce("source", F.lit("")).alias("__source"),
        n_words(F.col("text")).alias("size"),
        order_hash(seed).alias("__hash"),
    )


def order_hash(seed: int) -> Column:
    """The seeded place of a document; equal only for equal id and text."""
    return F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")))


def _numbered(df: DataFrame, keys: list[str], seed: int) -> DataFrame:
    """Adds ``__copy``: the 0-based number of each row among those with equal keys, in any order.

    A range sort by the keys and a random number, which is written first, gives the places, so that rows of one key are
    spread over tasks, however many there are.
    """
    placed = with_position(cut(df.withColumn("__tie", F.rand(seed))), *keys, "__tie", name="__place")
    first = placed.groupBy(*keys).agg(F.min("__place").alias("__first"))
    return join_same(placed, first, keys).withColumn("__copy", F.col("__place") - F.col("__first")).drop("__tie", "__place", "__first")


def _told_apart(sized: DataFrame, seed: int) -> DataFrame:
    """Gives equal rows, all but one of each, hashes of their own; ``__key`` is the hash they share."""
    keys = ["doc_id", *_SOURCE, "__hash"]
    sized = sized.withColumn("__key", F.col("__hash"))
    equal = cut(sized.groupBy(*keys).agg(F.count("*").alias("__rows")).where("__rows > 1").select(*keys))
    if equal.isEmpty():
        return sized
    side = F.broadcast(equal) if small_enough(equal, MAX_BROADCAST) else equal
    several = _numbered(join_same(sized, side, keys, "left_semi"), keys, seed)
    several = several.withColumn("__hash", F.when(F.col("__copy") == 0, F.col("__hash")).otherwise(F.xxhash64("__hash", "__copy"))).drop("__copy")
    return cut(join_same(sized, side, keys, "left_anti").unionByName(several))


def with_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = MAX_REPEATS) -> DataFrame:
    """Adds ``target`` to (__null, __source, source_size): shares by weight, filled up to ``repeats`` times the size."""
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = with_position(sources, *_SOURCE, name="rank").withColumn("__weight", weight).withColumn("__cap", F.col("source_size") * float(repeats))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, capped = None, -1
    while True:  # each round caps at least one more source, in practice many at once
        over = F.lit(False) if level is None else F.col("__cap") < F.col("__weight") * level
        n, full, open_ = sources.agg(F.count_if(over), F.sum(F.when(over, F.col("__cap"))), F.sum(F.when(~over, F.col("__weight")))).first()
        if n == capped:
            break
        capped, level = n, (total - (full or 0.0)) / open_ if open_ else level or 0.0
    return sources.withColumn("target", F.least("__cap", F.col("__weight") * F.lit(float(level or 0.0)))).drop("rank", "__weight", "__cap")


def _seats(q: str, extra: Column, n: int) -> Column:
    """The next ``n`` seats after ``q`` if seats are missing, the last ``n`` up to it if there are too many."""
    up = F.sequence(F.col(q), F.col(q) + n - 1)
    down = F.sequence(F.greatest(F.col(q) - n, F.lit(0)), F.col(q) - 1)
    empty = F.array().cast("array<bigint>")
    return F.when(extra > 0, up).when((extra < 0) & (F.col(q) > 0), down).otherwise(empty)


def _quotient(target: str) -> Column:
    return F.col(target) / (F.col("__seat") * 2 + 1)


def quotas(sources: DataFrame, blocks: int) -> DataFrame:
    """Adds ``quota``: ``blocks`` seats by highest target / (2k + 1), ties by source.

    Rounding target / divisor gives the apportionment of a house of nearly that many seats; what is missing or too
    much are the next seats by quotient.
    """
    total = sources.agg(F.sum("target")).first()[0] or 0.0
    divisor = total / blocks if blocks and total else 1.0
    start = cut(sources.withColumn("__q", F.floor(F.col("target") / divisor + 0.5)))
    missing = blocks - (start.agg(F.sum("__q")).first()[0] or 0) if total else 0
    if not missing:
        return start.withColumnRenamed("__q", "quota")
    n = 2
    while True:
        seat = start.select(*_SOURCE, "target", F.explode(_seats("__q", F.lit(missing), n)).alias("__seat"))
        best = _quotient("target").desc() if missing > 0 else _quotient("target").asc()
        moved = seat.orderBy(best, *_SOURCE).limit(abs(missing)).groupBy(*_SOURCE).agg(F.count("*").alias("__moved"))
        if (moved.agg(F.max("__moved")).first()[0] or 0) < n or n > abs(missing):
            break
        n *= 2
    change = F.coalesce("__moved", F.lit(0)) * (1 if missing > 0 else -1)
    return start.join(moved, [*_SOURCE], "left").withColumn("quota", F.col("__q") + change).drop("__q", "__moved")


def _shared_out(parts: DataFrame, whole: list[str], part: str, size: str, total: str, quota: str, out: str) -> DataFrame:
    """Adds ``out``: of each whole's ``quota`` the seats of its parts, by highest size / (2k + 1)."""
    by_whole = Window.partitionBy(*whole)
    share = F.when(F.col(total) > 0, F.col(quota) * F.col(size) / F.col(total)).otherwise(F.lit(0.0))
    start = parts.withColumn("__q", F.floor(share + 0.5)).withColumn("__extra", F.col(quota) - F.sum("__q").over(by_whole))
    seat = start.select(*whole, part, size, "__extra", F.explode(_seats("__q", F.col("__extra"), 2)).alias("__seat"))
    sign = F.signum(F.col("__extra").cast("double"))
    place = F.row_number().over(by_whole.orderBy((_quotient(size) * -sign), part, "__seat"))
    moved = seat.withColumn("__place", place).where(F.col("__place") <= F.abs("__extra"))
    moved = moved.groupBy(*whole, part).agg(F.sum(sign.cast("long")).alias("__moved"))
    return start.join(moved, [*whole, part], "left").withColumn(out, F.col("__q") + F.coalesce("__moved", F.lit(0))).drop("__q", "__moved", "__extra")


def shard_quotas(shards: DataFrame) -> DataFrame:
    """Adds ``shard_quota``: each source's quota goes to its groups of GROUP shards and theirs to the shards.

    Both by highest size / (2k + 1), so that no task sees more than GROUP shards, or groups, of a source.
    """
    grouped = shards.withColumn("__group", F.floor(F.col("shard") / GROUP))
    groups = grouped.groupBy(*_SOURCE, "__group").agg(F.sum("shard_size").alias("__group_size"), F.first("source_size").alias("source_size"), F.first("quota").alias("quota"))
    groups = _shared_out(groups, [*_SOURCE], "__group", "__group_size", "source_size", "quota", "__group_quota").select(*_SOURCE, "__group", "__group_size", "__group_quota")
    whole = [*_SOURCE, "__group"]
    return _shared_out(grouped.join(groups, whole), whole, "shard", "shard_size", "__group_size", "__group_quota", "shard_quota").drop("__group", "__group_size", "__group_quota")


def _overlap(start: Column, end: Column, lo: Column, hi: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), F.least(end, hi) - F.greatest(start, lo))


def _mixed(docs: DataFrame, weights: tuple[int, ...], repeats: int, block: int, seed: int) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, and __key (the hash of its id and text)."""
    sized = _told_apart(cut(_sized(docs, seed)), seed)
    sources = sized.groupBy(*_SOURCE).agg(F.sum("size").alias("source_size"), F.count("*").alias("__docs"))
    sources = cut(with_targets(sources, weights, repeats))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    block = max(1, min(block, total // MIN_BLOCKS))
    shards_of = F.greatest(F.ceil(F.col("source_size") / SHARD_WORDS), F.ceil(F.col("__docs") / SHARD_DOCS), F.lit(1))
    sources = cut(quotas(sources, total // block).withColumn("__shards", shards_of))
    # A join by source would deal a hot source to one task; broadcast, each row gets its shard in place.
    side = sources.drop("__docs")
    side = F.broadcast(side) if small_enough(side, MAX_BROADCAST) else side
    placed = sized.join(side, [*_SOURCE]).withColumn("shard", F.pmod("__hash", "__shards"))
    shards = placed.groupBy(*_SOURCE, "shard").agg(F.sum("size").alias("shard_size"), F.first("source_size").alias("source_size"), F.first("quota").alias("quota"))
    shards = shard_quotas(shards).select(*_SOURCE, "shard", "shard_size", "shard_quota")
    laid = placed.join(shards, [*_SOURCE, "shard"])
    end = F.sum("size").over(Window.partitionBy(*_SOURCE, "shard").orderBy("__hash", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0))
    n = F.col("shard_size")
    words = F.least(F.col("shard_quota") * block, n * repeats)
    first = F.pmod(F.xxhash64(F.lit(seed), *_SOURCE, "shard"), F.greatest(F.ceil(n / block), F.lit(1))) * block
    laid = laid.withColumns({"__end": end, "__words": words, "__first": first}).withColumn("__start", F.col("__end") - F.col("size"))
    rest = F.expr("__words % greatest(shard_size, 1)")
    stop = F.col("__first") + rest
    run = _overlap(F.col("__start"), F.col("__end"), F.col("__first"), F.least(stop, n)) + _overlap(F.col("__start"), F.col("__end"), F.lit(0).cast("long"), stop - n)
    taken = F.when(F.col("size") > 0, F.expr("__words div greatest(shard_size, 1)") * F.col("size") + run).otherwise(F.lit(0))
    source = F.when(~F.col("__null"), F.col("__source")).alias("source")
    return laid.select("doc_id", source, "size", "source_size", "target", taken.cast("long").alias("taken"), "__key")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = MAX_REPEATS, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken."""
    return _mixed(docs, weights, repeats, block, seed).drop("__key")


def apply_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = MAX_REPEATS, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """The mixed documents with their own columns: each as many times as the mix takes it, to the nearest whole.

    Only the document at either end of a shard's run is taken in part. Rows of equal id, source and text share out what
    the mix takes of them all.
    """
    taken = _mixed(docs, weights, repeats, block, seed).groupBy("doc_id", "source", "__key").agg(F.sum("taken").alias("taken"), F.max("size").alias("size"), F.count("*").alias("rows"))
    copies = F.floor(F.col("taken") / F.greatest("size", F.lit(1)) + 0.5)
    chosen = cut(taken.select(F.col("doc_id").alias("id"), F.col("source").alias("of"), F.col("__key").alias("order"), copies.alias("copies"), "rows").where("copies > 0"))
    # The document's own columns stay in one struct, so that none can clash with what is joined.
    keyed = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "source", order_hash(seed).alias("hash"))
    same = F.col("hash").eqNullSafe(F.col("order")) & F.col("doc_id").eqNullSafe(F.col("id")) & F.col("source").eqNullSafe(F.col("of"))
    out = keyed.join(chosen.where("rows = 1"), same).select("row", "copies")
    several = chosen.where("rows > 1")
    if not several.isEmpty():
        side = F.broadcast(several) if small_enough(several, MAX_BROADCAST) else several
        own = _numbered(keyed.join(side, same).select("row", "doc_id", "source", "hash", "copies", "rows"), ["doc_id", "source", "hash"], seed)
        share = F.expr("(__copy + 1) * copies div rows - __copy * copies div rows")
        out = out.unionByName(own.select("row", share.alias("copies")).where("copies > 0"))
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("row.*")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
