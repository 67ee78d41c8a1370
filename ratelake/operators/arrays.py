"""Maths over array columns; higher-order functions for short arrays, relational form for pooling."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLIP_SECONDS, SAMPLE_RATE = 10, 16_000


def peak(x: Column) -> Column:
    return F.array_max(F.transform(x, F.abs))


def peak_normalized(x: Column) -> Column:
    """Divided by the largest magnitude; silence stays, an empty array fails."""
    top = peak(x)
    scaled = F.transform(x, lambda v: v / top)
    return F.when(F.size(x) == 0, F.raise_error(F.lit("empty array"))).when(top > 0, scaled).otherwise(F.transform(x, lambda v: v.cast("double")))


def pad_or_clip(x: Column, n: int = CLIP_SECONDS * SAMPLE_RATE) -> Column:
    """Exactly ``n`` values: cut, or filled with zeros, at the end."""
    zeros = F.array_repeat(F.lit(0.0).cast("float"), F.greatest(F.lit(n) - F.size(x), F.lit(0)))
    return F.concat(F.slice(x.cast("array<float>"), 1, n), zeros)


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def dot(x: Column, weights: Sequence[float]) -> Column:
    w = F.array(*[F.lit(float(v)) for v in weights])
    return total(F.zip_with(x, w, lambda a, b: a.cast("double") * b))


def head(x: Column, weights: Sequence[float], bias: float) -> Column:
    """A scalar linear head."""
    return dot(x, weights) + bias


def layer_norm(x: Column, eps: float = 1e-5) -> Column:
    """Centred and divided by the biased standard deviation."""
    d = x.cast("array<double>")
    mean = total(d) / F.size(x)
    var = total(F.transform(d, lambda v: v * v)) / F.size(x) - mean * mean
    return F.transform(d, lambda v: (v - mean) / F.sqrt(F.greatest(var, F.lit(0.0)) + eps))


def affine(x: Column, rows: Sequence[Sequence[float]], bias: Sequence[float]) -> Column:
    """A dense layer: one output per row of weights."""
    return F.array(*[head(x, r, b) for r, b in zip(rows, bias, strict=True)])


def without_missing(x: Column) -> Column:
    return F.filter(x, lambda v: v.isNotNull() & ~F.isnan(v))


def with_repeated(frames: Column, vector: Column) -> Column:
    """Appends one vector to every frame of an array of frames."""
    return F.transform(frames, lambda f: F.concat(f, vector))


def layer_of(df: DataFrame, layer: int) -> DataFrame:
    """Rows of one encoder layer; -1 is the last one of each clip."""
    if layer >= 0:
        return df.where(F.col("layer") == layer)
    last = df.groupBy("path").agg(F.max("layer").alias("layer"))
    return df.join(last, ["path", "layer"], "left_semi")


#: What a task knows of a key's frames: their highest score, and relative to it the weights' sum and the weighted values.
_PARTIAL = "top double, weight double, sums array<double>"


def _merged(partials: Column) -> Column:
    """The partial of all frames from those of parts, each rescaled to the common highest score."""
    scaled = lambda p, top: F.struct(top.alias("top"), (p["weight"] * F.exp(p["top"] - top)).alias("weight"), F.transform(p["sums"], lambda v: v * F.exp(p["top"] - top)).alias("sums"))

    def merge(a: Column, b: Column) -> Column:
        top = F.greatest(a["top"], b["top"])
        x, y = scaled(a, top), scaled(b, top)
        return F.struct(top.alias("top"), (x["weight"] + y["weight"]).alias("weight"), F.zip_with(x["sums"], y["sums"], lambda u, v: u + v).alias("sums"))

    return F.aggregate(F.slice(partials, 2, F.greatest(F.size(partials) - 1, F.lit(1))), F.get(partials, F.lit(0)), merge)


def _pooled(rows: DataFrame, kind: str) -> DataFrame:
    """(key, pooled) of rows (key, scores, values): a block's scores, and its frames' values, one frame after another.

    Each task makes one partial for each run of a key's rows that it reads, and the parts of a key are merged after the
    only shuffle; a part is one vector, however many frames it stands for.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Carries a key's partial on through its run of rows."""
        held: tuple | list = []

        def out(done: list) -> pa.RecordBatch:
            columns = [pa.array([d[0] for d in done], batches_type[0]), *[pa.array([d[k] for d in done], pa.float64()) for k in (1, 2)], pa.array([d[3] for d in done], pa.list_(pa.float64()))]
            return pa.record_batch(columns, names=["key", "top", "weight", "sums"])

        def parts_of(batch: pa.RecordBatch) -> Iterator[tuple]:
            """A partial for each block; for rows of one frame each, for each run of equal keys."""
            keys, sizes = batch.column(0).to_pylist(), batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
            if len(keys) and (sizes == 1).all():
                score = batch.column(1).flatten().to_numpy(zero_copy_only=False)
                frames = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(score), -1)
                first = np.flatnonzero([True, *(a != b for a, b in zip(keys, keys[1:]))])
                top = np.maximum.reduceat(score, first)
                weights = np.exp(score - np.repeat(top, np.diff([*first, len(score)])))
                yield from zip([keys[i] for i in first.tolist()], top, np.add.reduceat(weights, first), np.add.reduceat(weights[:, None] * frames, first, axis=0))
                return
            for key, scores, values in zip(keys, batch.column(1), batch.column(2)):
                if scores.is_valid and len(scores):
                    score = scores.values.to_numpy(zero_copy_only=False)
                    frames = values.values.to_numpy(zero_copy_only=False).reshape(len(score), -1)
                    weights = np.exp(score - score.max())
                    yield key, score.max(), weights.sum(), weights @ frames

        batches_type: list = []
        for batch in batches:
            batches_type[:] = [batch.schema.field(0).type]
            done = []
            for part in parts_of(batch):
                key, top = part[:2]
                if held and held[0] == key:
                    both = max(top, held[1])
                    a, b = np.exp(held[1] - both), np.exp(top - both)
                    held = [key, both, held[2] * a + part[2] * b, held[3] * a + part[3] * b]
                else:
                    if held:
                        done.append(held)
                    held = part
            if done:
                yield out(done)
        if held:
            yield out([held])

    parts = rows.mapInArrow(run, f"key {kind}, {_PARTIAL}")
    whole = parts.groupBy("key").agg(_merged(F.collect_list(F.struct("top", "weight", "sums"))).alias("p"))
    return whole.select("key", F.transform("p.sums", lambda v: v / F.col("p.weight")).alias("pooled"))


def attention_pool_blocks(blocks: DataFrame, key: str, scores: str, values: str) -> DataFrame:
    """(key, pooled): softmax over a key's frames by their scores, then the weighted mean of their vectors.

    A row is a block of a key's frames: ``scores`` has one entry for each, ``values`` their vectors flattened. Blocks may
    lie anywhere; one shuffle of a vector for each key and task that has any.
    """
    rows = blocks.select(F.col(key).alias("key"), F.col(scores).cast("array<double>").alias("scores"), F.col(values).cast("array<double>").alias("values"))
    return _pooled(rows, rows.schema["key"].dataType.simpleString()).withColumnRenamed("key", key)


def attention_pool(frames: DataFrame, key: str, score: str, values: Sequence[str]) -> DataFrame:
    """(key, pooled values): softmax of the frames' scores over time, then weighted means; one row per frame."""
    rows = frames.select(F.col(key).alias("key"), F.array(F.col(score).cast("double")).alias("scores"), F.array(*[F.col(v).cast("double") for v in values]).alias("values"))
    pooled = _pooled(rows, rows.schema["key"].dataType.simpleString())
    return pooled.select(F.col("key").alias(key), *[F.get("pooled", F.lit(k)).alias(v) for k, v in enumerate(values)])
