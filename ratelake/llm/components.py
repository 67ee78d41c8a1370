"""Connected components of a graph given as a table of edges, without collecting any of it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratelake.llm.common import cut, small_enough

#: Links (16 bytes each) that one task joins up; more go through rounds of shuffles.
MAX_LINKS = 1 << 18


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): for every node of an edge (a, b) the smallest node that it can reach.

    Alternates the large-star and small-star steps (each one grouped minimum and a join back), which keep components
    whole and end in stars round their smallest nodes after about log2(nodes) rounds. Rows of a hub are spread by the
    join's skew handling; minima are pre-aggregated. Null ends are ignored.
    """
    links = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u is not null and v is not null and u <> v").distinct())
    before = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select("v", "m").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        state = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.count_distinct("u")).first()
        if state == before:
            break
        before = state
    roots = links.select(F.col("v").alias("node")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.join(links.select(F.col("u").alias("node")), "node", "left_anti").withColumn("component", F.col("node")))


def rooted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every end of the links (a, b) but the least of each component, and that least one."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    up = list(range(len(nodes)))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for x, y in zip(ends[: len(a)].tolist(), ends[len(a) :].tolist()):
        x, y = root(x), root(y)
        up[max(x, y)] = min(x, y)
    roots = np.array([root(x) for x in range(len(nodes))], np.int64)
    other = np.flatnonzero(roots != np.arange(len(nodes)))
    return nodes[other], nodes[roots[other]]


def reached(edges: DataFrame, max_links: int | None = None) -> DataFrame:
    """(node, component): for every node of an edge (a, b) but the least of a component the smallest one it can reach.

    Up to ``max_links`` different links, a size that is checked, one task joins them up in memory, which saves the some
    forty shuffles that rounds of stars take however small the graph is; beyond, ``connected_components`` does.
    """
    links = cut(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    if not small_enough(links, MAX_LINKS if max_links is None else max_links):
        return connected_components(links).where("node <> component")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if held:
            yield pa.record_batch([pa.array(x) for x in rooted(*(np.concatenate(x) for x in zip(*held)))], names=["node", "component"])

    return links.coalesce(1).mapInArrow(run, "node long, component long")
