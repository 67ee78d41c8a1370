"""Jaccard join of n-gram sets by PartEnum signatures.

A text is the set of its distinct word shingles, as 64-bit hashes. Two sets link if their Jaccard similarity is at least a
threshold (a whole percentage). Sizes are cut into bands so narrow that linked sets lie in the same band or in adjacent
ones; within such a pair of bands, linked sets differ in at most k elements, k following from the band. The feature domain
(all hash values) is cut into (k // 2 + 1) parts of three cells each. Of k differences at most one falls into some part, so
linked sets agree on two of its three cells at least: each two of a part's cells make a signature, and linked sets share
one. A set has signatures for its own band and for the next one, about a third as many as it has elements. That is a
proof: no link is missed (but for cells of equal 64-bit hash).

Signatures go through a range sort by signature and set, so that a signature of very many sets spans tasks, and
neighbours under a signature are chained into clusters. All of a cluster's sets are then compared exactly, in cells of
bounded size: first in blocks, each with the cluster's representative; where a cluster has several blocks and is not one
group by then, the sets outside its largest group meet all others, block by block. A crowd of copies of one text thus costs
a comparison for each of its blocks; only sets that share signatures without being similar are met in all pairs of blocks.
A task gives each set's least partner in reach. Sets are made anew from the texts of clusters alone; they are never kept for
all documents.

Defined cases: null texts and such without a word have an empty set, linked with nothing; fewer words than a shingle are
one shingle of the whole sequence; equal sets are one node; rows that share a ``doc_id`` are one document, so what either
is linked with is linked; a row without a ``doc_id`` is no document: it has its own size, no component, and links nothing;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratelake.llm import textkernel as tk
from ratelake.llm.common import cut, small_enough, table
from ratelake.llm.components import reached, rooted

WIDTH, PERCENT = 3, 90
#: Cells of a part, of which all but one make a signature.
CELLS = 3
#: Sets, and elements of sets, of a cluster's block.
BLOCK_SETS, BLOCK_ELEMENTS = 1 << 9, 1 << 20
#: Rows of two numbers that are broadcast; more are joined by a shuffle.
MAX_BROADCAST = 1 << 19
#: Elements in more sets than this are counted by a matrix product, others pair by pair.
DENSE = 16
_COLUMNS = 1 << 12
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


@dataclass(frozen=True)
class Bands:
    """Bands of set sizes: the largest size of each, and the parts for pairs from it and the band before."""

    last: np.ndarray
    parts: np.ndarray

    @staticmethod
    def upto(size: int, percent: int) -> Bands:
        """All bands up to ``size`` and one more. A band with no parts links equal sets alone."""
        last, parts, low = [], [], 1
        while not last or len(last) < 2 or last[-2] < size:
            high = low * 100 // percent
            # Of x + y elements in two sets, (100 - percent) in (100 + percent) at most are not shared.
            differ = 2 * high * (100 - percent) // (100 + percent)
            last.append(high)
            parts.append(differ // (CELLS - 1) + 1 if differ else 0)
            low = high + 1
        return Bands(np.array(last), np.array(parts))


def shingle_sets(c: tk.Chunk, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of a chunk's texts as hashes, sorted within each text, and where each text's begin."""
    low = replace(c, data=_LOWER[c.data])
    start, end, first = low.words()
    texts, n = len(c.offsets) - 1, np.diff(first)
    words = tk.span_hashes(low.prefix(), start, end, tk.POWERS)
    size = np.minimum(n, width)
    begins = np.maximum(n - width + 1, np.minimum(n, 1))
    owner = np.repeat(np.arange(texts), begins)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(begins) - begins, begins) + first[owner]
    hashes = size[owner].astype(np.uint64)
    for k in range(width):
        more = k < size[owner]
        hashes[more] = tk.combine(hashes[more], words[at[more] + k])
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
    return hashes[new], np.searchsorted(owner[new], np.arange(texts + 1))


def set_ids(elements: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set."""
    out = []
    for salt in (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179):
        run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tk.mix(elements ^ np.uint64(salt)), dtype=np.uint64)])
        out.append(tk.mix(run[first[1:]] - run[first[:-1]] + np.diff(first).astype(np.uint64)).view(np.int64))
    return out[0], out[1]


def signatures(elements: np.ndarray, first: np.ndarray, band: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """The signatures of each set as one of ``band`` (or of the band before), and where each set's begin."""
    parts, n = bands.parts[band], np.diff(first)
    cells = parts * CELLS
    base = np.concatenate([[0], np.cumsum(cells)])
    owner = np.repeat(np.arange(len(n)), n)
    has = cells[owner] > 0
    # Elements are sorted, and a cell is a range of values, so that its elements are neighbours.
    cell = (elements >> np.uint64(32)) * cells[owner].astype(np.uint64) >> np.uint64(32)
    held = np.bincount(base[owner[has]] + cell[has].astype(np.int64), minlength=base[-1]) if base[-1] else np.zeros(0, np.int64)
    bound = np.concatenate([[0], np.cumsum(held)])
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tk.mix(elements[has] ^ np.uint64(0x3C6EF372FE94F82B)), dtype=np.uint64)])
    content = tk.mix(run[bound[1:]] - run[bound[:-1]] + held.astype(np.uint64)).reshape(-1, CELLS)
    part = np.arange(len(content)) - np.repeat(base[:-1] // CELLS, parts)
    tag = tk.mix(np.repeat(band, parts).astype(np.uint64) << np.uint64(32) | part.astype(np.uint64))
    made = np.empty((len(content), CELLS), np.uint64)
    for left_out in range(CELLS):
        own = tag + np.uint64(left_out)
        for k in range(CELLS):
            if k != left_out:
                own = tk.combine(own, content[:, k])
        made[:, left_out] = own
    return made.ravel().view(np.int64), base


def _signed(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc_id, id1, id2, n, keys): each row's set, by its hashes, size and signatures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tk.release()
        bands = Bands.upto(1, percent)
        for batch in batches:
            ids = batch.column(0)
            for c in tk.chunks(batch.column(1)):
                elements, first = shingle_sets(c, width)
                n = np.diff(first)
                if n.max() > bands.last[-2]:
                    bands = Bands.upto(int(n.max()), percent)
                band = np.searchsorted(bands.last, n)
                keys, ends = zip(*(signatures(elements, first, band + k, bands) for k in (0, 1)))
                many = np.diff(ends[0]) + np.diff(ends[1])
                to = np.concatenate([[0], np.cumsum(many)])
                both = np.empty(to[-1], np.int64)
                for own, end, after in zip(keys, ends, (np.zeros(len(n), np.int64), np.diff(ends[0]))):
                    both[np.repeat(to[:-1] + after - end[:-1], np.diff(end)) + np.arange(len(own))] = own
                lists = pa.ListArray.from_arrays(pa.array(to.astype(np.int32)), pa.array(both))
                yield pa.record_batch([ids.slice(c.lo, c.hi - c.lo), *map(pa.array, set_ids(elements, first)), pa.array(n), lists], names=["doc_id", "id1", "id2", "n", "keys"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, id1 long, id2 long, n long, keys array<long>")


def _chained(rows: DataFrame) -> DataFrame:
    """Links (a, b) that connect all nodes under each key of ``rows`` (key, node)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links of each node under a key with the first one there, with null keys; the nodes at either end of the partition with theirs."""
        first = last = None
        out = lambda a, b, key: pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(key, pa.int64())], names=["a", "b", "key"])
        for batch in batches:
            key, node = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(key):
                continue
            if first is None:
                yield out([node[0]], [node[0]], [key[0]])
            else:
                key, node = np.concatenate([first[0], key]), np.concatenate([first[1], node])
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            at = np.flatnonzero(new)[np.cumsum(new) - 1]
            pairs = np.unique(np.stack([node, node[at]], axis=1)[node != node[at]], axis=0)
            yield out(pairs[:, 0], pairs[:, 1], [None] * len(pairs))
            first, last = (key[at[-1:]], node[at[-1:]]), (key[-1:], node[-1:])
        if last is not None:
            yield out(last[1], last[1], last[0])

    found = cut(rows.repartitionByRange("key", "node").sortWithinPartitions("key", "node").mapInArrow(run, "a long, b long, key long").distinct())
    ends = found.where("key is not null").select("key", "a")  # two for each task
    borders = ends.join(ends.groupBy("key").agg(F.min("a").alias("b")), "key").select("a", "b")
    return found.where("key is null").select("a", "b").unionByName(borders).where("a <> b")


def _clusters(signed: DataFrame, copies: DataFrame) -> DataFrame:
    """(node, cluster, id1, id2, n): the sets that share a signature with another one, by the least of each cluster.

    ``copies`` are the sets of several rows, with the least of their documents as ``node``.
    """
    ids = ["id1", "id2"]
    once = signed.join(copies, ids, "left_anti").select(F.col("doc_id").alias("node"), "keys")
    # Copies are merged before the shuffle, so that a text that a third of all rows hold is one row for each task.
    merged = signed.join(copies, ids).groupBy("node").agg(F.first("keys").alias("keys"))
    links = _chained(once.unionByName(merged).select(F.explode("keys").alias("key"), "node"))
    found = cut(reached(links).withColumnRenamed("component", "cluster"))
    found = found.unionByName(found.select(F.col("cluster").alias("node"), "cluster").distinct())
    side = F.broadcast(found) if small_enough(found, MAX_BROADCAST) else found
    return signed.join(side, signed["doc_id"] == side["node"]).select("node", "cluster", *ids, "n").distinct()


def _sets(docs: DataFrame, members: DataFrame, width: int) -> DataFrame:
    """``members`` (node, id1, id2, and others) with ``elements``, made anew from their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tk.release()
        for batch in batches:
            for c in tk.chunks(batch.column(1)):
                elements, first = shingle_sets(c, width)
                made = [elements[i:j].tobytes() for i, j in zip(first[:-1].tolist(), first[1:].tolist())]
                yield pa.record_batch([batch.column(0).slice(c.lo, c.hi - c.lo), *map(pa.array, set_ids(elements, first)), pa.array(made, pa.binary())], names=["node", "id1", "id2", "elements"])

    nodes = members.select("node").distinct()
    side = F.broadcast(nodes) if small_enough(nodes, MAX_BROADCAST) else nodes
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string").alias("text")).join(side, "node", "left_semi")
    made = texts.mapInArrow(run, "node long, id1 long, id2 long, elements binary").groupBy("node", "id1", "id2").agg(F.first("elements").alias("elements"))
    return made.join(members, ["node", "id1", "id2"])


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two of the sets share; an element in few of them counts pair by pair, in many by a product."""
    m = len(sets)
    if m == 2:
        return np.array([[0, n := len(np.intersect1d(*sets, assume_unique=True))], [n, 0]])
    element, owner = np.concatenate(sets), np.repeat(np.arange(m), [len(x) for x in sets])
    order = np.argsort(element, kind="stable")
    element, owner = element[order], owner[order]
    new = np.ones(len(element), bool)
    new[1:] = element[1:] != element[:-1]
    column = np.cumsum(new) - 1
    many = np.bincount(column)
    out = np.zeros(m * m, np.int64)
    few = (many[column] > 1) & (many[column] <= DENSE)
    c, o = column[few], owner[few]
    for d in range(1, DENSE):
        if len(c) <= d:
            break
        same = np.flatnonzero(c[d:] == c[:-d])
        if not len(same):
            break
        out += np.bincount(o[same] * m + o[same + d], minlength=m * m)  # owners ascend within a column
    out = out.reshape(m, m)
    out += out.T
    dense = many > DENSE
    place = np.cumsum(dense) - 1
    c, o = place[column[dense[column]]], owner[dense[column]]
    for lo in range(0, int(dense.sum()), _COLUMNS):
        i, j = np.searchsorted(c, [lo, lo + _COLUMNS])
        block = np.zeros((m, min(_COLUMNS, int(dense.sum()) - lo)), np.float32)
        block[o[i:j], c[i:j] - lo] = 1
        out += (block @ block.T).astype(np.int64)
    return out


def _cell_links(node: np.ndarray, sets: list[np.ndarray], group: np.ndarray, asks: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Sets linked with others of other groups, where one of the two at least asks, and the least that each reaches."""
    size = np.array([len(x) for x in sets], np.int64)
    both = shared_counts(sets)
    linked = 100 * both >= percent * (size[:, None] + size[None, :] - both)
    i, j = np.nonzero(np.triu(linked & (group[:, None] != group[None, :]) & (asks[:, None] | asks[None, :]), 1))
    return rooted(node[i], node[j])


def _compared(rows: DataFrame, percent: int) -> DataFrame:
    """(cluster, a, b): in each cell of ``rows`` (cluster, cell, node, group, asks, elements) the sets a linked with others, and the least b that each reaches.

    A cell is held by one task.
    """
    names = ["cluster", "cell", "node", "group", "asks", "elements"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tk.release()
        held: list[tuple] = []

        def met() -> Iterator[pa.RecordBatch]:
            if len(held) > 1:
                node, group, asks = (np.array([x[k] for x in held]) for k in (2, 3, 4))
                a, b = _cell_links(node, [np.frombuffer(x[5], np.uint64) for x in held], group, asks, percent)
                if len(a):
                    yield pa.record_batch([pa.array(np.full(len(a), held[0][0])), pa.array(a), pa.array(b)], names=["cluster", "a", "b"])

        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in names)):
                if held and held[0][:2] != row[:2]:
                    yield from met()
                    held = []
                held.append(row)
        yield from met()

    dealt = rows.repartition("cluster", "cell").sortWithinPartitions("cluster", "cell")
    return dealt.select(*names).mapInArrow(run, "cluster long, a long, b long")


def _linked(members: DataFrame, percent: int) -> DataFrame:
    """(node, component) of those ``members`` (node, cluster, n, elements) that have links and aren't the least they reach."""
    size = members.groupBy("cluster").agg(F.count("*").alias("__sets"), F.sum("n").alias("__elements"))
    blocks = F.greatest(F.ceil(F.col("__sets") / BLOCK_SETS), F.ceil(F.col("__elements") / BLOCK_ELEMENTS))
    wide = cut(size.select("cluster", blocks.cast("int").alias("blocks")).where("blocks > 1"))
    side = F.broadcast(wide) if small_enough(wide, MAX_BROADCAST) else wide
    placed = members.join(side, "cluster", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # The representative, the least of its cluster, goes to every block.
    everywhere = F.when(F.col("node") == F.col("cluster"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block")).cast("array<bigint>")
    first = placed.select("cluster", "node", F.explode(everywhere).alias("cell"), F.col("node").alias("group"), F.lit(True).alias("asks"), "elements")
    stars = cut(_compared(first, percent))
    if wide.isEmpty():
        return stars.select(F.col("a").alias("node"), F.col("b").alias("component"))
    # Wide clusters of several groups: what is outside the largest group meets everything.
    links = stars.join(side, "cluster", "left_semi").select("a", "b")
    own = placed.where("blocks > 1").join(reached(links), "node", "left").withColumn("group", F.coalesce("component", "node"))
    own = cut(own.select("cluster", "node", "group", "n", "blocks", "block", "elements"))
    sizes = own.groupBy("cluster", "group").agg(F.count("*").alias("__in"))
    largest = sizes.groupBy("cluster").agg(F.max_by("group", F.struct("__in", "group")).alias("__largest"), F.count("*").alias("__groups")).where("__groups > 1")
    asking = own.join(F.broadcast(largest) if small_enough(largest, MAX_BROADCAST) else largest, "cluster").withColumn("asks", F.col("group") != F.col("__largest"))
    few = asking.where("asks").groupBy("cluster").agg(F.count("*").alias("__sets"), F.sum("n").alias("__elements"))
    few = cut(few.select("cluster", F.greatest(F.ceil(F.col("__sets") / BLOCK_SETS), F.ceil(F.col("__elements") / BLOCK_ELEMENTS)).cast("int").alias("rows")))
    asking = asking.join(F.broadcast(few) if small_enough(few, MAX_BROADCAST) else few, "cluster")
    row = F.pmod(F.xxhash64(F.lit(1), "node"), F.col("rows"))
    # Cell (row, block): asking sets of the row, and all of the block.
    as_row = F.when(F.col("asks"), F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: row * F.col("blocks") + b)).otherwise(F.array().cast("array<bigint>"))
    as_block = F.transform(F.sequence(F.lit(0), F.col("rows") - 1), lambda r: (r * F.col("blocks") + F.col("block")).cast("bigint"))
    cells = F.array_distinct(F.concat(as_row, as_block))
    met = asking.select("cluster", "node", F.explode(cells).alias("cell"), "group", "asks", "elements")
    joined = reached(links.unionByName(_compared(met, percent).select("a", "b")))
    rest = stars.join(side, "cluster", "left_anti").select(F.col("a").alias("node"), F.col("b").alias("component"))
    return rest.unionByName(joined)


def jaccard_groups(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; the component is the smallest id that its links reach."""
    signed = cut(_signed(docs, width, percent))
    rows, ids = signed.select("doc_id", "id1", "id2", "n"), ["id1", "id2"]
    known = signed.where("doc_id is not null and n > 0")
    copies = cut(known.groupBy(*ids).agg(F.min("doc_id").alias("node"), F.count("*").alias("__rows")).where("__rows > 1").select(*ids, "node"))
    copies = F.broadcast(copies) if small_enough(copies, MAX_BROADCAST) else copies
    groups = cut(_linked(cut(_sets(docs, _clusters(known, copies), width)), percent))
    named = rows.join(copies, ids, "left").withColumn("node", F.coalesce("node", "doc_id"))
    # A document of several texts links their sets.
    several = known.groupBy("doc_id").agg(F.min(F.struct(*ids)).alias("x"), F.max(F.struct(*ids)).alias("y")).where("x <> y").select("doc_id")
    if not several.isEmpty():
        ends = named.where("n > 0").join(several, "doc_id").select(F.col("doc_id").alias("a"), F.col("node").alias("b")).where("a <> b").distinct()
        groups = reached(ends.unionByName(groups.select(F.col("node").alias("a"), F.col("component").alias("b"))))
    out = named.join(F.broadcast(groups) if small_enough(groups, MAX_BROADCAST) else groups, "node", "left")
    component = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.coalesce("component", "node")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents"))


ORACLE_SQL = """
with recursive w as materialized (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as ws from documents),
s as materialized (select distinct doc_id, array_to_string(ws[i : i + 2], ' ') as g from (select *, unnest(range(1, greatest(len(ws) - 2, least(len(ws), 1)) + 1)) as i from w)),
n as materialized (select doc_id, count(*) as n from s group by doc_id),
pairs as materialized (select a.doc_id as a, b.doc_id as b, count(*) as shared from s as a join s as b on a.g = b.g and a.doc_id < b.doc_id group by all),
links as materialized (select a, b from pairs join n as x on x.doc_id = a join n as y on y.doc_id = b where 100 * shared >= 90 * (x.n + y.n - shared)),
edges as materialized (select a, b from links union all select b, a from links),
reach as (select distinct a as doc_id, a as r from edges union select reach.doc_id, edges.b from reach join edges on edges.a = reach.r)
select w.doc_id, coalesce(n.n, 0)::bigint as n_shingles, coalesce(m.c, w.doc_id)::bigint as component_id
from w left join n using (doc_id) left join (select doc_id, min(r) as c from reach group by doc_id) as m using (doc_id)
"""
