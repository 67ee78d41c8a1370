"""SimHash near-duplicates by multi-index hashing.

A fingerprint is one or more 64-bit words whose bits are the majority votes of the hashes of a text's word shingles.
Fingerprints are cut into segments. A table holds every distinct fingerprint under each of its segments' values; a
small Hamming ball is enumerated round each segment's value and the table entries under the ball's values are fetched,
and their complete distances verified. With radii r1..rm, every pair within sum(ri + 1) - 1 bits agrees within ri on
some segment, so no such pair is missed.

Fetching is a shuffle by (segment, value) and a sort. A task streams through its keys and keeps only links that join
two groups not yet joined within the batch at hand, so a group of thousands of close fingerprints yields as many links
as it has members, not their square. Keys with more than HOT_ROWS entries are split into blocks, every pair of blocks
being met once.

The pipeline's stage links texts whose fingerprints lie within NEAR_BITS by the same multi-index hashing, and keeps a link
only if the two shingle sets have a Jaccard similarity of SIMILAR or more. Fingerprints of pairs just above SIMILAR
differ in more bits than any index of balls can reach, so pairs not yet of one group go on to bands of minima of the shingle
hashes and two sketches, and to the same exact comparison. The sketches only leave out pairs that lie five
deviations and more below that. Crowds of texts under one band are compared by their sets in the task that holds them, and
only links that make a forest leave it; the comparisons by sketches still grow with the square of a crowd.

Defined cases: a null or empty text has the fingerprint zero, linked like any other; fewer words than a shingle make
one shingle of the whole sequence; equal fingerprints are one node, whatever number of rows has them; a row with a
null ``doc_id`` links others by its fingerprint but never names a component (whose id is null if all its rows' are); of
rows that share an id and differ, a near copy of any joins the id; an empty table gives an empty result; other columns are ignored or carried along.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ratelake.llm import textkernel as tk
from ratelake.llm.common import cut, small_enough, table
from ratelake.llm.components import connected_components, reached
from ratelake.llm.textkernel import mix

#: Table entries under one key that one task compares with each other and with their probes (some 22 times as many).
HOT_ROWS = 1 << 13
#: Hot keys (16 bytes each) that are broadcast; more are joined by a shuffle.
MAX_BROADCAST = 1 << 18
#: Fingerprint pairs compared at once.
BLOCK_PAIRS = 1 << 21
#: Rows and bytes that a task holds before it compares them; more only if one key has more.
BATCH_ROWS = 1 << 17
BATCH_BYTES = 1 << 25

#: Segments of a 64-bit fingerprint, the radii of the balls round their values, and the bits within which they link.
SEGMENTS, RADII, NEAR_BITS = (21, 21, 22), (1, 1, 0), 4
#: Jaccard similarity of shingle sets from which two texts are near copies.
SIMILAR = 0.8
#: Minima by set, and how many make a band: at 0.8 a pair shares none of the 25 bands with probability 5e-5.
MINIMA, BAND_ROWS = 128, 5
#: Sketch bits in which a candidate pair may differ: 12.8 on average at 0.8, with a deviation of 3.4, so 5 of them above.
SKETCH_BITS = 30
#: Bits of an odd sketch at most; enough to tell 0.8 from 0.7 up to some 20,000 words.
ODD_BITS = 4096
#: Rows under one band that one task compares with each other.
CROWD_ROWS = 1 << 10
#: Rows signed at once, and ids of texts (8 bytes each) that are broadcast to fetch them.
_SIGNED_ROWS, MAX_NODES = 2048, 1 << 20
#: Places apart under a band at which the first round looks for pairs.
REACH = 4
_RANDOM = np.random.default_rng(5)
_FACTORS = _RANDOM.integers(0, 1 << 63, MINIMA, np.uint64) * np.uint64(2) + np.uint64(1)
_TERMS = _RANDOM.integers(0, 1 << 63, MINIMA, np.uint64)


def shingle_hashes(text: str | None, width: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each shingle of ``width`` lower-cased (A-Z) words, joined by spaces; repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n, digest = max(1, len(words) - width + 1), xxhash.xxh64_intdigest
    last = ends[min(width, len(words)) - 1 :]
    return np.array([digest(joined[i:j], seed) for i, j in zip(starts[:n].tolist(), last.tolist())], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The word whose bit is 1 where over half the hashes have it set."""
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096]
        votes += np.unpackbits(part.astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _remixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """Independent bits for a further fingerprint word."""
    if not k:
        return hashes
    x = hashes * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xD1B54A32D192ED03 * k % 2**64)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def fingerprints(docs: DataFrame, width: int = 4, words: int = 1) -> DataFrame:
    """(doc_id, fp): the fingerprint as an array of ``words`` signed 64-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((batch.num_rows, words), np.uint64)
            for i, text in enumerate(batch.column(1)):
                hashes = shingle_hashes(text.as_py(), width)
                for k in range(words if len(hashes) else 0):
                    out[i, k] = majority(_remixed(hashes, k))
            flat = pa.array(out.view(np.int64).ravel())
            yield pa.record_batch([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, words, dtype=np.int32)), flat)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp array<long>")


def ball(bits: int, radius: int) -> list[int]:
    """Masks of all changes of 1 to ``radius`` of ``bits`` bits."""
    return [sum(1 << b for b in chosen) for r in range(1, radius + 1) for chosen in combinations(range(bits), r)]


def _spanning(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the links (a, b) make a spanning forest, in order."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, parent = ends[: len(a)].tolist(), ends[len(a) :].tolist(), list(range(len(nodes)))
    keep = np.zeros(len(a), bool)
    for i, (p, q) in enumerate(zip(x, y)):
        while parent[p] != p:
            parent[p] = p = parent[parent[p]]
        while parent[q] != q:
            parent[q] = q = parent[parent[q]]
        if p != q:
            parent[max(p, q)] = min(p, q)
            keep[i] = True
    return keep


def _close(key: np.ndarray, entry: np.ndarray, node: np.ndarray, fp: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within ``most`` bits between rows of one key of which one at least is a table entry; a spanning forest.

    Rows come sorted by key, table entries first.
    """
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.concatenate([first, [len(key)]]))
    entries = np.add.reduceat(entry.astype(np.int64), first)
    # A table entry meets all rows after it in its group.
    group = np.repeat(np.arange(len(first)), size)
    left = np.flatnonzero(entry & (entries[group] > 0))
    partners = (first + size)[group[left]] - left - 1
    left, partners = left[partners > 0], partners[partners > 0]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    at, run = 0, np.cumsum(partners)
    while at < len(left):
        base = run[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(run, base + BLOCK_PAIRS, "right")))
        n = partners[at:to]
        a = np.repeat(left[at:to], n)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
        near = np.bitwise_count(fp[a] ^ fp[b]).sum(axis=1) <= most
        a, b = node[a[near]], node[b[near]]
        if len(a):
            one = _spanning(a, b)
            found.append((a[one], b[one]))
        at = to
    if not found:
        return node[:0], node[:0]
    a, b = (np.concatenate(x) for x in zip(*found))
    one = _spanning(a, b)
    return a[one], b[one]


def hamming_links(nodes: DataFrame, segments: Sequence[int], radii: Sequence[int], most: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of ``nodes`` (node, fp) within ``most`` bits.

    ``segments`` are widths in bits, from the lowest bit of the first word up; none crosses a word's end. All pairs
    within sum(radius + 1) - 1 bits are met, and of farther ones those that agree on some segment within its radius.
    """
    keys, entries, at = [], [], 0
    for s, (bits, radius) in enumerate(zip(segments, radii, strict=True)):
        value = F.shiftrightunsigned(F.get("fp", F.lit(at // 64)), at % 64).bitwiseAND(F.lit((1 << bits) - 1)).bitwiseOR(F.lit(s << 48))
        masks = ball(bits, radius)
        entries.append(value)
        keys += [F.array(*[value.bitwiseXOR(F.lit(m)) for m in masks])] if masks else []
        at += bits
    entry = nodes.select("node", "fp", F.explode(F.array(*entries)).alias("key"), F.lit(True).alias("entry"))
    probe = nodes.select("node", "fp", F.explode(F.concat(*keys) if keys else F.array().cast("array<bigint>")).alias("key"), F.lit(False).alias("entry"))
    rows = entry.unionByName(probe)
    hot = entry.groupBy("key").count().where(F.col("count") > hot_rows)
    hot_keys = cut(hot.select("key", F.ceil(F.col("count") / hot_rows).cast("int").alias("blocks")))
    if hot_keys.isEmpty():
        rows = rows.withColumn("cell", F.lit(0))
    else:  # a row goes to the cells (own block, any block), each pair of blocks being one cell
        side = F.broadcast(hot_keys) if small_enough(hot_keys, MAX_BROADCAST) else hot_keys
        rows = rows.join(side, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        own = F.pmod(F.xxhash64("node"), F.col("blocks"))
        cells = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: (F.least(own, k) * F.col("blocks") + F.greatest(own, k)).cast("int"))
        rows = rows.withColumn("cell", F.explode(cells))
    words = -(-sum(segments) // 64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def compare(t: pa.Table) -> Iterator[pa.RecordBatch]:
            key = t["key"].to_numpy() ^ (t["cell"].to_numpy().astype(np.int64) << 52)
            fp = t["fp"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, words)
            a, b = _close(key, t["entry"].to_numpy(zero_copy_only=False), t["node"].to_numpy(), fp, most)
            yield pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])

        n = 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n < BATCH_ROWS:
                continue
            t = pa.Table.from_batches(held)
            key, cell = t["key"].to_numpy(), t["cell"].to_numpy()
            whole = int(np.flatnonzero((key != key[-1]) | (cell != cell[-1]))[-1]) + 1 if (key[0] != key[-1] or cell[0] != cell[-1]) else 0
            if whole:
                yield from compare(t.slice(0, whole))
            held, n = t.slice(whole).to_batches(), len(t) - whole
        if n:
            yield from compare(pa.Table.from_batches(held))

    dealt = rows.repartition("key", "cell").sortWithinPartitions("key", "cell", F.col("entry").desc())
    return dealt.select("node", "fp", "key", "cell", "entry").mapInArrow(run, "a long, b long")


def near_groups(fps: DataFrame, segments: Sequence[int], radii: Sequence[int], most: int) -> DataFrame:
    """(fp, component_id) for each distinct fingerprint of one word: the smallest doc_id that it can reach by links."""
    # Fingerprints are nodes themselves, so those that only rows without an id have link others too.
    classes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least")).withColumn("node", F.get("fp", F.lit(0))))
    groups = connected_components(hamming_links(classes, segments, radii, most))
    joined = classes.join(groups, "node", "left").select("fp", "least", F.coalesce("component", "node").alias("component"))
    least = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    return joined.join(least, "component").select("fp", "component_id")


def op6_groups(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id; 4-word shingles, links at 4 bits."""
    fps = cut(fingerprints(docs, width=4, words=1))
    groups = near_groups(fps, SEGMENTS, RADII, NEAR_BITS)
    text: Column = F.lower(F.lpad(F.hex(F.get("fp", F.lit(0))), 16, "0"))
    return fps.join(groups, "fp").select("doc_id", text.alias("fingerprint"), "component_id")


def odd_sketch(hashes: np.ndarray) -> np.ndarray:
    """The parities of how many of the distinct ``hashes`` fall to each bit; 2 to 4 bits for each hash, 64 to ODD_BITS.

    Two sets' sketches differ in few bits more or less than the sets differ by elements, up to about ODD_BITS.
    """
    bits = min(ODD_BITS, max(64, 1 << int(2 * len(hashes) - 1).bit_length())) if len(hashes) else 64
    odd = np.bincount((tk.mix(hashes) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8))


def folded(sketches: np.ndarray, size: int) -> np.ndarray:
    """The sketches (rows of bytes) that ``size`` bytes would have given."""
    while sketches.shape[1] > size:
        half = sketches.shape[1] // 2
        sketches = sketches[:, :half] ^ sketches[:, half:]
    return sketches


def may_be_similar(elements: np.ndarray, size: int, differ: np.ndarray) -> np.ndarray:
    """Whether pairs of sets may have similarity SIMILAR: their elements together, bytes of a sketch, bits that differ.

    Six deviations of margin, so that a pair at SIMILAR is left out once in a thousand million times.
    """
    bits, apart = 8.0 * size, elements * (1 - SIMILAR) / (1 + SIMILAR)
    one, two = (1 - 2 / bits) ** apart, (1 - 4 / bits) ** apart
    spread = np.maximum(bits + bits * (bits - 1) * two - bits * bits * one * one, 0.0) / 4
    return differ <= bits / 2 * (1 - one) + 6 * np.sqrt(spread) + 2


class OddSketches:
    """Odd sketches of rows, compared in pairs at the size of the smaller one."""

    def __init__(self, n: np.ndarray, sketches: Sequence[bytes]) -> None:
        self.n, self.bytes = n, np.array([len(x) for x in sketches], np.int64)
        self.sketches, self.at = sketches, {}

    def _matrix(self, size: int) -> np.ndarray:
        """All sketches of ``size`` bytes and more, at ``size``."""
        if size not in self.at:
            out = np.zeros((len(self.n), size), np.uint8)
            for own in np.unique(self.bytes[self.bytes >= size]).tolist():
                rows = np.flatnonzero(self.bytes == own)
                whole = np.frombuffer(b"".join([self.sketches[r] for r in rows.tolist()]), np.uint8).reshape(-1, own)
                out[rows] = folded(whole, size)
            self.at[size] = out.view(np.uint64)
        return self.at[size]

    def near(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which of the pairs of rows may be similar."""
        out, sizes = np.zeros(len(i), bool), np.minimum(self.bytes[i], self.bytes[j])
        for size in np.unique(sizes).tolist():
            rows, matrix = np.flatnonzero(sizes == size), self._matrix(size)
            for lo in range(0, len(rows), max(1, (1 << 22) // size)):
                own = rows[lo : lo + max(1, (1 << 22) // size)]
                differ = np.bitwise_count(matrix[i[own]] ^ matrix[j[own]]).sum(axis=1, dtype=np.int64)
                out[own] = may_be_similar((self.n[i[own]] + self.n[j[own]]).astype(np.float64), size, differ)
        return out


def signatures(docs: DataFrame, width: int = 5, with_sets: bool = False) -> DataFrame:
    """(doc_id, id, n, fp, sketch, odd, bands) of each document's set of shingles.

    ``id`` is a 128-bit hash of the set, ``n`` its size and ``fp`` its fingerprint (each shingle has one vote). ``sketch`` has a bit of each of 128 minima under different
    hashes; two differ in (1 - J) / 2 of the bits on average. ``odd`` is the finer ``odd_sketch``. A band hashes
    BAND_ROWS of the minima. A text without a word has no band. With ``sets`` come the shingles' hashes themselves, cut to
    32 bits and sorted.
    """
    n_bands = MINIMA // BAND_ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tk.release()
        for whole in batches:
            for start in range(0, whole.num_rows, _SIGNED_ROWS):
                yield signed(whole.slice(start, _SIGNED_ROWS))

    def signed(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = batch.num_rows
        ids, n, fp, least, odd = np.zeros((rows, 2), np.uint64), np.zeros(rows, np.int64), np.zeros(rows, np.uint64), np.full((rows, MINIMA), 2**64 - 1, np.uint64), []
        sets: list[bytes] = []
        for i, text in enumerate(batch.column(1)):
            hashes = np.unique(shingle_hashes(text.as_py(), width))
            ids[i], n[i] = np.frombuffer(xxhash.xxh128_digest(hashes.tobytes()), np.uint64), len(hashes)
            fp[i] = majority(hashes) if len(hashes) else 0
            odd.append(odd_sketch(hashes).tobytes())
            if with_sets:
                sets.append(np.unique((hashes >> np.uint64(32)).astype("<u4")).tobytes())
            for at in range(0, len(hashes), 1024):
                np.minimum(least[i], (hashes[at : at + 1024, None] * _FACTORS + _TERMS).min(axis=0), out=least[i])
        sketch = np.packbits((least >> np.uint64(31)).astype(np.uint8) & 1, axis=1).view(np.int64)
        bands = mix((mix(least[:, : n_bands * BAND_ROWS]).reshape(rows, n_bands, BAND_ROWS) * _FACTORS[:BAND_ROWS]).sum(axis=2) + np.arange(n_bands, dtype=np.uint64))
        ends = np.concatenate([[0], np.cumsum(np.where(n > 0, n_bands, 0))]).astype(np.int32)
        pair = pa.array(np.arange(0, 2 * rows + 1, 2, dtype=np.int32))
        lists = [pa.ListArray.from_arrays(pair, pa.array(x.view(np.int64).ravel())) for x in (ids, sketch)]
        columns = [batch.column(0), lists[0], pa.array(n), pa.array(fp.view(np.int64)), lists[1], pa.array(odd, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(bands[n > 0].view(np.int64).ravel()))]
        more = [pa.array(sets, pa.binary())] if with_sets else []
        return pa.record_batch([*columns, *more], names=["doc_id", "id", "n", "fp", "sketch", "odd", "bands", *(["sets"] if with_sets else [])])

    kinds = "doc_id long, id array<long>, n long, fp long, sketch array<long>, odd binary, bands array<long>" + (", sets binary" if with_sets else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, kinds)


def _candidates(key: np.ndarray, comp: np.ndarray, n: np.ndarray, sketch: np.ndarray, lo: int, hi: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one key, lo to hi - 1 places apart, of different components, that may have similarity SIMILAR.

    Rows come sorted by key. With lo = 1 each row of a larger key is also paired with the one nearest to the key's
    majority sketch, from which near copies of one text differ least.
    """
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.concatenate([first, [len(key)]]))

    def test(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        differ = comp[i] != comp[j]
        i, j = i[differ], j[differ]
        fit = (np.minimum(n[i], n[j]) >= SIMILAR * np.maximum(n[i], n[j]) - 1e-9) & (np.bitwise_count(sketch[i] ^ sketch[j]).sum(axis=1) <= SKETCH_BITS)
        return i[fit], j[fit]

    if lo == 1:
        for at, many in zip(first[size > hi].tolist(), size[size > hi].tolist()):
            own = sketch[at : at + many]
            votes = np.unpackbits(own.view(np.uint8), axis=1).sum(axis=0, dtype=np.int64)
            middle = np.packbits(votes * 2 > many).view(np.uint64)
            centre = at + int(np.bitwise_count(own ^ middle).sum(axis=1).argmin())
            yield test(np.full(many, centre), np.arange(at, at + many))
    left = np.flatnonzero(np.repeat(size, size) > lo)
    last = np.repeat(first + size, size)
    for d in range(lo, hi):
        left = left[left + d < last[left]]
        if not len(left):
            break
        yield test(left, left + d)


def _forest(pairs: Iterator[tuple[np.ndarray, np.ndarray]], comp: np.ndarray, odd: OddSketches, sets: Sequence[np.ndarray]) -> tuple[list[int], list[int]]:
    """Of the pairs whose sets are similar, those that join two groups not yet joined."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    left, right = [], []
    for i, j in pairs:
        close = odd.near(i, j) if len(i) else np.zeros(0, bool)
        for a, b in zip(i[close].tolist(), j[close].tolist()):
            x, y = root(int(comp[a])), root(int(comp[b]))
            if x == y:
                continue
            both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
            if both >= SIMILAR * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                parent[max(x, y)] = min(x, y)
                left.append(a)
                right.append(b)
    return left, right


def _met(rows: DataFrame, lo: int, hi: int) -> DataFrame:
    """(a, b): the candidates of ``rows`` (key, cell, node, component, n, sketch) that are lo to hi - 1 places apart in their cells.

    If the rows have their ``sets`` (and ``odd``), similarity is computed, and a task gives only links that join two groups not yet
    joined within the batch at hand: a crowd of similar texts gives a forest, one of texts that are not similar nothing.
    """
    exact = "sets" in rows.columns
    names = ["key", "cell", "node", "component", "n", "sketch", *(["odd", "sets"] if exact else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tk.release()

        def compare(t: pa.Table) -> Iterator[pa.RecordBatch]:
            key, cell, node, comp, n = (t[k].to_numpy().astype(np.int64) for k in ("key", "cell", "node", "component", "n"))
            sketch = t["sketch"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, 2)
            pairs = _candidates(mix(key.view(np.uint64) + mix(cell.view(np.uint64))), comp, n, sketch, lo, hi)
            if exact:
                odd = OddSketches(n, [x.as_buffer().to_pybytes() for x in t["odd"]])
                pairs = iter([_forest(pairs, comp, odd, [np.frombuffer(x.as_buffer(), "<u4") for x in t["sets"]])])
            for i, j in pairs:
                if len(i):
                    a, b = node[i], node[j]
                    yield pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count < BATCH_ROWS and sum(x.nbytes for x in held) < BATCH_BYTES:
                continue
            t = pa.Table.from_batches(held)
            key, cell = t["key"].to_numpy(), t["cell"].to_numpy()
            other = np.flatnonzero((key != key[-1]) | (cell != cell[-1]))
            whole = int(other[-1]) + 1 if len(other) else 0
            if whole:
                yield from compare(t.slice(0, whole))
            held, count = t.slice(whole).to_batches(), len(t) - whole
        if count:
            yield from compare(pa.Table.from_batches(held))

    dealt = rows.repartition("key", "cell").sortWithinPartitions("key", "cell", "n", "node")
    return dealt.select(*names).mapInArrow(run, "a long, b long").distinct()


def likely(pairs: DataFrame, named: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) that may be similar by the odd sketches in ``named`` (node, n, odd)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.concatenate([batch.column(k).to_numpy() for k in ("n", "n2")])
            odd = OddSketches(n, batch.column("odd").to_pylist() + batch.column("odd2").to_pylist())
            at = np.arange(batch.num_rows)
            yield batch.select(["a", "b"]).filter(pa.array(odd.near(at, at + batch.num_rows)))

    left = named.select(F.col("node").alias("a"), "n", "odd")
    right = named.select(F.col("node").alias("b"), F.col("n").alias("n2"), F.col("odd").alias("odd2"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "n", "n2", "odd", "odd2").mapInArrow(run, "a long, b long")


def _picked(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """The different ``texts`` (node, text) of some nodes; named by few enough ids, they are picked where they are read."""
    nodes = cut(nodes)
    side = F.broadcast(nodes) if small_enough(nodes, MAX_NODES) else nodes
    return texts.join(side, "node", "left_semi").groupBy("node", F.xxhash64("text").alias("__tag")).agg(F.first("text").alias("text"))


def similar(pairs: DataFrame, texts: DataFrame, width: int = 5) -> DataFrame:
    """Those of ``pairs`` (a, b) whose ``texts`` (node, text) have sets of shingles of Jaccard similarity SIMILAR or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}

        def of(node: int, text: pa.Scalar) -> np.ndarray:
            if node not in held:
                if len(held) >= 64:
                    del held[next(iter(held))]
                held[node] = np.unique(shingle_hashes(text.as_py(), width))
            return held[node]

        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            for i, (a, b) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                x, y = of(a, batch.column(2)[i]), of(b, batch.column(3)[i])
                both = len(np.intersect1d(x, y, assume_unique=True))
                good[i] = both >= SIMILAR * (len(x) + len(y) - both) - 1e-9
            yield batch.select([0, 1]).filter(pa.array(good))

    own = cut(_picked(texts, pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()))
    full = pairs.join(own.select(F.col("node").alias("a"), F.col("text").alias("left")), "a").join(own.select(F.col("node").alias("b"), F.col("text").alias("right")), "b")
    return full.select("a", "b", "left", "right").mapInArrow(run, "a long, b long")


def fingerprint_links(named: DataFrame) -> DataFrame:
    """Links (a, b) whose components are those of all ``named`` (node, n, fp) with fingerprints within NEAR_BITS.

    Nodes of one fingerprint are linked to the least of them, which stands for it in the index.
    """
    full = named.where("n > 0").select("node", "fp")
    classes = cut(full.groupBy("fp").agg(F.min("node").alias("least")))
    equal = full.join(classes, "fp").where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    nodes = classes.select(F.col("least").alias("node"), F.array("fp").alias("fp"))
    return equal.unionByName(hamming_links(nodes, SEGMENTS, RADII, NEAR_BITS)).distinct()


def similar_groups(docs: DataFrame, width: int = 5, hot_rows: int = CROWD_ROWS) -> DataFrame:
    """(doc_id, component_id) of rows with an id: the smallest id reached by pairs of similarity SIMILAR or more.

    Equal sets of shingles are one node. Links of fingerprints are verified by the texts first; then nodes that share a
    band are candidates, unless they are of one group by then. Each round verifies by their texts the candidates some
    places apart under a band. Keys with two components or more go on, at a longer reach, until every
    candidate pair has been tested or is of one component.
    """
    signed = cut(signatures(docs.where("doc_id is not null"), width))
    named = cut(signed.groupBy("id").agg(F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("sketch").alias("sketch"), F.first("odd").alias("odd"), F.first("bands").alias("bands")))
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), "text")
    links = cut(similar(cut(fingerprint_links(named)), texts, width))
    groups, crowd = cut(reached(links)), None
    banded = named.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    rows = banded.select(F.explode("bands").alias("key"), "node", "component", "n", "sketch")
    lo, reach = 1, REACH
    while True:
        counts = rows.groupBy("key").agg(F.count("*").alias("count"), F.min("component").alias("x"), F.max("component").alias("y"))
        live = counts.where((F.col("count") > lo) & (F.col("x") < F.col("y"))).select("key", F.ceil(F.col("count") / hot_rows).cast("int").alias("blocks"))
        rows = cut(rows.join(live, "key").select("key", "node", "component", "n", "sketch", "blocks"))
        if rows.isEmpty():
            break
        # A row of a hot key goes to the cells (own block, any block), each pair of blocks being one cell.
        own = F.pmod(F.xxhash64("node"), F.col("blocks"))
        cells = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: (F.least(own, k) * F.col("blocks") + F.greatest(own, k)).cast("int"))
        dealt = rows.withColumn("cell", F.explode(cells))
        if lo == 1:  # a few pairs for each row
            pairs = cut(likely(_met(dealt, lo, lo + reach), named))
        else:  # crowds; their texts' sets are few beside all rows
            if crowd is None:
                own = _picked(texts, rows.select("node").distinct()).withColumnRenamed("node", "doc_id")
                full = signatures(own, width, with_sets=True).groupBy(F.col("doc_id").alias("node"), "sketch").agg(F.first("odd").alias("odd"), F.first("sets").alias("sets"))
                crowd = cut(full)
            pairs = cut(_met(dealt.join(crowd, ["node", "sketch"]), lo, lo + reach))
        found = None if pairs.isEmpty() else cut(similar(pairs, texts, width))
        rows = rows.drop("blocks")
        if found is not None and not found.isEmpty():
            links = cut(links.unionByName(found))
            groups = cut(reached(links))
            rows = rows.drop("component").join(groups, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"), "n", "sketch")
        lo, reach = lo + reach, 8 * reach
    classes = named.select("id", "node").join(groups, "node", "left").select("id", F.coalesce("component", "node").alias("component_id"))
    return signed.select("doc_id", "id").join(classes, "id").select("doc_id", "component_id")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """Keeps of each group of near copies the document with the smallest id; all columns stay.

    Groups are joined by pairs whose sets of five-word shingles have a Jaccard similarity of SIMILAR or more, by
    their texts. Rows with a null id stay; rows that share an id are one document.
    """
    copies = similar_groups(docs).where("doc_id <> component_id").select(F.col("doc_id").alias("__copy")).distinct()
    return docs.join(copies, docs["doc_id"] == copies["__copy"], "left_anti")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_groups(table(spark, sf_dir, "documents"))
