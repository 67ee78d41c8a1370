"""Substring dedup: words covered by a window that also starts in an earlier document go.

A window is WINDOW consecutive words. Every window has an anchor: the least hash among the shorter word n-grams inside
it. Equal windows have equal anchors, so a window occurs at most as often as its anchor, and consecutive windows mostly
share one, so there are about 13 times fewer anchors than windows. Each task counts its anchors in a sparse count-min
sketch (two rows of cells); the merged sketch overestimates how often an anchor, and so a window, occurs. Its size follows
the input: eight cells for each anchor expected. Up to MAX_CELLS, cells counted twice or more make two bit maps which
are broadcast; a larger sketch stays dealt by cells to the tasks, and anchors are looked up by a shuffle. In a second pass
only windows whose anchor is estimated repeated are grouped exactly, by 64-bit hash: the least doc_id of each
(pre-aggregated), and a join back whose hot keys Spark splits. No repeated window is ever lost; a false estimate only
costs a grouped row.

Two different windows share a 64-bit hash once in about n * n / 4e19 for n grouped windows.

Defined cases: null and empty texts have no words; a row with a null ``doc_id`` neither loses words nor makes others
lose any; rows with equal ids are one document, so they don't make each other lose words; shorter texts than a window
stay whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratelake.llm import textkernel as tk
from ratelake.llm.common import cut, small_enough, table

WINDOW = 50
#: Cells in a row of the sketch: 2**28 bits are 32 MB of broadcast, twice.
MIN_CELLS, MAX_CELLS = 1 << 20, 1 << 28
_BLOCK = 1 << 20
#: Documents with repeats (16 bytes each) that are broadcast, so that the others are not shuffled; with more, all texts are.
MAX_IDS = 1 << 20


def _least(x: np.ndarray, n: int) -> np.ndarray:
    """Least of each run of n values."""
    width, out = 1, x
    while width * 2 <= n:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    return out if width == n else np.minimum(out[: len(x) - n + 1], out[n - width :])


def windows(c: tk.Chunk, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every window of a chunk: its text, first word (counted from its text's), hash and anchor."""
    start, end, first = c.words()
    n = len(start)
    if n < size:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    words = tk.span_hashes(c.prefix(), start, end, tk.POWERS)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(words * tk.WORD_POWERS.get(n)[0][:n], out=prefix[1:])
    at = np.arange(n - size + 1)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    inside = text[at] == text[at + size - 1]
    gram = max(1, size // 2)
    places = np.arange(n - gram + 1)
    grams = tk.span_hashes(prefix, places, places + gram, tk.WORD_POWERS)
    at, anchor = at[inside], _least(grams, size - gram + 1)[inside]
    return text[at], at - first[text[at]], tk.span_hashes(prefix, at, at + size, tk.WORD_POWERS), anchor


def _cells(anchor: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """A cell in each row of the sketch."""
    low = np.uint64(cells - 1)
    return (anchor & low).astype(np.int64), (tk.mix(anchor ^ np.uint64(0x5851F42D4C957F2D)) & low).astype(np.int64)


def sketch(docs: DataFrame, size: int, cells: int) -> list[np.ndarray]:
    """Two bit maps of ``cells`` bits: the cells in which anchors are counted twice or more."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def merged(held: list[np.ndarray]) -> pa.RecordBatch:
            seen, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.record_batch([pa.array(seen), pa.array(n)], names=["cell", "n"])

        held: list[np.ndarray] = []
        for batch in batches:
            for c in tk.chunks(batch.column(0)):
                text, _, _, anchor = windows(c, size)
                if not len(anchor):
                    continue
                new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])])
                one, two = _cells(anchor[new], cells)
                held += [one, two + cells]
                if sum(map(len, held)) > 1 << 21:
                    yield merged(held)
                    held = []
        if held:
            yield merged(held)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Cells come sorted, so a block is complete when the next one begins."""
        block, bits = None, np.zeros(_BLOCK, bool)
        for batch in batches:
            cell = batch.column(0).to_numpy()
            for b in np.unique(cell // _BLOCK).tolist():
                if b != block:
                    if block is not None:
                        yield pa.record_batch([pa.array([block]), pa.array([np.packbits(bits).tobytes()])], names=["block", "bits"])
                    block, bits = b, np.zeros(_BLOCK, bool)
                bits[cell[cell // _BLOCK == b] % _BLOCK] = True
        if block is not None:
            yield pa.record_batch([pa.array([block]), pa.array([np.packbits(bits).tobytes()])], names=["block", "bits"])

    counts = docs.select("text").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    blocks = F.floor(F.col("cell") / _BLOCK)
    repeated = counts.where("n >= 2").select("cell").repartition(blocks).sortWithinPartitions("cell")
    maps = np.zeros(2 * cells // 8, np.uint8)
    for block, bits in repeated.mapInArrow(pack, "block long, bits binary").collect():  # 2 * cells bits at most
        maps[block * _BLOCK // 8 : (block + 1) * _BLOCK // 8] = np.frombuffer(bits, np.uint8)
    return [maps[: cells // 8], maps[cells // 8 :]]


def _marked(bits: np.ndarray, cell: np.ndarray) -> np.ndarray:
    return (bits[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8) & 1).astype(bool)


def _keyed(docs: DataFrame) -> DataFrame:
    tag = F.xxhash64(F.coalesce("text", F.lit(""))).bitwiseAND(F.lit(0xFFFFFFFF))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", tag.alias("tag"))


def _runs(docs: DataFrame, size: int, cells: int) -> DataFrame:
    """(one, two, doc_id, tag, place, n): runs of windows that share an anchor, with its cells in the sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tags = batch.column("doc_id").to_numpy(), batch.column("tag").to_numpy()
            for c in tk.chunks(batch.column("text")):
                text, place, _, anchor = windows(c, size)
                if len(anchor):
                    first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])]))
                    row = text[first] + c.lo
                    columns = [*_cells(anchor[first], cells), ids[row], tags[row], place[first], np.diff(np.concatenate([first, [len(anchor)]]))]
                    yield pa.record_batch([pa.array(x) for x in columns], names=["one", "two", "doc_id", "tag", "place", "n"])

    return _keyed(docs).where("doc_id is not null").mapInArrow(run, "one long, two long, doc_id long, tag long, place long, n long")


def _shuffled_candidates(docs: DataFrame, size: int, cells: int) -> DataFrame:
    """What ``_mapped_candidates`` gives, from a sketch whose cells are dealt to tasks, of any number."""
    runs = _runs(docs, size, cells)
    for row in ("one", "two"):
        # Keyed by the complement, so that the counts are dealt anew and Spark can split a hot cell's runs in the join.
        repeated = runs.groupBy(row).agg(F.count("*").alias("n")).where("n >= 2").select(F.bitwise_not(row).alias("key"))
        runs = runs.withColumn("key", F.bitwise_not(row)).join(repeated, "key", "left_semi").drop("key")
    by_doc = runs.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("place", "n")).alias("runs"))

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tags, own = batch.column("doc_id").to_numpy(), batch.column("tag").to_numpy(), batch.column("runs")
            for c in tk.chunks(batch.column("text")):
                text, place, hashes, _ = windows(c, size)
                first, chosen = np.searchsorted(text, np.arange(c.hi - c.lo + 1)), np.zeros(len(text) + 1, np.int64)
                for i in range(c.hi - c.lo):
                    parts = own[c.lo + i].values
                    at = parts.field("place").to_numpy() + first[i]
                    np.add.at(chosen, at, 1)
                    np.add.at(chosen, at + parts.field("n").to_numpy(), -1)
                hit = np.flatnonzero(np.cumsum(chosen)[:-1] > 0)
                row = text[hit] + c.lo
                yield pa.record_batch([pa.array(hashes[hit].view(np.int64)), pa.array(ids[row]), pa.array(place[hit] << 32 | tags[row])], names=["hash", "doc_id", "at"])

    # Rows of equal id and text have one list of runs, which serves them all.
    joined = _keyed(docs).join(by_doc.withColumn("runs", F.array_distinct("runs")), ["doc_id", "tag"]).select("doc_id", "tag", "text", "runs")
    return joined.mapInArrow(candidates, "hash long, doc_id long, at long")


def _mapped_candidates(docs: DataFrame, size: int, cells: int) -> DataFrame:
    """(hash, doc_id, at): windows whose anchor is estimated repeated, by the broadcast bit maps of the sketch."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch(docs, size, cells))

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = shared.value
        for batch in batches:
            ids, tags = batch.column("doc_id").to_numpy(), batch.column("tag").to_numpy()
            for c in tk.chunks(batch.column("text")):
                text, place, hashes, anchor = windows(c, size)
                a, b = _cells(anchor, cells)
                hit = np.flatnonzero(_marked(one, a) & _marked(two, b))
                row = text[hit] + c.lo
                yield pa.record_batch([pa.array(hashes[hit].view(np.int64)), pa.array(ids[row]), pa.array(place[hit] << 32 | tags[row])], names=["hash", "doc_id", "at"])

    return _keyed(docs).where("doc_id is not null").mapInArrow(candidates, "hash long, doc_id long, at long")


def repeated_windows(docs: DataFrame, size: int = WINDOW, max_cells: int = MAX_CELLS) -> DataFrame:
    """(doc_id, tag, places): first words of the windows that also start in a document with a smaller id."""
    bytes_ = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cells = MIN_CELLS
    while cells < 8 * (bytes_ / 6 * 2 / (size - size // 2 + 2)):
        cells *= 2
    found = (_mapped_candidates if cells <= max_cells else _shuffled_candidates)(docs, size, cells)
    least = found.groupBy("hash").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
    # Keyed by the complement, so that ``least`` is dealt anew and Spark can split a hot window's rows in the join.
    later = found.withColumn("key", F.bitwise_not("hash")).join(least.select(F.bitwise_not("hash").alias("key"), "least"), "key").where("doc_id > least")
    tag, place = F.col("at").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftright("at", 32).cast("int")
    return later.select("doc_id", tag.alias("tag"), place.alias("place")).groupBy("doc_id", "tag").agg(F.collect_list("place").alias("places"))


def without_repeats(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): each document's words that stay, joined by single spaces."""
    repeats = repeated_windows(docs, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, gone, kept = [], [], []
            for text, places in zip(batch.column("text"), batch.column("places")):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                total.append(len(words))
                if places.is_valid:
                    steps = np.zeros(len(words) + 1, np.int64)
                    at = places.values.to_numpy()
                    np.add.at(steps, at, 1)
                    np.add.at(steps, at + size, -1)
                    stays = np.cumsum(steps)[:-1] == 0
                    words = [w for w, s in zip(words, stays.tolist()) if s]
                gone.append(total[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.record_batch([batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    keys, keyed = ["doc_id", "tag"], _keyed(docs)
    repeats = cut(repeats)
    ids = repeats.select(*keys)
    if small_enough(ids, MAX_IDS):  # only texts that lose something are shuffled
        ids = F.broadcast(ids)
        some = keyed.join(ids, keys, "left_semi").join(repeats, keys).select("doc_id", "text", "places")
        joined = some.unionByName(keyed.join(ids, keys, "left_anti").select("doc_id", "text", F.lit(None).cast("array<int>").alias("places")))
    else:
        joined = keyed.join(repeats, keys, "left").select("doc_id", "text", "places")
    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = without_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_SQL = """
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as ws from documents),
win as (select doc_id, i, md5(array_to_string(ws[i : i + 49], ' ')) as h from (select *, unnest(range(1, len(ws) - 48)) as i from w)),
least as (select h, min(doc_id) as m from win group by h),
gone as (select distinct doc_id, i + unnest(range(0, 50)) as p from win join least using (h) where m < doc_id),
words as (select doc_id, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as p from w),
kept as (select doc_id, count(*) as n, string_agg(word, ' ' order by p) as t from words anti join gone using (doc_id, p) group by doc_id)
select w.doc_id, len(ws)::bigint as n_words, len(ws)::bigint - coalesce(n, 0) as n_removed, sha256(coalesce(t, '')) as kept_sha256
from w left join kept using (doc_id)
"""
