"""Token ids on disk: frequency-ranked, byte-aligned codes with separate control bytes.

Ids are renumbered by falling corpus frequency, so common ids are short. A rank takes 1 to 4 bytes, least significant
first; its length less one is a two-bit code, four codes to a control byte. Control bytes and data bytes of a block
are kept apart, so a reader looks the lengths of four ids up per control byte and gathers all bytes at once.

A token table is a folder with ``blocks`` (one row per document, in ascending doc_id order by part and row: part,
row, doc_id, n_tokens, control, data) and ``ranks`` (the id of every rank). Blocks are written by Spark's own writer,
whose commit keeps a lost executor's half-written files out, and read by any reader of the shared store.

Texts are encoded by the tokenizers library. Byte-level pre-tokens never cross the border between a non-space and a
following single space, so a text is cut there, each distinct piece is encoded once per worker (a bounded cache) and
the pieces' ids are gathered. Chunks with special tokens in their texts are encoded whole, and so are all texts if the
tokenizer is not a byte-level one without a normaliser. Ids are kept, two
bytes each if the vocabulary allows, in a written table between counting and coding.

Defined cases: a null text is empty and becomes the end id alone; rows with a null ``doc_id`` come first; rows with
equal ids stand next to each other, ordered by length and hash of their ids; an empty table gives an empty token
table; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratelake.llm import textkernel as tk
from ratelake.llm.common import shared_path, table

#: Pieces that a worker remembers, at about 50 bytes each, and bytes of text encoded at once.
CACHE_PIECES = 2_000_000
CHUNK = (1 << 19) - 2
END_ID = 2


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Growing:
    """An array that is appended to without copying it each time."""

    def __init__(self, kind: type, first: int = 0) -> None:
        self.held, self.size = np.zeros(1 << 16, kind), first

    def append(self, values: np.ndarray) -> None:
        to = self.size + len(values)
        if to > len(self.held):
            held = np.zeros(max(to, len(self.held) * 3 // 2), self.held.dtype)
            held[: self.size] = self.held[: self.size]
            self.held = held
        self.held[self.size : to] = values
        self.size = to

    @property
    def values(self) -> np.ndarray:
        return self.held[: self.size]


class PieceEncoder:
    """Encodes texts piece by piece; equal to encoding them whole.

    A cut stands before a single space or line feed between two other characters, and after such a line feed: there
    the pre-tokenizer's pattern always starts anew. Pieces are found and compared by two independent 64-bit hashes;
    should two pieces ever share the first one, the chunk is encoded whole.
    """

    _white = np.zeros(256, bool)
    _white[[*range(9, 14), *range(28, 33)]] = True
    _lead = np.zeros(256, bool)
    _lead[[0xC2, 0xE1, 0xE2, 0xE3]] = True  # first bytes of all other white space, among other characters
    _odd = re.compile(r"\s")
    _byte_level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    _second = tk._Powers(0xA24BAED4963EE407)

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # Pieces are cut as the byte-level pattern cuts; texts for any other tokenizer are encoded whole.
        settings = json.loads(self.tokenizer.to_str())
        self.pieces = settings.get("normalizer") is None and settings.get("pre_tokenizer") == self._byte_level
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        feed = self._ids("\n")
        self.feed = feed[0] if len(feed) == 1 else None
        self.forget()

    def _batch(self, texts: list[str]) -> list[list[int]]:
        """Ids alone; leaving out where they stand in the texts saves a third of the time."""
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _ids(self, text: str) -> list[int]:
        return self._batch([text])[0]

    def forget(self) -> None:
        self.known, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # hashes in order, and their entries
        self.check, self.bounds, self.ids = _Growing(np.uint64), _Growing(np.int64, first=1), _Growing(np.uint32)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Entries of sorted hashes; -1 where unknown."""
        if not len(self.known):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.known, keys), len(self.known) - 1)
        return np.where(self.known[at] == keys, self.place[at], -1)

    def _learn(self, pieces: list[str], keys: np.ndarray, check: np.ndarray) -> None:
        """Plain pieces are encoded as lines of one text, others one by one."""
        odd = np.array([self.feed is None or p == " " or self._odd.search(p, p[0] == " ") is not None for p in pieces])
        plain = np.flatnonzero(~odd)
        ids = np.array(self._ids("\n".join([pieces[i] for i in plain.tolist()])), np.uint32) if len(plain) else np.zeros(0, np.uint32)
        feeds = np.flatnonzero(ids == self.feed) if len(plain) else np.zeros(0, np.int64)
        if len(plain) and len(feeds) != len(plain) - 1:
            odd[:], plain, ids, feeds = True, plain[:0], ids[:0], feeds[:0]
        sizes = np.diff(np.concatenate([[-1], feeds, [len(ids)]]))[: len(plain)] - 1
        rest = np.flatnonzero(odd)
        more = self._batch([pieces[i] for i in rest.tolist()]) if len(rest) else []
        order = np.concatenate([plain, rest])
        places = np.empty(len(order), np.int64)
        places[order] = self.check.size + np.arange(len(order))
        between = np.searchsorted(self.known, keys)
        self.known, self.place = np.insert(self.known, between, keys), np.insert(self.place, between, places)
        self.check.append(check[order])
        sizes = np.concatenate([sizes, np.array([len(x) for x in more], np.int64)])
        self.bounds.append(self.bounds.values[-1] + np.cumsum(sizes))
        self.ids.append(np.delete(ids, feeds))
        self.ids.append(np.array([i for x in more for i in x], np.uint32))

    def _cuts(self, c: tk.Chunk) -> np.ndarray:
        """Where pieces start."""
        d, n = c.data, len(c.data)
        cut = np.zeros(n + 1, bool)
        if n > 2:
            white, lead = self._white[d], self._lead[d]
            single = np.zeros(n, bool)
            single[1:-1] = ((d[1:-1] == 32) | (d[1:-1] == 10)) & ~white[:-2] & ~white[2:] & ~lead[2:]
            single[2:] &= d[:-2] != 0xC2
            single[3:] &= ~lead[:-3]
            inner = c.offsets[(c.offsets > 0) & (c.offsets < n)]
            single[inner] = single[inner - 1] = False
            cut[:n] = single
            cut[1:] |= single & (d == 10)
        cut[c.offsets] = True
        return np.flatnonzero(cut[:n])

    def _whole(self, c: tk.Chunk) -> tuple[np.ndarray, np.ndarray]:
        raw, at = c.data.tobytes(), c.offsets.tolist()
        found = self._batch([raw[i:j].decode() for i, j in zip(at, at[1:])])
        return np.array([i for x in found for i in x], np.uint32), np.array([len(x) for x in found], np.int64)

    def encode(self, c: tk.Chunk) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a chunk in order, and the number of each text's."""
        raw = c.data.tobytes()
        if not self.pieces or any(s in raw for s in self.special):
            return self._whole(c)
        if not raw:
            return np.zeros(0, np.uint32), np.zeros(len(c.offsets) - 1, np.int64)
        start = self._cuts(c)
        end = np.concatenate([start[1:], [len(raw)]])
        hashes = tk.span_hashes(c.prefix(), start, end, tk.POWERS)
        check = tk.span_hashes(c.prefix(0xFF, self._second), start, end, self._second)
        unique, where, which = np.unique(hashes, return_index=True, return_inverse=True)
        at = self._find(unique)
        if len(self.known) + np.count_nonzero(at < 0) > CACHE_PIECES and len(self.known):
            self.forget()
            at[:] = -1
        fresh = np.flatnonzero(at < 0)
        if len(fresh):
            spans = zip(start[where[fresh]].tolist(), end[where[fresh]].tolist())
            self._learn([raw[i:j].decode() for i, j in spans], unique[fresh], check[where[fresh]])
            at = self._find(unique)
        at = at[which]
        if (self.check.values[at] != check).any():
            return self._whole(c)
        bounds = self.bounds.values
        sizes = bounds[at + 1] - bounds[at]
        ends = np.cumsum(sizes)
        ids = self.ids.values[np.repeat(bounds[at] - (ends - sizes), sizes) + np.arange(int(ends[-1]))]
        upto = np.concatenate([[0], ends])[np.searchsorted(start, c.offsets)]
        if np.max(end - start) > 1 << 16:  # don't keep long pieces
            self.forget()
        return ids, np.diff(upto)


_LENGTHS = np.array([[(c >> (2 * k) & 3) + 1 for k in range(4)] for c in range(256)], np.uint8)


def encode_block(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    ranks = ranks.astype("<u4")
    size = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[: len(ranks)] = size - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]]
    return control.tobytes(), data.tobytes()


def decode_block(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` values of a block: lengths by table lookup, then one gather for each byte place."""
    size = _LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    start = np.cumsum(size, dtype=np.int64) - size
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(3, np.uint8)])
    out = raw[start].astype(np.uint32)
    for k in range(1, int(size.max(initial=1))):
        has = size > k
        out[has] |= raw[start[has] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def encoded(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """(doc_id, ids): each text's ids with the end id, as little-endian bytes of the narrowest whole width."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        kind = id_type(encoder.tokenizer.get_vocab_size())
        for batch in batches:
            for c in tk.chunks(batch.column(1), CHUNK):
                ids, sizes = encoder.encode(c)
                out = np.insert(ids, np.cumsum(sizes), end_id).astype(kind)
                ends = np.cumsum((sizes + 1) * kind.itemsize)
                offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
                blob = pa.Array.from_buffers(pa.binary(), len(sizes), [None, offsets.buffers()[1], pa.py_buffer(out.tobytes())])
                yield pa.record_batch([batch.column(0).slice(c.lo, c.hi - c.lo), blob], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids binary")


_encoders: dict[str, PieceEncoder] = {}
tk.CACHES.append(_encoders)


def _encoder(path: str) -> PieceEncoder:
    """One per worker process, so its cache outlives a task; other operators' caches go."""
    tk.release(keep=_encoders)
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def id_type(vocabulary: int) -> np.dtype:
    return np.dtype("<u2" if vocabulary <= 1 << 16 else "<u4")


def rank_ids(encoded_ids: DataFrame, kind: np.dtype, vocabulary: int) -> np.ndarray:
    """Ids by falling frequency over the whole corpus, ties by id; one entry per vocabulary item."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            for blob in batch.column(0):
                total += np.bincount(np.frombuffer(blob.as_buffer(), kind), minlength=vocabulary) if len(blob.as_buffer()) > 4 * vocabulary else 0
            small = [np.frombuffer(b.as_buffer(), kind) for b in batch.column(0) if len(b.as_buffer()) <= 4 * vocabulary]
            if small:
                total += np.bincount(np.concatenate(small), minlength=vocabulary)
        seen = np.flatnonzero(total)
        yield pa.record_batch([pa.array(seen), pa.array(total[seen])], names=["id", "n"])

    counts = np.zeros(vocabulary, np.int64)
    rows = encoded_ids.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()  # the vocabulary at most
    for i, n in rows:
        counts[i] = n
    return np.lexsort((np.arange(vocabulary), -counts)).astype(np.uint32)


def write_tokens(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = END_ID) -> str:
    """Writes the token table of ``docs`` to ``folder`` and returns it."""
    from tokenizers import Tokenizer

    spark, tokenizer = docs.sparkSession, tokenizer or tokenizer_path()
    vocabulary = max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1)
    kind = id_type(vocabulary)
    encoded(docs, tokenizer, end_id).write.option("compression", "zstd").parquet(f"{folder}/ids")
    ids = spark.read.parquet(f"{folder}/ids")
    by_rank = rank_ids(ids, kind, vocabulary)
    rank_of = np.empty(vocabulary, np.uint32)
    rank_of[by_rank] = np.arange(vocabulary, dtype=np.uint32)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = 0
        part = TaskContext.get().partitionId()
        for batch in batches:
            blocks = [np.frombuffer(b.as_buffer(), kind) for b in batch.column(1)]
            pairs = [encode_block(rank_of[b]) for b in blocks]
            rows = np.arange(row, row + len(blocks))
            row += len(blocks)
            columns = [pa.array(np.full(len(blocks), part)), pa.array(rows), batch.column(0), pa.array([len(b) for b in blocks], pa.int64()), pa.array([c for c, _ in pairs], pa.binary()), pa.array([d for _, d in pairs], pa.binary())]
            yield pa.record_batch(columns, names=["part", "row", "doc_id", "n_tokens", "control", "data"])

    # Sorted before they are coded: the range sort samples its input, which would code everything twice.
    placed = ids.orderBy("doc_id", F.octet_length("ids"), F.xxhash64("ids")).mapInArrow(code, "part long, row long, doc_id long, n_tokens long, control binary, data binary")
    placed.write.option("compression", "none").parquet(f"{folder}/blocks")
    spark.createDataFrame(pa.table({"rank": pa.array(np.arange(vocabulary)), "id": pa.array(by_rank.astype(np.int64))}), "rank long, id long").write.parquet(f"{folder}/ranks")
    return folder


def _starts(blocks: DataFrame) -> DataFrame:
    """Adds ``start``: the ids of all documents before, by the parts' sums and a running sum within each part."""
    from pyspark.sql import Window

    sums = blocks.groupBy("part").agg(F.sum("n_tokens").alias("__n"))  # one row per written part
    before = F.coalesce(F.sum("__n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens")
    parts = sums.select("part", before.alias("__before"))
    return blocks.withColumn("__within", within).join(parts, "part").withColumn("start", F.col("__before") + F.col("__within"))


def read_tokens(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """(part, row, doc_id, n_tokens, ids_crc32, and ids if wanted) decoded from a token table."""
    by_rank = np.zeros(spark.read.parquet(f"{folder}/ranks").count(), np.uint32)
    for rank, i in spark.read.parquet(f"{folder}/ranks").collect():  # one row per vocabulary item
        by_rank[rank] = i
    names = ["part", "row", "doc_id", "n_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("n_tokens").to_numpy()
            decoded = (by_rank[decode_block(c.as_buffer(), d.as_buffer(), k)].astype("<u4") for c, d, k in zip(batch.column("control"), batch.column("data"), n))
            crc, blobs = [], []
            for ids in decoded:
                crc.append(zlib.crc32(ids))
                if with_ids:
                    blobs.append(ids.tobytes())
            columns = [*(batch.column(k) for k in names), pa.array(crc, pa.int64()), *([pa.array(blobs, pa.binary())] if with_ids else [])]
            yield pa.record_batch(columns, names=[*names, "ids_crc32", *(["ids"] if with_ids else [])])

    return spark.read.parquet(f"{folder}/blocks").mapInArrow(run, "part long, row long, doc_id long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else ""))


def digest(spark: SparkSession, folder: str) -> DataFrame:
    """Per document, read back from the files: doc_id, start, n_tokens, ids_crc32."""
    blocks = spark.read.parquet(f"{folder}/blocks").select("part", "row", "n_tokens")
    starts = _starts(blocks).select("part", "row", "start")
    read = read_tokens(spark, folder, with_ids=False)
    return read.join(starts, ["part", "row"]).select("doc_id", "start", "n_tokens", "ids_crc32")


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = write_tokens(table(spark, sf_dir, "documents"), shared_path(spark, "tokens"))
    return digest(spark, folder)
