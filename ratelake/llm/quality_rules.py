"""Quality rules: base heuristics and a hashed n-gram log-likelihood ratio.

Two multinomials over hashed word unigrams and bigrams are counted: a trusted target (half of all labelled good
documents, by the hash of their ids) and the raw corpus (every document). A document's score is the mean over its n-grams
of log p_target - log p_raw, so length does not matter. The other half, which the target has not seen, sets the
threshold: as far below its LOW quantile as that lies below its median, so that documents like the trusted ones
pass at every corpus size. Both are exact, from counts of the scores' bits, whatever number of documents is labelled. A document is kept if it reaches the threshold and passes the base heuristics. Nothing is
random, so every document has one verdict.

Defined cases: a null or empty text has no words and fails the base rules; rows with a null ``doc_id`` are judged
like any other but never are trusted; repeated rows get equal verdicts, and an id that rows share sets the threshold by
its lowest score; without trusted documents or on an empty
table every ratio is 0 and the threshold lets all pass; other columns of the input are ignored (``score``) or carried along (``keep_good``).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratelake.llm import textkernel as tk
from ratelake.llm.common import cut, small_enough, table

BUCKETS = 1 << 16
#: Ids of trusted documents that are broadcast to where texts are read; more are joined by a shuffle.
MAX_BROADCAST = 1 << 20
#: Quantile of the held-out trusted scores from which the threshold is set.
LOW = 0.001
MIN_WORDS = 50
SMOOTHING = 1.0

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each key: whether it occurs twice or more, and whether it isn't the first occurrence."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    any_, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    any_[order[1:][same]] = any_[order[:-1][same]] = True
    later[order[1:][same]] = True
    return any_, later


def _text_ids(first: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(first) - 1, dtype=np.uint64), np.diff(first))


def _salted(hashes: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Hashes that only agree within a text (64 bits: two different spans of a text collide once in 1e19)."""
    return tk.mix(hashes + (text + np.uint64(1)) * np.uint64(0xA0761D6478BD642F))


def chunk_stats(c: tk.Chunk) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """The base statistics by text, the word hashes and the index of each text's first word."""
    start, end, first = c.words()
    prefix = c.prefix()
    words, text = tk.span_hashes(prefix, start, end, tk.POWERS), _text_ids(first)
    at = lambda x: np.concatenate([[0], np.cumsum(x)])[c.offsets]
    by_text = lambda x: np.diff(at(x))

    covered = np.zeros(len(words) + 2, bool)
    if len(words) > 2:
        inside = np.flatnonzero(text[2:] == text[:-2])
        window = tk.combine(tk.combine(words[:-2], words[1:-1]), words[2:])[inside]
        twice = inside[_repeats(_salted(window, text[inside]))[0]]
        covered[twice] = covered[twice + 1] = covered[twice + 2] = True

    breaks = np.flatnonzero(c.data == 10)
    line_start = np.sort(np.concatenate([c.offsets[:-1], breaks + 1]))
    line_end = np.sort(np.concatenate([c.offsets[1:], breaks]))
    line_text = np.repeat(np.arange(len(c.offsets) - 1, dtype=np.uint64), by_text(c.data == 10) + 1)
    full = np.searchsorted(start, line_end) > np.searchsorted(start, line_start)
    lines = tk.span_hashes(prefix, line_start[full], line_end[full], tk.POWERS)
    again = line_text[full][_repeats(_salted(lines, line_text[full]))[1]]
    stats = {
        "n_words": np.diff(first),
        "word_chars": by_text(~tk._SPACE[c.data] & ((c.data & 0xC0) != 0x80)),
        "n_symbols": by_text(_SYMBOLS[c.data]),
        "n_dup_lines": np.bincount(again.astype(np.int64), minlength=len(c.offsets) - 1),
        "n_repeat_words": tk.per_text(first, covered[: len(words)]),
    }
    return stats, words, first


def ngram_buckets(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of unigrams, then of the bigram that starts at each word, and which words start one in their text."""
    text = _text_ids(first)
    starts = np.zeros(len(words), bool)
    starts[:-1] = text[1:] == text[:-1]
    pair = np.zeros(len(words), np.int64)
    pair[:-1] = (tk.combine(words[:-1], words[1:]) % np.uint64(BUCKETS)).astype(np.int64)
    return (words % np.uint64(BUCKETS)).astype(np.int64), pair, starts


def ngram_counts(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """(bucket, raw, target): n-gram counts of all documents and of the trusted ones.

    Each task sends at most ``BUCKETS`` rows, whatever it has read.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tk.release()
        total = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            good = np.asarray(batch.column(1).fill_null(False).to_numpy(zero_copy_only=False), bool)
            for c in tk.chunks(batch.column(0)):
                start, end, first = c.words()
                one, two, pairs = ngram_buckets(tk.span_hashes(c.prefix(), start, end, tk.POWERS), first)
                chosen = np.repeat(good[c.lo : c.hi], np.diff(first))
                for k, mask in ((0, slice(None)), (1, chosen)):
                    total[k] += np.bincount(one[mask], minlength=BUCKETS)
                    total[k] += np.bincount(two[mask][pairs[mask]], minlength=BUCKETS)
        seen = np.flatnonzero(total[0])
        yield pa.record_batch([pa.array(seen), pa.array(total[0][seen]), pa.array(total[1][seen])], names=["bucket", "raw", "target"])

    flagged = docs.select("doc_id", "text").join(_side(trusted), "doc_id", "left").select("text", "trusted")
    parts = flagged.mapInArrow(count, "bucket long, raw long, target long")
    return parts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def trusted_sample(labels: DataFrame) -> DataFrame:
    """(doc_id, trusted) of all documents rated good and not toxic; not trusted: held out, about half, by hash."""
    good = labels.where("quality = 1 and toxic = 0 and doc_id is not null").select("doc_id").distinct()
    return good.withColumn("trusted", F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(2)) == 0)


def _side(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if small_enough(ids, MAX_BROADCAST) else ids


def _ordered(values: np.ndarray) -> np.ndarray:
    """Doubles as integers of the same order, and back."""
    bits = values.view(np.int64)
    return bits ^ ((bits >> 63) & np.int64(2**63 - 1))


def at_ranks(codes: DataFrame, ranks: Sequence[int]) -> list[int]:
    """The values of the long column ``code`` at some ranks (from 0), by counting 16 of their bits at a time.

    Four counts, of which each collects at most 65,536 rows for each rank.
    """
    found = [(None, r) for r in ranks]
    for shift in (48, 32, 16, 0):
        prefixes = {p for p, _ in found if p is not None}
        rows = codes.where(F.shiftright("code", shift + 16).isin(*prefixes)) if prefixes else codes
        counts = sorted(tuple(r) for r in rows.groupBy(F.shiftright("code", shift)).count().collect())
        for k, (prefix, rest) in enumerate(found):
            for value, n in counts:
                if prefix is not None and value >> 16 != prefix:
                    continue
                if rest < n:
                    found[k] = (value, rest)
                    break
                rest -= n
    return [value for value, _ in found]


def threshold_of(docs: DataFrame, sample: DataFrame, ratios: np.ndarray) -> float:
    """The score below which a document is unlike the held-out trusted ones; minus infinity if there are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = judge(batch.column(1), ratios, -np.inf)
            long = pa.array(out["n_words"] >= MIN_WORDS)
            yield pa.record_batch([batch.column(0), pa.array(_ordered(out["llr"].astype(np.float64)))], names=["doc_id", "code"]).filter(long)

    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(_side(sample.where("not trusted")), "doc_id").select("doc_id", "text")
    # An id that several rows share counts once.
    lowest = cut(held.mapInArrow(run, "doc_id long, code long").groupBy("doc_id").agg(F.min("code").alias("code")).select("code"))
    n = lowest.count()
    if not n:
        return -np.inf
    places = [(n - 1) * q for q in (LOW, 0.5)]
    ranks = [r for p in places for r in (int(p), min(int(p) + 1, n - 1))]
    x = _ordered(np.array(at_ranks(lowest, ranks), np.int64).view(np.float64)).view(np.float64)
    low, middle = (float(a + (b - a) * (p - int(p))) for a, b, p in zip(x[::2], x[1::2], places))
    return 2 * low - middle


def log_ratios(docs: DataFrame, sample: DataFrame) -> np.ndarray:
    """log p_target - log p_raw of each bucket, smoothed; an array of the fixed size ``BUCKETS``."""
    counts = np.zeros((2, BUCKETS))
    for bucket, raw, target in ngram_counts(docs, sample).collect():  # BUCKETS rows at most
        counts[:, bucket] = raw, target
    if not counts[1].any():
        return np.zeros(BUCKETS, np.float32)
    share = (counts + SMOOTHING) / (counts.sum(axis=1, keepdims=True) + SMOOTHING * BUCKETS)
    return np.log(share[1] / share[0]).astype(np.float32)


def judge(array: pa.Array, ratios: np.ndarray, threshold: float) -> dict[str, np.ndarray]:
    """Statistics and verdict of each text of an Arrow array."""
    found: dict[str, list[np.ndarray]] = {k: [np.zeros(0, np.int64)] for k in (*STATS, "llr")}
    for c in tk.chunks(array):
        stats, words, first = chunk_stats(c)
        one, two, pairs = ngram_buckets(words, first)
        value = ratios[one].astype(np.float64) + np.where(pairs, ratios[two], 0.0)
        grams = tk.per_text(first, np.ones(len(words), np.int64) + pairs)
        stats["llr"] = tk.per_text(first, value) / np.maximum(grams, 1)
        for k, v in stats.items():
            found[k].append(v)
    out = {k: np.concatenate(v[1:] if len(v) > 1 else v) for k, v in found.items()}
    out["base_failed"] = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > 50 * out["n_words"])
    out["kept"] = ~out["base_failed"] & (out["llr"] >= threshold)
    return out


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """The log ratios and the threshold."""
    sample = cut(trusted_sample(labels))
    ratios = log_ratios(docs, sample)
    return ratios, threshold_of(docs, sample, ratios)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, the base statistics, llr, base_failed, kept."""
    ratios, threshold = fit(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = judge(batch.column(1), ratios, threshold)
            yield pa.record_batch([batch.column(0), *(pa.array(out[k]) for k in STATS), pa.array(out["llr"].astype(np.float64)), pa.array(out["base_failed"]), pa.array(out["kept"])], names=names)

    names = ["doc_id", *STATS, "llr", "base_failed", "kept"]
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"doc_id long, {', '.join(f'{k} long' for k in STATS)}, llr double, base_failed boolean, kept boolean")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that pass, with all their columns, in one pass over the texts without a shuffle."""
    (ratios, threshold), at = fit(docs, labels), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(judge(batch.column(at), ratios, threshold)["kept"]))

    return docs.mapInArrow(run, docs.schema)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
