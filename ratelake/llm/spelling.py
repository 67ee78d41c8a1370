"""Spelling variants: words one edit apart, by a positional q-gram inverted index with a count filter.

A word is padded by two marks on either side and cut into its grams of three characters, each with its place. One edit
changes three neighbouring grams at most, so two words one edit apart share as many grams as the longer one has
characters, less one; a shared gram stands at the same place or, in the longer word, one further on. Grams are ordered by
how many words have them. Going up that order, a word's grams are index keys until those passed no longer lie within
three neighbouring places (one edit could not have changed them all); two words one edit apart share their first common
gram as a key. So words meet under (length, gram, place) of their rare grams only, and mostly under two or three.

Under one key a task holds an inverted index of the words of that length, from (gram, place) to ascending postings. Each
word, of that length or one longer, merges the shorter postings of its own grams through a heap, looks entries up in the
longer ones, as far as the bound can still be reached, and candidates at the bound are verified. Keys with more than BLOCK_WORDS words are
dealt as blocks of index entries, each of which all probes visit; probes are streamed, so a task holds one block at most.

Counting words is pre-aggregated where texts are read. Gram counts, the only table that is collected, are bounded by the
alphabet: PAIRS of 92 characters to the third power, whatever the number of texts.

Defined cases: null texts have no words; a null ``doc_id`` counts as an empty string of digits in the hash; rows that
repeat are counted as often; words are compared by code points, upper-case letters beyond A-Z as they are; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from heapq import heapify, heappop, heapreplace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ratelake.llm import textkernel as tk
from ratelake.llm.common import cut, small_enough, table

MIN_LENGTH, MIN_COUNT = 5, 3
#: One in so many runs loses a character.
TYPO = 97
GRAM = 3
#: Times its own count that a word's form must have.
FORM_RATIO = 2
#: Index entries of one key that a task holds.
BLOCK_WORDS = 1 << 12
#: Hot keys that are broadcast; more are joined by a shuffle.
MAX_BROADCAST = 1 << 18
#: Different words that a task counts before it hands them on.
_HELD = 1 << 17
_RUN = re.compile("[a-zÀ-ÿ]+")
_MARK = "^"


def counted(docs: DataFrame, typo: int = TYPO) -> DataFrame:
    """(word, n): runs of letters, A-Z lower-cased; of runs whose hash with the document's id ``typo`` divides, one character is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tk.release()
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.record_batch([pa.array(list(counts.keys()), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if not text.is_valid:
                    continue
                start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                # Bytes are lower-cased for A-Z alone.
                for word, n in Counter(_RUN.findall(text.as_buffer().to_pybytes().lower().decode("utf-8", "replace"))).items():
                    h = zlib.crc32(word.encode(), start)
                    if not h % typo:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                    counts[word] += n
                if len(counts) >= _HELD:
                    yield out()
                    counts.clear()
        if counts:
            yield out()

    parts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """The (word, n) of ``counted`` that are long and frequent enough."""
    return counted(docs).where((F.length("word") >= min_length) & (F.col("n") >= min_count))


def grams(word: str) -> list[str]:
    padded = _MARK * (GRAM - 1) + word + _MARK * (GRAM - 1)
    return [padded[i : i + GRAM] for i in range(len(padded) - GRAM + 1)]


def index_keys(own: list[str], count: dict[str, int]) -> list[tuple[str, int]]:
    """The rarest of a word's grams, with their places, up to the first after those that one edit can change."""
    ordered = sorted(range(len(own)), key=lambda at: (count.get(own[at], 0), own[at], at))
    out, low, high = [], len(own), -1
    for at in ordered:
        out.append((own[at], at))
        low, high = min(low, at), max(high, at)
        if high - low >= GRAM:
            break
    return out


def one_edit(a: str, b: str) -> bool:
    """Whether words differ by exactly one inserted, deleted or replaced character."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    at = 0
    while at < len(a) and a[at] == b[at]:
        at += 1
    return a[at + (len(a) == len(b)) :] == b[at + 1 :]


def merged(lists: list[list[int]], least: int) -> Iterator[int]:
    """The entries that are in ``least`` of the ascending ``lists`` or more, in order.

    Such an entry misses len(lists) - least lists at most, so it is in one of that many shortest lists and one more. Those
    are merged through a heap; whether an entry is in enough of the longer ones is looked up there.
    """
    spare = len(lists) - least
    if spare < 0:
        return
    lists = sorted(lists, key=len)
    longer = lists[spare + 1 :]
    heap = [(x[0], k, 0) for k, x in enumerate(lists[: spare + 1])]
    heapify(heap)
    while heap:
        entry, missing = heap[0][0], least
        while heap and heap[0][0] == entry:
            _, k, at = heap[0]
            missing -= 1
            if at + 1 < len(lists[k]):
                heapreplace(heap, (lists[k][at + 1], k, at + 1))
            else:
                heappop(heap)
        left = len(longer)
        for x in longer:
            if not 0 < missing <= left:
                break
            at = bisect_left(x, entry)
            missing -= at < len(x) and x[at] == entry
            left -= 1
        if missing <= 0:
            yield entry


class Index:
    """Postings of the words of one length."""

    def __init__(self) -> None:
        self.words: list[tuple[str, int]] = []
        self.postings: dict[tuple[str, int], list[int]] = defaultdict(list)

    def add(self, word: str, n: int, own: list[str]) -> None:
        for at, gram in enumerate(own):
            self.postings[gram, at].append(len(self.words))
        self.words.append((word, n))

    def near(self, word: str, own: list[str], longer: bool) -> Iterator[tuple[str, int]]:
        """The words held that are one edit from ``word``, which is as long as they are or one longer."""
        get = self.postings.get
        found = [x for at, gram in enumerate(own) if (x := get((gram, at)))]
        if longer:  # the place may be one further on, behind an inserted character
            found += [x for at, gram in enumerate(own) if at and (x := get((gram, at - 1)))]
        for k in merged(found, len(word) - 1):
            if one_edit(word, self.words[k][0]):
                yield self.words[k]


#: Roles under a key: held in the index; of the same length, from another block; one longer.
_HELD_ROW, _SAME, _LONGER = 0, 1, 2


def _keyed(words: DataFrame, count: dict[str, int]) -> DataFrame:
    """(key, role, word, n): each word under its own keys, and as the longer one under those of words one shorter."""
    shared = words.sparkSession.sparkContext.broadcast(count)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tk.release()
        for batch in batches:
            rows: list[tuple[str, int, str, int]] = []
            for word, n in zip(*(batch.column(k).to_pylist() for k in (0, 1))):
                size = len(word)
                for gram, at in index_keys(grams(word), shared.value):
                    rows += [(f"{size}:{at}:{gram}", _HELD_ROW, word, n), (f"{size - 1}:{at}:{gram}", _LONGER, word, n)]
                    if at:
                        rows.append((f"{size - 1}:{at - 1}:{gram}", _LONGER, word, n))
            kinds = (pa.string(), pa.int32(), pa.string(), pa.int64())
            yield pa.record_batch([pa.array(x, kind) for x, kind in zip(zip(*rows) if rows else ([],) * 4, kinds)], names=["key", "role", "word", "n"])

    return words.select("word", "n").mapInArrow(run, "key string, role int, word string, n long")


def _gram_counts(words: DataFrame) -> dict[str, int]:
    """How many words have each gram: at most one entry for three characters of the alphabet and the mark."""
    padded = F.concat(F.lit(_MARK * (GRAM - 1)), "word", F.lit(_MARK * (GRAM - 1)))
    own = F.transform(F.sequence(F.lit(1), F.length("word") + GRAM - 1), lambda i: F.substring(padded, i, F.lit(GRAM)))
    return dict(words.select(F.explode(own).alias("gram")).groupBy("gram").count().toArrow().to_pandas().itertuples(index=False, name=None))


def near_pairs(words: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(a, n_a, b, n_b): each two of the distinct ``words`` (word, n) one edit apart, once."""
    rows = cut(_keyed(words, _gram_counts(words)))
    hot = rows.where(F.col("role") == _HELD_ROW).groupBy("key").count().where(F.col("count") > block_words)
    hot = cut(hot.select("key", F.ceil(F.col("count") / block_words).cast("int").alias("blocks")))
    if hot.isEmpty():
        dealt = rows.withColumn("block", F.lit(0))
    else:
        side = F.broadcast(hot) if small_enough(hot, MAX_BROADCAST) else hot
        own, last = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"), F.col("blocks") - 1
        # An index row visits the later blocks too, as a probe of the same length.
        visits = F.transform(F.sequence(F.lit(0), last), lambda b: F.struct(b.alias("block"), F.lit(_LONGER).alias("role")))
        entry = F.transform(F.sequence(own, last), lambda b: F.struct(b.alias("block"), F.when(b == own, _HELD_ROW).otherwise(_SAME).alias("role")))
        at = F.explode(F.when(F.col("role") == _HELD_ROW, entry).otherwise(visits)).alias("at")
        dealt = rows.join(side, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).select("key", "word", "n", at).select("key", "word", "n", "at.*")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tk.release()
        cell, index = None, Index()
        for batch in batches:
            found: list[tuple[str, int, str, int]] = []
            for key, block, role, word, n in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if (key, block) != cell:
                    cell, index = (key, block), Index()
                if role != _HELD_ROW and not index.words:
                    continue
                own = grams(word)
                found += [(min(word, other), n if word < other else m, max(word, other), m if word < other else n) for other, m in index.near(word, own, role == _LONGER)]
                if role == _HELD_ROW:
                    index.add(word, n, own)
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.record_batch([pa.array(x, kind) for x, kind in zip(zip(*found) if found else ([],) * 4, kinds)], names=["a", "n_a", "b", "n_b"])

    sorted_rows = dealt.repartition("key", "block").sortWithinPartitions("key", "block", "role")
    return sorted_rows.select("key", "block", "role", "word", "n").mapInArrow(run, "a string, n_a long, b string, n_b long").distinct()


def _followed(forms: DataFrame) -> DataFrame:
    """(word, root): ``forms`` (word, form) followed to the last; each round doubles the steps, and there are few."""
    roots = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("__next"))
        moved = cut(roots.join(further, "root", "left").select("word", F.coalesce("__next", "root").alias("root"), F.col("__next").isNotNull().alias("__moved")))
        roots = moved.drop("__moved")
        if moved.where("__moved").isEmpty():
            return roots


def variants(words: DataFrame, ratio: int = FORM_RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of distinct ``words`` (word, n)."""
    pairs = cut(near_pairs(words))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("n_b").alias("n_a"), F.col("a").alias("b"), F.col("n_a").alias("n_b")))
    best: Column = F.min(F.struct((-F.col("n_b")).alias("m"), F.col("b").alias("other")))
    near = both.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("__near"), best.alias("__best"))
    out = words.join(near, "word", "left")
    has = -F.col("__best.m") >= ratio * F.col("n")
    out = cut(out.select("word", "n", F.coalesce("__near", F.lit(0)).alias("n_near"), F.when(has, F.col("__best.other")).alias("form"), F.when(has, -F.col("__best.m")).alias("form_n")))
    roots = _followed(out.where("form is not null"))
    return out.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(cut(vocabulary(table(spark, sf_dir, "documents"))))


ORACLE_SQL = r"""
with recursive crc(i, c, k) as (select i, i, 0 from range(256) as t(i) union all select i, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from crc where k < 8),
tab as materialized (select list(c order by i) as t from crc where k = 8),
runs as materialized (select coalesce(doc_id::varchar, '') || ':' as id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) as r from documents),
per as materialized (select id, r, count(*) as n, hex(encode(id || r)) as x from runs group by all),
hashed as (select r, n, xor(list_reduce(list_prepend(4294967295::bigint, [('0x' || x[2 * i + 1 : 2 * i + 2])::bigint for i in range(len(x) // 2)]), lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1])), 4294967295) as h from per, tab),
words as materialized (select case when h % 97 = 0 then r[1 : h % length(r)] || r[h % length(r) + 2 : length(r)] else r end as word, sum(n)::bigint as n from hashed group by 1 having length(word) >= 5 and sum(n) >= 3),
spots as (select word, n, unnest(range(1, length(word) + 1)) as i from words),
cuts as materialized (select word, n, i, word[1 : i - 1] as l, word[i + 1 : length(word)] as r from spots),
near as materialized (
  select distinct a.word, b.word as other, b.n as m from cuts as a join cuts as b on a.i = b.i and a.l = b.l and a.r = b.r and a.word <> b.word
  union select distinct c.word, w.word, w.n from cuts as c join words as w on w.word = c.l || c.r
  union select distinct w.word, c.word, c.n from cuts as c join words as w on w.word = c.l || c.r),
best as (select word, count(*) as n_near, max(m) as m from near group by word),
formed as materialized (select w.word, w.n, coalesce(n_near, 0) as n_near, case when best.m >= 2 * w.n then (select min(other) from near where near.word = w.word and near.m = best.m) end as form, case when best.m >= 2 * w.n then best.m end as form_n from words as w left join best using (word)),
chain(word, tip, step) as (select word, word, 0 from formed union all select chain.word, formed.form, step + 1 from chain join formed on formed.word = chain.tip where formed.form is not null),
roots as (select word, max_by(tip, step) as root from chain group by word)
select word, form, root, n, n_near::bigint as n_near, form_n::bigint as form_n from formed join roots using (word)
"""
