"""Line dedup by a segment-partition edit join; DataFrame functions only.

Equal lines are one class, found by a pre-aggregated grouping on two 64-bit hashes. Different lines are linked if at
most ``edits`` edits (insert, delete, replace a character) turn one into the other. A line is cut into edits + 1 segments
of nearly equal length; edits can't touch all of them, so a linked line has one segment unchanged at nearly the same
place. Segments are an index by (length, segment number, hash); every line probes it, for its own length and up to
``edits`` shorter ones, with the substrings whose place a segment can have moved to (multi-match-aware selection). What
the index returns must also agree in a signature, counts of fifteen frequent letters, of which an edit changes two by
one; this prunes pairs that merely share a passage, inside the join. The rest is verified by a banded
bit-parallel automaton: one bit per diagonal and number of edits, all advanced together by shifts and masks for each
character.

Keys are made where lines are read, so that numbers are shuffled and texts only of lines in candidate pairs. Hot keys of
the joins are split by Spark. Among n variants of one long line that differ in more than ``edits`` edits, candidates
still grow with n * n (two in a hundred pairs, on test tables); none is dropped.

Defined cases: null texts and lines without a word have no line here; a pair whose shorter line has SHORT_CHARS
to MIN_CHARS - 1 characters is linked within SHORT_EDITS, and lines below that only if equal; a null ``doc_id`` comes last when the first document of a line is named; repeated rows count as
copies; an empty table gives an empty result; other columns are ignored or carried along (``without_copies``).
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ratelake.llm.common import cut, small_enough, table
from ratelake.llm.components import connected_components

EDITS = 2
MIN_CHARS = 24
#: Lines from here to below MIN_CHARS characters are linked at SHORT_EDITS, to lines of MIN_CHARS too.
SHORT_CHARS, SHORT_EDITS = 8, 1
#: Links by length of the shorter line: (edits, least, most).
REACHES = ((EDITS, MIN_CHARS, 1 << 30), (SHORT_EDITS, SHORT_CHARS, MIN_CHARS - 1))
SPACES = " \t\n\x0b\x0c\r"
LETTERS = "etanirsohdlucmg"
#: Hashes of lines in candidate pairs (8 bytes each) that are broadcast to find their texts; more are joined by a shuffle.
MAX_BROADCAST = 1 << 18


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line, a, b): every line with a word, and its two hashes."""
    split = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return split.where(F.btrim("line", F.lit(SPACES)) != "").select("doc_id", "line_no", "line", F.xxhash64("line").alias("a"), F.xxhash64(F.lit(1), "line").alias("b"))


def classes(found: DataFrame) -> DataFrame:
    """(a, b, doc_id, line_no, copies): one row per distinct line with its first place; null ids come last."""
    # A place as one number, so that the grouping needs no sort.
    place = F.col("doc_id").cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(10,0)") + F.col("line_no")
    nameless = F.min(F.when(F.col("doc_id").isNull(), F.col("line_no"))).alias("__nameless")
    by = found.groupBy("a", "b").agg(F.min(place).alias("__p"), nameless, F.count("*").alias("copies"))
    line_no = F.expr("cast(pmod(__p, cast(2147483648 as decimal(10,0))) as bigint)")
    by = by.withColumn("line_no", F.coalesce(line_no, F.col("__nameless").cast("long")))
    return by.select("a", "b", F.expr("(__p - line_no) div cast(2147483648 as decimal(10,0))").alias("doc_id"), "line_no", "copies")


def _letter_counts(df: DataFrame) -> DataFrame:
    """Adds ``counts`` to (line): how often each of LETTERS stands in it.

    Letters are taken out one after the other, so that later ones search shorter strings.
    """
    names = [f"__n{i}" for i in range(len(LETTERS))]
    df = df.withColumn("__left", F.col("line"))
    for name, letter in zip(names, LETTERS):
        df = df.withColumn("__rest", F.replace("__left", F.lit(letter), F.lit("")))
        df = df.withColumn(name, F.octet_length("__left") - F.octet_length("__rest")).drop("__left").withColumnRenamed("__rest", "__left")
    return df.withColumn("counts", F.array(*names)).drop("__left", *names)


def _signature() -> Column:
    """``counts`` modulo 8, each as one of the eight states of a ring of four bits.

    Neighbouring states differ in one bit, so the bits in which two signatures differ are at most as many as the counts
    differ by; and an edit changes two counts by one at most.
    """
    states = F.array(*[F.lit(x) for x in (0b0000, 0b0001, 0b0011, 0b0111, 0b1111, 0b1110, 0b1100, 0b1000)])
    return F.aggregate("counts", F.lit(0).cast("long"), lambda s, c: F.shiftleft(s, 4).bitwiseOR(F.get(states, c.bitwiseAND(F.lit(7))).cast("long")))


def _slots(edits: int) -> list[tuple[int, int, int]]:
    """What a line is indexed by (first edits + 1 slots) and probes.

    A slot (l, k, m) is segment k of lines shorter by l at its place moved by m. Edits left and right of the segment
    bound the move, whichever side the most edits are on. The index serves as the probe that moves nothing.
    """
    parts = edits + 1
    probes = [(less, k, m) for less in range(edits + 1) for k in range(parts) for m in range(max(-k, less - (edits - k)), min(k, less + (edits - k)) + 1)]
    index = [(0, k, 0) for k in range(parts)]
    return index + [p for p in probes if p not in index]


def _border(reach: int, edits: int, less: int, k: int) -> str:
    """Where segment ``k`` of a line of n - ``less`` characters begins; the last segments are the longer ones."""
    return "0" if k == 0 else f"(n - {less})" if k == edits + 1 else f"s{reach}_{less}_{k}"


def _borders(reach: int, edits: int) -> list[Column]:
    """The inner borders of ``_border``."""
    parts = edits + 1
    at = "cast((n - {less}) div {parts} * {k} + greatest({k} + (n - {less}) % {parts} - {parts}, 0) as int)"
    return [F.expr(at.format(less=less, parts=parts, k=k)).alias(_border(reach, edits, less, k)) for less in range(parts) for k in range(1, parts)]


def _key(reach: int, edits: int, least: int, most: int, slot: tuple[int, int, int]) -> Column:
    """The key of a line's slot: a 60-bit hash of (length, segment, substring), and the number of the reach."""
    less, k, moved = slot
    start, end = _border(reach, edits, less, k), _border(reach, edits, less, k + 1)
    hashed = f"(xxhash64(n - {less}, {k}, substring(wide, 4 * ({start} + {moved}) + 1, 4 * ({end} - {start}))) & -16) | {reach}"
    return F.expr(f"case when n - {less} between {least} and {most} and {start} + {moved} >= 0 and {end} + {moved} <= n then {hashed} end")


def _distance(edits: int) -> Column:
    """Edit distance of ``left`` and ``right`` (arrays of characters); more than ``edits`` gives null.

    Bit d of byte k is set if the automaton has read j characters of ``right`` and j + d - edits of ``left`` with at
    most k edits. A step keeps what matches, replaces (next byte), inserts (next byte, one diagonal down) and deletes
    (next byte, one diagonal up).
    """
    width = 2 * edits + 1
    mask = sum(((1 << width) - 1) << 8 * k for k in range(edits + 1))
    ones = sum(1 << 8 * k for k in range(edits + 1))
    equal = " + ".join(f"if(j + {d - edits} between 1 and size(left) and try_element_at(left, greatest(j + {d - edits}, 1)) = element_at(right, j), {1 << d}, 0)" for d in range(width))
    spread = lambda x: functools.reduce(lambda y, _: f"transform({y}, s -> (s | shiftleft(s, 8) | shiftleft(s, 9)) & {mask})", range(edits), x)
    step = f"array((s0 & (({equal}) * {ones})) | (shiftleft(s0, 8) & {mask}) | (shiftleft(shiftright(s0, 1) & {mask}, 8) & {mask}))"
    start = spread(f"array({1 << edits}L)") + "[0]"
    run = f"aggregate(sequence(1, size(right)), {start}, (s0, j) -> {spread(step.replace('* ' + str(ones), f'* {ones}L'))}[0])"
    # Bits that leave a byte's width are masked off, as are those that enter from the next byte.
    final = [f"when (r & shiftleft(1L, size(left) - size(right) + {edits + 8 * k})) <> 0 then {k}" for k in range(edits + 1)]
    return F.expr(f"transform(array({run}), r -> case {' '.join(final)} end)[0]")


def links(found: DataFrame, reaches: Sequence[tuple[int, int, int]] = REACHES) -> DataFrame:
    """(a, b, c, d, distance): pairs of different lines, by their hashes (a, b) and (c, d), within a reach.

    A reach (edits, least, most) links pairs within ``edits`` edits whose shorter line has ``least`` to ``most``
    characters.
    """
    least, edits = min(r[1] for r in reaches), max(r[0] for r in reaches)
    # In four bytes a character, substrings need no count of characters from the start of the line.
    wide = found.where(F.octet_length("line") >= least).select("a", "b", "line", F.encode("line", "UTF-32").alias("wide"))
    sized = wide.withColumn("n", F.expr("cast(octet_length(wide) div 4 as int)"))
    slots = [(i, r, s) for i, r in enumerate(reaches) for s in _slots(r[0])]
    borders = [b for i, r in enumerate(reaches) for b in _borders(i, r[0])]
    # Keys and signatures are made before equal lines are grouped, so numbers are shuffled and no texts.
    # (The higher-order function keeps this projection out of the stage's one method, which would be too long to compile.)
    keyed = _letter_counts(sized).select("a", "b", "wide", "n", "counts", *borders).select("a", "b", _signature().alias("signature"), *[_key(i, *r, s).alias(f"k{j}") for j, (i, r, s) in enumerate(slots)])
    keys = [f"k{j}" for j in range(len(slots))]
    distinct = keyed.groupBy("a", "b").agg(F.max("signature").alias("signature"), *[F.max(k).alias(k) for k in keys])
    # Outer explodes, because for inner ones the optimizer adds a filter that computes all keys once more.
    rows = distinct.select("a", "signature", F.posexplode_outer(F.array(*keys)).alias("slot", "key")).where("key is not null")
    # An index entry is met by entries and probes of lines of its length (once, by order of their hashes) and of longer ones.
    entries, equals = [j for j, (_, r, s) in enumerate(slots) if s[0] == s[2] == 0], [j for j, (_, r, s) in enumerate(slots) if s[0] == 0]
    entry = rows.where(F.col("slot").isin(entries)).select("key", "a", "signature")
    other = [F.col("key").alias("key2"), F.col("a").alias("c"), F.col("signature").alias("signature2")]
    probe = rows.where(~F.col("slot").isin(entries)).select(*other, F.col("slot").isin(equals).alias("equal"))
    bound = F.element_at(F.array(*[F.lit(2 * r[0]) for r in reaches]), (F.col("key").bitwiseAND(F.lit(15)) + 1).cast("int"))
    near = (F.col("key") == F.col("key2")) & (F.bit_count(F.col("signature").bitwiseXOR(F.col("signature2"))) <= bound)
    met = entry.join(entry.select(*other), near & (F.col("a") < F.col("c"))).select("a", "c")
    longer = entry.join(probe, near & (F.col("a") != F.col("c")) & (~F.col("equal") | (F.col("a") < F.col("c")))).select("a", "c")
    pairs = cut(met.unionByName(longer).select(F.least("a", "c").alias("a"), F.greatest("a", "c").alias("c")).distinct())
    ids = pairs.select("a").unionByName(pairs.select(F.col("c").alias("a"))).distinct()
    ids = F.broadcast(ids) if small_enough(ids, MAX_BROADCAST) else ids
    needed = cut(found.select("a", "b", "line").join(ids, "a").groupBy("a", "b").agg(F.first("line").alias("line")))
    texts = needed.select("a", "b", F.split("line", "").alias("left"))
    others = needed.select(F.col("a").alias("c"), F.col("b").alias("d"), F.split("line", "").alias("right"))
    rated = pairs.join(texts, "a").join(others, "c").withColumn("distance", _distance(edits))
    size = F.least(F.size("left"), F.size("right"))
    allowed = functools.reduce(operator.or_, [size.between(r[1], r[2]) & (F.col("distance") <= r[0]) for r in reaches])
    return rated.where(allowed).select("a", "b", "c", "d", "distance")


def line_id(a: str, b: str) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(a), 16, "0"), F.lpad(F.hex(b), 16, "0")))


def rated_links(found: DataFrame, reaches: Sequence[tuple[int, int, int]] = REACHES) -> DataFrame:
    """(line_id, n_links, class_id) of the lines with links; class_id is the smallest line_id that the line reaches."""
    ends = F.array_sort(F.array(line_id("a", "b"), line_id("c", "d")))
    pairs = cut(links(found, reaches).select(ends[0].alias("a"), ends[1].alias("b")).distinct())
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    counts = both.groupBy(F.col("a").alias("line_id")).agg(F.count("*").alias("n_links"))
    groups = connected_components(pairs).select(F.col("node").alias("line_id"), F.col("component").alias("class_id"))
    return counts.join(groups, "line_id")


def _named(a: str, b: str) -> tuple[Column, Column]:
    """The hashes in a line_id."""
    return tuple(F.conv(F.substring("line_id", at, 16), 16, -10).cast("long").alias(name) for at, name in ((1, a), (17, b)))


def dedup(docs: DataFrame, reaches: Sequence[tuple[int, int, int]] = REACHES) -> DataFrame:
    """One row per distinct line: line_id, doc_id and line_no of its first place, copies, n_links, class_id."""
    found = lines(docs)
    linked = rated_links(found, reaches).select(*_named("a", "b"), "n_links", "class_id")
    rows = classes(found).join(linked, ["a", "b"], "left")
    name = line_id("a", "b")
    return rows.select(name.alias("line_id"), "doc_id", "line_no", "copies", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("class_id", name).alias("class_id"))


def members(docs: DataFrame, reaches: Sequence[tuple[int, int, int]] = REACHES) -> DataFrame:
    """One row per line of each document: doc_id, line_no, line_id, class_id, n_links, copies, first_doc_id, first_line_no, kept.

    The first place is that of the line's class. A line is kept if it stands there or has no ``doc_id``.
    """
    found = lines(docs)
    linked = rated_links(found, reaches).select(*_named("a", "b"), "n_links", "class_id")
    # Lines with neither copies nor links, by far the most, are their own class and need not be looked up.
    more = classes(found).join(linked, ["a", "b"], "left").where("copies > 1 or n_links > 0").withColumn("class_id", F.coalesce("class_id", line_id("a", "b")))
    more = cut(more)
    first = more.groupBy("class_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "line_no")).alias("p"))
    by = more.join(first, "class_id").select("a", "b", "class_id", "n_links", "copies", "p")
    places = found.select("doc_id", F.col("line_no").cast("long").alias("line_no"), "a", "b").join(by, ["a", "b"], "left")
    alone, name = F.col("p").isNull(), line_id("a", "b")
    stays = alone | F.col("doc_id").isNull() | ((F.col("doc_id") == F.col("p.doc_id")) & (F.col("line_no") == F.col("p.line_no")))
    return places.select(
        "doc_id",
        "line_no",
        name.alias("line_id"),
        F.coalesce("class_id", name).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("copies"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("p.doc_id")).alias("first_doc_id"),
        F.when(alone, F.col("line_no")).otherwise(F.col("p.line_no")).alias("first_line_no"),
        F.coalesce(stays, F.lit(False)).alias("kept"),
    )


def without_copies(docs: DataFrame, reaches: Sequence[tuple[int, int, int]] = REACHES) -> DataFrame:
    """The documents, with all their columns, whose texts have no line that ``members`` does not keep."""
    gone = members(docs, reaches).where("not kept").groupBy(F.col("doc_id").alias("id")).agg(F.collect_set(F.struct("line_no", "line_id")).alias("gone"))
    # The document's own columns stay in one struct, so that none can clash with what is joined.
    keyed = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    # Of rows that share an id, each loses the lines that it has itself.
    name = lambda x: F.lower(F.concat(F.lpad(F.hex(F.xxhash64(x)), 16, "0"), F.lpad(F.hex(F.xxhash64(F.lit(1), x)), 16, "0")))
    left = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("gone", F.struct(i.cast("long").alias("line_no"), name(x).alias("line_id"))))
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    return keyed.join(gone, F.col("doc_id") == F.col("id"), "left").select(F.col("row").withField("text", text).alias("row")).select("row.*")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return members(table(spark, sf_dir, "documents"))
