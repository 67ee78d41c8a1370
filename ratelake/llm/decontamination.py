"""Benchmark decontamination by template canonicalisation; DataFrame functions only.

A text becomes tokens: numbers, words, runs of number words, runs of capitalised words inside a sentence, and single
characters of scripts without spaces. Numbers, capitalised names inside sentences and units after numbers become typed
placeholders; other tokens are lower-cased. Windows of WINDOW tokens of such templates are hash-joined with those of the
benchmark, which finds the places where an item may lie. A window with fewer than MIN_LITERALS ordinary tokens says little
about which question it is from (any row of numbers would fit), so such a window must also agree in its plain tokens.
All windows of all items are joined on, however many items share them; under a run of matching windows only its first
makes a row, so a passage that many items share costs a row for each item and place.

Each place found is then aligned with the whole item. Windows whose templates agree count; between the first and the
last of them every slot is looked at, and each value of the item must stand for one value of the document and the other
way round, as in a question whose numbers or names were exchanged. A document is contaminated by an item if consistent
windows cover MIN_COVERAGE of the item's windows, at one place, or at several whose slots agree with each other.

Items without a window of MIN_LITERALS ordinary tokens (short ones, or such of numbers and names) are found verbatim, by
windows of their plain tokens (WINDOW, or all of a shorter item); items under SHORT tokens, which are no sentence, only as
a whole text.

Join windows are broadcast if there are at most MAX_BROADCAST of them (32 bytes each), and joined by a shuffle otherwise.
Documents are exploded into windows in place, as numbers; only places are shuffled, and only documents that have any are
read again for their tokens.

Defined cases: null and empty texts match nothing, items without a token either; rows are judged by id and text, so rows
of one id with different texts, or with a null ``doc_id``, don't share a verdict; equal items each match; a null
``item_id`` is reported as null; an empty table gives no match; other columns are ignored or carried along.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ratelake.llm.common import cut, small_enough, table

WINDOW = 8
SHORT = 4
MIN_LITERALS = 5
MIN_COVERAGE = 0.25
MAX_BROADCAST = 1 << 18

NUMBER, NAME, UNIT = "#number", "#name", "#unit"
NUMBER_WORDS = ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "twenty", "thirty", "forty", "fifty", "hundred", "thousand", "million")
UNITS = (
    "mm", "cm", "m", "km", "inch", "inches", "foot", "feet", "yard", "yards", "mile", "miles", "mg", "g", "kg", "gram", "grams", "ton", "tons", "pound", "pounds", "ounce", "ounces",
    "ml", "l", "liter", "liters", "litre", "litres", "gallon", "gallons", "s", "sec", "second", "seconds", "min", "minute", "minutes", "h", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years",
    "cent", "cents", "dollar", "dollars", "euro", "euros", "usd", "eur", "percent", "degrees", "celsius", "fahrenheit", "mph", "kph", "hz", "khz", "mhz", "w", "kw", "v", "meter", "meters", "metre", "metres",
)
_COUNTED = f"(?:{'|'.join(NUMBER_WORDS)})"
_CAPITALISED = r"\p{Lu}[\p{Ll}\p{M}]+"
# Groups are repeated possessively: otherwise the engine descends once more for each repetition, and a run of some
# thousand numbers or names overflows a task's stack. Nothing after such a group ever needs one of its repetitions back.
TOKEN = "|".join(
    [
        r"\p{N}+(?:[.,:/]\p{N}+)*+(?:[ -](?:hundred|thousand|million)\b)*+",
        rf"{_COUNTED}(?:[ -]{_COUNTED}\b)++",
        rf"(?=\p{{Lu}})(?<=[^.!?\s]\s){_CAPITALISED}(?: {_CAPITALISED})++[.!?]?",
        r"[฀-໿⺀-꓏豈-﫿]",
        r"[\p{L}\p{M}]+[.!?]?",
    ]
)


def _plain(token: Column) -> Column:
    return F.rtrim(token, F.lit(".!?"))


def _after_number(before: Column) -> Column:
    return (before < ":") | before.rlike(r"^\p{N}") | F.substring_index(F.substring_index(_plain(before), " ", 1), "-", 1).isin(*NUMBER_WORDS)


def canonical(tokens: str) -> Column:
    """The template of an array of tokens; by far the most tokens take the first branch's first exit."""

    def one(token: Column, i: Column) -> Column:
        before = F.coalesce(F.get(tokens, i - 1), F.lit("."))
        plain = _plain(token)
        special = F.when(F.contains(token, F.lit(" ")) | F.contains(token, F.lit("-")) | plain.isin(*NUMBER_WORDS), NUMBER).when(_after_number(before), UNIT).otherwise(plain)
        lower = F.when(~plain.isin(*NUMBER_WORDS, *UNITS) & ~F.contains(token, F.lit(" ")) & ~F.contains(token, F.lit("-")), plain).otherwise(special)
        name = F.contains(token, F.lit(" ")) | (token.rlike(rf"^{_CAPITALISED}[.!?]?$") & ~before.rlike(r"[.!?]$"))
        small = F.lower(plain)
        other = F.when((token < ":") | token.rlike(r"^\p{N}") | small.isin(*NUMBER_WORDS), NUMBER).when(small.isin(*UNITS) & _after_number(before), UNIT).when(name, NAME).otherwise(small)
        return F.when((token >= "a") & (token < "{"), lower).otherwise(other)

    return F.transform(tokens, one)


def _tokens(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, raw, soft): tokens, and the hash of each one's canonical form."""
    raw = df.where(F.col("text").isNotNull()).select(*keys, F.regexp_extract_all("text", F.lit(TOKEN), 0).alias("raw"))
    return raw.select(*keys, "raw", F.transform(canonical("raw"), lambda t: F.xxhash64(t)).alias("soft"))


def _verbatim(tokens: str) -> Column:
    return F.transform(tokens, lambda t: F.xxhash64(F.lower(_plain(t))))


def _hash(hashes: str, at: Column, width: int) -> Column:
    return F.xxhash64(F.lit(width), *[F.get(hashes, at + k) for k in range(width)])


def _windows(df: DataFrame, hashes: str, width: int, *keys: str) -> DataFrame:
    """(keys, hashes, at, hash) of every window; the array is not copied before a join in place."""
    # An outer explode, because for an inner one the optimizer adds a filter that computes all tokens once more.
    rows = df.select(*keys, hashes, F.posexplode_outer(hashes).alias("at", "__")).where(F.col("at") <= F.size(hashes) - width)
    return rows.select(*keys, hashes, "at", _hash(hashes, F.col("at"), width).alias("hash"))


def _items(benchmark: DataFrame) -> DataFrame:
    """(item, item_id, raw, soft, hard, n): one row per id and text."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    keyed = _tokens(rows.withColumn("item", F.xxhash64(F.coalesce("item_id", F.lit(-1)), F.col("item_id").isNull(), "text")), "item", "item_id")
    return keyed.select("*", _verbatim("raw").alias("hard"), F.size("raw").alias("n")).where("n > 0")


def _literal(token: Column) -> Column:
    """Whether a token is certainly an ordinary word, by its form alone."""
    return (token >= "a") & (token == F.lower(token)) & ~F.contains(token, F.lit(" ")) & ~token.rlike(r"^\p{N}") & ~_plain(token).isin(*NUMBER_WORDS, *UNITS)


def _plain_hash(raw: str, at: Column, width: int) -> Column:
    return F.xxhash64(F.lit(width), *[F.xxhash64(F.lower(_plain(F.get(raw, at + k)))) for k in range(width)])


def _sides(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Windows to join on: (item, item_at, hash, before, plain) by templates, and (item, item_at, hash, before, plain, width) verbatim.

    ``before`` is the hash of the item's window one token earlier, if that alone makes a place; ``plain`` is the hash of
    the plain tokens where those must agree too.
    """
    at = F.col("at")
    flagged = items.where(F.col("n") >= WINDOW).select("item", "raw", "soft", "n", F.transform("raw", _literal).alias("literal"))
    rich = lambda i: F.size(F.filter(F.slice("literal", i + 1, WINDOW), lambda x: x)) >= MIN_LITERALS
    windows = flagged.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - WINDOW)).alias("at")).withColumn("rich", rich(at))
    before = F.when((at > 0) & rich(F.greatest(at - 1, F.lit(0))), _hash("soft", at - 1, WINDOW))
    told = windows.join(windows.where("rich").select("item").distinct(), "item", "left_semi")
    soft = told.select("item", at.alias("item_at"), _hash("soft", at, WINDOW).alias("hash"), before.alias("before"), F.when(~F.col("rich"), _plain_hash("raw", at, WINDOW)).alias("plain"))
    rest = items.join(soft.select("item").distinct(), "item", "left_anti").select("item", "hard", "n")
    verbatim = []
    for width in range(1, WINDOW + 1):
        own = rest.where(F.col("n") >= WINDOW) if width == WINDOW else rest.where(F.col("n") == width)
        rows = own.select("item", "hard", F.explode(F.sequence(F.lit(0), F.col("n") - width)).alias("at"))
        before = F.when(at > 0, _hash("hard", at - 1, width))
        verbatim.append(rows.select("item", at.alias("item_at"), _hash("hard", at, width).alias("hash"), before.alias("before"), F.lit(None).cast("long").alias("plain"), F.lit(width).alias("width")))
    return soft, reduce(DataFrame.unionByName, verbatim)


def _places(rows: DataFrame, sides: DataFrame, hashes: str, width: int) -> DataFrame:
    """(doc, item, shift, width): the places where an item may lie in a row's tokens.

    A window that follows one of the same place is passed over, so a run of windows gives one row for each place.
    """
    sides, at = sides.select("item", "item_at", "hash", "before", "plain"), F.col("at")
    windows, earlier, own = _windows(rows, hashes, width, "doc", "raw"), F.when(at > 0, _hash(hashes, at - 1, width)), _plain_hash("raw", at, width)
    if small_enough(sides, MAX_BROADCAST):  # both are computed for joined rows alone
        joined = windows.join(F.broadcast(sides), "hash")
        fits, follows = F.col("plain") == own, F.col("before") == earlier
    else:
        joined = windows.select("doc", "at", "hash", earlier.alias("__earlier"), own.alias("__own")).join(sides, "hash")
        fits, follows = F.col("plain") == F.col("__own"), F.col("before") == F.col("__earlier")
    # Both sides' nulls: no plain tokens are asked for, nothing lies before.
    starts = joined.where((F.col("plain").isNull() | fits) & ~F.coalesce(follows, F.lit(False)))
    return starts.select("doc", "item", (at - F.col("item_at")).alias("shift"), F.lit(width).alias("width")).distinct()


def _aligned(places: DataFrame, items: DataFrame, hashes: str) -> DataFrame:
    """(doc, doc_id, item, theirs, ours, same): each place's tokens beside its item's, and whether their forms agree."""
    sizes = F.broadcast(items.select("item", "n")) if small_enough(items, MAX_BROADCAST) else items.select("item", "n")
    at = lambda column: F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda j: F.get(column, F.col("shift") + j))
    cut_out = places.join(sizes, "item").select("doc", "doc_id", "item", "shift", at("raw").alias("ours"), at(hashes).alias("__own")).distinct()
    side = items.select("item", F.col("raw").alias("theirs"), F.col(hashes).alias("__item"))
    side = F.broadcast(side) if small_enough(items, MAX_BROADCAST // WINDOW) else side
    same = F.zip_with("__own", "__item", lambda x, y: F.coalesce(x == y, F.lit(False)))
    return cut_out.join(side, "item").select("doc", "doc_id", "item", "theirs", "ours", F.col("__item").alias("form"), same.alias("same"))


def _matched(aligned: DataFrame, width: Column) -> DataFrame:
    """(doc, doc_id, item, found, slots): the windows whose forms agree, and the values of all slots between them."""
    starts = F.when(F.size("same") >= width, F.sequence(F.lit(0), F.size("same") - width)).otherwise(F.array().cast("array<int>"))
    found = F.filter(starts, lambda i: F.forall(F.slice("same", i + 1, width), lambda x: x))
    framed = aligned.withColumn("found", found).where(F.size("found") > 0)
    kinds = F.array(*[F.xxhash64(F.lit(k)) for k in (NUMBER, NAME, UNIT)])
    places = F.sequence(F.element_at("found", 1), F.element_at("found", -1) + width - 1)
    slots = F.filter(places, lambda j: F.get("same", j) & F.array_contains(kinds, F.get("form", j)))
    value = lambda side, j: F.lower(_plain(F.get(side, j)))
    pairs = F.array_distinct(F.transform(slots, lambda j: F.struct(F.get("form", j).alias("kind"), value("theirs", j).alias("a"), value("ours", j).alias("b"))))
    return framed.select("doc", "doc_id", "item", "found", pairs.alias("slots"))


def _consistent(slots: str) -> Column:
    """Whether distinct pairs of values are one to one."""
    side = lambda k: F.size(F.array_distinct(F.transform(slots, lambda p: F.struct(p["kind"], p[k]))))
    return (F.size(slots) == side("a")) & (F.size(slots) == side("b"))


def _found(docs: DataFrame, benchmark: DataFrame, min_coverage: float) -> DataFrame:
    """(doc, doc_id, item_id, n_windows, coverage, n_slots): the items found in each row, ``doc`` naming its id and text."""
    items = cut(_items(benchmark))
    soft, verbatim = (cut(x) for x in _sides(items))
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", row_key().alias("doc"))
    rows = _tokens(named, "doc", "doc_id")
    exact = rows.withColumn("hard", _verbatim("raw"))
    places = [_places(rows, soft, "soft", WINDOW).withColumn("form", F.lit("soft"))]
    widths = [w for (w,) in verbatim.select("width").distinct().collect()]  # WINDOW at most
    for width in widths:
        own = exact if width >= SHORT else exact.where(F.size("hard") == width)
        places.append(_places(own, verbatim.where(F.col("width") == width), "hard", width).withColumn("form", F.lit("hard")))
    found = cut(reduce(DataFrame.unionByName, places))
    # Only rows with a place are read again for their tokens, equal ones once.
    wanted = found.select("doc").distinct()
    wanted = F.broadcast(cut(wanted)) if small_enough(wanted, MAX_BROADCAST) else wanted
    again = _tokens(named.join(wanted, "doc", "left_semi").dropDuplicates(["doc"]), "doc", "doc_id")
    full = again.withColumn("hard", _verbatim("raw")).join(found, "doc")
    parts = [_matched(_aligned(full.where("form = 'soft'"), items, "soft"), F.lit(WINDOW))]
    parts += [_matched(_aligned(full.where((F.col("form") == "hard") & (F.col("width") == width)), items, "hard"), F.lit(width)) for width in widths]
    matched = reduce(DataFrame.unionByName, parts)
    sizes = items.select("item", "item_id", F.greatest(F.col("n") - (WINDOW - 1), F.lit(1)).alias("__total"))
    sizes = F.broadcast(sizes) if small_enough(items, MAX_BROADCAST) else sizes
    single = matched.where(_consistent("slots")).withColumns({"n": F.size("found"), "k": F.size("slots")})
    best = F.max(F.struct("n", -F.col("k")))
    union = F.array_distinct(F.flatten(F.collect_set("found")))
    values = F.array_distinct(F.flatten(F.collect_set("slots")))
    by = single.groupBy("doc", "doc_id", "item").agg(best.alias("best"), F.size(union).alias("n"), values.alias("slots"))
    # All places together if they agree with each other, else the best one.
    joint = _consistent("slots")
    n = F.when(joint, F.col("n")).otherwise(F.col("best.n"))
    n_slots = F.when(joint, F.size("slots")).otherwise(-F.col("best.col2"))
    rated = by.select("doc", "doc_id", "item", n.cast("long").alias("n_windows"), n_slots.cast("long").alias("n_slots")).join(sizes, "item")
    rated = rated.withColumn("coverage", F.col("n_windows") / F.col("__total")).where(F.col("coverage") >= min_coverage)
    return rated.select("doc", "doc_id", "item_id", "n_windows", "coverage", "n_slots")


def row_key() -> Column:
    """Names a row's id and text."""
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), F.col("doc_id").isNull(), F.coalesce("text", F.lit("")))


def matches(docs: DataFrame, benchmark: DataFrame, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """(doc_id, item_id, n_windows, coverage, n_slots): the items found in each document; of equal ids the best match."""
    found = _found(docs, benchmark, min_coverage)
    best = F.max(F.struct("coverage", "n_windows", "n_slots")).alias("m")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "m.n_windows", "m.coverage", "m.n_slots")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no item is found, with all their columns."""
    found = cut(_found(docs, benchmark, MIN_COVERAGE).select(F.col("doc").alias("__found_row")).distinct())
    side = F.broadcast(found) if small_enough(found, MAX_BROADCAST) else found
    return docs.join(side, row_key() == side["__found_row"], "left_anti")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).withColumn("contaminated", F.lit(True))
