"""Manifest plans: per-corpus parsers (rate, check existence, project), cap, split, union, normalise.

Order matters: cap before split before normalisation, whose statistics come from training rows only.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from pathlib import Path
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ratelake.functions.columns import first_token, join_path
from ratelake.operators import existence, normalize, sampling
from ratelake.sources import readers
from ratelake.sources.writers import as_manifest

#: Name prefixes of the subsets of the quality corpus that may be used, and the columns of its table.
QUALITY_SUBSETS = ("NISQA_TRAIN", "NISQA_VAL")
QUALITY_COLUMNS = {"db", "filepath_deg", "mos"}
SOURCE_ORDER = ("bvcc", "tmhint", "audiomos", "nisqa")


class Parsed(NamedTuple):
    """A corpus' manifest rows, and (file, line, reason) of the lines of its tables that could not be read."""

    rows: DataFrame
    rejected: DataFrame
    counts: DataFrame | None = None


def mean_rating(ratings: DataFrame, key: str, score: str) -> DataFrame:
    """(key, acr): mean over raters; missing keys and scores don't count."""
    return ratings.where(F.col(key).isNotNull()).groupBy(key).agg(F.avg(score).alias("acr"))


def project(rated: DataFrame, path: Column, acr: Column, language: str, system: Column, source: str, split: str = "train") -> DataFrame:
    """The manifest's seven columns; comparative scores are missing in all corpora."""
    return rated.select(path.alias("path"), acr.cast("double").alias("acr"), F.lit(None).cast("double").alias("ccr"), F.lit(language).alias("language"), system.alias("system"), F.lit(split).alias("split"), F.lit(source).alias("source"))


def parse_bvcc(spark: SparkSession, tables: dict[str, str], wav_dir: str, listing: DataFrame) -> Parsed:
    """Headerless listener ratings by split label (train, dev)."""
    parts, bad = [], []
    for label, path in tables.items():
        ratings, rejected = readers.checked_csv(spark, path, readers.LISTENER_RATINGS, "filename", header=False)
        rated = mean_rating(ratings, "filename", "score")
        parts.append(project(rated, join_path(F.lit(wav_dir), "filename"), F.col("acr"), "en", first_token(F.col("filename"), "-"), "bvcc", label))
        bad.append(rejected)
    return Parsed(existence.existing(reduce(DataFrame.unionByName, parts), listing, "path"), reduce(DataFrame.unionByName, bad))


def parse_tmhint(spark: SparkSession, table: str, wav_dir: str, listing: DataFrame) -> Parsed:
    ratings, rejected = readers.checked_csv(spark, table, "file_name string, quality_score double", "file_name")
    rated = mean_rating(ratings, "file_name", "quality_score")
    path = join_path(F.lit(wav_dir), F.concat("file_name", F.lit(".wav")))
    return Parsed(existence.existing(project(rated, path, F.col("acr"), "zh", first_token(F.col("file_name"), "_"), "tmhint"), listing, "path"), rejected)


def parse_audiomos(spark: SparkSession, table: str, wav_dir: str, listing: DataFrame) -> Parsed:
    """One row per clip already."""
    rows, rejected = readers.checked_csv(spark, table, "filename string, mos double, sr integer", "filename")
    return Parsed(existence.existing(project(rows, join_path(F.lit(wav_dir), "filename"), F.col("mos"), "en", F.lit("unknown"), "audiomos"), listing, "path"), rejected)


def parse_nisqa(spark: SparkSession, folder: str, listing: DataFrame, pattern: str = "NISQA_corpus*.csv") -> Parsed | None:
    """Rows of the usable subsets, with (subset, n_kept, n_missing) as ``counts``; None if the corpus isn't there."""
    table = readers.discover(spark, folder, pattern, QUALITY_COLUMNS)
    if table is None:
        return None
    rows, rejected = readers.checked_csv(spark, table, "db string, filepath_deg string, mos double", "filepath_deg")
    usable = reduce(lambda a, b: a | b, [F.col("db").startswith(p) for p in QUALITY_SUBSETS])
    made = project(rows.where(usable), join_path(F.lit(folder), "filepath_deg"), F.col("mos"), "en", F.col("db"), "nisqa")
    counts = existence.kept_and_missing(made, listing, "path", "system")
    return Parsed(existence.existing(made, listing, "path"), rejected, counts)


def chosen(parts: dict[str, DataFrame], wanted: Iterable[str], folders: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """The parts that are asked for and there; a source with a folder in ``folders`` is there if that folder is."""
    asked = set(wanted)
    there = lambda s: s not in (folders or {}) or Path(folders[s]).is_dir()
    return {s: p for s, p in parts.items() if s in asked and there(s)}


def build(parts: dict[str, DataFrame], cap: int | None = None, per_source_z: bool = False, respect_split: bool = False) -> DataFrame:
    """One manifest of several sources; requested sources that are absent are simply not in ``parts``."""
    ordered = [parts[s] for s in SOURCE_ORDER if s in parts] + [p for s, p in parts.items() if s not in SOURCE_ORDER]
    capped = [sampling.cap(as_manifest(p), "source", "path", cap) for p in ordered]
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), capped)
    whole = whole if respect_split else sampling.split(whole, "source", "path")
    if per_source_z:
        whole = normalize.normalized(whole, "source", "acr")
    return as_manifest(whole)


def dev_acr(samples: DataFrame, folder: str) -> DataFrame:
    """(sample_id, path) of the rated clips."""
    return samples.select("sample_id", join_path(F.lit(folder), F.concat("sample_id", F.lit(".flac"))).alias("path"))


def dev_ccr(samples: DataFrame, folder: str) -> DataFrame:
    """(sample_id, path_a, path_b) of the compared clips."""
    side = lambda s: join_path(F.lit(folder), F.concat("sample_id", F.lit(f"_{s}.flac"))).alias(f"path_{s}")
    return samples.select("sample_id", side("a"), side("b"))
