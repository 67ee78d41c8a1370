"""Readers: rating files with explicit schemas, schema discovery, file listings, binary clips, archives."""

from __future__ import annotations

import tarfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratelake.functions.columns import missing_as_null


def _schema(ddl: str) -> T.StructType:
    """name type, ... of plain types, without needing a session."""
    out = T.StructType()
    for part in ddl.split(","):
        out.add(*part.split())
    return out


LISTENER_RATINGS = _schema("system_id string, filename string, score double, session_id string, listener_info string")
#: Columns, in order, of the manifest, whose missing values are NULL inside and empty in CSV.
MANIFEST = _schema("path string, acr double, ccr double, language string, system string, split string, source string")
UNKNOWN_SOURCE = "unknown"


def csv(spark: SparkSession, path: str, schema: T.StructType | str, header: bool = True) -> DataFrame:
    """CSV by an explicit schema, matched by name where there is a header; NaN and empty become NULL."""
    if isinstance(schema, str):
        schema = _schema(schema)
    if not header:
        df = spark.read.schema(schema).csv(path, header=False)
    else:
        names = spark.read.option("header", True).csv(path).columns
        kinds = {f.name: f.dataType for f in schema.fields}
        full = T.StructType([T.StructField(n, kinds.get(n, T.StringType())) for n in names])
        df = spark.read.schema(full).option("enforceSchema", False).csv(path, header=True)
        df = df.select(*[n for n in kinds if n in names])
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({c: missing_as_null(F.col(c)) for c in doubles}) if doubles else df


_BROKEN = "__broken"


def checked_csv(spark: SparkSession, path: str, schema: T.StructType | str, key: str, header: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected): a CSV by an explicit schema, and (file, line, reason) of the lines that don't fit it.

    All values are read as text and cast afterwards, so that a line whose number is none is told from one whose number is
    missing (empty or NaN), which stays with NULL. A line with more or fewer values than columns is rejected whole, and so
    is one without its ``key``.
    """
    if isinstance(schema, str):
        schema = _schema(schema)
    there = spark.read.option("header", True).csv(path).columns if header else schema.names
    if lacking := set(schema.names) - set(there):
        raise AssertionError(f"no columns {sorted(lacking)} in {path}; seen {there}")
    texts = T.StructType([T.StructField(n, T.StringType()) for n in [*there, _BROKEN]])
    # With columns pruned Spark would not count a line's values.
    read = spark.read.schema(texts).option("mode", "PERMISSIVE").option("columnPruning", False).option("columnNameOfCorruptRecord", _BROKEN).option("enforceSchema", not header)
    lines = read.csv(path, header=header).withColumn("__file", F.col("_metadata.file_path"))
    reason = F.when(F.col(_BROKEN).isNotNull(), F.lit("columns"))
    for f in schema.fields:
        text = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            continue
        wrong = text.isNotNull() & (F.lower(F.trim(text)) != "nan") & text.try_cast(f.dataType).isNull()
        reason = F.coalesce(reason, F.when(wrong, F.lit(f"{f.name} is not {f.dataType.simpleString()}")))
    reason = F.coalesce(reason, F.when(F.col(f"`{key}`").isNull(), F.lit(f"no {key}")))
    marked = lines.withColumn("__reason", reason)
    line = F.coalesce(F.col(_BROKEN), F.concat_ws(",", *[F.coalesce(F.col(f"`{n}`"), F.lit("")) for n in there]))
    rejected = marked.where(F.col("__reason").isNotNull()).select(F.col("__file").alias("file"), line.alias("line"), F.col("__reason").alias("reason"))
    good = marked.where(F.col("__reason").isNull()).select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in schema.fields])
    doubles = [f.name for f in schema.fields if isinstance(f.dataType, T.DoubleType)]
    return good.withColumns({c: missing_as_null(F.col(c)) for c in doubles}) if doubles else good, rejected


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """A manifest CSV; a file without ``source`` reads as unknown."""
    df = csv(spark, path, MANIFEST)
    for field in MANIFEST.fields:
        if field.name not in df.columns:
            df = df.withColumn(field.name, F.lit(None).cast(field.dataType))
    return df.select(*MANIFEST.names).fillna(UNKNOWN_SOURCE, ["source"])


def listing(spark: SparkSession, folder: str, pattern: str = "*.wav") -> DataFrame:
    """(path) of all files below a folder; contents aren't read. Sort by path where order matters."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return files.select(F.regexp_replace("path", "^file:/*", "/").alias("path"))


def binary(spark: SparkSession, folder: str, pattern: str = "*.wav") -> DataFrame:
    """(path, content) of all files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return files.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), "content")


def discover(spark: SparkSession, folder: str, pattern: str, needed: set[str]) -> str | None:
    """The first file by name that has all ``needed`` columns; None without files, an error if none fits."""
    paths = [r[0] for r in listing(spark, folder, pattern).orderBy("path").collect()]  # a corpus has a handful of tables
    seen = {}
    for path in paths:
        seen[path] = spark.read.option("header", True).csv(path).columns
        if needed <= set(seen[path]):
            return path
    if paths:
        raise AssertionError(f"no table with {sorted(needed)}; seen {seen}")
    return None


def embedded_audio(spark: SparkSession, path: str) -> DataFrame:
    """(sample_id, content) of a Parquet set whose ``audio`` struct holds undecoded bytes."""
    return spark.read.parquet(path).select("sample_id", F.col("audio.bytes").alias("content"))


def extract(archive: str, out: str) -> list[str]:
    """Unpacks .zip, .tar.gz and .tgz; members that point outside are refused; other files are ignored."""
    target = Path(out).resolve()
    target.mkdir(parents=True, exist_ok=True)
    if archive.endswith(".zip"):
        with zipfile.ZipFile(archive) as z:
            for name in z.namelist():
                if not (target / name).resolve().is_relative_to(target):
                    raise ValueError(f"member outside the folder: {name}")
            z.extractall(target)
            return z.namelist()
    if archive.endswith((".tar.gz", ".tgz")):
        with tarfile.open(archive) as t:
            t.extractall(target, filter="data")
            return t.getnames()
    return []


def fetch(url: str, dest: str, chunk: int = 8192) -> str:
    """Downloads in chunks unless the file is there; an HTTP error fails. Needs a network."""
    from urllib.request import urlopen

    if not Path(dest).exists():
        part = Path(f"{dest}.part")
        with urlopen(url) as response, part.open("wb") as f:
            while block := response.read(chunk):
                f.write(block)
        part.rename(dest)
    return dest


def valid_zip(path: str) -> bool:
    """Whether an archive is whole; a broken one is deleted."""
    if zipfile.is_zipfile(path):
        return True
    Path(path).unlink(missing_ok=True)
    return False
