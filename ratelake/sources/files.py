"""Small files in the storage that driver and executors share: exclusive and replacing moves, and short texts."""

from __future__ import annotations

from uuid import uuid4

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def filesystem(spark: SparkSession, path: str):
    """The path's file system and the path, as Spark sees them."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = filesystem(spark, path)
    return fs.exists(at)


def names(spark: SparkSession, folder: str) -> list[str]:
    """The names in a folder, in order, but for hidden ones; none if it isn't there."""
    fs, at = filesystem(spark, folder)
    found = [status.getPath().getName() for status in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(x for x in found if not x.startswith("."))


def touch(spark: SparkSession, path: str) -> None:
    """Makes an empty file and its folders."""
    fs, at = filesystem(spark, path)
    fs.create(at, False).close()


def delete(spark: SparkSession, path: str) -> None:
    fs, at = filesystem(spark, path)
    fs.delete(at, True)


def move(spark: SparkSession, source: str, target: str, replace: bool = False) -> bool:
    """One atomic move; whether it was done, which it isn't if the target is there and must not be replaced."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    (fs, a), (_, b) = filesystem(spark, source), filesystem(spark, target)
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = gateway.new_array(kind, int(replace))
    if replace:
        how[0] = kind.OVERWRITE
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(a.toUri(), spark._jsc.hadoopConfiguration()).rename(a, b, how)
    except Py4JJavaError:
        if replace or not fs.exists(b):
            raise
        return False
    return True


def read_text(spark: SparkSession, path: str) -> str:
    fs, at = filesystem(spark, path)
    held = fs.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(held, "UTF-8")
    finally:
        held.close()


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """Puts a short text in place of a file's; readers see the one or the other."""
    folder, _, name = path.rpartition("/")
    made = f"{folder}/.{name}-{uuid4().hex}"
    fs, at = filesystem(spark, made)
    out = fs.create(at, False)
    out.write(bytearray(text.encode()))
    out.close()
    move(spark, made, path, replace=True)
