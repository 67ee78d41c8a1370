"""Writers: manifests, predictions, zipped predictions, clips."""

from __future__ import annotations

import csv
import io
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratelake.operators.shared import cut
from ratelake.sources.readers import MANIFEST, UNKNOWN_SOURCE


def as_manifest(df: DataFrame) -> DataFrame:
    """The seven columns in order; missing ones are NULL, a missing source is unknown."""
    present = [F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in MANIFEST.fields]
    return df.select(*present).fillna(UNKNOWN_SOURCE, ["source"])


def write_manifest(df: DataFrame, path: str, single: bool = False) -> None:
    out = as_manifest(df)
    (out.coalesce(1) if single else out).write.mode("overwrite").csv(path, header=True)


def write_predictions(df: DataFrame, path: str) -> None:
    """(sample_id, pred_score) as CSV."""
    df.select("sample_id", "pred_score").write.mode("overwrite").csv(path, header=True)


#: Bytes of CSV that are deflated at once, and that the driver holds at most (deflated).
_PIECE = 1 << 20


def _times(matrix: list[int], vector: int) -> int:
    """A product over GF(2) of a matrix, a number for each column's bits, and a vector of bits."""
    out = 0
    for column in matrix:
        if vector & 1:
            out ^= column
        vector >>= 1
    return out


def joined_crc(first: int, second: int, length: int) -> int:
    """The CRC-32 of two texts, one after the other, from theirs and the second one's length.

    A zero byte behind a text multiplies its remainder by a fixed matrix, so ``length`` of them by that matrix' power.
    """
    power = [0xEDB88320, *[1 << k for k in range(31)]]  # one zero bit
    for _ in range(3):
        power = [_times(power, column) for column in power]  # one zero byte
    while length:
        if length & 1:
            first = _times(power, first)
        power = [_times(power, column) for column in power]
        length >>= 1
    return first ^ second


def _deflated(rows: DataFrame) -> DataFrame:
    """(part, piece, size, crc, data): each partition's rows as CSV, in pieces deflated so that they can follow one another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, number, part = io.StringIO(), 0, TaskContext.get().partitionId()
        out = csv.writer(text, lineterminator="\n")

        def piece() -> pa.RecordBatch:
            raw = text.getvalue().encode()
            deflate = zlib.compressobj(wbits=-zlib.MAX_WBITS)
            data = deflate.compress(raw) + deflate.flush(zlib.Z_FULL_FLUSH)  # ends at a byte, and isn't the last block
            return pa.record_batch([pa.array([x]) for x in (part, number, len(raw), zlib.crc32(raw), data)], names=["part", "piece", "size", "crc", "data"])

        for batch in batches:
            for row in zip(*(column.to_pylist() for column in batch.columns)):
                out.writerow(["" if v is None else v for v in row])
                if text.tell() >= _PIECE:
                    yield piece()
                    number += 1
                    text.seek(0)
                    text.truncate()
        if text.tell():
            yield piece()

    return rows.mapInArrow(run, "part long, piece long, size long, crc long, data binary")


def zip_predictions(df: DataFrame, path: str, member: str = "predictions.csv") -> str:
    """One zip with one CSV member of a fixed name, in the order of ``df``.

    Tasks write and deflate the rows. The driver lays their pieces end to end, one in memory at a time, and joins their
    checksums; it sees no row. ``path`` is the driver's.
    """
    header = b"sample_id,pred_score\n"
    pieces = cut(_deflated(df.select("sample_id", "pred_score")))
    size, crc, n = len(header), zlib.crc32(header), 0
    deflate = zlib.compressobj(wbits=-zlib.MAX_WBITS)
    head = deflate.compress(header) + deflate.flush(zlib.Z_FULL_FLUSH)
    name, start = member.encode(), 30 + len(member.encode())
    with open(path, "wb") as f:
        f.write(bytes(start) + head)
        n = len(head)
        for row in pieces.orderBy("part", "piece").toLocalIterator():
            f.write(row["data"])
            size, crc, n = size + row["size"], joined_crc(crc, row["crc"], row["size"]), n + len(row["data"])
        last = zlib.compressobj(wbits=-zlib.MAX_WBITS).flush()
        f.write(last)
        n += len(last)
        if max(size, n) >= 1 << 32:
            raise ValueError("4 GB and more need another kind of archive")
        # Deflated, UTF-8 name, the earliest date that the format knows.
        told = struct.pack("<HHHHHIIIHH", 20, 0x800, 8, 0, 33, crc, n, size, len(name), 0)
        f.write(b"PK\1\2" + struct.pack("<H", 20) + told + struct.pack("<HHHII", 0, 0, 0, 0, 0) + name)
        f.write(b"PK\5\6" + struct.pack("<HHHHIIH", 0, 0, 1, 1, 46 + len(name), start + n, 0))
        f.seek(0)
        f.write(b"PK\3\4" + told + name)
    return path


def save_clips(clips: DataFrame, folder: str) -> None:
    """Keeps (sample_id, content) as Parquet; nothing is written for ids that are there."""
    spark = clips.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        clips = clips.join(spark.read.parquet(folder).select("sample_id"), "sample_id", "left_anti")
    clips.write.mode("append").parquet(folder)
