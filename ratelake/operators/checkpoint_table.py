"""Checkpoints of runs as versions under one pointer.

A save writes its rows into a folder of its own and then moves the pointer, a short file that lists the versions that
count, in one step. A save that dies before that leaves a folder that nothing reads, so what a run resumes from is always
a whole state: the last epoch, the best one so far and the periodic ones, with their parameters.
"""

from __future__ import annotations

from dataclasses import dataclass
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratelake.operators import runs
from ratelake.sources import files

SCHEMA = "run string, epoch long, dev double, param string, values array<double>"


@dataclass(frozen=True)
class CheckpointTable:
    """Checkpoints of any number of runs in ``folder``, of storage that driver and executors share."""

    spark: SparkSession
    folder: str

    @property
    def pointer(self) -> str:
        return f"{self.folder}/pointer"

    def versions(self) -> list[str]:
        """The versions that count, in the order of their saves."""
        return files.read_text(self.spark, self.pointer).split() if files.exists(self.spark, self.pointer) else []

    def write(self, rows: DataFrame) -> str:
        """Writes (run, epoch, dev, param, values) as a version that doesn't count yet; its name."""
        name = uuid4().hex
        wanted = self.spark.createDataFrame([], SCHEMA).schema
        rows.select(*[F.col(f.name).cast(f.dataType) for f in wanted.fields]).write.parquet(f"{self.folder}/versions/{name}")
        return name

    def publish(self, name: str) -> None:
        """Moves the pointer to the versions before and this one. One writer at a time."""
        files.replace_text(self.spark, self.pointer, "\n".join([*self.versions(), name]))

    def save(self, rows: DataFrame) -> None:
        self.publish(self.write(rows))

    def read(self) -> DataFrame:
        """All rows of the versions that count; of an epoch that was saved again the later rows."""
        parts = [f"{self.folder}/versions/{v}" for v in self.versions()]
        if not parts:
            return self.spark.createDataFrame([], SCHEMA)
        order = F.array_position(F.array(*[F.lit(v) for v in self.versions()]), F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))
        rows = self.spark.read.parquet(*parts).withColumn("__version", order)
        last = rows.groupBy("run", "epoch").agg(F.max("__version").alias("__version"))
        return rows.join(last, ["run", "epoch", "__version"], "left_semi").drop("__version")

    def history(self) -> DataFrame:
        """(run, epoch, dev) of every saved epoch."""
        return self.read().select("run", "epoch", "dev").distinct()

    def kept(self, every: int) -> DataFrame:
        """(run, kind, epoch, name, param, values): last, best and periodic checkpoints of each run."""
        return runs.checkpoints(self.history(), 0, every).join(self.read().drop("dev"), ["run", "epoch"]).select("run", "kind", "epoch", "name", "param", "values")

    def resume(self) -> DataFrame:
        """(run, next_epoch, best_dev, param, values): where each run goes on, with the parameters of its last epoch."""
        points = runs.resume_point(runs.with_progress(self.history()))
        rows = self.read().select("run", (F.col("epoch") + 1).alias("next_epoch"), "param", "values")
        return points.join(rows, ["run", "next_epoch"]).select("run", "next_epoch", "best_dev", "param", "values")

    def vacuum(self) -> None:
        """Deletes the folders of saves that never counted; not while a save is under way."""
        for name in set(files.names(self.spark, f"{self.folder}/versions")) - set(self.versions()):
            files.delete(self.spark, f"{self.folder}/versions/{name}")
