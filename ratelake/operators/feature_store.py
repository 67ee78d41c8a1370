"""A store of features under content keys: bucketed, sorted, and appended to by commits.

The data are one table, bucketed and sorted by ``cache_key``, so that a read by key shuffles the wanted rows alone and
never the store. Each append writes a part of its own and then commits it by moving a folder that holds the part's name to
the name of the append. That move is the one atomic step: an append that failed before it left rows that no reader sees,
and can be run again; of two that carry the same name (a job that is retried, or runs twice) the first to commit is taken,
the other's part stays unseen. Readers take the committed parts only. A key in two commits is read from the one that comes first by
name; rows of one key lie in one bucket, so that needs no shuffle either.
"""

from __future__ import annotations

from dataclasses import dataclass
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratelake.functions.columns import content_key
from ratelake.sources import files

BUCKETS = 64
#: Fixed columns of the store; a user's own ones stand beside ``features``.
KEY, PART = "cache_key", "part"


@dataclass(frozen=True)
class FeatureStore:
    """A store in ``folder`` (of storage that driver and executors share), known to the session as table ``name``."""

    spark: SparkSession
    folder: str
    schema: T.StructType
    buckets: int = BUCKETS

    @property
    def name(self) -> str:
        return f"features_{uuid_of(self.folder)}"

    def _known(self) -> str:
        """The table's name; it is declared in this session if need be, and other sessions' parts are looked up."""
        if not self.spark.catalog.tableExists(self.name):
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema.fields)
            self.spark.sql(f"create table `{self.name}` ({columns}, {PART} string) using parquet options (path '{self.folder}/data') partitioned by ({PART}) clustered by ({KEY}) sorted by ({KEY}) into {self.buckets} buckets")
        if files.exists(self.spark, f"{self.folder}/data"):
            self.spark.sql(f"alter table `{self.name}` recover partitions")
        return self.name

    def commits(self) -> dict[str, str]:
        """The committed part of each append, by the append's name."""
        at = f"{self.folder}/commits"
        return {name: files.names(self.spark, f"{at}/{name}")[0] for name in files.names(self.spark, at)}

    def write_part(self, features: DataFrame) -> str:
        """Writes rows (path or cache_key, and the store's columns) as a part that no reader sees yet; its name."""
        rows = features if KEY in features.columns else features.withColumn(KEY, content_key(F.col("path")))
        part = uuid4().hex
        rows = rows.select(*[F.col(f.name).cast(f.dataType) for f in self.schema.fields], F.lit(part).alias(PART))
        # Dealt like the buckets, so that a part has one file for each.
        dealt = rows.repartition(self.buckets, KEY)
        dealt.write.mode("append").format("parquet").partitionBy(PART).bucketBy(self.buckets, KEY).sortBy(KEY).option("path", f"{self.folder}/data").saveAsTable(self._known())
        return part

    def commit(self, name: str, part: str) -> bool:
        """Makes a part the one of append ``name``, unless it has one; whether it was taken."""
        if not name.replace("-", "").replace("_", "").isalnum():
            raise ValueError(f"not a name for an append: {name!r}")
        # A folder that holds the part's name gets the append's name: one atomic move, which fails if that name is taken.
        made = f"{self.folder}/commits/.{part}"
        files.touch(self.spark, f"{made}/{part}")
        taken = files.move(self.spark, made, f"{self.folder}/commits/{name}")
        if not taken:
            files.delete(self.spark, made)
        return taken

    def append(self, name: str, features: DataFrame) -> bool:
        """Appends rows under a name; nothing is written if that name has been committed."""
        if name in self.commits():
            return False
        return self.commit(name, self.write_part(features))

    def read(self) -> DataFrame:
        """(cache_key, and the store's columns) of all committed parts, each key once."""
        parts = self.commits()
        rows = self.spark.table(self._known()).where(F.col(PART).isin(list(parts.values())))
        if len(parts) > 1:
            order = F.array_position(F.array(*[F.lit(p) for p in parts.values()]), F.col(PART))
            rows = rows.withColumn("__first", F.row_number().over(Window.partitionBy(KEY).orderBy(order))).where("__first = 1").drop("__first")
        return rows.drop(PART)


def uuid_of(folder: str) -> str:
    """A name for a folder that is the same in every session."""
    from hashlib import md5

    return md5(folder.rstrip("/").encode()).hexdigest()[:16]


def store_schema(kind: str = "array<float>", extra: str = "") -> T.StructType:
    """cache_key, any extra columns, features."""
    return T.StructType.fromDDL(f"{KEY} string, {extra + ', ' if extra else ''}features {kind}")
