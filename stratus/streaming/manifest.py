"""Which folders make up the stores of a stream: a list of versions, one JSON file each.

A batch writes its rows to fresh folders and then commits them: one appended file that
names every folder of every store as of that batch.  Readers take the newest version, so
they see a batch whole or not at all, and a compaction is one more version.  A batch that
is run again starts from the newest version of the batches before it, whatever was
committed under its own id, compacted or not; so replaying changes nothing.

One stream writes a root.  :func:`vacuum` deletes what neither the newest version nor a
replay of its batch needs.
"""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERSION = "version long, batch_id long, note string, folders map<string, array<string>>"


@dataclass
class State:
    """The stores as of one version: folder names by store, and what the writer noted."""
    version: int = 0
    batch_id: int = -1
    note: str | None = None
    folders: dict[str, list[str]] = field(default_factory=dict)


def _log(root: str) -> str:
    return os.path.join(root, "versions")


def _versions(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(VERSION).json(_log(root))


def begin(spark: SparkSession, root: str) -> None:
    """An empty list of versions, unless there is one."""
    spark.createDataFrame([], VERSION).write.mode("ignore").json(_log(root))


def state(spark: SparkSession, root: str, before_batch: int | None = None) -> State:
    """The newest version (of the batches before ``before_batch``)."""
    rows = _versions(spark, root)
    if before_batch is not None:
        rows = rows.where(F.col("batch_id") < before_batch)
    newest = rows.orderBy(F.col("version").desc()).first()
    return State(**newest.asDict()) if newest else State()


def write(df: DataFrame, root: str, store: str) -> str:
    """Write rows to a fresh folder of a store; its name."""
    name = uuid.uuid4().hex
    df.write.parquet(os.path.join(root, store, name))
    return name


def commit(spark: SparkSession, root: str, batch_id: int, folders: dict[str, list[str]], note: str | None = None) -> None:
    """Append a version.  One file, so it appears whole or not at all."""
    version = state(spark, root).version + 1
    (spark.createDataFrame([(version, batch_id, note, folders)], VERSION).coalesce(1).write.mode("append").json(_log(root)))


def paths(root: str, now: State, store: str) -> list[str]:
    return [os.path.join(root, store, name) for name in now.folders.get(store, [])]


def read(spark: SparkSession, root: str, now: State, store: str, schema: T.StructType) -> DataFrame:
    """Rows of a store as of a version; none if it has no folder."""
    where = paths(root, now, store)
    return spark.read.schema(schema).parquet(*where) if where else spark.createDataFrame([], schema)


def vacuum(spark: SparkSession, root: str) -> None:
    """Delete the versions, and the folders, that no reader of the newest version and no replay of its batch needs."""
    now = state(spark, root)
    kept = max(state(spark, root, now.batch_id).version, 0)
    rows = _versions(spark, root).select("version", "folders", F.col("_metadata.file_path").alias("file")).collect()
    needed = {(store, name) for r in rows if r.version >= kept for store, names in r.folders.items() for name in names}
    known = {(store, name) for r in rows for store, names in r.folders.items() for name in names}
    for target in [os.path.join(root, store, name) for store, name in known - needed] + [r.file for r in rows if r.version < kept]:
        path = spark._jvm.org.apache.hadoop.fs.Path(target)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
