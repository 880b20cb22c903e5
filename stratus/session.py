"""Session construction and the shared checkpoint folder.

On a cluster the operator names a shared folder in ``spark.checkpoint.dir``;
every job that cuts lineage or lands intermediate tables writes below it.
Only when the setting is absent (local tests) do we pick a scratch folder.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(master: str = "local[8]", app: str = "stratus",
                  shuffle_partitions: int = 8, extra: dict | None = None) -> SparkSession:
    """Session tuned for this library: UTC, AQE on, UI off, Arrow on."""
    builder = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


class SharedDirMissing(RuntimeError):
    """A cluster session must name its shared folder in spark.checkpoint.dir."""


def shared_dir(spark: SparkSession) -> str:
    """The cluster-wide checkpoint folder (``spark.checkpoint.dir``).

    Only a local-mode session without the setting (tests, single-machine
    runs) gets a scratch folder; a cluster session without it is an error,
    since a machine-local folder is not visible to other executors.
    """
    current = spark.conf.get(CHECKPOINT_CONF, None)
    if not current:
        if not spark.sparkContext.master.startswith("local"):
            raise SharedDirMissing(f"set {CHECKPOINT_CONF} to a folder every executor can reach")
        current = tempfile.mkdtemp(prefix="stratus-ckpt-")
        spark.conf.set(CHECKPOINT_CONF, current)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(os.path.join(current, "rdd"))
    return current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder (never reused)."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")


def materialize(df, name: str):
    """Write ``df`` below the shared folder and read it back.

    Used before iterative consumers (MLlib fits, tuning grids): each pass
    then scans Parquet instead of replaying the window/join lineage, and a
    lost executor recomputes only its own file splits.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
