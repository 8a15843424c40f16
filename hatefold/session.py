"""Session helpers: a tuned local session for tests, and shared scratch space.

On a cluster the caller owns the session; nothing here overrides settings that
are already present. Scratch output always goes under ``spark.checkpoint.dir``
(a shared folder on a cluster); a private temporary folder is only created when
that setting is absent and the session is a local one, as in tests.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # Fail instead of silently accepting pandas <-> Arrow type drift.
    "spark.sql.execution.pandas.convertToArrowArraySafely": "true",
}


def get_spark(master: str | None = None, shuffle_partitions: int = 8,
              app: str = "hatefold", driver_memory: str = "16g") -> SparkSession:
    builder = (SparkSession.builder
               .master(master or os.environ.get("HATEFOLD_MASTER", "local[8]"))
               .appName(app)
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", driver_memory))
    for k, v in _LOCAL_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster, or a private one of a
    local session. A cluster without the setting is an error: a folder of the
    driver's own disk would not reach the executors."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, never-reused folder under the checkpoint root."""
    root = checkpoint_root(spark)
    sep = "" if root.endswith("/") else "/"
    return f"{root}{sep}hatefold-{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back: cuts the lineage,
    survives the loss of executors, and fixes what is not deterministic."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
