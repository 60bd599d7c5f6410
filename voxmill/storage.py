"""Where intermediate tables live that cut a lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses ``spark.checkpoint.dir``; a temporary folder only on a local master without it."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="voxmill-")
    sc.setCheckpointDir(path)


def scratch(spark: SparkSession) -> str:
    """A new folder's path below the shared folder; it stays until that is cleared, since lazy results read it."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/tables/{uuid.uuid4().hex}"


def fixed(df: DataFrame) -> DataFrame:
    """``df`` computed once and stored as a table, so that what hangs on its partitions cannot change."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
