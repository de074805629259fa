"""Tables on the way: written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a local session, where all is one process, may be without it."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not where:
        master = spark.sparkContext.master
        if not master.startswith("local") or "local-cluster" in master:
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sluice-"))
        where = spark.sparkContext.getCheckpointDir()
    return where.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written and read back: it is computed once, and a lost executor does not compute it again."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
