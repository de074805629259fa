"""Re-entry on a stream: new caller facts unblock executions that wait for them.

Each micro-batch of facts joins the stored ones of the same executions, the executions
are run again, and what they commit is written. What a batch brings and what its run
commits are two folders named by the batch, which are written over when a batch is
delivered twice, so neither a replay nor a failure between them leaves a fact twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.runtime import Capabilities, entry_facts, reports
from ..plans.graph import Graph

SCHEMA = "execution_id string, key string, fact string, batch long, made_by string"


def stored_facts(spark, path: str) -> DataFrame:
    """The facts so far: execution_id, key, fact, batch, made_by (caller or run)."""
    return spark.read.schema(SCHEMA).parquet(path)


def on_batch(graph: Graph, path: str, caps: Callable[[], Capabilities] = Capabilities) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function over facts (execution_id, key, fact); the facts table lies at path."""

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        folder = lambda by: f"{path}/batch={batch_id}/made_by={by}"
        batch.select("execution_id", "key", "fact").write.mode("overwrite").parquet(folder("caller"))
        brought = spark.read.schema("execution_id string, key string, fact string").parquet(folder("caller"))
        # A batch that comes again does not read what its own run has written before.
        known = stored_facts(spark, path).filter((F.col("batch") < batch_id) | (F.col("batch") == batch_id) & (F.col("made_by") == "caller"))
        known = known.join(brought.select("execution_id").distinct(), "execution_id", "left_semi").select("execution_id", "key", "fact").distinct()
        reports(graph, entry_facts(known), caps).facts.select("execution_id", "key", "fact").write.mode("overwrite").parquet(folder("run"))

    return run
