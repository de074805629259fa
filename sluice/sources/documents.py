"""JSON text to values at scale: strict ingestion with reasons, good and bad rows split."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import Reject, ingest, render, structural_hash


def ingested(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, canonical JSON, structural hash and reject_reason of each text; a NULL text gives NULLs.

    Spark's own parser takes lone surrogates and integers beyond 2**53, so the strict
    reading runs in Arrow batches; nothing is raised on an executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for raw in batch.column(1).to_pylist():
                try:
                    value = ingest(raw) if raw is not None else None
                    rows.append((None, None, None) if raw is None else (render(value), structural_hash(value), None))
                except Reject as why:
                    rows.append((None, None, why.reason))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.string()) for c in cols]], names=["key", "canonical", "hash", "reject_reason"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, canonical string, hash string, reject_reason string")


def split_bad(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return df.filter("reject_reason is null"), df.filter("reject_reason is not null")


def manifest(df: DataFrame, expected: DataFrame) -> DataFrame:
    """Both-way comparison of files (path, content) with expected (path, sha256): path, state."""
    have = df.select("path", F.sha2("content", 256).alias("have"))
    state = F.when(F.col("have").isNull(), "missing").when(F.col("sha256").isNull(), "extra").when(F.col("have") == F.col("sha256"), "same").otherwise("changed")
    return have.join(expected, "path", "full_outer").select("path", state.alias("state"))
