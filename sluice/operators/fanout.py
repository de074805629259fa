"""Fan-out over an array column, two ways with one result.

in_place      transform over the array: no shuffle, for pure Column bodies.
exploded      a row per child, then gathered: for bodies that need rows of their own.

A child is an envelope {status, value, code, idx}. Without absorb the lowest failing
index fails the node. An empty array gives an empty gather; a NULL is no sequence.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import MAX_WIDTH

Child = Callable[[Column], tuple[Column, Column]]  # element -> value, error code or NULL


def _envelope(item: Column, index: Column, child: Child) -> Column:
    value, code = child(item)
    return F.struct(
        F.when(code.isNull(), "ok").otherwise("error").alias("status"), F.when(code.isNull(), value).alias("value"), code.alias("code"), index.cast("int").alias("idx")
    )


def _settled(gather: Column, width: Column, sequence: Column, absorb: bool) -> dict[str, Column]:
    first = F.array_min(F.transform(F.filter(gather, lambda e: e["status"] == "error"), lambda e: e["idx"]))
    error = F.when(~sequence, "kernel/fanout").when(width > MAX_WIDTH, "kernel/bounds")
    if not absorb:
        error = error.when(first.isNotNull(), "kernel/fanout_child")
    return {"gather": F.when(error.isNull(), gather), "error": error, "failed_index": F.when(sequence, first)}


def in_place(df: DataFrame, over: str, child: Child, out: str, absorb: bool = False) -> DataFrame:
    """df with <out>__gather, <out>__error and <out>__failed_index."""
    items = F.coalesce(F.col(over), F.array().cast(df.schema[over].dataType))
    gather = F.transform(items, lambda x, i: _envelope(x, i, child))
    got = df.withColumn(f"{out}__all", gather)
    made = _settled(F.col(f"{out}__all"), F.size(items), F.col(over).isNotNull(), absorb)
    return got.withColumns({f"{out}__{k}": c for k, c in made.items()}).drop(f"{out}__all")


def exploded(df: DataFrame, key: str, over: str, child: Child, out: str, absorb: bool = False) -> DataFrame:
    """The same by rows: key must be unique. Parents without items come back by the outer join."""
    rows = df.select(key, F.posexplode(over).alias("_i", "_x"))
    children = rows.select(key, _envelope(F.col("_x"), F.col("_i"), child).alias("_e"))
    gathered = children.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col("_e.idx").alias("at"), F.col("_e").alias("e")))).alias("_g"))
    joined = df.join(gathered, key, "left").withColumn("_all", F.transform("_g", lambda g: g["e"]))
    empty = F.filter(F.transform(F.array(F.lit(0)), lambda x: _envelope(F.lit(None).cast(df.schema[over].dataType.elementType), x, child)), lambda e: F.lit(False))
    joined = joined.withColumn("_all", F.coalesce("_all", empty))
    made = _settled(F.col("_all"), F.coalesce(F.size(over), F.lit(0)), F.col(over).isNotNull(), absorb)
    return joined.withColumns({f"{out}__{k}": c for k, c in made.items()}).drop("_g", "_all")
