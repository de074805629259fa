"""The facts table: replay, memo, idempotency keys, sealing, budgets and costs as DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import hash_list, hash_string


def replay(df: DataFrame, facts: DataFrame, key: str, out: str) -> DataFrame:
    """df (execution_id, ...) with <out>__replayed and <out>__skipped from facts (execution_id, key, fact)."""
    mine = facts.filter(F.col("key") == key).select("execution_id", F.col("fact").alias(f"{out}__replayed"), F.lit(True).alias("_hit"))
    return df.join(mine, "execution_id", "left").withColumn(f"{out}__skipped", F.coalesce("_hit", F.lit(False))).drop("_hit")


def unsettled(df: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """Executions that have no fact for the key."""
    return df.join(facts.filter(F.col("key") == key), "execution_id", "left_anti")


def idempotency_key(execution_id: Column, node_key: str) -> Column:
    return hash_list(hash_string(execution_id), hash_string(F.lit(node_key)))


def memo_key(ref: str, inputs_hash: Column, params_hash: Column) -> Column:
    return hash_list(hash_string(F.lit(ref)), hash_string(inputs_hash), hash_string(params_hash))


def with_memo(df: DataFrame, memo: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """df with memo_value and cached, and the distinct keys still to be computed."""
    stored = memo.select(F.col("memo_key").alias(key), F.col("value").alias("memo_value"))
    joined = df.join(stored, key, "left").withColumn("cached", F.col("memo_value").isNotNull())
    return joined, df.select(key).dropDuplicates([key]).join(stored, key, "left_anti")


def sealed(content_hash: Column) -> Column:
    return F.struct(F.lit(True).alias("sealed"), content_hash.alias("contentHash"))


def budgeted(ready: DataFrame, ceilings: dict[str, int], used: DataFrame | None = None) -> DataFrame:
    """ready (execution_id, ord, cost_class, ...) with selected: a running count under what is left of each class's ceiling.

    used (execution_id, cost_class, ticks): what earlier waves have used.
    """
    w = Window.partitionBy("execution_id", "cost_class").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ceiling = F.create_map(*[F.lit(x) for kv in sorted(ceilings.items()) for x in kv]) if ceilings else F.create_map().cast("map<string,int>")
    most, before = F.try_element_at(ceiling, F.col("cost_class")), F.lit(0)
    if used is not None:
        ticks = used.groupBy("execution_id", "cost_class").agg(F.sum("ticks").alias("_ticks"))
        ready, before = ready.join(ticks, ["execution_id", "cost_class"], "left"), F.coalesce("_ticks", F.lit(0))
    return ready.withColumn("selected", most.isNull() | (F.count(F.lit(1)).over(w) + before <= most)).drop("_ticks")


def defer_costly(ready: DataFrame, order: list[str]) -> DataFrame:
    """ready with selected: only the best ranked class of each execution; unlisted classes come after, by name."""
    place = F.array_position(F.array(*map(F.lit, order)).cast("array<string>"), F.col("cost_class"))
    rank = F.when(place > 0, F.struct(place.alias("a"), F.lit("").alias("b"))).otherwise(F.struct(F.lit(len(order) + 1).cast("long").alias("a"), F.col("cost_class").alias("b")))
    best = F.min(rank).over(Window.partitionBy("execution_id"))
    return ready.withColumn("selected", rank == best)


def cost_used(rows: DataFrame) -> DataFrame:
    """Ticks by cost class: one for each attempt; classes without ticks are left out."""
    return rows.filter("cost_class <> 'none'").groupBy("cost_class").agg(F.sum("attempts").alias("ticks")).filter("ticks > 0")


def canonical_order(rows: DataFrame) -> DataFrame:
    return rows.orderBy("execution_id", "ord")
