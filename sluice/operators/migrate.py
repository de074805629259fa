"""Migration of facts to another version of a graph, as joins against its positions.

Positions are the keys a graph can have, `*` in place of a fan-out index; they are few
and known on the driver, so the facts side streams past a broadcast table whose size is
that of the graph. A fact's key is walked segment by segment to its position: below a
fan-out a number is an index, elsewhere it is a name like any other, and each level's
renames are applied on the way. Facts with a `$in` segment are carried as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.graph import Graph


class AckRequired(Exception):
    def __init__(self, keys: list[str]):
        super().__init__("kernel/migration_ack")
        self.keys = keys


def positions(graph: Graph, prefix: str = "") -> Iterator[tuple[str, str, bool, bool]]:
    """(key, derivation, effectful, static) of every position."""
    for id_, n in sorted(graph.nodes.items()):
        key = prefix + id_
        yield key, graph.derivations[id_], n.effectful, "*" not in prefix
        if n.species == "invoke":
            yield from positions(n.child, key + "/")
        if n.species == "map":
            yield f"{key}/*", graph.derivations[id_], n.effectful, False
            if n.child is not None:
                yield from positions(n.child, f"{key}/*/")


def _levels(graph: Graph, prefix: str = "") -> Iterator[tuple[str, Graph]]:
    yield prefix, graph
    for id_, n in graph.nodes.items():
        if n.child is not None:
            yield from _levels(n.child, f"{prefix}{id_}/*/" if n.species == "map" else f"{prefix}{id_}/")


def _walked(key: Column, graph: Graph, renames: bool) -> Column:
    """The position of a key (`p`) and the key itself (`k`), after the renames of each level if wanted."""
    fans = [prefix + id_ for prefix, g in _levels(graph) for id_, n in g.nodes.items() if n.species == "map"]
    moves = [(prefix + old, new) for prefix, g in _levels(graph) for old, new in (g.spec.get("renames") or {}).items()] if renames else []
    fan = F.array(*map(F.lit, fans)).cast("array<string>")
    move = F.create_map(*[F.lit(x) for m in moves for x in m]) if moves else None

    def step(at: Column, seg: Column) -> Column:
        index = F.array_contains(fan, at["p"]) & seg.rlike("^(0|[1-9][0-9]*)$")
        joined = lambda a, b: F.when(a == "", b).otherwise(F.concat(a, F.lit("/"), b))
        name = seg if move is None else F.coalesce(F.try_element_at(move, joined(at["p"], seg)), seg)
        return F.struct(joined(at["p"], F.when(index, "*").otherwise(name)).alias("p"), joined(at["k"], F.when(index, seg).otherwise(name)).alias("k"))

    return F.aggregate(F.split(key, "/"), F.struct(F.lit("").alias("p"), F.lit("").alias("k")), step)


def classify(facts: DataFrame, graph: Graph) -> DataFrame:
    """facts (execution_id, key, derivation) with classification, new_key and needs_ack."""
    spark: SparkSession = facts.sparkSession
    table = spark.createDataFrame(list(positions(graph)), "p_key string, p_derivation string, p_effectful boolean, p_static boolean")
    rows = facts.withColumn("_w", _walked(F.col("key"), graph, False)["p"]).withColumn("_r", _walked(F.col("key"), graph, True))
    here = F.broadcast(table.select(F.col("p_key").alias("_p1"), F.col("p_derivation").alias("d1"), F.col("p_effectful").alias("e1")))
    moved = F.broadcast(table.select(F.col("p_key").alias("_p2"), F.col("p_derivation").alias("d2"), F.col("p_effectful").alias("e2")))
    joined = rows.join(here, F.col("_w") == F.col("_p1"), "left").join(moved, F.col("_r.p") == F.col("_p2"), "left")
    caller = F.array_contains(F.split("key", "/"), "$in")
    carry = F.col("d1") == F.col("derivation")
    rename = (F.col("d2") == F.col("derivation")) & (F.col("_r.k") != F.col("key"))
    kind = F.when(caller, "caller").when(carry, "carry").when(rename, "rename").when(F.col("d1").isNotNull() | F.col("d2").isNotNull(), "invalidate").otherwise("orphan")
    with_kind = joined.withColumn("classification", kind)
    return with_kind.select(
        *facts.columns,
        "classification",
        F.when(F.col("classification").isin("carry", "caller"), F.col("key")).when(F.col("classification") == "rename", F.col("_r.k")).alias("new_key"),
        ((F.col("classification") == "invalidate") & F.coalesce("e2", "e1", F.lit(False))).alias("needs_ack"),
    )


def new_positions(classified: DataFrame, graph: Graph) -> DataFrame:
    """Statically known positions of the graph that have no surviving fact, for each execution."""
    keys = [k for k, _, _, static in positions(graph) if static]
    every = classified.select("execution_id").distinct().withColumn("new_key", F.explode(F.array(*map(F.lit, keys))))
    return every.join(classified.filter("new_key is not null").select("execution_id", "new_key"), ["execution_id", "new_key"], "left_anti")


def migrate(facts: DataFrame, graph: Graph, acknowledge: bool = False) -> DataFrame:
    """The facts that survive, under their new keys; a column node (of the provenance) follows a rename.

    Effects to be repeated must be acknowledged: the error names all their distinct keys.
    """
    classified = classify(facts, graph)
    if not acknowledge:
        keys = [r["key"] for r in classified.filter("needs_ack").select("key").distinct().orderBy("key").collect()]
        if keys:
            raise AckRequired(keys)
    kept = classified.filter("new_key is not null").withColumn("key", F.col("new_key"))
    if "node" in facts.columns:
        kept = kept.withColumn("node", F.when(F.col("classification") == "rename", F.col("new_key")).otherwise(F.col("node")))
    return kept.drop("new_key", "classification", "needs_ack")
