import json
import random

from pyspark.sql import functions as F

from sluice.operators.fanout import exploded, in_place
from sluice.operators.migrate import AckRequired, migrate
from sluice.plans import predicates as P
from sluice.plans.graph import compile_graph
from sluice.plans.registry import stock_registry
from sluice.queries import QUERIES
from sluice.sources.documents import ingested, manifest, split_bad
from sluice.streaming.reentry import entry_facts, on_batch


def test_lowered_predicates_equal_the_evaluator(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([None, 0.0, 1.0, 2.5, -3.0]), rng.choice([None, "", "a", "b"]), rng.choice([None, True, False]), rng.choice([None, [], [1.0], [1.0, 2.5, 7.0]])) for i in range(80)]
    df = spark.createDataFrame(rows, "i int, n double, s string, b boolean, l array<double>")
    kinds = {"n": "number", "s": "string", "b": "boolean", "l": "list"}
    texts = [
        "n > 1", "!(n == 1)", "n != 1", "n != s", "!(n < s)", 's <= "a"', "b", "!b", "b && n >= 0", "b || absent(s)", "present(l)", "size(l) >= 1", "size(s) == 1", "l[0] == 1", "l.2 > 5", "n in [1, 2.5, \"a\"]", "n in l",
        "n * 2 - 1 == 4", "n * 1e308 > 0", "zz == 1", "!(zz == 1) && n in [0]", "s + 1 == 2", "s == null",
    ]

    def resolve(path):
        if path[0] not in kinds:
            return None
        t = P.Typed(F.col(path[0]), kinds[path[0]])
        return P.Typed(F.get(t.column, F.lit(path[1])), "number") if len(path) > 1 else t

    got = df.select("i", *[P.lower(P.parse(t), resolve).column.alias(f"p{k}") for k, t in enumerate(texts)]).collect()
    env = {r[0]: {k: v for k, v in zip("nsbl", r[1:], strict=True) if v is not None} for r in rows}
    numbers = lambda v: [numbers(x) for x in v] if isinstance(v, list) else int(v) if isinstance(v, float) and v == int(v) else v
    for r in got:
        mine = {k: numbers(v) for k, v in env[r["i"]].items()}
        for k, t in enumerate(texts):
            assert bool(r[f"p{k}"]) == (P.evaluate(P.parse(t), mine) is True), (t, mine)


def test_fan_out_both_ways(spark):
    df = spark.createDataFrame([(1, [1.0, 50.0]), (2, []), (3, None), (4, [2.0])], "k long, q array<double>")
    child = lambda x: (x * 2, F.when(x > 45, "t/over"))
    for absorb in (False, True):
        a = {r.k: r for r in in_place(df, "q", child, "m", absorb).collect()}
        b = {r.k: r for r in exploded(df, "k", "q", child, "m", absorb).collect()}
        assert {k: (r.m__gather, r.m__error, r.m__failed_index) for k, r in a.items()} == {k: (r.m__gather, r.m__error, r.m__failed_index) for k, r in b.items()}
        assert a[2].m__gather == [] and a[3].m__error == "kernel/fanout"
        assert (a[1].m__error, a[1].m__failed_index) == ((None if absorb else "kernel/fanout_child"), 1)


def test_migration_needs_acknowledgement(spark):
    spec = lambda v: {"name": "g", "nodes": [{"id": "s", "routine": "vec/keyecho@1", "in": {"in": "c"}}, {"id": "c", "routine": "vec/const@1", "params": {"value": v}}], "exports": [{"name": "o", "from": "s"}]}
    old, new = (compile_graph(spec(v), stock_registry()) for v in (1, 2))
    facts = spark.createDataFrame([("x", "s", old.derivations["s"]), ("x", "c", old.derivations["c"]), ("x", "$in/q", "")], "execution_id string, key string, derivation string")
    try:
        migrate(facts, new)
        raise AssertionError
    except AckRequired as why:
        assert why.keys == ["s"]
    assert [r.key for r in migrate(facts, new, acknowledge=True).collect()] == ["$in/q"]
    assert {r.key for r in migrate(facts, old).collect()} == {"s", "c", "$in/q"}


def test_ingestion_and_manifest(spark):
    df = spark.createDataFrame([(1, '{"b":1.0,"a":[null]}'), (2, "9007199254740993"), (3, None)], "k long, t string")
    good, bad = split_bad(ingested(df, "k", "t"))
    assert {r.key: r.canonical for r in good.collect()} == {1: '{"a":[null],"b":1}', 3: None}
    assert [r.reject_reason for r in bad.collect()] == ["integer_range"]
    have = spark.createDataFrame([("a", bytearray(b"x")), ("b", bytearray(b"y"))], "path string, content binary")
    want = spark.createDataFrame([("a", "2d711642b726b04401627ca9fbac32f5c8530fb1903cc4db02258717921a4881"), ("c", "0")], "path string, sha256 string")
    assert {r.path: r.state for r in manifest(have, want).collect()} == {"a": "same", "b": "extra", "c": "missing"}


def test_stream_re_entry(spark, tmp_path):
    g = compile_graph({"name": "g", "inputs": {"x": {}, "y": {}}, "nodes": [{"id": "p", "routine": "vec/pack@1", "in": {"a0": "$input.x", "a1": "$input.y"}}], "exports": [{"name": "o", "from": "p"}]}, stock_registry())
    src, facts = str(tmp_path / "in"), str(tmp_path / "facts")
    schema = "execution_id string, key string, fact string"
    for rows in ([("e1", "$in/x", "1")], [("e1", "$in/y", '"two"'), ("e2", "$in/x", "3")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        q = spark.readStream.schema(schema).parquet(src).writeStream.foreachBatch(on_batch(g, facts)).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination()
    got = {(r.execution_id, r.key): r.fact for r in spark.read.parquet(facts).collect()}
    assert json.loads(got["e1", "p"]) == {"a0": 1, "a1": "two"} and ("e2", "p") not in got
    assert entry_facts(spark.read.parquet(facts)).count() == 2


def test_entry_runs(spark):
    assert QUERIES["decision_route"](spark, "/root/testdata/sf0.001").count() > 0
