"""Checks, values and reports that earlier versions had wrong."""

import json

import pytest
from pyspark.sql import functions as F

from sluice.functions import values as V
from sluice.operators import facts as FT
from sluice.operators.columns import lower_graph, value
from sluice.operators.migrate import AckRequired, classify, migrate
from sluice.operators.runtime import Capabilities, State, drive, entry_facts, execute, reports, until_quiescent
from sluice.plans import predicates as P
from sluice.plans.generator import generate
from sluice.plans.graph import compile_graph, diagnose
from sluice.plans.registry import contract, stock_registry
from sluice.streaming.reentry import on_batch, stored_facts


def _spec(nodes, exports, **more):
    return {"name": "g", "nodes": nodes, "exports": [{"name": a, "from": b} for a, b in exports], **more}


def _codes(spec, registry):
    return [d.code for d in diagnose(spec, registry)]


def test_weight_of_match_specifications():
    compare = {"kind": "compare", "path": ["x"], "op": "eq", "value": 1}
    assert P.rule_weight({"kind": "all", "of": [compare] * 14}) == 58
    assert P.rule_weight({"kind": "any", "of": [{"kind": "present", "path": ["x"]}, {"kind": "all", "of": [compare]}]}) == 2 + 3 + 2 + 4
    assert P.rule_weight({"expr": "x == 1 && present(x)"}) == 9


def test_fan_out_needs_one_required_input_in_all():
    reg = stock_registry()
    reg.routines |= {"t/pair@1": contract([{"name": "a"}, {"name": "b"}], [{"port": "value"}], "pure")}
    reg.graphs["t/g@1"] = (_spec([{"id": "p", "routine": "vec/pack@1", "in": {"a0": "$input.x", "a1": "$input.y"}}], [("o", "p")], inputs={"x": {}, "y": {}}), None)
    const = {"id": "c", "routine": "vec/const@1", "params": {"value": [1]}}
    assert "E_FANOUT_BIND" in _codes(_spec([const, {"id": "m", "routine": "t/pair@1", "in": {"a": "c[*]", "b": "c"}}], [("o", "m")]), reg)
    pair = _codes(_spec([const, {"id": "m", "species": "map", "body": "t/pair@1", "over": "x", "in": {"x": "c", "b": "c"}}], [("o", "m")]), reg)
    assert "E_FANOUT_BIND" in pair and "E_INPUT_UNBOUND" in pair  # b is fed, but a is required as well
    bound = {"id": "m", "species": "map", "body": "t/g@1", "over": "x", "bind": {"x": "0"}, "in": {"x": "c"}}
    g = compile_graph(_spec([const, bound], [("o", "m")]), reg)  # y may come at run time
    rows = {r["key"]: r for r in execute(g, execution_id="x")["rows"]}
    assert rows["m"]["outcome"] == "failed" and rows["m/0"]["error"]["code"] == "kernel/bind"


def test_unsatisfiable_match_is_checked_for_references_too():
    when = {"kind": "compare", "path": ["y"], "op": "lt", "value": True}
    spec = _spec([{"id": "c", "routine": "vec/const@1", "params": {"value": 1}}, {"id": "d", "species": "decision", "rules": [{"route": "a", "when": when}], "default": "b", "in": {"x": "c"}}], [("o", "d")])
    assert _codes(spec, stock_registry()) == ["E_MATCH_INVALID", "E_PRED_REF"]


def test_generated_specs_and_stock_failures():
    nodes = generate(6)["nodes"]
    assert nodes[2] == {"id": "n2", "routine": "vec/fail@1", "params": {"code": "vec/planned", "message": "planned failure", "retryable": False}}
    g = compile_graph(generate(6), stock_registry())
    failed = next(r for r in execute(g, execution_id="x")["rows"] if r["outcome"] == "failed")
    assert failed["error"] == {"code": "vec/planned", "message": "planned failure", "retryable": False}
    both_absent = compile_graph(_spec([{"id": "f", "routine": "t/f@1"}], [("o", "f")]), _with_failif())
    assert execute(both_absent, execution_id="x")["rows"][0]["error"] == {"code": "", "message": "matched", "retryable": False}


def _with_failif():
    reg = stock_registry()
    reg.routines["t/f@1"], reg.implementations["t/f@1"] = contract([], [{"port": "value"}], "pure"), reg.implementations["vec/failif@1"]
    return reg


def test_calls_have_ids_of_their_own():
    g = compile_graph(_spec([{"id": "k", "routine": "vec/keyecho@1"}, {"id": "e", "routine": "vec/echo@1", "in": {"in": "k"}}], [("o", "e")]), stock_registry())
    _, found = until_quiescent(g, State(), Capabilities(policy="single-wave"), "loop")
    assert [r["executionId"] for r in found] == ["loop-call-0", "loop-call-1"]


ECHO = _spec([{"id": "e", "routine": "vec/echo@1", "in": {"in": "$input.x"}}], [("o", "e")], inputs={"x": {}})


def test_no_text_raises(spark):
    texts = ["", " ", "{", "nul", '"x"', '{"$in/x":1e999}', '{"$in/x":"\ud83d"}'.encode("utf-16", "surrogatepass").decode("utf-16", "replace"), "[" * 100, '{"$in/x":' + "[" * 70 + "]" * 70 + "}", None, '{"$in/x":-0.0}', '{"e":1}']
    df = spark.createDataFrame([(str(i), t, "clash") for i, t in enumerate(texts)] + [(None, "{}", "x"), ("", "{}", "x")], "execution_id string, facts string, rows string")
    rows = reports(compile_graph(ECHO, stock_registry()), df).rows.collect()
    by = {r.execution_id: r for r in rows}
    assert len(rows) == len(texts) + 2
    assert {by[str(i)].error_code for i in (0, 1, 2, 3, 7)} == {"ingest/syntax"} | {by["7"].error_code}
    assert by["4"].error_code == "ingest/facts_not_a_map" and by["5"].error_code == "ingest/overflow" and by["8"].error_code == "ingest/depth"
    assert by["9"].outcome == "blocked" and by["10"].output == "0" and by["11"].outcome == "skipped"
    assert by[None].error_code == by[""].error_code == "kernel/options"


def test_broken_capabilities_end_one_execution(spark):
    df = spark.createDataFrame([("a", '{"$in/x":1}'), ("b", None)], "execution_id string, facts string")
    g = compile_graph(ECHO, stock_registry())
    for caps, code in ((lambda: Capabilities(policy="nope"), "kernel/options"), (lambda: 1 / 0, "kernel/crash")):
        assert {r.error_code for r in reports(g, df, caps).rows.collect()} == {code}


def test_drive_gives_all_facts(spark):
    spec = _spec([{"id": "a", "routine": "vec/echo@1", "in": {"in": "$input.x"}}, {"id": "b", "routine": "vec/pack@1", "in": {"a0": "a"}}, {"id": "c", "routine": "vec/echo@1", "in": {"in": "b"}}], [("o", "c")], inputs={"x": {}})
    df = spark.createDataFrame([("a-call-7", '{ "$in/x" : [1, "}"] } '), ("b", None), ("c", '{"$in/x":{}}')], "execution_id string, facts string")
    facts, last = drive(compile_graph(spec, stock_registry()), df, lambda: Capabilities(policy="single-wave"))
    assert {(r.execution_id, r.key): r.fact for r in facts.collect()} == {(e, k): v for e, x in (("a-call-7", '[1,"}"]'), ("c", "{}")) for k, v in (("a", x), ("b", f'{{"a0":{x}}}'), ("c", f'{{"a0":{x}}}'))}
    assert {r.execution_id: (r.calls, r.quiescent) for r in last.collect()} == {"a-call-7": (3, True), "b": (1, True), "c": (3, True)}


def test_entry_facts_quote_keys_and_show_conflicts(spark):
    df = spark.createDataFrame([("a", 'q"\\', "1"), ("b", "k", "1"), ("b", "k", "2"), ("c", "k", "1"), ("c", "k", "1")], "execution_id string, key string, fact string")
    got = {r.execution_id: r.facts for r in entry_facts(df).collect()}
    assert json.loads(got["a"]) == {'q"\\': 1} and json.loads(got["c"]) == {"k": 1}
    with pytest.raises(V.Reject, match="duplicate_key"):
        V.ingest(got["b"])


def test_a_batch_that_comes_twice(spark, tmp_path):
    run = on_batch(compile_graph(ECHO, stock_registry()), str(tmp_path))
    batch = spark.createDataFrame([("e1", "$in/x", "1")], "execution_id string, key string, fact string")
    for _ in range(2):
        run(batch, 0)
    run(spark.createDataFrame([("e1", "$in/z", "1")], batch.schema), 1)
    assert sorted((r.key, r.made_by, r.batch) for r in stored_facts(spark, str(tmp_path)).collect()) == [("$in/x", "caller", 0), ("$in/z", "caller", 1), ("e", "run", 0)]


def test_budget_after_earlier_waves(spark):
    ready = spark.createDataFrame([("x", i, "big") for i in range(4)] + [("y", 0, "big"), ("y", 1, "free")], "execution_id string, ord int, cost_class string")
    used = spark.createDataFrame([("x", "big", 1), ("x", "big", 1)], "execution_id string, cost_class string, ticks int")
    got = FT.budgeted(ready, {"big": 3}, used).filter("selected")
    assert sorted((r.execution_id, r.ord) for r in got.collect()) == [("x", 0), ("y", 0), ("y", 1)]


def test_invalidation_asks_the_renamed_position(spark):
    """A key that is both a position of its own and renamed: whether it needs an acknowledgement is asked of the renamed one."""
    reg = stock_registry()
    nodes = [{"id": "a", "routine": "vec/const@1", "params": {"value": 1}}, {"id": "b", "routine": "vec/keyecho@1"}]
    g = compile_graph(_spec(nodes, [("x", "a"), ("y", "b")], renames={"a": "b"}), reg)
    facts = spark.createDataFrame([("e", "a", "other", "a")], "execution_id string, key string, derivation string, node string")
    row = classify(facts, g).first()
    assert (row.classification, row.needs_ack) == ("invalidate", True)
    with pytest.raises(AckRequired):
        migrate(facts, g)
    moved = spark.createDataFrame([("e", "a", g.derivations["b"], "a"), ("e", "b", None, "b")], facts.schema)
    assert [(r.key, r.node) for r in migrate(moved, g, acknowledge=True).collect()] == [("b", "b")]


def test_variant_predicates_equal_the_evaluator(spark):
    docs = ['{"n":1}', '{"n":"1"}', '{"n":1.5}', '{"n":null}', "{}", '{"n":true}', '{"n":[1,2]}', '{"n":{"a":1,"b":2}}', '{"n":[]}', '{"n":[1,"a"]}', '{"n":"b"}', '{"n":100}', '{"n":{"a":{"b":[3,4]}}}']
    texts = ["x.n == 1", 'x.n == "1"', "x.n != 1", "x.n < 2", 'x.n >= "a"', "x.n", "!x.n", "present(x.n)", "absent(x.n)", "size(x.n) == 2", "x.n[0] == 1", "x.n.a == 1", "x.n.a.b[1] == 4", "x.n in [1, \"b\", true]", "x.n == null", "x.n != null", "x.n * 2 + 1 == 3", "x.n == x.n", "size(x) == 1", "x.n.0 == x.n.1"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "i int, t string").withColumn("x", F.parse_json("t"))
    x = P.column_of(df, "x")
    got = df.select("i", *[P.holds(P.parse(t), lambda path: P.resolve(x, path[1:]) if path[0] == "x" else None).alias(f"p{k}") for k, t in enumerate(texts)]).collect()
    for r in got:
        for k, t in enumerate(texts):
            assert bool(r[f"p{k}"]) == (P.evaluate(P.parse(t), {"x": V.ingest(docs[r["i"]])}) is True), (t, docs[r["i"]])


def test_column_graphs_equal_the_wave_runtime(spark):
    """One graph with joins, gates, orders, an invoked graph and a fan-out, lowered and by waves."""
    reg = stock_registry()
    reg.graphs["t/child@1"] = (_spec([{"id": "k", "routine": "vec/failif@1", "params": {"when": 2, "code": "t/two"}, "in": {"in": "$input.x"}}], [("out", "k")], inputs={"x": {}, "y": {"optional": True}}), None)
    fail = {"routine": "vec/failif@1", "params": {"when": 1, "code": "t/one"}}
    nodes = [
        {"id": "a", **fail, "in": {"in": "$input.p"}},
        {"id": "b", "routine": "vec/echo@1", "in": {"in": "$input.q"}, "needs": ["a"]},
        {"id": "d", "species": "decision", "rules": [{"route": "big", "when": {"expr": "v > 2"}, "to": ["h"]}], "default": "small", "in": {"v": "b"}},
        {"id": "h", "routine": "vec/echo@1", "in": {"in": "a"}},
        {"id": "i", "species": "invoke", "graph": "t/child@1", "in": {"x": "$input.p"}},
        {"id": "j", "routine": "vec/echo@1", "joins": {"in": "any"}, "in": {"in": ["a", "i.out"]}},
        {"id": "m", **fail, "in": {"in": "$input.l[*]"}},
        {"id": "g", "species": "map", "body": "t/child@1", "over": "x", "absorb": True, "in": {"x": "$input.l"}},
    ]
    g = compile_graph(_spec(nodes, [(n["id"], n["id"]) for n in nodes], inputs={"p": {}, "q": {}, "l": {}}), reg)
    bodies = {"vec/echo@1": lambda env, params: value(env["in"]), "vec/failif@1": lambda env, params: value(env["in"], F.when(env["in"].column == params["when"], F.lit(params["code"])))}
    rows = [(i, p, q, x) for i, (p, q, x) in enumerate((p, q, x) for p in (None, 1, 2, 3) for q in (None, 1, 3) for x in (None, [], [1, 2, 3], [3]))]
    df = spark.createDataFrame(rows, "i long, p long, q long, l array<long>")
    low = lower_graph(g, df, {c: P.column_of(df, c) for c in "pql"}, bodies)
    mine = {(r.i, r.key): (r.outcome, r.error_code, r.cause_kind, r.cause_node, r.awaiting) for r in low.report("i").collect()}
    for i, p, q, x in rows:
        given = {f"$in/{k}": v for k, v in (("p", p), ("q", q), ("l", x)) if v is not None}
        for r in execute(g, State(given), execution_id="x")["rows"]:
            if "/" not in r["key"]:
                cause = r.get("cause") or {}
                awaiting = [w["key"] for w in r["awaiting"]] if r["outcome"] == "blocked" and r["key"] != "i" else None
                got = mine[i, r["key"]]
                assert got[:4] == (r["outcome"], (r.get("error") or {}).get("code"), cause.get("kind"), cause.get("node") or cause.get("decision")), (i, r, got)
                assert r["key"] == "i" or got[4] == awaiting, (i, r, got)
