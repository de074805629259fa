import json

import pytest

from sluice.functions import values as V
from sluice.operators.policies import policy
from sluice.operators.runtime import Capabilities, KernelError, State, execute, until_quiescent
from sluice.plans import predicates as P
from sluice.plans.generator import SplitMix64, generate
from sluice.plans.graph import GraphError, compile_graph
from sluice.plans.registry import contract, stock_registry

GOLDEN = {
    "null": "6e340b9cffb37a989ca544e6bb780a2c78901d3fb33738768511a30617afa01d",
    "true": "dbc1b4c900ffe48d575b5da5c638040125f65db0fe3e24494b76ea986457d986",
    "0": "41f45e0c4ba13f0e8c873f321d4a83b354816b4f6f1c7cb51b97d7fae02ebe25",
    "-1": "cddff891c965782063de904a1c3fab4003c898e7519aa80b8402c70147e58a92",
    "258": "cad3777994fff44d1c6a754edb3d7f12fe6898a1dc0ad98092390232822e63c3",
    "1.5": "a39f5f7616203e78dbc030cf0b3c757dbafe91dca679b94ddbb4a4ef9fda84b9",
    '"ab"': "ad4abb4c1097b65b4f8fb65a01e4a0e62a7d140ed273eea17303d8693b37f452",
    "[]": "69c29c051218dbea38795b1cdfd816855c312a9cbc0b1daaa79bb9a0b895361a",
    "{}": "7e2e8b49f93a4f1fcd3d8c53db08bcd2fb714f1d91d4db7ed0b8786c572f9164",
    '{"a":1}': "d98ffd29dca0ab5a63af61a48e5b61d7ec395460290ae3f3b1861f14d62674f7",
    '[1,"a",null]': "f8d710346870ecb52a2aabd5699e2f2730af35f118b719358c1d19def002c0c5",
}


@pytest.mark.parametrize("text", GOLDEN)
def test_structural_hash_and_render(text):
    assert V.structural_hash(V.ingest(text)) == GOLDEN[text]
    assert V.render(V.ingest(text)) == text


@pytest.mark.parametrize("text,want", [("1.0", "1"), ("-0.0", "0"), ("1e3", "1000"), ("1e21", "1e+21"), ("1.5e-7", "1.5e-07"), ("0.0001", "0.0001"), ("1e-400", "0"), ("123456789.25", "123456789.25")])
def test_numbers(text, want):
    assert V.render(V.ingest(text)) == want


@pytest.mark.parametrize("text,reason", [('"\\ud800"', "surrogate"), ('{"a":1,"a":1}', "duplicate_key"), ("1" * 101, "number_literal_length"), ("9007199254740992", "integer_range"), ("1e999", "overflow"), ("[" * 65 + "]" * 65, "depth"), ('"' + "x" * (1 << 20) + 'y"', "string_length"), ("1 2", "syntax")])
def test_rejects(text, reason):
    with pytest.raises(V.Reject) as got:
        V.ingest(text)
    assert got.value.reason == reason


def test_pointer():
    doc = {"a/b": [10, {"~": 5}]}
    assert V.pointer(doc, "/a~1b/1/~0") == 5 and V.pointer(doc, "/a~1b/01") is V.ABSENT and V.pointer(doc, "") is doc


@pytest.mark.parametrize(
    "text,env,want",
    [
        ("!(missing == 1)", {}, True), ("missing != 1", {}, False), ("a != 1", {"a": "1"}, True), ("a == 1", {"a": 1}, True), ('a < "b"', {"a": "a"}, True), ("a < 1", {"a": "0"}, False),
        ("a in [1, 2]", {"a": 2}, True), ("a in b", {"a": 2, "b": [1, 2]}, True), ("size(a) > 1", {"a": [1, 2]}, True), ("size(a) > 1", {"a": "xx"}, False), ("present(a)", {"a": None}, True), ("absent(a.b)", {"a": {}}, True),
        ("a * 2 + 1 == 7", {"a": 3}, True), ("a[1] == 5", {"a": [4, 5]}, True), ("a.0 == 4 && a.1 == 5", {"a": [4, 5]}, True), ("a || true", {"a": 3}, True), ("a-1 == 2", {"a-1": 2}, True), ("a == -1", {"a": -1}, True), ("a - 1 == 2", {"a": 3}, True),
    ],
)
def test_predicates(text, env, want):
    assert P.evaluate(P.parse(text), env) is want


@pytest.mark.parametrize("text", ["a ==", "a == b == c", "a & b", "(a", 'a == "x', "a\n== 1"])
def test_parse_errors(text):
    with pytest.raises(P.ParseError):
        P.parse(text)


@pytest.mark.parametrize("later,earlier,want", [("a > 5", "a > 3", True), ("a > 3", "a > 5", False), ("a == 4 && b == 1", "a >= 4", True), ("a > 3", "b > 1", False), ('a == "x"', "a != 1", True), ("a != 1", "a != 2", False), ("a > 1 && a < 1", "a == 9", True), ("a >= 1 && a <= 1", "a == 1", True)])
def test_shadowing(later, earlier, want):
    assert P.implies(P.conjunction(P.parse(later)), P.conjunction(P.parse(earlier))) is want


CONST = {"id": "c", "routine": "vec/const@1", "params": {"value": 1}}
ECHO = {"id": "e", "routine": "vec/echo@1", "in": {"in": "c"}}


def _spec(nodes, exports=(("o", "e"),), **more):
    return {"name": "g", "nodes": nodes, "exports": [{"name": a, "from": b} for a, b in exports], **more}


def _decision(when, default="lo", route="hi"):
    return {"id": "d", "species": "decision", "rules": [{"route": route, "when": when}], "default": default, "in": {"x": "c"}}


def _codes(spec, strict=False, registry=None):
    try:
        return [d.code for d in compile_graph(spec, registry or stock_registry(), strict).lints]
    except GraphError as why:
        return [d.code for d in why.diagnostics]


CASES = {
    "E_SCHEMA": _spec([CONST | {"odd": 1}, ECHO]),
    "E_IDENT": _spec([CONST, ECHO], name="G!"),
    "E_NODE_DUP": _spec([CONST, CONST, ECHO]),
    "E_EXPORT_DUP": _spec([CONST, ECHO], (("o", "e"), ("o", "c"))),
    "E_REF_UNKNOWN": _spec([CONST, ECHO | {"routine": "no/such@1"}]),
    "E_DECISION_ROUTE_DUP": _spec([CONST, _decision({"expr": "x > 1"}, "hi")], (("o", "d"),)),
    "E_ENDPOINT_PARSE": _spec([CONST, ECHO | {"in": {"in": "c..x"}}]),
    "E_EDGE_UNKNOWN_NODE": _spec([CONST, ECHO | {"in": {"in": "zz"}}], (("o", "e"), ("p", "c"))),
    "E_EDGE_UNKNOWN_PORT": _spec([CONST, {"id": "t", "routine": "vec/two@1", "in": {"in": "c"}}, ECHO | {"in": {"in": "t.zz"}}]),
    "E_EDGE_UNKNOWN_INPUT": _spec([CONST, ECHO | {"in": {"in": "c", "zz": "c"}}]),
    "E_INPUT_UNDECLARED": _spec([ECHO | {"in": {"in": "$input.q"}}]),
    "E_ORDER_PATH": _spec([CONST, ECHO | {"needs": ["c.x"]}]),
    "E_GATE_UNKNOWN_ROUTE": _spec([CONST, _decision({"expr": "x > 1"}), ECHO | {"needs": ["d.route.zz"]}], (("o", "e"), ("p", "d"))),
    "E_DUP_BINDING": _spec([CONST, ECHO | {"in": {"in": ["c", "c"]}}]),
    "E_JOIN_INVALID": _spec([CONST, ECHO | {"joins": {"zz": "all"}}]),
    "E_CYCLE": _spec([{"id": "c", "routine": "vec/echo@1", "in": {"in": "e"}}, ECHO]),
    "E_UNREACHABLE": _spec([CONST, ECHO, {"id": "u", "routine": "vec/pack@1"}]),
    "E_EXPORT_UNKNOWN": _spec([CONST, ECHO], (("o", "e"), ("p", "zz"))),
    "E_PARAM_UNDECLARED": _spec([CONST, ECHO | {"params": {"in": 2}, "in": {}}]),
    "E_PARAM_INPUT_COLLISION": _spec([CONST, {"id": "e", "routine": "vec/const@1", "params": {"value": 2}, "in": {"value": "c"}}]),
    "E_INPUT_UNBOUND": _spec([{"id": "e", "routine": "vec/echo@1"}]),
    "E_FANOUT_BIND": _spec([CONST, {"id": "e", "routine": "vec/pack@1", "in": {"a0": "c[*]"}}]),
    "E_PRED_PARSE": _spec([CONST, _decision({"expr": "x >"})], (("o", "d"),)),
    "E_PRED_COMPUTES": _spec([CONST, _decision({"expr": "x + x == 1"})], (("o", "d"),)),
    "E_PRED_REF": _spec([CONST, _decision({"expr": "y == 1"})], (("o", "d"),)),
    "E_PRED_TOO_COMPLEX": _spec([CONST, _decision({"expr": " && ".join(["x == 1"] * 12)})], (("o", "d"),)),
    "E_MATCH_INVALID": _spec([CONST, _decision({"kind": "compare", "path": ["x"], "op": "lt", "value": True})], (("o", "d"),)),
    "E_SENS_NO_SUBJECT": _spec([CONST, {"id": "e", "routine": "vec/sense@1", "in": {"in": "c"}}]),
    "E_SENS_LEAK": _spec([CONST, ECHO], distribution="client"),
    "L_INPUT_UNUSED": _spec([CONST, ECHO], inputs={"q": {}}),
    "L_RULE_SHADOWED": _spec([CONST, {"id": "d", "species": "decision", "rules": [{"route": "a", "when": {"expr": "x > 1"}}, {"route": "b", "when": {"expr": "x > 2"}}], "default": "z", "in": {"x": "c"}}], (("o", "d"),)),
}


@pytest.mark.parametrize("code", CASES)
def test_diagnostics(code):
    assert code in _codes(CASES[code])


def test_shape_mismatch_and_near_misses():
    reg = stock_registry()
    port = lambda kind: contract([], [{"port": "value", "shape": {"kind": kind}}], "pure")
    reg.routines |= {"t/int@1": port("integer"), "t/str@1": port("string"), "t/num@1": contract([{"name": "in", "shape": {"kind": "number"}}], [{"port": "value"}], "pure")}
    make = lambda ref: _spec([{"id": "c", "routine": ref}, {"id": "e", "routine": "t/num@1", "in": {"in": "c"}}])
    assert _codes(make("t/str@1"), registry=reg) == ["E_SHAPE_MISMATCH"] and _codes(make("t/int@1"), registry=reg) == []
    assert _codes(_spec([CONST, ECHO])) == []
    assert "L_INPUT_UNUSED" in _codes(CASES["L_INPUT_UNUSED"], strict=True)


def test_canonical_form_and_derivations():
    sugar = compile_graph(_spec([ECHO, CONST]), stock_registry())
    plain = compile_graph(_spec([CONST, {"id": "e", "species": "routine", "routine": "vec/echo@1"}], edges=[{"kind": "data", "from": "c", "to": "e.in"}]), stock_registry())
    assert sugar.hash == plain.hash and sugar.derivations == plain.derivations
    assert [e["id"] for e in sugar.spec["edges"]] == ["d:e:in:0"]
    moved = compile_graph(_spec([CONST, ECHO | {"id": "e2"}], (("o", "e2"),)), stock_registry())
    assert moved.hash != sugar.hash and moved.derivations["e2"] == sugar.derivations["e"]


def test_generator_samples():
    assert [hex(SplitMix64(1).next())] == ["0x910a2dec89025cc1"]
    assert [len(generate(s)["nodes"]) for s in (1, 2, 3, 6, 7)] == [2, 2, 5, 4, 4]
    assert [s for s in range(1, 40) if any("fail" in n["routine"] for n in generate(s)["nodes"])] == [6, 8, 11, 14, 17, 18, 21, 26, 39]


SEEDS = range(1, 13)


@pytest.mark.parametrize("seed", SEEDS)
def test_theorems(seed):
    g = compile_graph(generate(seed), stock_registry())
    whole = execute(g, execution_id="t")
    for caps in (Capabilities(policy="single-wave"), Capabilities(policy="budgeted", config={"ceilings": {"default": 1, "effect": 1}})):
        state, reports = until_quiescent(g, State(), caps, "t")
        assert state.facts == whole["facts"]  # confluence
        for a, b in zip(reports, reports[1:], strict=False):  # settled rows stay as they are
            before = {r["key"]: r["outcome"] for r in a["rows"]}
            for r in b["rows"]:
                if before[r["key"]] in ("executed", "skipped"):
                    assert r["outcome"] == "skipped"
    again = execute(g, State(whole["facts"]), execution_id="t")
    assert again["facts"] == {}  # replay
    for a, b in zip(whole["rows"], again["rows"], strict=True):
        assert b["outcome"] == "skipped" if a["outcome"] == "executed" else a == b
    memo: dict = {}
    execute(g, None, Capabilities(memo=memo), "t")
    warm = execute(g, None, Capabilities(memo=memo), "t")
    strip = lambda rows: [{k: v for k, v in r.items() if k != "cached"} for r in rows]
    assert warm["facts"] == whole["facts"] and strip(warm["rows"]) == strip(whole["rows"]) and any(r.get("cached") for r in warm["rows"])
    with pytest.raises(KernelError):
        execute(g, None, Capabilities(decide=lambda ready, used, wave: ("run", ["nope"])), "t")


def test_outcomes_of_one_graph():
    reg = stock_registry()
    reg.graphs["g/child@1"] = (_spec([{"id": "k", "routine": "vec/echo@1", "in": {"in": "$input.x"}}], (("out", "k"),), inputs={"x": {}}), None)
    nodes = [
        {"id": "c", "routine": "vec/const@1", "params": {"value": [1, "error", 3]}},
        {"id": "m", "routine": "vec/failif@1", "params": {"when": "error"}, "in": {"in": "c[*]"}},
        {"id": "ma", "routine": "vec/failif@1", "params": {"when": "error"}, "absorb": True, "in": {"in": "c[*]"}},
        {"id": "b", "routine": "vec/echo@1", "bind": {"in": "x"}, "absorb": True, "in": {"in": "c[*]"}},
        {"id": "g", "species": "map", "body": "g/child@1", "over": "x", "in": {"x": "c"}},
        {"id": "i", "species": "invoke", "graph": "g/child@1", "in": {"x": "$input.q"}},
        {"id": "fl", "routine": "vec/flaky@1", "params": {"succeed_on": 3}, "retry": {"maxAttempts": 2, "backoff": "1s"}},
        {"id": "cr", "routine": "vec/deep@1", "params": {"n": 70}, "absorb": True},
        {"id": "k", "routine": "vec/keyecho@1"},
    ]
    g = compile_graph(_spec(nodes, tuple((f"o{j}", n["id"]) for j, n in enumerate(nodes)), inputs={"q": {}}), reg)
    events: list = []
    report = execute(g, None, Capabilities(observe=events.append), "x")
    rows = {r["key"]: r for r in report["rows"]}
    assert rows["m"]["error"] == {"code": "kernel/fanout_child", "message": "child 1 failed", "retryable": False, "detail": {"index": 1}}
    assert [e["status"] for e in rows["ma"]["output"]] == ["ok", "error", "ok"]
    assert all(e["error"]["code"] == "kernel/bind" for e in rows["b"]["output"])
    assert rows["g"]["output"][0] == {"status": "ok", "value": {"out": 1}} and rows["g/0/k"]["outcome"] == "executed"
    assert rows["i"]["outcome"] == "blocked" and rows["i"]["awaiting"][0]["key"] == "$in/q"
    assert (rows["fl"]["attempts"], rows["fl"]["backoff"]) == (2, "1s")
    assert rows["cr"]["absorbed"] and rows["cr"]["output"]["error"]["code"] == "kernel/bounds"
    assert rows["k"]["output"] == {"key": V.structural_hash(["x", "k"])}
    assert report["cost"]["used"]["effect"] == 3 and report["quiescent"] and events[0]["event"] == "execution_started"
    json.dumps(report)


def test_seal_and_policies():
    spec = _spec([{"id": "s", "routine": "vec/sense@1", "in": {"in": "$input.who"}}], (("o", "s"),), inputs={"who": {"subject": True}})
    g, vault = compile_graph(spec, stock_registry()), {}
    with pytest.raises(KernelError, match="kernel/seal"):
        execute(g, State({"$in/who": "ann"}), None, "x")
    got = execute(g, State({"$in/who": "ann"}), Capabilities(seal=lambda h, s, v: vault.update({h: (s, v)})), "x")
    assert got["facts"]["s"] == {"sealed": True, "contentHash": V.structural_hash("ann")} and vault[V.structural_hash("ann")] == ("ann", "ann")
    ready = [("a", "big"), ("b", "small"), ("c", "big")]
    assert policy("defer-costly", {"order": ["small"]})(ready, {}, 0) == ("run", ["b"])
    from collections import Counter

    assert policy("budgeted", {"ceilings": {"big": 1}})(ready, Counter(), 0) == ("run", ["a", "b"])
    assert policy("script", {"waves": ["all", ["a"], {"yield": "why"}]})(ready, {}, 2) == ("yield", "why")
    assert policy("script", {"waves": []})(ready, {}, 0) == ("yield", "script-exhausted")
