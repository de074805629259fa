"""What a graph may refer to: routine contracts, their implementations, and other graphs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any


class Failure(Exception):
    """A routine's failure; retryable is None when the routine did not say, and may count without being said."""

    def __init__(self, code: str, message: str = "", retryable: bool | None = None, detail: Any = None, said: bool = True):
        super().__init__(code)
        self.code, self.message, self.retryable, self.detail, self.said = code, message, retryable, detail, said

    def value(self) -> dict:
        out: dict = {"code": self.code, "message": self.message}
        if self.retryable is not None and self.said:
            out["retryable"] = self.retryable
        if self.detail is not None:
            out["detail"] = self.detail
        return out

    def __reduce__(self):
        return Failure, (self.code, self.message, self.retryable, self.detail, self.said)


@dataclass(frozen=True)
class Contract:
    inputs: dict[str, dict]  # name -> {shape, optional, sensitivity, configEligible, secret}
    outputs: dict[str, dict]  # port -> {shape, sensitivity}
    effect: str = "effectful"
    cost_class: str = "default"

    @property
    def effectful(self) -> bool:
        return self.effect != "pure"

    @property
    def bare(self) -> bool:
        """A single port named value commits its value alone."""
        return list(self.outputs) == ["value"]


def contract(inputs: list[dict], outputs: list[dict], effect: str = "effectful", costClass: str = "default") -> Contract:  # noqa: N803
    return Contract({i["name"]: i for i in inputs}, {o["port"]: o for o in outputs}, effect, costClass)


@dataclass
class Registry:
    identity: str = "registry@0"
    routines: dict[str, Contract] = field(default_factory=dict)
    implementations: dict[str, Callable[[dict], dict]] = field(default_factory=dict)
    graphs: dict[str, tuple[dict, Registry | None]] = field(default_factory=dict)
    compiled: dict[str, Any] = field(default_factory=dict)

    def graph(self, ref: str):
        """The compiled graph of a reference; None if it is unbound, does not compile, or is being compiled."""
        if ref not in self.compiled:
            from .graph import GraphError, compile_graph

            self.compiled[ref] = None
            if ref in self.graphs:
                spec, registry = self.graphs[ref]
                try:
                    self.compiled[ref] = compile_graph(spec, registry or self)
                except GraphError:
                    pass
        return self.compiled[ref]


def from_document(doc: dict, implementations: dict[str, Callable] | None = None) -> Registry:
    out = Registry(doc.get("identity", "registry@0"), implementations=dict(implementations or {}))
    out.routines = {ref: contract(c.get("inputs", []), c.get("outputs", []), c.get("effect", "effectful"), c.get("costClass", "default")) for ref, c in doc.get("routines", {}).items()}
    out.graphs = {ref: (g["spec"] if "spec" in g else g, None) for ref, g in doc.get("graphs", {}).items()}
    return out


def _value(name: str):
    return lambda env: {"value": env.get(name)}


def _text(env: dict, name: str) -> str:
    return env[name] if isinstance(env.get(name), str) else ""


#: Fixed values, here and in the two below: the codes and messages of the stock failures.
def _fail(env: dict) -> dict:
    raise Failure(_text(env, "code"), _text(env, "message"), env.get("retryable") is True)


def _flaky(env: dict) -> dict:
    wanted = env.get("succeed_on")
    if env.get("$attempt", 0) < (wanted if type(wanted) is int else 0):
        raise Failure("vec/again", "not yet", True, said=False)
    return {"value": env.get("value")}


def _fail_if(env: dict) -> dict:
    from ..functions.values import equal

    if equal(env.get("in"), env.get("when")):
        raise Failure(_text(env, "code"), "matched", False)
    return {"value": env.get("in")}


def _deep(env: dict) -> dict:
    value: Any = 0
    for _ in range(env["n"] if type(env.get("n")) is int else 0):
        value = [value]
    return {"value": value}


#: The stock routines: plain Python, one envelope in, one map of ports out.
STOCK: dict[str, Callable[[dict], dict]] = {
    "vec/const@1": _value("value"),
    "vec/echo@1": _value("in"),
    "vec/sense@1": _value("in"),
    "vec/pack@1": lambda env: {"value": {k: env[k] for k in ("a0", "a1", "a2", "a3", "a4", "a5") if k in env}},
    "vec/two@1": lambda env: {"a": env.get("a"), "b": env.get("b")},
    "vec/scrub@1": lambda env: {"value": "scrubbed"},
    "vec/fail@1": _fail,
    "vec/flaky@1": _flaky,
    "vec/keyecho@1": lambda env: {"value": {"key": env.get("$key")}},
    "vec/failif@1": _fail_if,
    "vec/deep@1": _deep,
}

_ANY = {"shape": {"kind": "any"}}
_IN = {"name": "in", "optional": True, **_ANY}
_CONFIG = lambda *names: [{"name": n, "configEligible": True, "optional": True, **_ANY} for n in names]
_OUT = [{"port": "value", **_ANY}]


def stock_registry() -> Registry:
    """The stock routines under contracts that their bodies call for."""
    out = Registry("vec-registry@0.1.0", implementations=dict(STOCK))
    out.routines = {
        "vec/const@1": contract([{"name": "value", "configEligible": True, **_ANY}], _OUT, "pure"),
        "vec/echo@1": contract([{"name": "in", **_ANY}], _OUT, "pure"),
        "vec/sense@1": contract([{"name": "in", **_ANY}], [{"port": "value", "sensitivity": "pii"}], "pure"),
        "vec/pack@1": contract([{"name": f"a{i}", "optional": True, **_ANY} for i in range(6)], _OUT, "pure"),
        "vec/two@1": contract(_CONFIG("a", "b"), [{"port": "a"}, {"port": "b"}], "pure"),
        "vec/scrub@1": contract([_IN], [{"port": "value", "sensitivity": "public"}], "pure"),
        "vec/fail@1": contract([_IN, *_CONFIG("code", "message", "retryable")], _OUT, "effectful", "effect"),
        "vec/flaky@1": contract([_IN, *_CONFIG("value", "succeed_on")], _OUT, "effectful", "effect"),
        "vec/keyecho@1": contract([_IN], _OUT, "effectful", "effect"),
        "vec/failif@1": contract([{"name": "in", **_ANY}, *_CONFIG("when", "code")], _OUT, "pure"),
        "vec/deep@1": contract([_IN, *_CONFIG("n")], _OUT, "pure"),
    }
    return out
